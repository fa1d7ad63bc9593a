"""Hard negatives by inner product, with length buckets and coordinate pruning (the LEMP scheme).

Vectors are dealt by length into levels, levels into cells of bounded size, and a cell into buckets
of falling length.  A bucket holds, for every coordinate, its rows in the order of that coordinate.
An anchor that still looks for scores of ``t`` or more skips a bucket whose longest row cannot reach
``t``.  Otherwise the angle between the anchor and any row it wants is bounded, and with it the
values of the anchor's focus coordinates (its largest ones): the rows inside all of these ranges are
the candidates, whose scores are then computed exactly.  Where the ranges leave most of a bucket, all
its rows are verified in one product.

Anchors meet cells as blocks of a grid, at most ``GROUP`` anchors and one cell in a task at a time.
A first round over one cell finds scores that every anchor reaches, so that the second round over
the other cells starts with them as thresholds; both thresholds and buckets only skip what cannot
be among the first.
"""
from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from secframe.llm.common import Scratch, spark_partitions, table

#: Levels of length, bytes of vectors in a cell, rows of a bucket, anchors that meet a cell at once.
LEVELS, CELL_BYTES, BUCKET_ROWS, GROUP = 16, 4_000_000, 1024, 2048
#: Focus coordinates of an anchor; share of a bucket up to which ranges are intersected.
FOCUS, NARROW = 4, 0.5
BLOCK = 256
SLACK = 1e-7
_ROW = "id bigint, label bigint, wide boolean, length double, data binary"


def _scaled(df: DataFrame, id: str, vector: str, label: Column, scale: int, extra: dict[str, Column]) -> DataFrame:
    """(at, id, label, wide, length, data, extra) of the rows that take part; components as floor(scale * x)."""
    rows = df.select(F.col(id).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                     F.col(vector).cast("array<double>").alias("v"), *[c.alias(n) for n, c in extra.items()])
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))

    names = ["id", "label", "wide", "length", "data", *extra]

    def pack(batches):
        for batch in batches:
            values = batch.column(2)
            ends = values.offsets.to_numpy()
            flat = np.floor(scale * values.values.to_numpy(zero_copy_only=False))
            parts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
            wide = [bool(len(p)) and bool(np.abs(p).max() > 32767) for p in parts]
            data = [p.tobytes() if w else p.astype(np.int16).tobytes() for p, w in zip(parts, wide)]
            length = [float(np.sqrt(np.dot(p, p))) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(wide, pa.bool_()), pa.array(length, pa.float64()),
                                              pa.array(data, pa.binary()), *batch.columns[3:]], names)

    kinds = "".join(f", {n} boolean" for n in extra)
    return rows.mapInArrow(pack, _ROW + kinds).withColumn("at", F.monotonically_increasing_id())


def _matrix(data, wide) -> np.ndarray:
    """Rows of packed vectors as doubles, shorter ones filled up with zeros."""
    rows = [np.frombuffer(d, np.float64 if w else np.int16) for d, w in zip(data, wide)]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


class Levels:
    """Levels of falling length and how many cells each is cut into: at most ``LEVELS`` numbers on the driver."""

    def __init__(self, base: DataFrame):
        shares = [i / LEVELS for i in range(LEVELS - 1, 0, -1)]
        (row,) = base.agg(F.percentile_approx("length", shares, 10_000).alias("cuts")).collect()
        self.cuts = sorted(set(row.cuts or ()), reverse=True)
        sizes = base.groupBy(self.level().alias("level")).agg(F.sum(F.length("data") + 16).alias("bytes"), F.max("length").alias("top")).orderBy("level").collect()
        self.top = [r.top for r in sizes]
        self.parts = [max(1, ceil(r.bytes / CELL_BYTES)) for r in sizes]
        self.first = [sum(self.parts[:i]) for i in range(len(self.parts))]
        self.order = {r.level: i for i, r in enumerate(sizes)}
        self.cells = sum(self.parts)

    def level(self) -> Column:
        out = F.lit(0)
        for cut in self.cuts:
            out = out + (F.col("length") <= cut).cast("int")
        return out

    def cell(self) -> Column:
        """Cell of a row: its level, and a part of it by a stored row number, so that equal rows spread too."""
        at, out = F.xxhash64("at"), F.lit(0).cast("bigint")
        for level, i in self.order.items():
            out = F.when(self.level() == level, self.first[i] + F.pmod(at, F.lit(self.parts[i]))).otherwise(out)
        return out

    def reached(self, threshold: Column, length: Column) -> Column:
        """Cells, without the first one, whose longest rows can give an anchor a score of the threshold."""
        lists = [F.when(length * top * (1 + SLACK) >= threshold, F.sequence(F.lit(first), F.lit(first + parts - 1)))
                 .otherwise(F.array().cast("array<int>")) for top, first, parts in zip(self.top, self.first, self.parts)]
        return F.filter(F.flatten(F.array(*lists)), lambda c: c > 0)


def _buckets(base: DataFrame, levels: Levels, partitions: int) -> DataFrame:
    """One row per bucket: cell, longest row, ids, labels, vectors and the sorted coordinate lists."""
    dealt = base.select(levels.cell().alias("cell"), "length", "id", "label", "wide", "data").repartition(
        min(partitions, max(1, levels.cells)), "cell").sortWithinPartitions("cell", F.desc("length"))

    def bucket(cell, rows):
        m = _matrix(rows["data"], rows["wide"])
        ids = pd.array(rows["id"], dtype="Int64")
        small = not m.size or np.abs(m).max() <= 32767
        return {"cell": cell, "top": float(max(rows["length"])), "n": len(m), "dim": m.shape[1], "wide": not small,
                "ids": ids.fillna(0).to_numpy(dtype=np.int64).tobytes(), "unnamed": np.asarray(ids.isna(), bool).tobytes(),
                "labels": np.array(rows["label"], np.int64).tobytes(), "lengths": np.array(rows["length"]).tobytes(),
                "m": (m.astype(np.int16) if small else m).tobytes(),
                "lists": np.argsort(m / np.maximum(np.array(rows["length"]), 1e-300)[:, None], axis=0, kind="stable").T.astype(np.uint16).tobytes()}

    def pack(batches):
        held, cell = {k: [] for k in ("length", "id", "label", "wide", "data")}, None

        def out():
            return pa.RecordBatch.from_pylist([bucket(cell, held)], schema=schema)
        for batch in batches:
            for row in batch.to_pylist():
                if held["id"] and (row["cell"] != cell or len(held["id"]) >= BUCKET_ROWS):
                    yield out()
                    held = {k: [] for k in held}
                cell = row["cell"]
                for k in held:
                    held[k].append(row[k])
        if held["id"]:
            yield out()

    schema = pa.schema([("cell", pa.int64()), ("top", pa.float64()), ("n", pa.int32()), ("dim", pa.int32()), ("wide", pa.bool_()),
                        *[(k, pa.binary()) for k in ("ids", "unnamed", "labels", "lengths", "m", "lists")]])
    return dealt.mapInArrow(pack, "cell bigint, top double, n int, dim int, wide boolean, ids binary, unnamed binary, labels binary, "
                                  "lengths binary, m binary, lists binary")


class Bucket:
    def __init__(self, row):
        self.n, self.top = row.n, row.top
        self.ids, self.unnamed = np.frombuffer(row.ids, np.int64), np.frombuffer(row.unnamed, bool)
        self.labels, self.lengths = np.frombuffer(row.labels, np.int64), np.frombuffer(row.lengths)
        self.m = np.frombuffer(row.m, np.float64 if row.wide else np.int16).reshape(row.n, row.dim).astype(np.float64)
        self.lists = np.frombuffer(row.lists, np.uint16).reshape(row.dim, row.n)
        self._values = {}

    def values(self, f: int) -> np.ndarray:
        """Coordinate ``f`` of the unit vectors, in the order of its list."""
        if f not in self._values:
            order = self.lists[f]
            self._values[f] = self.m[order, f] / np.maximum(self.lengths[order], 1e-300)
        return self._values[f]

    def candidates(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows that can have this cosine to the anchor, by its focus coordinates; None where that leaves most rows."""
        if cosine <= 0:
            return None
        turn, spans = np.arccos(min(1.0, cosine)), []
        for f in focus[focus < len(self.lists)]:
            at = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, at + turn)) - SLACK, np.cos(max(0.0, at - turn)) + SLACK
            v = self.values(int(f))
            spans.append((int(f), np.searchsorted(v, low), np.searchsorted(v, high, "right")))
        if not spans or min(b - a for _, a, b in spans) > NARROW * self.n:
            return None
        hits = np.zeros(self.n, np.int8)
        for f, a, b in spans:
            hits[self.lists[f, a:b]] += 1
        return np.flatnonzero(hits == len(spans))


class First:
    """The first ``k`` rows of one wish: highest score first, then smaller id, rows without an id last."""

    def __init__(self, k: int, low: float, high: float):
        self.k, self.low, self.high, self.rows = k, low, high, []

    def threshold(self) -> float:
        return max(self.low, -self.rows[-1][0]) if len(self.rows) == self.k else self.low

    def offer(self, scores: np.ndarray, bucket: Bucket, rows: np.ndarray) -> None:
        fit = (scores >= self.threshold()) & (scores <= self.high)
        if not fit.any():
            return
        s, r = scores[fit], rows[fit]
        best = np.lexsort((bucket.ids[r], bucket.unnamed[r], -s))[:self.k]
        self.rows = sorted(self.rows + [(-s[i], bool(bucket.unnamed[r[i]]), int(bucket.ids[r[i]])) for i in best])[:self.k]


def _search(anchors: pd.DataFrame, buckets: pd.DataFrame, same: bool) -> list[tuple]:
    """(anchor, wish, id, score) of the first rows of every wish among these buckets."""
    q = _matrix(anchors["data"], anchors["wide"])
    lengths = anchors["length"].to_numpy()
    unit = q / np.maximum(lengths, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    labels, ids = anchors["label"].to_numpy(), anchors["id"].to_numpy()
    wishes = [[First(int(k), lo, hi) for k, lo, hi in zip(w[0::3], w[1::3], w[2::3])] for w in anchors["wishes"]]
    for row in buckets.sort_values("top", ascending=False, kind="stable").itertuples():
        b = Bucket(row)
        d = min(q.shape[1], b.m.shape[1])
        whole = []
        for i in range(len(q)):
            low = min(w.threshold() for w in wishes[i])
            reach = lengths[i] * b.top
            if low > reach * (1 + SLACK):
                continue
            rows = b.candidates(unit[i], focus[i], low / reach - SLACK) if low > 0 else None
            if rows is None:
                whole.append(i)
            elif len(rows):
                _offer(wishes[i], b, rows, b.m[rows, :d] @ q[i, :d], labels[i], ids[i], same)
        for start in range(0, len(whole), BLOCK):
            part = whole[start:start + BLOCK]
            for i, scores in zip(part, q[part, :d] @ b.m[:, :d].T):
                rows = np.flatnonzero(scores >= min(w.threshold() for w in wishes[i]))
                _offer(wishes[i], b, rows, scores[rows], labels[i], ids[i], same)
    return [(at, j, None if unnamed else id, int(-s)) for at, mine in zip(anchors["at"], wishes) for j, w in enumerate(mine) for s, unnamed, id in w.rows]


def _offer(wishes, bucket, rows, scores, label, own, same):
    fit = ((bucket.labels[rows] == label) == same) & ((bucket.ids[rows] != own) | bucket.unnamed[rows])
    if fit.any():
        for w in wishes:
            w.offer(scores[fit], bucket, rows[fit])


def _meet(anchors: DataFrame, cells: Column, buckets: DataFrame, groups: int, same: bool) -> DataFrame:
    """(at, wish, id, score): anchors against the cells named for each, block by block."""
    left = anchors.select("at", "id", "label", "wide", "length", "data", "wishes", F.pmod(F.xxhash64("at"), F.lit(groups)).alias("grp"),
                          F.explode(cells.cast("array<bigint>")).alias("cell"))
    right = buckets.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = _search(a, b, same) if len(a) and len(b) else []
        return pd.DataFrame({"at": pd.array([x[0] for x in found], "int64"), "wish": pd.array([x[1] for x in found], "int32"),
                             "found": pd.array([x[2] for x in found], "Int64"), "score": pd.array([x[3] for x in found], "int64")})

    return left.groupBy("cell", "grp").cogroup(right.groupBy("cell", "grp")).applyInPandas(block, "at bigint, wish int, found bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("at", "wish").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rounds(anchors: DataFrame, wishes: Column, k: int, levels: Levels, buckets: DataFrame, groups: int, same: bool, scratch: Scratch, name: str) -> DataFrame:
    """(at, wish, found, score, rank): the first k of every wish (k, lowest, highest score) of every anchor."""
    anchors = anchors.withColumn("wishes", wishes)
    seed = scratch.keep(_best(_meet(anchors, F.array(F.lit(0)), buckets.filter("cell = 0"), groups, same), k), f"{name}_seed")
    weakest = seed.groupBy("at", "wish").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    known = weakest.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("wish", F.col("least").cast("double").alias("least")))).alias("known"))
    raised = F.transform("wishes", lambda x, i: F.when(i % 3 == 1, F.greatest(x, F.coalesce(F.element_at("known", F.floor(i / 3).cast("int")), x))).otherwise(x))
    later = anchors.join(known, "at", "left").withColumn("wishes", raised)
    lowest = F.array_min(F.transform(F.filter("wishes", lambda x, i: i % 3 == 1), lambda x: x))
    rest = _meet(later, levels.reached(lowest, F.col("length")), buckets.filter("cell > 0"), groups, same)
    return scratch.keep(_best(seed.drop("rank").unionByName(rest), k), name)


def hard_negatives(vectors: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    Scores are inner products of floor(scale * component), exact up to 2^53.  A positive is one of the
    anchor's first ``positives`` other rows of its label; its negatives are the first ``negatives`` rows
    of another label with low * positive <= 100 * negative <= high * positive.  Rows with a null label,
    a null vector or a null or non-finite component take no part.  Rows with the anchor's own id are
    never its partners; other repeated rows all count; rows without an id are no anchors and come last
    among equals.  Shorter vectors count as filled up with zeros, an empty one as zero.  Further
    columns of the table are ignored.  An empty table gives no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "hard_negatives")
    label = F.col(label) if isinstance(label, str) else label
    base = scratch.keep(_scaled(vectors, id, vector, label, scale, {"anchor": F.coalesce(anchor & F.col(id).isNotNull(), F.lit(False))}), "vectors")
    levels = Levels(base)
    if not levels.cells:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    buckets = scratch.keep(_buckets(base, levels, spark_partitions(spark)), "buckets")
    anchors = scratch.keep(base.filter("anchor").drop("anchor"), "anchors")
    groups = max(1, ceil(anchors.count() / GROUP))
    top, nothing = 1e300, F.array().cast("array<double>")
    first = _rounds(anchors, F.array(F.lit(float(positives)), F.lit(-top), F.lit(top)), positives, levels, buckets, groups, True, scratch, "positives")
    listed = first.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))).alias("good"))
    asked = anchors.join(listed, "at")
    band = lambda p: F.array(F.lit(float(negatives)), F.ceil(low * p["positive_score"] / 100).cast("double"), F.floor(high * p["positive_score"] / 100).cast("double"))
    second = _rounds(asked.select("at", "id", "label", "wide", "length", "data", "good"), F.coalesce(F.flatten(F.transform("good", band)), nothing), negatives,
                     levels, buckets, groups, False, scratch, "negatives")
    pairs = asked.select("at", F.col("id").alias("anchor_id"), F.posexplode("good").alias("wish", "p"))
    return pairs.join(second, ["at", "wish"]).select("anchor_id", "p.positive_id", "rank", F.col("found").alias("negative_id"), "p.positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


OP12_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
good AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
bad AS (
  SELECT g.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY g.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM good g JOIN scored s ON g.anchor_id = s.anchor_id AND s.label <> s.own
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM bad WHERE rank <= 3
"""
