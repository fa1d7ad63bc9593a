"""Removal of long byte strings that occur twice, by merging Burrows-Wheeler transforms of shards.

Where a string of WIDTH bytes repeats, all its places have the same smallest hash of the GRAM-byte
strings inside.  Runs of window starts with one such smallest hash are segments; only segments
whose hash occurs again can hold repeats, and segments equal as a whole are one content with a
weight.  Contents of one hash meet in one task, where they are split over shards; so do segments in which the hash itself stands twice.

A shard's strings are read in blocks of BLOCK bytes from each of the BLOCK offsets; a block, hashed,
is a symbol.  Its transform lists, in suffix order, the symbol before each suffix.  Transforms are
merged without sorting suffixes again: an interleave of the shards, first one after the other, is
refined by the symbols before it, once per block of depth.  Rows that one refinement separates have
shorter common prefixes; rows still together after WIDTH / BLOCK refinements share WIDTH bytes.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from secframe.llm.common import Scratch, spark_partitions, table, text_of
from secframe.llm.hashing import U64, mix
from secframe.llm.storage import slices

WIDTH, GRAM, BLOCK = 200, 64, 40
#: Bytes of contents that are merged at a time, and of one shard.
MERGE_BYTES, SHARD_BYTES = 1 << 18, 1 << 16
#: With more contents of one hash than this, each of their windows is counted by itself instead.
HOT_CONTENTS = 20_000

_BYTE = mix(np.arange(256, dtype=U64) + U64(0x51))
_M = U64(0x9FB21C651E98DF25)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of neighbouring strings from theirs."""
    h = (a * _M) ^ b
    h ^= h >> U64(32)
    h *= _M
    return h ^ (h >> U64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a multiple of 8, 64 at most) from every place that has them."""
    if len(data) < size:
        return np.zeros(0, U64)
    # only the powers of two that make up the size are held
    h, step, powers = _BYTE[data], 1, {}
    while True:
        if size & step:
            powers[step] = h
        if 2 * step > size:
            break
        h = _join(h[:-step], h[step:])
        step *= 2
    out, done = None, 0
    for step in sorted(powers, reverse=True):
        if size - done >= step:
            h = powers[step]
            out = h if out is None else _join(out[:len(h) - done], h[done:])
            done += step
    return out[:len(data) - size + 1]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours."""
    pad = -len(x) % n
    blocks = np.concatenate([x, np.full(pad, np.iinfo(U64).max, U64)]).reshape(-1, n)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = len(x) - n + 1
    return np.minimum(right[:m], left[n - 1:n - 1 + m])


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, smallest hash, hash of the content, looped) of all segments.

    ``looped``: the smallest hash stands more than once in it, so that it may repeat itself.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return none, none, none, none, none, none.astype(bool)
    span = WIDTH - GRAM + 1
    grams = gram_hashes(data, GRAM)
    low = sliding_min(grams, span)
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(low)]
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(low))
    whole = at - begin[owner] + WIDTH <= sizes[owner]
    fresh = np.r_[True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])]
    start = np.maximum.accumulate(np.where(fresh, at, 0))
    fresh |= (at - start) % span == 0
    firsts = np.flatnonzero(fresh & whole)
    ends = np.flatnonzero(np.r_[fresh[1:], True] | np.r_[whole[:-1] & ~whole[1:], False])
    ends = ends[whole[ends]]
    count = ends - firsts + 1
    blob = memoryview(data)
    content = np.fromiter((xxhash.xxh3_64_intdigest(blob[a:a + n + WIDTH - 1]) for a, n in zip(firsts.tolist(), count.tolist())),
                          U64, len(firsts))
    looped = np.fromiter((np.count_nonzero(grams[a:a + n + span - 1] == g) > 1 for a, n, g in zip(
        firsts.tolist(), count.tolist(), low[firsts])), bool, len(firsts))
    text = owner[firsts]
    return text, firsts - begin[text], count, low[firsts].view(np.int64), content.view(np.int64), looped


# ---------------------------------------------------------------- transforms

class Shard:
    """Suffix order of strings, and the symbol before each suffix."""

    def __init__(self, bodies: list[bytes], first: int):
        sizes = np.array([len(b) for b in bodies], np.int64)
        rows = sizes + 1                                   # every place, and the end
        self.body = np.repeat(np.arange(first, first + len(bodies)), rows)
        begin = np.cumsum(rows) - rows
        self.place = np.arange(rows.sum()) - np.repeat(begin, rows)
        data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
        symbol = np.zeros(len(data), U64)
        h = gram_hashes(data, BLOCK)
        symbol[:len(h)] = h
        end = self.place + BLOCK > np.repeat(sizes, rows)  # fewer bytes than a block are left
        self.ends = int(end.sum())
        real = np.flatnonzero(~end)
        rank = np.zeros(len(data), np.int64)
        rank[end] = np.arange(self.ends)                   # each end is a symbol of its own, below all others
        rank[real] = self.ends + np.unique(symbol[real], return_inverse=True)[1]
        depth = BLOCK
        while len(real):                                   # twice as many blocks each time, until all differ
            after = np.minimum(real + depth, len(rank) - 1)
            beyond = self.body[after] != self.body[real]
            key = rank[real] * (len(rank) + 1) + np.where(beyond, 0, rank[after] + 1)
            values, dense, counts = np.unique(key, return_inverse=True, return_counts=True)
            place = np.cumsum(counts) - counts
            rank[real] = self.ends + place[dense]
            if len(values) == len(real):
                break
            depth *= 2
        order = np.argsort(rank, kind="stable")
        self.body, self.place = self.body[order].astype(np.int32), self.place[order].astype(np.int32)
        self.has = self.place >= BLOCK
        self.before = np.where(self.has, symbol[np.maximum(order - BLOCK, 0)], U64(0))


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 below 2 ** 32, by 16 bits at a time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and x.max() >> 16:
        order = order[np.argsort((x >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def _numbered(values: np.ndarray) -> np.ndarray:
    """Dense numbers of values, in their order."""
    order = np.argsort(values)
    values = values[order]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(np.r_[False, values[1:] != values[:-1]], dtype=np.int32)
    return out


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, place, group) of the merged rows; rows of a group share WIDTH bytes, ends are groups of their own.

    The list is used up: what a shard holds is let go once it is joined with that of the others.
    """
    sizes = np.array([len(s.place) for s in shards])
    has = np.concatenate([s.has for s in shards])
    before = np.concatenate([s.before for s in shards])
    body = np.concatenate([s.body for s in shards])
    place = np.concatenate([s.place for s in shards])
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    ends = np.repeat(np.arange(len(shards), dtype=np.uint16), [s.ends for s in shards])
    shards.clear()
    symbol = _numbered(before)
    del before
    group = np.zeros(len(z), np.int32)
    row = np.empty(len(z), np.int32)
    count = np.arange(len(z), dtype=np.int32)

    def place_rows():
        # the n-th entry of a shard in the interleave is its n-th suffix
        row[np.argsort(z, kind="stable")] = count

    place_rows()
    for _ in range(WIDTH // BLOCK):
        live = has[row]
        c = symbol[row[live]]
        order = stable_order(c)
        old, c = group[live][order], c[order]
        z = np.concatenate([ends, z[live][order]])
        del order, live
        split = np.r_[True, (c[1:] != c[:-1]) | (old[1:] != old[:-1])] if len(c) else np.zeros(0, bool)
        group = np.concatenate([count[:len(ends)], len(ends) - 1 + np.cumsum(split, dtype=np.int32)])
        place_rows()
    return body[row], place[row], group


def repeated_starts(bodies: list[bytes], weights: np.ndarray, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """Per body, the places of WIDTH-byte strings that occur twice or more; a body counts ``weights`` times."""
    shards, first, held = [], 0, 0
    for i, b in enumerate(bodies):
        held += len(b)
        if held >= shard_bytes or i + 1 == len(bodies):
            shards.append(Shard(bodies[first:i + 1], first))
            first, held = i + 1, 0
    body, place, group = merge(shards)
    total = np.bincount(group, weights[body])
    sizes = np.array([len(b) for b in bodies], np.int64)
    twice = (total >= 2)[group] & (place + WIDTH <= sizes[body])
    body, place = body[twice], place[twice]
    del total, group, twice
    order = np.lexsort((place, body))
    body, place = body[order], place[order]
    cuts = np.searchsorted(body, np.arange(len(bodies) + 1))
    return [place[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of consecutive places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), places[np.r_[cut, len(places) - 1]].tolist()))


# ---------------------------------------------------------------- jobs

def _merged(merge_bytes: int, shard_bytes: int):
    fields = pa.schema([("gram", pa.int64()), ("content", pa.int64()),
                        ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def run(batches):
        """Whole groups of (gram, content, weight, body), which come sorted by gram."""
        held, size = [], 0

        def flush():
            bodies = [r[3] for r in held]
            found = repeated_starts(bodies, np.array([r[2] for r in held], np.float64), shard_bytes)
            rows = [{"gram": r[0], "content": r[1], "spans": [{"a": a, "b": b} for a, b in runs(p)]}
                    for r, p in zip(held, found) if len(p)]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, fields)

        for batch in slices(batches, 3):
            for r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= merge_bytes and held[-1][0] != r[0]:
                    yield flush()
                    size = 0
                held.append(r)
                size += len(r[3])
        if held:
            yield flush()
    return run


def _segment_rows(batches):
    for batch in slices(batches, 2, 1 << 18):
        text, first, count, gram, content, looped = segments([t.encode() for t in batch.column(2).to_pylist()])
        take = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(first.astype(np.int32)),
             pa.array(count.astype(np.int32)), pa.array(gram), pa.array(content), pa.array(looped)],
            ["id", "version", "first", "n", "gram", "content", "looped"])


def _cut(batches):
    fields = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    for batch in slices(batches, 1):
        rows = []
        for id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            data, kept, at, n, removed = text.encode(), [], 0, 0, 0
            end = -1
            for s in sorted((s["a"], s["b"]) for s in spans or ()):
                if s[0] > end:
                    kept.append(data[max(end, 0):s[0]])
                    n += 1
                    removed += s[1] - s[0]
                    end = s[1]
                elif s[1] > end:
                    removed += s[1] - end
                    end = s[1]
            kept.append(data[max(end, 0):])
            rows.append({"id": id, "n_bytes": len(data), "n_removed": removed, "n_spans": n, "kept": b"".join(kept)})
        yield pa.RecordBatch.from_pylist(rows, fields)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", hot: int = HOT_CONTENTS,
                   merge_bytes: int = MERGE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) per document row; ``kept`` is the rest as bytes.

    Every byte of a WIDTH-byte string that starts anywhere else too goes, judged on the input.  A
    null text is empty, texts shorter than WIDTH stay whole, a null id is kept as null, rows that
    are repeated are each other's copies.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    base = docs.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(text_of(text)).alias("version"), text_of(text).alias("text"))
    rows = scratch.keep(base.mapInArrow(_segment_rows, "id bigint, version bigint, first int, n int, gram bigint, content bigint, looped boolean"), "segments")
    again = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("places"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("looped").alias("looped"))
    again = again.filter("places > 1 OR looped").select("gram", (F.col("looped") | (F.col("lo") != F.col("hi"))).alias("differ"))
    live = scratch.keep(rows.drop("looped").join(again, "gram"), "live")
    scratch.drop("segments")
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    # a hash with one content only: all its windows repeat
    same = live.filter("NOT differ").select("id", "version", span(F.col("first"), F.col("first") + F.col("n") + (WIDTH - 1)).alias("s"))

    rep = F.min(F.struct("id", "version", "first", "n")).alias("rep")
    contents = live.filter("differ").groupBy("gram", "content").agg(F.count(F.lit(1)).alias("weight"), rep)
    asked = contents.groupBy(F.col("rep.id").alias("id"), F.col("rep.version").alias("version")).agg(
        F.collect_list(F.struct("gram", "content", "weight", F.col("rep.first").alias("first"), F.col("rep.n").alias("n"))).alias("asked"))
    match = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["version"] == b["version"])
    found = base.join(asked.hint("merge"), match(base, asked)).select(base["text"].cast("binary").alias("data"), F.explode("asked").alias("q"))
    bodies = found.select("q.gram", "q.content", "q.weight", "q.n", F.substring(
        F.col("data"), F.col("q.first") + 1, F.col("q.n") + (WIDTH - 1)).alias("body")).dropDuplicates(["gram", "content"])
    bodies = scratch.keep(bodies, "bodies")
    crowd = bodies.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hot).select("gram")
    few = bodies.join(crowd, "gram", "left_anti").select("gram", "content", "weight", "body")
    few = few.repartition(spark_partitions(docs.sparkSession), "gram").sortWithinPartitions("gram", "content")
    spans_type = "gram bigint, content bigint, spans array<struct<a:int,b:int>>"
    marked = few.mapInArrow(_merged(merge_bytes, shard_bytes), spans_type)
    each = bodies.join(crowd, "gram", "left_semi").select("gram", "content", "weight", "body", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    each = each.select("gram", "content", "weight", "i", F.unhex(F.md5(F.substring(F.col("body"), F.col("i") + 1, F.lit(WIDTH)))).alias("window"))
    often = each.groupBy("window").agg(F.sum("weight").alias("w")).filter("w > 1").select("window")
    alone = each.join(often, "window", "left_semi").groupBy("gram", "content").agg(F.collect_list(span(F.col("i"), F.col("i"))).alias("spans"))
    marked = scratch.keep(marked.unionByName(alone), "marked")
    scratch.drop("bodies")

    cut = live.filter("differ").join(marked, ["gram", "content"]).select("id", "version", "first", F.explode("spans").alias("m"))
    cut = cut.select("id", "version", span(F.col("first") + F.col("m.a"), F.col("first") + F.col("m.b") + WIDTH).alias("s"))
    spans = scratch.keep(same.unionByName(cut).distinct().groupBy("id", "version").agg(F.collect_list("s").alias("spans")), "spans")
    scratch.drop("live", "marked")
    out = base.join(spans.hint("merge"), match(base, spans), "left").select(base["id"], base["text"], "spans")
    return out.mapInArrow(_cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary").withColumnRenamed("id", id)


def op7_suffix_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
