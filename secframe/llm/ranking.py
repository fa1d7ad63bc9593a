"""Ranked lexical search of all documents for a table of items, as a dual-tree search.

Items and documents are vectors over the items' terms.  Documents are cut into blocks of bounded
size; the documents of a block are put in the order of their heaviest term and form a tree whose
nodes hold the largest value of every coordinate below.  Items form a tree in the same way.  The
product of the two nodes' maxima bounds the score of every pair below them: where it is smaller than
the weakest ``k``-th score that the items below have found so far, the whole batch of pairs is left
out.  Leaves are scored exactly.  A first round over a bounded number of documents gives scores to
start from; they are lower bounds of the final ones, so nothing is lost by pruning with them.

Terms: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from secframe.llm.common import Scratch, spark_partitions, table, text_of
from secframe.llm.storage import slices

TOP = 50
#: Text of items that are searched for in one pass; more items take further passes.
ITEM_BYTES = 8_000_000
#: Documents and term entries of a block, documents of a leaf, children of a node, items of an item leaf.
BLOCK_DOCS, BLOCK_ENTRIES, LEAF, FANOUT, ITEM_LEAF = 8192, 2_000_000, 64, 8, 8
#: Documents of the first round, whose scores only serve as thresholds.
SEED_DOCS = 20_000
PIECE = 1 << 20
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def term_pieces(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in lists of about a megabyte each; no term is cut."""
    text, at = data.translate(_KEEP), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut if cut > at else text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Items:
    """A batch of items: their ids, the terms of each and the vocabulary; later the weights and the tree."""

    def __init__(self, rows):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.terms = [], []
        for id, text in rows:
            own = {t for part in term_pieces((text or "").encode()) for t in part}
            self.ids.append(id)
            self.terms.append(np.array(sorted(self.vocabulary.setdefault(t, len(self.vocabulary)) for t in sorted(own)), np.int64))

    def weigh(self, documents: int, length: int, df: np.ndarray) -> "Items":
        """Term weights by document frequency; items in the order of their heaviest term, and the levels above them."""
        self.n, self.length = documents, length
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        heaviest = [int(t[np.argmax(self.weight[t])]) if len(t) else -1 for t in self.terms]
        self.order = np.argsort(np.array(heaviest), kind="stable")
        groups = [np.array([i]) for i in self.order]
        self.levels = []                        # from single items up to the root: (members, terms, begin)
        while True:
            union = [np.unique(np.concatenate([self.terms[i] for i in g])) for g in groups]
            sizes = np.array([len(u) for u in union])
            self.levels.append((groups, np.concatenate(union) if len(union) else np.zeros(0, np.int64), np.cumsum(sizes) - sizes, sizes))
            if len(groups) <= 1:
                return self
            step = ITEM_LEAF if len(self.levels) == 1 else FANOUT
            groups = [np.concatenate(groups[a:a + step]) for a in range(0, len(groups), step)]

    def reach(self, dense: np.ndarray, weakest: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Items whose bound against a document node, given its maxima, is above 0 and not below their weakest score."""
        allowed = alive.copy()
        for groups, terms, begin, sizes in reversed(self.levels):
            some = np.array([bool(allowed[g].any()) for g in groups])
            if not some.any():
                return np.zeros(0, np.int64)
            picked = np.flatnonzero(some & (sizes > 0))
            at = np.repeat(begin[picked] - (np.cumsum(sizes[picked]) - sizes[picked]), sizes[picked]) + np.arange(sizes[picked].sum())
            keys = terms[at]
            bound = np.add.reduceat(dense[keys] * self.weight[keys], np.cumsum(sizes[picked]) - sizes[picked]) if len(picked) else np.zeros(0)
            keep = np.zeros(len(allowed), bool)
            for g, b in zip((groups[p] for p in picked), bound):
                if b > 0 and b >= weakest[g].min():
                    keep[g] = True
            allowed &= keep
        return np.flatnonzero(allowed)


def profiles(docs: DataFrame, items, id: str, text: str) -> DataFrame:
    """(id, n, ids, tfs) of the documents with a term: all terms counted, those of the items listed."""
    base = docs.select(F.col(id).cast("bigint").alias("id"), text_of(text).cast("binary").alias("text"))

    def count(batches):
        get, size = items.value.vocabulary.get, len(items.value.vocabulary)
        for batch in slices(batches, 1):
            ids, ns, names, tfs = [], [], [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, hits = 0, []
                for words in term_pieces(data.as_py()):
                    n += len(words)
                    found = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    hits.append(np.unique(found[found >= 0], return_counts=True))
                if n:
                    u = hits[0] if len(hits) == 1 else _merged(hits, size)
                    ids.append(name)
                    ns.append(n)
                    names.append(u[0].astype(np.int32).tobytes())
                    tfs.append(u[1].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(names, pa.binary()), pa.array(tfs, pa.binary())],
                                             ["id", "n", "ids", "tfs"])

    return base.mapInArrow(count, "id bigint, n bigint, ids binary, tfs binary")


def _merged(hits, size: int):
    total = np.zeros(size, np.int64)
    for u, c in hits:
        total[u] += c
    return np.flatnonzero(total), total[total > 0]


def frequencies(profile: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents, terms in all of them, documents per term); tasks send one sum per term they met."""
    def count(batches):
        df, n, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n += batch.num_rows
            length += pc.sum(batch.column(0)).as_py() or 0
            for ids in batch.column(1).to_pylist():
                df[np.frombuffer(ids, np.int32)] += 1
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], met]), pa.int64()), pa.array(np.concatenate([[length, n], df[met]]), pa.int64())], ["term", "n"])

    rows = profile.select("n", "ids").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size, np.int64)
    found = {r.term: r.n for r in rows}
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(-1, 0), found.get(-2, 0), df


class Block:
    """Documents of a block in tree order; levels from leaves to the root hold sparse coordinate maxima."""

    def __init__(self, items: Items, ids: list, ns: list, names: list, tfs: list):
        size = len(items.vocabulary)
        terms = [np.frombuffer(x, np.int32) for x in names]
        share = [50 + (50 * n * items.n) // items.length for n in ns]
        values = [(1_000_000_000 * t) // (1000 * t + 20 * m) for t, m in zip((np.frombuffer(x, np.int32).astype(np.int64) for x in tfs), share)]
        heaviest = [int(t[np.argmax(items.weight[t] * v)]) if len(t) else -1 for t, v in zip(terms, values)]
        order = np.lexsort((np.array(share, np.float64), np.array(heaviest)))
        self.ids = [ids[i] for i in order]
        self.terms, self.values = [terms[i] for i in order], [values[i] for i in order]
        owner = np.repeat(np.arange(len(order)) // LEAF, [len(t) for t in self.terms])
        self.levels, self.size = [], size
        level = self._maxima(owner, np.concatenate(self.terms).astype(np.int64), np.concatenate(self.values), -(-len(order) // LEAF))
        while True:
            self.levels.append(level)
            begin, t, v = level
            if len(begin) <= 2:
                break
            owner = np.repeat(np.arange(len(begin) - 1) // FANOUT, np.diff(begin))
            level = self._maxima(owner, t, v, -(-(len(begin) - 1) // FANOUT))

    def _maxima(self, owner, terms, values, nodes: int):
        order = np.lexsort((terms, owner))
        owner, terms, values = owner[order], terms[order], values[order]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])])) if len(owner) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(values, new) if len(new) else values
        return np.searchsorted(owner[new], np.arange(nodes + 1)), terms[new], top


class Best:
    """First ``k`` documents of every item that a task has met: (-score, no id, id)."""

    def __init__(self, items: Items, k: int, known: np.ndarray):
        self.items, self.k, self.rows = items, k, [[] for _ in items.ids]
        self.weakest = known.astype(np.float64)          # scores below it are not wanted
        self.exact = np.int64 if max((int(items.weight[t].sum()) for t in items.terms), default=0) * 10 ** 6 >= 2 ** 53 else np.float64
        self.place = np.full(len(items.vocabulary), -1, np.int64)
        self.dense = np.zeros(len(items.vocabulary), np.float64)

    def search(self, block: Block) -> None:
        self._node(block, len(block.levels) - 1, 0, np.ones(len(self.items.ids), bool))

    def _node(self, block: Block, level: int, node: int, alive: np.ndarray) -> None:
        begin, terms, values = block.levels[level]
        own = slice(begin[node], begin[node + 1])
        self.dense[terms[own]] = values[own]
        some = self.items.reach(self.dense, self.weakest, alive)
        self.dense[terms[own]] = 0
        if not len(some):
            return
        if level == 0:
            return self._leaf(block, node, terms[own], some)
        below = np.zeros(len(alive), bool)
        below[some] = True
        for child in range(node * FANOUT, min((node + 1) * FANOUT, len(block.levels[level - 1][0]) - 1)):
            self._node(block, level - 1, child, below)

    def _leaf(self, block: Block, node: int, local: np.ndarray, some: np.ndarray) -> None:
        docs = range(node * LEAF, min((node + 1) * LEAF, len(block.ids)))
        self.place[local] = np.arange(len(local))
        c = np.zeros((len(docs), len(local)), self.exact)
        for row, d in enumerate(docs):
            c[row, self.place[block.terms[d]]] = block.values[d]
        w = np.zeros((len(local), len(some)), self.exact)
        for col, i in enumerate(some):
            t = self.items.terms[i]
            t = t[self.place[t] >= 0]
            w[self.place[t], col] = self.items.weight[t]
        self.place[local] = -1
        scores = c @ w
        for col in np.flatnonzero((scores >= np.maximum(self.weakest[some], 1)).any(0)):
            i = int(some[col])
            rows = np.flatnonzero(scores[:, col] >= max(self.weakest[i], 1))
            if len(rows) > self.k:
                cut = np.partition(scores[rows, col], len(rows) - self.k)[len(rows) - self.k]
                rows = rows[scores[rows, col] >= cut]
            found = [(-int(scores[r, col]), block.ids[docs[r]] is None, block.ids[docs[r]] or 0) for r in rows]
            self.rows[i] = sorted(self.rows[i] + found)[:self.k]
            if len(self.rows[i]) == self.k:
                self.weakest[i] = max(self.weakest[i], -self.rows[i][-1][0])


def _blocks(batches):
    """Columns of documents, at most ``BLOCK_DOCS`` and about ``BLOCK_ENTRIES`` entries at a time."""
    held, entries = ([], [], [], []), 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            for column, value in zip(held, row):
                column.append(value)
            entries += len(row[2]) // 4
            if len(held[0]) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                yield held
                held, entries = ([], [], [], []), 0
    if held[0]:
        yield held


def _found(profile: DataFrame, items, known, k: int) -> DataFrame:
    """(item, id, score): every task's first ``k`` documents of each item, none below what is known."""
    def search(batches):
        best = Best(items.value, k, known.value)
        for columns in _blocks(batches):
            best.search(Block(items.value, *columns))
        flat = [(i, None if unnamed else id, -s) for i, rows in enumerate(best.rows) for s, unnamed, id in rows]
        for a in range(0, len(flat), 50_000):
            part = flat[a:a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()),
                                              pa.array([x[2] for x in part], pa.int64())], ["item", "id", "score"])

    return profile.select("id", "n", "ids", "tfs").mapInArrow(search, "item bigint, id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of each item; items with rows from very many tasks are thinned in parts before."""
    by = (F.desc("score"), F.asc_nulls_last("id"))
    part = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).filter(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= k).drop("part")


def _batch(docs: DataFrame, rows: list, id: str, text: str, k: int, scratch: Scratch, name: str) -> DataFrame | None:
    spark = docs.sparkSession
    items = Items(rows)
    shared = spark.sparkContext.broadcast(items)                # at most about ITEM_BYTES of text
    profile = scratch.keep(profiles(docs, shared, id, text), f"{name}_profiles")
    n, length, df = frequencies(profile, len(items.vocabulary))
    if not n or not items.vocabulary:
        return None
    shared = spark.sparkContext.broadcast(items.weigh(n, length, df))
    none = spark.sparkContext.broadcast(np.zeros(len(items.ids)))
    some = profile.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SEED_DOCS))) == 0).coalesce(spark_partitions(spark))
    seed = _ranked(_found(some, shared, none, k), k).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    known = np.zeros(len(items.ids))
    for r in seed.filter(F.col("n") == k).collect():            # a number per item of the batch
        known[r.item] = r.least
    best = _ranked(_found(profile, shared, spark.sparkContext.broadcast(known), k), k)
    ids = spark.createDataFrame(list(enumerate(items.ids)), "item bigint, item_id bigint")
    return best.join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def ranked_search(docs: DataFrame, benchmark: DataFrame, k: int = TOP, id: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    All documents are ranked, by their whole texts.  Equal scores are ranked by ascending document
    id, documents without an id last.  Null and empty texts have no terms: such documents are never
    found, such items find nothing.  Every row is an item or a document of its own, repeated ones
    too.  Further columns are ignored; an empty table on either side gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ranked_search")
    asked = scratch.keep(benchmark.select(F.col(item).cast("bigint").alias("item_id"), text_of(item_text).alias("text"))
                         .withColumn("at", F.monotonically_increasing_id()), "items")
    (size,) = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 100), F.lit(0)).alias("n")).collect()
    batches, out = -(-int(size.n) // item_bytes), None
    for b in range(batches):
        rows = asked.filter(F.pmod(F.xxhash64("at"), F.lit(batches)) == b).orderBy("at").select("item_id", "text").collect()
        found = _batch(docs, [tuple(r) for r in rows], id, text, k, scratch, f"batch{b}") if rows else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


def op11_ranked_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"""
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
docs AS (SELECT doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM docs),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
flat AS (SELECT doc_id, n, unnest(terms) AS term FROM docs),
tf AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM flat WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, nd),
part AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // l)))) AS s
         FROM tf JOIN w USING (term), total),
scored AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM asked JOIN part USING (term) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored QUALIFY rank <= 50
"""
