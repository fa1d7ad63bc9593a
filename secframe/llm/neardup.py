"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find.

An element of a set walks through the signature in its own random order; at step j it offers a
value in [j, j+1) to one slot.  Later steps can only fill slots that no earlier step has reached, so
the walk of a set ends as soon as all its slots hold values below the next step.  Slots of one
element are without replacement, which lowers the variance against independent hashes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from secframe.llm.common import Scratch, table, text_of
from secframe.llm.grouping import exact_pairs, first_stars, groups, shares
from secframe.llm.hashing import U64, WordHashes, chain, mix
from secframe.llm.storage import slices

SHINGLE = 5
#: Documents link when their shingle sets have this Jaccard similarity, in hundredths.
LIKE = 75
#: 48 bands of five values miss a pair at 0.75 about twice in a million times.
BANDS, ROWS = 48, 5
#: Set elements that are hashed at a time, over several documents.
CHUNK = 20_000


def shingle_sets(texts: list[bytes], words: WordHashes, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    split = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = words.of([w for ws in split for w in ws])
    ends = np.cumsum(sizes)
    runs = chain([flat[j:len(flat) - width + 1 + j] for j in range(width)]) if len(flat) >= width else flat[:0]
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist()):
        if n >= width:
            out.append(np.unique(runs[end - n:end - width + 1]))
        elif n:
            whole = mix(np.array([n], dtype=U64))
            for h in flat[end - n:end]:
                whole = mix(whole ^ h)
            out.append(whole)
        else:
            out.append(flat[:0])
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """(sets, m) signatures; an empty set keeps infinity everywhere."""
    sig = np.full((len(sets), m), np.inf)
    flat = sig.reshape(-1)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return sig
    e = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint32), (len(e), m)).copy()
    row = np.arange(len(e))
    for j in range(m):
        x = mix(e + U64((j + 1) * 0xD1342543DE82EF95 % 2 ** 64))
        k = j + ((x & U64(0xFFFFF)) * U64(m - j) >> U64(20)).astype(np.int64)
        slot = order[row, k]
        order[row, k] = order[:len(e), j]
        np.minimum.at(flat, owner * m + slot, (x >> U64(20)).astype(np.float64) * 2.0 ** -44 + j)
        if j + 1 == m:
            break
        going = (sig.max(axis=1) >= j + 1)[owner]
        if not going.all():
            e, owner, order = e[going], owner[going], order[going]
            row = np.arange(len(e))
            if not len(e):
                break
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(U64).reshape(len(sig), bands, rows)
    which = np.broadcast_to(np.arange(bands, dtype=U64), (len(sig), bands))
    return chain([which] + [bits[:, :, r] for r in range(rows)])


def _chunks(sets: list[np.ndarray], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, s in enumerate(sets):
        if i > start and total + len(s) > limit:
            yield start, i
            start, total = i, 0
        total += len(s)
    if start < len(sets):
        yield start, len(sets)


def _signed(batches, words=WordHashes()):
    """(id, text) -> (id, n_shingles, digest, keys)."""
    for batch in slices(batches, 1):
        sets = shingle_sets([t.encode() for t in batch.column(1).to_pylist()], words)
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        keys = [band_keys(superminhash(sets[a:b], BANDS * ROWS), BANDS, ROWS) for a, b in _chunks(sets)]
        offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
             pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys).view(np.int64).reshape(-1)))],
            ["id", "n", "digest", "keys"])


def _sets(batches, words=WordHashes()):
    """(id, text) -> (id, members), one row per set."""
    for batch in slices(batches, 1):
        sets = shingle_sets([t.encode() for t in batch.column(1).to_pylist()], words)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "members"])


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", like: int = LIKE) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept.

    Sets without words link with nothing.  Rows that share an id are one document: they are linked
    to each other and to whatever one of them is like.  A row without id cannot be named in a
    component: its component is null and it is kept.  An empty table gives an empty result.

    Equal sets are one class, joined to the smallest id.  Only classes are banded; the members of a
    band meet its smallest and its largest id, and every such pair is checked on whole sets.  Pairs
    of other members go on to ``grouping`` until they are linked or known not to be alike.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    base = docs.select(F.col(id).cast("bigint").alias("id"), text_of(text).alias("text"))
    signed = scratch.keep(base.mapInArrow(_signed, "id bigint, n bigint, digest binary, keys array<bigint>"), "signed")
    named = signed.filter("id IS NOT NULL AND n > 0")
    classes = named.groupBy("digest").agg(F.min("id").alias("rep"))
    member = named.select("id", "digest").join(classes, "digest").filter("id <> rep").select(
        F.col("id").alias("a"), F.col("rep").alias("b"))
    heads = named.join(classes, "digest").filter("id = rep").select("id", "keys")
    banded = scratch.keep(heads.select("id", F.explode("keys").alias("key")), "bands")
    pairs, between = first_stars(banded)
    pairs = scratch.keep(pairs, "pairs")
    between = scratch.keep(between, "between")
    scratch.drop("bands")
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # the ids asked for grow with the corpus: merged at every size, never broadcast
    texts = base.join(asked.hint("merge"), "id", "left_semi").select("id", "text")
    sets = scratch.keep(texts.mapInArrow(_sets, "id bigint, members array<bigint>").filter(F.size("members") > 0), "sets")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("members").alias(f"{c}_set"))

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return both.filter(shares(F.col("a_set"), F.col("b_set"), like)).select("a", "b")

    def links_within(left: DataFrame) -> DataFrame:
        open_sets = scratch.keep(left.select("id", "c").distinct().join(sets, "id"), "open_sets")
        return alike(scratch.keep(exact_pairs(open_sets, like), "exact_pairs"))

    links = scratch.keep(alike(pairs).unionByName(member).distinct(), "links")
    scratch.drop("pairs")
    owner = groups(between, links, alike, links_within, scratch)
    scratch.drop("sets")
    return signed.select("id", "n").join(owner, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("component", "id") == F.col("id"))).alias("kept"))


def op8_superminhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage_neardup(spark, docs, sf_dir):
    """Pipeline stage: of each component the document with the smallest id stays."""
    gone = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").select(*docs.columns)


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
#: All pairs that share a shingle, so for small tables.
OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_W} AS w FROM documents),
g AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {SHINGLE - 1}, 1))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS x FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= {LIKE} * (na.n + nb.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
