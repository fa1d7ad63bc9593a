"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.

Equal lines are one node from the start: their signature is one aggregate over exploded shingles.
Lines that share a band meet the first and the last line of that band, pairs of the lines between go
on to ``grouping`` until they are linked or known not to be alike, and components keep the line that
comes first.  A pair is checked on whole shingle sets unless the sketches of its lines, parities of
their shingles, differ in more places than sets that are alike can.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from secframe.llm.common import Scratch, spark_partitions, table, text_of
from secframe.llm.grouping import band_pairs, first_stars, groups, shares

SHINGLE = 8
#: White space inside a line.
BLANK = " \t\r\x0b\x0c"
#: Lines link when their shingle sets have this Jaccard similarity, in hundredths.
LIKE = 80
#: The signature is a square of GRID x GRID values; its rows, columns and (broken) diagonals are the bands.
#: Any five of the nine values hold a whole band, so pairs at 0.80 are met with probability 0.99.
GRID = 3
#: Shingles of a line that are hashed in one row of the signature's aggregate.
STEP = 4
#: Words of 64 bits in a sketch.
SKETCH = 16


def _masks() -> list[int]:
    """A constant per signature value: the order of shingles by hash XOR constant differs for each."""
    out = []
    for j in range(1, GRID * GRID + 1):
        x = j * 0x9E3779B97F4A7C15 % 2 ** 64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor % 2 ** 64
        x ^= x >> 31
        out.append(x - 2 ** 64 if x >= 2 ** 63 else x)
    return out


def bands() -> list[list[int]]:
    """The lines of the plane over the numbers modulo GRID: one column set, and a set per slope."""
    at = range(GRID)
    return [[GRID * r + c for r in at] for c in at] + [
        [GRID * ((slope * c + r) % GRID) + c for c in at] for slope in at for r in at]


def band_keys() -> list[Column]:
    """A key per band of lines s0, s1, ...; keys of different bands differ too."""
    return [F.xxhash64(F.lit(i), *[F.col(f"s{j}") for j in band]) for i, band in enumerate(bands())]


def trimmed(line: Column) -> Column:
    """Without white space around it; trimming walks over a whole line, so only lines that need it are trimmed."""
    ends = [line.startswith(c) | line.endswith(c) for c in BLANK]
    return F.when(reduce(or_, ends), F.btrim(line, F.lit(BLANK))).otherwise(line)


def normal_form(line: Column) -> Column:
    return F.lower(trimmed(line))


def _wide(line: Column) -> Column:
    """Four bytes per character (big-endian, no mark), so that a shingle is a slice at a known place."""
    return F.encode(line, "UTF-32")


def _starts(wide: Column) -> Column:
    """Shingle starts in bytes; a line shorter than a shingle is one shingle."""
    return F.sequence(F.lit(1), F.greatest(F.length(wide) - 4 * SHINGLE + 1, F.lit(1)), F.lit(4))


def shingle_hashes(wide: Column) -> Column:
    """64-bit hashes of all shingles of a wide line.

    The inner function works on a bound variable, since a binary column is copied at every use.
    """
    cut = lambda w: F.transform(_starts(w), lambda i: F.xxhash64(F.substring(w, i, F.lit(4 * SHINGLE))))
    return F.transform(F.array(wide), cut)[0]


def signatures(lines: DataFrame) -> DataFrame:
    """(d1, d2, n, s0, s1, ...) of lines (d1, d2, norm), one row per distinct line that occurs n times.

    Equal lines have equal signatures, so they meet in the same aggregate and no text is moved.
    """
    at = lines.select("d1", "d2", _wide(F.col("norm")).alias("wide"))
    last = F.greatest(F.length("wide") - 4 * SHINGLE + 1, F.lit(1))
    at = at.select("d1", "d2", "wide", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(4 * STEP))).alias("i"))
    # past the end the last shingle is hashed again: no smallest value changes, and none is null
    start = lambda k: F.least(F.col("i") + 4 * k, F.col("last"))
    h = at.select("d1", "d2", "i", *[F.xxhash64(F.substring(F.col("wide"), start(k), F.lit(4 * SHINGLE))).alias(f"h{k}") for k in range(STEP)])
    least = lambda m: F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(m)) for k in range(STEP)])
    times = F.count(F.when(F.col("i") == 1, 1)).alias("n")
    return h.groupBy("d1", "d2").agg(times, *[F.min(least(m)).alias(f"s{j}") for j, m in enumerate(_masks())])


def sketches(texts: DataFrame) -> DataFrame:
    """(id, n, b0, b1, ...) of lines (id, norm): number of distinct shingles, and for each bit whether an odd number of them fall on it.

    A shingle changes one word of its line; the words of a line meet in its partition, with no further shuffle.
    """
    sets = texts.repartition(spark_partitions(texts.sparkSession), "id").select("id", F.array_distinct(shingle_hashes(_wide(F.col("norm")))).alias("x"))
    # outer, though no set is empty: an inner explosion of a column adds a filter that computes the column once more
    h = sets.select("id", F.explode_outer("x").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    h = h.select("id", bit.alias("bit"), F.shiftright("h", 6).bitwiseAND(F.lit(SKETCH - 1)).alias("word"))
    h = h.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("bit").alias("bits"))
    words = [F.bit_xor(F.when(F.col("word") == w, F.col("bits")).otherwise(F.lit(0).cast("bigint"))).alias(f"b{w}") for w in range(SKETCH)]
    return h.groupBy("id").agg(F.sum("n").alias("n"), *words)


def may_be_alike(like: int) -> Column:
    """Of sketches a_n, a_b0, ... and b_n, b_b0, ...: true for all pairs of that similarity.

    Sets x, y with 100 |x and y| >= like |x or y| differ in at most (100 - like) / (100 + like) of
    |x| + |y| members, and a bit of the sketches differs only where a member of one set alone falls on it.
    """
    places = [F.bit_count(F.col(f"a_b{w}").bitwiseXOR(F.col(f"b_b{w}"))) for w in range(SKETCH)]
    return sum(places[1:], places[0]) * (100 + like) <= (F.col("a_n") + F.col("b_n")) * (100 - like)


def first_shared() -> Column:
    """Of keys a_k0, a_k1, ... and b_k0, b_k1, ...: whether ``key`` is the first band that the two lines share.

    A pair of different components shares every earlier band too where it was met in a star and found unlike, or
    where both are still open; so the pair comes out in one of its bands only, and none is lost.
    """
    return F.coalesce(*[F.when(F.col(f"a_k{i}") == F.col(f"b_k{i}"), F.col(f"a_k{i}")) for i in range(len(bands()))]) == F.col("key")


def similar_groups(signed: DataFrame, lines: DataFrame, scratch: Scratch, like: int = LIKE) -> tuple[DataFrame, DataFrame]:
    """(node, component) of distinct lines whose shingle sets are alike, ids of ``signed``, and the rows of
    ``lines`` (d1, d2, norm, ...) that occur again or were compared: (id, n, ...) without d1, d2 and norm."""
    keys = band_keys()
    pairs, between = first_stars(signed.select("id", F.explode(F.array(*keys)).alias("key")), scratch)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("asked", F.lit(True))
    asked = signed.select("id", "d1", "d2", "n", *[k.alias(f"k{i}") for i, k in enumerate(keys)]).join(ids, "id", "left")
    asked = scratch.keep(asked.filter("n > 1 OR asked"), "asked")
    keyed = asked.filter("asked").select("id", *[f"k{i}" for i in range(len(keys))])
    # what is asked for grows with the corpus: shuffled at every size, never broadcast; the texts need no sort
    seen = lines.join(asked.select("id", "d1", "d2", "n", "asked").hint("shuffle_hash"), ["d1", "d2"]).drop("d1", "d2")
    seen = scratch.keep(seen.withColumn("norm", F.when(F.col("asked"), F.col("norm"))).drop("asked"), "seen")
    texts = scratch.keep(seen.filter("norm IS NOT NULL").select("id", "norm").dropDuplicates(["id"]), "texts")
    sketched = scratch.keep(sketches(texts), "sketched")
    of = lambda c: sketched.select(F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in sketched.columns[1:]])
    side = lambda c: texts.select(F.col("id").alias(c), F.col("norm").alias(f"{c}_norm"))

    def alike(pairs: DataFrame) -> DataFrame:
        likely = pairs.join(of("a"), "a").join(of("b"), "b").filter(may_be_alike(like)).select("a", "b")
        return same_sets(scratch.keep(likely, "likely"))

    def same_sets(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), "a").join(side("b"), "b").select(
            "a", "b", _wide(F.col("a_norm")).alias("a_wide"), _wide(F.col("b_norm")).alias("b_wide"))
        both = both.select("a", "b", shingle_hashes(F.col("a_wide")).alias("x"), shingle_hashes(F.col("b_wide")).alias("y"))
        both = both.select("a", "b", F.array_distinct("x").alias("x"), F.array_distinct("y").alias("y"))
        return both.filter(shares(F.col("x"), F.col("y"), like)).select("a", "b")

    def links_within(left: DataFrame) -> DataFrame:
        met = band_pairs(left.join(sketched, "id").join(keyed, "id"), may_be_alike(like) & first_shared())
        return same_sets(scratch.keep(met, "band_pairs"))

    links = scratch.keep(alike(pairs), "links")
    owner = groups(between, links, alike, links_within, scratch)
    scratch.drop("shared", "asked", "texts", "sketched", "links")
    return owner, seen.drop("norm")


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", like: int = LIKE) -> DataFrame:
    """The documents with later copies of lines taken out, n_lines, n_removed and ``emptied``.

    Lines are cut at ``\\n`` and compared trimmed and in lower case; a line with nothing else than
    white space is no copy of anything and stays.  Of each component the occurrence with the
    smallest (id, place) stays.  ``emptied``: every line with content went.  A null or empty text
    stays as it is.  Rows equal in id and text are one document and keep the same lines; a null
    id sorts first.  Columns named n_lines, n_removed or emptied give way.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    own = F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(F.col(id).cast("string"), F.lit("\x02")), text_of(text))))
    # named before the explosion, so that a text is digested once and not for each of its lines; outer, so that it is not cut twice
    at = docs.select(own.alias("own"), F.col(id).alias("doc"), F.split(text_of(text), "\n").alias("parts"))
    at = at.select("own", "doc", F.posexplode_outer("parts").alias("pos", "line"))
    at = at.filter(trimmed(F.col("line")) != "").select("own", "doc", "pos", normal_form(F.col("line")).alias("norm"))
    # 128 bits tell lines apart
    at = at.select("own", "doc", "pos", F.xxhash64("norm").alias("d1"), F.xxhash64(F.lit(1), "norm").alias("d2"), "norm")
    signed = scratch.keep(signatures(at.select("d1", "d2", "norm")).withColumn("id", F.monotonically_increasing_id()), "signed")
    owner, seen = similar_groups(signed, at, scratch, like)
    # a line that occurs once and is like no other stays, so its place is not asked for
    placed = seen.join(owner, F.col("id") == F.col("node"), "left").filter("n > 1 OR component IS NOT NULL")
    placed = scratch.keep(placed.select("own", "doc", "pos", F.coalesce("component", "id").alias("group")), "placed")
    order = F.struct("doc", "pos", "own")
    first = placed.groupBy("group").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = placed.join(first, "group").filter(~((F.col("own") == F.col("first.own")) & (F.col("pos") == F.col("first.pos"))))
    gone = scratch.keep(gone.select("own", "pos").distinct().groupBy("own").agg(F.collect_list("pos").alias("__gone")).withColumnRenamed("own", "__of"), "gone")
    scratch.drop("signed", "seen", "placed")

    parts = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__gone"))
    cut = F.array_join(F.transform(left, lambda i: F.get(F.col("__parts"), i)), "\n")
    taken = ("n_lines", "n_removed", "emptied")
    base = docs.drop(*[c for c in docs.columns if c in taken])
    out = base.withColumn("__own", own).join(gone, F.col("__own") == F.col("__of"), "left").withColumn("__parts", parts)
    out = out.withColumn("__new", F.when(F.col("__gone").isNull(), F.col(text)).otherwise(cut))
    return out.select(
        *[F.col("__new").alias(c) if c == text else F.col(f"`{c}`") for c in base.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("__parts")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        (F.col("__gone").isNotNull() & (F.btrim(F.col("__new"), F.lit(" \t\n\r\x0b\x0c")) == "")).alias("emptied"))


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(text_of(), 256).alias("kept_sha256"))


def stage_lines(spark, docs, sf_dir):
    """Pipeline stage: texts lose copied lines; a document of which nothing is left goes."""
    return line_dedup(docs).filter("NOT emptied").select(*docs.columns)
