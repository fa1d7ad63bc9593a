"""Quality rules judged per document and per host.

Every rule is a column over a few counts of the text.  Failures are added up per host, each host's
failure rate is pulled towards the corpus rate by a beta prior fitted to the hosts themselves, and
documents of hosts whose shrunk rate is too high go with the documents that fail on their own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from secframe.llm.common import Scratch, space_words, table, text_of

WINDOW = 5
MIN_WORDS = 10
#: A host goes if the shrunk rate of any rule reaches this.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight in documents: no host is judged without it, none only by it.
MIN_PRIOR, MAX_PRIOR = 5.0, 1e6

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds ``name``: words inside windows of five that occur twice or more in the same text.

    Windows are compared by 64-bit hashes within one text.  Only texts with equal hashes sort
    their windows; the rest stop at the distinct count, so cost is n log n however repetitive
    a text is.
    """
    w, n = F.col(words), F.size(words)
    window = lambda i: F.xxhash64(*[w[i + j] for j in range(WINDOW)])
    empty = F.array().cast("array<bigint>")
    df = df.withColumn("__h", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), window)).otherwise(empty))
    df = df.withColumn("__again", F.size(F.array_distinct("__h")) < F.size("__h"))
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.col("__again"), pairs))
    s = F.col("__s")
    twin = lambda x, i: (((i > 0) & (s[i - 1]["h"] == x["h"]))
                         | ((i + 1 < F.size(s)) & (s[i + 1]["h"] == x["h"])))
    starts = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))
    # each window adds the words that the one before did not cover
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("sum")),
        lambda acc: acc["sum"])
    return df.withColumn(name, F.coalesce(F.when(F.col("__again"), covered), F.lit(0)).cast("bigint")) \
             .drop("__h", "__again", "__s")


def text_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds FEATURES and ``n_lines`` (lines with a word) of a text column; null counts as empty."""
    df = df.withColumn("__t", text_of(text)).withColumn("__w", space_words(F.col("__t")))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    df = df.withColumn("__l", F.filter(F.split("__t", "\n"), has_word))
    df = repeated_words(df, "__w", "__r")
    long = lambda c: c.cast("bigint")
    plain = F.regexp_replace("__t", r"[#*$%&|<>]", "")
    return df.select(
        *[c for c in df.columns if c not in ("__t", "__w", "__l", "__r", *FEATURES, "n_lines")],
        long(F.size("__w")).alias("n_words"), long(F.length(F.array_join("__w", ""))).alias("word_chars"),
        long(F.length("__t") - F.length(plain)).alias("n_symbols"),
        long(F.size("__l") - F.size(F.array_distinct("__l"))).alias("n_dup_lines"),
        F.col("__r").alias("n_repeat_words"), long(F.size("__l")).alias("n_lines"))


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * n)


def rules() -> dict[str, Column]:
    """Rule name -> failure.  The first two reject a document by themselves; all count for its host."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 2 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def host_verdicts(counted: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n, shrunk rates as a map, host_failed) from documents with their counts.

    The prior of a rule has the corpus rate m as its mean; its weight follows from the variance
    between hosts beyond what drawing n documents at rate m explains (method of moments).
    """
    names = list(rules())
    hosts = counted.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("bigint")).alias(f"f_{r}") for r, c in rules().items()])
    rate = lambda r: F.col(f"f_{r}") / F.col("n")
    total = hosts.agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("H"),
        *[F.sum(f"f_{r}").alias(f"k_{r}") for r in names],
        *[F.sum(rate(r) * F.col(f"f_{r}")).alias(f"q_{r}") for r in names])
    N, H = F.col("N"), F.col("H")
    prior = []
    for r in names:
        m = F.col(f"k_{r}") / N
        spread = F.col(f"q_{r}") / N - m * m - m * (1 - m) * H / N
        weight = F.when(spread > 0, m * (1 - m) / spread - 1).otherwise(F.lit(MAX_PRIOR))
        prior += [m.alias(f"m_{r}"),
                  F.greatest(F.lit(MIN_PRIOR), F.least(F.lit(MAX_PRIOR), weight)).alias(f"s_{r}")]
    # one row for the whole corpus
    judged = hosts.withColumn("p", total.select(F.struct(*prior)).scalar())
    shrunk = {r: (F.col(f"f_{r}") + F.col(f"p.m_{r}") * F.col(f"p.s_{r}")) / (F.col("n") + F.col(f"p.s_{r}"))
              for r in names}
    failed = F.lit(False)
    for c in shrunk.values():
        failed = failed | (c >= limit)
    return judged.select("host", "n", F.map_from_arrays(
        F.array(*[F.lit(r) for r in names]), F.array(*shrunk.values())).alias("rates"),
        failed.alias("host_failed"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", carry=None,
                  limit: float = HOST_LIMIT) -> DataFrame:
    """``carry`` columns of every document, its counts, ``base_failed``, ``host_failed``, ``kept``.

    A null text has no words and fails; a null host is the host ''.  Repeated rows are judged each.
    An empty table gives an empty result.  A carried column named like a result column gives way.
    The counts are written once; the host table is joined by size, so a host that holds a third
    of the corpus is either met by a broadcast or split by the adaptive skew join.
    """
    carry = docs.columns if carry is None else carry
    scratch = Scratch(docs.sparkSession, "quality")
    taken = {*FEATURES, "n_lines", "base_failed", "host_failed", "kept"}
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry if c not in taken]).alias("__row"),
                       F.col(text).alias("__text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host"))
    counted = scratch.keep(text_counts(base, "__text").drop("__text"), "counted")
    hosts = host_verdicts(counted, "__host", limit).select(F.col("host").alias("__host"), "host_failed")
    return counted.join(hosts, "__host").select(
        "__row.*", *FEATURES, "n_lines", base_failed().alias("base_failed"), "host_failed",
        (~base_failed() & ~F.col("host_failed")).alias("kept"))


def op6_quality_rules(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", *FEATURES, "base_failed", "kept")


def stage_quality(spark, docs, sf_dir):
    """Pipeline stage: documents that the rules or their host's verdict reject go."""
    return quality_rules(docs).filter("kept").select(*docs.columns)


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 4)) AS i, w FROM d WHERE len(w) >= 5),
v AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS x FROM g),
twice AS (SELECT doc_id, x FROM v GROUP BY doc_id, x HAVING count(*) > 1),
p AS (SELECT DISTINCT v.doc_id, v.i + j AS pos FROM v JOIN twice USING (doc_id, x), (SELECT unnest([0, 1, 2, 3, 4]) AS j)),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM p GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
r AS (
  SELECT host, 'short' AS rule, n_words < {MIN_WORDS} AS bad FROM f
  UNION ALL SELECT host, 'repeats', 100 * n_repeat_words > 20 * n_words FROM f
  UNION ALL SELECT host, 'symbols', 2 * n_symbols > n_words FROM f
  UNION ALL SELECT host, 'dup_lines', 10 * n_dup_lines > 3 * n_lines FROM f
  UNION ALL SELECT host, 'word_length', word_chars < 2 * n_words OR word_chars > 15 * n_words FROM f),
h AS (SELECT host, rule, count(*) AS n, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS k FROM r GROUP BY host, rule),
m AS (SELECT rule, sum(k) / sum(n) AS m, count(*) / sum(n) AS hn, sum(k * k / n) / sum(n) AS q FROM h GROUP BY rule),
s AS (SELECT rule, m, greatest({MIN_PRIOR}, least({MAX_PRIOR}, CASE WHEN q - m * m - m * (1 - m) * hn > 0
        THEN m * (1 - m) / (q - m * m - m * (1 - m) * hn) - 1 ELSE {MAX_PRIOR} END)) AS s FROM m),
bad AS (SELECT DISTINCT host FROM h JOIN s USING (rule) WHERE (k + m * s) / (n + s) >= {HOST_LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.host IS NULL AS kept
FROM f LEFT JOIN bad ON f.host = bad.host
"""
