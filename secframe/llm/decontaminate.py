"""Benchmark passages in the corpus, found through a positional inverted index.

The index holds (term, document, position) for every corpus occurrence of a benchmark term.  Terms
are pairs of neighbouring words, so that common words alone never make long lists; a window of a
single word is its own term.  For phrases, each benchmark window starts from the shorter lists of its
two rarest terms, shifted by their offsets: equal shifted positions are candidates, which then meet
the lists of all other terms.  A proximity match holds at least two thirds of a window's terms with
shifted positions within ``slop`` words, so one of its rarest third (and one more) is always there:
those lists give the places at which all other lists are looked up.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from secframe.llm.common import Scratch, ascii_lower, table, text_of

WINDOW = 10
SLOP = 3
#: Terms of a window, in thirds, that a proximity match holds.
NEAR_THIRDS = 2
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(text), _GAP), "")


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                      width: int = WINDOW) -> DataFrame:
    """(item, window): every run of ``width`` words, or all words of a shorter item; none without words."""
    words = words_of(text_of(text))
    df = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words.alias("w"))
    last = F.greatest(F.size("w") - width, F.lit(0))
    at = df.filter(F.size("w") > 0).select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return at.select("item", F.array_join(F.slice("w", F.col("i") + 1, width), " ").alias("window")).distinct()


def window_terms(windows: DataFrame) -> DataFrame:
    """(wid, len, off, term) for (wid, window)."""
    w = windows.select("wid", F.split("window", " ").alias("w"))
    pair = w.filter(F.size("w") > 1).select(
        "wid", F.size("w").alias("len"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("off"))
    pair = pair.select("wid", "len", "off", F.concat(F.get("w", F.col("off")), F.lit(" "), F.get("w", F.col("off") + 1)).alias("term"))
    one = w.filter(F.size("w") == 1).select("wid", F.lit(1).alias("len"), F.lit(0).alias("off"), F.col("w")[0].alias("term"))
    return pair.unionByName(one)


def postings(docs: DataFrame, id: str, text: str, terms: DataFrame) -> DataFrame:
    """(rid, doc_id, pos, tid) of ``terms`` (term, tid); the term '' stands once behind each document's last word."""
    words = F.concat(words_of(text_of(text)), F.array(F.lit("")))
    df = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id).alias("doc_id"), words.alias("w"))
    df = df.select("rid", "doc_id", "w", F.posexplode("w").alias("pos", "word"))
    pair = F.concat(F.col("word"), F.lit(" "), F.get("w", F.col("pos") + 1))
    df = df.select("rid", "doc_id", "pos", F.explode(F.array("word", pair)).alias("term"))
    return df.join(terms, "term").select("rid", "doc_id", "pos", "tid")


def near_matches(lists: DataFrame, weighed: DataFrame, slop: int = SLOP) -> DataFrame:
    """(rid, wid, start) where enough terms of a window stand within ``slop`` words: ``lists`` (rid, pos, tid),
    ``weighed`` (wid, off, tid, n) with all terms of each window, n null where the corpus lacks one."""
    per = Window.partitionBy("wid")
    t = weighed.withColumn("terms", F.count(F.lit(1)).over(per)).withColumn(
        "rank", F.row_number().over(per.orderBy(F.coalesce("n", F.lit(0)), "off")))
    t = t.withColumn("need", F.expr(f"(terms * {NEAR_THIRDS} + 2) div 3")).filter("n IS NOT NULL")
    rare = t.filter("rank <= terms - need + 1").select("wid", "off", "tid")
    anchors = lists.join(rare, "tid").select("rid", "wid", (F.col("pos") - F.col("off")).alias("start")).distinct()
    cell = f"(start + off) div {slop + 1}"
    asked = anchors.join(t.select("wid", "off", "tid", "need"), "wid").withColumn(
        "cell", F.explode(F.expr(f"array({cell} - 1, {cell}, {cell} + 1)")))
    there = lists.select("rid", "tid", "pos", F.expr(f"pos div {slop + 1}").alias("cell"))
    by = asked.join(there, ["rid", "tid", "cell"]).withColumn("by", F.col("pos") - F.col("off") - F.col("start")).filter(F.abs("by") <= slop)
    held = [F.size(F.collect_set(F.when(F.col("by").between(k - slop, k), F.col("off")))) for k in range(slop + 1)]
    most = F.greatest(*held) if slop else held[0]
    return by.groupBy("rid", "wid", "start", "need").agg(most.alias("held")).filter("held >= need").select("rid", "wid", "start")


def find(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text",
         item: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = SLOP):
    """Documents (rid, id, n_words), windows' items (wid, item), phrases (rid, wid, len, start) and near (rid, wid, start)."""
    items = scratch.keep(benchmark_windows(benchmark, item, item_text, width), "items")
    windows = scratch.keep(items.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    wterms = window_terms(windows)
    mark = docs.sparkSession.createDataFrame([("",)], "term string")
    terms = scratch.keep(wterms.select("term").unionByName(mark).distinct()
                         .withColumn("tid", F.monotonically_increasing_id()), "terms")
    index = scratch.keep(postings(docs, id, text, terms), "index")
    end = terms.filter("term = ''").select(F.col("tid").alias("end_tid"))
    # the lists' lengths; a window with a term that the corpus lacks occurs nowhere
    freq = index.groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    weighed = scratch.keep(wterms.join(terms, "term").join(freq, "tid", "left").select("wid", "len", "off", "tid", "n"), "weighed")
    per = Window.partitionBy("wid")
    ranked = weighed.withColumn("whole", F.count("n").over(per) == F.count(F.lit(1)).over(per)).filter("whole")
    ranked = scratch.keep(ranked.withColumn("rank", F.row_number().over(per.orderBy("n", "off")))
                          .withColumn("terms", F.count(F.lit(1)).over(per)).drop("whole", "n"), "ranked")
    lists = index.select("rid", "pos", "tid")
    # offset-adjusted lists of the rarest terms
    start = F.col("pos") - F.col("off")
    heads = lists.join(ranked.filter("rank <= 2"), "tid").select("rid", "wid", "len", "rank", "terms", start.alias("start"))
    first = heads.filter("rank = 1 AND terms > 1").select("rid", "wid", "len", "start")
    second = heads.filter("rank = 2").select("rid", "wid", "start")
    found = scratch.keep(first.join(second, ["rid", "wid", "start"]).filter("start >= 0").distinct(), "found")
    # phrase candidates meet the rest of their lists
    rest = ranked.filter("rank > 2").select("wid", "off", "tid", "terms")
    spots = found.join(rest, "wid").select("rid", "wid", "len", "start", "terms", "tid", (F.col("start") + F.col("off")).alias("pos"))
    full = (spots.join(lists, ["rid", "pos", "tid"]).groupBy("rid", "wid", "len", "start", "terms")
            .agg(F.count(F.lit(1)).alias("n")).filter("n = terms - 2").select("rid", "wid", "len", "start"))
    two = found.join(ranked.filter("rank = 2 AND terms = 2").select("wid"), "wid").select("rid", "wid", "len", "start")
    single = heads.filter("terms = 1").select("rid", "wid", "len", "start")
    matches = scratch.keep(full.unionByName(two).unionByName(single), "matches")
    near = scratch.keep(near_matches(lists, weighed.select("wid", "off", "tid", "n"), slop), "near")
    documents = index.join(end, index.tid == end.end_tid).select("rid", F.col("doc_id").alias(id), F.col("pos").cast("bigint").alias("n_words"))
    return documents, windows.join(items, "window").select("wid", "item"), matches, near


def passages(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", **how) -> DataFrame:
    """``id``, item, start (word of the document), kind ('exact' or 'near'; a near start may be up to ``slop`` words off)."""
    documents, of_window, matches, near = find(docs, benchmark, Scratch(docs.sparkSession, "leaks"), id, **how)
    exact = matches.select("rid", "wid", "start", F.lit("exact").alias("kind"))
    other = near.join(matches, ["rid", "wid", "start"], "left_anti").select("rid", "wid", "start", F.lit("near").alias("kind"))
    return exact.unionByName(other).join(of_window, "wid").join(documents, "rid").select(id, "item", "start", "kind").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per document row: ``id``, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    ``n_near`` counts items of which a window has two thirds of its terms within ``slop`` of their
    places.  Null and wordless texts have no words and no hits.  A null id is kept as null; rows
    that share an id are judged each.  An item without id is the item ''; items that share an id
    are one item.  An empty benchmark hits nothing.
    """
    documents, of_window, matches, near = find(docs, benchmark, Scratch(docs.sparkSession, "leaks"),
                                               id, text, item, item_text, width, slop)
    covered = (matches.select("rid", "start", "len").distinct()
               .select("rid", F.explode(F.expr("sequence(start, start + len - 1)")).alias("p")).distinct()
               .groupBy("rid").agg(F.count(F.lit(1)).alias("n_hit")))
    named = (matches.select("rid", "wid").distinct().join(of_window, "wid").select("rid", "item").distinct()
             .groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items")))
    close = (near.select("rid", "wid").distinct().join(of_window, "wid").select("rid", "item").distinct()
             .groupBy("rid").agg(F.count(F.lit(1)).alias("n_near")))
    zero = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c)
    return documents.join(covered, "rid", "left").join(named, "rid", "left").join(close, "rid", "left").select(
        id, "n_words", zero("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce(F.col("n_hit"), F.lit(0)) > 0).alias("contaminated"), zero("n_near"))


def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_near")


def stage_decontaminate(spark, docs, sf_dir):
    """Pipeline stage: documents that hold a benchmark window go, with every row of their id."""
    bad = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated") \
        .select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti").select(*docs.columns)


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS x FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, i, di.n, item FROM di JOIN bw ON di.n = bw.n AND array_to_string(list_slice(w, i, i + di.n - 1), ' ') = bw.x),
pos AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit),
cov AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
