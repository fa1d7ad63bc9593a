import base64
import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from secframe.llm import decontaminate as D, licenses as L, lines as N, neardup as M, pieces as P, quality as Q, rans as R, suffixes as S, toxicity as T, warc as W  # noqa: E402
from secframe.llm.common import Scratch  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, ids string, digest string, line string"


def words(rnd, n):
    return " ".join(rnd.choice(["la", "mo", "ti", "ker", "san", "du", "wo"]) + rnd.choice(["x", "y", "z", "ra", "ne"]) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, near copies, shared passages, columns with clashing names."""
    rnd = random.Random(11)
    base = [words(rnd, n) for n in (60, 80, 120, 40, 12, 3)]
    near = base[2].split(" ")
    near[50] = "other"
    passage = words(rnd, 70)
    rows = [(1, base[0]), (2, base[0]), (3, base[1]), (4, base[2]), (5, " ".join(near)), (6, ""), (7, None), (8, " \n\t "),
            (9, base[5]), (10, base[4] + "\n" + passage), (11, base[3] + "\n" + passage + "\n" + base[4].upper()),
            (12, "ab " * 300), (13, words(rnd, 9000)), (13, base[1] + " twice"), (None, base[0]), (14, base[1]), (14, base[1]),
            (15, "été über ▁ 🙂 " + words(rnd, 30)), (16, "Released under the MIT License.\n" + words(rnd, 4)), (17, "x" * 700)]
    fill = [(i, t, [None, "en", "fr"][k % 3], [None, "a", "b", "a"][k % 4], 0, "q", "q", "q", "q", "q") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(fill, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < -1")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_quality(docs, empty, rows):
    got = Q.quality_rules(docs)
    assert set(got.columns) >= {"doc_id", "text", "kept", "n_words"}
    want = []
    for i, t in rows:
        w = brute.space_words(t)
        lines = [x for x in (t or "").split("\n") if brute.space_words(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)),
                     brute.repeat_words(w), brute.base_failed(t)))
    same([tuple(r) for r in got.select("doc_id", *Q.FEATURES, "base_failed").collect()], want)
    assert Q.quality_rules(empty).count() == 0


def test_host_verdict_takes_all_documents_of_a_bad_host(spark):
    good = "one two three four five six seven eight nine ten eleven %d"
    rows = [(i, good % i, "fine") for i in range(200)] + [(1000 + i, "short", "spam") for i in range(190)] + [(5000, good % 5000, "spam")]
    got = {r.doc_id: r.kept for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not got[5000]


def test_line_dedup(docs, empty, rows):
    once = {i: t for i, t in rows if i is not None and i not in (13, 14)}
    part = docs.filter("doc_id IS NOT NULL AND doc_id NOT IN (13, 14)")
    got = {r.doc_id: (r.text, r.emptied) for r in N.line_dedup(part).collect()}
    assert got == brute.dedup_lines(once)
    whole = N.line_dedup(docs)
    assert whole.count() == len(rows) and N.line_dedup(empty).count() == 0
    assert {r.text for r in whole.filter("doc_id = 14").collect()} != set()


def test_near_duplicates(docs, empty, rows):
    got = M.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    comp = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert comp[2] == 1 and comp[5] == 4 and comp[14] == comp[13] == 3 and comp[6] == 6 and comp[8] == 8
    (unnamed,) = [r for r in got if r.doc_id is None]
    assert unnamed.component_id is None and unnamed.kept
    plain = docs.filter("doc_id <> 13 AND doc_id <> 14")
    want = brute.near({i: t for i, t in rows if i not in (None, 13, 14)})
    assert {r.doc_id: r.component_id for r in M.near_duplicates(plain).collect()} == want
    assert M.near_duplicates(empty).count() == 0


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(2)
    a = np.unique(rnd.integers(0, 2 ** 63, 900).astype(np.uint64))
    b = np.concatenate([a[:600], np.unique(rnd.integers(0, 2 ** 63, 300).astype(np.uint64))])
    sig = M.superminhash([a, b, a[:0], a[:3]], 240)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.12 and np.isinf(sig[2]).all() and np.isfinite(sig[3]).all()
    assert (M.superminhash([a[:3]], 240)[0] == sig[3]).all()


def test_decontamination(spark, docs, empty, rows):
    texts = dict((i, t) for i, t in rows if i is not None)
    items = [(1, " ".join(texts[10].split()[14:44])), (2, texts[9]), (2, "nothing like it at all"), (None, texts[4]), (4, None), (5, "!!"), (6, "x" * 700)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    named = [("" if i is None else i, t) for i, t in items]
    want = []
    for i, t in rows:
        n, hit, found = brute.leaks(t, named)
        want.append((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    same([tuple(r)[:6] for r in D.decontaminate(docs, bench).collect()], want)
    assert D.decontaminate(empty, bench).count() == 0
    assert D.decontaminate(docs, bench.filter("item_id < 0")).filter("contaminated").count() == 0


def test_proximity(spark):
    text = " ".join(f"w{i}" for i in range(40))
    moved = text.replace("w14 w15", "w14 more w15")
    docs = spark.createDataFrame([(1, text), (2, moved)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(10, 20)))], "item_id bigint, text string")
    got = {r.doc_id: (r.contaminated, r.n_near) for r in D.decontaminate(docs, bench).collect()}
    assert got[1] == (True, 1) and not got[2][0]


def test_pieces(docs, empty, rows):
    from sentencepiece import SentencePieceProcessor
    lib = SentencePieceProcessor(model_file=P.model_path())
    got = P.round_trip(docs, ["doc_id", "ids", "line"])
    want = [(i, lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for i, t in rows]
    same([(r.doc_id, list(r.ids), r.decoded) for r in got.collect()], want)
    assert P.round_trip(empty, ["doc_id"]).count() == 0
    bpe, rnd = P.PieceBpe(P.model_path()), random.Random(3)
    odd = ["".join(rnd.choices(list("ab  \n▁éß中🙂\x00aaath"), k=rnd.randrange(50))) for _ in range(400)] + ["a" * 2000, " " * 90]
    assert [x.tolist() for x in bpe.encode(odd)] == lib.encode(odd)
    for _ in range(300):
        ids = [rnd.randrange(3, 32000 if rnd.random() < 0.5 else 259) for _ in range(8)]
        assert bpe.decode(np.array(ids)) == lib.decode(ids)


def test_range_coding(spark, docs, empty, rows):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(R.vocabulary_path())
    scratch = Scratch(spark, "t")
    index, table = R.encode_corpus(docs, scratch.place("files"), scratch)
    got = sorted(R.read_files(index, table).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, order):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(rows)
    scratch = Scratch(spark, "t")
    index, table = R.encode_corpus(empty, scratch.place("files"), scratch)
    assert R.read_files(index, table).count() == 0


def test_blocks_notice_damage():
    ids = np.random.default_rng(1).zipf(1.3, 5000) % 900
    table = R.Table.of_counts(*np.unique(ids, return_counts=True))
    data = R.block_bytes(table, [5, None], [ids[:4000], ids[4000:]])
    names, parts = R.read_block(table, data)
    assert names == [5, None] and (np.concatenate(parts) == ids).all()
    with pytest.raises(ValueError):
        R.read_block(table, data[:-3] + bytes([data[-3] ^ 1]) + data[-2:])


def test_repeats(docs, empty, rows):
    got = S.remove_repeats(docs, merge_bytes=2000, shard_bytes=500).collect()
    digest = lambda r: (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
    want = [(i, *x) for (i, _), x in zip(rows, brute.cut_repeats([t for _, t in rows]))]
    same([digest(r) for r in got], want)
    same([digest(r) for r in S.remove_repeats(docs, hot=0).collect()], want)      # every window counted by itself
    assert S.remove_repeats(empty).count() == 0


def test_warc(spark):
    pages = [(3, "http://a/é", "same"), (1, None, "same"), (2, "u\r\nx: y", None), (5, "u", ""), (5, "u", ""), (None, "n", "same"), (8, "b", "ü" * 5000), (9, "c", "a\r\n\r\nb")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    scratch = Scratch(spark, "t")
    written = scratch.keep(W.write_archives(df, scratch.place("a")), "manifest")
    for split in (1 << 20, 137):
        got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
               for r in W.read_archives(written, split_bytes=split).collect()]
        first = {"same": 1, "": 2, "ü" * 5000: 8, "a\r\n\r\nb": 9}
        want = []
        for p, u, t in pages:
            data, f = (t or "").encode(), first[t or ""]
            sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
            want.append((p, u, len(data), sha, "response", None, data) if p == f else (p, u, len(data), sha, "revisit", f, None))
        same(got, want)
    assert W.read_archives(W.write_archives(df.filter("page_id < 0"), scratch.place("b"))).count() == 0


def test_licenses(spark, docs, empty, rows):
    notice = "Licensed under the Apache License, Version 2.0."
    files = [(1, "p/LICENSE", notice), (2, "p/q/a.py", "plain words only"), (3, "p/q/r/NOTICE", "Released under the MIT License."), (4, "p/q/r/b.py", "x"),
             (5, "o/c.py", None), (6, "o/d.py", words(random.Random(4), 60) + "\n" + notice), (7, "top", "")]
    df = spark.createDataFrame(files, "doc_id bigint, path string, text string")
    got = {r.doc_id: (r.license, r.origin, r.from_dir) for r in L.license_scan(df, F.col("path")).collect()}
    assert got == {1: ("Apache-2.0", "own", None), 2: ("Apache-2.0", "inherited", "p"), 3: ("MIT", "own", None), 4: ("MIT", "inherited", "p/q/r"),
                   5: (None, "none", None), 6: ("Apache-2.0", "own", None), 7: (None, "none", None)}
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    assert L.license_scan(docs, path).count() == len(rows) and L.license_scan(empty, path).count() == 0


def test_toxicity(spark, docs, empty, rows):
    rnd = random.Random(6)
    data = []
    for i in range(900):
        w = words(rnd, rnd.randrange(5, 80)).split(" ")
        bad = i % 5 == 0
        if bad:
            w.insert(rnd.randrange(len(w)), rnd.choice(["vile", "rotten"]))
        data.append((i, " ".join(w), "en" if i % 3 else "fr", int(bad)))
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, toxic int")
    labels = df.select("doc_id", "toxic")
    got = {r.doc_id: r for r in T.toxicity(df.drop("toxic"), labels).collect()}
    held = [(r[3], got[r[0]]) for r in data if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(g.held_out for _, g in held) and sum(g.held_out for g in got.values()) == len(held)
    assert np.mean([g.predicted == y for y, g in held]) > 0.95
    assert T.toxicity(docs, labels).count() == len(rows) and T.toxicity(empty, labels).count() == 0
    none = T.toxicity(docs, labels.filter("toxic > 5")).collect()
    assert len({r.score for r in none}) == 1 and not any(r.predicted for r in none)


def test_near_duplicates_between_the_ends_of_a_band(spark):
    """Light copies (0.85 to each other) among heavy ones (0.62 to all): every band's ends are heavy."""
    rnd = random.Random(21)
    base = [f"b{i}" for i in range(400)]

    def copy(n, edits):
        out = list(base)
        for at in range(3, 400, 400 // edits):
            out[min(399, at + rnd.randrange(400 // edits - 5))] = f"n{n}_{at}"
        return " ".join(out)
    heavy = {i: copy(i, 18) for i in [*range(200), *range(5000, 5200)]}
    light = {i: copy(i, 5) for i in range(1000, 1010)}
    texts = heavy | light
    got = M.near_duplicates(spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.near(texts)
    assert len({brute.near(light)[i] for i in light}) == 1


def test_line_twins_inside_a_template_family(spark):
    """Twins (over 0.80) among lines of one template (about 0.5): bands hold both, their ends are seldom twins."""
    rnd = random.Random(5)
    own = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, texts = own(38), {}
    for i in range(250):
        line = head + own(10)
        texts[2 * i] = line
        texts[2 * i + 1] = line[:-1] + ("1" if i % 2 else "2")
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.emptied) for r in N.line_dedup(docs).collect()}
    want = brute.dedup_lines(texts)
    wrong = sum(got[i] != want[i] for i in texts)
    assert wrong <= 5          # pairs that share no band: one in a hundred at 0.80


def test_sketches_leave_few_pairs_of_a_line_family_and_lose_none(spark):
    """Lines at about 0.7 to each other in one band: the join gives the alike pairs and few others, not the square of the family."""
    from secframe.llm.grouping import band_pairs
    rnd = random.Random(8)
    own = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, lines = own(300), []
    for _ in range(60):
        line = head + own(60)
        lines += [line, line[:-3] + own(3)]
    texts = spark.createDataFrame(list(enumerate(lines)), "id bigint, norm string")
    sketched = N.sketches(texts)
    rows = sketched.withColumn("key", F.lit(1)).withColumn("c", F.col("id"))
    for block in (2000, 50):
        got = {tuple(r) for r in band_pairs(rows, N.may_be_alike(80), block).collect()}
        sets = [brute.line_shingles(x) for x in lines]
        want = {(i, j) for j in range(len(lines)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        assert len(want) >= 60 and want <= got and len(got) <= 2 * len(want)
    assert {r.id: r.n for r in sketched.collect()} == {i: len(s) for i, s in enumerate(sets)}


def test_a_pair_leaves_the_join_inside_the_bands_once(spark):
    """Lines of one family share several bands; each pair comes out of the first of them, at any block size."""
    from secframe.llm.grouping import _cells
    rnd = random.Random(9)
    own = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = own(300)
    texts = spark.createDataFrame([(i, head + own(25)) for i in range(40)], "id bigint, norm string")
    signed = N.signatures(texts.select("id", "norm", F.col("id").alias("d1"), F.lit(0).alias("d2"))).withColumn("id", F.col("d1")).localCheckpoint()
    keyed = signed.select("id", F.col("id").alias("c"), *[k.alias(f"k{i}") for i, k in enumerate(N.band_keys())])
    rows = keyed.withColumn("key", F.explode(F.array(*[f"k{i}" for i in range(len(N.bands()))]))).join(N.sketches(texts), "id").localCheckpoint()
    for block in (2000, 7):
        a, b = _cells(rows, "key", block)
        met = a.join(b, ["key", "row", "col"]).filter((F.col("a_id") < F.col("b_id")) & N.may_be_alike(80))
        every = [tuple(r) for r in met.select("a_id", "b_id").collect()]
        once = [tuple(r) for r in met.filter(N.first_shared()).select("a_id", "b_id").collect()]
        assert len(every) > 3 * len(set(every)) > 0 and sorted(once) == sorted(set(every))


def test_lines_are_trimmed_of_the_same_white_space(spark):
    lines = ["", " ", "a", " A", "B\t", "\r\x0b c\x0c", "\xa0d ", "e f", " \t\r", "\u00c9 ", "g\u2003"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.select(N.normal_form(F.col("line")), F.lower(F.btrim("line", F.lit(" \t\r\x0b\x0c")))).collect()
    assert all(r[0] == r[1] for r in got) and [r[0] for r in got][:6] == ["", "", "a", "a", "b", "c"]


def test_signatures_count_and_cover_every_shingle(spark):
    """Lines around the number of shingles hashed at a time: each shingle takes part, places are counted once a line."""
    lines = ["abcdefghijklmnopqrstuvwxyz"[:n] for n in (1, 7, 8, 9, 15, 16, 23, 24, 26)] + ["a" * 40] * 3
    df = spark.createDataFrame([(x, x) for x in lines], "d1 string, norm string").withColumn("d2", F.lit(0))
    masks = N._masks()
    got = {r.d1: (r.n, [r[f"s{j}"] for j in range(len(masks))]) for r in N.signatures(df).collect()}
    hashes = {r.d1: r.h for r in df.select("d1", N.shingle_hashes(N._wide(F.col("norm"))).alias("h")).collect()}
    assert got == {x: (lines.count(x), [min(h ^ m for h in hashes[x]) for m in masks]) for x in lines}


def test_proximity_of_an_edited_passage(spark):
    item = [f"w{i}" for i in range(10, 20)]
    docs = [(1, "a b " + " ".join(item)), (2, "c " + " ".join(item).replace("w14 w15", "w14 more w15") + " d"),
            (3, " ".join(item).replace("w16", "other")), (4, " ".join(reversed(item))), (5, " ".join(item[:5]) + " x" * 9 + " " + " ".join(item[5:]))]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    for part in (docs, docs[1:]):                  # with and without a verbatim copy elsewhere
        df = spark.createDataFrame(part, "doc_id bigint, text string")
        got = {r.doc_id: (r.contaminated, r.n_near) for r in D.decontaminate(df, bench).collect()}
        want = {1: (True, 1), 2: (False, 1), 3: (False, 1), 4: (False, 0), 5: (False, 0)}
        assert got == {i: want[i] for i, _ in part}
    found = D.passages(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert (1, "7", 2, "exact") in {tuple(r) for r in found} and (2, "7", 1, "near") in {tuple(r) for r in found}
    assert {r.doc_id for r in found} == {1, 2, 3}


def test_line_dedup_bears_its_own_column_names(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta", "x", "y", 3), (2, "alpha beta gamma delta\nother words here", "p", "q", 4)],
                               "doc_id bigint, text string, own string, gone string, pos int")
    got = {r.doc_id: (r.text, r.own, r.gone, r.pos) for r in N.line_dedup(df).collect()}
    assert got == {1: ("alpha beta gamma delta", "x", "y", 3), 2: ("other words here", "p", "q", 4)}


def test_warc_urls_come_back_as_written():
    for url in ("http://a/%41?x=1%20b", "http://a/é ü", "100%", "a%zz&b=c#d"):
        import gzip
        assert W.parse_record(gzip.decompress(W.record_bytes(1, url, b"x")))["url"] == url


def test_cuts_by_language_are_the_best_by_f1(spark):
    rnd = random.Random(11)
    bins = {}
    for _ in range(600):
        lang, toxic = rnd.choice(["en", "fr", "one"]), rnd.random() < 0.3
        at = rnd.randrange(-60, 40) + (25 if toxic else 0)
        n, t = bins.get((lang, at), (0, 0))
        bins[lang, at] = (n + 1, t + (toxic and lang != "one"))
    df = spark.createDataFrame([(l, b, n, int(t)) for (l, b), (n, t) in bins.items()], "lang string, bin int, n bigint, toxic bigint")
    got = {r.lang: r.cut * T.PER_UNIT for r in T.best_cuts(df).collect()}
    assert set(got) == {"en", "fr"}          # no toxic row, no cut
    for lang, cut in got.items():
        own = {b: v for (l, b), v in bins.items() if l == lang}

        def f1(at):
            above = [v for b, v in own.items() if b >= at]
            return 2 * sum(t for _, t in above) / (sum(n for n, _ in above) + sum(t for _, t in own.values()))
        assert f1(cut) == max(f1(b) for b in own)
        assert not any(b < cut < b + 1 for b in own)      # no bin is cut in two
