"""Ranked search, hard negatives and the byte network against plain versions."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from secframe.llm import bytenet as B, hardneg as H, ranking as R

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def plain_search(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df, out = Counter(t for _, c in counts for t in c), []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) & set(c))
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if unnamed else i, -s) for r, (s, unnamed, i) in enumerate(sorted(found)[:k])]
    return sorted(map(repr, out))


def prose(rnd, n):
    return " ".join(rnd.choice(["Ala", "mo", "été", "ker", "x9"]) + str(int(rnd.paretovariate(0.7)) % 60) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    docs = [(i, prose(rnd, rnd.randrange(1, 120))) for i in range(700)]
    docs += [(700 + i, docs[3][1]) for i in range(90)] + [(5, docs[9][1]), (None, docs[3][1]), (None, None), (901, None), (902, ""), (903, "!? \n"), (904, "huge " * 400_000 + docs[4][1])]
    items = [(i, prose(rnd, 12)) for i in range(30)] + [(3, docs[3][1]), (3, docs[3][1]), (None, "mo1 mo2"), (40, None), (41, "--"), (42, "nowhere")]
    return docs, items


def test_ranked_search(spark, corpus, monkeypatch):
    docs, items = corpus
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, score int, rank int").repartition(5)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    want = plain_search(docs, items, 50)
    got = lambda **kw: sorted(map(repr, (tuple(r) for r in R.ranked_search(df, bench, **kw).collect())))
    assert got() == want
    assert got(item_bytes=1500) == want                       # several passes
    assert got(k=3) == plain_search(docs, items, 3)
    assert R.ranked_search(df.filter("doc_id < 0"), bench).count() == 0 == R.ranked_search(df, bench.filter("item_id < 0")).count()


def test_bounds_cover_every_score(corpus):
    """No node's bound is below a score beneath it, and some batches are pruned."""
    docs, items = corpus
    it = R.Items([x for x in items if x[1]])
    rows = [(i, [t for p in R.term_pieces((x or "").encode()) for t in p]) for i, x in docs[:600]]
    ids = [np.unique([it.vocabulary[t] for t in w if t in it.vocabulary], return_counts=True) for _, w in rows]
    df = np.zeros(len(it.vocabulary), np.int64)
    for u, _ in ids:
        df[u.astype(np.int64)] += 1
    it.weigh(len(rows), sum(len(w) for _, w in rows), df)
    block = R.Block(it, [i for i, _ in rows], [len(w) for _, w in rows], [u.astype(np.int32).tobytes() for u, _ in ids], [c.astype(np.int32).tobytes() for _, c in ids])
    for level, (begin, t, v) in enumerate(block.levels):
        width = R.LEAF * R.FANOUT ** level
        for node in range(len(begin) - 1):
            top = dict(zip(t[begin[node]:begin[node + 1]].tolist(), v[begin[node]:begin[node + 1]].tolist()))
            for d in range(node * width, min((node + 1) * width, len(rows))):
                assert all(top[a] >= b for a, b in zip(block.terms[d].tolist(), block.values[d].tolist()))
    best, seen = R.Best(it, 2, np.zeros(len(it.ids))), []
    leaf = best._leaf
    best._leaf = lambda b, node, local, some: (seen.append(len(some)), leaf(b, node, local, some))
    best.search(block)
    assert sum(seen) < len(it.ids) * -(-len(rows) // R.LEAF)


def plain_negatives(rows, is_anchor):
    out = []
    take = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for i, l, v in take:
        if i is None or not is_anchor(i):
            continue
        others = [(dot(v, w), j, m) for j, m, w in take if j != i]
        for p, j, _ in sorted((s for s in others if s[2] == l), key=order)[:5]:
            bad = sorted((s for s in others if s[2] != l and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:3]
            out += [(i, j, r + 1, x[1], p, x[0]) for r, x in enumerate(bad)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("shape", ["clustered", "flat"])
def test_hard_negatives(spark, monkeypatch, shape):
    rnd = np.random.default_rng(4)
    monkeypatch.setattr(H, "CELL_BYTES", 3000)
    monkeypatch.setattr(H, "GROUP", 20)
    centres = rnd.normal(0, 1, (6, 8))
    rows = []
    for i in range(400):
        v = centres[i % 6] * rnd.uniform(0.2, 2) + rnd.normal(0, 0.15, 8) if shape == "clustered" else np.round(rnd.normal(0, 1, 8))
        rows.append((i, int(rnd.integers(0, 4)), [float(x) for x in v.astype(np.float32)]))
    rows += [(1000 + i, 1, rows[0][2]) for i in range(60)] + [(7, 2, rows[8][2])] * 2
    rows += [(2000, 1, None), (2010, None, rows[1][2]), (2020, 1, [1.0, None]), (2030, 2, [float("nan")] * 8), (2040, 2, [float("inf")] * 8), (None, 1, rows[0][2]), (None, 0, rows[5][2]),
             (2050, 0, []), (2060, 0, [0.0] * 8), (2070, 1, rows[3][2][:5]), (2080, 1, [300.0, *rows[3][2][1:]])]
    df = spark.createDataFrame([(i, v, l, "x") for i, l, v in rows], "vec_id bigint, embedding array<float>, label int, rank string").repartition(3)
    got = [tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(map(repr, got)) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert H.hard_negatives(df.filter("vec_id < 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_coordinate_ranges_lose_nothing():
    rnd = np.random.default_rng(9)
    m = rnd.normal(0, 200, (500, 6)).astype(np.int16).astype(float)
    m[:250, 0] += 4000
    lengths = np.sqrt((m ** 2).sum(1))
    b = H.Bucket.__new__(H.Bucket)
    b.n, b.m, b.lengths, b._values = len(m), m, lengths, {}
    b.lists = np.argsort(m / lengths[:, None], axis=0, kind="stable").T.astype(np.uint16)
    narrowed = 0
    for q in m[:60]:
        unit = q / np.sqrt(q @ q)
        for cosine in (0.5, 0.9, 0.99):
            rows = b.candidates(unit, np.argsort(-np.abs(unit))[:H.FOCUS], cosine)
            if rows is not None:
                narrowed += len(rows) < len(m) / 2
                assert set(np.flatnonzero(m @ unit / lengths >= cosine)) <= set(rows)
    assert narrowed > 20


def labelled(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(500):
        text = prose(rnd, rnd.randrange(5, 300)).lower()
        if i % 5 == 0:
            text = text.replace(" ", "### ")
        rows.append((i, text, int(i % 5 > 0)))
    return rows, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")


def test_quality_bytes(spark):
    rows, labels = labelled(spark)
    odd = [(None, "plain words only"), (600, None), (601, ""), (3, "again"), (3, "again"), (602, "lang ### " * 200_000)]
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows] + [(i, t, None, None) for i, t in odd], "doc_id bigint, text string, lang string, score double")
    got = B.quality(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {i: q for i, _, q in rows}
    held = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert np.mean(held) > 0.95
    assert B.quality(docs.filter("doc_id < 0"), labels).count() == 0
    for one in (labels.filter("quality = 1"), labels.filter("quality > 5")):
        same = B.quality(docs, one).collect()
        assert len({r.score for r in same}) == 1 and all(r.predicted for r in same)


def test_byte_network_alone(monkeypatch):
    """Folded scoring equals the filters applied one by one; gradients equal differences; long texts come out alike."""
    rnd = np.random.default_rng(3)
    net = B.Network()
    texts = [bytes(rnd.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 7, 511, 512, 513, 960, 4000)]

    def plain(text):
        data = np.concatenate([np.frombuffer(text, np.uint8).astype(int), [256] * 8])
        h = []
        for a in range(0, max(1, len(text) - 64), 448):
            z = [sum(net.p["e"][data[p + j]] @ net.p["w"][j] for j in range(8)) for p in range(a, min(a + 512, max(1, len(text))))]
            h.append(np.maximum(np.max(z, 0) + net.p["b"], 0))
        return np.concatenate([np.mean(h, 0), np.max(h, 0)]) @ net.p["v"] + net.p["c"][0]
    want = [plain(t) for t in texts]
    assert np.allclose(B.logits(net.folded(), texts), want, atol=1e-4)
    monkeypatch.setattr(B, "RUN", 1000)
    assert np.allclose(B.logits(net.folded(), texts), want, atol=1e-4)
    docs, y, weight = [np.frombuffer(t, np.uint8).astype(np.int32) for t in texts], np.array([0, 1] * 4, np.float32), np.ones(8)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = 1 / (1 + np.exp(-np.array([plain(t) for t in texts])))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    grads = net._batch(docs, y, weight)
    for k, at in (("v", (3,)), ("v", (20,)), ("b", (2,)), ("c", (0,)), ("w", (3, 1, 5)), ("e", (int(docs[3][0]), 2))):
        keep, eps = net.p[k][at], 1e-5
        net.p[k][at] = keep + eps
        up = loss()
        net.p[k][at] = keep - eps
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / (2 * eps) - grads[k][at]) < 1e-4 + 0.02 * abs(grads[k][at]), (k, at)


def test_calibration():
    x = (np.arange(B.BINS) + 0.5 - B.BINS // 2) / B.PER_UNIT
    n = 1000 * np.exp(-x ** 2 / 50)
    p = 1 / (1 + np.exp(-(0.7 * x + 1.5)))
    assert np.allclose(B.calibrated(np.stack([n * (1 - p), n * p])), (0.7, 1.5), atol=1e-2)
