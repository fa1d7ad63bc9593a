"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of two rows picked by two hashes.  Rows start from how much more often
toxic texts of the sample have the word, shrunk for rare words; rows that the sample never uses are
zero, so that words not seen in training add nothing.  Filters of several widths run over the words of the whole
text, their largest outputs feed a logistic unit.  Scoring folds embeddings and filters into one
table of fixed size.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from secframe.llm.common import Scratch, table, text_of
from secframe.llm.hashing import U64, WordHashes
from secframe.llm.storage import slices

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
#: The training sample: labelled rows of each class, and words of a row that may be in it.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WORDS = 2500, 5000, 20_000
EPOCHS, BATCH, RATE, WORD_DROP, L2, PRIOR = 12, 32, 0.02, 0.0, 1e-3, 4.0
SLICE_BYTES = 300_000
#: Bins of logits, from which cuts are found, per unit.
PER_UNIT = 32
PAD = 2 * BUCKETS

_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def word_buckets(text: str, words: WordHashes) -> np.ndarray:
    """(words, 2) rows in the embedding table; ASCII letters, digits and all other characters make words."""
    h = words.of(text.encode().translate(_KEEP).split())
    return np.stack([(h % U64(BUCKETS)).astype(np.int32), (h >> U64(40)).astype(np.int32) % BUCKETS + BUCKETS], axis=1)


class Network:
    """Parameters, training by Adam, and the folded table for scoring."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rng = rng
        n = FILTERS * len(WIDTHS)
        self.p = {"e": np.zeros((2 * BUCKETS + 1, DIM), np.float32), "b": np.full(n, 0.1, np.float32),
                  "v": rng.normal(0, 0.5, n).astype(np.float32), "c": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32)

    def start(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """First embeddings: the shrunk log odds of each used row, and a little noise."""
        toxic, seen = np.zeros(2 * BUCKETS + 1), np.zeros(2 * BUCKETS + 1)
        for d, label in zip(docs, y):
            rows = np.unique(d)
            seen[rows] += 1
            toxic[rows] += label
        used, share = np.flatnonzero(seen), y.mean()
        odds = np.log((toxic + PRIOR * share) / share) - np.log((seen - toxic + PRIOR * (1 - share)) / (1 - share))
        e = self.p["e"]
        e[used] = self.rng.normal(0, 0.02, (len(used), DIM)).astype(np.float32)
        e[used, 0] += (0.2 * odds[used]).astype(np.float32)

    def _adam(self, grads: dict, t: int, state: dict) -> None:
        for k, g in grads.items():
            if k == "e":
                rows, g = g
                m, v = state.setdefault(k, (np.zeros_like(self.p[k]), np.zeros_like(self.p[k])))
                m[rows] = 0.9 * m[rows] + 0.1 * g
                v[rows] = 0.999 * v[rows] + 0.001 * g * g
                step = m[rows] / (1 - 0.9 ** t) / (np.sqrt(v[rows] / (1 - 0.999 ** t)) + 1e-6)
                self.p[k][rows] -= RATE * (step + L2 * self.p[k][rows])
            else:
                m, v = state.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.999 * v + 0.001 * g * g
                self.p[k] -= RATE * (m / (1 - 0.9 ** t) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-6))

    def _batch(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the weighted log loss over a batch."""
        pad = np.full((max(WIDTHS), 2), PAD, np.int32)
        flat = np.concatenate([x for d in docs for x in (d, pad)])
        sizes = np.array([len(d) + len(pad) for d in docs])
        begin = np.cumsum(sizes) - sizes
        count = np.maximum(1, sizes - len(pad))
        x = self.p["e"][flat[:, 0]] + self.p["e"][flat[:, 1]]
        best, at = [], []
        for w in WIDTHS:
            z = x[:len(x) - w + 1] @ self.p[f"w{w}"][0]
            for j in range(1, w):
                z = z + x[j:len(x) - w + 1 + j] @ self.p[f"w{w}"][j]
            top = np.stack([z[a:a + n].argmax(0) + a for a, n in zip(begin, count)])
            at.append(top)
            best.append(np.take_along_axis(z, top, 0))
        u = np.concatenate(best, 1) + self.p["b"]
        h = np.maximum(u, 0)
        s = 1 / (1 + np.exp(-(h @ self.p["v"] + self.p["c"])))
        d = ((s - y) * weight / len(docs)).astype(np.float32)
        du = d[:, None] * self.p["v"] * (u > 0)
        grads = {"v": h.T @ d, "c": np.array([d.sum()], np.float32), "b": du.sum(0)}
        rows, parts = [], []
        for i, w in enumerate(WIDTHS):
            g = du[:, i * FILTERS:(i + 1) * FILTERS]
            gw = np.zeros_like(self.p[f"w{w}"])
            for j in range(w):
                place = at[i] + j
                gw[j] = np.einsum("nfd,nf->df", x[place], g)
                part = (g[:, :, None] * self.p[f"w{w}"][j].T[None]).reshape(-1, DIM)
                for side in (0, 1):
                    rows.append(flat[place.reshape(-1), side])
                    parts.append(part)
            grads[f"w{w}"] = gw
        rows, parts = np.concatenate(rows), np.concatenate(parts)
        live = (rows != PAD) & (parts != 0).any(1)
        unique, where = np.unique(rows[live], return_inverse=True)
        summed = np.zeros((len(unique), DIM), np.float32)
        np.add.at(summed, where, parts[live])
        grads["e"] = (unique, summed)
        return grads

    def train(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> "Network":
        weight = np.where(y == 1, np.sqrt(max(1, (y == 0).sum()) / max(1, (y == 1).sum())), 1.0)
        self.start(docs, y)
        state, t = {}, 0
        for _ in range(epochs):
            order = self.rng.permutation(len(docs))
            for i in range(0, len(order), BATCH):
                pick, t = order[i:i + BATCH], t + 1
                kept = [d[self.rng.random(len(d)) >= WORD_DROP] for d in (docs[k] for k in pick)]
                self._adam(self._batch(kept, y[pick].astype(np.float32), weight[pick]), t, state)
        return self

    def folded(self) -> dict:
        """What scoring needs: a row of filter outputs per bucket and filter place."""
        cols = [self.p["e"] @ self.p[f"w{w}"][j] for w in WIDTHS for j in range(w)]
        return {"rows": np.concatenate(cols, 1).astype(np.float32), "b": self.p["b"], "v": self.p["v"],
                "c": float(self.p["c"][0])}


def logits(model: dict, docs: list[np.ndarray]) -> np.ndarray:
    """Log odds, within 60; a text without words is scored by the filters' output on nothing."""
    pad = np.full((max(WIDTHS), 2), PAD, np.int32)
    flat = np.concatenate([x for d in docs for x in (d, pad)])
    sizes = np.array([len(d) + len(pad) for d in docs])
    begin = np.cumsum(sizes) - sizes
    ends = begin + np.maximum(1, sizes - len(pad))
    a = model["rows"][flat[:, 0]] + model["rows"][flat[:, 1]]
    cuts = np.stack([begin, ends], 1).reshape(-1)
    best, col = [], 0
    for w in WIDTHS:
        n = len(flat)
        z = np.zeros((n, FILTERS), np.float32)
        for j in range(w):
            z[:n - j] += a[j:, col:col + FILTERS]
            col += FILTERS
        best.append(np.maximum.reduceat(z, cuts)[::2])
    h = np.maximum(np.concatenate(best, 1) + model["b"], 0)
    return np.clip(h @ model["v"] + model["c"], -60, 60).astype(np.float64)


def is_held_out(id: Column) -> Column:
    """Every fifth row by the checksum of its id as text, a null id as the empty text; never learned from."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sets_cuts(id: Column) -> Column:
    """Every fourth row by a hash of its id; at every size such rows set the cuts and train nothing."""
    return F.pmod(F.xxhash64(F.lit(PER_UNIT), id.cast("string")), F.lit(4)) == 0


def known_labels(labels: DataFrame, id: str) -> DataFrame:
    """(id, toxic) outside the held-out rows; of several labels of one id the largest counts."""
    known = labels.filter(F.col(id).isNotNull() & F.col("toxic").isNotNull()).groupBy(id).agg(F.max("toxic").alias("toxic"))
    return known.filter(~is_held_out(F.col(id)))


def training_sample(docs: DataFrame, labels: DataFrame, id: str, text: str) -> list:
    """Rows (id, toxic, buckets) of a bounded sample of labelled documents, in the order of a hash of their ids."""
    known = known_labels(labels, id).filter(~sets_cuts(F.col(id)))
    order = F.xxhash64(F.col(id).cast("string"))
    some = lambda t, n: known.filter(F.col("toxic") == t).orderBy(order, id).limit(n)
    picked = some(1, SAMPLE_TOXIC).unionByName(some(0, SAMPLE_CLEAN))
    rows = docs.select(F.col(id).alias("__id"), text_of(text).alias("__text")).join(
        picked, F.col("__id") == F.col(id)).select("__id", "toxic", "__text")

    def hashed(batches, words=WordHashes()):
        for batch in slices(batches, 2):
            got = [word_buckets(t, words) for t in batch.column(2).to_pylist()]
            keep = [i for i, b in enumerate(got) if len(b) <= SAMPLE_WORDS]
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(2)), pa.array([got[i].tobytes() for i in keep], pa.binary())],
                ["id", "toxic", "buckets"])

    kept = rows.mapInArrow(hashed, "id bigint, toxic int, buckets binary").collect()
    return sorted(kept, key=lambda r: (r.id, r.buckets))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> dict:
    """Model for ``logits``; of a constant score where labels are of one class or none."""
    rows = training_sample(docs, labels, id, text)
    y = np.array([r.toxic for r in rows], np.int64)
    net = Network()
    if not (0 < y.sum() < len(y)):
        net.p["c"][:] = 5.0 if len(y) and y.all() else -5.0
    else:
        net.train([np.frombuffer(r.buckets, np.int32).reshape(-1, 2) for r in rows], y)
    return net.folded()


def histogram(raw: DataFrame, labels: DataFrame, id: str) -> DataFrame:
    """(lang, bin, n, toxic) of logits over all rows that set cuts."""
    known = known_labels(labels, id).filter(sets_cuts(F.col(id))).select(F.col(id).cast("bigint").alias("doc_id"), "toxic")
    bin = F.floor(F.col("logit") * PER_UNIT).cast("int").alias("bin")
    return raw.join(known, "doc_id").groupBy("lang", bin).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") > 0).cast("bigint")).alias("toxic"))


def best_cuts(bins: DataFrame) -> DataFrame:
    """(lang, cut): the logit that splits a language's rows best by F1, midway to the next lower bin in use.

    Of equally good cuts the highest counts; a language without rows of both classes has none.
    """
    all = Window.partitionBy("lang")
    order = all.orderBy(F.desc("bin"))
    down = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = bins.select(
        "lang", "bin", F.lead("bin").over(order).alias("below"), F.sum("toxic").over(down).alias("hits"), F.sum("n").over(down).alias("taken"),
        F.sum("toxic").over(all).alias("toxic"), F.sum("n").over(all).alias("n")).filter("toxic > 0 AND toxic < n")
    f1 = 2 * F.col("hits") / (F.col("taken") + F.col("toxic"))
    cut = (F.col("bin") + F.coalesce(F.col("below") + 1, F.col("bin"))) / (2.0 * PER_UNIT)
    return rows.groupBy("lang").agg(F.max_by(cut, F.struct(f1, "bin")).alias("cut"))


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted, threshold, flagged.

    Scores are moved so that the cut with the best F1 over all rows of ``sets_cuts`` lies at 0.5;
    ``predicted`` is score >= 0.5.  ``threshold`` is the best cut of the row's language, 0.5 for a
    language without rows of both classes, and ``flagged`` is score >= threshold.  The language is no
    input of a score.  A null text counts as empty and is scored, a null language as the empty one,
    repeated rows are scored each, a null id is kept, further columns are ignored.  With labels of one
    class or none the score is a constant; an empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    shared = spark.sparkContext.broadcast(fit(docs, labels, id, text))     # a table of fixed size
    base = docs.select(F.col(id).cast("bigint").alias("doc_id"), text_of(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"))

    def score(batches, words=WordHashes()):
        for batch in slices(batches, 1, SLICE_BYTES):
            x = logits(shared.value, [word_buckets(t, words) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x)], ["doc_id", "lang", "logit"])

    # texts are scored once; cuts and result only see their logits
    raw = scratch.keep(base.mapInArrow(score, "doc_id bigint, lang string, logit double"), "logits")
    bins = scratch.keep(histogram(raw, labels, id), "bins")
    every = bins.groupBy(F.lit("").alias("lang"), "bin").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    cut = next((r.cut for r in best_cuts(every).collect()), 0.0)
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    out = raw.join(best_cuts(bins), "lang", "left").select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), sigmoid(F.col("logit") - cut).alias("score"),
        sigmoid(F.coalesce(F.col("cut"), F.lit(cut)) - cut).alias("threshold"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def op5_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
