"""Quality of documents: a convolutional network over bytes, trained in numpy.

A text is cut into overlapping chunks that cover all of it.  Learned filters over byte embeddings run
over every chunk, each keeps its largest output there; over the chunks of the document these maxima
are averaged and maximised again, and a logistic unit turns both into one probability.  Scoring folds
embeddings and filters into tables of byte pairs of fixed size.

Fitting uses a bounded sample of labelled rows.  The probabilities are calibrated on all labelled rows
outside the sample (and outside the held-out ones), by a histogram of their scores, so they do not
depend on the size of the sample or the table.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from secframe.llm.common import Scratch, table, text_of
from secframe.llm.storage import slices

DIM, FILTERS, WIDTH = 8, 16, 8
CHUNK, STEP = 512, 448
#: The training sample: rows of each class, and bytes of a row that may be in it.
SAMPLE_BAD, SAMPLE_GOOD, SAMPLE_BYTES = 1500, 2500, 30_000
EPOCHS, BATCH, RATE, L2 = 8, 16, 0.01, 1e-4
#: Scores from here on count as good quality.
CUT = 0.7
#: Bins of a score's logit, a tenth wide, over which scores are calibrated.
BINS, PER_UNIT = 401, 10
SLICE_BYTES, RUN = 500_000, 1 << 20
PAD = 256
_TAIL = np.full(WIDTH, PAD, np.int32)


def chunk_starts(size: int) -> np.ndarray:
    """Begins of chunks of ``CHUNK`` bytes, each overlapping the one before; the last reaches the end."""
    return np.arange(0, max(1, size - (CHUNK - STEP)), STEP)


class Network:
    def __init__(self, seed: int = 5):
        rng = self.rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.5, (257, DIM)).astype(np.float32), "w": rng.normal(0, 0.25, (WIDTH, DIM, FILTERS)).astype(np.float32),
                  "b": np.full(FILTERS, 0.1, np.float32), "v": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32)}
        self.p["e"][PAD] = 0

    def _batch(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the weighted log loss; only the places of the maxima carry them."""
        flat = np.concatenate([x for d in docs for x in (d, _TAIL)])
        base = np.cumsum([0, *[len(d) + len(_TAIL) for d in docs]])
        starts = [chunk_starts(len(d)) + b for d, b in zip(docs, base)]
        ends = [np.minimum(s + CHUNK, b + max(1, len(d))) for s, d, b in zip(starts, docs, base)]
        x = self.p["e"][flat]
        n = len(flat) - WIDTH + 1
        z = sum(x[j:n + j] @ self.p["w"][j] for j in range(WIDTH))
        at = np.stack([z[a:b].argmax(0) + a for s, e in zip(starts, ends) for a, b in zip(s, e)])
        u = np.take_along_axis(z, at, 0) + self.p["b"]
        h = np.maximum(u, 0)
        chunks = np.array([len(s) for s in starts])
        first = np.cumsum(chunks) - chunks
        owner = np.repeat(np.arange(len(docs)), chunks)
        mean = np.add.reduceat(h, first) / chunks[:, None]
        top = np.stack([h[a:a + k].argmax(0) + a for a, k in zip(first, chunks)])
        best = np.take_along_axis(h, top, 0)
        f = np.concatenate([mean, best], 1)
        s = 1 / (1 + np.exp(-np.clip(f @ self.p["v"] + self.p["c"], -30, 30)))
        d = ((s - y) * weight / len(docs)).astype(np.float32)
        grads = {"v": f.T @ d, "c": np.array([d.sum()], np.float32)}
        du = (d[:, None] * self.p["v"][:FILTERS] / chunks[:, None])[owner]
        np.add.at(du, (top, np.arange(FILTERS)[None]), d[:, None] * self.p["v"][FILTERS:])
        du = (du * (u > 0)).astype(np.float32)
        grads["b"] = du.sum(0)
        gw, ge = np.zeros_like(self.p["w"]), np.zeros((257, DIM), np.float32)
        for j in range(WIDTH):
            place = at + j
            gw[j] = np.einsum("nfd,nf->df", x[place], du)
            np.add.at(ge, flat[place].reshape(-1), (du[:, :, None] * self.p["w"][j].T[None]).reshape(-1, DIM))
        ge[PAD] = 0
        return grads | {"w": gw, "e": ge}

    def train(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> "Network":
        """Adam over mini-batches; both classes weigh the same."""
        share = y.mean()
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        moments, t = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}, 0
        steps = epochs * -(-len(docs) // BATCH)
        for _ in range(epochs):
            order = self.rng.permutation(len(docs))
            for i in range(0, len(order), BATCH):
                pick, t = order[i:i + BATCH], t + 1
                rate = RATE * (1 - 0.9 * t / steps)
                for k, g in self._batch([docs[q] for q in pick], y[pick].astype(np.float32), weight[pick]).items():
                    m, v = moments[k]
                    g = g + L2 * self.p[k]
                    m[:] = 0.9 * m + 0.1 * g
                    v[:] = 0.999 * v + 0.001 * g * g
                    self.p[k] -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-6)
                self.p["e"][PAD] = 0
        return self

    def folded(self) -> dict:
        """Tables of filter outputs for every pair of bytes at every second place of the filters."""
        per = np.einsum("bd,jdf->jbf", self.p["e"], self.p["w"])
        pairs = [(per[j][:, None] + per[j + 1][None]).reshape(-1, FILTERS).astype(np.float32) for j in range(0, WIDTH, 2)]
        return {"pairs": pairs, "b": self.p["b"], "v": self.p["v"].astype(np.float64), "c": float(self.p["c"][0])}


def logits(model: dict, texts: list[bytes]) -> np.ndarray:
    """Log odds of whole texts; long ones are taken through in runs, so memory does not grow with them."""
    out = np.zeros(len(texts))
    group, size = [], 0
    for i, t in enumerate(texts):
        if len(t) > RUN:
            out[i] = _logit(model, *_long(model, t))
            continue
        group.append(i)
        size += len(t)
        if size > RUN or i == len(texts) - 1:
            out[group] = _some(model, [texts[k] for k in group])
            group, size = [], 0
    if group:
        out[group] = _some(model, [texts[k] for k in group])
    return out


def _logit(model, mean, best) -> np.ndarray:
    return np.concatenate([mean, best], -1) @ model["v"] + model["c"]


def _chunks(model: dict, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Pooled filter outputs of chunks of a byte array that ends with padding."""
    n = len(flat) - WIDTH + 1
    pair = flat[:-1] * 257 + flat[1:]
    z = model["pairs"][0][pair[:n]]
    for j, rows in enumerate(model["pairs"][1:], 1):
        z += rows[pair[2 * j:2 * j + n]]
    # chunks overlap, so maxima are taken over the pieces between all borders and then over a chunk's pieces
    borders = np.unique(np.concatenate([starts, ends]))
    pieces = np.maximum.reduceat(z, borders[borders < n], axis=0)
    a, b = np.searchsorted(borders, starts), np.searchsorted(borders, ends)
    return np.maximum(np.maximum.reduceat(np.concatenate([pieces, pieces[-1:]]), np.stack([a, b], 1).reshape(-1), axis=0)[::2] + model["b"], 0)


def _some(model: dict, texts: list[bytes]) -> np.ndarray:
    parts = [np.frombuffer(t, np.uint8).astype(np.int32) for t in texts]
    flat = np.concatenate([x for p in parts for x in (p, _TAIL)])
    base = np.cumsum([0, *[len(p) + len(_TAIL) for p in parts]])
    starts = [chunk_starts(len(p)) + b for p, b in zip(parts, base)]
    ends = [np.minimum(s + CHUNK, b + max(1, len(p))) for s, p, b in zip(starts, parts, base)]
    h = _chunks(model, flat, np.concatenate(starts), np.concatenate(ends))
    counts = np.array([len(s) for s in starts])
    first = np.cumsum(counts) - counts
    return _logit(model, np.add.reduceat(h, first, axis=0, dtype=np.float64) / counts[:, None], np.maximum.reduceat(h, first, axis=0))


def _long(model: dict, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(mean, maximum) of a long text's chunks, some chunks at a time."""
    data, starts = np.frombuffer(text, np.uint8), chunk_starts(len(text))
    total, best = np.zeros(FILTERS), np.zeros(FILTERS)
    step = RUN // STEP
    for i in range(0, len(starts), step):
        own = starts[i:i + step]
        end = min(len(data), own[-1] + CHUNK)
        part = np.concatenate([data[own[0]:min(len(data), end + WIDTH - 1)].astype(np.int32), _TAIL])
        h = _chunks(model, part, own - own[0], np.minimum(own + CHUNK, end) - own[0])
        total += h.sum(0, dtype=np.float64)
        best = np.maximum(best, h.max(0))
    return total / len(starts), best


def is_held_out(id: Column) -> Column:
    """Rows whose id's checksum is 2 modulo 4; never learned from.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _known(labels: DataFrame, id: str) -> DataFrame:
    known = labels.filter(F.col(id).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id).alias("__known")).agg(F.min("quality").alias("quality"))
    return known.filter(~is_held_out(F.col("__known")))


def _sample(docs: DataFrame, known: DataFrame, id: str, text: str) -> list:
    """(id, quality, text) of the bounded training sample, in a fixed order."""
    order = F.xxhash64(F.col("__known").cast("string"))
    some = lambda q, n: known.filter(F.col("quality") == q).orderBy(order, "__known").limit(n)
    picked = F.broadcast(some(0, SAMPLE_BAD).unionByName(some(1, SAMPLE_GOOD)))        # rows by parameter
    base = docs.select(F.col(id).alias("__id"), text_of(text).cast("binary").alias("__text"))
    rows = base.join(picked, F.col("__id") == F.col("__known")).filter(F.octet_length("__text") <= SAMPLE_BYTES)
    return sorted(rows.select("__id", "quality", "__text").collect(), key=lambda r: (r[0], bytes(r[2])))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[dict, list]:
    """(model for ``logits``, ids of the training sample); of a constant score where labels are of one class or none."""
    rows = _sample(docs, _known(labels, id), id, text)
    y = np.array([r.quality for r in rows], np.int64)
    net = Network()
    if not (0 < y.sum() < len(y)):
        net.p["v"][:] = 0
        net.p["c"][:] = -5.0 if len(y) and not y.any() else 5.0
        return net.folded(), []
    net.train([np.frombuffer(bytes(r[2]), np.uint8).astype(np.int32) for r in rows], y)
    return net.folded(), sorted({r[0] for r in rows})


def _calibration(raw: DataFrame, labels: DataFrame, id: str, taken: list) -> tuple[float, float]:
    """(scale, shift) from all labelled rows outside the sample; from the sample where a class is missing there."""
    if not taken:
        return 1.0, 0.0
    bins = F.least(F.greatest(F.floor(F.col("logit") * PER_UNIT) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).alias("bin")
    used = F.broadcast(raw.sparkSession.createDataFrame([(i,) for i in taken], "taken bigint"))
    rows = raw.join(_known(labels, id).select(F.col("__known").cast("bigint").alias("doc_id"), "quality"), "doc_id").join(
        used, F.col("doc_id") == F.col("taken"), "left")
    counts = np.zeros((2, 2, BINS))
    for r in rows.groupBy(F.col("taken").isNotNull().alias("seen"), (F.col("quality") > 0).alias("good"), bins).count().collect():
        counts[int(r.seen), int(r.good), r.bin] = r["count"]
    return calibrated(counts[0] if counts[0].sum(1).all() else counts[1])


def calibrated(counts: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(scale, shift) of logits that make them the log odds of good quality: logistic regression on (label, bin) counts."""
    x = (np.arange(BINS) + 0.5 - BINS // 2) / PER_UNIT
    n, good = counts.sum(0), counts[1]
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        g = np.array([((good - n * p) * x).sum() - 1e-2 * (a - 1), (good - n * p).sum()])
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
    return float(max(a, 1e-3)), float(b)


def quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, score (probability of good quality), predicted (score >= 0.7).

    A null text counts as empty; empty texts are scored by the network's output on nothing.  Repeated
    rows are scored each, a null id is kept.  Of several labels of one id the smallest counts.  With
    labels of one class or none the score is a constant.  Further columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "byte_quality")
    model, taken = fit(docs, labels, id, text)
    shared = spark.sparkContext.broadcast(model)                # tables of fixed size
    base = docs.select(F.col(id).cast("bigint").alias("doc_id"), text_of(text).cast("binary").alias("text"))

    def score(batches):
        for batch in slices(batches, 1, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logits(shared.value, batch.column(1).to_pylist()))], ["doc_id", "logit"])

    # texts are read once; calibration and result only see their scores
    raw = scratch.keep(base.mapInArrow(score, "doc_id bigint, logit double"), "logits")
    scale, shift = _calibration(raw, labels, id, taken)
    odds = F.greatest(F.least(F.col("logit") * scale + shift, F.lit(60.0)), F.lit(-60.0))
    return raw.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-odds))).alias("score")).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int"))


def op13_quality_bytes(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
