"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Distinct words of a batch are laid out as one flat symbol array.  In each round every word finds the
smallest rank among its neighbouring pairs, merges at the leftmost such place (at all of them where
that comes to the same), and the array is compacted; words without a pair leave.
"""
from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from secframe.llm.common import table, text_of
from secframe.llm.storage import slices

SPACE = "▁"
NO_PAIR = np.int32(2 ** 31 - 1)
#: Characters of distinct words that are merged at a time.
ROUND_CHARS = 400_000
#: Words whose ids a worker remembers, none longer than LONG characters.
REMEMBERED, LONG = 250_000, 64
MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class PieceTables:
    """Ranks of symbol pairs and the bytes of pieces, read from a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        pieces = {}
        self.out: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        self.raw = np.zeros(n, bool)
        for i in range(n):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(p[3:5], 16)
                self.byte_ids[b], self.raw[i] = i, True
                self.out.append(bytes([b]))
            elif model.is_control(i):
                self.out.append(b"")
            elif model.is_unknown(i):
                self.out.append(" ⁇ ".encode())
            else:
                pieces[p] = i
                self.out.append(p.replace(SPACE, " ").encode())
        self.pieces = pieces
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("pieces of this model cross word ends")
        # symbols: pieces, then characters that only occur inside pieces, then all others by code point
        chars = {c for p in pieces for c in p}
        symbol = dict(pieces)
        for c in sorted(chars - pieces.keys()):
            symbol[c] = n + len(symbol) - len(pieces)
        self.known = n + len(symbol) - len(pieces)
        self.char_of = {symbol[c]: c for c in chars if c not in pieces}
        self.char_symbol = np.arange(0x110000, dtype=np.int64) + self.known
        for c in chars:
            self.char_symbol[ord(c)] = symbol[c]
        scores = {p: model.get_score(i) for p, i in pieces.items()}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        keys, merged, rank = [], [], []
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.known + b)
                    merged.append(i)
                    rank.append(ranks[scores[p]])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int32)[order]
        self.rank = np.array(rank, np.int32)[order]
        # a rank is plain if one piece has it and no pair with that piece comes before it
        made = np.full(len(ranks), -1, np.int64)
        plain = np.ones(len(ranks), bool)
        for r, i in zip(self.rank.tolist(), self.merged.tolist()):
            plain[r] &= made[r] in (-1, i)
            made[r] = i
        first = np.full(self.known, NO_PAIR, np.int64)
        for side in (self.keys // self.known, self.keys % self.known):
            np.minimum.at(first, side, self.rank)
        has = made >= 0
        plain[has] &= first[made[has]] > np.flatnonzero(has)
        self.plain = plain

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair in the tables, -1 for pairs that no piece has."""
        key = a * self.known + b
        key[(a >= self.known) | (b >= self.known)] = -1
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != key] = -1
        return at

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 16- or 32-bit integers (``id_type``)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.char_symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), sizes)
        at = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            at[:-1] = np.where(word[1:] == word[:-1], self.pairs(sym[:-1], sym[1:]), -1)
        done_word, done_sym = [], []
        while len(sym):
            rank = np.where(at >= 0, self.rank[at], NO_PAIR)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            going = np.repeat(low != NO_PAIR, lengths)
            if not going.all():
                done_word.append(word[~going])
                done_sym.append(sym[~going])
                low = np.repeat(low, lengths)[going]
                sym, word, at, rank = sym[going], word[going], at[going], rank[going]
                if not len(sym):
                    break
            else:
                low = np.repeat(low, lengths)
            here = np.flatnonzero(rank == low)
            w = word[here]
            first = np.r_[True, w[1:] != w[:-1]]
            # in a run of overlapping places every second one merges
            fresh = np.r_[True, (here[1:] != here[:-1] + 1) | (w[1:] != w[:-1])]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(here)), 0))
            even = (np.arange(len(here)) - begin) % 2 == 0
            here = here[np.where(self.plain[low[here]], even, first)]
            keep = np.ones(len(sym), bool)
            keep[here + 1] = False
            sym[here] = self.merged[at[here]]
            place = np.cumsum(keep)[here] - 1
            sym, word, at = sym[keep], word[keep], at[keep]
            for left in (place, place[place > 0] - 1):
                inner = left[left + 1 < len(sym)]
                at[left] = -1
                at[inner] = np.where(word[inner] == word[inner + 1], self.pairs(sym[inner], sym[inner + 1]), -1)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order]
        cuts = np.searchsorted(word, np.arange(len(words) + 1))
        if (sym >= self.size).any():       # characters without a piece become their bytes
            lists = [[s] if s < self.size else self.byte_ids[list(self._char(s).encode())].tolist() for s in sym.tolist()]
            grown = np.r_[0, np.cumsum([len(x) for x in lists])]
            sym, cuts = np.array([i for x in lists for i in x]), grown[cuts]
        flat = sym.astype(self.id_type)
        return [flat[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    @property
    def id_type(self) -> str:
        return "<u2" if self.size <= 1 << 16 else "<u4"

    def _char(self, s: int) -> str:
        return self.char_of[s] if s in self.char_of else chr(s - self.known)


_WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class PieceBpe:
    """Encoder and decoder with a bounded memory of words."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tables, self.remembered, self.memory = PieceTables(path), remembered, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; an empty text has none."""
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.memory) > self.remembered:
            self.memory = {}
        memory = self.memory
        new = list({w for words in split for w in words if w not in memory})
        start = chars = 0
        for i, w in enumerate(new + [""]):
            if i == len(new) or chars + len(w) > ROUND_CHARS and i > start:
                if i > start:
                    memory.update(zip(new[start:i], self.tables.merge_words(new[start:i])))
                start, chars = i, 0
            chars += len(w)
        kind = self.tables.id_type
        out = [np.frombuffer(b"".join([memory[w] for w in words]), kind) for words in split]
        for w in new:
            if len(w) > LONG:
                del memory[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: the first piece loses one leading space, bytes that are no UTF-8 become U+FFFD."""
        out = self.tables.out
        parts = [out[i] for i in ids.tolist()]
        if parts and parts[0][:1] == b" " and not self.tables.raw[ids[0]]:
            parts[0] = parts[0][1:]
        data = b"".join(parts)
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _lenient(data)


def _lenient(data: bytes) -> str:
    """Every byte that starts no whole character stands for one U+FFFD."""
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i:i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def coder(path: str) -> PieceBpe:
    """One per worker process."""
    return PieceBpe(path)


def _ids_array(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def round_trip(docs: DataFrame, carry: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``carry`` columns, ``ids`` (array of int) and ``decoded`` of every row.

    A null text counts as empty and has no ids; repeated rows are coded each; a carried column
    named ids or decoded gives way.  An empty table gives an empty result.
    """
    path = path or model_path()
    carry = [c for c in carry if c not in ("ids", "decoded")]
    base = docs.select(text_of(text).alias("__text"), *[F.col(f"`{c}`") for c in carry])

    def run(batches):
        bpe = coder(path)
        for batch in slices(batches, 0):
            ids = bpe.encode(batch.column(0).to_pylist())
            back = pa.array([bpe.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], _ids_array(ids), back], [*carry, "ids", "decoded"])

    schema = base.select(*[F.col(f"`{c}`") for c in carry], F.array(F.lit(0)).alias("ids"), F.lit("").alias("decoded")).schema
    return base.mapInArrow(run, schema)


def digests(coded: DataFrame, carry: list[str]) -> DataFrame:
    return coded.select(*carry, F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_sentencepiece(spark, sf_dir):
    return digests(round_trip(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def stage_pieces(spark, docs, sf_dir):
    """Last pipeline stage: the ids of every kept document, checked by decoding them."""
    coded = round_trip(docs, ["doc_id", "lang", "source", "text"])
    same = F.col("decoded") == F.translate(text_of(), SPACE, " ")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"))
