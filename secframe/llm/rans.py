"""Token ids as range-coded files: static asymmetric numeral systems with interleaved lanes.

One frequency table serves all files.  A block holds whole documents and decodes on its own: its
header has the state of every lane at its start (the checkpoint to enter from), its words, and a
checksum.  The index of blocks lets every task decode its own ones.
"""
from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from secframe.llm.common import Scratch, spark_partitions, table, text_of
from secframe.llm.storage import PartFile, open_store, slices

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Frequencies add up to 2 ** SCALE; states lie in [2 ** 31, 2 ** 63) and move 32 bits at a time.
SCALE, LANES = 20, 1024
BLOCK_TOKENS, FILE_BYTES = 131_072, 256 << 20
#: Pieces a worker remembers, none longer than LONG bytes.
REMEMBERED, LONG = 600_000, 64
_U = np.uint64
_HEAD = struct.Struct("<4sIQIQI")     # mark, documents, tokens, lanes, words, crc32 of the rest
_BLOCK = b"rANB"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


# ---------------------------------------------------------------- tokens

#: Bytes looked at, pieces put together, and words in one text for the library, at a time.
LOOK, GATHER, TOGETHER = 1 << 22, 1 << 18, 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Marks before which a letter always ends a pre-token.
_MARK = np.zeros(256, bool)
_MARK[list(b".,!?;:&$%#*")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
#: What may follow a joint: no white space, and no byte that begins some wide white space.
_SOLID = ~_SPACE
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def joints(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 where pre-tokens of this vocabulary always part.

    A single space or line end between characters that are surely no white space begins a piece, such a
    line end is a piece of its own, and a mark after a Latin letter begins one.
    """
    out = []
    for lo in range(0, len(data), LOOK):
        n = min(LOOK, len(data) - lo)
        b = np.zeros(n + 5, np.uint8)                          # four bytes before, one after
        b[:4], b[-1] = 32, 32
        some = data[max(0, lo - 4):lo + n + 1]
        at = 4 - min(lo, 4)
        b[at:at + len(some)] = some
        here, one, two = b[4:-1], b[3:-2], b[2:-3]
        plain = one < 0x80
        wide = ~plain & ((two >= 0xC3) & (two < 0xE0) | (b[1:-4] >= 0xE4) & (b[1:-4] < 0xF0) | (b[:-5] >= 0xF0))
        alone = ((here == 32) | (here == 10)) & (plain & ~_SPACE[one] | wide) & _SOLID[b[5:]]
        latin = (two == 0xC3) & ~plain & (one != 0x97) & (one != 0xB7)
        out.append(lo + np.flatnonzero(alone | _MARK[here] & (_LETTER[one] | latin)))
        out.append(lo + np.flatnonzero(alone & (here == 10)) + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Encoder:
    """Ids of texts by way of their pieces between joints; the library encodes each distinct piece once."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library, self.remembered, self.pieces = Tokenizer.from_file(path), remembered, {}
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.line = self.library.encode("\n", add_special_tokens=False).ids[0]

    def _learn(self, pieces: list[bytes]) -> None:
        """Remembers ids of new pieces.

        Words of letters alone go to the library many in one text, each with a line end after it, which
        always is a pre-token of its own there.
        """
        texts = [x.decode() for x in pieces]
        plain = [t[t[:1] == " ":].isalpha() for t in texts]
        words, rest = list(compress(pieces, plain)), [i for i, p in enumerate(plain) if not p]
        call = lambda some: [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
        together = [t + "\n" for t in compress(texts, plain)]
        ids = call(["".join(together[i:i + TOGETHER]) for i in range(0, len(together), TOGETHER)])
        ids = np.fromiter(chain.from_iterable(ids), self.kind)
        ends = np.flatnonzero(ids == self.line)
        if len(ends) != len(words):
            raise ValueError("a line end is no token of its own in this vocabulary")
        data, ends = ids.tobytes(), ends * self.width
        starts = np.r_[0, ends[:-1] + self.width]
        self.pieces.update((x, data[i:j]) for x, i, j in zip(words, starts.tolist(), ends.tolist()))
        for i, got in zip(rest, call([texts[i] for i in rest])):
            self.pieces[pieces[i]] = np.array(got, self.kind).tobytes()

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.pieces) > self.remembered:
            self.pieces = {}
        known = self.pieces
        new = [x for x in pieces if x not in known]
        if new:
            self._learn(new)
        out = [known[x] for x in pieces]
        for x in new:
            if len(x) > LONG:
                del known[x]
        return out

    def encode(self, texts: pa.StringArray) -> pa.BinaryArray:
        """Little-endian ids of each text with the end id."""
        if not len(texts):
            return pa.array([], pa.binary())
        texts = pa.concat_arrays([texts.cast(pa.binary()), pa.array([b""], pa.binary())])     # an own buffer
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts)]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[:ends[-1]]
        cuts = np.sort(np.concatenate([joints(data[ends[0]:]) + ends[0], ends]).astype(np.int32))
        cuts = cuts[np.r_[True, cuts[1:] != cuts[:-1]]]
        flat, sizes = [], [np.zeros(0, np.int64)]
        if len(cuts) > 1:
            pieces = pa.BinaryArray.from_buffers(
                pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
            ids = self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
            begin, store = np.cumsum(size) - size, np.frombuffer(b"".join(ids), self.kind)
            codes = pieces.indices.to_numpy()
            for i in range(0, len(codes), GATHER):
                c = codes[i:i + GATHER]
                n = size[c]
                stop = np.cumsum(n)
                flat.append(store[np.repeat(begin[c] - stop + n, n) + np.arange(stop[-1])])
                sizes.append(n)
        before = np.r_[0, np.cumsum(np.concatenate(sizes))][np.searchsorted(cuts, ends)]      # tokens before each text
        flat = np.concatenate(flat or [np.zeros(0, self.kind)])
        flat = np.insert(flat, before[1:], np.array(END_ID, self.kind))
        offsets = ((before + np.arange(len(before))) * self.width).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(shard, place, doc_id, ids) in ascending order of ids: shards, and places in a shard."""
    path = path or vocabulary_path()
    base = docs.select(F.col(id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    base = base.repartitionByRange(spark_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        coder, shard, place = encoder(path), TaskContext.get().partitionId(), 0
        for batch in slices(batches, 1, LOOK):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()),
                 batch.column(0), coder.encode(batch.column(1))],
                ["shard", "place", "doc_id", "ids"])
            place += n

    return base.mapInArrow(run, "shard int, place bigint, doc_id bigint, ids binary")


# ---------------------------------------------------------------- coding

class Table:
    """Frequencies of symbols, summing to 2 ** SCALE, and what coding needs of them."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.freq = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, _U)
        self.freq[symbols] = freqs
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(_U)

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> "Table":
        """Every counted symbol gets at least 1; the largest ones take up the rounding."""
        total = 1 << SCALE
        if len(symbols) > total:
            raise ValueError(f"{len(symbols)} symbols need a larger scale than {SCALE}")
        freqs = np.maximum(1, (counts.astype(np.float64) * (total / max(1, counts.sum()))).astype(np.int64))
        over = int(freqs.sum()) - total
        for i in np.argsort(-freqs, kind="stable"):
            if over <= 0:
                break
            cut = min(over, int(freqs[i]) - 1)
            freqs[i] -= cut
            over -= cut
        if len(freqs) and over < 0:
            freqs[np.argmax(freqs)] -= over
        return cls(symbols, freqs)

    @property
    def symbol_at(self) -> np.ndarray:
        if not hasattr(self, "_at"):
            self._at = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        return self._at

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
        """(lane states, 32-bit words): symbol i belongs to lane i modulo lanes; coded from the end."""
        lanes = max(1, min(lanes, len(ids)))
        x = np.full(lanes, 1 << 31, _U)
        words = []
        for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes) if len(ids) else ():
            s = ids[at:at + lanes]
            n = len(s)
            f, y = self.freq[s], x[:n]
            # full frequency 2**SCALE reaches 2**63, still inside 64 bits
            out = y >= f << _U(63 - SCALE)
            words.append((y[out] & _U(0xFFFFFFFF)).astype("<u4"))
            y = np.where(out, y >> _U(32), y)
            q = y // f
            x[:n] = (q << _U(SCALE)) + (y - q * f) + self.start[s]
        return x, np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")

    def decode(self, states: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        lanes, x, at = len(states), states.copy(), 0
        out = np.empty(n, np.int32)
        symbol, wide = self.symbol_at, words.astype(_U)
        for i in range(0, n, lanes):
            m = min(lanes, n - i)
            y = x[:m]
            slot = y & _U((1 << SCALE) - 1)
            s = symbol[slot.astype(np.int64)]
            out[i:i + m] = s
            y = self.freq[s] * (y >> _U(SCALE)) + slot - self.start[s]
            low = np.flatnonzero(y < _U(1 << 31))
            y[low] = (y[low] << _U(32)) | wide[at:at + len(low)]
            at += len(low)
            x[:m] = y
        if at != len(words) or (x != _U(1 << 31)).any():
            raise ValueError("block does not decode to its start state")
        return out


def block_bytes(table: Table, doc_ids: list, ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids)
    states, words = table.encode(flat)
    named = np.array([d is not None for d in doc_ids], np.uint8)
    body = b"".join([named.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                     np.array([len(x) for x in ids], "<i8").tobytes(), states.astype("<u8").tobytes(), words.tobytes()])
    return _HEAD.pack(_BLOCK, len(ids), len(flat), len(states), len(words), zlib.crc32(body)) + body


def read_block(table: Table, data: bytes) -> tuple[list, list[np.ndarray]]:
    """(document ids, token ids of each); raises if the checksum or the decoding is off."""
    mark, docs, tokens, lanes, n, crc = _HEAD.unpack_from(data)
    body = memoryview(data)[_HEAD.size:]
    if mark != _BLOCK or zlib.crc32(body) != crc or len(body) != docs * 17 + lanes * 8 + n * 4:
        raise ValueError("damaged block")
    named = np.frombuffer(body, np.uint8, docs)
    names = np.frombuffer(body, "<i8", docs, docs)
    sizes = np.frombuffer(body, "<i8", docs, docs * 9)
    states = np.frombuffer(body, "<u8", lanes, docs * 17).astype(_U)
    words = np.frombuffer(body, "<u4", n, docs * 17 + lanes * 8)
    flat = table.decode(states, words, tokens)
    return [int(d) if k else None for d, k in zip(names, named)], np.split(flat, np.cumsum(sizes)[:-1])


# ---------------------------------------------------------------- files

def token_counts(tokens: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, counts) over all ids; as long as the vocabulary at most."""
    def count(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for data in batch.column(0):
                got = np.bincount(np.frombuffer(data.as_buffer(), kind))
                if len(got) > len(total):
                    got[:len(total)] += total
                    total = got
                else:
                    total[:len(got)] += got
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["symbol", "n"])

    rows = tokens.select("ids").mapInArrow(count, "symbol int, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))
    rows = rows.orderBy("symbol").collect()
    return np.array([r.symbol for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def write_files(tokens: DataFrame, folder: str, table: Table, kind: str) -> DataFrame:
    """Writes blocks of ``tokens`` in their order; (path, at, bytes, shard, place, docs, tokens) per block."""
    columns = pa.schema([("path", pa.string()), ("at", pa.int64()), ("bytes", pa.int64()), ("shard", pa.int32()),
                         ("place", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def write(batches):
        part = last = None
        held, names, place, n, index = [], [], 0, 0, []

        def flush():
            nonlocal held, names, n
            if held:
                data = block_bytes(table, names, held)
                index.append({"path": part.uri, "at": part.write(data), "bytes": len(data), "shard": last[0], "place": place,
                              "docs": len(held), "tokens": n})
            held, names, n = [], [], 0

        for batch in batches:
            for shard, at, doc, data in zip(*(batch.column(i) for i in range(4))):
                here = (shard.as_py(), at.as_py())
                if last is None or here != (last[0], last[1] + 1) or part.size >= FILE_BYTES:
                    flush()
                    if part is not None:
                        part.close()
                    part = PartFile(folder, ".rans")
                if not held:
                    place = here[1]
                last = here
                names.append(doc.as_py())
                held.append(np.frombuffer(data.as_buffer(), kind).astype(np.int64))
                n += len(held[-1])
                if n >= BLOCK_TOKENS:
                    flush()
        flush()
        if part is not None:
            part.close()
            yield pa.RecordBatch.from_pylist(index, columns)

    return tokens.select("shard", "place", "doc_id", "ids").mapInArrow(
        write, "path string, at bigint, bytes bigint, shard int, place bigint, docs bigint, tokens bigint")


def block_starts(index: DataFrame) -> DataFrame:
    """Adds ``first``: tokens before the block.  Shards are summed to one row each before they are ordered."""
    shards = index.groupBy("shard").agg(F.sum("tokens").alias("all"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return index.join(shards, "shard").withColumn(
        "first", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("base")


def read_files(index: DataFrame, table: Table, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded block by block."""
    spark = index.sparkSession
    index = index.select("path", "at", "bytes", "first").repartition(spark_partitions(spark), "path", "at")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    schema = pa.schema([pa.field(c, pa.list_(pa.int32()) if c == "ids" else pa.int64()) for c in names])

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                store, path = open_store(r["path"])
                with store.open_input_file(path) as source:
                    source.seek(r["at"])
                    docs, parts = read_block(table, source.read(r["bytes"]))
                start, rows = r["first"], []
                for d, x in zip(docs, parts):
                    row = {"doc_id": d, "start": start, "n_tokens": len(x), "ids_crc32": zlib.crc32(x.astype("<u4").tobytes())}
                    rows.append(row | ({"ids": x} if ids else {}))
                    start += len(x)
                yield pa.RecordBatch.from_pylist(rows, schema)

    return index.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


def encode_corpus(docs: DataFrame, folder: str, scratch: Scratch, id: str = "doc_id", text: str = "text",
                  path: str | None = None) -> tuple[DataFrame, Table]:
    """(index of blocks, table) of the files written for all documents.

    Documents stand in ascending order of id, nulls first, rows of equal id by text.  A null or
    empty text is the end id alone.  An empty table gives an empty index.
    """
    path = path or vocabulary_path()
    kind = Encoder(path).kind
    tokens = scratch.keep(tokenize(docs, id, text, path), "tokens")
    table = Table.of_counts(*token_counts(tokens, kind))
    index = scratch.keep(write_files(tokens, folder, table, kind), "index")
    scratch.drop("tokens")
    return block_starts(index), table


def op1_range_coding(spark, sf_dir):
    scratch = Scratch(spark, "rans")
    index, coding = encode_corpus(table(spark, sf_dir, "documents"), scratch.place("files"), scratch)
    return read_files(index, coding, ids=False)
