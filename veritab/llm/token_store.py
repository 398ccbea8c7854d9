"""Token-ID output: a concatenated id array with Elias-Fano encoded document boundaries.

A store is a folder of shard files. A shard holds consecutive documents in ascending doc_id order:
    8 bytes   magic
    7 x u64   id width in bytes, documents, ids, null doc_ids, smallest doc_id, and the lengths in
              bytes of the two sequences that follow
    Elias-Fano sequence of doc_id - smallest, of the documents whose doc_id isn't null (nulls first)
    Elias-Fano sequence of the documents' ends, as counts of ids
    ids, little-endian unsigned, of the least of 1, 2 and 4 bytes that the vocabulary needs
    u32 crc32 of all before
An Elias-Fano sequence of n ascending values below u keeps floor(log2(u / n)) low bits of each
value plainly and the high parts as unary gaps in a bit vector: about 2 + log2(u / n) bits a value.
select(i) finds the i-th set bit through one 32-bit sample for every 256 set bits and a scan of the
bytes from there; block(i, j) decodes a run of values the same way. So no 64-bit table of offsets
exists in the file, and readers hold one of BLOCK values at a time.

Documents are dealt by range of doc_id and text hash (a doc_id that many rows share is split, and
its rows have one order, whatever is computed again); a task encodes and writes its range in pieces, holding one
shard at a time. Only one manifest row per shard is gathered, and offsets across shards come from
its prefix sums. Null texts are empty ones (the end id alone), null doc_ids come first, repeated
rows are kept as they are, an empty table makes an empty store, extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _files
from ._common import checkpoint, partitions, positions, scratch, table
from ._tokens import U4, encoder, tokenizer_path

MAGIC = b"EFTOKEN1"
SHARD_IDS = 4_000_000
SAMPLE, BLOCK = 256, 4096
_COUNTS = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """An ascending sequence of unsigned integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) + 1 if len(v) else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits((v[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little").tobytes(), ones[::SAMPLE].astype(U4))

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        left, at = i % SAMPLE, start // 8
        byte = self.high[at] >> start % 8 << start % 8
        while left >= _COUNTS[byte]:
            left -= int(_COUNTS[byte])
            at += 1
            byte = self.high[at]
        for _ in range(left):
            byte &= byte - 1
        one = at * 8 + (byte & -byte).bit_length() - 1
        value = one - i << self.low_bits
        for b in range(self.low_bits):
            where = i * self.low_bits + b
            value |= (self.low[where // 8] >> where % 8 & 1) << b
        return value

    def block(self, i: int, j: int) -> np.ndarray:
        """The values from the i-th to before the j-th."""
        j = min(j, self.n)
        if i >= j:
            return np.zeros(0, np.int64)
        first, last = i // SAMPLE, -(-j // SAMPLE)  # the samples around
        begin = int(self.samples[first])
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8, end - begin // 8, begin // 8), bitorder="little")
        bits[: begin % 8] = 0
        ones = np.flatnonzero(bits)[i - first * SAMPLE : j - first * SAMPLE] + begin // 8 * 8
        out = ones - np.arange(i, j) << self.low_bits
        if self.low_bits:
            at = i * self.low_bits
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8, offset=at // 8), bitorder="little", count=at % 8 + (j - i) * self.low_bits)[at % 8 :]
            out |= (bits.reshape(j - i, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return out

    def all(self) -> np.ndarray:
        return self.block(0, self.n)

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b = struct.unpack_from("<QQQQ", data)
        return cls(n, bits, data[32 : 32 + a], data[32 + a : 32 + a + b], np.frombuffer(data, U4, offset=32 + a + b))


def shard_bytes(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A shard of documents in order; ids as little-endian unsigned 32-bit integers."""
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    names = EliasFano.of([d - least for d in known]).to_bytes()
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in ids])).to_bytes()
    flat = np.frombuffer(b"".join(ids), U4)
    head = struct.pack("<QQQQqQQ", width, len(ids), len(flat), len(doc_ids) - len(known), least, len(names), len(ends))
    body = MAGIC + head + names + ends + flat.astype(f"<u{width}").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard file's documents: ids(i) by two selects, without decoding other boundaries."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole shard")
        width, self.documents, self.n_ids, nulls, least, a, b = struct.unpack_from("<QQQQqQQ", data, 8)
        at = 8 + struct.calcsize("<QQQQqQQ")
        self.nulls, self.least = nulls, least
        self.names = EliasFano.from_bytes(data[at : at + a])
        self.ends = EliasFano.from_bytes(data[at + a : at + a + b])
        self.flat = np.frombuffer(data, f"<u{width}", self.n_ids, at + a + b)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.flat[start:end]

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Those of the documents from the i-th to before the j-th."""
        j = min(j, self.documents)
        known = self.names.block(max(i - self.nulls, 0), max(j - self.nulls, 0))
        return [None] * (j - i - len(known)) + (known + self.least).tolist()


def write_store(docs: DataFrame, folder: str, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the store; returns its manifest (part, shard, file, documents, n_ids), in the order of
    part and shard. path: the tokenizer's file, the same on every machine."""
    _files.make_dir(folder)

    def run(batches):
        enc, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        width = next(w for w in (1, 2, 4) if max(enc.vocab_size, end_id + 1) <= 1 << 8 * w)
        end = np.array([end_id], U4).tobytes()
        names: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush():
            file = f"{folder}/part-{part:06d}-{shard:06d}.eft"
            _files.write(file, shard_bytes(names, ids, width))
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "file": [file], "documents": [len(names)], "n_ids": [held]}, schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(doc_id)
                ids.append(enc.encode(text.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= shard_ids:
                    yield flush()
                    names, ids, held, shard = [], [], 0, shard + 1
        if names:
            yield flush()

    schema = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("n_ids", pa.int64())])
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return checkpoint(dealt.mapInArrow(run, "part long, shard long, file string, documents long, n_ids long"))


def read_store(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest."""

    def run(batches):
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("_before").to_pylist()):
                shard = Shard(_files.read(file))
                last = 0
                for i in range(0, shard.documents, BLOCK):
                    ends = shard.ends.block(i, i + BLOCK)
                    starts = np.concatenate([[last], ends[:-1]])
                    last = int(ends[-1])
                    crcs = [zlib.crc32(shard.flat[a:b].astype(U4).tobytes()) for a, b in zip(starts, ends)]
                    yield pa.RecordBatch.from_pydict({"doc_id": shard.doc_ids(i, i + BLOCK), "start": starts + before, "n_tokens": ends - starts, "ids_crc32": crcs}, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    placed = positions(manifest, [F.col("part"), F.col("shard")], "n_ids")
    dealt = placed.select("file", "_before").repartition(partitions(manifest.sparkSession), "file")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return read_store(write_store(docs, scratch(spark, "tokens"), tokenizer_path("byte_bpe_50k.json")))


QUERIES = {"op4_token_store": op4_token_store}
