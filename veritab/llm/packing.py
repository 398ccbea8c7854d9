"""Packing: order-preserving dynamic programming over window cuts.

Documents' ids follow each other in order; cuts split the stream into windows of at most `window`
ids. Cuts may stand at document ends, at sentence ends, and, where a sentence is longer than a
window allows, inside it. The cost of a window is its padding plus the penalty of the cut that ends
it. With p the cut positions, f[j] = window - p[j] + penalty[j] + min(f[i] + p[i]) over the i with
p[j] - p[i] <= window: a sliding minimum, kept by a monotone queue in constant time a cut.

Documents are dealt by range of the order, so a task packs consecutive documents; it streams them,
solves `segment` ids at a time, and carries what follows the last but one window over into the next
solution, so only the last window of a task is cut short by its end. A task holds one segment, or
one document if that is longer.

Defined results: null texts are empty ones (the end id alone); null doc_ids come first; repeated
rows are packed one after the other; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from ._tokens import U4, encoder, tokenizer_path

WINDOW = 4096
#: Shares of a window that a cut at a sentence's end, or inside a sentence, costs.
SENTENCE_PENALTY, INNER_PENALTY = 1 / 512, 1 / 64
SEGMENT = 1 << 19
TASK_BYTES = 16 << 20
MAX_TASKS = 20_000
#: Characters that end a sentence, and closers that may follow them.
ENDERS, CLOSERS = ".!?。！？…", "\"')]}»”’"


def choose_cuts(spots: np.ndarray, penalties: np.ndarray, window: int = WINDOW, open_end: bool = False) -> list[int]:
    """Indices of the chosen cuts. spots: ascending positions over 0, each at most window after the
    one before; penalties: of a cut there. The last cut is the last spot; with open_end it is the
    cheapest of those that leave a window or less behind them, for what is still to come."""
    at = [0, *spots.tolist()]
    fee = [0, *penalties.tolist()]
    best, back = [0] * len(at), [0] * len(at)  # best: cost plus position
    queue = deque([0])
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0]] > window:
            queue.popleft()
        back[j] = queue[0]
        best[j] = value = window + fee[j] + best[queue[0]]
        while queue and best[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    if open_end:
        j = min((i for i in range(1, len(at)) if at[-1] - at[i] <= window), key=lambda i: (best[i] - at[i], -i))
    while j:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


def spots_of(lengths: list[int], sentence_ends: list[np.ndarray], window: int = WINDOW, sentence_penalty: float = SENTENCE_PENALTY, inner_penalty: float = INNER_PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, and the penalties there."""
    ends = np.cumsum(lengths)
    inner = [s + e - n for s, e, n in zip(sentence_ends, ends, lengths)]
    spots = np.concatenate([*inner, ends]).astype(np.int64)
    fees = np.full(len(spots), round(sentence_penalty * window), np.int64)
    fees[len(spots) - len(ends) :] = 0
    order = np.lexsort((fees, spots))
    spots, fees = spots[order], fees[order]
    first = np.concatenate([[True], spots[1:] > spots[:-1]]) & (spots > 0)
    spots, fees = spots[first], fees[first]
    # inside a long sentence, a cut every 128th of a window
    gaps = np.diff(np.concatenate([[0], spots]))
    step = max(1, window // 128)
    more = [np.arange(e - g + step, e, step) for e, g in zip(spots[gaps > step], gaps[gaps > step])]
    if more:
        more_at = np.concatenate(more)
        spots, fees = np.concatenate([spots, more_at]), np.concatenate([fees, np.full(len(more_at), round(inner_penalty * window))])
        order = np.argsort(spots, kind="stable")
        spots, fees = spots[order], fees[order]
    return spots, fees


def ender_ids(path: str) -> np.ndarray:
    """For each id, whether its token ends a sentence."""
    enc = encoder(path)
    out = np.zeros(enc.vocab_size, bool)
    for i in range(enc.vocab_size):
        text = enc.tokenizer.decode([i]).strip()
        out[i] = bool(text.rstrip(CLOSERS)) and set(text.rstrip(CLOSERS)) <= set(ENDERS)
    return out


class _Stream:
    """Packs consecutive documents; yields (doc_id, start, ids, doc_tokens, window, offset)."""

    def __init__(self, window: int, segment: int):
        self.window, self.segment = window, segment
        self.docs: list[tuple] = []  # doc_id, ids as bytes, sentence ends, start, doc_tokens
        self.held = self.windows = 0

    def add(self, doc_id, ids: bytes, ends: np.ndarray):
        n = len(ids) // 4
        self.docs.append((doc_id, ids, ends, 0, n))
        self.held += n
        if self.held >= self.segment:
            yield from self.flush(last=False)

    def flush(self, last: bool):
        if not self.docs:
            return
        lengths = [len(d[1]) // 4 for d in self.docs]
        spots, fees = spots_of(lengths, [d[2] for d in self.docs], self.window)
        cuts = [int(spots[c]) for c in choose_cuts(spots, fees, self.window, open_end=not last)]
        begin, k, used = 0, 0, 0  # used: ids of document k that are in windows already
        for cut in cuts:
            offset = 0
            while begin + offset < cut:
                doc_id, ids, _, start, total = self.docs[k]
                take = min(lengths[k] - used, cut - begin - offset)
                yield doc_id, start + used, ids[4 * used : 4 * (used + take)], total, self.windows, offset
                offset, used = offset + take, used + take
                if used == lengths[k]:
                    k, used = k + 1, 0
            begin, self.windows = cut, self.windows + 1
        rest = self.docs[k:]
        if used:
            doc_id, ids, ends, start, total = rest[0]
            rest[0] = (doc_id, ids[4 * used :], ends[ends > used] - used, start + used, total)
        self.docs, self.held = rest, self.held - begin


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, order: list[str] | None = None, with_ids: bool = False, segment: int = SEGMENT) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    with_ids also ids (array<int>). Documents keep the order of the columns order (doc_id)."""
    order = order or ["doc_id"]
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(MAX_TASKS, size // TASK_BYTES + 1)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        enc, enders = encoder(path), ender_ids(path)
        end, first = np.array([end_id], U4).tobytes(), TaskContext.get().partitionId() << 33
        stream = _Stream(window, segment)

        def rows(pieces):
            cols: list[list] = [[] for _ in schema]
            for doc_id, start, ids, total, sequence, offset in pieces:
                row = [doc_id, start, len(ids) // 4, zlib.crc32(ids), total, first + sequence, offset]
                for col, value in zip(cols, row + [np.frombuffer(ids, U4).astype(np.int32)] * with_ids):
                    col.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                ends = np.flatnonzero(enders[np.frombuffer(ids, U4, len(ids) // 4 - 1)]) + 1
                done = list(stream.add(doc_id, ids, ends))
                if done:
                    yield rows(done)
        done = list(stream.flush(last=True))
        if done:
            yield rows(done)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)])
    # the text hash splits an id that many rows share, and gives its rows one order whatever is recomputed
    keys = [*[F.col(f"_order{i}") for i in range(len(order))], F.xxhash64("text")]
    dealt = dealt.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return dealt.select("doc_id", "text").mapInArrow(run, ddl)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op7_pack": op7_pack}
