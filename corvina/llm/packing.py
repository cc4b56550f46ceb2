"""Packing by shortest-pack-first over the length histogram.

Each document's ids are cut into full pieces of ``capacity`` and one shorter rest. Full pieces are sequences of
their own. The rests' length histogram (at most ``capacity`` bins, so its size is fixed) goes to the driver, which
places lengths longest first, each into the pack with the most room in which it fits, a whole count at a time, and
so gets packing patterns with counts. Patterns are joined back to documents by rank: the r-th rest of a length takes
the r-th slot of that length. Ranks come from counts per task and length, never from one global sort, so a length
that a third of all rests share is no hot spot.

Null and empty texts give one id, the end id, hence a piece of length 1. Rows that share a doc_id are packed each
for itself. An empty table gives an empty result. Other columns than doc_id and text are not carried.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices, written
from .tokens import END, encoder_of


def cut(docs: DataFrame, tokenizer: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and part, rank (its place among the task's
    pieces of that length), and ids if asked for."""
    bounded_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = encoder_of(tokenizer), TaskContext.get().partitionId(), Counter()
        for rows, texts in slices(batches, "text"):
            out: list[list] = [[] for _ in schema]
            for doc_id, raw in zip(rows.column(0).to_pylist(), encoder.encode(texts)):
                raw += END
                view, n = memoryview(raw), len(raw) // 4
                for start in range(0, n, capacity):
                    piece = view[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    values = [doc_id, start, length, zlib.crc32(piece), n, part, seen[length]]
                    seen[length] += 1
                    for col, value in zip(out, values):
                        col.append(value)
                    if with_ids:
                        out[-1].append(np.frombuffer(piece, "<i4"))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs). ``histogram``: length -> number of pieces."""
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [lengths, count]
    for length in sorted(histogram, reverse=True):
        left, placed = histogram[length], []
        for room in range(capacity, length - 1, -1):
            groups = open_.get(room)
            while left and groups:
                lengths, count = groups.pop()
                take = min(left, count)
                if take < count:
                    groups.append([lengths, count - take])
                placed.append((room - length, [(*lengths, length), take]))
                left -= take
            if not left:
                break
        # a pack that has just got this length may have room for it again
        while left:
            again = max((x for x in placed if x[0] >= length), default=None, key=lambda x: x[0])
            if again is None:
                placed.append((capacity - length, [(length,), left]))
                if capacity - length < length:
                    left = 0
                    break
                fit = capacity // length  # as many of it as fit one pack, in whole packs
                placed.pop()
                whole, rest = divmod(left, fit)
                if whole:
                    placed.append((capacity - fit * length, [(length,) * fit, whole]))
                if rest:
                    placed.append((capacity - rest * length, [(length,) * rest, 1]))
                left = 0
                break
            placed.remove(again)
            room, (lengths, count) = again
            take = min(left, count)
            if take < count:
                placed.append((room, [lengths, count - take]))
            placed.append((room - length, [(*lengths, length), take]))
            left -= take
        for room, group in placed:
            open_[room].append(group)
    found: Counter = Counter()
    for groups in open_.values():
        for lengths, count in groups:
            found[tuple(lengths)] += count
    return sorted(found.items(), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, last rank, sequence of the first, offset) of each run of slots; and the number of sequences."""
    out, used, sequence = [], Counter(), 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            out.append((length, used[length], used[length] + count - 1, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return out, sequence


class Slots:
    """The slot table, searched by (length, rank): runs of slots in order of their length and first rank."""

    def __init__(self, runs: list[tuple[int, int, int, int, int]]):
        table = np.array(sorted(runs), np.int64).reshape(-1, 5)
        self.length, self.low, _, self.sequence, self.offset = (np.ascontiguousarray(c) for c in table.T)
        self.first = {int(n): int(i) for n, i in zip(*np.unique(self.length, return_index=True))}
        self.ends = {n: i + int((self.length == n).sum()) for n, i in self.first.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the slot with each rank among those of its length."""
        run = np.empty(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            own = lengths == n
            run[own] = self.first[n] + np.searchsorted(self.low[self.first[n] : self.ends[n]], ranks[own], side="right") - 1
        return self.sequence[run] + ranks - self.low[run], self.offset[run]


def placed(ranked: DataFrame, table: Slots) -> DataFrame:
    """``ranked`` (length, r, ...) with sequence_id and offset instead of r: one Arrow pass, a binary search for each
    piece, so a length with many runs of slots costs no more rows than any other. The table has a row for each pattern
    and length in it: bounded by the capacity, whatever the number of documents."""
    sent = ranked.sparkSession.sparkContext.broadcast(table)
    names = [c for c in ranked.columns if c != "r"]
    schema = T.StructType([ranked.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            if batch.num_rows:
                found = known.find(at["length"].to_numpy(), at["r"].to_numpy())
                yield pa.RecordBatch.from_arrays([*[at[n] for n in names], *map(pa.array, found)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for) of each piece."""
    pieces = written(spark, cut(docs, tokenizer, capacity, with_ids), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    bases = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    bases = bases.select("length", "part", F.coalesce("base", F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table, _ = slots(shortest_pack_first(histogram, capacity))
    # full pieces hold most of the ids; their bases, one for each task, are sent to them, so that only rests are shuffled
    full, rest = F.col("length") == capacity, F.col("length") < capacity
    ranked = pieces.where(full).join(F.broadcast(bases.where(full)), ["length", "part"]).unionByName(pieces.where(rest).join(bases.where(rest), ["length", "part"]))
    ranked = ranked.withColumn("r", F.col("rank") + F.col("base"))
    out = placed(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids, "r"), Slots(table))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
