"""Token-ID output: ids in bit or byte planes, each plane compressed with zstandard, with a chunk index.

A shard is a self-describing file image::

    magic "CVT1" | header | doc table (zstd) | chunk index | plane payloads

The doc table holds each document's id and its number of ids; the chunk index holds for each chunk of at most
``chunk_ids`` ids its count, its crc32 and the offset and length of each plane. In a shard's file (``export_shards``
writes each as one) any chunk can be read alone; as a row of the Parquet table (part, seq, part_start, n_ids, shard) a
shard is read whole, and its chunks are then decoded one by one. The table may lie in any Hadoop file system, and
Spark's committer makes the write atomic for each task.

Order: ascending doc_id (nulls first); rows that share a doc_id are ordered by a hash of the text, then by the text, so
repeated rows stand together (null text counts as empty). Null and empty texts give one id, the end id. An empty table
gives no shard. Other columns than doc_id and text are not carried.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, kept, slices, table_path

MAGIC = b"CVT1"
HEAD = struct.Struct("<4sBBxxIQII")  # magic, planes kind, planes, docs, ids, chunks, doc table bytes
NULL_ID = -(1 << 63)
END = struct.pack("<I", 0)


#: Letters of which every Unicode version says so.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: ASCII marks that are no apostrophe.
MARKS = ".,;:!?%&#*$|()\"-"


SEEN = 1 << 21


class Parts(dict):
    """A part of a text -> the ids' bytes of ``prefix`` and it.

    A part is kept from its second use on, as most parts of a corpus occur once: ``seen`` has a byte for each hash of a
    part. At most two generations of ``most`` parts are kept.
    """

    def __init__(self, encoder: Encoder, prefix: str, most: int):
        super().__init__()
        self.encoder, self.prefix, self.most, self.old = encoder, prefix, most, {}
        self.seen = bytearray(SEEN)

    def __missing__(self, part: str) -> bytes:
        got = self.old.get(part)
        if got is None:
            core = part.rstrip(MARKS)
            if not LETTERS.fullmatch(core):
                got = self.encoder.whole([self.prefix + part])[0]
            elif len(core) < len(part):
                got = self[core] + self.encoder.tails[part[len(core) :]]
            else:
                got = self.encoder.letters(self.prefix + part)
        at = hash(part) & (SEEN - 1)
        if not self.seen[at]:
            self.seen[at] = 1
        elif len(part) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
                self.seen = bytearray(SEEN)
            self[part] = got
        return got


class Encoder:
    """Ids of texts as little-endian uint32 bytes, by the tokenizers library.

    Byte-level BPE splits a text before a blank that stands between non-blanks, and around a single line feed
    between non-blanks, whatever else the text holds; it also splits a run of letters from the marks after it.
    So these parts are encoded alone and remembered: words recur, and the library then sees each only once.
    The memories are bounded (see Parts).
    """

    _pairs = re.compile(r"\s\s")
    _cuts = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str, most: int = 300_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.first, self.after, self.tails = Parts(self, "", most // 4), Parts(self, " ", most), Parts(self, "", 10_000)
        a, b, both = (self.tok.encode(x, add_special_tokens=False).ids for x in ("ab", " cd", "ab cd"))
        self.parts = self.tok.normalizer is None and a + b == both
        if self.parts:
            self.newline = self.whole(["\n"])[0]
            shown = {*range(33, 127), *range(161, 173), *range(174, 256)}  # byte-level BPE shows the other bytes from 256 on
            self.shown = {x: 256 + i for i, x in enumerate(x for x in range(256) if x not in shown)}
            self.blank = chr(self.shown[32])

    def whole(self, parts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(parts), 1024):
            out += [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(parts[i : i + 1024], add_special_tokens=False)]
        return out

    def letters(self, word: str) -> bytes:
        shown = word.replace(" ", self.blank) if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.parts:
            return self.whole(texts)
        first, after, out = self.first.__getitem__, self.after.__getitem__, []
        for t in texts:
            if self._pairs.search(t):
                out.append(b"".join(map(first, self._cuts.split(t))))
                continue
            lines = []
            for line in t.split("\n"):
                head, *words = line.split(" ")
                lines.append(first(head) + b"".join(map(after, words)))
            out.append(self.newline.join(lines))
        return out


def encoder_of(path: str) -> Encoder:
    """A Python worker's encoder: tasks that follow one another in it find the words of earlier ones."""
    return kept(("encoder", path), lambda: Encoder(path))


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of uint32 ids: 4 byte planes, or 32 bit planes (each packed, the last byte filled with zeros)."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        raw = np.empty((n, 4), np.uint8)
        for i, p in enumerate(planes):
            raw[:, i] = np.frombuffer(p, np.uint8) if p else 0
    else:
        bits = np.zeros((32, n), np.uint8)
        for i, p in enumerate(planes):
            if p:
                bits[i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def pack_shard(doc_ids: list[int | None], parts: list[bytes], chunk_ids: int = 1 << 16, kind: str = "byte", level: int = 3) -> bytes:
    """A shard image. A plane of zeros only is left out (length 0)."""
    press = zstandard.ZstdCompressor(level=level)
    ids = np.frombuffer(b"".join(parts), "<u4")
    table = np.empty((2, len(doc_ids)), "<i8")
    table[0] = [NULL_ID if d is None else d for d in doc_ids]
    table[1] = [len(p) // 4 for p in parts]
    docs = press.compress(table.tobytes())
    n_planes = 4 if kind == "byte" else 32
    index, payload, at = [], [], 0
    for i in range(0, len(ids), chunk_ids):
        chunk = ids[i : i + chunk_ids]
        index.append(struct.pack("<II", len(chunk), zlib.crc32(chunk.tobytes())))
        for plane in to_planes(chunk, kind):
            data = press.compress(plane) if plane.count(0) < len(plane) else b""
            index.append(struct.pack("<QI", at, len(data)))
            payload.append(data)
            at += len(data)
    n_chunks = -(-len(ids) // chunk_ids)
    head = HEAD.pack(MAGIC, kind == "bit", n_planes, len(doc_ids), len(ids), n_chunks, len(docs))
    return b"".join([head, docs, *index, *payload])


def read_index(shard: bytes) -> tuple[str, np.ndarray, list[tuple[int, int, list[tuple[int, int]]]], int]:
    """Planes kind, doc table, chunk index (ids, crc32, planes' offsets and lengths) and where the payload starts."""
    magic, bit, n_planes, n_docs, _, n_chunks, n_table = HEAD.unpack_from(shard)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    table = np.frombuffer(zstandard.ZstdDecompressor().decompress(shard[HEAD.size : HEAD.size + n_table], max_output_size=16 * n_docs + 1), "<i8").reshape(2, -1)
    at, index = HEAD.size + n_table, []
    for _ in range(n_chunks):
        n, crc = struct.unpack_from("<II", shard, at)
        index.append((n, crc, [struct.unpack_from("<QI", shard, at + 8 + 12 * k) for k in range(n_planes)]))
        at += 8 + 12 * n_planes
    return ("bit" if bit else "byte"), table, index, at


def read_chunk(shard: bytes, entry: tuple, kind: str, base: int) -> np.ndarray:
    n, crc, planes = entry
    open_ = zstandard.ZstdDecompressor().decompress
    most = n if kind == "byte" else -(-n // 8)
    ids = from_planes([open_(shard[base + o : base + o + k], max_output_size=most) if k else b"" for o, k in planes], n, kind)
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a chunk's checksum differs")
    return ids


def unpack_shard(shard: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, ids in each document, all ids."""
    kind, table, index, base = read_index(shard)
    ids = [read_chunk(shard, e, kind, base) for e in index]
    return [None if d == NULL_ID else int(d) for d in table[0]], table[1], np.concatenate(ids) if ids else np.empty(0, "<u4")


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_ids: int = 1 << 20, chunk_ids: int = 1 << 16, kind: str = "byte") -> None:
    """Encodes (doc_id, text) and writes shards of about ``shard_ids`` ids in order to the table at ``path``.

    One range shuffle puts documents in order; ties are split by a hash of the text, so no key can fill a task but one of
    equal texts. Texts are shuffled, not ids: ids compress so badly that they are no less, and would need a table of their
    own, or to be made twice, as the shuffle's bounds are found by a pass of its own.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        held: list[tuple[list, list]] = []
        size = seq = before = 0

        def flush():
            nonlocal held, size, seq, before
            ids, parts = [d for a, _ in held for d in a], [p for _, b in held for p in b]
            out = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "part_start": [before], "n_ids": [size], "shard": [pack_shard(ids, parts, chunk_ids, kind)]}, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("shard", pa.binary())]))
            before, seq, size, held = before + size, seq + 1, 0, []
            return out

        for rows, texts in slices(batches, "text"):
            parts = [p + END for p in encoder.encode(texts)]
            held.append((rows.column(0).to_pylist(), parts))
            size += sum(map(len, parts)) // 4
            if size >= shard_ids:
                yield flush()
        if held:
            yield flush()

    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, "part int, seq int, part_start long, n_ids long, shard binary").write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """From the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for."""
    bounded_batches(spark)
    shards = spark.read.schema("part int, seq int, part_start long, n_ids long, shard binary").parquet(path)
    sums = sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_ids")).collect()))  # a row for each writing task
    total, bases = 0, []
    for part, n in sums:
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "part int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)
        for batch in batches:
            for start, shard in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, lengths, ids = unpack_shard(shard.as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("part_start")).alias("start"), "shard").mapInArrow(run, ddl)


def export_shards(spark: SparkSession, path: str, folder: str) -> int:
    """Writes each shard as a file of its own into a local folder (one at a time through the driver); their number."""
    n = 0
    for row in spark.read.parquet(path).orderBy("part", "seq").toLocalIterator():
        with open(f"{folder}/{row['part']:06d}-{row['seq']:06d}.cvt", "wb") as f:
            f.write(row["shard"])
        n += 1
    return n


def encode_corpus(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    path = path or table_path(spark, "tokens")
    write_shards(docs, path, tokenizer)
    return read_documents(spark, path)
