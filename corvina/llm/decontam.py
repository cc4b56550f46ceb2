"""Benchmark decontamination by winnowing.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. A window is ``window`` consecutive words
of a benchmark item; an item of fewer words is one window. The fingerprint of a window is the least hash of K
consecutive words in it (the rightmost of equal ones), so neighbouring windows mostly share theirs, and equal windows
always do: no shared window is missed. Items shorter than ``window`` have one fingerprint, of their own length.

Steps, whatever the size of either side:

1. the benchmark's windows with their fingerprints and items are written as a table; a bit table of the fingerprints
   (64 bits for each, MOST_BITS at most, three places a fingerprint) is the only thing that is sent to the executors;
2. one pass over the documents winnows them and keeps the windows whose fingerprint may be in the bit table; what it
   lets through in vain costs a row in the join, nothing else;
3. the distinct windows so found are joined with the benchmark's by fingerprint, and confirmed on their words;
4. the documents' windows are joined with the confirmed ones, those of a passage that a third of all documents hold
   dealt over many tasks (``spread_join``); a document's confirmed windows are extended to passages;
5. documents with the same confirmed windows share a list of items, which is made once for each such set.

Documents without a candidate never enter a join. Null and empty texts have no words. Rows that share a doc_id, and
repeated rows, are judged each for itself; items that share an item_id count once; a null item_id is written as an empty
string. Columns named n_words, hits or items are carried as n_words_given and so on. Windows are told apart by 128-bit
hashes after step 3 has compared their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, gram_hashes, map_texts, mix, spread_join, word_hashes, written

K = 5
#: The bit table has at most 2 to this bits (32 MB); a larger benchmark only lets more windows through to the join.
MOST_BITS = 28
#: A-Z to a-z; every other ASCII character that is no letter or digit to a blank; bytes from 128 on stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

U = np.uint64
WINDOW = "array<struct<start:int,n:int,fp:long,h1:long,h2:long,words:string>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split(b" ")


def split_words(text: str) -> list[bytes]:
    return [w for w in words_of(text) if w]


def prints_of(h: np.ndarray, n: int, k: int) -> np.ndarray:
    """The fingerprint of each window of ``n`` words: the least hash of ``k`` words in it, told apart by n."""
    least = gram_hashes(h, min(k, n))
    grams, width = least, n - min(k, n) + 1
    if len(grams) < width:
        return np.empty(0, U)
    for j in range(1, width):
        least = np.minimum(least[:-1], grams[j:])
    return mix(least + U(n))


def kept(prints: np.ndarray) -> np.ndarray:
    """Where a fingerprint differs from that of the window before: neighbours mostly share theirs, and it is kept once."""
    return np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.empty(0, np.int64)


def window_row(words: list[bytes], start: int, n: int, fp: int) -> tuple[int, int, int, int, int, str]:
    raw = b" ".join(words[start : start + n])
    h = xxhash.xxh3_128_digest(raw)
    return start, n, fp, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), raw.decode("utf-8", "surrogatepass")


#: Places of a fingerprint in the bit table.
PLACES = 3


def place(prints: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th place of each fingerprint in a table of 2 to ``bits`` bits."""
    return mix(prints + U((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U(64 - bits)


class BitTable:
    def __init__(self, words: np.ndarray, bits: int):
        self.bytes, self.bits = words.view(np.uint8), bits

    def may_hold(self, prints: np.ndarray) -> np.ndarray:
        """Positions of the fingerprints that may be in the table."""
        left = np.arange(len(prints))
        for i in range(PLACES):
            at = place(prints[left], i, self.bits)
            left = left[(self.bytes[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1]
            if not len(left):
                break
        return left


def benchmark_windows(spark: SparkSession, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """(item, n, fp, h1, h2, words) of the windows of each item, as a table."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))

    def make():
        hashes = word_hashes()

        def work(texts: list[str]) -> dict:
            out = []
            for t in texts:
                words = split_words(t)
                n = min(len(words), window)
                h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
                prints = prints_of(h, n, k).view(np.int64).tolist() if n else []
                out.append([window_row(words, i, n, fp) for i, fp in enumerate(prints)])
            return {"windows": out}

        return work

    found = map_texts(items, make, f"windows {WINDOW}", keep=["item"]).select("item", F.explode("windows").alias("w"))
    return written(spark, found.select("item", "w.n", "w.fp", "w.h1", "w.h2", "w.words").distinct(), "benchmark")


def bit_table(spark: SparkSession, windows: DataFrame) -> BitTable:
    """Built on the executors as 64-bit words, joined by or; its size follows from the number of fingerprints, up to
    MOST_BITS."""
    prints = windows.select("fp").distinct()
    bits = min(MOST_BITS, max(16, (64 * max(prints.count(), 1) - 1).bit_length()))

    def run(batches):
        for batch in batches:
            at = np.concatenate([place(batch.column(0).to_numpy().view(U), i, bits) for i in range(PLACES)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).astype(np.int64)), pa.array((U(1) << (at & U(63))).view(np.int64))], ["word", "bits"])

    rows = prints.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2 to (bits - 6) rows at most
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return BitTable(table, bits)


def winnowed(docs: DataFrame, table: BitTable, lengths: list[int], k: int, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, n_words, and the windows whose fingerprint may be in the table."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        known, hashes = sent.value, word_hashes()

        def work(texts: list[str]) -> dict:
            n_words, windows = [], []
            for t in texts:
                words = split_words(t)
                h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
                found = []
                for n in lengths:
                    prints = prints_of(h, n, k)
                    first = kept(prints)
                    ends = np.append(first[1:], len(prints))
                    for i in known.may_hold(prints[first]).tolist():
                        fp = int(prints[first[i]].view(np.int64))
                        found += [window_row(words, s, n, fp) for s in range(first[i], ends[i])]
                n_words.append(len(words))
                windows.append(found)
            return {"n_words": n_words, "windows": windows}

        return work

    return map_texts(docs, make, f"n_words long, windows {WINDOW}", keep=keep)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def passages(windows: list[dict]) -> list[dict]:
    return [{"start": s, "end": e} for s, e in merged([(w["start"], w["start"] + w["n"]) for w in windows])]


def judged(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int, k: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The winnowed documents with a number ``row`` each, as a table; and of the rows with hits: row, hits, items.

    ``keep`` has no names of this module's own.
    """
    known = benchmark_windows(spark, benchmark, window, min(k, window))
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # ``window`` numbers at most
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    rows = written(spark, winnowed(numbered, bit_table(spark, known), lengths, min(k, window), [*keep, "row"]), "winnowed")

    own = rows.where(F.size("windows") > 0).select("row", F.explode("windows").alias("w")).select("row", "w.*")
    asked = own.groupBy("n", "fp", "h1", "h2").agg(F.first("words").alias("words"))
    confirmed = asked.join(known.select("n", "fp", "h1", "h2", "words").distinct(), ["n", "fp", "h1", "h2", "words"], "left_semi").select("h1", "h2")
    confirmed = written(spark, confirmed, "confirmed")

    total = rows.agg(F.coalesce(F.sum(F.size("windows")), F.lit(0))).first()[0]
    held = spread_join(own.select("row", "start", "n", "h1", "h2"), confirmed, ["h1", "h2"], total, "left_semi")
    by_row = held.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"), F.array_sort(F.collect_set(F.struct("h1", "h2"))).alias("held"))
    spans = F.udf(passages, "array<struct<start:int,end:int>>", useArrow=True)("spans")
    by_row = by_row.select("row", spans.alias("hits"), "held", F.xxhash64("held").alias("set1"), F.xxhash64(F.lit(1), "held").alias("set2"))
    by_row = written(spark, by_row, "hits")

    sets = by_row.groupBy("set1", "set2").agg(F.first("held").alias("held"))
    named = sets.select("set1", "set2", F.explode("held").alias("w")).select("set1", "set2", "w.*").join(known.select("h1", "h2", "item"), ["h1", "h2"])
    lists = named.groupBy("set1", "set2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = spread_join(by_row.drop("held"), lists, ["set1", "set2"], by_row.count()).select("row", "hits", "items")
    return rows, hits


def find_hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = K, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all) with n_words, hits (array of the start and end, in words, of each hit passage) and items
    (ids as strings, in order)."""
    names = carried(docs.columns if keep is None else keep, ["n_words", "hits", "items"])
    inner = {c: f"c{i}" for i, c in enumerate(names)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], F.col("text"))
    rows, hits = judged(spark, held, benchmark, window, k, list(inner.values()))
    shown = [F.col(n).alias(names[c]) for c, n in inner.items()]
    none, nobody = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    clean_ = rows.where(F.size("windows") == 0).select(*shown, "n_words", none.alias("hits"), nobody.alias("items"))
    asked = rows.where(F.size("windows") > 0).drop("windows").join(hits, "row", "left")
    return clean_.unionByName(asked.select(*shown, "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", nobody).alias("items")))


def hit_words(hits: str = "hits"):
    """Number of words in the hits, which do not overlap."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, unchanged."""
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], F.col("text"))
    rows, hits = judged(spark, held, benchmark, window, K, list(inner.values()))
    back = [F.col(n).alias(c) for c, n in inner.items()]
    asked = rows.where(F.size("windows") > 0).join(hits, "row", "left_anti")
    return rows.where(F.size("windows") == 0).select(*back).unionByName(asked.select(*back))
