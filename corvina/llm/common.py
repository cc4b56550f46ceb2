"""What the operators of this subpackage share: shared-folder tables, bounded Arrow passes, word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import tables
from ..tables import delete, table_path  # noqa: F401  (operators take them from here)

#: Rows of an Arrow batch: a batch of very long texts must still fit beside the JVM.
BATCH_ROWS = 512
#: Characters handled at once inside a batch.
CHUNK_CHARS = 1 << 20

_MASK = (1 << 64) - 1


def written(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: it cuts the lineage and survives lost executors."""
    return stored(spark, df, name, **options)[0]


def stored(spark: SparkSession, df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """``written`` with the table's path, for steps that delete a table once the next one is there."""
    return tables.stored(df, name, **options)


def carried(keep: list[str], added: list[str]) -> dict[str, str]:
    """The names under which columns are carried beside ``added`` ones: their own, or with "_given" behind where an added
    column has the name already (Spark tells names apart without case)."""
    taken, out = {a.lower() for a in added} | {k.lower() for k in keep}, {}
    for name in dict.fromkeys(keep):
        new = name
        if name.lower() in {a.lower() for a in added}:
            while new.lower() in taken:
                new += "_given"
            taken.add(new.lower())
        out[name] = new
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches to BATCH_ROWS rows unless the session already asks for fewer. The setting stays: Spark reads
    it when the plan runs, which is after the operator has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: A key is hot if it has more rows than this and than a MOST_HOT-th of all.
HOT_ROWS, MOST_HOT = 1000, 1000


def spread_join(rows: DataFrame, one: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """``tables.spread_join`` with this subpackage's bounds: the rows of hot keys are dealt over several tasks."""
    return tables.spread_join(rows, one, on, total, how, HOT_ROWS, MOST_HOT)


#: What a Python worker keeps between tasks, by key: one thing at a time.
_kept: dict = {}
_asked = False


def kept(key: tuple, make: Callable):
    """``make()``, kept in the Python worker for later tasks that ask for the same key; another key's is let go first."""
    global _asked
    _asked = True
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def prepared(make: Callable):
    """``make()`` at a task's start; what earlier tasks left in the worker goes unless ``make`` asks for it."""
    global _asked
    _asked = False
    work = make()
    if not _asked:
        _kept.clear()
    return work


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so that each part holds about CHUNK_CHARS characters (or one text); null texts come as ''."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK_CHARS or i + 1 == len(texts):
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], dict]], added: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """One Arrow pass: ``make()`` runs once a task and gives a function from texts to the ``added`` columns (DDL).

    ``keep`` names the columns carried through unchanged (default: all); one whose name an added column has is carried
    as ``<name>_given``. No shuffle, row by row, so a lost task is simply run again.
    """
    bounded_batches(df.sparkSession)
    new = T._parse_datatype_string(added)
    names = carried(df.columns if keep is None else keep, [f.name for f in new.fields])
    keep = list(names)
    schema = T.StructType([T.StructField(names[c], df.schema[c].dataType) for c in keep] + list(new.fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepared(make)
        for part, texts in slices(batches, text):
            got = work(texts)
            held = got.pop("_rows", None)  # positions kept, where the pass also filters
            arrays = []
            for i, field in enumerate(arrow):
                if i < len(keep):
                    col = part.column(part.schema.get_field_index(keep[i]))
                    if held is not None:
                        col = col.take(pa.array(held, pa.int64()))
                    arrays.append(col if col.type == field.type else col.cast(field.type))
                else:
                    arrays.append(pa.array(got[field.name], field.type))
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    cols = list(dict.fromkeys([*keep, text]))
    return df.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered; emptied when it holds ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def word_hashes() -> WordHashes:
    """The worker's word hashes."""
    return kept(("word hashes",), WordHashes)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's), elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes, in order; empty with fewer than k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = mix(out) + h[j : j + n] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & _MASK)
    return mix(out)


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cols)
