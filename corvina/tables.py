"""Tables between steps, in the folder that driver and executors share, and joins that deal hot keys over tasks.

``spark.checkpoint.dir`` names the folder; only where it is unset, as in tests, a local one is made. A written table cuts
the lineage, is computed once and outlives lost executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="corvina-")
        warnings.warn(f"spark.checkpoint.dir is unset; tables between steps go to {found}, which only one machine sees", stacklevel=2)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended
        pass


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/corvina-{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def stored(df: DataFrame, name: str = "table", **options: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and the table's path, for steps that delete a table once the
    next one is there."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again; deleted when the driver ends."""
    return stored(df, name, **options)[0]


#: A key is hot if it has more rows than this and than a MOST_HOT-th of all; so there are fewer than MOST_HOT of them.
HOT_ROWS, MOST_HOT = 10_000, 1000


def hot_keys(rows: DataFrame, on: list[str], total: int, least: int = HOT_ROWS, most: int = MOST_HOT, counts: DataFrame | None = None) -> DataFrame | None:
    """The keys that hold more rows than a task should get, with _ways, the number of tasks to deal them over; None if
    there is none. Counted by partial aggregates, unless ``counts`` (the keys with _n) are at hand; fewer than ``most``
    whatever the number of rows, so they may be collected and broadcast."""
    limit = max(least, total // most)
    if total <= limit:
        return None
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n")) if counts is None else counts
    found = counts.where(F.col("_n") > limit).select(*on, F.ceil(F.col("_n") / limit).cast("long").alias("_ways")).collect()
    schema = T.StructType([*[rows.schema[c] for c in on], T.StructField("_ways", T.LongType())])
    return rows.sparkSession.createDataFrame(found, schema) if found else None


def spread_join(rows: DataFrame, one: DataFrame, on: list[str], total: int, how: str = "inner", least: int = HOT_ROWS, most: int = MOST_HOT, counts: DataFrame | None = None) -> DataFrame:
    """``rows``, of which there are ``total``, joined (inner, left or left_semi) with ``one``, which has few rows a key.
    The rows of a hot key are dealt over several tasks by a hash of the row, and its rows of ``one`` are copied to each of
    them: at most 2 * ``most`` times in all."""
    hot = hot_keys(rows, on, total, least, most, counts)
    if hot is None:
        return rows.join(one, on, how)
    hot = F.broadcast(hot)
    dealt = F.when(F.col("_ways").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), "_ways")).cast("long")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_ways") - 1, F.lit(0)).cast("long")))
    left = rows.join(hot, on, "left").withColumn("_salt", dealt).drop("_ways")
    right = one.join(hot, on, "left").withColumn("_salt", copies).drop("_ways")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
