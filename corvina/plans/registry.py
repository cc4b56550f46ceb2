"""Where queries and their SQL are registered, and the record view that most of them read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import RECORDS_SQL, from_documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The compared form of a text in SQL.
NORM_SQL = "trim(regexp_replace(regexp_replace(lower(strip_accents(replace({}, 'ß', 'ss'))), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def query(sql: str | None = None, records: bool = True):
    """Registers a query, and its SQL (over the record view unless said otherwise)."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = f"WITH {RECORDS_SQL}{'' if sql.startswith(',') else chr(10)}{sql}" if records else sql
        return function

    return add
