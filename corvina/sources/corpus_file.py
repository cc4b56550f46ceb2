"""A corpus as one JSON document: records with their uids, searches, and the counts of a deduplication.

``read`` gives tables, ``write`` one file of one record a line. A document of this kind is read by one task, as JSON of one
object must be; tables of records beyond that are Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields
from ..schema import RECORD, SEARCH, conform

#: The name of the format; documents of other tools with the same content and version are read too.
FORMAT = "corvina/corpus-1"
KNOWN = r"^$|/corpus-1$"

_RECORDS = T.ArrayType(T.StructType([f for f in RECORD if f.name != "ord"]))
_SEARCHES = T.ArrayType(T.StructType([f for f in SEARCH if f.name != "ord"]))
DOCUMENT = T.StructType([T.StructField("format", T.StringType()), T.StructField("searches", _SEARCHES), T.StructField("records", _RECORDS), T.StructField("dedup", T.StringType())])


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, searches, dedup as JSON texts). uids and search_ids stay as they are; a search without one gets its
    place; identifiers come in their canonical form. Raises ValueError for documents of another kind."""
    found = spark.read.schema(DOCUMENT).option("multiLine", "true").json(path)
    label = F.coalesce("format", F.lit(""))
    wrong = found.where(~label.rlike(KNOWN) | (F.col("records").isNull() & F.col("searches").isNull())).select(label.alias("format")).head()
    if wrong is not None:
        raise ValueError(f"not a corpus document: format {wrong['format']!r}")
    records = found.select(F.posexplode("records").alias("ord", "r")).select(F.col("ord").cast("long").alias("ord"), "r.*")
    records = conform(records.withColumns({"doi": fields.doi("doi"), "pmid": fields.pmid("pmid"), "openalex_id": fields.openalex("openalex_id")}))
    searches = found.select(F.posexplode("searches").alias("ord", "s")).select(F.col("ord").cast("long").alias("ord"), "s.*")
    own = F.concat(F.lit("S"), (F.col("ord") + 1).cast("string"))
    texts = {f.name: F.coalesce(f.name, F.lit("")) for f in SEARCH if isinstance(f.dataType, T.StringType)}
    searches = searches.withColumns(texts | {"search_id": F.coalesce(F.nullif("search_id", F.lit("")), own), "records_retrieved": F.coalesce("records_retrieved", F.lit(0).cast("long"))})
    return records, searches, found.where("dedup is not null").select("dedup")


def next_uid(records: DataFrame) -> int:
    """The number after the last R number in use, from which added records count on."""
    return records.agg(F.coalesce(F.max(F.regexp_extract("uid", r"^R(\d+)$", 1).try_cast("long")), F.lit(0))).first()[0] + 1


def lines(records: DataFrame, searches: DataFrame, dedup: str = "") -> DataFrame:
    """(at, line): the document's lines in order."""
    text = lambda df: F.to_json(F.struct(*[c for c in df.columns if c != "ord"]))
    raw = F.when(F.col("raw") != "", F.concat(F.lit(', "raw": '), "raw")).otherwise("")
    body = F.concat(F.regexp_replace(text(records.drop("raw")), r"\}$", ""), raw, F.lit("}"))
    spark = records.sparkSession
    frame = lambda rows: spark.createDataFrame(rows, "part int, ord long, line string")
    comma = lambda df, part, line, last: df.select(F.lit(part).alias("part"), "ord", F.concat(line, F.when(F.col("ord") == last, "").otherwise(",")).alias("line"))
    most = lambda df: df.agg(F.max("ord")).first()[0]
    out = frame([(0, 0, f'{{"format": "{FORMAT}", "searches": ['), (2, 0, '], "records": ['), (4, 0, "]" + (f', "dedup": {dedup}' if dedup else "") + "}")])
    out = out.unionByName(comma(searches, 1, text(searches), most(searches))).unionByName(comma(records, 3, body, most(records)))
    return out.select(F.struct("part", "ord").alias("at"), "line")


def write(records: DataFrame, searches: DataFrame, path: str, dedup: str = "") -> None:
    """One file; its lines pass through one task, a line at a time."""
    lines(records, searches, dedup).orderBy("at").select("line").coalesce(1).write.option("lineSep", "\n").text(path)
