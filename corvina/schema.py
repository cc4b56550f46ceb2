"""The record schema, and a record view over the driver's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written

STRINGS = ("title", "abstract", "journal", "doi", "pmid", "openalex_id", "scopus_id", "issn", "volume", "issue", "pages", "doc_type", "language", "url")
LISTS = ("authors", "keywords", "affiliations", "references")
_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
PROVENANCE = T.ArrayType(T.StructType([T.StructField(c, _S) for c in ("database", "search_id", "source_id")]))

#: A missing string is "", never null; year, cited_by and open_access are null where missing. ord is the input's order.
RECORD = T.StructType(
    [T.StructField("ord", _L)]
    + [T.StructField(c, _S) for c in ("uid", "search_id", "source", "source_id", *STRINGS)]
    + [T.StructField("year", _I), T.StructField("cited_by", _I), T.StructField("open_access", _B)]
    + [T.StructField(c, T.ArrayType(_S)) for c in LISTS]
    + [T.StructField("provenance", PROVENANCE), T.StructField("raw", _S)]
)

SEARCH = T.StructType([T.StructField("ord", _L)] + [T.StructField(c, _S) for c in ("search_id", "database", "platform", "interface", "query", "filters", "date_run", "url", "notes")] + [T.StructField("records_retrieved", _L)])


def conform(df: DataFrame) -> DataFrame:
    """``df`` with exactly the record columns: what is missing is filled with the type's "missing" value."""
    out = []
    for f in RECORD:
        have = F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.StringType):
            have = F.coalesce(have, F.lit(""))
        elif isinstance(f.dataType, T.ArrayType):
            have = F.coalesce(have, F.array().cast(f.dataType))
        out.append(have.alias(f.name))
    return df.select(*out)


def uid_of(ord_: Column) -> Column:
    return F.format_string("R%06d", ord_ + 1)


def append(corpus: DataFrame, added: DataFrame, event: dict[str, str], first_ord: int) -> DataFrame:
    """Adds one search's records after ``first_ord`` records: uid by order, search_id, provenance, source if empty."""
    own = F.struct(F.lit(event["database"]).alias("database"), F.lit(event["search_id"]).alias("search_id"), F.col("source_id").alias("source_id"))
    added = conform(added).withColumn("ord", F.col("ord") + first_ord)
    added = added.withColumns({"uid": uid_of(F.col("ord")), "search_id": F.lit(event["search_id"]), "source": F.when(F.col("source") == "", F.lit(event["database"])).otherwise(F.col("source")), "provenance": F.array_append("provenance", own)})
    return corpus.unionByName(added)


def numbered(records: DataFrame, *order: str) -> DataFrame:
    """``ord`` from an order, without putting all rows into one task: counts of range partitions, then places in them."""
    ranged = records.drop("ord").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ranged = written(ranged, "numbered")
    counts = ranged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"), F.lit(1).alias("_one"))
    firsts = ranged.groupBy("_part").agg(F.min("_row").alias("_first"))
    return ranged.join(F.broadcast(starts.join(firsts, "_part")), "_part").withColumn("ord", F.col("_start") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_start", "_first", "_one")


#: Letters whose capital in Unicode is several letters, and those whose capital came with Unicode 16 only; in
#: CAPITALS their capital of one letter, or themselves where there is none. For other letters upper() is of one letter.
LETTERS = "".join(map(chr, [0xDF, 0x149, 0x1F0, 0x390, 0x3B0, 0x587, *range(0x1E96, 0x1E9B), *range(0x1F50, 0x1F57, 2), *range(0x1F80, 0x1FB0), *range(0x1FB2, 0x1FB5), 0x1FB6, 0x1FB7, 0x1FBC, *range(0x1FC2, 0x1FC5), 0x1FC6, 0x1FC7, 0x1FCC, 0x1FD2, 0x1FD3, 0x1FD6, 0x1FD7, *range(0x1FE2, 0x1FE5), 0x1FE6, 0x1FE7, *range(0x1FF2, 0x1FF5), 0x1FF6, 0x1FF7, 0x1FFC, *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), 0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86)]))
CAPITALS = "ẞ" + "".join(chr(ord(c) + 8) if 0x1F80 <= ord(c) < 0x1FB0 and ord(c) % 16 < 8 else chr(ord(c) + 9) if c in "\u1fb3\u1fc3\u1ff3" else c for c in LETTERS[1:])


def capital(letter: Column) -> Column:
    """The capital of one letter, one letter itself, as SQL gives it: of ß it is ẞ, not SS."""
    return F.when(F.lit(LETTERS).contains(letter), F.translate(letter, LETTERS, CAPITALS)).otherwise(F.upper(letter))


def from_documents(documents: DataFrame) -> DataFrame:
    """Records made from documents: identifiers, years, pages and authors are synthetic, made from the text, so that
    copies agree on them. ``RECORDS_SQL`` says the same in SQL."""
    text = F.coalesce("text", F.lit(""))
    docs = documents.select("doc_id", "lang", "source", text.alias("t"), F.md5(text).alias("h"), F.length(text).alias("n"), F.slice(F.filter(F.split(text, r"[ \n\t\r]+", 17), lambda x: x != ""), 1, 15).alias("w"))
    word = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    out = docs.select(
        F.col("doc_id").alias("ord"),
        uid_of(F.col("doc_id")).alias("uid"),
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string")).alias("search_id"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("doc_id").cast("string").alias("source_id"),
        F.array_join(F.slice("w", 1, 12), " ").alias("title"),
        F.col("t").alias("abstract"),
        F.concat(F.lit("Journal of "), word(1)).alias("journal"),
        F.when(F.substring("h", 1, 1) < "c", F.concat(F.lit("10.5555/"), F.substring("h", 1, 12))).otherwise("").alias("doi"),
        F.when(F.substring("h", 2, 1) < "4", F.conv(F.substring("h", 3, 6), 16, 10)).otherwise("").alias("pmid"),
        (F.col("n") % 40 + 1).cast("string").alias("volume"),
        F.when(F.col("n") % 5 == 0, "").otherwise(F.concat((F.col("n") % 900 + 1).cast("string"), F.lit("-"), (F.col("n") % 900 + 9).cast("string"))).alias("pages"),
        F.when(F.col("n") % 3 == 0, "article").when(F.col("n") % 3 == 1, "review").otherwise("").alias("doc_type"),
        F.coalesce("lang", F.lit("")).alias("language"),
        F.when(F.col("n") % 7 == 0, F.lit(None)).otherwise(1990 + F.col("n") % 30).cast("int").alias("year"),
        F.when(F.col("n") % 2 == 0, (F.col("n") % 100).cast("int")).alias("cited_by"),
        F.when(word(13) == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(word(13), F.lit(", "), capital(F.substring(word(14), 1, 1))))).alias("authors"),
        F.slice("w", 3, 2).alias("keywords"),
        F.array(F.concat(F.lit("10.5555/"), F.substring(F.md5(word(0)), 1, 12)), F.concat(F.lit("Some Work, "), word(2))).alias("references"),
    )
    return conform(out)


#: The same view in DuckDB's SQL, as a WITH item.
RECORDS_SQL = r"""records AS (
  SELECT doc_id AS ord, 'R' || lpad(CAST(doc_id + 1 AS VARCHAR), 6, '0') AS uid, 'S' || CAST(doc_id % 3 + 1 AS VARCHAR) AS search_id,
    coalesce(source, '') AS source, CAST(doc_id AS VARCHAR) AS source_id, array_to_string(w[1:12], ' ') AS title, t AS abstract,
    'Journal of ' || coalesce(w[2], '') AS journal,
    CASE WHEN substr(h, 1, 1) < 'c' THEN '10.5555/' || substr(h, 1, 12) ELSE '' END AS doi,
    CASE WHEN substr(h, 2, 1) < '4' THEN CAST(CAST('0x' || substr(h, 3, 6) AS BIGINT) AS VARCHAR) ELSE '' END AS pmid,
    CAST(n % 40 + 1 AS VARCHAR) AS volume,
    CASE WHEN n % 5 = 0 THEN '' ELSE CAST(n % 900 + 1 AS VARCHAR) || '-' || CAST(n % 900 + 9 AS VARCHAR) END AS pages,
    CASE n % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'review' ELSE '' END AS doc_type, coalesce(lang, '') AS language,
    CASE WHEN n % 7 = 0 THEN NULL ELSE CAST(1990 + n % 30 AS INTEGER) END AS year,
    CASE WHEN n % 2 = 0 THEN CAST(n % 100 AS INTEGER) END AS cited_by,
    CASE WHEN coalesce(w[14], '') = '' THEN [] ELSE [w[14] || ', ' || upper(substr(coalesce(w[15], ''), 1, 1))] END AS authors,
    w[3:4] AS keywords, ['10.5555/' || substr(md5(coalesce(w[1], '')), 1, 12), 'Some Work, ' || coalesce(w[3], '')] AS refs
  FROM (SELECT *, md5(t) AS h, length(t) AS n, list_filter(regexp_split_to_array(t, '[ \n\t\r]+'), lambda x: x <> '') AS w
    FROM (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents)))"""
