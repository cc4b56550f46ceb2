"""Fingerprints of records and record sets, drift between two harvests, and archives of recorded responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.text import column, normalize_title, surname

#: Parameters that are secrets, and those that name a person.
SECRETS = ["apikey", "api_key", "key", "token", "insttoken", "access_token", "x-api-key", "api-key", "subscriber", "password"]
PRIVATE = ["mailto", "email", "tool", "api_email"]
VOLATILE = ("cited_by", "open_access")


def payload(norm_title: Column, norm_journal: Column, first_surname: Column) -> Column:
    """The stable fields as canonical JSON: keys in order, no blanks, nulls kept."""
    squeezed = lambda c: fields.squeeze(F.col(c))
    lowered = lambda c: F.lower(F.btrim(F.col(c)))
    values = {
        "doc_type": lowered("doc_type"),
        "doi": F.col("doi"),
        "first_author_surname": first_surname,
        "has_abstract": F.btrim("abstract") != "",
        "issn": F.upper(F.btrim("issn")),
        "issue": squeezed("issue"),
        "language": lowered("language"),
        "n_authors": F.size("authors"),
        "norm_journal": norm_journal,
        "norm_title": norm_title,
        "openalex_id": F.col("openalex_id"),
        "pages": squeezed("pages"),
        "pmid": F.col("pmid"),
        "scopus_id": F.col("scopus_id"),
        "volume": squeezed("volume"),
        "year": F.col("year"),
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})


def fingerprints(records: DataFrame) -> DataFrame:
    """ord, key, checksum, doi, title, year, source, source_id, cited_by, open_access of each record."""
    first = F.coalesce(F.get("authors", F.lit(0)), F.lit(""))
    normed = records.withColumns({"_t": column(normalize_title, "title"), "_j": column(normalize_title, "journal"), "_s": column(surname, first)})
    return normed.select("ord", fields.record_key(F.col("_t")).alias("key"), F.sha2(payload(F.col("_t"), F.col("_j"), F.col("_s")).cast("binary"), 256).alias("checksum"), "doi", fields.squeeze(F.col("title")).alias("title"), "year", "source", "source_id", *VOLATILE)


def corpus_checksum(prints: DataFrame) -> DataFrame:
    """One row: the checksum of a record set, whatever its order, as other tools define it: over one text of all sorted
    checksums. That text (64 characters a record, 2 GB at most) is made in one task; ``corpus_digest`` has no such limit."""
    sums = prints.agg(F.array_sort(F.collect_list("checksum")).alias("c"))
    text = F.when(F.size("c") == 0, "[]").otherwise(F.concat(F.lit('["'), F.array_join("c", '","'), F.lit('"]')))
    return sums.select(F.sha2(text.cast("binary"), 256).alias("checksum"))


#: Checksums that a part of the digest's tree holds on average, at most.
LEAF = 65_536


def corpus_digest(prints: DataFrame) -> DataFrame:
    """One row: digest, n. A checksum of any number of records in any order: checksums with their counts (so copies are
    one entry) are hashed by parts that share leading digits, then the parts' hashes in order. The number of digits
    follows from the number of distinct checksums alone."""
    counted = prints.groupBy("checksum").agg(F.count("*").alias("n"))
    size = counted.count()
    digits = 1
    while size > LEAF * 16**digits:
        digits += 1
    entry = F.concat("checksum", F.lit(":"), F.col("n").cast("string"))
    parts = counted.groupBy(F.substring("checksum", 1, digits).alias("lead")).agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.sum("n").alias("n"))
    parts = parts.select("lead", "n", F.sha2(F.array_join("entries", ",").cast("binary"), 256).alias("sum"))
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("lead", "sum"))).alias("sums"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    return whole.select(F.sha2(F.array_join(F.transform("sums", lambda x: x["sum"]), ",").cast("binary"), 256).alias("digest"), "n")


def sorted_records(records: DataFrame) -> DataFrame:
    """The canonical order: DOI (none first), title, year, source, source's id."""
    return records.withColumn("_t", column(normalize_title, "title")).orderBy("doi", "_t", F.coalesce("year", F.lit(-1)), "source", "source_id", "ord").drop("_t")


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, change, fields): added, removed, changed, counters (only volatile fields differ) or unchanged. Of several
    records with one key the first in order counts."""
    names = ["doi", "title", "year", "source", "source_id"]
    first = lambda df, p: df.groupBy("key").agg(*[F.min_by(c, "ord").alias(f"{p}_{c}") for c in ("checksum", *names, *VOLATILE)], F.lit(True).alias(f"{p}_here"))
    both = first(before, "x").join(first(after, "y"), "key", "full_outer")
    differ = lambda cs: F.filter(F.array(*[F.when(~F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}")), F.lit(c)) for c in cs]), lambda v: v.isNotNull())
    counters = differ(VOLATILE)
    change = F.when(F.col("x_here").isNull(), "added").when(F.col("y_here").isNull(), "removed").when(F.col("x_checksum") != F.col("y_checksum"), "changed").when(F.size(counters) > 0, "counters").otherwise("unchanged")
    out = both.withColumn("change", change)
    fields_ = F.when(F.col("change") == "changed", F.array_sort(differ(names))).when(F.col("change") == "counters", F.array_sort(counters)).otherwise(F.array().cast("array<string>"))
    return out.select("key", "change", fields_.alias("fields"))


def diff_fields(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ("uid", "search_id", "provenance", "raw", "ord")) -> DataFrame:
    """(ord, fields) of the records whose values differ; records only one side has differ in "ord"."""
    names = sorted(set(a.columns) - set(ignore))
    left = a.select("ord", F.struct(*names).alias("x"))
    right = b.select("ord", F.struct(*names).alias("y"))
    both = left.join(right, "ord", "full_outer")
    found = F.filter(F.array(*[F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit(c)) for c in names]), lambda v: v.isNotNull())
    missing = F.col("x").isNull() | F.col("y").isNull()
    return both.select("ord", F.when(missing, F.array(F.lit("ord"))).otherwise(found).alias("fields")).where(F.size("fields") > 0)


def redacted(params: Column) -> Column:
    """Request parameters (a map) without secrets, contact addresses masked."""
    kept = F.map_filter(params, lambda k, v: ~F.lower(k).isin(SECRETS))
    return F.transform_values(kept, lambda k, v: F.when(F.lower(k).isin(PRIVATE), F.lit("<redacted>")).otherwise(F.coalesce(v, F.lit(""))))


def request_key(url: Column, params: Column) -> Column:
    """The same for every caller: secrets and contact addresses don't count, parameters are in order of their names."""
    kept = F.map_filter(params, lambda k, v: ~F.lower(k).isin(SECRETS + PRIVATE))
    entries = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].alias("k"), F.coalesce(e["value"], F.lit("")).alias("v"))))
    inner = lambda v: F.regexp_replace(F.to_json(F.struct(v.alias("x"))), r'^\{"x":|\}$', "")
    body = F.array_join(F.transform(entries, lambda e: F.concat(inner(e["k"]), F.lit(":"), inner(e["v"]))), ",")
    return F.sha2(F.concat(F.lit("["), inner(F.btrim(url)), F.lit(",{"), body, F.lit("}]")).cast("binary"), 256)


def drift_counts(drift_: DataFrame) -> DataFrame:
    """One row: n_before, n_after, added, removed, changed, counters, unchanged, and whether the two are the same."""
    n = lambda *kinds: F.count(F.when(F.col("change").isin(*kinds), 1))
    both = ("changed", "counters", "unchanged")
    out = drift_.agg(n("removed", *both).alias("n_before"), n("added", *both).alias("n_after"), *[n(c).alias(c) for c in ("added", "removed", *both)])
    return out.withColumn("stable", F.expr("added + removed + changed = 0"))


def drift_markdown(drift_: DataFrame, limit: int = 20) -> str:
    """The counts of a drift, and the first keys of each kind of change (``limit`` is the report's own)."""
    c = drift_counts(drift_).first()
    labels = {"unchanged": "The same in both", "added": "Added", "removed": "Removed", "changed": "Changed", "counters": "Only counters changed"}
    out = ["| Change | Records |", "|---|---|", *[f"| {label} | {c[kind]} |" for kind, label in labels.items()]]
    for kind in ("added", "removed", "changed"):
        rows = drift_.where(F.col("change") == kind).orderBy("key").limit(limit).collect()
        if rows:
            out += ["", f"**{labels[kind]}**", "", *[f"- {r['key']}" + (f": {', '.join(r['fields'])}" if r["fields"] else "") for r in rows]]
            out += [f"- and {c[kind] - limit} more"] if c[kind] > limit else []
    return "\n".join(out)


RESPONSE = "seq int, harvest_id string, url string, params map<string,string>, request_key string, status int, retrieved_at string, authenticated boolean, body string, content_sha256 string, content_length long, wire_sha256 string"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses: JSON under responses/, an object a file or a line."""
    return spark.read.schema(RESPONSE).option("multiLine", "false").json(f"{path}/responses")


def archived(pages: DataFrame, harvest_id: str = "H1", after: int = 0, authenticated: bool = False) -> DataFrame:
    """Pages of a connector (seq, url, params, status, body, retrieved_at, wire_sha256) as rows of an archive, numbered on
    from ``after``. Parameters are redacted here as well, whoever made the pages."""
    sha = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256)
    have = set(pages.columns)
    params = F.coalesce("params", F.create_map().cast("map<string,string>")) if "params" in have else F.create_map().cast("map<string,string>")
    return pages.select(
        (F.col("seq") + after + 1).cast("int").alias("seq"), F.lit(harvest_id).alias("harvest_id"), F.substring_index("url", "?", 1).alias("url"), redacted(params).alias("params"),
        request_key(F.substring_index("url", "?", 1), params).alias("request_key"), "status", F.col("retrieved_at") if "retrieved_at" in have else F.lit("").alias("retrieved_at"),
        F.lit(authenticated).alias("authenticated"), "body", sha("body").alias("content_sha256"), F.length(F.coalesce("body", F.lit(""))).cast("long").alias("content_length"),
        F.col("wire_sha256") if "wire_sha256" in have else sha("body").alias("wire_sha256"),
    )


def write_archive(responses: DataFrame, path: str, manifest_: DataFrame | None = None) -> None:
    """Appends rows of ``archived`` to the archive, and the harvest's manifest."""
    responses.write.mode("append").json(f"{path}/responses")
    if manifest_ is not None:
        manifest_.write.mode("append").json(f"{path}/manifests")


def manifest(responses: DataFrame, prints: DataFrame, **about: str) -> DataFrame:
    """One row: what a methods section needs of a harvest: what was asked (``about``: database, query, filters, ...), how
    many responses and records there are, their checksums."""
    n = responses.agg(F.count("*").alias("n_responses"), F.min("retrieved_at").alias("harvested_at"), F.max("authenticated").alias("authenticated"))
    m = prints.agg(F.count("*").alias("n_records"), F.count(F.when(F.col("doi") != "", 1)).alias("n_with_doi"))
    out = n.crossJoin(m).crossJoin(corpus_digest(prints).select("digest"))  # one row each
    return out.select(*[F.lit(v).alias(k) for k, v in sorted(about.items())], "n_responses", "n_records", "n_with_doi", "harvested_at", "authenticated", "digest")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/manifests")


def verify_archive(responses: DataFrame) -> DataFrame:
    """(harvest_id, n, gaps, broken): missing sequence numbers and responses whose checksum differs."""
    broken = F.col("content_sha256") != F.sha2(F.col("body").cast("binary"), 256)
    return responses.groupBy("harvest_id").agg(F.count("*").alias("n"), (F.max("seq") - F.min("seq") + 1 - F.countDistinct("seq")).alias("gaps"), F.count(F.when(broken, 1)).alias("broken"))


def replay(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The n-th request (ord, request_key) of a key gets the n-th recorded response of it that is no 429 or 5xx."""
    from pyspark.sql import Window

    nth = lambda *order: F.row_number().over(Window.partitionBy("request_key").orderBy(*order))
    usable = responses.where("status <> 429 and status < 500").select("request_key", nth("seq").alias("nth"), "seq", "status", "body")
    return requests.withColumn("nth", nth("ord")).join(usable, ["request_key", "nth"], "left").drop("nth")
