"""Reports on a corpus: completeness, sources and their tiers, integrity flags, cited references, flow counts.

All are aggregates with partial sums; what is rendered as text (Markdown, SVG) is a frame of a fixed, small size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.text import column, has_diacritics

QUALITY_FIELDS = ("doi", "abstract", "year", "authors", "issn", "language", "keywords")


def present(name: str) -> Column:
    """Whether a field counts as present: "", empty lists and 0 don't."""
    if name in ("authors", "keywords", "affiliations", "references"):
        return F.size(name) > 0
    if name in ("year", "cited_by"):
        return F.coalesce(F.col(name) != 0, F.lit(False))
    return F.coalesce(F.col(name) != "", F.lit(False))


def percent(cond: Column) -> Column:
    return 100.0 * F.count(F.when(cond, 1)) / F.count("*")


def quality(records: DataFrame) -> DataFrame:
    """A row for each source: n, the percentage of records with each field, the mean length of abstracts."""
    source = F.when(F.col("source") == "", "?").otherwise(F.col("source"))
    return records.groupBy(source.alias("source")).agg(F.count("*").alias("n"), *[percent(present(f)).alias(f"pct_{f}") for f in QUALITY_FIELDS], F.coalesce(F.avg(F.when(F.col("abstract") != "", F.length("abstract"))), F.lit(0.0)).alias("mean_abstract_len"))


def quality_rounded(records: DataFrame) -> DataFrame:
    """``quality`` with one decimal, rounded as Python does (half to even on the exact value)."""
    found = quality(records)
    names = [c for c in found.columns if c.startswith(("pct_", "mean_"))]
    return found.withColumns({c: column(_one_decimal, c, returns="double") for c in names}).orderBy("source")


def _one_decimal(x: float) -> float:
    return round(x, 1)


def by_source(searches: DataFrame) -> DataFrame:
    """Records retrieved by database."""
    return searches.groupBy("database").agg(F.sum("records_retrieved").alias("records"))


# --- source tiers: fixed values

PRINCIPAL = {
    "Scopus": "listed", "Web of Science Core Collection": "listed", "PubMed/MEDLINE": "listed", "Embase": "platform", "Cochrane CENTRAL": "listed",
    "EBSCOhost Business Source": "platform", "EBSCOhost PsycINFO": "platform", "EBSCOhost CINAHL": "listed", "EBSCOhost ERIC": "listed",
    "ProQuest ABI/INFORM": "platform", "IEEE Xplore": "field-convention", "ACM Digital Library": "listed",
}
SUPPLEMENTARY = {
    "Crossref": "not-assessed", "OpenAlex": "not-assessed", "Semantic Scholar": "not-assessed", "arXiv": "not-assessed", "bioRxiv": "not-assessed",
    "medRxiv": "not-assessed", "Google Scholar": "not-principal", "Dimensions": "not-assessed", "Lens.org": "not-assessed",
}
#: Pattern of a database's names -> its name, in the order in which they are tried.
SOURCE_NAMES = [
    (r"\bscopus\b|elsevier scopus", "Scopus"),
    (r"\bwos\b|\bwoscc\b|web of science|web of knowledge|\bsci ?expanded\b|social sciences citation index|\bssci\b|\bscie\b", "Web of Science Core Collection"),
    (r"\bcochrane\b|central register of controlled trials|controlled trials register", "Cochrane CENTRAL"),
    (r"\bembase\b|excerpta medica", "Embase"),
    (r"\bpubmed\b|\bmedline\b|\bpmc\b|ncbi|entrez|e-?utilities", "PubMed/MEDLINE"),
    (r"\bpsyc ?info\b|\bpsyclit\b", "EBSCOhost PsycINFO"),
    (r"\bcinahl\b|cumulative index to nursing", "EBSCOhost CINAHL"),
    (r"\beric\b|education resources information", "EBSCOhost ERIC"),
    (r"business source|\bbspremier\b|\bbsc\b|\bebsco", "EBSCOhost Business Source"),
    (r"abi/?inform|\babi\b|\bproquest\b", "ProQuest ABI/INFORM"),
    (r"ieee ?xplore|\bieee\b|\biel\b", "IEEE Xplore"),
    (r"\bacm\b|association for computing machinery|acm ?dl", "ACM Digital Library"),
    (r"\bcrossref\b|cross ?ref", "Crossref"),
    (r"\bopen ?alex\b", "OpenAlex"),
    (r"semantic ?scholar|\bs2ag\b|\bs2\b|allen institute", "Semantic Scholar"),
    (r"\barxiv\b", "arXiv"),
    (r"\bbio ?rxiv\b", "bioRxiv"),
    (r"\bmed ?rxiv\b", "medRxiv"),
    (r"google ?scholar|\bgscholar\b|publish or perish", "Google Scholar"),
    (r"\bdimensions\b|digital science", "Dimensions"),
    (r"\blens\b|lens\.?org", "Lens.org"),
]


def _plain(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(fields.text(name)), r"[^a-z0-9./ ]+", " "), r"\s+", " "))


def canonical_source(name: Column | str) -> Column:
    """A database's registered name; "" if it isn't known."""
    value = _plain(F.col(name) if isinstance(name, str) else name)
    out = F.lit("")
    for pattern, known in reversed(SOURCE_NAMES):
        out = F.when(value.rlike(pattern), F.lit(known)).otherwise(out)
    for known in (*PRINCIPAL, *SUPPLEMENTARY):
        out = F.when(value == _plain(F.lit(known)), F.lit(known)).otherwise(out)
    return F.when(value == "", "").otherwise(out)


def tier(canonical: Column) -> Column:
    return F.when(canonical.isin(list(PRINCIPAL)), "principal").when(canonical.isin(list(SUPPLEMENTARY)), "supplementary").otherwise("unknown")


def source_evidence(name: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in (PRINCIPAL | SUPPLEMENTARY).items() for x in pair])
    return F.coalesce(F.try_element_at(known, canonical_source(name)), F.lit(""))


def source_audit(searches: DataFrame) -> DataFrame:
    """A row for each source: tier, records, searches, the names seen (in order) and its share of all records."""
    name = F.coalesce("database", F.lit(""))
    known = canonical_source(name)
    label = F.when(known != "", known).when(name != "", name).otherwise("(unnamed source)")
    rows = searches.select("ord", name.alias("name"), label.alias("source"), tier(known).alias("tier"), F.coalesce("records_retrieved", F.lit(0)).alias("n"))
    spelled = rows.where("name <> ''").groupBy("source", "name").agg(F.min("ord").alias("ord")).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names_seen"))
    out = rows.groupBy("source", "tier").agg(F.sum("n").alias("records"), F.count("*").alias("searches")).join(spelled, "source", "left")
    total = rows.agg(F.sum("n").alias("total"))
    out = out.crossJoin(F.broadcast(total))  # one row
    return out.select("source", "tier", "records", "searches", F.coalesce("names_seen", F.array().cast("array<string>")).alias("names_seen"), F.when(F.col("total") > 0, F.col("records") / F.col("total")).otherwise(0.0).alias("share"))


def audit_warnings(audit: DataFrame) -> list[tuple[str, str]]:
    """(level, code) of what a reviewer must be told; from the small audit frame."""
    rows = audit.collect()
    principal = [r["source"] for r in rows if r["tier"] == "principal"]
    share = sum(r["share"] for r in rows if r["tier"] == "supplementary")
    out = []
    if not principal:
        out.append(("critical", "no_principal"))
    elif len(principal) == 1:
        out.append(("warning", "single_principal"))
    if share > 0.5:
        out.append(("warning", "supplementary_majority"))
    if any(r["tier"] == "unknown" for r in rows):
        out.append(("warning", "unclassified_source"))
    if any(PRINCIPAL.get(s) in ("platform", "field-convention") for s in principal):
        out.append(("note", "tier_provenance"))
    return out


# --- integrity


def integrity(records: DataFrame) -> DataFrame:
    """(ord, uid, flag, excluding, notice) of the records that are flagged."""
    flag = fields.integrity_flag("doc_type", "title")
    return records.select("ord", "uid", flag.alias("flag")).where("flag is not null").withColumns({"excluding": F.col("flag").isin(fields.EXCLUDING), "notice": F.col("flag").isin(fields.NOTICES)})


def integrity_counts(records: DataFrame) -> DataFrame:
    return integrity(records).groupBy("flag").agg(F.count("*").alias("n"))


def retractions(records: DataFrame, works: DataFrame) -> DataFrame:
    """(uid, doi, status) against ``works`` (doi, type, updated_by array, update_to array): checked, retracted, notice,
    no_doi or not_found."""
    bad = F.array(F.lit("retraction"), F.lit("withdrawal"))
    lower = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    known = works.groupBy(fields.doi("doi").alias("doi")).agg(F.max(F.arrays_overlap(lower(F.col("updated_by")), bad)).alias("retracted"), F.max((F.lower(F.coalesce("type", F.lit(""))) == "retraction") | F.arrays_overlap(lower(F.col("update_to")), bad)).alias("notice"))
    out = records.select("uid", "doi").join(known, "doi", "left")
    status = F.when(F.col("doi") == "", "no_doi").when(F.col("retracted").isNull(), "not_found").when(F.col("retracted"), "retracted").when(F.col("notice"), "notice").otherwise("checked")
    return out.select("uid", "doi", status.alias("status"))


# --- cited references


def reference_entries(records: DataFrame) -> DataFrame:
    """(ord, key) of each entry of each record's references."""
    return records.select("ord", F.explode("references").alias("entry")).select("ord", fields.reference_key(F.col("entry")).alias("key"))


def cited_dois(records: DataFrame) -> DataFrame:
    """(doi, n): how many records cite it."""
    found = reference_entries(records).where(F.col("key").startswith("doi:")).distinct()
    return found.groupBy(F.expr("substring(key, 5)").alias("doi")).agg(F.count("*").alias("n"))


def cited_but_absent(records: DataFrame, min_citing: int = 1) -> DataFrame:
    present_ = records.select(fields.doi("doi").alias("own")).where("own <> ''").distinct()
    cited = cited_dois(records).where(F.col("n") >= min_citing).withColumn("own", fields.doi("doi"))
    return cited.join(present_, "own", "left_anti").select("doi", "n").orderBy(F.desc("n"), "doi")


def reference_coverage(records: DataFrame) -> DataFrame:
    doi_entries = F.size(F.filter("references", lambda e: fields.reference_key(e).startswith("doi:")))
    return records.agg(F.count("*").alias("records"), F.count(F.when(F.size("references") > 0, 1)).alias("records_with_references"), F.coalesce(F.sum(F.size("references")), F.lit(0)).cast("long").alias("reference_entries"), F.coalesce(F.sum(doi_entries), F.lit(0)).cast("long").alias("entries_with_doi"))


# --- profile


def corpus_profile(records: DataFrame) -> DataFrame:
    """One row: completeness, median title words and authors, share of preprints and of titles with diacritics."""
    words = F.size(F.filter(F.split(fields.squeeze(F.col("title")), " "), lambda w: w != ""))
    preprint = F.concat_ws(" ", "doc_type", "journal").rlike(fields.PREPRINT)
    parts = [percent(present(f)).alias(f"pct_{f}") for f in ("doi", "pmid", "abstract", "authors", "year", "journal", "pages", "volume")]
    marks = column(has_diacritics, "title", returns="boolean")
    return records.withColumn("_words", words).withColumn("_marks", marks).agg(F.count("*").alias("n"), *parts, F.median("_words").alias("median_title_words"), F.median(F.size("authors")).alias("median_authors"), percent(preprint).alias("pct_preprint"), percent(F.col("_marks")).alias("pct_diacritics"))


# --- enrichment


def recover_abstracts(records: DataFrame, works: DataFrame, min_len: int = 250) -> DataFrame:
    """Records with short abstracts and a DOI get a longer abstract and missing identifiers from ``works`` (doi,
    openalex_id, pmid, inverted map<string,array<int>>). Of records with one DOI, the last in input order is filled."""
    short = (F.col("doi") != "") & (F.length("abstract") < min_len)
    last = records.where(short).groupBy("doi").agg(F.max("ord").alias("ord"))
    found = works.select(fields.doi("doi").alias("doi"), "openalex_id", "pmid", fields.rebuilt_abstract(F.col("inverted")).alias("text"))
    best = found.where("doi <> ''").groupBy("doi").agg(F.max_by("text", F.length("text")).alias("_text"), F.max("openalex_id").alias("_oa"), F.max("pmid").alias("_pmid"))
    got = records.join(last.join(best, "doi").select("ord", "_text", "_oa", "_pmid"), "ord", "left")
    longer = F.coalesce(F.length("_text") > F.length("abstract"), F.lit(False))
    note = F.struct(F.lit("OpenAlex").alias("database"), F.lit("enrichment").alias("search_id"), F.lit("abstract_recovery").alias("source_id"))
    fill = lambda c, v: F.when(F.col(c) == "", F.coalesce(F.col(v), F.lit(""))).otherwise(F.col(c))
    out = got.withColumns({"provenance": F.when(longer, F.array_append("provenance", note)).otherwise(F.col("provenance")), "abstract": F.when(longer, F.col("_text")).otherwise(F.col("abstract")), "openalex_id": fill("openalex_id", "_oa"), "pmid": fill("pmid", "_pmid")})
    return out.select(*records.columns)


def quality_csv(found: DataFrame, path: str) -> None:
    """``quality_rounded`` as one CSV file, a row for each source, by name."""
    found.orderBy("source").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def source_note(name: Column | str) -> Column:
    """What the registry says of a source in words."""
    known, evidence = canonical_source(name), source_evidence(name)
    words = {"listed": "listed as suitable as a principal source", "platform": "listed as a platform; it depends on the databases chosen there", "field-convention": "used as a principal source by convention of its field", "not-assessed": "not assessed; supplementary", "not-principal": "assessed as not suitable as a principal source"}
    text = F.try_element_at(F.create_map(*[F.lit(x) for p in words.items() for x in p]), evidence)
    return F.when(known == "", "unknown source").otherwise(F.concat(known, F.lit(": "), F.coalesce(text, F.lit(""))))


# --- flow


FLOW = ("identified", "duplicates_removed", "automation_excluded", "other_excluded", "records_excluded", "reports_not_retrieved", "fulltext_excluded", "studies_included")


def flow(spark: SparkSession, **given: int) -> DataFrame:
    """One row: the counts given (FLOW; missing ones 0) and those that follow, with what does not add up."""
    row = spark.createDataFrame([tuple(int(given.get(c, 0)) for c in FLOW)], ", ".join(f"{c} long" for c in FLOW))
    row = row.withColumn("records_screened", F.expr("identified - duplicates_removed - automation_excluded - other_excluded"))
    row = row.withColumn("reports_sought", F.expr("records_screened - records_excluded")).withColumn("reports_assessed", F.expr("reports_sought - reports_not_retrieved"))
    problems = [F.when(F.col(c) < 0, F.lit(f"negative: {c}")) for c in FLOW]
    problems += [F.when(F.col("records_screened") < 0, F.lit("removed before screening exceeds identified")), F.when(F.col("reports_sought") < 0, F.lit("excluded exceeds screened")), F.when(F.col("reports_assessed") < 0, F.lit("not retrieved exceeds sought")), F.when(F.expr("reports_assessed - fulltext_excluded <> studies_included"), F.lit("assessed minus excluded is not included"))]
    return row.withColumn("problems", F.filter(F.array(*problems), lambda p: p.isNotNull()))


def markdown(frame: DataFrame, most: int = 10_000) -> str:
    """A frame of at most ``most`` rows as a Markdown table; of a longer one the first rows, and how many there are."""
    rows = frame.limit(most + 1).collect()
    over = len(rows) > most
    rows = [tuple(r) for r in rows[:most]] + ([("...", *[""] * (len(frame.columns) - 2), f"{frame.count()} rows")[: len(frame.columns)]] if over else [])
    head = f"| {' | '.join(frame.columns)} |\n|{'---|' * len(frame.columns)}"
    return "\n".join([head, *[f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows]])


def flow_svg(row) -> str:
    """The flow diagram of a ``flow`` row: a box for each stage, what leaves it to the right."""
    from html import escape

    boxes = [("Records identified", row["identified"], f"Duplicates removed: {row['duplicates_removed']}; by automation: {row['automation_excluded']}; other: {row['other_excluded']}"), ("Records screened", row["records_screened"], f"Excluded: {row['records_excluded']}"), ("Reports sought", row["reports_sought"], f"Not retrieved: {row['reports_not_retrieved']}"), ("Reports assessed", row["reports_assessed"], f"Excluded: {row['fulltext_excluded']}"), ("Studies included", row["studies_included"], "")]
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="720" height="{100 * len(boxes)}" font-family="sans-serif" font-size="13">']
    for i, (name, n, side) in enumerate(boxes):
        y = 100 * i + 10
        parts.append(f'<rect x="10" y="{y}" width="240" height="60" fill="none" stroke="black"/><text x="20" y="{y + 35}">{escape(name)} (n = {n})</text>')
        if side:
            parts.append(f'<rect x="300" y="{y}" width="410" height="60" fill="none" stroke="black"/><text x="310" y="{y + 35}">{escape(side)}</text><path d="M250 {y + 30}H300" stroke="black"/>')
        if i + 1 < len(boxes):
            parts.append(f'<path d="M130 {y + 60}V{y + 100}" stroke="black"/>')
    return "".join([*parts, "</svg>"])


def search_appendix(searches: DataFrame, queries: dict[str, str] | None = None) -> str:
    """The log of searches as Markdown: each search with its database, platform, query, limits, date and count."""
    rows = searches.orderBy("ord").collect()  # a row for each search that a person ran
    have = set(searches.columns)
    parts = ["## Searches", ""]
    for n, r in enumerate(rows, 1):
        parts.append(f"### {n}. {r['database'] or 'unnamed source'}")
        for label, c in (("Platform", "platform"), ("Interface", "interface"), ("Query", "query"), ("Limits", "filters"), ("Date", "date_run"), ("Address", "url"), ("Notes", "notes"), ("Records", "records_retrieved")):
            value = r[c] if c in have else None
            if value not in (None, ""):
                parts.append(f"- {label}: {value}")
        parts.append("")
    for name, text in (queries or {}).items():
        parts += [f"### Query for {name}", "", "```", str(text), "```", ""]
    return "\n".join(parts)
