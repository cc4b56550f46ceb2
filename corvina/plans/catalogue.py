"""Queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.text import column, normalize_title, surname
from ..operators import blocking, dedup, export, harvest, identity, match, reports, search, validate
from ..tables import written
from .registry import NORM_SQL, ORACLE, QUERIES, query, records_of


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    names = F.array(*map(F.lit, ["Scopus", "PubMed (via NCBI)", "OpenAlex API", "Clarivate Web of Science", "My Library"]))
    return nations.select(F.col("n_nationkey").cast("long").alias("ord"), F.get(names, F.col("n_nationkey") % 5).alias("database"), (F.col("n_nationkey") * 10).cast("long").alias("records_retrieved"))


SEARCHES_SQL = """searches AS (SELECT n_nationkey AS ord, (['Scopus', 'PubMed (via NCBI)', 'OpenAlex API', 'Clarivate Web of Science', 'My Library'])[n_nationkey % 5 + 1] AS database, CAST(n_nationkey * 10 AS BIGINT) AS records_retrieved FROM nation)"""

# --- fields


def _forms(forms: list[tuple]) -> list:
    """Columns of cases that records take in turn, by ord."""
    at = (F.col("ord") % len(forms)).cast("int")
    return [F.get(F.array(*[F.lit(f[k]) for f in forms]), at) for k in range(len(forms[0]))]


def _forms_sql(forms: list[tuple], k: int) -> str:
    """The k-th value of each case in SQL."""
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"([{', '.join(shown(f[k]) for f in forms)}])[ord % {len(forms)} + 1]"


#: What stands before and behind a DOI.
_DOI_FORMS = [("", ""), ("https://doi.org/", ""), ("http://dx.doi.org/", "."), ("DOI: ", ";"), ("doi:", ","), (" ", " "), ("doi.org/", ""), ("NA ", ""), ("x", ""), ("10.12/", ""), ("no ", " x")]


@query(f"SELECT uid, {_forms_sql(_DOI_FORMS, 0)} || replace(upper(doi), '/', CASE WHEN ord % 4 = 0 THEN '%2F' WHEN ord % 4 = 1 THEN '%252F' ELSE '/' END) || {_forms_sql(_DOI_FORMS, 1)} AS given, doi FROM records")
def normalize_doi(spark, sf_dir):
    """DOIs as people write them: resolvers, labels, marks behind, escaped once or twice, shouted."""
    before, after = _forms(_DOI_FORMS)
    slash = F.when(F.col("ord") % 4 == 0, "%2F").when(F.col("ord") % 4 == 1, "%252F").otherwise("/")
    given = F.concat(before, F.replace(F.upper("doi"), F.lit("/"), slash), after)
    return records_of(spark, sf_dir).select("uid", given.alias("given"), fields.doi(given).alias("doi"))


@query("SELECT uid, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(title, 'ß', 'ss'))), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS norm_title FROM records")
def normalize_titles(spark, sf_dir):
    return records_of(spark, sf_dir).select("uid", column(normalize_title, "title").alias("norm_title"))


@query("SELECT uid, CASE WHEN len(authors) = 0 THEN '' ELSE trim(regexp_replace(regexp_replace(lower(strip_accents(replace(split_part(authors[1], ',', 1), 'ß', 'ss'))), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) END AS surname FROM records")
def surnames(spark, sf_dir):
    first = F.coalesce(F.get("authors", F.lit(0)), F.lit(""))
    return records_of(spark, sf_dir).select("uid", column(surname, first).alias("surname"))


@query("SELECT uid, pages AS cleaned, regexp_extract(pages, '[0-9]+', 0) AS first_page, regexp_extract(pages, '[0-9]+', 0) AS digits, regexp_extract(pages, '^1-([0-9]{1,3})$', 1) NOT IN ('', '1') AS pseudo FROM records")
def pages_fields(spark, sf_dir):
    spaced = F.replace("pages", F.lit("-"), F.lit(" -- "))
    return records_of(spark, sf_dir).select("uid", fields.clean_pages(spaced).alias("cleaned"), fields.first_page("pages").alias("first_page"), fields.page_digits("pages").alias("digits"), fields.pseudo_range("pages").alias("pseudo"))


#: A year's cell and the year; a number's cell and the number.
_YEARS = [("2001.0", 2001), ("c1998", 1998), ("(2020) June", 2020), ("", None), ("n.d.", None), ("1500", 1500), ("12/2011", 2011), ("20", None), (" 1999 ", 1999), ("2019-05-06", 2019), ("in press", None)]
_NUMBERS = [("1,234", 1234), ("12 345", 12345), ("-5", -5), ("7.0", 7), ("", None), ("cited 17 times", 17), ("none", None), ("0", 0), ("3.5", 3)]


@query(f"SELECT uid, CAST({_forms_sql(_YEARS, 1)} AS INTEGER) AS y, CAST({_forms_sql(_NUMBERS, 1)} AS INTEGER) AS n FROM records")
def parse_numbers(spark, sf_dir):
    return records_of(spark, sf_dir).select("uid", fields.parse_year(_forms(_YEARS)[0]).alias("y"), fields.parse_int(_forms(_NUMBERS)[0]).alias("n"))


#: A label and the document type that it names.
_LABELS = [
    ("Systematic  Review", "review"), ("Meta-Analysis", "review"), ("Working Paper", "preprint"), ("Submitted manuscript", "preprint"), ("Conference Paper", "conference"), ("PROCEEDINGS", "conference"), ("Meeting Abstract", "conference"),
    ("Book Chapter", "chapter"), ("inbook", "chapter"), ("PhD Dissertation", "thesis"), ("Technical Report", "report"), ("Practice Guideline", "report"), ("Erratum", "editorial"), ("Note", "editorial"), ("Letter", "letter"), ("Comment", "letter"),
    ("Monograph", "book"), ("Journal Article", "article"), ("Original Research", "article"), ("Data Paper", "article"), ("", ""), ("Patent", ""), ("Review of a book", "review"), ("Letter to the editor, short survey", "review"),
]


@query(f"SELECT uid, {_forms_sql(_LABELS, 1)} AS mapped FROM records")
def doc_type_map(spark, sf_dir):
    return records_of(spark, sf_dir).select("uid", fields.doc_type(_forms(_LABELS)[0]).alias("mapped"))


@query("SELECT uid, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(title, '[^ -~]', 'z', 'g') || ' Part ' || volume, '(?i)\\bq[1-4]\\b|\\b(?:part|vol|volume|no|number|issue|wave|round|edition|ed)\\.?\\s*(?:[ivxlcdm]+|\\d+)\\b'), lambda x: lower(x)))), '|') AS markers FROM records")
def period_markers(spark, sf_dir):
    title = F.concat("title", F.lit(" Part "), "volume")
    return records_of(spark, sf_dir).select("uid", F.array_join(fields.period_markers(title), "|").alias("markers"))


#: Titles and whether they are nothing but an identifier; venues of meetings; pages that a spreadsheet has made dates.
_TITLES = [("10.1000/abc", True), (" doi: 10.1000/x ", True), ("https://doi.org/10.1/x y", False), ("hdl.handle.net/1/2", True), ("urn:nbn:de:1", True), ("ISBN 978-3-16-148410-0", True), ("https://x.org/a", True), ("A plain title", False), ("", False), ("10.1000/a b", False), ("ISBN", False)]
_VENUES = [("Annual Meeting of Things", True), ("Proceedings of X", True), ("Things", False), ("J Supplement 2", True), ("Suppl to Y", True), ("Abstracts", True), ("World Congress", True), ("Symposia", False), ("Annual Scientific Session", True), ("", False), ("Supple Things", False), ("Conferences", False)]
_PAGES = [("11-Sep", True), ("Nov-19", True), ("11-19", False), ("1 dec", True), ("March/12", True), ("", False), ("S3-Sep", False), ("sept-5", True), ("12345-may", False), ("may", False)]


@query(f"SELECT uid, {_forms_sql(_TITLES, 1)} AS only_id, {_forms_sql(_VENUES, 1)} AS venue, {_forms_sql(_PAGES, 1)} AS mangled FROM records")
def title_and_venue_flags(spark, sf_dir):
    title, venue, pages = (_forms(x)[0] for x in (_TITLES, _VENUES, _PAGES))
    return records_of(spark, sf_dir).select("uid", fields.identifier_title(title).alias("only_id"), fields.conference_venue(venue).alias("venue"), fields.mangled_pages(pages).alias("mangled"))


@query("SELECT ord, round(CAST((CASE WHEN title <> '' THEN 1.0 ELSE 0 END) + (CASE WHEN doi <> '' THEN 1.0 ELSE 0 END) + 1.0 + 1.0 + (CASE WHEN pages <> '' THEN 1.0 ELSE 0 END) + (CASE WHEN doc_type <> '' THEN 1.0 ELSE 0 END) + (CASE WHEN language <> '' THEN 1.0 ELSE 0 END) + (CASE WHEN year IS NOT NULL THEN 1.0 ELSE 0 END) + (CASE WHEN len(authors) > 0 THEN 1.1 ELSE 0 END) + (CASE WHEN len(keywords) > 0 THEN 1.0 ELSE 0 END) + least(length(abstract), 3000) / 1000.0 AS DOUBLE), 6) AS rich FROM records")
def rich_records(spark, sf_dir):
    return records_of(spark, sf_dir).select("ord", F.round(fields.richness(), 6).alias("rich"))


@query("SELECT uid, CASE WHEN doi <> '' THEN 'doi:' || doi WHEN pmid <> '' THEN 'pmid:' || pmid ELSE 'sid:' || source || ':' || source_id END AS key FROM records")
def record_keys(spark, sf_dir):
    return records_of(spark, sf_dir).select("uid", fields.record_key(F.col("title")).alias("key"))


# --- links, clusters


@query("SELECT a.ord, b.owner, a.kind, a.value, b.members FROM (SELECT ord, 'doi' AS kind, doi AS value FROM records WHERE doi <> '' UNION ALL SELECT ord, 'pmid', pmid FROM records WHERE pmid <> '') a JOIN (SELECT kind, value, min(ord) AS owner, count(*) AS members FROM (SELECT ord, 'doi' AS kind, doi AS value FROM records WHERE doi <> '' UNION ALL SELECT ord, 'pmid', pmid FROM records WHERE pmid <> '') GROUP BY kind, value) b USING (kind, value) WHERE a.ord <> b.owner")
def id_links(spark, sf_dir):
    return identity.id_links(records_of(spark, sf_dir)).select("ord", "owner", "kind", "value", "members")


@query("""SELECT ord, least(min(ord) OVER (PARTITION BY CASE WHEN doi <> '' THEN doi ELSE uid END), min(ord) OVER (PARTITION BY CASE WHEN pmid <> '' THEN 'p' || pmid ELSE uid END)) AS cluster FROM records""")
def id_components(spark, sf_dir):
    r = records_of(spark, sf_dir)
    return identity.clusters(r, identity.id_links(r), "owner", "ord")


@query("SELECT count(*) AS works FROM (SELECT DISTINCT least(min(ord) OVER (PARTITION BY CASE WHEN doi <> '' THEN doi ELSE uid END), min(ord) OVER (PARTITION BY CASE WHEN pmid <> '' THEN 'p' || pmid ELSE uid END)) AS c FROM records)")
def unique_works(spark, sf_dir):
    """How many works, by identifier."""
    r = records_of(spark, sf_dir)
    return identity.clusters(r, identity.id_links(r), "owner", "ord").agg(F.countDistinct("cluster").alias("works"))


@query(f"""SELECT DISTINCT least(a.ord, b.ord) AS i, greatest(a.ord, b.ord) AS j FROM
  (SELECT ord, token FROM (SELECT ord, token, df, row_number() OVER (PARTITION BY ord ORDER BY df, token) AS rk FROM
     (SELECT ord, token, count(*) OVER (PARTITION BY token) AS df FROM (SELECT DISTINCT ord, unnest(string_split({NORM_SQL.format("title")}, ' ')) AS token FROM records) WHERE length(token) > 2)) WHERE rk <= 4 AND df <= 400) a
  JOIN (SELECT DISTINCT ord, unnest(string_split({NORM_SQL.format("title")}, ' ')) AS token FROM records) b USING (token) WHERE a.ord <> b.ord""")
def token_block_pairs(spark, sf_dir):
    r = blocking.with_norms(records_of(spark, sf_dir))
    held = blocking.tokens(r)
    probes = blocking.ranked_tokens(held).where("df <= 400")
    return blocking._pairs(probes, held.join(probes.select("token").distinct(), "token", "left_semi"), "token")


@query()
def dedup_clusters(spark, sf_dir):
    return dedup.deduplicate(records_of(spark, sf_dir)).clusters


@query()
def dedup_decisions(spark, sf_dir):
    return dedup.deduplicate(records_of(spark, sf_dir)).decisions.drop("place")


@query()
def dedup_records(spark, sf_dir):
    return dedup.deduplicate(records_of(spark, sf_dir)).records.drop("provenance")


@query()
def dedup_overlap(spark, sf_dir):
    return dedup.deduplicate(records_of(spark, sf_dir)).overlap


@query("SELECT least(a.source, b.source) AS source_a, greatest(a.source, b.source) AS source_b, count(*) AS n FROM (SELECT ord, source, min(ord) OVER (PARTITION BY CASE WHEN doi <> '' THEN doi ELSE uid END) AS c FROM records) a JOIN records b ON a.c = b.ord WHERE a.ord <> b.ord AND a.source <> b.source GROUP BY 1, 2")
def overlap_by_doi(spark, sf_dir):
    r = records_of(spark, sf_dir)
    links = identity.id_links(r).where("kind = 'doi'")
    return dedup.overlap(r, identity.clusters(r, links, "owner", "ord"))


@query("SELECT c AS ord, max(length(abstract)) AS longest, max(cited_by) AS cited_by, count(*) AS members FROM (SELECT *, min(ord) OVER (PARTITION BY CASE WHEN doi <> '' THEN doi ELSE uid END) AS c FROM records) GROUP BY c")
def merged_by_doi(spark, sf_dir):
    r = records_of(spark, sf_dir)
    clusters = identity.clusters(r, identity.id_links(r).where("kind = 'doi'"), "owner", "ord")
    sizes = clusters.groupBy(F.col("cluster").alias("ord")).agg(F.count("*").alias("members"))
    return dedup.merge_clusters(r, clusters).join(sizes, "ord").select("ord", F.length("abstract").alias("longest"), "cited_by", "members")


# --- filters


@query(f"SELECT uid FROM (SELECT uid, year, doc_type, {NORM_SQL.format("title || ' ' || abstract || ' ' || array_to_string(keywords, ' ')")} AS hay FROM records) WHERE (year IS NULL OR year BETWEEN 1995 AND 2010) AND doc_type IN ('article', 'review') AND (hay LIKE '%ion%' OR hay LIKE '%eau%') AND (hay LIKE '%the%' OR hay LIKE '%ich%')")
def local_boolean_filter(spark, sf_dir):
    q = search.SearchQuery([["ion", "éau"], ["the", "ich"], []], years=(1995, 2010), doc_types=["article", "review"])
    return q.filter(records_of(spark, sf_dir)).select("uid")


# --- reports


_PRESENT = {"doi": "doi <> ''", "abstract": "abstract <> ''", "year": "year IS NOT NULL", "authors": "len(authors) > 0", "issn": "false", "language": "language <> ''", "keywords": "len(keywords) > 0"}


@query(f"SELECT source, count(*) AS n, {', '.join(f'100.0 * count(CASE WHEN {c} THEN 1 END) / count(*) AS pct_{f}' for f, c in _PRESENT.items())}, coalesce(avg(CASE WHEN abstract <> '' THEN length(abstract) END), 0) AS mean_abstract_len FROM records GROUP BY source")
def quality_report(spark, sf_dir):
    return reports.quality(records_of(spark, sf_dir))


_ROUND = "CASE WHEN {0} * 10 - floor({0} * 10) = 0.5 AND floor({0} * 10) % 2 = 0 THEN floor({0} * 10) / 10 ELSE round({0}, 1) END"


@query(f"SELECT source, n, {', '.join(f'{_ROUND.format(f)} AS {f}' for f in [*(f'pct_{f}' for f in _PRESENT), 'mean_abstract_len'])} FROM (SELECT source, count(*) AS n, {', '.join(f'100.0 * count(CASE WHEN {c} THEN 1 END) / count(*) AS pct_{f}' for f, c in _PRESENT.items())}, coalesce(avg(CASE WHEN abstract <> '' THEN length(abstract) END), 0) AS mean_abstract_len FROM records GROUP BY source)")
def quality_report_rounded(spark, sf_dir):
    return reports.quality_rounded(records_of(spark, sf_dir))


@query(f"WITH {SEARCHES_SQL} SELECT database, CAST(sum(records_retrieved) AS BIGINT) AS records FROM searches GROUP BY database", records=False)
def identified_by_source(spark, sf_dir):
    return reports.by_source(_searches(spark, sf_dir))


@query(f"""WITH {SEARCHES_SQL}, named AS (SELECT *, CASE database WHEN 'PubMed (via NCBI)' THEN 'PubMed/MEDLINE' WHEN 'OpenAlex API' THEN 'OpenAlex' WHEN 'Clarivate Web of Science' THEN 'Web of Science Core Collection' ELSE database END AS source FROM searches)
SELECT source, CASE source WHEN 'OpenAlex' THEN 'supplementary' WHEN 'My Library' THEN 'unknown' ELSE 'principal' END AS tier, CAST(sum(records_retrieved) AS BIGINT) AS records, count(*) AS searches, [min(database)] AS names_seen, sum(records_retrieved) / (SELECT sum(records_retrieved) FROM searches) AS share FROM named GROUP BY source""", records=False)
def source_audit(spark, sf_dir):
    return reports.source_audit(_searches(spark, sf_dir))


#: What stands before a title, the document type, and the flag that follows.
_FLAGS = [
    ("RETRACTED: ", "", "retracted"), ("Retracted article - ", "", "retracted"), ("[Retracted]: ", "", "retracted"), ("Retraction note: ", "", "retraction_notice"), ("Retraction: ", "", "retraction_notice"), ("This article has been retracted ", "", "retraction_notice"),
    ("Withdrawn - ", "", "withdrawn"), ("Withdrawal notice: ", "", "withdrawn"), ("Expression of  concern about ", "", "concern"), ("Corrigendum to ", "", "erratum"), ("Erratum: ", "", "erratum"), ("On ", "", None), ("Withdrawing ", "", None),
    ("On ", "Retracted Publication", "retracted"), ("On ", "correction", "erratum"), ("RETRACTED: ", "Withdrawn", "withdrawn"), ("The retracted article ", "", "retracted"),
]


@query(f"SELECT flag, count(*) AS n FROM (SELECT {_forms_sql(_FLAGS, 2)} AS flag FROM records) WHERE flag IS NOT NULL GROUP BY 1")
def integrity_flags(spark, sf_dir):
    lead, kind, _ = _forms(_FLAGS)
    return reports.integrity_counts(records_of(spark, sf_dir).withColumns({"title": F.concat(lead, "title"), "doc_type": kind}))


_CITED = "cited AS (SELECT DISTINCT ord, substr(key, 5) AS doi FROM (SELECT ord, 'doi:' || unnest(list_filter(refs, lambda x: x LIKE '10.5555/%')) AS key FROM records))"


@query(f", {_CITED} SELECT doi, count(*) AS n FROM cited GROUP BY doi")
def cited_dois(spark, sf_dir):
    return reports.cited_dois(records_of(spark, sf_dir))


@query(f", {_CITED} SELECT doi, count(*) AS n FROM cited WHERE doi NOT IN (SELECT doi FROM records) GROUP BY doi HAVING count(*) >= 2")
def cited_but_absent(spark, sf_dir):
    return reports.cited_but_absent(records_of(spark, sf_dir), 2)


@query("SELECT count(*) AS records, count(CASE WHEN ord % 3 > 0 THEN 1 END) AS records_with_references, CAST(sum(CASE ord % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) AS BIGINT) AS reference_entries, count(CASE WHEN ord % 3 = 1 THEN 1 END) AS entries_with_doi FROM records")
def reference_coverage(spark, sf_dir):
    some = F.when(F.col("ord") % 3 == 0, F.array().cast("array<string>")).when(F.col("ord") % 3 == 1, F.col("references")).otherwise(F.slice("references", 2, 1))
    return reports.reference_coverage(records_of(spark, sf_dir).withColumn("references", some))


@query(f"SELECT count(*) AS n, {', '.join(f'100.0 * count(CASE WHEN {c} THEN 1 END) / count(*) AS pct_{f}' for f, c in (_PRESENT | {'pmid': chr(112) + 'mid <> ' + chr(39) * 2, 'journal': 'true', 'pages': 'pages <> ' + chr(39) * 2, 'volume': 'true'}).items() if f in ('doi', 'pmid', 'abstract', 'authors', 'year', 'journal', 'pages', 'volume'))}, median(len(list_filter(string_split(title, ' '), lambda x: x <> ''))) AS median_title_words, median(len(authors)) AS median_authors, CAST(0 AS DOUBLE) AS pct_preprint, 100.0 * count(CASE WHEN strip_accents(title) <> title OR regexp_matches(title, '[łŁøØđßæœ]') THEN 1 END) / count(*) AS pct_diacritics FROM records")
def corpus_profile(spark, sf_dir):
    return reports.corpus_profile(records_of(spark, sf_dir))


@query("SELECT uid, doi, CASE WHEN doi = '' THEN 'no_doi' WHEN doi NOT IN (SELECT doi FROM records WHERE ord % 3 < 2 AND doi <> '') THEN 'not_found' WHEN doi IN (SELECT doi FROM records WHERE ord % 3 = 0 AND doi <> '') THEN 'retracted' ELSE 'checked' END AS status FROM records")
def retraction_join(spark, sf_dir):
    r = records_of(spark, sf_dir)
    works = r.where("ord % 3 < 2 and doi <> ''").select(F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.lit("journal-article").alias("type"), F.when(F.col("ord") % 3 == 0, F.array(F.lit("Retraction"))).otherwise(F.array().cast("array<string>")).alias("updated_by"), F.array().cast("array<string>").alias("update_to"))
    return reports.retractions(r, works)


@query("SELECT ord, CASE WHEN ord = last AND length(abstract) < 250 THEN length(abstract) + 300 ELSE length(abstract) END AS n FROM (SELECT *, CASE WHEN doi = '' THEN -1 ELSE max(CASE WHEN length(abstract) < 250 THEN ord END) OVER (PARTITION BY doi) END AS last FROM records)")
def enrich_left_join(spark, sf_dir):
    r = records_of(spark, sf_dir)
    long_ = F.concat("abstract", F.repeat(F.lit("x"), F.lit(300)))
    works = r.where("doi <> ''").groupBy("doi").agg(F.first(long_).alias("t")).select("doi", F.lit("W1").alias("openalex_id"), F.lit("").alias("pmid"), F.create_map("t", F.array(F.lit(0))).alias("inverted"))
    return reports.recover_abstracts(r, works).select("ord", F.length("abstract").alias("n"))


@query("SELECT uid, array_to_string(list_filter(string_split(title, ' '), lambda x: x <> ''), ' ') AS text FROM records")
def abstract_rebuild(spark, sf_dir):
    words = records_of(spark, sf_dir).select("uid", F.posexplode_outer(F.filter(F.split("title", " "), lambda w: w != "")))
    entries = words.groupBy("uid", "col").agg(F.collect_list("pos").alias("at")).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", "at")))).alias("m"))
    return entries.select("uid", fields.rebuilt_abstract(F.col("m")).alias("text"))


@query("""SELECT n AS identified, d AS duplicates_removed, n - d AS records_screened, e AS records_excluded, n - d - e AS reports_sought, r AS reports_not_retrieved, n - d - e - r AS reports_assessed, CAST(CASE WHEN n - d - e - r - 1 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS n_problems
FROM (SELECT count(*) AS n, count(*) - count(DISTINCT CASE WHEN doi <> '' THEN doi ELSE uid END) AS d, count(CASE WHEN year < 2000 THEN 1 END) AS e, count(CASE WHEN pages = '' AND year >= 2010 THEN 1 END) AS r FROM records)""")
def prisma_counts(spark, sf_dir):
    """A flow whose counts come from the records; one study less than assessed is a problem that it must name."""
    r = records_of(spark, sf_dir)
    got = r.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("doi") != "", F.col("doi")).otherwise(F.col("uid"))).alias("u"), F.count(F.when(F.col("year") < 2000, 1)).alias("e"), F.count(F.when((F.col("pages") == "") & (F.col("year") >= 2010), 1)).alias("r")).first()
    row = reports.flow(spark, identified=got["n"], duplicates_removed=got["n"] - got["u"], records_excluded=got["e"], reports_not_retrieved=got["r"], studies_included=1)
    return row.select("identified", "duplicates_removed", "records_screened", "records_excluded", "reports_sought", "reports_not_retrieved", "reports_assessed", F.size("problems").alias("n_problems"))


# --- harvests


def _two_harvests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records keyed by place alone; in the second some have come, gone, changed or got other counters."""
    r = records_of(spark, sf_dir).withColumns({"doi": F.lit(""), "pmid": F.lit(""), "source": F.lit(""), "cited_by": F.lit(0)})
    after = r.where("ord % 10 <> 2").withColumns({"volume": F.when(F.col("ord") % 11 == 0, "changed").otherwise(F.col("volume")), "cited_by": F.when(F.col("ord") % 7 == 0, 5).otherwise(F.col("cited_by"))})
    return r.where("ord % 10 <> 1"), after


_SURNAME = f"CASE WHEN len(authors) = 0 THEN '' ELSE {NORM_SQL.format("split_part(authors[1], ',', 1)")} END"
_PAYLOAD = """'{"doc_type":"' || lower(trim(doc_type)) || '","doi":"' || doi || '","first_author_surname":"' || surname || '","has_abstract":' || CASE WHEN trim(abstract) <> '' THEN 'true' ELSE 'false' END || ',"issn":"","issue":"","language":"' || lower(trim(language)) || '","n_authors":' || len(authors) || ',"norm_journal":"' || nj || '","norm_title":"' || nt || '","openalex_id":"","pages":"' || pages || '","pmid":"' || pmid || '","scopus_id":"","volume":"' || volume || '","year":' || coalesce(CAST(year AS VARCHAR), 'null') || '}'"""
_SUMS = f"""sums AS (SELECT ord, CASE WHEN doi <> '' THEN 'doi:' || doi WHEN pmid <> '' THEN 'pmid:' || pmid ELSE 'sid:' || source || ':' || source_id END AS key, sha256({_PAYLOAD}) AS checksum
  FROM (SELECT *, {_SURNAME} AS surname, {NORM_SQL.format("journal")} AS nj, {NORM_SQL.format("title")} AS nt FROM records))"""


@query(f", {_SUMS} SELECT * FROM sums")
def record_checksums(spark, sf_dir):
    return harvest.fingerprints(records_of(spark, sf_dir)).select("ord", "key", "checksum")


@query(f""", {_SUMS} SELECT sha256('["' || string_agg(checksum, '","' ORDER BY checksum) || '"]') AS checksum FROM sums""")
def corpus_checksum(spark, sf_dir):
    return harvest.corpus_checksum(harvest.fingerprints(records_of(spark, sf_dir)))


@query(f""", {_SUMS} SELECT sha256(string_agg(s, ',' ORDER BY lead)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT substr(checksum, 1, 1) AS lead, sha256(string_agg(checksum || ':' || n, ',' ORDER BY checksum)) AS s, sum(n) AS n FROM (SELECT checksum, count(*) AS n FROM sums GROUP BY checksum) GROUP BY 1)""")
def corpus_digest(spark, sf_dir):
    return harvest.corpus_digest(harvest.fingerprints(records_of(spark, sf_dir)))


@query("""SELECT key, change FROM (SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN a.o % 11 = 0 THEN 'changed' WHEN a.o % 7 = 0 THEN 'counters' ELSE 'unchanged' END AS change
FROM (SELECT 'sid::' || CAST(ord AS VARCHAR) AS key, ord AS o FROM records WHERE ord % 10 <> 1) a FULL JOIN (SELECT 'sid::' || CAST(ord AS VARCHAR) AS key, ord AS o FROM records WHERE ord % 10 <> 2) b ON a.key = b.key)""")
def harvest_drift(spark, sf_dir):
    r, after = _two_harvests(spark, sf_dir)
    return harvest.drift(harvest.fingerprints(r), harvest.fingerprints(after)).select("key", "change")


@query("""SELECT count(CASE WHEN k <> 2 OR ord % 10 <> 2 THEN 1 END) - count(CASE WHEN ord % 10 = 1 THEN 1 END) AS n_before, count(*) - count(CASE WHEN ord % 10 = 2 THEN 1 END) AS n_after, count(CASE WHEN ord % 10 = 1 THEN 1 END) AS added, count(CASE WHEN ord % 10 = 2 THEN 1 END) AS removed,
  count(CASE WHEN ord % 10 NOT IN (1, 2) AND ord % 11 = 0 THEN 1 END) AS changed, count(CASE WHEN ord % 10 NOT IN (1, 2) AND ord % 11 <> 0 AND ord % 7 = 0 THEN 1 END) AS counters, count(CASE WHEN ord % 10 NOT IN (1, 2) AND ord % 11 <> 0 AND ord % 7 <> 0 THEN 1 END) AS unchanged, false AS stable FROM (SELECT *, 0 AS k FROM records)""")
def drift_counts(spark, sf_dir):
    r, after = _two_harvests(spark, sf_dir)
    return harvest.drift_counts(harvest.drift(harvest.fingerprints(r), harvest.fingerprints(after)))


@query("SELECT uid, sha256('[\"https://x.org/q\",{\"page\":\"' || source_id || '\",\"q\":\"a b\"}]') AS key FROM records")
def request_keys(spark, sf_dir):
    params = F.create_map(F.lit("q"), F.lit("a b"), F.lit("page"), F.col("source_id"), F.lit("apiKey"), F.lit("secret"), F.lit("mailto"), F.lit("me@x.org"))
    return records_of(spark, sf_dir).select("uid", harvest.request_key(F.lit(" https://x.org/q"), params).alias("key"))


@query(f"SELECT ord, row_number() OVER (ORDER BY doi, {NORM_SQL.format('title')}, coalesce(year, -1), source, source_id, ord) AS place FROM records")
def sort_records(spark, sf_dir):
    from ..schema import numbered

    r = records_of(spark, sf_dir).withColumns({"given": F.col("ord"), "t": column(normalize_title, "title"), "y": F.coalesce("year", F.lit(-1))})
    return numbered(r, "doi", "t", "y", "source", "source_id", "given").select(F.col("given").alias("ord"), (F.col("ord") + 1).alias("place"))


# --- validation


_TRUTH = "truth AS (SELECT uid, doi AS work FROM records WHERE doi <> ''), clusters AS (SELECT uid, title AS cluster FROM records)"


@query(f""", {_TRUTH}, n AS (SELECT CAST(sum(CASE WHEN a.work = b.work AND a.cluster = b.cluster THEN 1 ELSE 0 END) AS BIGINT) AS pair_tp, CAST(sum(CASE WHEN a.work <> b.work THEN 1 ELSE 0 END) AS BIGINT) AS pair_fp,
  CAST(sum(CASE WHEN a.work = b.work AND a.cluster <> b.cluster THEN 1 ELSE 0 END) AS BIGINT) AS pair_fn FROM (truth JOIN clusters USING (uid)) a JOIN (truth JOIN clusters USING (uid)) b ON (a.cluster = b.cluster OR a.work = b.work) AND a.uid < b.uid)
SELECT pair_tp, pair_fp, pair_fn, pair_tp + pair_fn AS pair_truth, pair_tp / (pair_tp + pair_fp) AS precision, pair_tp / (pair_tp + pair_fn) AS recall, 2.0 * pair_tp / (2 * pair_tp + pair_fp + pair_fn) AS f1 FROM n""")
def pair_metrics(spark, sf_dir):
    r = records_of(spark, sf_dir)
    return validate.pair_metrics(r.select("uid", F.col("title").alias("cluster")), validate.truth(r))


@query(f", {_TRUTH}, j AS (SELECT *, uid = min(uid) OVER (PARTITION BY work) AS is_first FROM truth JOIN clusters USING (uid)), k AS (SELECT *, uid = coalesce(min(CASE WHEN is_first THEN uid END) OVER (PARTITION BY cluster), min(uid) OVER (PARTITION BY cluster)) AS keep FROM j) SELECT count(CASE WHEN NOT is_first AND NOT keep THEN 1 END) AS rec_tp, count(CASE WHEN is_first AND keep THEN 1 END) AS rec_tn, count(CASE WHEN is_first AND NOT keep THEN 1 END) AS rec_fp, count(CASE WHEN NOT is_first AND keep THEN 1 END) AS rec_fn FROM k")
def record_metrics(spark, sf_dir):
    r = records_of(spark, sf_dir)
    return validate.record_metrics(r.select("uid", F.col("title").alias("cluster")), validate.truth(r)).select("rec_tp", "rec_tn", "rec_fp", "rec_fn")


@query("SELECT n AS size, count(*) AS works FROM (SELECT doi, count(*) AS n FROM records WHERE doi <> '' GROUP BY doi) GROUP BY n")
def truth_groups(spark, sf_dir):
    return validate.truth_shape(validate.truth(records_of(spark, sf_dir)))




@query("SELECT a.work AS work_a, b.work AS work_b, a.volume AS cluster FROM (SELECT DISTINCT doi AS work, volume FROM records WHERE doi <> '') a JOIN (SELECT DISTINCT doi AS work, volume FROM records WHERE doi <> '') b ON a.volume = b.volume AND a.work < b.work")
def false_pairs(spark, sf_dir):
    r = records_of(spark, sf_dir)
    return validate.false_pairs(r.select("uid", F.col("volume").alias("cluster")), validate.truth(r)).select("work_a", "work_b", "cluster")


@query("SELECT a.work, a.source AS cluster_a, b.source AS cluster_b FROM (SELECT DISTINCT doi AS work, source FROM records WHERE doi <> '') a JOIN (SELECT DISTINCT doi AS work, source FROM records WHERE doi <> '') b ON a.work = b.work AND a.source < b.source")
def missed_pairs(spark, sf_dir):
    r = records_of(spark, sf_dir)
    return validate.missed_pairs(r.select("uid", F.col("source").alias("cluster")), validate.truth(r)).select("work", "cluster_a", "cluster_b")


@query("SELECT uid, array_to_string(w[1:greatest(4, CAST(floor(len(w) * 0.6) AS BIGINT))], ' ') AS title FROM (SELECT uid, list_filter(string_split(title, ' '), lambda x: x <> '') AS w FROM records) WHERE len(w) >= 8")
def perturb_truncated(spark, sf_dir):
    return validate.damaged(records_of(spark, sf_dir), "truncated_title").select("uid", "title")


@query("SELECT uid, CASE WHEN b BETWEEN 1 AND 12 AND a BETWEEN 1 AND 31 THEN CAST(a AS VARCHAR) || '-' || m[b] ELSE m[a] || '-' || lpad(CAST(b AS VARCHAR), 2, '0') END AS pages FROM (SELECT uid, CAST(split_part(pages, '-', 1) AS INTEGER) AS a, CAST(split_part(pages, '-', 2) AS INTEGER) AS b, ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'] AS m FROM records WHERE pages <> '') WHERE (b BETWEEN 1 AND 12 AND a BETWEEN 1 AND 31) OR (a BETWEEN 1 AND 12 AND b BETWEEN 1 AND 99)")
def perturb_excel_pages(spark, sf_dir):
    return validate.damaged(records_of(spark, sf_dir), "excel_mangled_pages").select("uid", "pages")


_UPPER = "upper(replace(title, 'ß', 'SS'))"


@query(f"SELECT uid, {_UPPER} AS title FROM records WHERE title <> '' AND title <> {_UPPER}")
def perturb_uppercase(spark, sf_dir):
    return validate.damaged(records_of(spark, sf_dir), "uppercase_title").select("uid", "title")


@query("SELECT a.ord AS i, b.ord AS j, jaro_winkler_similarity(regexp_replace(a.journal, '[^ -~]', '?', 'g'), regexp_replace(b.journal, '[^ -~]', '?', 'g')) AS sim_journal FROM records a JOIN records b ON b.ord = a.ord + 1")
def jaro_winkler(spark, sf_dir):
    r = records_of(spark, sf_dir).select("ord", F.regexp_replace("journal", "[^ -~]", "?").alias("journal"))
    pairs = r.select(F.col("ord").alias("i"), (F.col("ord") + 1).alias("j"), F.col("journal").alias("a_journal")).join(r.select(F.col("ord").alias("j"), F.col("journal").alias("b_journal")), "j")
    return validate.similarities(pairs, ("journal",)).select("i", "j", "sim_journal")


@query()
def comparison_rule(spark, sf_dir):
    r = records_of(spark, sf_dir)
    author = F.coalesce(F.get("authors", F.lit(0)), F.lit(""))
    values = {"title": F.col("title"), "abstract": F.col("abstract"), "author": author, "journal": F.col("journal"), "isbn": F.lit(""), "pages": F.col("pages"), "volume": F.col("volume"), "number": F.col("issue"), "doi": F.col("doi"), "year": F.col("year")}
    side = lambda p, n: r.select(F.col("ord").alias(n), *[v.alias(f"{p}_{c}") for c, v in values.items()])
    pairs = blocking.round_pairs(blocking.with_norms(r), blocking.COMPARISON_BLOCK).join(side("a", "i"), "i").join(side("b", "j"), "j")
    return validate.nine_scores(pairs).select("i", "j", validate.true_pair().alias("true_pair"), validate.maybe_pair().alias("maybe_pair"))


# --- exports


_CELL = "CASE WHEN substr({0}, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN chr(39) || {0} ELSE {0} END"


@query(f"SELECT ord, uid AS record_id, {_CELL.format('title')} AS title, {_CELL.format('abstract')} AS abstract, {_CELL.format("array_to_string(authors, '; ')")} AS authors, coalesce(CAST(year AS VARCHAR), '') AS year, doi FROM records")
def export_screening(spark, sf_dir):
    return export.screening_frame(records_of(spark, sf_dir))


@query("SELECT ord, split_part(pages, '-', 1) AS page_start, split_part(pages, '-', 2) AS page_end, CASE WHEN doi <> '' THEN 'record:' || doi WHEN pmid <> '' THEN 'record:pmid:' || pmid ELSE 'record:srcid:' || source_id END AS eid, CASE doc_type WHEN 'article' THEN 'Article' WHEN 'review' THEN 'Review' ELSE '' END AS kind FROM records")
def export_scopus_csv(spark, sf_dir):
    return export.scopus_frame(records_of(spark, sf_dir)).select("ord", F.col("Page start").alias("page_start"), F.col("Page end").alias("page_end"), F.col("EID").alias("eid"), F.col("Document Type").alias("kind"))


@query("""SELECT ord, 'TY  - JOUR' || chr(10) || CASE WHEN len(authors) > 0 THEN 'AU  - ' || authors[1] || chr(10) ELSE '' END || CASE WHEN title <> '' THEN 'TI  - ' || title || chr(10) ELSE '' END || CASE WHEN abstract <> '' THEN 'AB  - ' || abstract || chr(10) ELSE '' END || CASE WHEN year IS NOT NULL THEN 'PY  - ' || CAST(year AS VARCHAR) || chr(10) ELSE '' END || 'T2  - ' || journal || chr(10) || CASE WHEN doi <> '' THEN 'DO  - ' || doi || chr(10) ELSE '' END || 'VL  - ' || volume || chr(10) || CASE WHEN pages <> '' THEN 'SP  - ' || split_part(pages, '-', 1) || chr(10) || 'EP  - ' || split_part(pages, '-', 2) || chr(10) ELSE '' END || CASE WHEN len(keywords) > 0 THEN array_to_string(list_transform(keywords, lambda k: 'KW  - ' || k), chr(10)) || chr(10) ELSE '' END || CASE WHEN language <> '' THEN 'LA  - ' || language || chr(10) ELSE '' END || 'ID  - ' || uid || chr(10) || 'ER  - ' || chr(10) AS text FROM records""")
def export_ris(spark, sf_dir):
    return records_of(spark, sf_dir).select("ord", export.ris_text().alias("text"))


def _latex_sql(value: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in export.LATEX.items())
    return f"array_to_string(list_transform(string_split({value}, ''), lambda c: CASE c {cases} ELSE c END), '')"


_BIBTEX = {
    "title": "title", "author": "array_to_string(authors, ' and ')", "journal": "journal", "year": "coalesce(CAST(year AS VARCHAR), '')", "volume": "volume", "pages": "pages", "doi": "doi",
    "language": "language", "keywords": "array_to_string(keywords, '; ')", "note": "CASE WHEN pmid <> '' THEN 'PMID: ' || pmid ELSE '' END", "abstract": "abstract",
}


@query(f""", named AS (SELECT *, regexp_replace({_SURNAME}, '[^a-z]', '', 'g') AS s FROM records),
based AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN s = '' THEN 'anon' ELSE s END, year ORDER BY ord) AS n FROM named),
keyed AS (SELECT *, CASE WHEN s = '' THEN 'anon' ELSE s END || coalesce(CAST(year AS VARCHAR), '') || CASE WHEN n = 1 THEN '' WHEN n <= 26 THEN chr(CAST(96 + n AS INTEGER)) ELSE chr(CAST(96 + (n - 1) // 26 AS INTEGER)) || chr(CAST(97 + (n - 1) % 26 AS INTEGER)) END AS key FROM based)
SELECT ord, key, '@article{{' || key || ',' || chr(10) || array_to_string(list_filter([{', '.join(f"CASE WHEN {v} <> '' THEN '  {k} = {{' || {_latex_sql(v)} || '}}' END" for k, v in _BIBTEX.items())}], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS text FROM keyed""")
def export_bibtex(spark, sf_dir):
    return export.bibtex_frame(records_of(spark, sf_dir))


FLAGSHIP = "unique_works"

from . import formats, matching  # noqa: E402, F401  (they register their queries)
