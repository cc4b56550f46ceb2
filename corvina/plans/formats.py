"""Queries that write records in a format, read them back with its parser, and compare with the records themselves.

Files hold five neighbouring records each and are rows (path, content), as the reader of files gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..operators import export
from ..sources import exports, mappers
from .registry import query, records_of

PER_FILE = 5

#: A text on one line as parsers make it, in SQL; and with each line for itself.
FLAT = r"trim(regexp_replace({}, '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"
LINES = r"array_to_string(list_filter(list_transform(string_split(regexp_replace({}, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), ' ')"
NAMES = "list_transform(authors, lambda x: trim(x))"
KEPT = "(title <> '' OR doi <> '')"


def line(lead: str, value: Column | str) -> Column:
    """A line for a value that is there."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(lead), value, F.lit("\n"))).otherwise("")


def year() -> Column:
    return F.coalesce(F.col("year").cast("string"), F.lit(""))


def first_author() -> Column:
    return F.coalesce(F.get("authors", F.lit(0)), F.lit(""))


def files(records: DataFrame, stanza: Column, head: str = "", foot: str = "", by: str = "\n", encoded: bool = False) -> DataFrame:
    """(path, content): PER_FILE neighbours to a file; with ``encoded`` in three encodings in turn."""
    held = records.select(F.floor(F.col("ord") / PER_FILE).alias("file"), F.struct("ord", stanza.alias("t")).alias("s"))
    held = held.groupBy("file").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]).alias("s"))
    text = F.concat(F.lit(head), F.array_join("s", by), F.lit(foot))
    content = F.encode(text, "UTF-8")
    if encoded:
        content = F.when(F.col("file") % 3 == 1, F.encode(text, "UTF-16")).when(F.col("file") % 3 == 2, F.concat(F.unhex(F.lit("EFBBBF")), content)).otherwise(content)
    return held.select(F.concat(F.lit("file-"), F.col("file").cast("string")).alias("path"), content.alias("content"))


def read_back(found: DataFrame, fmt: str = "auto") -> DataFrame:
    return exports.parsed(found, fmt).where("reason is null").withColumn("doi", fields.doi("doi"))


def ris_files(r: DataFrame) -> DataFrame:
    return files(r, export.ris_text(), encoded=True)


def csv_files(r: DataFrame) -> DataFrame:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", *[quoted(F.col(f"`{c}`")) for c in export.SCOPUS_COLUMNS])
    return files(export.scopus_frame(r), row, head=",".join(f'"{c}"' for c in export.SCOPUS_COLUMNS) + "\n")


def nbib_files(r: DataFrame) -> DataFrame:
    lid = F.when(F.col("doi") != "", F.concat("doi", F.lit(" [doi]")))
    stanza = F.concat(line("PMID- ", "pmid"), line("TI  - ", "title"), line("DP  - ", year()), line("JT  - ", "journal"), line("VI  - ", "volume"), line("PG  - ", "pages"), line("LID - ", lid), line("AU  - ", first_author()), line("LA  - ", "language"), F.lit("PT  - Journal Article\n"))
    return files(r.where("pmid <> ''"), stanza)


def wos_files(r: DataFrame) -> DataFrame:
    pages = F.split("pages", "-", 2)
    stanza = F.concat(F.lit("PT J\n"), line("AU ", first_author()), line("TI ", "title"), line("SO ", "journal"), line("PY ", year()), line("VL ", "volume"), line("BP ", F.get(pages, F.lit(0))), line("EP ", F.get(pages, F.lit(1))), line("DI ", "doi"), line("LA ", "language"), line("TC ", F.col("cited_by").cast("string")), line("UT ", "uid"), F.lit("DT Article\nER\n"))
    return files(r, stanza, head="FN Clarivate Analytics Web of Science\nVR 1.0\n", foot="\nEF\n")


def enw_files(r: DataFrame) -> DataFrame:
    stanza = F.concat(F.lit("%0 Journal Article\n"), line("%T ", "title"), line("%D ", year()), line("%J ", "journal"), line("%V ", "volume"), line("%P ", "pages"), line("%R ", "doi"), line("%G ", "language"), line("%M ", "uid"))
    return files(r, stanza)


def xml(value: Column | str) -> Column:
    """Text for XML: marks escaped, characters that XML has not left out."""
    out = F.regexp_replace(F.col(value) if isinstance(value, str) else value, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def endnote_files(r: DataFrame) -> DataFrame:
    half = F.floor(F.length("title") / 2).cast("int")  # a title in two runs of style
    title = F.concat(F.lit("<titles><title><style face='bold'>"), xml(F.col("title").substr(F.lit(1), half)), F.lit("</style><style>"), xml(F.col("title").substr(half + 1, F.length("title"))), F.lit("</style></title></titles>"))
    tag = lambda name, v: F.concat(F.lit(f"<{name}>"), xml(v), F.lit(f"</{name}>"))
    stanza = F.concat(F.lit('<record><ref-type name="Journal Article">17</ref-type>'), title, F.lit("<periodical>"), tag("full-title", "journal"), F.lit("</periodical><dates>"), tag("year", year()), F.lit("</dates>"), tag("volume", "volume"), tag("pages", "pages"), tag("electronic-resource-num", "doi"), tag("rec-number", "uid"), F.lit("</record>"))
    return files(r, stanza, head="<?xml version='1.0'?><xml><records>", foot="</records></xml>")


def html_files(r: DataFrame) -> DataFrame:
    cell = lambda v: F.concat(F.lit("<td>"), xml(v), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *[cell(v) for v in ("title", "journal", "volume", "pages", "doi", year(), "uid")], F.lit("</tr>"))
    return files(r, row, head="<html><body><table><tr><td>menu</td></tr></table><table><tr><th>Title</th><th>Journal</th><th>Volume</th><th>Pages</th><th>DOI</th><th>Year</th><th>ID</th></tr>", foot="</table></body></html>")


@query(f"SELECT uid AS source_id, {FLAT.format('title')} AS title, {LINES.format('abstract')} AS abstract, {NAMES} AS authors, year, trim(journal) AS journal, doi, volume, pages, 'article' AS doc_type, language FROM records")
def read_ris(spark, sf_dir):
    """Stanzas in three encodings, abstracts of many lines."""
    return read_back(ris_files(records_of(spark, sf_dir))).select("source_id", "title", "abstract", "authors", "year", "journal", "doi", "volume", "pages", "doc_type", "language")


_SAFE = "CASE WHEN substr({0}, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN chr(39) || {0} ELSE {0} END"


@query(f"SELECT {FLAT.format(_SAFE.format('title'))} AS title, {FLAT.format(_SAFE.format('abstract'))} AS abstract, year, trim(journal) AS journal, doi, volume, pages, doc_type, language, cited_by FROM records WHERE {KEPT}")
def read_csv(spark, sf_dir):
    """All 46 columns of the vendor's table, texts with line ends and quotes in cells."""
    return read_back(csv_files(records_of(spark, sf_dir))).select("title", "abstract", "year", "journal", "doi", "volume", "pages", "doc_type", "language", "cited_by")


@query(f"SELECT {FLAT.format('nfc_normalize(title)')} AS title, year, {FLAT.format('nfc_normalize(journal)')} AS journal, doi, volume, pages, language FROM records WHERE {KEPT}")
def read_bibtex(spark, sf_dir):
    """Texts escaped for LaTeX and back."""
    frame = export.bibtex_frame(records_of(spark, sf_dir))
    return read_back(files(frame, F.col("text"), by="\n\n")).select("title", "year", "journal", "doi", "volume", "pages", "language")


@query(f"SELECT pmid, trim(title) AS title, year, trim(journal) AS journal, doi, volume, pages, {NAMES} AS authors, language FROM records WHERE pmid <> ''")
def read_nbib(spark, sf_dir):
    return read_back(nbib_files(records_of(spark, sf_dir))).select("pmid", "title", "year", "journal", "doi", "volume", "pages", "authors", "language")


@query(f"SELECT uid AS source_id, title, year, trim(journal) AS journal, doi, volume, pages, {NAMES} AS authors, language, cited_by FROM records")
def read_wos(spark, sf_dir):
    return read_back(wos_files(records_of(spark, sf_dir))).select("source_id", "title", "year", "journal", "doi", "volume", "pages", "authors", "language", "cited_by")


@query(f"SELECT uid AS source_id, {FLAT.format('title')} AS title, year, {FLAT.format('journal')} AS journal, doi, volume, pages, language FROM records WHERE {KEPT}")
def read_enw(spark, sf_dir):
    return read_back(enw_files(records_of(spark, sf_dir))).select("source_id", "title", "year", "journal", "doi", "volume", "pages", "language")


_XML = r"regexp_replace({}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"


@query(f"SELECT uid AS source_id, {FLAT.format(_XML.format('title'))} AS title, year, {FLAT.format(_XML.format('journal'))} AS journal, doi, volume, pages FROM records WHERE {KEPT}")
def read_endnote(spark, sf_dir):
    """Titles in several runs of style."""
    return read_back(endnote_files(records_of(spark, sf_dir))).select("source_id", "title", "year", "journal", "doi", "volume", "pages")


@query(f"SELECT uid AS source_id, {FLAT.format(_XML.format('title'))} AS title, year, {FLAT.format(_XML.format('journal'))} AS journal, doi, volume, pages FROM records WHERE {KEPT}")
def read_html(spark, sf_dir):
    """The largest of several tables of a page."""
    return read_back(html_files(records_of(spark, sf_dir))).select("source_id", "title", "year", "journal", "doi", "volume", "pages")


_FILE = "CAST(floor(ord / 5) AS BIGINT)"


@query(f"""SELECT format, encoding, count(*) AS files FROM (
  SELECT DISTINCT 'ris' AS format, CASE {_FILE} % 3 WHEN 1 THEN 'utf-16-be' WHEN 2 THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding, {_FILE} AS f FROM records
  UNION ALL SELECT DISTINCT unnest(['csv', 'wos', 'enw', 'endnote', 'html']), 'utf-8', {_FILE} FROM records
  UNION ALL SELECT DISTINCT 'nbib', 'utf-8', {_FILE} FROM records WHERE pmid <> '') GROUP BY ALL""")
def detected_formats(spark, sf_dir):
    """Each file's format and encoding, found by content."""
    r = records_of(spark, sf_dir)
    kinds = {"ris": ris_files, "csv": csv_files, "wos": wos_files, "enw": enw_files, "endnote": endnote_files, "html": html_files, "nbib": nbib_files}
    out = None
    for name, make in kinds.items():
        own = make(r).withColumn("path", F.concat(F.lit(name), F.lit("/"), "path"))
        out = own if out is None else out.unionByName(own)
    return exports.formats(out).distinct().groupBy("format", "encoding").agg(F.count("*").alias("files"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS seen, count(CASE WHEN {KEPT} THEN 1 END) AS accepted, count(CASE WHEN NOT {KEPT} THEN 1 END) AS no_content, CAST(0 AS BIGINT) AS notes FROM records")
def parse_accounts(spark, sf_dir):
    """Seen = accepted + rejected, over the vendor's tables."""
    found = exports.accounts(exports.parsed(csv_files(records_of(spark, sf_dir))))
    return found.agg(F.sum("seen").alias("seen"), F.sum("accepted").alias("accepted"), F.sum("no_content").alias("no_content"), F.sum(F.size("notes")).cast("long").alias("notes"))


@query("SELECT ord, title, trim(regexp_replace(regexp_replace(abstract, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS abstract, year, journal, doi, volume, pages, doc_type, language, cited_by, list_transform(authors, lambda x: regexp_replace(x, ', $', '')) AS authors FROM records")
def map_crossref(spark, sf_dir):
    """Items of an API's answer, as JSON, mapped to records. Abstracts are compared without their marks of blanks."""
    r = records_of(spark, sf_dir)
    parts = F.regexp_extract(first_author(), "^(.*), (.*)$", 1), F.regexp_extract(first_author(), "^(.*), (.*)$", 2)
    people = F.when(F.size("authors") > 0, F.array(F.struct(parts[0].alias("family"), parts[1].alias("given")))).otherwise(F.array().cast("array<struct<family:string,given:string>>"))
    issued = F.struct(F.array(F.array("year")).alias("date-parts"))
    values = {"title": F.array("title"), "abstract": F.col("abstract"), "container-title": F.array("journal"), "DOI": F.col("doi"), "volume": F.col("volume"), "page": F.col("pages"), "type": F.col("doc_type"), "language": F.col("language"), "is-referenced-by-count": F.col("cited_by"), "issued": issued, "author": people}
    items = r.select("ord", F.to_json(F.struct(*[v.alias(k) for k, v in values.items()])).alias("json"))
    found = mappers.crossref(items).withColumn("abstract", F.btrim(F.regexp_replace("abstract", r"\s+", " ")))
    return found.select("ord", "title", "abstract", "year", "journal", "doi", "volume", "pages", "doc_type", "language", "cited_by", "authors")


@query("SELECT ord, title, year, journal, doi, volume, pages, doc_type, language, cited_by, 'W' || source_id AS openalex_id FROM records")
def map_openalex(spark, sf_dir):
    r = records_of(spark, sf_dir)
    pages = F.split("pages", "-", 2)
    biblio = F.struct("volume", F.get(pages, F.lit(0)).alias("first_page"), F.get(pages, F.lit(1)).alias("last_page"))
    place = F.struct(F.struct(F.col("journal").alias("display_name")).alias("source"))
    values = {"id": F.concat(F.lit("https://openalex.org/W"), "source_id"), "doi": F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), "doi")), "display_name": F.col("title"), "publication_year": F.col("year"), "type": F.col("doc_type"), "language": F.col("language"), "cited_by_count": F.col("cited_by"), "primary_location": place, "biblio": biblio}
    items = r.select("ord", F.to_json(F.struct(*[v.alias(k) for k, v in values.items()])).alias("json"))
    return mappers.openalex(items).select("ord", "title", "year", "journal", "doi", "volume", "pages", "doc_type", "language", "cited_by", "openalex_id")
