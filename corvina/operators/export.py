"""Exports: columns or texts, one row a record, so that writing them is a plain Spark sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.text import column, normalize_title, surname
from ..tables import written

# --- fixed values

SCREENING = ("record_id", "title", "abstract", "authors", "year", "doi")
CSV_COLUMNS = ("uid", "title", "abstract", "authors", "year", "journal", "doi", "pmid", "openalex_id", "scopus_id", "issn", "doc_type", "language", "cited_by", "source", "search_id")
#: The header of the vendor's CSV export.
SCOPUS_COLUMNS = (
    "Authors", "Author full names", "Author(s) ID", "Title", "Year", "Source title", "Volume", "Issue", "Art. No.", "Page start", "Page end",
    "Page count", "Cited by", "DOI", "Link", "Affiliations", "Authors with affiliations", "Abstract", "Author Keywords", "Index Keywords",
    "Molecular Sequence Numbers", "Chemicals/CAS", "Tradenames", "Manufacturers", "Funding Details", "Funding Texts", "References",
    "Correspondence Address", "Editors", "Publisher", "Sponsors", "Conference name", "Conference date", "Conference location", "Conference code",
    "ISSN", "ISBN", "CODEN", "PubMed ID", "Language of Original Document", "Abbreviated Source Title", "Document Type", "Publication Stage",
    "Open Access", "Source", "EID",
)
SCOPUS_TYPES = {"article": "Article", "review": "Review", "conference": "Conference Paper", "chapter": "Book Chapter", "book": "Book", "thesis": "Thesis", "report": "Report", "editorial": "Editorial", "letter": "Letter", "preprint": "Preprint"}
RIS_TYPES = {"article": "JOUR", "review": "JOUR", "conference": "CONF", "chapter": "CHAP", "book": "BOOK", "thesis": "THES", "report": "RPRT"}
BIBTEX_TYPES = {"article": "article", "review": "article", "conference": "inproceedings", "chapter": "incollection", "book": "book", "thesis": "phdthesis", "report": "techreport", "preprint": "misc", "editorial": "article", "letter": "article"}


def _mapped(names: dict[str, str], col: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), col), other)


def _list(name: str) -> Column:
    return F.array_join(name, "; ")


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _year() -> Column:
    return F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string")).otherwise("")


def csv_frame(records: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS) -> DataFrame:
    types = dict(records.dtypes)
    cell = lambda c: _list(c) if types[c].startswith("array") else _number(c)
    return records.select("ord", *[fields.safe_cell(cell(c)).alias(c) for c in columns])


def screening_frame(records: DataFrame) -> DataFrame:
    values = ["uid", "title", "abstract"]
    cols = [fields.safe_cell(F.col(c)) for c in values] + [fields.safe_cell(_list("authors")), _year(), F.col("doi")]
    return records.select("ord", *[v.alias(n) for v, n in zip(cols, SCREENING)])


def record_id(prefix: str = "record:") -> Column:
    """A stable id for records without the vendor's: the strongest identifier, else a digest of title and year. Never
    empty, since readers drop records with equal ids."""
    digest = F.substring(F.sha1(F.concat(column(normalize_title, "title"), F.lit("|"), _year()).cast("binary")), 1, 16)
    out = F.concat(F.lit("sha1:"), digest)
    for kind, c in (("srcid:", "source_id"), ("openalex:", "openalex_id"), ("pmid:", "pmid"), ("", "doi")):
        out = F.when(F.col(c) != "", F.concat(F.lit(kind), c)).otherwise(out)
    return F.concat(F.lit(prefix), out)


def scopus_frame(records: DataFrame, prefix: str = "record:") -> DataFrame:
    start, end = fields.split_pages(F.col("pages"))
    have = {
        "Authors": _list("authors"), "Author full names": _list("authors"), "Title": F.col("title"), "Year": _year(), "Source title": F.col("journal"),
        "Volume": F.col("volume"), "Issue": F.col("issue"), "Page start": start, "Page end": end, "Cited by": _number("cited_by"), "DOI": F.col("doi"),
        "Link": F.col("url"), "Abstract": F.col("abstract"), "Author Keywords": _list("keywords"), "Affiliations": _list("affiliations"),
        "References": _list("references"), "ISSN": F.col("issn"), "PubMed ID": F.col("pmid"), "Language of Original Document": F.col("language"),
        "Document Type": _mapped(SCOPUS_TYPES, F.col("doc_type"), F.col("doc_type")), "Open Access": F.when(F.col("open_access"), "All Open Access").otherwise(""),
        "Source": F.col("source"), "EID": F.when(F.col("scopus_id") != "", F.col("scopus_id")).otherwise(record_id(prefix)),
    }
    return records.select("ord", *[fields.safe_cell(have.get(c, F.lit(""))).alias(c) for c in SCOPUS_COLUMNS])


def write_csv(frame: DataFrame, path: str, one_file: bool = False) -> None:
    out = frame.orderBy("ord").drop("ord")
    (out.coalesce(1) if one_file else out).write.option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def ris_text() -> Column:
    """A record as a RIS stanza."""
    line = lambda tag, v: F.when(v != "", F.concat(F.lit(f"{tag}  - "), v))
    each = lambda tag, c: F.transform(c, lambda v: F.concat(F.lit(f"{tag}  - "), v))
    one = lambda *xs: F.array(*xs)
    pages = F.split("pages", "-", -1)
    parts = F.concat(
        one(F.concat(F.lit("TY  - "), _mapped(RIS_TYPES, F.col("doc_type"), F.lit("JOUR")))),
        each("AU", "authors"),
        one(line("TI", F.col("title")), line("AB", F.col("abstract")), line("PY", _year()), line("T2", F.col("journal")), line("DO", F.col("doi")), line("SN", F.col("issn")), line("VL", F.col("volume")), line("IS", F.col("issue"))),
        one(F.when(F.col("pages") != "", F.concat(F.lit("SP  - "), F.get(pages, F.lit(0)))), F.when(F.col("pages").contains("-"), F.concat(F.lit("EP  - "), F.element_at(pages, -1)))),
        each("KW", "keywords"),
        one(line("UR", F.col("url")), line("LA", F.col("language")), line("ID", F.col("uid")), F.lit("ER  - "), F.lit("")),
    )
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")


#: The characters that are special in LaTeX, and how they are written.
LATEX = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "{": r"\{", "}": r"\}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_"}


def bibtex_escape(col: Column) -> Column:
    """Special characters as LaTeX writes them, character by character, so that no replacement meets another's result."""
    table = F.create_map(*[F.lit(x) for pair in LATEX.items() for x in pair])
    special = "[" + "".join("\\" + c for c in LATEX) + "]"
    pieces = F.split(col, "")
    written_ = F.array_join(F.transform(pieces, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(col.rlike(special), written_).otherwise(col)


def letters(n: Column) -> Column:
    """1, 2, ... as a, b, ..., z, aa, ab, ...: letters in the way of a spreadsheet's columns, up to seven of them."""
    out, rest = F.lit(""), n.cast("long")
    for _ in range(7):
        letter = F.when(rest > 0, F.char(F.lit(97) + F.pmod(rest - 1, F.lit(26)))).otherwise("")
        out, rest = F.concat(letter, out), F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0)).cast("long")
    return out


def bibtex_frame(records: DataFrame) -> DataFrame:
    """(ord, key, text). A key is surname and year; the second record of a key gets b, the third c, the 27th aa, and so on, so
    keys are unique and hold letters and digits only."""
    from pyspark.sql import Window

    first = F.coalesce(F.get("authors", F.lit(0)), F.lit(""))
    name = F.regexp_replace(column(surname, first), "[^a-z]", "")
    keyed = written(records.withColumn("_base", F.concat(F.when(name == "", "anon").otherwise(name), _year())))
    # the place among equal keys: counts per block of ord, so that a very common key is no single task
    block = keyed.withColumn("_block", F.floor(F.col("ord") / 10_000))
    sizes = block.groupBy("_base", "_block").count()
    before = Window.partitionBy("_base").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_base", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_base", "_block").orderBy("ord"))
    keyed = block.withColumn("_n", place).join(starts, ["_base", "_block"]).withColumn("_n", F.col("_n") + F.col("_start"))
    key = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", letters(F.col("_n"))))
    kind = _mapped(BIBTEX_TYPES, F.col("doc_type"), F.lit("article"))
    venue = F.when(kind.isin("inproceedings", "incollection"), "booktitle").otherwise("journal")
    values = [(F.lit("title"), F.col("title")), (F.lit("author"), F.array_join("authors", " and ")), (F.lit("type"), F.when(kind == "misc", F.col("doc_type")).otherwise("")), (venue, F.col("journal")), (F.lit("year"), _year()), (F.lit("volume"), F.col("volume")), (F.lit("number"), F.col("issue")), (F.lit("pages"), F.col("pages")), (F.lit("doi"), F.col("doi")), (F.lit("issn"), F.col("issn")), (F.lit("url"), F.col("url")), (F.lit("language"), F.col("language")), (F.lit("keywords"), _list("keywords")), (F.lit("note"), F.when(F.col("pmid") != "", F.concat(F.lit("PMID: "), "pmid")).otherwise("")), (F.lit("abstract"), F.col("abstract"))]
    lines = F.filter(F.array(*[F.when(v != "", F.concat(F.lit("  "), n, F.lit(" = {"), bibtex_escape(v), F.lit("}"))) for n, v in values]), lambda x: x.isNotNull())
    text = F.concat(F.lit("@"), kind, F.lit("{"), F.col("key"), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
    return keyed.withColumn("key", key).select("ord", "key", text.alias("text"))


def decision_lines(decisions: DataFrame) -> DataFrame:
    """The log of decisions as a table for people: in the order in which they were taken, scores with four places."""
    cells = [fields.safe_cell(F.coalesce(c, F.lit(""))).alias(c) for c in ("kept_source", "removed_source", "kept_title", "removed_title")]
    return decisions.select(F.struct("stage", "place").alias("ord"), "kept_uid", "removed_uid", "method", F.format_string("%.4f", "score").alias("score"), "key", *cells)


def write_decisions(decisions: DataFrame, path: str) -> None:
    write_csv(decision_lines(decisions), path, one_file=True)


def write_text(frame: DataFrame, path: str) -> None:
    frame.orderBy("ord").select("text").write.option("lineSep", "\n").text(path)
