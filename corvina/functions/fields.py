"""Fields of records as built-in expressions: identifiers, pages, years, document types, flags, keys.

Missing strings are "". Java's \\s and \\d are ASCII unless (?U) is set, which it is where the text may be anything.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: Document type -> what names it, in the order in which they are tried.
DOC_TYPES = [
    ("review", ["systematic review", "literature review", "meta-analysis", "meta analysis", "review", "short survey", "survey article"]),
    ("preprint", ["preprint", "pre-print", "e-print", "eprint", "working paper", "unpublished", "submitted manuscript"]),
    ("conference", ["conference", "proceeding", "inproceedings", "cpaper", "congress", "symposium", "workshop", "meeting abstract"]),
    ("chapter", ["book chapter", "book section", "book part", "incollection", "inbook", "chapter"]),
    ("thesis", ["thesis", "dissertation", "phdthesis", "mastersthesis"]),
    ("report", ["technical report", "techreport", "report", "manual", "guideline"]),
    ("editorial", ["editorial", "erratum", "corrigendum", "note"]),
    ("letter", ["letter", "correspondence", "comment", "reply"]),
    ("book", ["book", "monograph", "edited volume"]),
    ("article", ["journal article", "journal", "article", "original research", "research paper", "paper", "jour", "data paper"]),
]

#: Titles that hold nothing but an identifier.
IDENTIFIER_TITLE = r"(?iU)^\s*(?:(?:https?://)?(?:dx\.)?doi\.org/\S+|doi:\s*\S+|10\.\d{4,9}/\S+|(?:https?://)?hdl\.handle\.net/\S+|urn:[a-z0-9-]+:\S+|isbn[\s:-]*[\d\-xX]{10,17}|https?://\S+)\s*$"

#: Which instalment of a series a title names.
PERIOD_MARKER = (
    r"(?iU)\b(?:first|second|third|fourth|1st|2nd|3rd|4th)\s+quarter\b|\bq[1-4]\b"
    r"|\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b"
    r"|\b(?:spring|summer|autumn|fall|winter)\b"
    r"|\b(?:part|vol|volume|no|number|issue|wave|round|edition|ed)\.?\s*(?:[ivxlcdm]+|\d+)\b"
    r"|\b(?:annual|yearly|monthly|quarterly|biennial)\b(?:\s+\w+){0,3}\s+(?:19|20)\d{2}\b"
    r"|\b(?:19|20)\d{2}\s+(?:edition|report|update|survey|review|yearbook)\b"
)

CONFERENCE = r"(?iU)\bconference\b|\bsuppl(?:ement)?\b|\babstracts?\b|\bmeeting\b|\bproceedings\b|\bcongress\b|\bsymposium\b|\bannual (?:scientific )?session"

PREPRINT = r"(?i)preprint|arxiv|biorxiv|medrxiv|ssrn|research square"

#: Flag -> title pattern, in the order in which they are tried.
INTEGRITY_TITLES = [
    ("retraction_notice", r"^\s*retraction\s*(?:note|notice|statement)\b"),
    ("retraction_notice", r"^\s*retraction\s*:"),
    ("retraction_notice", r"^\s*this article has been retracted\b"),
    ("retracted", r"^\s*retracted\s*(?:article|paper)?\s*[:\-]"),
    ("retracted", r"^\s*\[?retracted\]?\s*:"),
    ("retracted", r"\bretracted\s+article\b"),
    ("withdrawn", r"^\s*withdrawn\s*[:\-]"),
    ("withdrawn", r"^\s*withdrawal\s*(?:note|notice)?\s*[:\-]"),
    ("withdrawn", r"\barticle\s+withdrawn\b"),
    ("concern", r"expression\s+of\s+concern"),
    ("erratum", r"^\s*(?:erratum|corrigendum)\s*[:\-]"),
    ("erratum", r"^\s*(?:erratum|corrigendum)\s+(?:to|for|in)\b"),
]
INTEGRITY_TYPES = {
    "retraction": "retraction_notice", "retraction of publication": "retraction_notice", "retracted publication": "retracted", "withdrawn": "withdrawn",
    "erratum": "erratum", "corrigendum": "erratum", "correction": "erratum", "expression of concern": "concern",
}
EXCLUDING = ["retracted", "withdrawn"]
NOTICES = ["retraction_notice", "erratum", "concern"]


def text(col: Column | str) -> Column:
    """Never null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def squeeze(col: Column) -> Column:
    return F.btrim(F.regexp_replace(col, r"(?U)\s+", " "))


def unescape(col: Column) -> Column:
    """Percent escapes resolved once; broken escapes stay as they are (the built-in decoder would fail on them)."""
    whole = F.regexp_replace(col, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B"))), col)


def doi(col: Column | str) -> Column:
    """Lower-cased, unescaped (three times at most), without resolver; "" unless it has a DOI's shape."""
    value = F.lower(F.btrim(text(col)))
    for _ in range(3):
        value = F.when(value.contains("%"), unescape(value)).otherwise(value)
    value = F.regexp_replace(value, r"^(https?://)?(dx\.)?doi\.org/", "")
    value = F.regexp_replace(value, r"^doi:\s*", "")
    value = F.rtrim(F.btrim(value), F.lit(".;,"))
    return F.regexp_extract(value, r"(?U)10\.\d{4,9}/\S+", 0)


def pmid(col: Column | str) -> Column:
    return F.regexp_replace(text(col), r"\D", "")


def openalex(col: Column | str) -> Column:
    return F.upper(F.substring_index(text(col), "/", -1))


def identifier_title(col: Column | str) -> Column:
    return text(col).rlike(IDENTIFIER_TITLE)


def clean_pages(col: Column | str) -> Column:
    """Any dashes to one hyphen without blanks around it."""
    value = F.regexp_replace(squeeze(text(col)), "[‐-―−]|-{2,}", "-")
    return F.btrim(F.regexp_replace(value, r"\s*-\s*", "-"), F.lit(" -,;"))


def parse_year(col: Column | str) -> Column:
    value = F.btrim(text(col))
    whole = F.regexp_extract(value, r"^(\d{4})(?:\.0+)?$", 1)
    return F.nullif(F.when(whole != "", whole).otherwise(F.regexp_extract(value, r"(?:1[5-9]|20)\d{2}", 0)), F.lit("")).try_cast("int")


def parse_int(col: Column | str) -> Column:
    value = F.regexp_replace(F.btrim(text(col)), "[, ]", "")
    whole = F.regexp_extract(value, r"^(-?\d+)(?:\.0+)?$", 1)
    return F.nullif(F.when(whole != "", whole).otherwise(F.regexp_extract(value, r"\d+", 0)), F.lit("")).try_cast("int")


def doc_type(col: Column | str) -> Column:
    value = F.lower(squeeze(text(col)))
    out = F.lit("")
    for name, needles in reversed(DOC_TYPES):
        hit = value.contains(needles[0])
        for n in needles[1:]:
            hit = hit | value.contains(n)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def first_page(col: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(F.btrim(text(col))), r"[a-z]?\s?\d+", 0), r"\s", "")


def page_digits(col: Column | str) -> Column:
    digits = F.regexp_extract(text(col), r"\d+", 0)
    return F.when(digits == "", "").when(F.ltrim(digits, F.lit("0")) == "", "0").otherwise(F.ltrim(digits, F.lit("0")))


def volume(col: Column | str) -> Column:
    return F.regexp_extract(text(col), r"\d+", 0)


def mangled_pages(col: Column | str) -> Column:
    """A page range that a spreadsheet has made a date."""
    value = F.lower(F.btrim(text(col)))
    names = [F.regexp_extract(value, r"^([a-z]{3})[a-z]*[-/ ]\d{1,4}$", 1), F.regexp_extract(value, r"^\d{1,4}[-/ ]([a-z]{3})[a-z]*$", 1)]
    return names[0].isin(MONTHS) | names[1].isin(MONTHS)


def pseudo_range(col: Column | str) -> Column:
    """1 to n: a length rather than a place."""
    n = F.regexp_extract(F.btrim(text(col)), r"^1\s*[-–—]\s*(\d{1,3})$", 1)
    return F.coalesce(n.try_cast("int") > 1, F.lit(False))


def period_markers(col: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text(col), F.lit(PERIOD_MARKER), 0), F.lower)))


def conference_venue(col: Column | str) -> Column:
    return text(col).rlike(CONFERENCE)


def integrity_flag(doc_type_: Column | str, title: Column | str) -> Column:
    """The flag that the document type names, else the first that the title has; null if none."""
    kind = F.lower(F.btrim(text(doc_type_)))
    out = F.lit(None).cast("string")
    for flag, pattern in reversed(INTEGRITY_TITLES):
        out = F.when(text(title).rlike("(?i)" + pattern), F.lit(flag)).otherwise(out)
    for name, flag in INTEGRITY_TYPES.items():
        out = F.when(kind == name, F.lit(flag)).otherwise(out)
    return out


def reference_key(entry: Column) -> Column:
    """doi:..., oa:W... or txt:... of a cited reference: entries with one key are one work."""
    value = F.btrim(text(entry))
    d = F.regexp_extract(value, r"(?i)\b(10\.\d{4,9}/[^\s\"<>;,]+)", 1)
    w = F.regexp_extract(value, r"(?i)openalex\.org/(W\d+)", 1)
    w = F.when(w == "", F.regexp_extract(value, r"(?i)^(W\d{4,})$", 1)).otherwise(w)
    plain = F.lower(F.btrim(squeeze(value), F.lit(" .;")))
    return F.when(d != "", F.concat(F.lit("doi:"), F.lower(F.rtrim(d, F.lit(".)"))))).when(w != "", F.concat(F.lit("oa:"), F.upper(w))).otherwise(F.concat(F.lit("txt:"), plain))


def split_references(cell: Column | str) -> Column:
    return F.filter(F.transform(F.split(text(cell), ";", -1), lambda x: F.btrim(x)), lambda x: x != "")


def id_keys() -> Column:
    """(rank, kind, value) of a record's identifiers, in order, without empty ones."""
    pairs = [("doi", "doi"), ("pmid", "pmid"), ("openalex", "openalex_id"), ("scopus", "scopus_id")]
    entries = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(c).alias("value")) for i, (k, c) in enumerate(pairs)])
    return F.filter(entries, lambda e: e["value"] != "")


def richness() -> Column:
    """How complete a record is; the order of the additions is fixed, so that equal records get equal numbers."""
    score = F.lit(0.0)
    for c in ("title", "doi", "journal", "issn", "volume", "pages", "doc_type", "language", "url"):
        score = score + (F.col(c) != "").cast("double")
    score = score + (F.coalesce("year", F.lit(0)) != 0).cast("double")
    n = F.size("authors")
    score = score + F.when(n > 0, 1 + F.least(n, F.lit(10)) / F.lit(10.0)).otherwise(0.0)
    score = score + (F.size("keywords") > 0).cast("double")
    return score + F.least(F.length("abstract"), F.lit(3000)) / F.lit(1000.0)


def record_key(norm_title: Column) -> Column:
    """The key that aligns two harvests: the strongest identifier, else title and year."""
    out = F.concat(F.lit("title:"), norm_title, F.lit("|"), F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string")).otherwise(""))
    out = F.when(F.col("source_id") != "", F.concat(F.lit("sid:"), "source", F.lit(":"), "source_id")).otherwise(out)
    for kind, c in (("scopus", "scopus_id"), ("openalex", "openalex_id"), ("pmid", "pmid"), ("doi", "doi")):
        out = F.when(F.col(c) != "", F.concat(F.lit(f"{kind}:"), c)).otherwise(out)
    return out


def rebuilt_abstract(inverted: Column) -> Column:
    """Text of an inverted index (word -> places); of words at one place the last stays."""
    entries = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    ordered = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["at"].alias("at"), i.alias("i"), e["word"].alias("word"))))
    last = F.filter(ordered, lambda e, i: F.coalesce(F.get(ordered, i + 1)["at"] != e["at"], F.lit(True)))
    return F.coalesce(F.array_join(F.transform(last, lambda e: e["word"]), " "), F.lit(""))


#: Parts of a cell that say "open", and words it starts with for "closed".
OPEN = ["yes", "true", "gold", "green", "hybrid", "bronze", "all open", "open access", "doaj", "1"]
CLOSED = ["no", "false", "0", "closed", "subscription", "none"]


def open_access(cell: Column | str) -> Column:
    """True, false or null of a vendor's cell; what says "open" is tried first."""
    value = F.lower(squeeze(text(cell)))
    yes, no = F.lit(False), F.lit(False)
    for t in OPEN:
        yes = yes | value.contains(t)
    for t in CLOSED:
        no = no | value.startswith(t)
    return F.when(yes, True).when(no, False)


def safe_cell(col: Column) -> Column:
    """A cell that a spreadsheet won't take for a formula."""
    return F.when(F.substring(col, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), col)).otherwise(col)


def split_pages(col: Column) -> tuple[Column, Column]:
    parts = F.transform(F.split(F.btrim(col), "-", -1), lambda x: F.btrim(x))
    range_ = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    return F.when(range_, F.get(parts, F.lit(0))).otherwise(F.btrim(col)), F.when(range_, F.get(parts, F.lit(1))).otherwise("")
