"""Database exports: bytes to text, text to stanzas, stanzas to records.

Each parser is a function of one text that yields, for each stanza it sees, either a record (a dict of the fields of the
record schema) or a Rejection with one of five reasons, so that seen = records + rejections always holds and no input
raises. ``read_exports`` applies them to files through Spark: one task a file (a file is one database's export, of
bounded size), with accounts beside the records.
"""

from __future__ import annotations

import csv
import html.parser
import io
import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import CLOSED, DOC_TYPES, OPEN
from ..functions.text import author_name, collapse, display_name, split_authors, split_keywords
from ..schema import LISTS, RECORD, STRINGS

REASONS = ("no_content", "empty", "malformed", "truncated", "unreadable")
#: Beside rejected stanzas, files have notes: characters replaced, a format forced against the content, no records at all.
NOTE = "note"


@dataclass(frozen=True)
class Rejection:
    reason: str
    detail: str = ""


# --- bytes

#: First bytes -> what such a file is; first bytes -> encoding.
MAGIC = [(b"%PDF-", "PDF"), (b"PK\x03\x04", "ZIP"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "OLE2"), (b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\x89PNG", "PNG"), (b"\xff\xd8\xff", "JPEG"), (b"SQLite format 3\x00", "SQLite")]
BOMS = [(b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")]


def sniff_encoding(data: bytes) -> str:
    for bom, name in BOMS:
        if data.startswith(bom):
            return name
    head = data[:4096]
    if head.count(0) >= 4:  # ASCII in UTF-16 has a zero in every other place
        even, odd, half = head[::2].count(0), head[1::2].count(0), max(1, len(head) // 2)
        if max(even, odd) > 0.4 * half and even != odd:
            return "utf-16-le" if odd > even else "utf-16-be"
    for name in ("utf-8", "cp1252"):
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError:
            pass
    return "latin-1"


def binary_kind(data: bytes, encoding: str) -> str:
    """What a file is that holds no text; "" for text."""
    for magic, kind in MAGIC:
        if data.startswith(magic):
            return kind
    head = data[:8192]
    control = sum(c < 32 and c not in (9, 10, 12, 13) for c in head)
    return "binary" if control * 20 > len(head) and not encoding.startswith(("utf-16", "utf-32")) else ""


def decoded(data: bytes, encoding: str = "auto") -> tuple[str, str, str]:
    """(text, encoding, kind): undecodable bytes are replaced, line ends are line feeds; a binary file gives no text."""
    name = sniff_encoding(data) if encoding == "auto" else encoding
    kind = binary_kind(data, name)
    if kind:
        return "", name, kind
    return data.decode(name, "replace").lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n"), name, ""


def detect_format(text: str) -> str:
    """By content: nbib, ris, bibtex, endnote, atom, pubmed, html, enw, wos or csv; "" if nothing fits."""
    head = text.replace("﻿", "").lstrip()[:20_000]
    low = head.lower()
    for name, pattern in (("nbib", r"^PMID\s*-\s*\d+"), ("ris", r"^TY\s{1,2}-\s*\S"), ("bibtex", r"^\s*@[A-Za-z]+\s*[{(]")):
        if re.search(pattern, head, re.M):
            return name
    if head.startswith("<"):
        if "<pubmedarticle" in low:
            return "pubmed"
        if any(x in low for x in ("<records", "<record>", "<ref-type")):
            return "endnote"
        if "<feed" in low and "arxiv" in low:
            return "atom"
        return "html" if any(x in low[:4096] for x in ("<html", "<table", "<!doctype")) else ""
    if len(re.findall(r"^%\S[ \t]", head[:8000], re.M)) >= 2:
        return "enw"
    if re.search(r"^(?:FN|VR)\s+\S", head, re.M) or (re.search(r"^ER\s*$", head, re.M) and re.search(r"^(?:PT|TI|AU|SO)\s{1,3}\S", head, re.M)):
        return "wos"
    first = head.split("\n", 1)[0]
    for delimiter in ",;\t":
        cells = first.split(delimiter)
        if sum(bool(re.search("[A-Za-z]", c)) for c in cells) >= 2:
            return "csv"
    return ""


# --- fields


def year_of(text: str, early: bool = False) -> int | None:
    m = re.search(r"(?:1[5-9]|20)\d{2}" if early else r"(?:19|20)\d{2}", text or "")
    return int(m[0]) if m else None


def int_of(text: str) -> int | None:
    m = re.fullmatch(r"(-?\d+)(?:\.0+)?", text := re.sub("[, ]", "", text or "")) or re.search(r"(\d+)", text)
    return int(m[1]) if m else None


def pages_of(text: str) -> str:
    return re.sub(r"\s*-\s*", "-", re.sub("[‐-―−]|-{2,}", "-", collapse(text))).strip(" -,;")


def type_of(label: str) -> str:
    low = collapse(label).lower()
    return next((name for name, needles in DOC_TYPES if low and any(n in low for n in needles)), "")


def open_of(cell: str) -> bool | None:
    low = collapse(cell).lower()
    return True if any(t in low for t in OPEN) else False if any(low.startswith(t) for t in CLOSED) else None


def unique(items: list[str]) -> list[str]:
    found: dict[str, str] = {}
    for x in items:
        found.setdefault(x.lower(), x)
    return list(found.values())


def kept(record: dict, *needs: str) -> dict | Rejection:
    """The record if one of the fields it needs is there."""
    if any(record.get(n) for n in needs):
        return record
    return Rejection("no_content", f"none of {', '.join(needs)}")


class Tags:
    """Values of a stanza by tag, in order."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.by: dict[str, list[str]] = {}
        for tag, value in pairs:
            self.by.setdefault(tag, []).append(value)

    def all(self, *tags: str) -> list[str]:
        return [v for t in tags for v in self.by.get(t, [])]

    def first(self, *tags: str) -> str:
        return next((self.by[t][0] for t in tags if self.by.get(t)), "")

    def some(self, *tags: str) -> list[str]:
        return next((self.by[t] for t in tags if self.by.get(t)), [])

    def joined(self, tag: str) -> str:
        return " ".join(self.by.get(tag, [])).strip()


def stanzas(text: str, tag: re.Pattern, opens: str = "", closes: str = "", blank: bool = False, more: str = r"\s*\S") -> Iterator[list[tuple[str, str]]]:
    """Runs of (tag, value): a stanza ends before an opening tag, at a closing tag or at a blank line; a line without a
    tag that matches ``more`` continues the value before it."""
    current: list[tuple[str, str]] = []
    for line in text.split("\n"):
        m = tag.match(line)
        if m and m[1] != closes:
            if m[1] == opens and current:
                yield current
                current = []
            current.append((m[1], m[2].strip()))
        elif m or (blank and not line.strip()):
            if current:
                yield current
                current = []
        elif current and re.match(more, line) and line.strip():
            current[-1] = (current[-1][0], f"{current[-1][1]} {line.strip()}".strip())
    if current:
        yield current


# --- RIS

RIS_TAG = re.compile(r"^([A-Z][A-Z0-9])  ?- ?(.*)$")
#: What the format's types are called here; each dialect's journal tags, in order.
RIS_TYPES = {"JOUR": "article", "JFULL": "article", "EJOUR": "article", "CONF": "conference", "CPAPER": "conference", "CHAP": "chapter", "BOOK": "book", "THES": "thesis", "RPRT": "report", "GEN": "", "ABST": "article"}
RIS_JOURNAL = {
    "generic": ["JF", "JO", "T2", "J2", "JA"],
    "scopus": ["T2", "JF", "JO", "J2"],
    "embase": ["T2", "JF", "JO", "J2"],
    "central": ["T2", "JF", "JO", "J2"],
    "ebsco": ["JF", "T2", "JO", "J2"],
    "proquest": ["JF", "T2", "JO", "J2"],
    "wos": ["T2", "JO", "JF"],
    "zotero": ["T2", "JF", "JO"],
}
#: What a platform's database label contains, and its accession prefixes -> the database.
EBSCO_LABELS = [("business source", "Business Source"), ("bsc", "Business Source"), ("psycinfo", "PsycINFO"), ("psycharticles", "PsycARTICLES"), ("cinahl", "CINAHL"), ("eric", "ERIC"), ("academic search", "Academic Search"), ("medline", "MEDLINE"), ("sportdiscus", "SPORTDiscus"), ("econlit", "EconLit"), ("communication", "Communication Source"), ("library, information science", "LISTA"), ("greenfile", "GreenFILE")]
EBSCO_PREFIXES = {"bth": "Business Source", "buh": "Business Source", "psyh": "PsycINFO", "pdh": "PsycARTICLES", "ccm": "CINAHL", "eric": "ERIC", "a9h": "Academic Search", "cmedm": "MEDLINE", "s3h": "SPORTDiscus", "ecn": "EconLit", "ufh": "Communication Source", "lxh": "LISTA", "8gh": "GreenFILE"}
CENTRAL_ID = re.compile(r"\bCN-?\s?(\d{6,10})\b", re.I)
EMBASE_ID = re.compile(r"\b(L\d{7,10}|6\d{8})\b")
TRIAL_ID = re.compile(r"\b(NCT\d{8}|ISRCTN\d{6,8}|ACTRN\d{11,14}|ChiCTR[-\w]*\d{6,}|EUCTR\d{4}-\d{6}-\d{2}|IRCT\d{8,}\w*|DRKS\d{8})\b", re.I)


def ris_dialect(text: str) -> str:
    head = text[:6000]
    line = lambda pattern: re.search(r"^" + pattern, head, re.M | re.I)
    if re.search(r"^DB  ?- ?Scopus", head, re.M):
        return "scopus"
    if line(r"(?:AN|ID)  ?- ?CN-?\s?\d{6,}") or line(r"DB  ?- ?[^\n]*Cochrane") or "Cochrane Central Register" in head:
        return "central"
    if "Embase" in head:
        return "embase"
    if "EBSCO" in head or line(r"DB  ?- ?[^\n]*(?:" + "|".join(re.escape(k) for k, _ in EBSCO_LABELS) + ")"):
        return "ebsco"
    if "ProQuest" in head or "ABI/INFORM" in head:
        return "proquest"
    if re.search(r"^DB  ?- ?(?:WOS|Web of Science)", head, re.M) or "Clarivate" in head:
        return "wos"
    return "zotero" if re.search(r"^M3  ?-", head, re.M) and re.search(r"^DA  ?-", head, re.M) else "generic"


def first_match(pattern: re.Pattern, values: list[str]) -> str:
    return next((m[1] for v in values if (m := pattern.search(v))), "")


def ris_pmid(t: Tags, dialect: str) -> str:
    for value in t.all("AN", "C2", "N1", "U1", "ID"):
        m = None if CENTRAL_ID.search(value) else re.search(r"\b(\d{7,8})\b", value)
        if m and (dialect in ("ebsco", "embase", "central") or re.search("pmid|pubmed", value, re.I)):
            return m[1]
    return ""


def parse_ris(text: str, dialect: str = "auto", source: str = "") -> Iterator[dict | Rejection]:
    dialect = ris_dialect(text) if dialect == "auto" else dialect
    for pairs in stanzas(text, RIS_TAG, "TY", "ER"):
        t = Tags(pairs)
        pages, raw = t.first("SP"), {"dialect": dialect}
        if t.first("EP") and pages and "-" not in pages:
            pages += "-" + t.first("EP")
        kind = t.first("TY")
        r = {
            "title": collapse(t.first("TI", "T1")), "abstract": t.first("AB", "N2"), "authors": t.some("AU", "A1"), "year": year_of(t.first("PY", "Y1", "DA")),
            "journal": t.first(*RIS_JOURNAL.get(dialect, RIS_JOURNAL["generic"])), "doi": t.first("DO", "DI", *["M3"] * (dialect == "scopus")), "pmid": ris_pmid(t, dialect),
            "issn": t.first("SN"), "volume": t.first("VL"), "issue": t.first("IS"), "pages": pages, "doc_type": RIS_TYPES.get(kind, kind.lower()),
            "language": t.first("LA").lower(), "keywords": t.all("KW"), "url": t.first("UR", "L2"), "source_id": t.first("AN", "ID", "U1"), "source": source or f"RIS/{dialect}",
        }
        refine = REFINEMENTS.get(dialect)
        if refine:
            refine(r, t, raw, source)
        r["raw"] = raw
        yield kept(r, "title", "doi", "pmid", "source_id")


def _embase(r: dict, t: Tags, raw: dict, source: str) -> None:
    subtype = t.first("M3")
    if subtype and not re.match(r"10\.\d{4,9}/", subtype):
        r["doc_type"], raw["subtype"] = type_of(subtype) or r["doc_type"], collapse(subtype)
    found = first_match(EMBASE_ID, t.all("AN", "ID"))
    if found:
        r["source_id"] = raw["embase_id"] = found
    elif r["source_id"].upper().startswith(("PMID", "MEDLINE")):
        r["source_id"] = re.sub(r"\D", "", r["source_id"]) or r["source_id"]


def _central(r: dict, t: Tags, raw: dict, source: str) -> None:
    _embase(r, t, raw, source)
    found = first_match(CENTRAL_ID, t.all("AN", "ID", "U1"))
    if found:
        r["source_id"] = raw["central_id"] = f"CN-{found}"
    trials = [m.upper() for v in t.all("AN", "C7", "N1", "DB", "U1") for m in TRIAL_ID.findall(v)]
    if trials:
        raw["trial_ids"] = list(dict.fromkeys(trials))


def _ebsco(r: dict, t: Tags, raw: dict, source: str) -> None:
    labels = [collapse(v).lower() for v in t.all("DB", "DP", "T3")]
    db = next((name for v in labels for needle, name in EBSCO_LABELS if needle in v), "") or EBSCO_PREFIXES.get(r["source_id"].split("-")[0].strip().lower(), "")
    if db:
        raw["database"] = db
        r["source"] = source or db
    r["source_id"] = next((v for v in t.all("AN") if v and not v.isdigit()), r["source_id"])


def _proquest(r: dict, t: Tags, raw: dict, source: str) -> None:
    r["title"] = max([r["title"], *map(collapse, t.all("TI", "T1"))], key=len)
    found = first_match(re.compile(r"\b(\d{6,12})\b"), t.all("ID", "AN")) or first_match(re.compile(r"docview/(\d+)"), [r["url"]])
    if found:
        raw["proquest_id"] = found
        r["source_id"] = r["source_id"] or found


REFINEMENTS = {"embase": _embase, "central": _central, "ebsco": _ebsco, "proquest": _proquest}

# --- Web of Science tagged

WOS_TAG = re.compile(r"^([A-Z][A-Z0-9])(?: (.*)|)$")
#: Fixed values.
WOS_TYPES = {"article": "article", "review": "review", "proceedings paper": "conference", "book chapter": "chapter", "book": "book", "editorial material": "editorial", "letter": "letter"}


def parse_wos(text: str, dialect: str = "", source: str = "") -> Iterator[dict | Rejection]:
    lines: list[tuple[str, str]] = []

    def built() -> dict | Rejection:
        t = Tags([(k, v) for k, v in lines if v])
        pages = t.joined("BP")
        if pages and t.joined("EP"):
            pages += "-" + t.joined("EP")
        kind, cited = t.joined("DT").lower(), t.joined("TC")
        r = {
            "title": t.joined("TI"), "abstract": t.joined("AB"), "authors": t.some("AF", "AU"), "year": year_of(t.joined("PY")), "journal": t.joined("SO"), "doi": t.joined("DI"),
            "pmid": t.joined("PM"), "issn": t.joined("SN") or t.joined("EI"), "volume": t.joined("VL"), "issue": t.joined("IS"), "pages": pages or t.joined("AR"),
            "doc_type": WOS_TYPES.get(kind, kind), "language": t.joined("LA").lower(), "keywords": [k.strip() for v in t.all("DE", "ID") for k in v.split(";") if k.strip()],
            "cited_by": int(cited) if cited.isdigit() else None, "references": t.all("CR"), "source": source or "Web of Science", "source_id": t.joined("UT"), "raw": {},
        }
        return kept(r, "title", "doi", "pmid", "source_id")

    tag = ""
    for line in text.split("\n"):
        m = WOS_TAG.match(line)
        if line[:2] == "ER":
            if lines:
                yield built()
            lines, tag = [], ""
        elif line[:2] in ("FN", "VR", "EF") and m:
            tag = ""
        elif m:
            tag = m[1]
            lines.append((tag, line[3:].strip()))
        elif line.startswith("   ") and tag:
            lines.append((tag, line.strip()))
    if lines:
        yield built()


# --- MEDLINE

NBIB_TAG = re.compile(r"^([A-Z]{2,4}) *- ?(.*)$")


def parse_nbib(text: str, dialect: str = "", source: str = "") -> Iterator[dict | Rejection]:
    for pairs in stanzas(text, NBIB_TAG, opens="PMID", more=r" {6}"):
        t = Tags(pairs)
        kinds = [k.lower() for k in t.all("PT")]
        r = {
            "title": t.first("TI"), "abstract": t.first("AB"), "authors": t.some("FAU", "AU"), "year": year_of(t.first("DP")), "journal": t.first("JT", "TA"),
            "doi": next((v.replace("[doi]", "").strip() for v in t.all("LID", "AID") if "[doi]" in v), ""), "pmid": t.first("PMID"), "issn": t.first("IS").split(" ")[0],
            "volume": t.first("VI"), "issue": t.first("IP"), "pages": t.first("PG"), "doc_type": medline_type(kinds), "language": t.first("LA").lower(),
            "keywords": [k.rstrip("*") for k in t.all("MH", "OT")], "source": source or "PubMed", "source_id": t.first("PMID"), "raw": {},
        }
        yield kept(r, "title", "pmid", "doi")


def medline_type(kinds: list[str]) -> str:
    return "review" if "review" in kinds else "article" if "journal article" in kinds else kinds[0] if kinds else ""


# --- EndNote tagged

ENW_TAG = re.compile(r"^%(\S)[ \t]?(.*)$")
#: Fixed values.
ENW_TYPES = {"electronic article": "article", "journal": "article", "newspaper article": "article", "magazine article": "article", "conference proceedings": "conference", "conference paper": "conference", "web page": "", "generic": ""}


def parse_enw(text: str, dialect: str = "", source: str = "") -> Iterator[dict | Rejection]:
    for pairs in stanzas(text, ENW_TAG, opens="0", blank=True):
        t = Tags([(k, v) for k, v in pairs if v])
        if not t.by:
            yield Rejection("empty", "no tagged values")
            continue
        numbers = [collapse(v).replace(" ", "") for v in t.all("@")]
        found = next((m[0].rstrip(".,;)") for v in t.all("R", "U", "Z", "3") if (m := re.search(r"10\.\d{4,9}/\S+", v, re.I))), "")
        label = collapse(t.first("0")).lower()
        url = next((collapse(v) for v in t.all("U") if collapse(v).lower().startswith(("http://", "https://", "doi:"))), "")
        ids = t.all("M", "Z", "1")
        pmid = first_match(re.compile(r"(?:pmid|pubmed)[:\s]*(\d{5,9})", re.I), ids) or next((collapse(v) for v in ids if re.fullmatch(r"\d{5,9}", collapse(v))), "")
        r = {
            "title": collapse(t.first("T", "!")), "abstract": collapse(t.first("X")), "authors": [a for v in t.all("A") for a in split_authors(v)], "year": year_of(t.first("D", "8"), True),
            "journal": collapse(t.first("J", "B", "S")), "doi": found.lower(), "pmid": pmid, "issn": next((v for v in numbers if re.fullmatch(r"\d{4}-\d{3}[\dxX]", v)), ""),
            "volume": collapse(t.first("V")), "issue": collapse(t.first("N")), "pages": pages_of(t.first("P")), "doc_type": ENW_TYPES.get(label, type_of(label)), "language": collapse(t.first("G")).lower(),
            "keywords": unique([k for v in t.all("K") for k in split_keywords(v)]), "url": url or (f"https://doi.org/{found}" if found else ""),
            "source": source or collapse(t.first("I")) or "EndNote", "source_id": collapse(t.first("M", "F", "L")), "raw": {"publisher": collapse(t.first("I")), "place": collapse(t.first("C"))},
        }
        yield kept(r, "title", "doi", "pmid")


# --- XML


def inner(node: ET.Element | None) -> str:
    return collapse("".join(node.itertext())) if node is not None else ""


def texts(node: ET.Element, *paths: str) -> list[str]:
    """Texts at the first path that has any."""
    return next((found for p in paths if (found := [x for x in map(inner, node.findall(p)) if x])), [])


def one(node: ET.Element, *paths: str) -> str:
    return (texts(node, *paths) or [""])[0]


def without_namespaces(root: ET.Element) -> ET.Element:
    for el in root.iter():
        if isinstance(el.tag, str):
            el.tag = el.tag.rpartition("}")[2]
    return root


def xml_nodes(text: str, tag: str) -> Iterator[ET.Element | Rejection]:
    """Elements of a document; of a damaged one the complete elements, and what its end cut off."""
    body = text.lstrip("﻿ \t\n")
    try:
        root = without_namespaces(ET.fromstring(body))
        yield from ([root] if root.tag == tag else root.iter(tag))
        return
    except ET.ParseError:
        pass
    end = 0
    for m in re.finditer(rf"<{tag}\b.*?</{tag}>", body, re.S | re.I):
        end = m.end()
        try:
            yield without_namespaces(ET.fromstring(m[0]))
        except ET.ParseError as e:
            yield Rejection("malformed", str(e))
    if re.search(rf"<{tag}\b", body[end:], re.I):
        yield Rejection("truncated", "the document ends inside an element")


#: Fixed values.
ENDNOTE_TYPES = {"journal article": "article", "electronic article": "article", "conference proceedings": "conference", "conference paper": "conference", "book section": "chapter", "book": "book", "thesis": "thesis", "report": "report", "17": "article", "10": "conference", "47": "conference", "5": "chapter", "6": "book", "32": "thesis", "27": "report"}


def parse_endnote(text: str, dialect: str = "", source: str = "") -> Iterator[dict | Rejection]:
    for node in xml_nodes(text, "record"):
        if isinstance(node, Rejection):
            yield node
            continue
        accession = one(node, "accession-num")
        notes = " ".join([accession, *(x for p in ("custom1", "custom2", "notes", "remote-database-name") for x in texts(node, p))])
        url = one(node, "urls/related-urls/url", "urls/web-urls/url", "urls/pdf-urls/url")
        doi = one(node, "electronic-resource-num", "doi") or (url if "doi.org" in url.lower() else "")
        m = re.search(r"10\.\d{4,9}/\S+", doi, re.I)
        kind = node.find("ref-type")
        label = collapse(kind.get("name", "") if kind is not None else "").lower() or one(node, "reftype").lower()
        code = inner(kind)
        pmid = accession if re.fullmatch(r"\d{5,9}", accession) else first_match(re.compile(r"(?:pmid|pubmed)[:\s]*(\d{5,9})", re.I), [notes])
        r = {
            "title": one(node, "titles/title", "title"), "abstract": one(node, "abstract"), "authors": list(dict.fromkeys(filter(None, map(author_name, texts(node, "contributors/authors/author", "contributors/secondary-authors/author"))))),
            "year": year_of(one(node, "dates/year", "dates/pub-dates/date", "year"), True), "journal": one(node, "periodical/full-title", "periodical/abbr-1", "titles/secondary-title", "titles/alt-title", "alt-periodical/full-title"),
            "doi": m[0] if m else doi, "pmid": pmid, "issn": one(node, "isbn"), "volume": one(node, "volume"), "issue": one(node, "number", "issue"), "pages": pages_of(one(node, "pages")),
            "doc_type": ENDNOTE_TYPES.get(label) or type_of(label) or ENDNOTE_TYPES.get(code, ""), "language": one(node, "language").lower(), "keywords": unique([k for v in texts(node, "keywords/keyword") for k in split_keywords(v)]),
            "url": url, "cited_by": int_of(one(node, "times-cited")), "source": source or one(node, "remote-database-name", "database", "source-app") or "EndNote XML", "source_id": accession or one(node, "rec-number"), "raw": {},
        }
        yield kept(r, "title", "doi")


def parse_atom(text: str, dialect: str = "", source: str = "") -> Iterator[dict | Rejection]:
    for node in xml_nodes(text, "entry"):
        if isinstance(node, Rejection):
            yield node
            continue
        uri, published = one(node, "id"), one(node, "published")
        links = [x.get("href") for x in node.findall("link") if x.get("rel") == "alternate" and x.get("href")]
        terms = [x.get("term") for x in [*node.findall("primary_category"), *node.findall("category")] if x.get("term")]
        yield {
            "title": one(node, "title"), "abstract": one(node, "summary"), "authors": [display_name(a) for a in texts(node, "author/name")], "year": int(published[:4]) if published[:4].isdigit() else None,
            "journal": one(node, "journal_ref"), "doi": one(node, "doi"), "doc_type": "preprint", "keywords": list(dict.fromkeys(terms)), "url": (links or [uri])[0], "open_access": True,
            "source": source or "arXiv", "source_id": re.sub(r"v\d+$", "", uri.rpartition("/abs/")[2]), "raw": {"id": uri},
        }


def parse_pubmed(text: str, dialect: str = "", source: str = "") -> Iterator[dict | Rejection]:
    for node in xml_nodes(text, "PubmedArticle"):
        if isinstance(node, Rejection):
            yield node
            continue
        article, issue = "MedlineCitation/Article", "MedlineCitation/Article/Journal/JournalIssue"
        names = []
        for a in node.findall(f"{article}/AuthorList/Author"):
            family, given = one(a, "LastName"), one(a, "ForeName")
            names.append(", ".join(filter(None, (family, given))) if family else one(a, "CollectiveName"))
        parts = [(f"{x.get('Label')}: " if x.get("Label") else "") + inner(x) for x in node.findall(f"{article}/Abstract/AbstractText")]
        dois = [inner(x) for x in node.findall(f"{article}/ELocationID") if x.get("EIdType") == "doi"] or [inner(x) for x in node.findall("PubmedData/ArticleIdList/ArticleId") if x.get("IdType") == "doi"]
        when = one(node, f"{issue}/PubDate/Year") or one(node, f"{issue}/PubDate/MedlineDate")[:4]
        pmid = one(node, "MedlineCitation/PMID")
        r = {
            "title": one(node, f"{article}/ArticleTitle"), "abstract": " ".join(parts).strip(), "authors": [n for n in names if n], "year": int(when) if when.isdigit() else None,
            "journal": one(node, f"{article}/Journal/Title"), "issn": one(node, f"{article}/Journal/ISSN"), "volume": one(node, f"{issue}/Volume"), "issue": one(node, f"{issue}/Issue"),
            "pages": one(node, f"{article}/Pagination/MedlinePgn"), "doi": (dois or [""])[-1], "pmid": pmid, "language": one(node, f"{article}/Language").lower(),
            "doc_type": medline_type([x.lower() for x in texts(node, f"{article}/PublicationTypeList/PublicationType")]),
            "keywords": texts(node, "MedlineCitation/KeywordList/Keyword") + texts(node, "MedlineCitation/MeshHeadingList/MeshHeading/DescriptorName"), "source": source or "PubMed", "source_id": pmid, "raw": {},
        }
        yield kept(r, "title", "doi", "pmid")


# --- BibTeX

#: Fixed values.
BIBTEX_TYPES = {"article": "article", "inproceedings": "conference", "conference": "conference", "proceedings": "conference", "incollection": "chapter", "inbook": "chapter", "book": "book", "booklet": "book", "collection": "book", "phdthesis": "thesis", "mastersthesis": "thesis", "thesis": "thesis", "techreport": "report", "manual": "report", "unpublished": "preprint"}
#: Fixed values.
ACCENTS = {"'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "u": "̆", "v": "̌", "H": "̋", "c": "̧", "k": "̨", "r": "̊", "b": "̱", "d": "̣"}
#: Fixed values.
SYMBOLS = {
    "ss": "ß", "SS": "SS", "l": "ł", "L": "Ł", "o": "ø", "O": "Ø", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "i": "i", "j": "j", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ", "dj": "đ", "DJ": "Đ", "ng": "ŋ", "NG": "Ŋ",
    "textendash": "–", "textemdash": "—", "textquotesingle": "'", "textquotedblleft": "“", "textquotedblright": "”", "textquoteleft": "‘", "textquoteright": "’", "textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^", "textbullet": "•", "textdegree": "°",
    "textregistered": "®", "texttrademark": "™", "textcopyright": "©", "copyright": "©", "textless": "<", "textgreater": ">", "textbar": "|", "textpm": "±", "textmu": "µ", "textperiodcentered": "·", "textellipsis": "…", "ldots": "…", "dots": "…", "pounds": "£", "euro": "€", "S": "§", "P": "¶",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "lambda": "λ", "mu": "μ", "pi": "π", "sigma": "σ", "tau": "τ", "phi": "φ", "omega": "ω", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω", "Gamma": "Γ",
    "times": "×", "div": "÷", "pm": "±", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "to": "→", "rightarrow": "→", "infty": "∞", "degree": "°", "checkmark": "✓",
}


def delatex(text: str) -> str:
    """LaTeX as plain Unicode, read from left to right: accents compose, symbols are looked up, other macros keep their
    argument, escaped characters stay, braces and mathematical marks go."""
    out: list[str] = []
    i, n = 0, len(text)

    def letter(at: int) -> tuple[str, int]:
        while at < n and text[at] in " {\\":
            at += 1
        return (text[at] if at < n else ""), at + 1

    while i < n:
        c = text[i]
        if c != "\\":
            out.append(" " if c == "~" else "" if c in "{}$" else c)
            i += 1
            continue
        m = re.compile(r"[A-Za-z]+\*?").match(text, i + 1)
        name = m[0] if m else text[i + 1 : i + 2]
        after = i + 1 + len(name)
        if name in ACCENTS and (not m or after < n and text[after] in " {\\"):
            base, i = letter(after)
            out.append(base + ACCENTS[name])
        elif name in SYMBOLS:
            out.append(SYMBOLS[name])
            i = after + (after < n and text[after] == " ")
        elif name == "href":
            skip = re.compile(r"\s*\{[^{}]*\}").match(text, after)
            i = skip.end() if skip else after
        else:
            if name and name in "&%$#_{}":
                out.append(name)
            elif name == "\\":
                out.append(" ")
            i = after
    return collapse(unicodedata.normalize("NFC", "".join(out)))


def bibtex_value(text: str, i: int, strings: dict[str, str]) -> tuple[str, int]:
    """A value from ``i`` on: braced, quoted, bare or a macro, joined by #."""
    parts, n = [], len(text)
    while True:
        while i < n and text[i].isspace():
            i += 1
        if i < n and text[i] in '{"':
            quote, depth, start = text[i] == '"', 0 if text[i] == '"' else 1, i + 1
            i += 1
            while i < n:
                c = text[i]
                if c == "\\":
                    i += 1
                elif c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                    if not quote and depth == 0:
                        break
                elif quote and c == '"' and depth == 0:
                    break
                i += 1
            parts.append(text[start:i])
            i += 1
        else:
            m = re.compile(r"[^\s,#}\)]*").match(text, i)
            parts.append(strings.get(m[0].lower(), m[0]))
            i = m.end()
        m = re.compile(r"\s*#").match(text, i)
        if not m:
            return "".join(parts), i
        i = m.end()


def bibtex_entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    strings: dict[str, str] = {}
    i = 0
    opens = re.compile(r"@\s*([A-Za-z]+)\s*[{(]")
    name = re.compile(r"[\s,]*([^\s=,{}()\"]+)\s*=")
    while m := opens.search(text, i):
        kind, i = m[1].lower(), m.end()
        if kind in ("comment", "preamble"):
            continue
        key = ""
        if kind != "string":
            k = re.compile(r"\s*([^,\s{}]*)\s*,?").match(text, i)
            if "=" not in k[1]:
                key, i = k[1], k.end()
        fields: dict[str, str] = {}
        while f := name.match(text, i):
            value, i = bibtex_value(text, f.end(), strings)
            fields.setdefault(f[1].lower(), value)
        if kind == "string":
            strings |= {k: v for k, v in fields.items()}
        else:
            yield kind, key, fields


def bibtex_dialect(text: str) -> str:
    low = text[:40_000].lower()
    has = lambda *xs: any(x in low for x in xs)
    if has("author_keywords", "www.scopus.com") or re.search(r"cited\s+by\s*:?\s*\d|source\s*=\s*[{\"]scopus", low):
        return "scopus"
    if has("numpages", "articleno", "association for computing machinery", "acm.org", "@inproceedings{10.1145/") or re.search(r"doi\s*=\s*[{\"]10\.1145/", low):
        return "acm"
    if has("ieeexplore") or ("ieee" in low and has("keywords", "booktitle", "issn")):
        return "ieee"
    if "unique-id" in low and "wos:" in low:
        return "wos"
    return "arxiv" if "archiveprefix" in low and "arxiv" in low else "generic"


def bibtex_names(value: str) -> list[str]:
    """Names joined by "and" outside braces."""
    depth, start, parts = 0, 0, []
    for m in re.finditer(r"[{}]|\s+and\s+", value):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif depth <= 0:
            parts.append(value[start : m.start()])
            start = m.end()
    names = (delatex(p) for p in [*parts, value[start:]])
    return [author_name(x) for x in names if x and x.lower() != "others"]


def parse_bibtex(text: str, dialect: str = "auto", source: str = "") -> Iterator[dict | Rejection]:
    dialect = bibtex_dialect(text) if dialect in ("auto", "") else dialect
    for kind, key, f in bibtex_entries(text):
        if not f:
            yield Rejection("empty", f"@{kind} without fields")
            continue
        g = lambda *names: next((f[n] for n in names if f.get(n)), "")  # noqa: E731, B023
        note, url = g("note", "annote"), collapse(g("url", "ee", "link", "howpublished")).replace("\\", "")
        doi = collapse(g("doi")).replace("\\", "")
        if not doi and "doi.org" in url.lower():
            doi = first_match(re.compile(r"(10\.\d{4,9}/[^\s{}\"'<>]+)", re.I), [url])
        doc_type = BIBTEX_TYPES.get(kind, "") or type_of(g("type", "documenttype", "doc_type"))
        if g("archiveprefix", "eprinttype").lower() == "arxiv" or "arxiv" in g("journal", "booktitle", "eprint").lower():
            doc_type = "preprint" if kind == "misc" else doc_type or "preprint"
        ids = [x for x in (g("pmid"), note, g("eprint")) if x]
        pmid = next((x.strip() for x in ids if re.fullmatch(r"\d{7,8}", x.strip())), "") or first_match(re.compile(r"(?:pmid|pubmed)[:\s]*(\d{5,9})", re.I), ids)
        r = {
            "title": delatex(g("title", "titre")), "abstract": delatex(g("abstract")), "authors": bibtex_names(g("author")) or bibtex_names(g("editor")), "year": year_of(g("year", "date", "issue_date", "urldate"), True),
            "journal": delatex(g("journal", "journaltitle", "booktitle", "series", "publisher")), "doi": doi, "pmid": pmid, "issn": collapse(g("issn")), "volume": delatex(g("volume")), "issue": delatex(g("number", "issue")),
            "pages": pages_of(delatex(g("pages", "page"))) or collapse(g("articleno")), "doc_type": doc_type, "language": collapse(g("language", "langid")).lower(), "keywords": split_keywords(delatex(g("keywords", "author_keywords", "keyword", "index_keywords"))),
            "url": url, "cited_by": int_of(first_match(re.compile(r"cited\s+by\s*:?\s*(\d+)", re.I), [note])), "source": source or f"BibTeX/{dialect}", "source_id": key, "raw": {"dialect": dialect, "entry_type": kind},
        }
        yield kept(r, "title", "doi")


# --- tables

#: For each vendor, the headers that hold a field, the first present one counts.
CSV_MAPS = {
    "scopus": {"title": ["Title"], "authors": ["Authors", "Author full names", "Author Names"], "year": ["Year"], "journal": ["Source title"], "pages_start": ["Page start"], "pages_end": ["Page end"], "keywords": ["Author Keywords"], "keywords2": ["Index Keywords"], "doc_type": ["Document Type"], "language": ["Language of Original Document", "Language"], "cited_by": ["Cited by"], "url": ["Link", "DOI Link"], "scopus_id": ["EID"], "pmid": ["PubMed ID"]},
    "wos": {"title": ["Article Title", "Title"], "authors": ["Author Full Names", "Authors"], "year": ["Publication Year", "Year Published"], "journal": ["Source Title", "Journal"], "pages_start": ["Start Page"], "pages_end": ["End Page"], "keywords": ["Author Keywords"], "keywords2": ["Keywords Plus"], "affiliations": ["Addresses", "Affiliations"], "references": ["Cited References", "References"], "cited_by": ["Times Cited, All Databases", "Times Cited, WoS Core"], "url": ["DOI Link"], "source_id": ["UT (Unique WOS ID)", "UT (Unique ID)"], "open_access": ["Open Access Designations"]},
    "ieee": {"title": ["Document Title"], "year": ["Publication Year"], "journal": ["Publication Title"], "issn": ["ISSN", "ISBNs"], "keywords2": ["IEEE Terms", "INSPEC Controlled Terms"], "doc_type": ["Document Identifier", "Content Type"], "cited_by": ["Article Citation Count"], "url": ["PDF Link"]},
    "dimensions": {"authors": ["Authors", "Authors (Raw Affiliation)"], "year": ["PubYear", "Publication Year"], "journal": ["Source title", "Source Title/Anthology Title"], "pages": ["Pagination", "Pages"], "keywords": ["MeSH terms", "Keywords"], "doc_type": ["Publication Type", "Document Type"], "cited_by": ["Times cited"], "url": ["Source Linkout", "Dimensions URL"], "source_id": ["Publication ID"]},
    "ebsco": {"title": ["Title", "Article Title"], "year": ["Year", "Publication Date"], "journal": ["Journal", "Journal Title", "Source"], "keywords": ["Subjects", "Keywords", "Subject Terms"], "url": ["PLink", "URL"], "source_id": ["Accession Number", "An"]},
    "embase": {"authors": ["Author Names", "Authors", "Author"], "year": ["Date of Publication", "Publication Year", "Year"], "journal": ["Source title", "Journal"], "issn": ["ISSN", "CODEN"], "keywords": ["Author Keywords", "Emtree Drug Index Terms", "Emtree Medical Index Terms"], "keywords2": ["Emtree Medical Index Terms (Major Focus)", "Emtree Drug Index Terms (Major Focus)"], "affiliations": ["Author Address"], "language": ["Language of Article", "Language"], "url": ["Full Text Link", "Embase Link"], "pmid": ["Medline PMID", "PMID"], "source_id": ["Embase Accession ID", "Accession Number", "PUI"]},
    "proquest": {"title": ["Title", "Document Title"], "authors": ["Author", "Authors"], "year": ["Publication year", "Year", "publication date"], "journal": ["publication title", "Journal"], "doi": ["DOI", "digitalObjectIdentifier"], "keywords": ["Subject", "subjectTerms", "Keywords"], "keywords2": ["Identifier / keyword", "identifierKeywords"], "doc_type": ["Document type", "Source type", "Publication type"], "language": ["Language of Publication", "Language"], "url": ["document url", "URL"], "source_id": ["StoreId", "ProQuest document ID", "Accession Number"]},
    "generic": {"title": ["Title", "Article Title", "Document Title", "Primary Title"], "authors": ["Authors", "Author", "Author Full Names", "Author Names", "Creator"], "year": ["Year", "Publication Year", "PubYear", "Date", "Publication Date"], "journal": ["Journal", "Source title", "Publication Title", "Journal Title", "Container Title", "Periodical"], "doi": ["DOI", "Digital Object Identifier"], "abstract": ["Abstract", "Abstract Note", "Summary"], "volume": ["Volume"], "issue": ["Issue", "Number"], "pages": ["Pages", "Pagination", "Page Range"], "pages_start": ["Page start", "Start Page", "First Page"], "pages_end": ["Page end", "End Page", "Last Page"], "issn": ["ISSN", "eISSN", "ISBN"], "keywords": ["Keywords", "Author Keywords", "Subjects", "Subject Terms"], "keywords2": ["Index Keywords", "Keywords Plus", "IEEE Terms"], "affiliations": ["Affiliations", "Addresses", "Author Address", "Author affiliation", "Author Affiliations"], "references": ["References", "Cited References"], "doc_type": ["Document Type", "Publication Type", "Type", "Item Type"], "language": ["Language"], "cited_by": ["Cited by", "Times cited", "Times Cited, All Databases", "Citation Count"], "url": ["URL", "Link", "PDF Link"], "source_id": ["Accession Number", "ID", "Publication ID", "UT (Unique WOS ID)"], "pmid": ["PMID", "PubMed ID"], "scopus_id": ["EID", "Scopus ID"], "open_access": ["Open Access"]},
}
#: How much a header says that a table is a vendor's: 3 is its own, 1 is weak.
CSV_SIGNS = {
    "scopus": {"eid": 3, "citedby": 2, "authorkeywords": 1, "indexkeywords": 2, "sourcetitle": 1, "languageoforiginaldocument": 2, "documenttype": 1},
    "wos": {"utuniquewosid": 3, "utuniqueid": 3, "articletitle": 2, "publicationyear": 1, "keywordsplus": 3, "timescitedalldatabases": 3, "timescitedwoscore": 3, "authorfullnames": 1},
    "ieee": {"documenttitle": 3, "ieeeterms": 3, "inspeccontrolledterms": 3, "publicationtitle": 2, "pdflink": 2, "articlecitationcount": 2},
    "dimensions": {"pubyear": 3, "publicationid": 3, "timescited": 2, "dimensionsurl": 3, "sourcelinkout": 2, "meshterms": 1},
    "ebsco": {"accessionnumber": 3, "plink": 3, "subjectterms": 2, "journal": 1, "an": 1},
    "embase": {"embaseaccessionid": 3, "medlinepmid": 3, "emtreedrugindexterms": 3, "emtreemedicalindexterms": 3, "authornames": 2, "dateofpublication": 2, "languageofarticle": 2},
    "proquest": {"storeid": 3, "proquestdocumentid": 3, "documenturl": 3, "identifierkeyword": 2, "subjectterms": 1, "publicationyear": 1, "publicationtitle": 1},
}


def header_key(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


def csv_dialect(header: list[str]) -> str:
    keys = set(map(header_key, header))
    score = {name: sum(w for k, w in signs.items() if k in keys) for name, signs in CSV_SIGNS.items()}
    best = max(score, key=lambda n: score[n])
    return best if score[best] >= 3 else "generic"


def csv_columns(header: list[str], dialect: str) -> dict[str, int]:
    """Field -> place of its column: by the vendor's map, then by the generic one."""
    at: dict[str, int] = {}
    for i, name in enumerate(header):
        at.setdefault(header_key(name), i)
    out: dict[str, int] = {}
    for table in (CSV_MAPS.get(dialect, {}), CSV_MAPS["generic"]):
        for name, headers in table.items():
            found = next((at[header_key(h)] for h in headers if header_key(h) in at), None)
            if found is not None and name not in out:
                out[name] = found
    return out


def csv_delimiter(text: str) -> str:
    """The mark that splits the header into most cells, quotes respected."""
    first = next((x for x in text.split("\n") if x.strip()), "")
    return max(",;\t|", key=lambda d: len(next(csv.reader([first], delimiter=d), [])))


def parse_grid(rows: list[list[str]], dialect: str = "auto", source: str = "") -> Iterator[dict | Rejection]:
    if not rows:
        return
    header = [collapse(c) for c in rows[0]]
    if not any(header):
        yield from (Rejection("malformed", "no header") for _ in rows)
        return
    dialect = csv_dialect(header) if dialect in ("auto", "") else dialect
    at = csv_columns(header, dialect)
    for row in rows[1:]:
        cell = lambda name: collapse(row[at[name]]) if name in at and at[name] < len(row) else ""  # noqa: E731, B023
        url, doi = cell("url"), cell("doi")
        if not doi and "doi.org" in url.lower():
            doi = first_match(re.compile(r"(10\.\d{4,9}/\S+)"), [url])
        if not (cell("title") or doi):
            yield Rejection("no_content" if any(map(collapse, row)) else "empty", "no title and no DOI")
            continue
        span = "-".join(filter(None, (cell("pages_start"), cell("pages_end")))) if cell("pages_start") else ""
        eid, own = cell("scopus_id"), cell("source_id")
        made_up = bool(re.match(r"[a-z]+:", eid))  # an export of this library for a record without the vendor's id
        own = own or eid
        if not own:
            own = first_match(re.compile({"ieee": r"arnumber=(\d+)", "proquest": r"docview/(\d+)"}.get(dialect, r"(?!)()")), [url])
        split = lambda name: [x for x in map(str.strip, cell(name).split(";")) if x]
        yield {
            "title": cell("title"), "abstract": cell("abstract"), "authors": split_authors(cell("authors")), "affiliations": split("affiliations"), "references": split("references"), "year": year_of(cell("year"), True),
            "journal": cell("journal"), "doi": doi, "pmid": cell("pmid"), "scopus_id": "" if made_up else eid, "issn": cell("issn"), "volume": cell("volume"), "issue": cell("issue"), "pages": pages_of(cell("pages")) or pages_of(span),
            "doc_type": type_of(cell("doc_type")), "language": cell("language").lower(), "keywords": unique(split_keywords(cell("keywords")) + split_keywords(cell("keywords2"))), "url": url, "open_access": open_of(cell("open_access")),
            "cited_by": int_of(cell("cited_by")), "source": source or f"CSV/{dialect}", "source_id": own, "raw": {"dialect": dialect},
        }


def parse_csv(text: str, dialect: str = "auto", source: str = "") -> Iterator[dict | Rejection]:
    csv.field_size_limit(1 << 26)
    try:
        rows = list(csv.reader(io.StringIO(text.replace("\0", "")), delimiter=csv_delimiter(text)))
    except csv.Error as e:
        yield Rejection("malformed", str(e))
        return
    while rows and not any(map(str.strip, rows[0])):
        rows.pop(0)
    yield from parse_grid(rows, dialect, source)


class Tables(html.parser.HTMLParser):
    """All tables of a document, nested ones for themselves."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done, self.open, self.hidden = [], [], 0  # open: [rows, cells of the row or None, texts of the cell or None]

    def end_cell(self):
        if self.open and self.open[-1][2] is not None:
            top = self.open[-1]
            top[1] = (top[1] or []) + [collapse("".join(top[2]))]
            top[2] = None

    def end_row(self):
        self.end_cell()
        if self.open and self.open[-1][1] is not None:
            if any(self.open[-1][1]):
                self.open[-1][0].append(self.open[-1][1])
            self.open[-1][1] = None

    def end_table(self):
        self.end_row()
        if self.open:
            self.done.append(self.open.pop()[0])

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            self.open.append([[], None, None])
        elif tag == "tr":
            self.end_row()
            if self.open:
                self.open[-1][1] = []
        elif tag in ("td", "th") and self.open:
            self.end_cell()
            self.open[-1][2] = []
        elif tag in ("br", "p", "div", "li"):
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th"):
            self.end_cell()
        elif tag == "tr":
            self.end_row()
        elif tag == "table":
            self.end_table()

    def handle_data(self, data):
        if not self.hidden and self.open and self.open[-1][2] is not None:
            self.open[-1][2].append(data)


def html_grid(text: str) -> list[list[str]]:
    """The table with most rows (then columns) that has a header and data; short rows are filled up."""
    tables = Tables()
    tables.feed(text)
    tables.close()
    while tables.open:
        tables.end_table()
    found = [t for t in tables.done if len(t) >= 2]
    best = max(found, key=lambda t: (len(t), max(map(len, t))), default=[])
    return [r + [""] * (len(best[0]) - len(r)) for r in best]


def parse_html(text: str, dialect: str = "auto", source: str = "") -> Iterator[dict | Rejection]:
    yield from parse_grid(html_grid(text), dialect, source)


PARSERS = {"ris": parse_ris, "wos": parse_wos, "nbib": parse_nbib, "enw": parse_enw, "endnote": parse_endnote, "atom": parse_atom, "pubmed": parse_pubmed, "bibtex": parse_bibtex, "csv": parse_csv, "html": parse_html}


def parse(text: str, fmt: str = "auto", dialect: str = "auto", source: str = "") -> list[dict | Rejection]:
    """Records and rejections of a text. Never raises on damaged input."""
    fmt = detect_format(text) if fmt == "auto" else fmt
    if not text.strip():
        return []
    if fmt not in PARSERS:
        return [Rejection("unreadable", "no known format")]
    out: list[dict | Rejection] = []
    try:
        for found in PARSERS[fmt](text, dialect, source):
            out.append(found)
    except Exception as e:  # a damaged file must not cost the ones beside it
        out.append(Rejection("malformed", f"{type(e).__name__}: {e}"[:500]))
    return out


# --- files

OUTCOME = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "format", "encoding")] + [T.StructField("at", T.IntegerType()), T.StructField("reason", T.StringType()), T.StructField("detail", T.StringType())] + [f for f in RECORD if f.name not in ("ord", "uid", "search_id", "provenance")])


#: Rows and characters of text that a frame of outcomes holds at most (or one file's).
FRAME_ROWS, FRAME_CHARS = 5000, 8_000_000


def outcome(path: str, fmt: str, encoding: str, at: int, found: dict | Rejection) -> tuple:
    import json

    head = (path, fmt, encoding, at)
    if isinstance(found, Rejection):
        empty = [None] * (len(OUTCOME) - len(head) - 2)
        return (*head, found.reason, found.detail[:500], *empty)
    values = []
    for f in list(OUTCOME)[len(head) + 2 :]:
        v = found.get(f.name)
        if f.name == "raw":
            v = json.dumps(v or {}, sort_keys=True, ensure_ascii=False)
        elif f.name in LISTS:
            v = list(v or [])
        elif f.name in (*STRINGS, "source", "source_id"):
            v = v or ""
        values.append(v)
    return (*head, None, None, *values)


def frames(batches: Iterator[pd.DataFrame], fmt: str = "auto", dialect: str = "auto", source: str = "", encoding: str = "auto") -> Iterator[pd.DataFrame]:
    """Outcomes of files (path, content). Those of many small files come in one frame, since a frame costs as much as the
    parsing of dozens of them."""

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=OUTCOME.names).astype({"year": "Int32", "cited_by": "Int32", "open_access": "boolean", "at": "Int32"})

    rows, chars = [], 0
    for pdf in batches:
        for p, data in zip(pdf["path"], pdf["content"]):
            text, name, kind = decoded(bytes(data), encoding)
            likely = detect_format(text)
            used = likely if fmt == "auto" else fmt
            found = [Rejection("unreadable", kind)] if kind else parse(text, used, dialect, source)
            lost = text.count("\ufffd")
            notes = [f"{lost} undecodable characters replaced"] * bool(lost) + [f"read as {used}, looks like {likely}"] * bool(likely and used != likely) + ["no records"] * (not found)
            found += [Rejection(NOTE, n) for n in notes]
            chars += len(text)
            for i, x in enumerate(found):
                rows.append(outcome(p, used, name, i, x))
                if len(rows) == FRAME_ROWS:
                    yield framed(rows)
                    rows, chars = [], 0
            if rows and chars >= FRAME_CHARS:
                yield framed(rows)
                rows, chars = [], 0
    if rows:
        yield framed(rows)


def read_exports(spark: SparkSession, path: str, fmt: str = "auto", dialect: str = "auto", source: str = "", encoding: str = "auto") -> DataFrame:
    """A row for each stanza of each file under ``path``: the record's fields, or reason and detail. ``at`` is its place
    in its file, so input order is (path, at)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return parsed(files, fmt, dialect, source, encoding)


def parsed(files: DataFrame, fmt: str = "auto", dialect: str = "auto", source: str = "", encoding: str = "auto") -> DataFrame:
    """``read_exports`` of files that are there as rows (path, content)."""

    return files.mapInPandas(lambda batches: frames(batches, fmt, dialect, source, encoding), OUTCOME)


def formats(files: DataFrame, encoding: str = "auto") -> DataFrame:
    """(path, format, encoding) of each file as ``parsed`` finds them; whole files are decoded, no record is made."""

    def run(batches):
        for pdf in batches:
            read = [decoded(bytes(data), encoding) for data in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "format": [detect_format(text) for text, _, _ in read], "encoding": [name for _, name, _ in read]})

    return files.mapInPandas(run, "path string, format string, encoding string")


def accounts(outcomes: DataFrame) -> DataFrame:
    """For each file: stanzas seen, accepted and rejected by reason; seen = accepted + rejected; and the notes on it."""
    counts = [F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in REASONS]
    stanza = F.coalesce(F.col("reason") != NOTE, F.lit(True))
    notes = F.array_sort(F.collect_list(F.when(~stanza, F.col("detail"))))
    return outcomes.groupBy("path", "format", "encoding").agg(F.count(F.when(stanza, 1)).alias("seen"), F.count(F.when(F.col("reason").isNull(), 1)).alias("accepted"), *counts, notes.alias("notes"))


def records_of(outcomes: DataFrame) -> DataFrame:
    """The accepted records in the record schema, identifiers in their canonical form; ord from (path, at)."""
    from ..functions import fields
    from ..schema import conform, numbered

    good = outcomes.where("reason is null").withColumns({"doi": fields.doi("doi"), "pmid": fields.pmid("pmid"), "openalex_id": fields.openalex("openalex_id")})
    return conform(numbered(good, "path", "at"))
