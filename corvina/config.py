"""The configuration of a review: which keys there are, what they may hold, and a checksum of what was asked.

Every fault is reported, not just the first one; an unknown key is a fault, as a misspelt limit would silently widen a
search.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import fields as dataclass_fields

from .operators.match import Options
from .operators.search import DIALECTS
from .sources.connectors import SOURCES

Check = Callable[[object], str]


def _is(kind: type | tuple[type, ...], what: str, holds: Callable = lambda v: True) -> Check:
    return lambda v: "" if isinstance(v, kind) and not (isinstance(v, bool) and kind is not bool) and holds(v) else f"must be {what}"


def _listed(item: Check, what: str) -> Check:
    return lambda v: "" if isinstance(v, list) and all(not item(x) for x in v) else f"must be a list of {what}"


_text = _is(str, "a text")
_years = _is(list, "two years in order", lambda v: len(v) == 2 and all(isinstance(y, int) for y in v) and 1000 <= v[0] <= v[1] <= 2999)
_count = _is(int, "a positive number", lambda v: v > 0)


def _section(keys: dict[str, Check], needed: tuple[str, ...] = ()) -> Check:
    def check(value: object) -> str:
        if not isinstance(value, dict):
            return "must be an object"
        return "; ".join(f"{k}: {why}" for k, why in faults_of(value, keys, needed))

    return check


def faults_of(given: dict, keys: dict[str, Check], needed: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    out = [(k, "unknown key") for k in given if k not in keys]
    out += [(k, "missing") for k in needed if k not in given]
    return out + [(k, why) for k, check in keys.items() if k in given and (why := check(given[k]))]


_OPTION_TYPES = {"bool": _is(bool, "true or false"), "int": _is(int, "a number"), "float": _is((int, float), "a number")}
QUERY = {"blocks": _listed(_listed(_text, "terms"), "lists of terms"), "years": _years, "doc_types": _listed(_text, "document types"), "languages": _listed(_text, "languages"), "title_only": _is(bool, "true or false")}
SOURCE = {"name": _is(str, "one of " + ", ".join(SOURCES), lambda v: v in SOURCES), "max_results": _count, "params": _is(dict, "an object"), "keyvariable": _text}
FILE = {"path": _text, "format": _text, "dialect": _text, "source": _text, "encoding": _text}
DEDUP = {f.name: _OPTION_TYPES[f.type] for f in dataclass_fields(Options)} | {"mode": _is(str, "sequential or pairwise", lambda v: v in ("sequential", "pairwise"))}
FLOW = {k: _is(int, "a number", lambda v: v >= 0) for k in ("automation_excluded", "other_excluded", "records_excluded", "reports_not_retrieved", "fulltext_excluded", "studies_included")}
KEYS: dict[str, Check] = {
    "title": _text,
    "query": _section(QUERY, ("blocks",)),
    "sources": _listed(_section(SOURCE, ("name",)), "sources"),
    "files": _listed(_section(FILE, ("path",)), "files"),
    "dedup": _section(DEDUP),
    "flow": _section(FLOW),
    "exports": _listed(_is(str, "csv, screening, scopus, ris or bibtex", lambda v: v in ("csv", "screening", "scopus", "ris", "bibtex")), "csv, screening, scopus, ris, bibtex"),
    "targets": _listed(_is(str, "a dialect", lambda v: v in DIALECTS), ", ".join(DIALECTS)),
}


def faults(config: object) -> list[str]:
    """What is wrong with a configuration; empty if nothing is."""
    if not isinstance(config, dict):
        return ["the configuration must be an object"]
    out = [f"{k}: {why}" for k, why in faults_of(config, KEYS)]
    if not config.get("sources") and not config.get("files"):
        out.append("neither sources nor files")
    if config.get("sources") and "query" not in config:
        out.append("sources need a query")
    return out


def checksum(config: dict) -> str:
    """The same for every spelling of the same configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
