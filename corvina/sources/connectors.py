"""Live sources as a batch data source. A box without network registers and plans it; reading needs a network.

Pages are requested one after another, as the providers demand; each page becomes a row of PAGE, which
``operators.harvest.write_archive`` keeps and ``sources.mappers`` maps. A source is a row of SOURCES: its address, its
first parameters, where the items are, and how the next request follows from a page.

A key goes into a request header and into no row: what a row says of a request is redacted (secrets left out, contact
addresses masked) before it leaves the reader.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.harvest import PRIVATE, SECRETS

PAGE = "seq int, url string, params map<string,string>, status int, body string, counted int, retrieved_at string, wire_sha256 string"


def _at(body, path: str):
    for key in path.split("."):
        body = body.get(key) if isinstance(body, dict) else None
    return body


def listed(node) -> list:
    """What an API writes as one object or a list of them."""
    return node if isinstance(node, list) else [] if node is None else [node]


@dataclass
class Page:
    """What the next request may depend on: this request, the answer, items seen so far and on this page."""

    request: dict
    answer: object
    seen: int
    got: int


def by_cursor(param: str, path: str) -> Callable[[Page], dict | None]:
    """The next request carries the cursor of this page; a cursor that repeats ends the run."""

    def follow(p: Page) -> dict | None:
        cursor = _at(p.answer, path)
        return p.request | {param: cursor} if cursor and cursor != p.request.get(param) and p.got else None

    return follow


def by_offset(param: str, first: int = 0, most: int | None = None, total: str = "") -> Callable[[Page], dict | None]:
    """The next request starts after what has been seen, up to the provider's last offset and to the total that it names."""

    def follow(p: Page) -> dict | None:
        at = first + p.seen
        known = int(_at(p.answer, total) or 0) if total else None
        done = not p.got or (most is not None and at > most) or (known is not None and p.seen >= known)
        return None if done else p.request | {param: at}

    return follow


def by_page(param: str) -> Callable[[Page], dict | None]:
    return lambda p: p.request | {param: int(p.request.get(param, 1)) + 1} if p.got else None


def entries(answer) -> int:
    return len(re.findall(r"<entry[\s>]", answer)) if isinstance(answer, str) else 0


def articles(answer) -> int:
    return len(re.findall(r"<Pubmed(?:Book)?Article[\s>]", answer)) if isinstance(answer, str) else 0


EUTILS = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/"
WINDOW = 200


def pubmed_windows(p: Page) -> dict | None:
    """After the search, which leaves its result on the server, windows of records."""
    if isinstance(p.answer, dict):
        found = p.answer.get("esearchresult") or {}
        total, start = int(found.get("count") or 0), 0
        if not total:
            return None
        kept = {k: v for k, v in p.request.items() if k in ("api_key", "email", "tool")}
        kept |= {"_url": EUTILS + "efetch.fcgi", "_total": total, "db": "pubmed", "query_key": found.get("querykey", "1"), "WebEnv": found.get("webenv", ""), "rettype": "abstract", "retmode": "xml", "retmax": WINDOW}
    else:
        kept, start = p.request, int(p.request["retstart"]) + WINDOW
        if start >= p.request["_total"]:
            return None
    return kept | {"retstart": start}


def preprint_days(p: Page) -> dict | None:
    """The next hundred of a span of days."""
    note = (listed(_at(p.answer, "messages")) or [{}])[0]
    total = int(note.get("total") or 0)
    return p.request | {"cursor": p.seen} if p.got and p.seen < total else None


@dataclass(frozen=True)
class Source:
    """``items``: the path of the list of items, or a function that counts them; ``key``: the header that carries a key;
    ``path``: parameters that stand in the address."""

    url: str
    first: dict
    items: str | Callable
    follow: Callable[[Page], dict | None]
    key: str = ""
    path: tuple[str, ...] = ()
    repeats_end: bool = field(default=False)


#: Addresses, page sizes, headers and limits of the providers.
SOURCES = {
    "crossref": Source("https://api.crossref.org/works", {"rows": 100, "cursor": "*"}, "message.items", by_cursor("cursor", "message.next-cursor")),
    "openalex": Source(
        "https://api.openalex.org/works",
        {"per-page": 100, "cursor": "*", "select": "id,doi,display_name,title,publication_year,type,language,cited_by_count,ids,authorships,primary_location,open_access,biblio,abstract_inverted_index,referenced_works"},
        "results", by_cursor("cursor", "meta.next_cursor"),
    ),
    "semanticscholar": Source("https://api.semanticscholar.org/graph/v1/paper/search", {"limit": 100, "offset": 0}, "data", by_offset("offset", most=999), key="x-api-key"),
    "scopus": Source("https://api.elsevier.com/content/search/scopus", {"count": 25, "start": 0}, "search-results.entry", by_offset("start", most=4975), key="X-ELS-APIKey"),
    "wos": Source("https://api.clarivate.com/apis/wos-starter/v1/documents", {"db": "WOS", "limit": 50, "page": 1}, "hits", by_page("page"), key="X-ApiKey", repeats_end=True),
    "wos_expanded": Source("https://api.clarivate.com/api/wos", {"databaseId": "WOS", "count": 100, "firstRecord": 1}, "Data.Records.records.REC", by_offset("firstRecord", first=1, total="QueryResult.RecordsFound"), key="X-ApiKey"),
    "pubmed": Source(EUTILS + "esearch.fcgi", {"db": "pubmed", "retmode": "json", "usehistory": "y", "retmax": 0}, articles, pubmed_windows),
    "arxiv": Source("https://export.arxiv.org/api/query", {"start": 0, "max_results": 100}, entries, by_offset("start")),
    "biorxiv": Source("https://api.biorxiv.org/details/biorxiv", {"cursor": 0}, "collection", preprint_days, path=("from", "to", "cursor")),
    "medrxiv": Source("https://api.biorxiv.org/details/medrxiv", {"cursor": 0}, "collection", preprint_days, path=("from", "to", "cursor")),
    "openalex_lookup": Source("https://api.openalex.org/works", {"per-page": 50}, "results", lambda p: None),
    "crossref_lookup": Source("https://api.crossref.org/works", {}, "message", lambda p: None, path=("doi",)),
}

#: DOIs of one lookup request, where a request may ask for several.
BATCH = 25
EPOCH = date(2013, 1, 1)


def interval(years: tuple[int, int] | None, today: date | None = None) -> tuple[str, str]:
    """The days of a span of years, for sources that list by day; never beyond today."""
    today = today or date.today()
    if not years:
        return EPOCH.isoformat(), today.isoformat()
    return f"{years[0]}-01-01", min(f"{years[1]}-12-31", today.isoformat())


def lookups(source: str, dois: list[str]) -> list[dict]:
    """The parameters of the requests that look DOIs up: one each, or BATCH at a time."""
    if source == "crossref_lookup":
        return [{"doi": d} for d in dois]
    return [{"filter": "doi:" + "|".join(dois[i : i + BATCH])} for i in range(0, len(dois), BATCH)]


def redacted(params: dict) -> dict[str, str]:
    """What a record of a request may say: no secrets, contact addresses masked."""
    kept = {k: v for k, v in params.items() if not k.startswith("_") and k.lower() not in SECRETS}
    return {k: "<redacted>" if k.lower() in PRIVATE else str(v) for k, v in kept.items()}


def address(source: Source, request: dict) -> str:
    base = request.get("_url", source.url)
    parts = [urllib.parse.quote(str(request[p]), safe="") for p in source.path if p in request]
    query = {k: v for k, v in request.items() if not k.startswith("_") and k not in source.path}
    return "/".join([base, *parts]) + (f"?{urllib.parse.urlencode(query)}" if query else "")


def fetch(url: str, headers: dict[str, str] | None = None, tries: int = 4) -> tuple[int, str]:
    """Status and body; 429 and 5xx are tried again after growing pauses."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=60) as r:
                return r.status, r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or attempt + 1 == tries:
                return e.code, ""
            time.sleep(2**attempt)
    return 0, ""


def pages(name: str, params: dict, most: int, get: Callable = fetch, key: str = "") -> Iterator[tuple]:
    """Rows of PAGE until ``most`` items, an empty page, an error, a cursor or a page that repeats. ``counted`` says how
    many of a page's items are within ``most``: the last page may hold more."""
    source = SOURCES[name]
    headers = {source.key: key} if key and source.key else {}
    request, seen, seq, before = source.first | params, 0, 0, None
    while request is not None and seen < most:
        status, body = get(address(source, request), headers)
        try:
            answer = json.loads(body) if status == 200 else None
        except ValueError:
            answer = body
        got = 0 if answer is None else source.items(answer) if callable(source.items) else len(listed(_at(answer, source.items)))
        digest = hashlib.sha256(body.encode()).hexdigest()
        if source.repeats_end and digest == before:
            return
        shown = redacted(request)
        yield seq, address(source, {k: v for k, v in request.items() if k == "_url"} | shown), shown, status, body, min(got, most - seen), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), digest
        if status != 200:
            return
        seen, seq, before = seen + got, seq + 1, digest
        request = source.follow(Page(request, answer, seen, got))


def within(items: DataFrame, pages_: DataFrame) -> DataFrame:
    """The items (seq, at, ...) of the pages (seq, counted, ...) that are within the limit of the run."""
    from pyspark.sql import functions as F

    return items.join(F.broadcast(pages_.select("seq", "counted")), "seq").where("at < counted").drop("counted")  # a row for each request


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.name = options.get("source", "")
        self.most = int(options.get("maxresults", "1000"))
        self.params = json.loads(options.get("params", "{}"))
        self.key_variable = options.get("keyvariable", "")
        if self.name not in SOURCES:
            raise ValueError(f"unknown source {self.name!r}; known: {', '.join(SOURCES)}")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        yield from pages(self.name, self.params, self.most, key=os.environ.get(self.key_variable, ""))


class Bibliography(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bibliography"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """``spark.read.format("bibliography").option("source", "crossref").option("params", '{"query": "..."}')``; option
    keyvariable names the environment variable of the executors that holds the provider's key."""
    spark.dataSource.register(Bibliography)
