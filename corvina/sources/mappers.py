"""Responses of bibliographic APIs as records: nested JSON read with a schema and mapped by built-in expressions.

``items`` is a DataFrame with a column ``json``, one item of a response each (``unnest`` takes them out of archived
responses). What an API writes as one object or a list of them is read as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.text import column, display_name
from ..schema import conform

CROSSREF = "title array<string>, `container-title` array<string>, DOI string, ISSN array<string>, volume string, issue string, page string, type string, language string, URL string, abstract string, `is-referenced-by-count` int, issued struct<`date-parts`:array<array<int>>>, author array<struct<family:string,given:string>>, reference array<struct<DOI:string,unstructured:string>>"
OPENALEX = "id string, doi string, display_name string, title string, publication_year int, type string, language string, cited_by_count int, ids struct<pmid:string>, authorships array<struct<author:struct<display_name:string>,raw_author_name:string>>, primary_location struct<landing_page_url:string,source:struct<display_name:string,issn_l:string>>, open_access struct<is_oa:boolean>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>, abstract_inverted_index map<string,array<int>>, referenced_works array<string>"
S2 = "paperId string, title string, abstract string, year string, venue string, publicationDate string, citationCount int, externalIds struct<DOI:string,PubMed:string,ArXiv:string>, authors array<struct<name:string>>, publicationTypes array<string>, openAccessPdf struct<url:string>, publicationVenue struct<name:string>"
SCOPUS = "`dc:title` string, `dc:description` string, `dc:creator` string, `prism:publicationName` string, `prism:doi` string, `prism:issn` string, `prism:volume` string, `prism:issueIdentifier` string, `prism:pageRange` string, `prism:coverDate` string, `citedby-count` string, `pubmed-id` string, eid string, subtypeDescription string, openaccessFlag boolean, authkeywords string, author string, affiliation string, `prism:url` string"
WOS = "uid string, title string, types array<string>, source struct<sourceTitle:string,publishYear:int,volume:string,issue:string,pages:struct<range:string,begin:string,end:string>>, names struct<authors:array<struct<displayName:string,wosStandard:string>>>, citations array<struct<db:string,count:int>>, identifiers struct<doi:string,issn:string,eissn:string,pmid:string>, keywords struct<authorKeywords:array<string>>, links struct<record:string>"
WOS_EXPANDED = "UID string, static_data struct<summary:struct<titles:struct<title:string>,names:struct<name:string>,doctypes:struct<doctype:string>,pub_info:struct<pubyear:string,vol:string,issue:string,page:struct<content:string>>>,fullrecord_metadata:struct<abstracts:struct<abstract:string>,keywords:struct<keyword:string>,addresses:struct<address_name:string>>>, dynamic_data struct<cluster_related:struct<identifiers:struct<identifier:string>>>"
PREPRINT = "doi string, title string, authors string, date string, version string, category string, abstract string, server string"

#: What the vendors call document types, in the order in which they count.
S2_TYPES = [("review", "review"), ("conference", "conference"), ("booksection", "chapter"), ("book", "book"), ("journalarticle", "article"), ("editorial", "editorial"), ("lettersandcomments", "letter"), ("clinicaltrial", "article"), ("casereport", "article"), ("study", "article"), ("dataset", "report")]
WOS_TYPES = [("review", "review"), ("proceedings paper", "conference"), ("book chapter", "chapter"), ("editorial material", "editorial"), ("letter", "letter"), ("article", "article"), ("book", "book")]


def unnest(responses: DataFrame, path: str) -> DataFrame:
    """(seq, at, json) of each item of the list at ``path`` (dotted) in the responses' bodies; one object is a list of one."""
    at = "$." + path
    body = F.get_json_object("body", at)
    listed = F.when(F.ltrim(body).startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    items = F.from_json(listed, "array<variant>")
    return responses.select("seq", F.posexplode(items).alias("at", "item")).select("seq", "at", F.to_json("item").alias("json"))


def _read(items: DataFrame, schema: str) -> DataFrame:
    keep = [c for c in items.columns if c != "json"]
    return items.select(*keep, F.from_json("json", schema).alias("x"))


def _listed(json: Column, schema: str) -> Column:
    """A JSON text of one object or a list of them, as a list."""
    return F.from_json(F.when(F.ltrim(json).startswith("["), json).otherwise(F.concat(F.lit("["), json, F.lit("]"))), f"array<{schema}>")


def _strings(json: Column) -> Column:
    """A JSON text of one string or a list of them (one string comes without its quotes), as a list."""
    return F.when(F.ltrim(json).startswith("["), F.from_json(json, "array<string>")).when(json.isNotNull(), F.array(json))


def _first(c: Column) -> Column:
    return F.coalesce(F.get(c, F.lit(0)), F.lit(""))


def _names(c: Column) -> Column:
    """Display names to "Family, Given", list by list in one Arrow batch."""
    return F.from_json(column(_display_all, F.to_json(F.coalesce(c, F.array().cast("array<string>")))), "array<string>")


def _display_all(names: str) -> str:
    import json

    return json.dumps([display_name(n) for n in json.loads(names or "[]") if n], ensure_ascii=False)


def _type(values: Column, table: list[tuple[str, str]], squeeze: bool) -> Column:
    lowered = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.replace(v, F.lit(" "), F.lit("")) if squeeze else v))
    out = F.lit("")
    for needle, name in reversed(table):
        out = F.when(F.array_contains(lowered, needle), F.lit(name)).otherwise(out)
    return out


def _mapped(items: DataFrame, schema: str, label: str, **values: Column) -> DataFrame:
    rows = _read(items, schema)
    ord_ = F.col("ord") if "ord" in items.columns else F.monotonically_increasing_id()
    values = {"ord": ord_, "source": F.lit(label)} | values
    out = conform(rows.select(*[v.alias(k) for k, v in values.items()]))
    return out.withColumns({"doi": fields.doi("doi"), "pmid": fields.pmid("pmid"), "openalex_id": fields.openalex("openalex_id")})


def crossref(items: DataFrame) -> DataFrame:
    x = F.col("x")
    people = F.filter(x["author"], lambda a: F.coalesce(a["family"], F.lit("")) != "")
    names = F.transform(people, lambda a: F.when(F.coalesce(a["given"], F.lit("")) != "", F.concat_ws(", ", a["family"], a["given"])).otherwise(a["family"]))
    refs = F.filter(F.transform(x["reference"], lambda r: F.btrim(F.coalesce(F.nullif(r["DOI"], F.lit("")), r["unstructured"], F.lit("")))), lambda r: r != "")
    year = F.get(F.get(x["issued"]["date-parts"], F.lit(0)), F.lit(0))
    text = fields.squeeze(F.regexp_replace(F.coalesce(x["abstract"], F.lit("")), "<[^>]+>", " "))
    return _mapped(items, CROSSREF, "Crossref", title=_first(x["title"]), abstract=text, authors=names, year=F.nullif(year, F.lit(0)), journal=_first(x["container-title"]), doi=x["DOI"], issn=_first(x["ISSN"]), volume=x["volume"], issue=x["issue"], pages=x["page"], doc_type=x["type"], language=x["language"], url=x["URL"], cited_by=x["is-referenced-by-count"], references=refs, source_id=x["DOI"])


def openalex(items: DataFrame) -> DataFrame:
    x = F.col("x")
    names = F.filter(F.transform(x["authorships"], lambda a: F.coalesce(F.nullif(a["author"]["display_name"], F.lit("")), a["raw_author_name"])), lambda n: F.coalesce(n, F.lit("")) != "")
    pages = F.concat_ws("-", F.nullif(x["biblio"]["first_page"], F.lit("")), F.nullif(x["biblio"]["last_page"], F.lit("")))
    own = F.substring_index(x["id"], "/", -1)
    refs = F.transform(x["referenced_works"], lambda r: F.substring_index(r, "/", -1))
    return _mapped(items, OPENALEX, "OpenAlex", title=F.coalesce(F.nullif(x["display_name"], F.lit("")), x["title"]), abstract=fields.rebuilt_abstract(x["abstract_inverted_index"]), authors=names, year=x["publication_year"], journal=x["primary_location"]["source"]["display_name"], doi=x["doi"], pmid=F.substring_index(x["ids"]["pmid"], "/", -1), openalex_id=own, issn=x["primary_location"]["source"]["issn_l"], volume=x["biblio"]["volume"], issue=x["biblio"]["issue"], pages=pages, doc_type=x["type"], language=x["language"], url=x["primary_location"]["landing_page_url"], open_access=x["open_access"]["is_oa"], cited_by=x["cited_by_count"], references=refs, source_id=own)


def semanticscholar(items: DataFrame) -> DataFrame:
    x = F.col("x")
    year = F.coalesce(x["year"].try_cast("int"), F.substring(x["publicationDate"], 1, 4).try_cast("int"))
    kind = _type(x["publicationTypes"], S2_TYPES, True)
    preprint = (kind == "") & (F.coalesce(x["externalIds"]["ArXiv"], F.lit("")) != "") & (F.coalesce(x["externalIds"]["DOI"], F.lit("")) == "")
    url = F.coalesce(F.nullif(x["openAccessPdf"]["url"], F.lit("")), F.concat(F.lit("https://www.semanticscholar.org/paper/"), x["paperId"]))
    return _mapped(items, S2, "Semantic Scholar", title=x["title"], abstract=x["abstract"], authors=_names(F.transform(x["authors"], lambda a: a["name"])), year=year, journal=F.coalesce(F.nullif(x["venue"], F.lit("")), x["publicationVenue"]["name"]), doi=x["externalIds"]["DOI"], pmid=x["externalIds"]["PubMed"], doc_type=F.when(preprint, "preprint").otherwise(kind), url=url, open_access=x["openAccessPdf"].isNotNull(), cited_by=x["citationCount"], source_id=x["paperId"])


def scopus(items: DataFrame) -> DataFrame:
    x = F.col("x")
    people = _listed(x["author"], "struct<authname:string,surname:string,`given-name`:string>")
    full = F.filter(F.transform(people, lambda a: F.when(F.coalesce(a["surname"], F.lit("")) != "", F.concat_ws(", ", a["surname"], F.nullif(a["given-name"], F.lit("")))).otherwise(a["authname"])), lambda n: F.coalesce(n, F.lit("")) != "")
    names = F.when(F.size(full) > 0, full).when(F.coalesce(x["dc:creator"], F.lit("")) != "", F.array(x["dc:creator"])).otherwise(F.array().cast("array<string>"))
    places = F.transform(_listed(x["affiliation"], "struct<affilname:string,`affiliation-city`:string,`affiliation-country`:string>"), lambda a: F.concat_ws(", ", a["affilname"], a["affiliation-city"], a["affiliation-country"]))
    words = F.filter(F.transform(F.split(F.coalesce(x["authkeywords"], F.lit("")), r"\|"), lambda k: F.btrim(k)), lambda k: k != "")
    return _mapped(items, SCOPUS, "Scopus", title=x["dc:title"], abstract=x["dc:description"], authors=names, year=F.substring(x["prism:coverDate"], 1, 4).try_cast("int"), journal=x["prism:publicationName"], doi=x["prism:doi"], pmid=x["pubmed-id"], scopus_id=x["eid"], issn=x["prism:issn"], volume=x["prism:volume"], issue=x["prism:issueIdentifier"], pages=x["prism:pageRange"], doc_type=fields.doc_type(x["subtypeDescription"]), url=x["prism:url"], open_access=x["openaccessFlag"], cited_by=x["citedby-count"].try_cast("int"), keywords=words, affiliations=places, source_id=x["eid"])


def wos(items: DataFrame) -> DataFrame:
    x = F.col("x")
    names = F.transform(x["names"]["authors"], lambda a: F.coalesce(F.nullif(a["wosStandard"], F.lit("")), a["displayName"]))
    pages = x["source"]["pages"]
    span = F.coalesce(F.nullif(pages["range"], F.lit("")), F.concat_ws("-", F.nullif(pages["begin"], F.lit("")), F.nullif(pages["end"], F.lit(""))))
    own = F.filter(x["citations"], lambda c: F.upper(c["db"]) == "WOS")
    cited = F.coalesce(F.get(own, F.lit(0))["count"], F.array_max(F.transform(x["citations"], lambda c: c["count"])))
    pmid = F.substring_index(x["identifiers"]["pmid"], ":", -1)
    return _mapped(items, WOS, "Web of Science", title=x["title"], authors=names, year=x["source"]["publishYear"], journal=x["source"]["sourceTitle"], doi=x["identifiers"]["doi"], pmid=pmid, issn=F.coalesce(F.nullif(x["identifiers"]["issn"], F.lit("")), x["identifiers"]["eissn"]), volume=x["source"]["volume"], issue=x["source"]["issue"], pages=span, doc_type=_type(x["types"], WOS_TYPES, False), keywords=x["keywords"]["authorKeywords"], cited_by=cited, url=x["links"]["record"], source_id=x["uid"])


def wos_expanded(items: DataFrame) -> DataFrame:
    """Full records, in which any list may be one object."""
    x = F.col("x")
    static = x["static_data"]
    summary, full = static["summary"], static["fullrecord_metadata"]
    titles = _listed(summary["titles"]["title"], "struct<type:string,content:string>")
    title = lambda kind: F.coalesce(F.btrim(F.get(F.filter(titles, lambda t: t["type"] == kind), F.lit(0))["content"]), F.lit(""))
    people = F.filter(_listed(summary["names"]["name"], "struct<role:string,full_name:string,display_name:string,last_name:string>"), lambda n: F.coalesce(n["role"], F.lit("author")) == "author")
    named = F.filter(F.transform(people, lambda n: F.coalesce(F.nullif(n["full_name"], F.lit("")), F.nullif(n["display_name"], F.lit("")), n["last_name"])), lambda n: F.coalesce(n, F.lit("")) != "")
    ids = F.filter(_listed(x["dynamic_data"]["cluster_related"]["identifiers"]["identifier"], "struct<type:string,value:string>"), lambda i: F.coalesce(i["value"], F.lit("")) != "")
    own = lambda kind: F.get(F.filter(ids, lambda i: F.lower(i["type"]) == kind), F.lit(0))["value"]
    texts = F.flatten(F.transform(_listed(full["abstracts"]["abstract"], "struct<abstract_text:struct<p:string>>"), lambda a: F.coalesce(_strings(a["abstract_text"]["p"]), F.array().cast("array<string>"))))
    places = F.filter(F.transform(_listed(full["addresses"]["address_name"], "struct<address_spec:struct<full_address:string>>"), lambda a: F.btrim(a["address_spec"]["full_address"])), lambda a: F.coalesce(a, F.lit("")) != "")
    pub = summary["pub_info"]
    return _mapped(items, WOS_EXPANDED, "Web of Science Core Collection", title=title("item"), abstract=F.btrim(F.array_join(texts, "\n\n")), authors=_names(named), year=pub["pubyear"].try_cast("int"), journal=title("source"), doi=own("doi"), pmid=F.regexp_replace(own("pmid"), r"\D", ""), issn=F.coalesce(own("issn"), own("eissn")), volume=pub["vol"], issue=pub["issue"], pages=pub["page"]["content"], doc_type=_type(_strings(summary["doctypes"]["doctype"]), WOS_TYPES, False), keywords=_strings(full["keywords"]["keyword"]), affiliations=F.array_distinct(places), source_id=x["UID"])


def preprints(items: DataFrame) -> DataFrame:
    """Of the versions of a preprint the first listed stays."""
    x = F.col("x")
    names = F.filter(F.transform(F.split(F.coalesce(x["authors"], F.lit("")), ";"), lambda a: F.btrim(a)), lambda a: a != "")
    out = _mapped(items, PREPRINT, "", title=x["title"], abstract=x["abstract"], authors=names, year=F.substring(x["date"], 1, 4).try_cast("int"), journal=x["server"], doi=x["doi"], doc_type=F.lit("preprint"), keywords=F.when(F.coalesce(x["category"], F.lit("")) != "", F.array(x["category"])), source=x["server"], source_id=x["doi"], open_access=F.lit(True), url=F.concat(F.lit("https://doi.org/"), x["doi"]), raw=x["version"])
    from ..operators.validate import keep_first

    return keep_first(out.withColumn("_key", F.when(F.col("doi") != "", F.col("doi")).otherwise(F.col("title"))), ["_key", "raw"], "ord").drop("_key")


MAPPERS = {"crossref": crossref, "openalex": openalex, "semanticscholar": semanticscholar, "scopus": scopus, "wos": wos, "wos_expanded": wos_expanded, "preprints": preprints}
