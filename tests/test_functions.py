import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvina.functions import fields, text


def values(spark, function, items, schema="x string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i long, {schema}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("x"))).collect()]


def test_names():
    cases = {
        "Kowalski, Jan": "Kowalski, Jan", "Kowalski J.": "Kowalski, J.", "Jan Kowalski": "Kowalski, Jan", "Ludwig van Beethoven": "van Beethoven, Ludwig", "J. M. Kowalski": "Kowalski, J. M.",
        "Lynch J.G., Jr.": "Lynch, J.G.", "John Smith Jr": "Smith, John", "Plato": "Plato", "": "", "Doe, John, III": "Doe, John", "Al Gore": "Gore, Al",
    }
    assert {k: text.author_name(k) for k in cases} == cases
    assert text.split_authors("Adeli K.Lewis G. F.") == ["Adeli, K.", "Lewis, G. F."]
    assert text.split_authors("Smith, John, Doe, Jane") == ["Smith, John", "Doe, Jane"]
    assert text.split_authors("Smith, John") == ["Smith, John"]
    assert text.split_authors("A. Nowak and B. Smith; et al.") == ["Nowak and B. Smith, A."]
    assert text.split_keywords("a; A; b.; ") == ["a", "b"] and text.split_keywords("x|y, z") == ["x", "y, z"]
    assert text.surname("Nowak A.") == "nowak" and text.surname("Łukasz Żółw") == "zolw"
    assert text.display_name("Ludwig van Beethoven") == "van Beethoven, Ludwig" and text.display_name("Plato") == "Plato"


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_title_is_a_fixed_point(x):
    once = text.normalize_title(x)
    assert text.normalize_title(once) == once and not set(once) - set("abcdefghijklmnopqrstuvwxyz0123456789 ")


@given(st.lists(st.sampled_from(["Nowak", "van", "de", "J.", "AB", "Smith", "Jr", "III", ","]), max_size=6).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_author_names_never_fail(x):
    assert text.author_name(text.author_name(x)) is not None


def test_titles():
    assert text.normalize_title("Wpływ <i>X</i> na “Łódź” – Straße") == "wplyw x na lodz strasse"
    assert text.ratio("tide", "diet") != text.ratio("diet", "tide")
    assert round(text.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611 and text.jaro_winkler("", "a") == 0


def test_identifiers(spark):
    dois = ["https://doi.org/10.1000/AbC.", "doi: 10.1016/s0025-7753%2817%2930624-3", "NA", None, "x 10.1000/a b", "10.1000/a+b%zz", "10.1000/%2528x", "10.12/no"]
    assert values(spark, fields.doi, dois) == ["10.1000/abc", "10.1016/s0025-7753(17)30624-3", "", "", "10.1000/a", "10.1000/a+b%zz", "10.1000/(x", ""]
    assert values(spark, fields.pmid, ["PMID: 12 34", None]) == ["1234", ""]
    assert values(spark, fields.openalex, ["https://openalex.org/w12", "W3"]) == ["W12", "W3"]
    assert values(spark, fields.identifier_title, ["10.1000/x", " doi: 10.1/y ", "A title 10.1000/x", "ISBN 978-3-16-148410-0", ""]) == [True, True, False, True, False]
    refs = ["Doe, https://doi.org/10.1000/X).", "https://openalex.org/W123", "W12345", "  Some  Work. ", ""]
    assert values(spark, fields.reference_key, refs) == ["doi:10.1000/x", "oa:W123", "oa:W12345", "txt:some work", "txt:"]


def test_coordinates(spark):
    pages = ["pp. 413-420", "S354", "e0137960", "", None, "11-Sep", "Nov-19", "1-15", "1 – 1"]
    assert values(spark, fields.first_page, pages) == ["413", "s354", "e0137960", "", "", "11", "19", "1", "1"]
    assert values(spark, fields.page_digits, pages) == ["413", "354", "137960", "", "", "11", "19", "1", "1"]
    assert values(spark, fields.mangled_pages, pages) == [False] * 5 + [True, True, False, False]
    assert values(spark, fields.pseudo_range, pages) == [False] * 7 + [True, False]
    assert values(spark, fields.clean_pages, ["10--20", " 10 – 20 ;", "-"]) == ["10-20", "10-20", ""]
    assert values(spark, fields.parse_year, ["2024", "2024.0", "May 1999", "x", None, "0999"]) == [2024, 2024, 1999, None, None, 999]
    assert values(spark, fields.parse_int, ["1,234", "12.0", "n 7", "", None]) == [1234, 12, 7, None, None]
    markers = values(spark, fields.period_markers, ["X (Third Quarter 2021) Part II", "The year 2012", "Annual report of things 2019"])
    assert markers == [["part ii", "third quarter"], [], ["annual report of things 2019"]]
    assert values(spark, fields.doc_type, ["Review Article", "Conference Paper", "Book Chapter", "zzz", None]) == ["review", "conference", "chapter", "", ""]
    assert values(spark, fields.open_access, ["All Open Access, Gold", "No", "closed", "?", ""]) == [True, False, False, None, None]
    assert values(spark, fields.safe_cell, ["=1", "a", "", "-x"]) == ["'=1", "a", "", "'-x"]
    assert values(spark, fields.split_references, ["a; b;;", None]) == [["a", "b"], []]


def test_integrity_flags(spark):
    rows = [("RETRACTED: X", "", "retracted"), ("Retraction notice: X", "", "retraction_notice"), ("X", "Erratum", "erratum"), ("Corrigendum to X", "", "erratum"), ("Withdrawn: X", "", "withdrawn"), ("Expression of Concern: X", "article", "concern"), ("A study of retracted papers", "", None)]
    df = spark.createDataFrame(rows, "title string, doc_type string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", fields.integrity_flag("doc_type", "title").alias("got")).collect())


def test_rebuilt_abstract(spark):
    maps = [{"b": [1, 3], "a": [0], "c": [2]}, {}, None]
    assert values(spark, fields.rebuilt_abstract, maps, "x map<string,array<int>>") == ["a b c b", "", ""]


def test_checksums(spark):
    from corvina.operators import harvest
    from corvina.schema import conform

    rows = [(0, 'A "quoted"\ttitle \\ ü', "10.1000/a", 2001), (1, "B", "", None)]
    prints = harvest.fingerprints(conform(spark.createDataFrame(rows, "ord long, title string, doi string, year int"))).orderBy("ord").collect()
    for r, (_, title, doi, year) in zip(prints, rows):
        want = {k: "" for k in ("pmid", "openalex_id", "scopus_id", "norm_journal", "issn", "volume", "issue", "pages", "doc_type", "language", "first_author_surname")} | {"doi": doi, "norm_title": text.normalize_title(title), "year": year, "n_authors": 0, "has_abstract": False}
        assert r["checksum"] == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    total = harvest.corpus_checksum(spark.createDataFrame([(r["checksum"],) for r in prints], "checksum string")).first()[0]
    assert total == hashlib.sha256(json.dumps(sorted(r["checksum"] for r in prints), separators=(",", ":")).encode()).hexdigest()


def test_archive(spark, tmp_path):
    from corvina.operators import harvest

    rows = [(1, "h", "u", {"q": "x"}, "k1", 200, "t", '{"items": [{"a": 1}, {"a": 2}]}'), (2, "h", "u", {"q": "x"}, "k1", 429, "t", "slow down"), (4, "h", "u", {"q": "y"}, "k1", 200, "t", '{"items": {"a": 3}}')]
    harvest.write_archive(spark.createDataFrame(rows, "seq int, harvest_id string, url string, params map<string,string>, request_key string, status int, retrieved_at string, body string"), f"{tmp_path}/arc")
    back = harvest.read_archive(spark, f"{tmp_path}/arc")
    assert harvest.verify_archive(back).first().asDict() == {"harvest_id": "h", "n": 3, "gaps": 1, "broken": 0}
    requests = spark.createDataFrame([(0, "k1"), (1, "k1"), (2, "k1")], "ord long, request_key string")
    assert [(r["ord"], r["seq"]) for r in harvest.replay(requests, back).orderBy("ord").collect()] == [(0, 1), (1, 4), (2, None)]
    from corvina.sources.mappers import unnest

    assert [(r["seq"], r["at"], r["json"]) for r in unnest(back.where("status = 200"), "items").orderBy("seq", "at").collect()] == [(1, 0, '{"a":1}'), (1, 1, '{"a":2}'), (4, 0, '{"a":3}')]


def test_keys_of_requests(spark):
    from corvina.operators import harvest

    df = spark.createDataFrame([({"q": "a", "apiKey": "s", "mailto": "me"},)], "p map<string,string>")
    assert df.select(harvest.redacted(F.col("p"))).first()[0] == {"q": "a", "mailto": "<redacted>"}
    key = df.select(harvest.request_key(F.lit(" u "), F.col("p"))).first()[0]
    assert key == hashlib.sha256(b'["u",{"q":"a"}]').hexdigest()


@pytest.mark.parametrize("kind", ["added_subtitle", "missing_authors", "year_off_by_one", "transliterated"])
def test_damages(spark, kind):
    from corvina.operators import validate
    from corvina.schema import conform

    rows = [(0, "R1", "Wpływ czegoś", 2000, ["Żółw, A"]), (1, "R2", "Plain: with subtitle", None, [])]
    out = validate.damaged(conform(spark.createDataFrame(rows, "ord long, uid string, title string, year int, authors array<string>")), kind).collect()
    assert [r["uid"] for r in out] == ["R1"]
    r = out[0]
    assert {"added_subtitle": r["title"].startswith("Wpływ czegoś: "), "missing_authors": r["authors"] == [], "year_off_by_one": abs(r["year"] - 2000) == 1, "transliterated": (r["title"], r["authors"]) == ("Wplyw czegos", ["Zolw, A"])}[kind]


def test_clusters_and_wilson(spark):
    from corvina.operators import validate

    decisions = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "kept_uid string, removed_uid string")
    uids = spark.createDataFrame([(u,) for u in "abcxyz"], "uid string")
    assert dict(map(tuple, validate.clusters_of(decisions, uids).collect())) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    low, high = validate.wilson(F.lit(8.0), F.lit(10.0))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert abs(r["l"] - 0.4902) < 1e-3 and abs(r["h"] - 0.9433) < 1e-3


def test_query_compilers():
    from corvina.operators.search import SearchQuery

    q = SearchQuery([["deep learning", "tool"], ["x"]], years=(2010, 2020), doc_types=["article", "poem"], languages=["en", "xx"])
    out = q.compile_all()
    assert out["scopus"] == '(TITLE-ABS-KEY("deep learning" OR "tool")) AND TITLE-ABS-KEY("x") AND (PUBYEAR > 2009 AND PUBYEAR < 2021) AND (DOCTYPE(ar)) AND LANGUAGE(english)'
    assert out["wos"] == 'TS=("deep learning" OR tool) AND TS=(x) AND PY=2010-2020 AND DT=(Article) AND LA=(English OR xx)'
    assert out["pubmed"].startswith('("deep learning"[Title/Abstract] OR "tool"[Title/Abstract]) AND ("x"[Title/Abstract]) AND 2010:2020[dp] AND ("journal article"[pt])')
    assert out["openalex"] == 'title_and_abstract.search:("deep learning" OR "tool") AND ("x"),from_publication_date:2010-01-01,to_publication_date:2020-12-31,type:article,language:en|xx'
    assert out["arxiv"] == '(all:"deep learning" OR all:"tool") AND (all:"x")' and out["crossref"]["query.bibliographic"] == "deep learning tool x"
    n = len(out["warnings"])
    q.compile_all()
    assert len(q.warnings) == n and q.describe() == 'title/abstract/category: ("deep learning" OR "tool") AND ("x")'


def test_flow(spark):
    from corvina.operators import reports

    row = reports.flow(spark, identified=10, duplicates_removed=12).first()
    assert row["records_screened"] == -2 and len(row["problems"]) == 4
    assert reports.flow_svg(row).startswith("<svg") and reports.markdown(spark.range(1)) == "| id |\n|---|\n| 0 |"


def test_audit(spark):
    from corvina.operators import reports

    names = ["Elsevier Scopus", "scopus", "ProQuest Central", "Semantic Scholar API", "", None, "bioRxiv", "Cochrane Library"]
    searches = spark.createDataFrame([(i, n, 10 * i) for i, n in enumerate(names)], "ord long, database string, records_retrieved long")
    audit = {r["source"]: r for r in reports.source_audit(searches).collect()}
    assert set(audit) == {"Scopus", "ProQuest ABI/INFORM", "Semantic Scholar", "(unnamed source)", "bioRxiv", "Cochrane CENTRAL"}
    assert audit["Scopus"]["names_seen"] == ["Elsevier Scopus", "scopus"] and audit["bioRxiv"]["tier"] == "supplementary"
    assert {c for _, c in reports.audit_warnings(reports.source_audit(searches))} == {"unclassified_source", "tier_provenance"}


def test_comparison_rule(spark):
    from corvina.operators import validate

    base = {"title": "The effect of sleep on memory", "abstract": "We studied sleep.", "author": "Nowak, A", "journal": "J One", "isbn": "", "pages": "1-9", "volume": "3", "number": "1", "doi": ""}
    others = [({}, 2001), ({"title": "Another thing altogether"}, 2001), ({}, 2005), ({"abstract": "", "pages": "50-60", "volume": "9", "number": "7"}, 2001), ({"doi": "10.1000/b"}, 2000)]
    names = list(base)
    rows = [(i, *[base[n] for n in names], *[(base | o)[n] for n in names], 2000, y) for i, (o, y) in enumerate(others)]
    ddl = "i long, " + ", ".join(f"a_{n} string" for n in names) + ", " + ", ".join(f"b_{n} string" for n in names) + ", a_year int, b_year int"
    scored = validate.nine_scores(spark.createDataFrame(rows, ddl))
    got = {r["i"]: (r["t"], r["m"]) for r in scored.select("i", validate.true_pair().alias("t"), validate.maybe_pair().alias("m")).collect()}
    assert got == {0: (True, True), 1: (False, False), 2: (False, False), 3: (False, True), 4: (True, True)}


def test_search_appendix(spark):
    from corvina.operators import reports

    searches = spark.createDataFrame([(1, "PubMed", "x[ti]", 7), (0, "Scopus", "TITLE(x)", 9)], "ord long, database string, query string, records_retrieved long")
    text = reports.search_appendix(searches, {"wos": "TS=(x)"})
    assert text.index("1. Scopus") < text.index("2. PubMed") and "- Records: 9" in text and "TS=(x)" in text


def test_bibtex_keys_are_unique(spark):
    import re

    from corvina.operators import export
    from corvina.schema import conform

    records = conform(spark.range(1500).selectExpr("id AS ord", "'T' AS title", "array('Smith, J') AS authors", "2000 AS year"))
    keys = [r["key"] for r in export.bibtex_frame(records).orderBy("ord").collect()]
    assert len(set(keys)) == 1500 and all(re.fullmatch("smith2000[a-z]*", k) for k in keys)
    assert keys[:3] == ["smith2000", "smith2000b", "smith2000c"] and keys[25:28] == ["smith2000z", "smith2000aa", "smith2000ab"] and keys[702] == "smith2000aaa"


def test_latex_escape(spark):
    from corvina.operators import export

    rows = ["a~b^c\\d {x} & 50% $ # _", "plain", "", "\\textbackslash{}"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(export.bibtex_escape(F.col("t"))).collect()]
    special = {"\\": "\\textbackslash{}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"} | {c: "\\" + c for c in "{}&%$#_"}
    assert got == ["".join(special.get(c, c) for c in t) for t in rows]


def test_faults_and_instalments(spark):
    from corvina.operators import validate

    rows = [
        ("serial_instalment", "outlook first quarter 2021", "outlook second quarter 2021", "", "", "10.1/a", "10.1/b"),
        ("serial_instalment", "trends part 2", "trends part iii", "", "", "", ""),
        ("supplementary_component", "a", "a", "component", "", "", ""),
        ("correction_vs_original", "Correction: a", "a", "", "", "", ""),
        ("preprint_vs_published", "a", "a", "", "", "10.48550/x", "10.1000/x"),
        ("two_preprint_servers", "a", "a", "", "", "10.48550/x", "10.1101/x"),
        ("working_paper_vs_published", "a", "a", "report", "", "", ""),
        ("book_edition", "a", "b", "book", "", "", ""),
        ("identical_title_distinct_doi", "a", "a", "", "", "10.1/a", "10.1/b"),
        ("over_merge", "a 5", "b 7", "", "", "10.1/a", "10.1/b"),
    ]
    df = spark.createDataFrame(rows, "want string, a_title string, b_title string, a_doc_type string, b_doc_type string, a_doi string, b_doi string")
    df = df.withColumns({"a_norm_title": F.regexp_replace(F.lower("a_title"), ":", ""), "b_norm_title": F.regexp_replace(F.lower("b_title"), ":", "")})
    got = df.select("want", validate.fault_kind().alias("kind")).collect()
    assert [r["kind"] for r in got] == [r["want"] for r in got]
    assert {r["kind"]: r["n"] for r in validate.fault_counts(df).collect()}["serial_instalment"] == 2
    titles = spark.createDataFrame([("report for the third quarter of 2021",), ("about 20 things",), ("wave 2 of 3 in 1999",), ("volume q2021",), ("",)], "t string")
    assert [r[0] for r in titles.select(validate.designations(F.col("t"))).collect()] == [["2021", "3"], [], ["1999", "2"], ["2021"], []]


def test_damage_arm_and_control(spark):
    from corvina.operators import validate
    from corvina.schema import conform

    records = conform(spark.range(400).selectExpr("id AS ord", "concat('R', id) AS uid", "concat('A title of some words number ', id, ' and more') AS title", "concat('10.1000/', id) AS doi", "2000 AS year"))
    arm, control = validate.arm(records, "truncated_title", 0.3, seed=5)
    new = lambda df: {r["uid"]: r for r in df.where("uid like 'D%'").collect()}
    a, c = new(arm), new(control)
    assert 80 < len(a) < 160 and a.keys() == c.keys() and arm.where("uid like 'R%'").count() == 400
    old = {r["uid"]: r["title"] for r in records.collect()}
    assert all(c[u]["title"] == old[u[1:]] and a[u]["title"] != old[u[1:]] and a[u]["doi"] == "" and a[u]["ord"] >= 400 for u in a)


def test_intervals_and_digest(spark):
    from corvina.operators import harvest, validate

    low, high = validate.bootstrap_f1(900, 50, 50)
    assert low < 2 * 900 / 1900 < high and high - low < 0.03 and validate.bootstrap_f1(0, 0, 0) == (1.0, 1.0)
    assert validate.percentile([1.0, 2.0, 4.0], 0.5) == 2.0 and validate.percentile([1.0, 2.0, 4.0], 0.75) == 3.0
    sums = spark.range(3000).selectExpr("sha2(cast(id % 900 AS string), 256) AS checksum")
    a, b = harvest.corpus_digest(sums).first(), harvest.corpus_digest(sums.orderBy(F.rand(1)).repartition(7)).first()
    assert a == b and a["n"] == 3000 and a["digest"] != harvest.corpus_digest(sums.limit(2999)).first()["digest"]


def test_scopus_languages():
    from corvina.operators.search import SearchQuery

    q = SearchQuery([["x"]], languages=["ar", "sv", "he"])
    assert q.compile("scopus") == 'TITLE-ABS-KEY("x") AND (LANGUAGE(arabic OR swedish OR hebrew))' and not q.warnings


def test_vendor_names():
    from corvina.functions.text import vendor_name

    assert [vendor_name(n) for n in ("Wu Y.", "Wu Y.-J.", "de la Cruz M.A.", "Anna Nowak", "Nowak, A", "Solo", "", None)] == ["Wu, Y.", "Wu, Y.-J.", "de la Cruz, M.A.", "Nowak, Anna", "Nowak, A", "Solo", "", ""]
