import json

from pyspark.sql import functions as F

from corvina.sources import connectors, mappers


def items(spark, *objects):
    return spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "ord long, json string")


def test_crossref(spark):
    item = {"title": ["A <i>title</i>"], "container-title": ["J One"], "DOI": "10.1000/A", "ISSN": ["1234-5678"], "page": "1-9", "type": "journal-article", "issued": {"date-parts": [[2020, 5]]}, "author": [{"family": "Nowak", "given": "Anna"}, {"name": "Group"}, {"family": "Doe"}], "abstract": "<jats:p>Some  text</jats:p>", "is-referenced-by-count": 3, "reference": [{"DOI": "10.1000/b"}, {"unstructured": " Free text "}, {}]}
    r, empty = mappers.crossref(items(spark, item, {})).orderBy("ord").collect()
    assert (r["doi"], r["year"], r["authors"], r["abstract"], r["references"], r["cited_by"]) == ("10.1000/a", 2020, ["Nowak, Anna", "Doe"], "Some text", ["10.1000/b", "Free text"], 3)
    assert empty["title"] == "" and empty["year"] is None and empty["authors"] == []


def test_openalex(spark):
    item = {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1000/a", "display_name": "T", "publication_year": 2020, "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/77"}, "authorships": [{"author": {"display_name": "Anna Nowak"}}, {"raw_author_name": "B. Doe"}], "primary_location": {"source": {"display_name": "J", "issn_l": "1"}}, "open_access": {"is_oa": True}, "biblio": {"first_page": "1", "last_page": None}, "abstract_inverted_index": {"two": [1], "one": [0]}, "referenced_works": ["https://openalex.org/W2"]}
    (r,) = mappers.openalex(items(spark, item)).collect()
    assert (r["openalex_id"], r["doi"], r["pmid"], r["authors"], r["abstract"], r["pages"], r["references"], r["open_access"]) == ("W1", "10.1000/a", "77", ["Anna Nowak", "B. Doe"], "one two", "1", ["W2"], True)


def test_others(spark):
    s2 = {"paperId": "p", "title": "T", "publicationDate": "2019-01-02", "authors": [{"name": "Ludwig van Beethoven"}], "publicationTypes": ["Journal Article", "Review"], "externalIds": {"DOI": "10.1000/a"}, "citationCount": 2}
    (r,) = mappers.semanticscholar(items(spark, s2)).collect()
    assert (r["year"], r["authors"], r["doc_type"], r["open_access"], r["url"]) == (2019, ["van Beethoven, Ludwig"], "review", False, "https://www.semanticscholar.org/paper/p")
    entry = {"dc:title": "T", "dc:creator": "Nowak A.", "prism:coverDate": "2018-03-01", "eid": "2-s2.0-1", "subtypeDescription": "Conference Paper", "citedby-count": "5", "authkeywords": "a | b", "affiliation": {"affilname": "Uni", "affiliation-city": "Town"}}
    (r,) = mappers.scopus(items(spark, entry)).collect()
    assert (r["authors"], r["year"], r["doc_type"], r["cited_by"], r["keywords"], r["affiliations"]) == (["Nowak A."], 2018, "conference", 5, ["a", "b"], ["Uni, Town"])
    hit = {"uid": "WOS:1", "title": "T", "types": ["Article", "Proceedings Paper"], "source": {"sourceTitle": "J", "publishYear": 2017, "pages": {"begin": "3", "end": "9"}}, "names": {"authors": [{"displayName": "Nowak, Anna", "wosStandard": "Nowak, A"}]}, "citations": [{"db": "WOS", "count": 4}, {"db": "X", "count": 9}], "identifiers": {"doi": "10.1000/a", "pmid": "MEDLINE:123"}}
    (r,) = mappers.wos(items(spark, hit)).collect()
    assert (r["doc_type"], r["pages"], r["cited_by"], r["pmid"], r["authors"]) == ("conference", "3-9", 4, "123", ["Nowak, A"])
    pre = {"doi": "10.1101/1", "title": "T", "authors": "Nowak, A.; Doe, B.", "date": "2020-01-01", "version": "1", "server": "medrxiv"}
    out = mappers.preprints(items(spark, pre, pre, pre | {"version": "2"})).collect()
    assert len(out) == 2 and out[0]["authors"] == ["Nowak, A.", "Doe, B."] and out[0]["source"] == "medrxiv"


def answers(*bodies):
    """A source that gives these answers, and the requests that it has seen."""
    left, seen = iter(bodies), []

    def get(url, headers):
        seen.append((url, headers))
        body = next(left)
        return 200, body if isinstance(body, str) else json.dumps(body)

    return get, seen


def test_paging():
    get, seen = answers({"message": {"items": [1, 2], "next-cursor": "b"}}, {"message": {"items": [3], "next-cursor": "b"}})
    got = list(connectors.pages("crossref", {"query": "x"}, 100, get))
    assert [g[0] for g in got] == [0, 1] and "cursor=b" in seen[1][0]
    get, seen = answers({"data": [1, 2]}, {"data": []})
    assert len(list(connectors.pages("semanticscholar", {"query": "x"}, 100, get))) == 2 and "offset=2" in seen[1][0]
    assert len(list(connectors.pages("wos", {}, 100, lambda url, headers: (500, "")))) == 1


def test_limits_of_sources():
    """The last page counts up to the limit; offsets end where the provider ends; a page that repeats ends the run."""
    get, _ = answers({"data": [0] * 100}, {"data": [0] * 100})
    assert [r[5] for r in connectors.pages("semanticscholar", {}, 130, get)] == [100, 30]
    get, seen = answers(*[{"data": [i] * 100} for i in range(20)])
    assert len(list(connectors.pages("semanticscholar", {}, 10_000, get))) == 10 and "offset=900" in seen[-1][0]
    get, seen = answers(*[{"hits": [1, 2]}] * 5)
    assert len(list(connectors.pages("wos", {}, 1000, get))) == 1 and len(seen) == 2


def test_keys_never_reach_a_row():
    get, seen = answers({"search-results": {"entry": [{}]}}, {"search-results": {"entry": []}})
    rows = list(connectors.pages("scopus", {"query": "TITLE(x)", "apiKey": "SECRET", "mailto": "me@x.org"}, 100, get, key="HIDDEN"))
    assert seen[0][1] == {"X-ELS-APIKey": "HIDDEN"} and "SECRET" in seen[0][0]
    assert not [r for r in rows if any(w in str(r) for w in ("SECRET", "HIDDEN", "me@x.org"))]
    assert rows[0][2]["mailto"] == "<redacted>" and "query=TITLE" in rows[0][1]


def test_other_sources():
    found = {"esearchresult": {"count": "350", "querykey": "1", "webenv": "W"}}
    get, seen = answers(found, "<PubmedArticleSet>" + "<PubmedArticle>x</PubmedArticle>" * 200 + "</PubmedArticleSet>", "<PubmedArticle>" * 150)
    rows = list(connectors.pages("pubmed", {"term": "x", "api_key": "K"}, 1000, get))
    assert [r[5] for r in rows] == [0, 200, 150] and "efetch" in seen[1][0] and "retstart=200" in seen[2][0] and "api_key=K" in seen[1][0] and "K" not in rows[1][2].values()
    get, seen = answers("<feed><entry>a</entry><entry >b</entry></feed>", "<feed></feed>")
    assert [r[5] for r in connectors.pages("arxiv", {"search_query": "all:x"}, 100, get)] == [2, 0] and "start=2" in seen[1][0]
    get, seen = answers({"messages": [{"total": 3}], "collection": [1, 2]}, {"messages": [{"total": 3}], "collection": [3]})
    assert len(list(connectors.pages("biorxiv", {"from": "2020-01-01", "to": "2020-12-31"}, 100, get))) == 2 and seen[1][0].endswith("/biorxiv/2020-01-01/2020-12-31/2")
    get, seen = answers({"QueryResult": {"RecordsFound": 120}, "Data": {"Records": {"records": {"REC": [{}] * 100}}}}, {"QueryResult": {"RecordsFound": 120}, "Data": {"Records": {"records": {"REC": [{}] * 20}}}})
    assert [r[5] for r in connectors.pages("wos_expanded", {"usrQuery": "TS=x"}, 1000, get, key="k")] == [100, 20] and "firstRecord=101" in seen[1][0]
    get, seen = answers({"message": {"DOI": "10.1000/a"}})
    assert [r[5] for r in connectors.pages("crossref_lookup", {"doi": "10.1000/a"}, 1, get)] == [1] and seen[0][0].endswith("works/10.1000%2Fa")
    assert [len(p["filter"].split("|")) for p in connectors.lookups("openalex_lookup", [f"10.1/{i}" for i in range(60)])] == [25, 25, 10]
    from datetime import date

    assert connectors.interval((2019, 2030), date(2021, 5, 6)) == ("2019-01-01", "2021-05-06") and connectors.interval(None, date(2021, 5, 6))[1] == "2021-05-06"


def test_archive_and_manifest(spark, tmp_path):
    from corvina.operators import harvest

    get, _ = answers({"message": {"items": [{"DOI": "10.1000/a"}, {"DOI": "10.1000/b"}], "next-cursor": "b"}}, {"message": {"items": []}})
    pages = spark.createDataFrame(list(connectors.pages("crossref", {"query": "x", "mailto": "me@x.org"}, 1, get)), connectors.PAGE)
    rows = harvest.archived(pages, "H1", after=4)
    items = connectors.within(mappers.unnest(pages, "message.items"), pages)
    assert items.count() == 1
    prints = harvest.fingerprints(mappers.crossref(items))
    path = str(tmp_path / "arc")
    harvest.write_archive(rows, path, harvest.manifest(rows, prints, database="Crossref", query="x"))
    back = harvest.read_archive(spark, path)
    assert harvest.verify_archive(back).first().asDict() == {"harvest_id": "H1", "n": 1, "gaps": 0, "broken": 0}
    (r,) = back.collect()
    assert r["seq"] == 5 and r["params"]["mailto"] == "<redacted>" and r["content_sha256"] == r["wire_sha256"] and "me@x.org" not in str(r)
    m = harvest.read_manifests(spark, path).first()
    assert (m["database"], m["n_responses"], m["n_records"], m["n_with_doi"]) == ("Crossref", 1, 1, 1)
    damaged = back.withColumn("body", F.lit("{}"))
    assert harvest.verify_archive(damaged).first()["broken"] == 1


def test_corpus_document(spark, tmp_path):
    import pytest

    from corvina.schema import conform
    from corvina.sources import corpus_file

    rows = [(0, "R000007", 'A "quoted" title\n', "10.1000/a", ["Nowak, A"], 2001, '{"k": [1, 2]}'), (1, "R000003", "", "", [], None, "")]
    records = conform(spark.createDataFrame(rows, "ord long, uid string, title string, doi string, authors array<string>, year int, raw string"))
    searches = spark.createDataFrame([(0, "S1", "Scopus", 12)], "ord long, search_id string, database string, records_retrieved long")
    path = str(tmp_path / "corpus")
    corpus_file.write(records, searches, path, '{"before": 2, "after": 2}')
    text = "".join(p.read_text() for p in sorted((tmp_path / "corpus").glob("part-*")))
    assert [r["uid"] for r in json.loads(text)["records"]] == ["R000007", "R000003"] and json.loads(text)["records"][0]["raw"] == {"k": [1, 2]}
    (tmp_path / "one.json").write_text(text)
    back, found, dedup = corpus_file.read(spark, str(tmp_path / "one.json"))
    names = [c for c in records.columns if c != "raw"]
    assert sorted(map(tuple, back.select(names).collect())) == sorted(map(tuple, records.select(names).collect()))
    assert json.loads(back.orderBy("ord").first()["raw"]) == {"k": [1, 2]} and json.loads(dedup.first()["dedup"]) == {"before": 2, "after": 2}
    assert found.first()["records_retrieved"] == 12 and corpus_file.next_uid(back) == 8
    for bad in ('{"format": "other/thing-9", "records": []}', '{"a": 1}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            corpus_file.read(spark, str(tmp_path / "bad.json"))


def test_wos_expanded(spark):
    rec = {"UID": "WOS:1", "static_data": {"summary": {"titles": {"title": [{"type": "source", "content": "J One"}, {"type": "item", "content": "A title"}]}, "names": {"name": {"role": "author", "full_name": "Nowak, Anna"}}, "doctypes": {"doctype": ["Article", "Proceedings Paper"]}, "pub_info": {"pubyear": 2019, "vol": "3", "issue": "2", "page": {"content": "1-9"}}}, "fullrecord_metadata": {"abstracts": {"abstract": {"abstract_text": {"p": ["One.", "Two."]}}}, "keywords": {"keyword": "solo"}, "addresses": {"address_name": [{"address_spec": {"full_address": "Uni, Town"}}, {"address_spec": {"full_address": "Uni, Town"}}]}}}, "dynamic_data": {"cluster_related": {"identifiers": {"identifier": [{"type": "doi", "value": "10.1000/A"}, {"type": "eissn", "value": "1234-5678"}]}}}}
    single = {"UID": "WOS:2", "static_data": {"summary": {"titles": {"title": {"type": "item", "content": "T"}}, "doctypes": {"doctype": "Review"}, "names": {"name": [{"role": "author", "full_name": "Doe, J"}, {"role": "book_editor", "full_name": "Ed, I"}]}}}}
    a, b, c = mappers.wos_expanded(items(spark, rec, single, {})).orderBy("ord").collect()
    assert (a["title"], a["journal"], a["authors"], a["year"], a["doc_type"], a["doi"], a["issn"], a["pages"], a["keywords"], a["affiliations"], a["abstract"]) == ("A title", "J One", ["Nowak, Anna"], 2019, "conference", "10.1000/a", "1234-5678", "1-9", ["solo"], ["Uni, Town"], "One.\n\nTwo.")
    assert (b["title"], b["doc_type"], b["authors"], b["journal"]) == ("T", "review", ["Doe, J"], "") and c["title"] == "" and c["authors"] == []


def test_stream(spark, tmp_path):
    from corvina.streaming import intake

    (tmp_path / "in").mkdir()
    rows = [{"ord": i, "title": t, "doi": d, "source": "A", "arrived": "2024-01-01T00:00:00"} for i, (t, d) in enumerate([("One", "10.1000/a"), ("One again", "10.1000/a"), ("Two", "")])]
    blank = {c: "" for c in ("uid", "search_id", "source_id", "pmid", "openalex_id", "scopus_id")}
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(blank | r) for r in rows))
    q = intake.append_to(intake.first_seen(intake.incoming(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 and out.where(F.col("doi") == "10.1000/a").count() == 1


def test_data_source_plans(spark):
    connectors.register(spark)
    df = spark.read.format("bibliography").option("source", "crossref").load()
    assert df.columns == ["seq", "url", "params", "status", "body", "counted", "retrieved_at", "wire_sha256"]


def test_command_line(spark, tmp_path, capsys):
    from corvina.__main__ import main

    config = tmp_path / "q.json"
    config.write_text('{"blocks": [["a"]]}')
    assert main(["query", str(config)]) == 0 and '"scopus"' in capsys.readouterr().out
    config.write_text('{"blocks": [["a"]], "oops": 1}')
    assert main(["query", str(config)]) == 2


def test_run_a_configuration(spark, tmp_path, capsys):
    from corvina.__main__ import main

    ris = "TY  - JOUR\nTI  - The effect of sleep on memory\nAU  - Nowak, A\nPY  - 2001\nDO  - 10.1000/a\nER  - \n"
    (tmp_path / "a.ris").write_text(ris + ris.replace("10.1000/a", "10.1000/b").replace("sleep", "diet in old age"))
    (tmp_path / "b.ris").write_text(ris)
    config = {"title": "T", "files": [{"path": str(tmp_path / "a.ris"), "source": "Scopus"}, {"path": str(tmp_path / "b.ris"), "source": "PubMed"}], "dedup": {"fuzzy_threshold": 0.9}, "flow": {"studies_included": 2}, "exports": ["ris", "csv"]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    assert main(["check", str(tmp_path / "c.json")]) == 0 and len(capsys.readouterr().out.strip()) == 64
    assert main(["run", str(tmp_path / "c.json"), str(tmp_path / "out")]) == 0
    assert spark.read.parquet(f"{tmp_path}/out/unique").count() == 2
    report = "\n".join(r[0] for r in spark.read.option("lineSep", "\x00").text(f"{tmp_path}/out/report").collect())
    assert "| Scopus | principal | 2 | 1 |" in report and '"before": 3' in report
    log = spark.read.option("header", "true").csv(f"{tmp_path}/out/decisions").collect()
    assert [(r["kept_uid"], r["removed_uid"], r["method"], r["score"]) for r in log] == [("R000001", "R000003", "doi", "1.0000")]
    (tmp_path / "c.json").write_text(json.dumps(config | {"oops": 1, "dedup": {"max_block": "x"}}))
    assert main(["run", str(tmp_path / "c.json"), str(tmp_path / "out2")]) == 2
    err = capsys.readouterr().err
    assert "oops: unknown key" in err and "max_block" in err
