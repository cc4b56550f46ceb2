"""Queries that must cover every row or pair, against plain Python over the same record view."""

from itertools import combinations

from corvina.functions.text import surname_key
from corvina.operators import match
from corvina.plans import catalogue, matching

SF = "/root/testdata/sf0.001"


def round_keys(f, x):
    """The composite keys of one record, from its facts and its row."""
    author, year = surname_key((x["authors"] or [""])[0]), "" if x["year"] is None else str(x["year"])
    found = [(1, f.norm_title, f.page), (2, f.norm_title, author), (3, author, year, f.page), (4, x["norm_journal"][:24], f.volume_no, f.page)]
    return [k for k in found if all(k)] + ([(5, author, year, f.norm_title[:18])] if author and year and len(f.norm_title) >= 18 else [])


def keyed_pairs(known, raw, limit):
    held = {}
    for f in known:
        for k in round_keys(f, raw[f.ord]):
            held.setdefault(k, []).append(f.ord)
    return {p for b in held.values() if len(b) <= limit for p in combinations(sorted(set(b)), 2)}


def facts_and_rows(spark, r):
    from corvina.operators.blocking import with_norms

    normed = with_norms(r)
    known = list(match.facts(normed).toPandas().itertuples(index=False))
    return known, {x["ord"]: x.asDict() for x in normed.select("ord", "authors", "year", "norm_journal").collect()}


def test_pair_guards_cover_all_candidates(spark):
    known, raw = facts_and_rows(spark, catalogue.records_of(spark, SF))
    by, o = {f.ord: f for f in known}, match.Options()
    titles = {f.ord: {t for t in f.norm_title.split() if len(t) > 2} for f in known}
    df, couples = {}, {}
    for n, t in titles.items():
        for x in t:
            df.setdefault(x, set()).add(n)
    ranked = {n: sorted(t, key=lambda x: (len(df[x]), x))[:4] for n, t in titles.items()}
    for n, t in ranked.items():
        for c in combinations(t, 2):
            couples.setdefault(c, set()).add(n)
    want = {}
    for n, t in ranked.items():
        near = set().union(*(df[x] for x in t if len(df[x]) <= o.max_block)) - {n}
        near = near or set().union(*(couples[c] for c in combinations(t, 2) if len(couples[c]) <= o.max_block)) - {n}
        want |= {(min(n, m), max(n, m)): False for m in near}
    want |= dict.fromkeys(keyed_pairs(known, raw, 25), True)
    guards = {}
    year = lambda x: None if x.year is None or x.year != x.year else x.year
    for (i, j), via in want.items():
        a, b = by[i], by[j]
        sizes = len(a.norm_title), len(b.norm_title)
        need = o.round_title_min if via else o.fuzzy_threshold
        years = None not in (year(a), year(b))
        conflict = next((n for c, n in match.IDS.items() if getattr(a, c) and getattr(b, c) and getattr(a, c) != getattr(b, c)), "")
        pages = not (a.unreadable or b.unreadable) and "" not in (a.page, b.page) and a.page != b.page and a.digits != b.digits
        volumes = "" not in (a.volume_no, b.volume_no) and a.volume_no != b.volume_no and years and a.year != b.year
        place = "pages" if pages else "volume+year" if volumes else "series instalment" if list(a.markers) != list(b.markers) else ""
        meeting = any(x.venue and not x.doi and not x.page and y.doi and y.page for x, y in ((a, b), (b, a)))
        guards[i, j] = (min(sizes) > 0 and 2 * min(sizes) / sum(sizes) >= need, not years or abs(a.year - b.year) <= o.year_tolerance, conflict, place, meeting)
    got = {(x[0], x[1]): tuple(x[2:]) for x in matching.pair_guards(spark, SF).collect()}
    assert got == guards
    assert not all(want.values())


def test_comparison_rule_has_its_own_limit(spark, tmp_path):
    words = "one title of twelve words that many copies of a record share Nowak K and more text".split()
    rows = [(n, " ".join(words), "en", "A") for n in range(30)]
    rows += [(100 + n, " ".join(["other", *words]), "en", "A") for n in range(401)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    known, raw = facts_and_rows(spark, catalogue.records_of(spark, str(tmp_path)))
    got = {(x["i"], x["j"]) for x in catalogue.comparison_rule(spark, str(tmp_path)).collect()}
    assert got == keyed_pairs(known, raw, 400) == set(combinations(range(30), 2))


def test_uppercase_takes_every_title(spark):
    titles = {r["uid"]: r["title"] for r in catalogue.records_of(spark, SF).select("uid", "title").collect()}
    want = {u: t.upper() for u, t in titles.items() if t and t != t.upper()}
    assert any("ß" in titles[u] for u in want)
    assert dict(map(tuple, catalogue.perturb_uppercase(spark, SF).collect())) == want


def table_of(spark, tmp_path, firsts):
    """Documents whose first author is each of ``firsts``, with a comma and an initial after it."""
    rows = [(n, " ".join([*"=one two three four five six seven eight nine ten eleven twelve thirteen".split(), a, "Xyz"]), "en", "A") for n, a in enumerate(firsts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_screening_holds_every_record(spark, tmp_path):
    sf = table_of(spark, tmp_path, ["=cmd", "+Nowak", "-Doe", "@Smith", "Kowalski"])
    for folder in (sf, SF):
        safe = lambda s: "'" + s if s.startswith(("=", "+", "-", "@", "\t", "\r")) else s
        want = [(r["ord"], safe(r["uid"]), safe(r["title"]), safe(r["abstract"]), safe("; ".join(r["authors"])), str(r["year"] or ""), r["doi"]) for r in catalogue.records_of(spark, folder).collect()]
        got = [tuple(r) for r in catalogue.export_screening(spark, folder).collect()]
        assert sorted(got) == sorted(want)
    assert {r["authors"] for r in catalogue.export_screening(spark, sf).collect()} == {"'=cmd, X", "'+Nowak, X", "'-Doe, X", "'@Smith, X", "Kowalski, X"}


def test_surnames_hold_every_record(spark, tmp_path):
    sf = table_of(spark, tmp_path, [",Nowak", ",", "Doe"])
    assert sorted(map(tuple, catalogue.surnames(spark, sf).collect())) == [("R000001", ""), ("R000002", ""), ("R000003", "doe")]


def test_ris_has_abstracts(spark):
    def stanza(r):
        types = {"article": "JOUR", "review": "JOUR"}
        lines = [("TY", types.get(r["doc_type"], "JOUR")), *[("AU", a) for a in r["authors"]]]
        lines += [(t, v) for t, v in (("TI", r["title"]), ("AB", r["abstract"]), ("PY", str(r["year"] or "")), ("T2", r["journal"]), ("DO", r["doi"]), ("SN", r["issn"]), ("VL", r["volume"]), ("IS", r["issue"])) if v]
        if r["pages"]:
            lines += [("SP", r["pages"].split("-")[0]), *[("EP", r["pages"].split("-")[-1])] * ("-" in r["pages"])]
        lines += [("KW", k) for k in r["keywords"]]
        lines += [(t, v) for t, v in (("UR", r["url"]), ("LA", r["language"]), ("ID", r["uid"])) if v]
        return "".join(f"{t}  - {v}\n" for t, v in lines) + "ER  - \n"

    rows = catalogue.records_of(spark, SF).collect()
    assert any("\n" in r["abstract"] for r in rows) and max(len(r["abstract"]) for r in rows) > 10_000
    assert dict(map(tuple, catalogue.export_ris(spark, SF).collect())) == {r["ord"]: stanza(r) for r in rows}
