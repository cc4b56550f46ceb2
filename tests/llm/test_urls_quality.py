import random
import re

import pytest
from pyspark.sql import functions as F

from corvina.llm import quality, urls

from .conftest import ODD

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/es/deep/"), ("allow", "a.net", ""), ("block", "net", "/es/")]


def plain_judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls(spark):
    rng = random.Random(5)
    hosts = ["WWW.Example.com", "example.com", "x.example.com", "a.net", "b.a.net", "net", "com", "notexample.com", "xnet", "", "a..net", "é.com", "1.2.3.4", "net:80", "q." * 200 + "net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/", "/es/deep/y", "/es/dee", "?x=/en/", "#a", "/En/", "//en/"]
    rows = [(i, f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#f'])}") for i in range(400)]
    rows += [(900, None), (901, ""), (902, "no scheme"), (903, "a://b://c.com/x"), (None, "http://com/"), (5, "http://com/"), (5, "http://com/"), (904, "x://net/es/" + "y" * 100_000), (905, "p\nq://com/\nz")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = urls.judge(spark, pages, spark.createDataFrame(RULES, "verdict string, host string, path string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *plain_judge(u))) for i, u in rows)


def test_urls_empty(spark):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://com/")], "page_id long, url string")
    assert urls.judge(spark, pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in urls.judge(spark, pages, rules.limit(0), default="block").collect()] == [(1, "com", "/", None, "block")]


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, odd, prose):
    loop = " ".join(f"w{i}" for i in range(9))
    rows = [(50, f"{loop} {loop} tail"), (51, "a " * 30), (52, "x\nx\n\n \nx\ny #*$%&|<>"), (53, prose(60) + "\n" + prose(60)), (54, "\x0b\x0c\ra\x0bb"), (55, "one\u00a0word\u2003only"), (56, prose(500, 3))]
    docs = odd.select("doc_id", "text", "kept").unionByName(spark.createDataFrame([(d, t, None) for d, t in rows], "doc_id long, text string, kept boolean"))
    got = quality.judge(docs).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(map(repr, ((r["doc_id"], *[r[n] for n in names]) for r in got))) == sorted(repr((d, *plain_measures(t))) for d, t in [*ODD, *rows])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[56] and not kept[50] and not kept[2] and not kept[51]


def test_order_does_not_matter(spark, prose):
    docs = spark.createDataFrame([(i, prose(5 * i, i)) for i in range(12)] + [(99, "b " * 50)], "doc_id long, text string")
    rules = quality.standard_rules()
    measures = quality.expressions(F.col("text"), quality.words_of(F.col("text")))
    seen = {frozenset(r[0] for r in docs.where(quality.cascade(order, measures).isNull()).select("doc_id").collect()) for order in (rules, rules[::-1], rules[2:] + rules[:2])}
    seen.add(frozenset(r[0] for r in quality.kept(docs).collect()))
    seen.add(frozenset(r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]))
    assert len(seen) == 1
    ordered = quality.ordered_rules(docs, rules)
    assert [s / c for _, c, s in ordered] == sorted((s / c for _, c, s in ordered), reverse=True)


def test_short_circuit(spark, prose):
    """What a rule rejects is never measured by the rules behind it: the order decides what work is done."""
    docs = spark.createDataFrame([(1, prose(50)), (2, "too short")], "doc_id long, text string")
    measures = quality.expressions(F.col("text"), quality.words_of(F.col("text")))
    first = quality.Rule("all", lambda m: m["n_words"] >= 0)
    costly = quality.Rule("costly", lambda m: F.raise_error(F.lit("measured")).cast("boolean"))
    assert docs.where(quality.cascade([first, costly], measures).isNull()).count() == 0
    with pytest.raises(Exception, match="measured"):
        docs.where(quality.cascade([costly, first], measures).isNull()).count()


def test_costs_follow_the_work(spark, prose):
    """A rule that takes fifty times the work is behind one of the same selectivity."""
    docs = spark.createDataFrame([(i, prose(400, i)) for i in range(60)], "doc_id long, text string")
    heavy = quality.Rule("a_heavy", lambda m: F.length(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.sha2(F.concat(F.col("_text"), i.cast("string")).cast("binary"), 256)), "")) > 1)
    light = quality.Rule("b_light", lambda m: m["n_digits"] >= 0)
    assert [r.name for r, _, _ in quality.ordered_rules(docs, [heavy, light])] == ["b_light", "a_heavy"]


def test_other_rules(spark):
    cut = "\n".join(f"a line of seven words that ends ..." for _ in range(5))
    lists = "\n".join(f"- item {c} of a list" for c in "abcdefg")
    fine = "\n".join(f"a line of eight words that ends here {c}" for c in "abcdefg")
    docs = spark.createDataFrame([(1, cut.replace("a line", "another line", 1), None), (2, lists, None), (3, "2024 1234567 " * 25 + fine, None), (4, fine, None), (5, "12 34567890 " * 3 + fine, None)], "doc_id long, text string, n_words string")
    rules = [r for r in quality.standard_rules() if r.name in ("digits", "cut_lines", "list_lines")]
    got = {r["doc_id"]: r for r in quality.judge(docs, rules, carried=["doc_id", "n_words"]).collect()}
    assert {d: r["rejected_by"] for d, r in got.items()} == {1: "cut_lines", 2: "list_lines", 3: "digits", 4: None, 5: None}
    assert got[4]["n_words_given"] is None and got[4]["n_words"] == 63


def test_very_long_and_empty(spark, empty, long_text):
    assert quality.judge(empty).count() == 0
    (r,) = quality.judge(spark.createDataFrame([(1, long_text)], "doc_id long, text string")).collect()
    assert r["n_words"] == 60_000 and r["kept"]
