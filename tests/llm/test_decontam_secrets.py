import base64
import hashlib
import json
import random
import re
from collections import Counter

import numpy as np

from corvina.llm import common, decontam, secret_scan

from .conftest import ODD


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_hits(text, items, window=10):
    words, hit, found = plain_words(text), set(), set()
    for item, t in items:
        w = plain_words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def rows_of(found):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.select("doc_id", "n_words", decontam.hit_words().alias("n_hit"), "items").collect())


def test_equals_brute_force(spark, odd, prose, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng.choice([10, 11, 25, 40]), 500 + i, 200)) for i in range(8)]
    items += [(100, "Seven SHORT words, of one single item"), (101, "word"), (102, ""), (103, None), (None, items[0][1]), (1, items[0][1]), (104, "a a a a a a a a a a a a")]
    texts = [prose(120, i, 200) for i in range(30)]
    for i in range(20):
        w = plain_words(items[i % 8][1])
        n = rng.choice([9, 10, 11, len(w)])
        s = rng.randrange(max(1, len(w) - n + 1))
        texts[i] += " -- " + "\n".join(w[s : s + n]).upper() + " " + texts[(i + 7) % 30]
    texts += ["a " * 40, "seven short words of one single item", items[0][1] * 3, "x word y"]
    rows = [(20 + i, t) for i, t in enumerate(texts)]
    docs = odd.select("doc_id", "text", "id").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((d, n, h, tuple(f)) for d, (n, h, f) in ((d, plain_hits(t, items)) for d, t in [*ODD, *rows]))
    assert rows_of(decontam.find_hits(spark, docs, benchmark)) == want
    monkeypatch.setattr(decontam, "MOST_BITS", 6)  # a bit table that lets nearly everything through
    for name, value in (("HOT_ROWS", 2), ("MOST_HOT", 40)):  # many hot windows
        monkeypatch.setattr(common, name, value)
    assert rows_of(decontam.find_hits(spark, docs, benchmark)) == want
    assert rows_of(decontam.find_hits(spark, docs, benchmark.limit(0))) == Counter((d, n, 0, ()) for d, n, _, _ in want.elements())
    left = decontam.clean(spark, docs, benchmark)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(d for d, _, h, _ in want.elements() if not h)


def test_winnowing_guarantee():
    """Equal windows have equal fingerprints, each the least hash in its window, kept once for neighbours that share it."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        h = rng.integers(0, 4, rng.integers(1, 40), dtype=np.uint64)  # many ties
        grams, prints = decontam.gram_hashes(h, 5), decontam.prints_of(h, 10, 5)
        assert len(prints) == max(0, len(h) - 9)
        for i, fp in enumerate(prints.tolist()):
            assert fp == int(decontam.mix(grams[i : i + 6].min(keepdims=True) + np.uint64(10))[0])
        first = decontam.kept(prints).tolist()
        assert first == [i for i in range(len(prints)) if i == 0 or prints[i] != prints[i - 1]]


def test_one_pass_whatever_the_benchmark(spark, prose):
    """The plan has one Arrow pass over the documents, and clashing names are carried beside the added ones."""
    items = spark.createDataFrame([(i, prose(400, i, 900)) for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(50, i, 900), 7, "x") for i in range(40)], "doc_id long, text string, HITS int, n_words string")
    found = decontam.find_hits(spark, docs, items)
    assert found.columns == ["doc_id", "text", "HITS_given", "n_words_given", "n_words", "hits", "items"]
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()  # done once, before the table
    assert {r["doc_id"] for r in found.where("size(hits) > 0").collect()} == set(range(40))
    assert {r["HITS_given"] for r in found.collect()} == {7}


def test_empty_and_long(spark, empty, long_text):
    benchmark = spark.createDataFrame([(1, long_text[5000:5200])], "item_id long, text string")
    assert decontam.find_hits(spark, empty, benchmark).count() == 0
    docs = spark.createDataFrame([(1, long_text)], "doc_id long, text string")
    assert [r["items"] for r in decontam.find_hits(spark, docs, benchmark).collect()] == [["1"]]


# --- secrets


def der(tag, content):
    n = len(content)
    head = bytes([n]) if n < 128 else bytes([0x80 + (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k, "big")
    return bytes([tag]) + head + content


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = der(0x30, b"".join(map(number, [0, 2**255 + 7, 65537, 2**250 + 1, 2**120 + 3, 2**121 + 3, 2**100 + 5, 2**99 + 5, 2**98 + 9])))
PKCS8 = der(0x30, number(0) + der(0x30, der(6, b"\x2a\x86\x48") + der(5, b"")) + der(4, RSA))
SEC1 = der(0x30, number(1) + der(4, bytes(range(32))))
OPENSSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + bytes(60)


def b64(x, url=False):
    return (base64.urlsafe_b64encode(x).rstrip(b"=") if url else base64.b64encode(x)).decode()


def jwt(header=None):
    return ".".join([b64(json.dumps(header or {"alg": "HS256", "typ": "JWT"}).encode(), True), b64(json.dumps({"sub": "1"}).encode(), True), b64(bytes(range(32)), True)])


def test_structures():
    for key in (RSA, PKCS8, SEC1, OPENSSH):
        assert secret_scan.is_private_key(key)
        assert not secret_scan.is_private_key(key[:-1] if key is not OPENSSH else key[:20])
    assert not secret_scan.is_private_key(RSA[:2] + bytes([RSA[2] + 1]) + RSA[3:])
    assert not secret_scan.is_private_key(der(0x30, number(0) + number(5) + der(5, b"") * 20))
    assert secret_scan.is_signed_token(jwt())
    assert not secret_scan.is_signed_token(jwt({"typ": "JWT"}))
    assert not secret_scan.is_signed_token("aaaaaaaa.bbbb.cccc")


def test_confirmed_spans():
    rng = random.Random(1)
    noise = b64(bytes(rng.randrange(256) for _ in range(90)))
    armour = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(RSA))) + "\n-----END RSA PRIVATE KEY-----"
    for text, kind in ((b64(PKCS8), "key"), (RSA.hex(), "key"), (armour, "key"), (jwt(), "jwt"), (b64(OPENSSH), "key")):
        whole = f"é🙂 before {text} after {noise} and {noise.replace('+', '.')}"
        assert secret_scan.confirmed_spans(whole) == [(kind, 10, 10 + len(text))]
    assert secret_scan.confirmed_spans(noise + " " + "ab" * 200) == []


def plain_base(text):
    text = text or ""
    out = [("assign", *m.span()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[1]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_scan(spark, odd, long_text):
    rng = random.Random(7)
    parts = ["password", "PASSWD", "secret", "tokEn", "api_key", "apikey", '"', "'", " ", " ", ":", "=", "abcdefgh", "1234567", "AKIA", "ABCDEFGHIJKL", "a1" * 16, "ſecret", "Key", "é", "\n", "-", "f" * 31]
    rows = [(20 + i, "".join(rng.choices(parts, k=rng.randint(1, 14)))) for i in range(600)]
    rows += [(5000, long_text), (5001, "f" * 200_000), (5002, "AKIA" * 50_000), (5003, "token=" * 30_000), (5004, f"key {jwt()} token = {'q' * 9}")]
    docs = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    got = secret_scan.scan(docs).collect()
    want = Counter()
    for d, t in [*ODD, *rows]:
        base = plain_base(t)
        kinds = Counter(k for k, _, _ in base)
        want[(d, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    (mixed,) = [r["spans"] for r in got if r["doc_id"] == 5004]
    assert [x.split(":")[0] for x in mixed.split(",")] == ["jwt", "assign"]


def test_redact(spark, odd, empty):
    docs = odd.select("doc_id", "text", "kept").unionByName(spark.createDataFrame([(70, f"a {jwt()} b token = abcdefgh123 c", None)], "doc_id long, text string, kept boolean"))
    got = secret_scan.redact(docs.selectExpr("*", "length(text) AS n_chars", "'x' AS redacted"))
    assert got.columns == [*docs.columns, "n_chars", "redacted"]
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows if r["doc_id"] != 70) == Counter(ODD)
    assert [(r["text"], r["n_chars"]) for r in rows if r["doc_id"] == 70] == [("a [SECRET] b [SECRET] c", 23)]
    assert secret_scan.redact(empty).count() == 0


def test_short_signed_token():
    """A token needs no long run beside it to be found."""
    token = "eyJhbGciOiJub25lIn0.e30.AA"
    assert secret_scan.confirmed_spans(token) == [("jwt", 0, len(token))]
    assert secret_scan.confirmed_spans(f"a {token} " + "b" * 60) == [("jwt", 2, 2 + len(token))]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "token = abcdefghij", "x", 5)], "doc_id long, text string, spans string, N_HEX int")
    (r,) = secret_scan.scan(docs, keep=["doc_id", "spans", "N_HEX"]).collect()
    assert r["spans_given"] == "x" and r["N_HEX_given"] == 5 and r["spans"] == "assign:0:18" and r["n_hex"] == 0
