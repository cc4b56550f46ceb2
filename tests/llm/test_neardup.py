import random
from collections import Counter

import numpy as np
import pytest

from corvina import tables
from corvina.llm import common, neardup

from .conftest import ODD


def plain_sets(rows, k):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def plain_components(rows, k):
    sets = plain_sets(rows, k)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)) or (rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        comp = d if not sets[i] else min(ids, default=None)
        out.append((d, len(sets[i]), comp, comp is None or d == comp))
    return out


def copies(rng, text, n, share):
    """Copies with some words replaced, and copies of these."""
    out, words = [text], text.split()
    for _ in range(n):
        words = list(rng.choice(out).split())
        for _ in range(max(1, int(share * len(words)))):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out[1:]


@pytest.mark.parametrize("k", [2, 5])
def test_equals_all_pairs(spark, odd, prose, k, monkeypatch):
    for name, value in (("HOT_ROWS", 3), ("MOST_HOT", 30)) if k == 2 else ():  # most joins meet hot keys
        monkeypatch.setattr(common, name, value)
    rng = random.Random(k)
    texts = [prose(n, i) for i, n in enumerate([1, 2, 4, 5, 30, 80, 150, 400])]
    for t, n, share in ((texts[6], 60, 0.02), (texts[7], 30, 0.03), (texts[5], 10, 0.04)):
        texts += copies(rng, t, n, share)
    texts += [texts[6]] * 40 + [texts[4].upper()]
    rows = [(20 + i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = odd.select("doc_id", "text", "kept", "bands").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    everything = [*ODD, *rows]
    got = neardup.near_duplicates(spark, docs, k=k).collect()
    assert Counter(map(tuple, got)) == Counter(plain_components(everything, k))
    stay = neardup.deduplicated(spark, docs, k=k)
    assert stay.columns == docs.columns
    kept = [r["doc_id"] for r in stay.collect() if r["doc_id"] is not None]
    assert sorted(kept) == sorted({d for d, _, c, _ in plain_components(everything, k) if d == c and d is not None})


@pytest.mark.parametrize("block", [1024, 7])
def test_open_buckets(spark, prose, monkeypatch, block):
    """Large buckets whose members are in several components are compared block by block; none is lost."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SMALL", 4)
    rng = random.Random(9)
    passage = prose(300, 1)
    rows = []
    for i in range(50):  # half of each text is shared: many buckets in common, no links
        own = passage + " " + prose(150, 100 + i)
        rows.append((1000 + i, own))
        if i % 10 == 0:
            rows.append((2000 + i, copies(rng, own, 1, 0.01)[0]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(spark, docs, k=2, bands=56, rows=6).collect()
    assert Counter(map(tuple, got)) == Counter(plain_components(rows, 2))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join(spark, how):
    """The same rows as a plain join; the rows of a hot key are dealt over several groups."""
    rows = spark.createDataFrame([(7, i) for i in range(3000)] + [(8, i) for i in range(1500)] + [(i, i) for i in range(100, 200)], "key long, n long")
    one = spark.createDataFrame([(k, f"v{k}") for k in (7, 8, *range(150, 220))], "key long, v string")
    got, want = common.spread_join(rows, one, ["key"], rows.count(), how), rows.join(one, ["key"], how)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    hot = {r["key"]: r["_ways"] for r in tables.hot_keys(rows, ["key"], rows.count(), 1000).collect()}
    assert hot == {7: 3, 8: 2}
    assert tables.hot_keys(rows.where("key > 8"), ["key"], 100, 10) is None


def test_sketch_agreement():
    rng = np.random.default_rng(1)
    for n, shared in ((200, 150), (3, 2), (1, 1)):
        agree = []
        for _ in range(20):
            items = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
            a, b = neardup.sketches([items[:n], items[n - shared :]], 336)
            assert (a != neardup.EMPTY).all()
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - shared / (2 * n - shared)) < 0.04


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(10, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    got = dict(map(tuple, neardup.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: c for x, c in parent.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_empty_and_long(spark, empty, long_text):
    assert neardup.near_duplicates(spark, empty).count() == 0
    assert neardup.deduplicated(spark, empty).count() == 0
    docs = spark.createDataFrame([(1, long_text), (2, long_text + " x"), (3, long_text[:1000])], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark, docs).collect()} == {1: 1, 2: 1, 3: 3}
