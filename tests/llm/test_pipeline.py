import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corvina.llm import queries, secret_scan, toxicity

from .test_decontam_secrets import plain_hits
from .test_neardup import plain_components

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
            if name in ("near_duplicates", "decontamination"):
                assert set(map(tuple, out.select("doc_id", "text").collect())) <= set(map(tuple, docs.select("doc_id", "text").collect()))
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = Counter({r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()})
            got = Counter()
            for r in out.collect():
                got[r["doc_id"]] += r["length"]
            assert got == want
        docs = corpus_pipeline.written(spark, out, "test")
        seen.append(docs.count())
        texts[name] = docs
    assert seen[0] > seen[1] >= seen[2] >= seen[3] == seen[4] and seen[2] > 0
    assert not [r for r in texts["secrets"].collect() if 'token = "' in (r["text"] or "")]


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run(spark, name):
    out = queries.QUERIES[name](spark, SF)
    ids = "page_id" if "url" in name else "doc_id"
    want = spark.read.parquet(f"{SF}/{'pages' if 'url' in name else 'documents'}.parquet").select(ids)
    assert out.select(ids).distinct().count() == want.distinct().count()
    if name in queries.ORACLE:
        from oracle import both

        ours, theirs = both(spark, queries.QUERIES[name], queries.ORACLE[name], SF)
        assert ours == theirs


# --- stage by stage against brute force, on nulls, repeated rows, ties and long texts


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with all that a stage must catch, and what it must leave."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(260):
        toxic = i % 4 == 0
        text = prose(rng.randint(30, 90)) + (" vileword and badbad " + prose(5) if toxic else "")
        rows.append((i, text, "en" if i % 2 else "de", "a"))
        labels.append((i, 1, int(toxic)))
    item = prose(30)
    base = prose(200)
    rows += [(1000, None, "en", "a"), (1001, "", None, "a"), (1002, " \n ", "en", None), (1003, base, "en", "a"), (1004, base, "en", "a"), (1004, base, "en", "a"), (1005, base + " one more", "de", "b"), (1006, prose(30) + " " + item + " " + prose(9), "en", "a"), (1007, " ".join(item.split()[:9]), "en", "a"), (1008, 'token = "abcdefgh12" ' + prose(40), "en", "a"), (1009, prose(40_000), "en", "a"), (None, prose(20), "en", "a"), (None, None, None, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def rows_of(df):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect())


def test_stages_against_brute_force(spark, corpus, tmp_path):
    folder, item = corpus
    kept = str(tmp_path / "stages")
    out = corpus_pipeline.run(spark, folder, keep_in=kept)
    before = spark.read.parquet(f"{folder}/documents.parquet")
    tables = {name: spark.read.parquet(f"{kept}/{name}") for name, _ in corpus_pipeline.STAGES}

    left = rows_of(tables["toxicity"])
    model = toxicity.train(before, spark.read.parquet(f"{folder}/labels.parquet"))
    words = toxicity.Words(len(model.embed))
    score = lambda t: float(toxicity.sigmoid(model.scale * toxicity.raw_scores(model, [words.of(t or "")])[0] + model.shift))
    assert left == Counter({r: n for r, n in rows_of(before).items() if score(r[1]) < model.thresholds.get(r[2] or "", model.thresholds[""])})

    rows = sorted(left.elements(), key=repr)
    want = Counter()
    groups = {}
    for r, (d, _, comp, stays) in zip(rows, plain_components([(r[0], r[1]) for r in rows], 5)):
        if comp is None:
            want[r] = 1  # rows without an id are told apart by their text
        elif stays:
            groups.setdefault(d, r)
    want += Counter(groups.values())
    assert rows_of(tables["near_duplicates"]) == want

    clean = Counter({r: n for r, n in want.items() if not plain_hits(r[1], [(1, item)])[1]})
    assert rows_of(tables["decontamination"]) == clean and len(clean) < len(want)

    redacted = Counter()
    for d, t, lang, source, n in clean.elements():
        found = secret_scan.in_order(secret_scan.base_spans(t or "") + secret_scan.confirmed_spans(t or ""))
        new = secret_scan.redacted(t, found) if found else t
        redacted[d, new, lang, source, len(new) if found else n] += 1
    assert rows_of(tables["secrets"]) == redacted and any("[SECRET]" in (r[1] or "") for r in redacted)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for d, t, *_ in redacted.elements())
    pieces = out.collect()
    whole, places = {}, {}
    for r in pieces:
        assert len(r["ids"]) == r["length"] <= 1024 and r["offset"] + r["length"] <= 1024
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            whole.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for got in places.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
    assert {(d, tuple(x for _, part in sorted(parts) for x in part)) for d, parts in whole.items()} == {k for k in ids if k[0] is not None}
    assert sum(r["length"] for r in pieces) == sum(len(k[1]) * n for k, n in ids.items())


def test_taken_up_again(spark, corpus, tmp_path, monkeypatch):
    """A run that fails in a stage is taken up there; the stages before it are not run again."""
    folder, _ = corpus
    kept, ran = str(tmp_path / "stages"), []

    def traced(name, stage):
        def run(*args):
            ran.append(name)
            if name == "secrets" and ran.count("secrets") == 1:
                raise RuntimeError("lost")
            return stage(*args)

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [traced(n, s) for n, s in corpus_pipeline.STAGES])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, folder, keep_in=kept)
    first = list(ran)
    corpus_pipeline.run(spark, folder, keep_in=kept)
    assert first == ["toxicity", "near_duplicates", "decontamination", "secrets"] and ran[len(first) :] == ["secrets", "packing"]
