import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvina.llm import packing, tokens

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_library():
    rng = random.Random(1)
    parts = ["a", "Bé", " ", "\n", "'s", "'", "1", "23", ".", "!!", "<|endoftext|>", "\u00a0", "\x85", "\x1c", "\t", "日本", "ß", "\u0301", "🙂", "\r", "'ll", "\u2028", "-", "(x)"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    encoder = tokens.Encoder(PATH, most=50)  # so small that both generations are in use
    assert encoder.encode(texts) == encoder.whole(texts)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert np.array_equal(tokens.from_planes(tokens.to_planes(ids, kind), n, kind), ids)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_shard_round_trip(kind):
    parts = [np.arange(n, dtype="<u4").tobytes() for n in (0, 3, 70_000, 1)]
    shard = tokens.pack_shard([5, None, -2, 7], parts, chunk_ids=1000, kind=kind)
    ids, lengths, flat = tokens.unpack_shard(shard)
    assert ids == [5, None, -2, 7] and lengths.tolist() == [0, 3, 70_000, 1]
    assert flat.tobytes() == b"".join(parts)
    kind_, _, index, base = tokens.read_index(shard)
    assert np.array_equal(tokens.read_chunk(shard, index[3], kind_, base), flat[3000:4000])  # one chunk alone
    broken = bytearray(shard)
    broken[base + index[0][2][0][0] + 12] ^= 1
    with pytest.raises(Exception):
        tokens.unpack_shard(bytes(broken))


def test_encode_corpus(spark, odd, long_text, tmp_path):
    docs = odd.select("doc_id", "text", "start").unionByName(spark.createDataFrame([(100, long_text, 1)], "doc_id long, text string, start int"))
    path = f"file://{tmp_path}/t"
    tokens.write_shards(docs, path, PATH, shard_ids=40)
    got = sorted(tuple(r) for r in tokens.read_documents(spark, path, with_ids=True).collect() if r["doc_id"] is not None)
    want = Counter((d, tuple(plain_ids(t))) for d, t in [*ODD, (100, long_text)] if d is not None)
    assert Counter((d, tuple(ids)) for d, _, _, _, ids in got) == want
    everything = tokens.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    at, last = 0, -1
    for r in everything:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert (-1 if r["doc_id"] is None else r["doc_id"]) >= last
        at, last = at + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]
    assert tokens.export_shards(spark, path, str(tmp_path)) == spark.read.parquet(path).count() == len(list(tmp_path.glob("*.cvt")))


def test_encode_empty_table(spark, empty):
    assert tokens.encode_corpus(spark, empty, PATH).count() == 0
    assert packing.pack(spark, empty, PATH).count() == 0


def test_shortest_pack_first():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([1, 2, 8, 16, 64])
        histogram = {n: rng.randint(1, 30) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 12)))}
        patterns = packing.shortest_pack_first(histogram, capacity)
        placed = Counter()
        for lengths, count in patterns:
            assert count > 0 and sum(lengths) <= capacity
            for n in lengths:
                placed[n] += count
        assert placed == histogram
        table, sequences = packing.slots(patterns)
        assert sequences == sum(c for _, c in patterns)
        for n, count in histogram.items():
            assert sorted(r for x, lo, hi, _, _ in table if x == n for r in range(lo, hi + 1)) == list(range(count))


def test_pack(spark, odd, prose):
    rows = [(1000 + i, prose(n, i)) for i, n in enumerate([3, 40, 700, 2500, 90, 91, 92, 5])]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = packing.pack(spark, docs, PATH, capacity=64, with_ids=True).collect()
    whole = Counter()
    for d, t in [*ODD, *rows]:
        ids = plain_ids(t)
        for s in range(0, len(ids), 64):
            whole[(d, s, tuple(ids[s : s + 64]), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"]), r["doc_tokens"]) for r in got) == whole
    by = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by) == list(range(len(by)))
    assert len(by) <= 1.1 * sum(r["length"] for r in got) / 64 + 2
