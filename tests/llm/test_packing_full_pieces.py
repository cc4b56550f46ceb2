"""Full pieces hold most of the ids and are not shuffled to find their rank; nothing of them is lost."""

import zlib

import numpy as np
import public_tokenizers

from corvina.llm import packing


def test_full_pieces_stay(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(n, f"word{n} and more " * n * 3) for n in range(40)], "doc_id long, text string").repartition(3)
        out = packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=64, with_ids=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastHashJoin") == 1
    assert all(r["length"] == len(r["ids"]) and zlib.crc32(np.array(r["ids"], "<i4").tobytes()) == r["ids_crc32"] for r in rows)
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
    assert len({r["doc_id"] for r in rows}) == 40 and any(r["length"] == 64 for r in rows)
    spots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(spots, spots[1:])) and spots[0][:2] == (0, 0)
