"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set holds the distinct shingles of ``k`` words (the whole sequence where it has fewer words). The sketch
has ``bands * rows`` coordinates. Fast similarity sketching fills it in rounds: in each of the first t rounds every
element goes to a hashed bin with a hashed value, later values of a bin only count if no earlier round filled it, and
rounds t to 2t send all elements to one bin each, so every coordinate is filled for any non-empty set. Coordinates
agree with probability J, with concentration as for independent ones.

Steps, each over tables in the shared folder:

1. one pass over the texts: set size, a 128-bit digest of the set, the hash of each band;
2. documents with equal sets form a class (partial aggregation, so any number of copies is no hot spot);
3. postings: band hashes that two classes or more share; a pair of similarity 0.8 shares no band of 56 with 6 rows
   with probability 4e-8;
4. each bucket first links its members to its smallest one; links are confirmed on the full sets; connected components;
5. only buckets that still hold more than one component go on: members outside a bucket's largest component are
   compared with the members of other components, in large buckets block by block (see ``open_pairs``).

No bucket is capped and nothing is collected: a bucket whose members are all in one component is done after step 4.

Null texts, empty texts and texts without words have the empty set, which is linked with nothing. Rows that share a
doc_id count as one document. Rows without doc_id are linked too but give no component_id; a component of only such
rows has none, and all its rows are kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, delete, gram_hashes, map_texts, mix, spread_join, stored, word_hashes, written

EMPTY = np.iinfo(np.uint64).max
U = np.uint64


def shingle_set(text: str, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at 20 and 09-0D
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    if len(words) < k:
        return gram_hashes(h, len(words)) ^ U(len(words))
    return np.unique(gram_hashes(h, k))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches: a row of t values for each set, all EMPTY for an empty set."""
    n = len(sets)
    out = np.full(n * t, EMPTY, U)
    owner = np.repeat(np.arange(n, dtype=np.int64) * t, [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.empty(0, U)
    low = U(0xFFFFFFFF)
    for r in range(2 * t):
        if not len(items):
            break
        x = mix(items + U((r * 0x9E3779B97F4A7C15 + 0x1234567) & ((1 << 64) - 1)))
        place = owner + (((x & low) * U(t)) >> U(32)).astype(np.int64) if r < t else owner + (r - t)
        np.minimum.at(out, place, (x >> U(32)) | U(r << 32))
        full = (out.reshape(n, t) != EMPTY).all(axis=1)
        if full.any():
            left = ~full[owner // t]
            items, owner = items[left], owner[left]
    return out.reshape(n, t)


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=U), parts.shape[:2]).copy()
    for j in range(rows):
        h = mix(h * U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h


def sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def make():
        hashes = word_hashes()

        def work(texts: list[str]) -> dict:
            sets = [shingle_set(t, k, hashes) for t in texts]
            found = band_hashes(sketches(sets, bands * rows), bands, rows).view(np.int64)
            digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) if len(s) else (0, 0) for s in sets], np.int64).reshape(-1, 2)
            sizes = np.array([len(s) for s in sets], np.int64)
            kept = found[sizes > 0]
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))])
            return {"n_shingles": sizes, "d1": digest[:, 0], "d2": digest[:, 1], "bands": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kept.reshape(-1)))}

        return work

    return map_texts(docs, make, "n_shingles long, d1 long, d2 long, bands array<long>", keep=["doc_id", "id"])


def shingles(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, grams) of each text."""

    def make():
        hashes = word_hashes()

        def work(texts: list[str]) -> dict:
            sets = [shingle_set(t, k, hashes).view(np.int64) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            return {"n": [len(s) for s in sets], "grams": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))}

        return work

    return map_texts(docs, make, "n long, grams array<long>", keep=["id"])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, comp) for the nodes of ``edges`` (a, b); comp: the smallest node reachable. Large-star, small-star; the hub of
    a giant component is a hot key of both joins (see ``spread_join``). A round's table goes once the next is there."""
    e, path = stored(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        several = e.groupBy("u").count().where("count > 1").limit(1)
        chained = e.join(e.select(F.col("u").alias("v")), "v", "left_semi").select("u").limit(1)
        if several.isEmpty() and chained.isEmpty():
            break
        total = e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, ["u"], 2 * total).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e, path, old = *stored(spark, large, "large"), path
        delete(spark, old)
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(e, least, ["u"], total).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e, path, old = *stored(spark, small.select("x.u", "x.v").where("u <> v").distinct(), "small"), path
        delete(spark, old)
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return written(spark, e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots), "components")


def sizes_fit(n: Column, m: Column, percent: int) -> Column:
    """What the sizes alone allow: the smaller set must reach the share of the larger."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def confirmed(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on the full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("g_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("g_b"))
    pairs = written(spark, pairs, "asked")
    total = pairs.count()
    both = spread_join(spread_join(pairs, left, ["a"], total), right, ["b"], total).where(sizes_fit(F.col("n_a"), F.col("n_b"), percent))
    both = both.withColumn("shared", F.size(F.array_intersect("g_a", "g_b")))
    return written(spark, both.where(f"100 * shared >= {percent} * (n_a + n_b - shared)").select("a", "b").distinct(), "links")


#: Buckets of so many members are compared by a join; larger ones block by block.
SMALL = 32
#: Members of a block.
BLOCK = 1024
#: Bits of the table in which a block marks a set.
MARK_BITS = 22


def open_pairs(spark: SparkSession, postings: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Candidate pairs across components in the buckets that hold more than one component; empty if there is none.

    Members of the bucket's largest component are never compared with each other, so what is done grows with the
    members outside it.
    """
    placed = postings.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("n_comp"))
    keys = parts.groupBy("key").agg(F.sum("n_comp").alias("members"), F.max_by("comp", F.struct("n_comp", "comp")).alias("main"), F.max("n_comp").alias("in_main")).where("members > in_main")
    opened = written(spark, placed.join(keys, "key"), "open")
    if opened.isEmpty():
        return []
    small = opened.where(F.col("members") <= SMALL).select("key", "id", "n", "comp")
    a = small.select("key", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("c_a"))
    b = small.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("c_b"))
    pairs = a.join(b, "key").where("a < b and c_a <> c_b").where(sizes_fit(F.col("n_a"), F.col("n_b"), percent))
    out = [pairs.select("a", "b").distinct()]
    large = opened.where(F.col("members") > SMALL)
    if not large.isEmpty():
        out.append(block_pairs(large, sets, percent))
    return out


def block_pairs(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """In each bucket, the pairs of a member outside the main component and a member of another component whose sets may
    reach the similarity.

    A task gets a block of outside members and a block of all members with their shingles cut to 31 bits. It counts
    shared shingles by marking one set at a time, which can only count too many; so none is missed, and the pairs it
    gives are confirmed on the full sets afterwards. Only these pairs leave the task.
    """
    grams = sets.join(large.select("id").distinct(), "id", "left_semi").groupBy("id", "n").agg(F.first("grams").alias("grams"))
    grams = grams.select("id", F.transform("grams", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("grams"))
    whole = lambda n: F.ceil(n / BLOCK).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    of_all, of_outside = whole(F.col("members")), whole(F.col("members") - F.col("in_main"))
    members = large.select("key", every(of_outside).alias("i"), dealt(of_all).alias("j"), F.lit(0).alias("role"), "id", "n", "comp")
    outside = large.where("comp <> main").select("key", dealt(of_outside).alias("i"), every(of_all).alias("j"), F.lit(1).alias("role"), "id", "n", "comp")
    rows = members.unionByName(outside).join(grams, "id")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role").select("key", "i", "j", "role", "id", "n", "comp", "grams")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compared(block: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        t = pa.Table.from_batches(block)
        role, ids, n, comp = (t.column(c).to_numpy() for c in ("role", "id", "n", "comp"))
        lists = t.column("grams").combine_chunks()
        flat = lists.flatten().to_numpy() & ((1 << MARK_BITS) - 1)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        m = int((role == 0).sum())
        if not m:
            return []
        columns, starts = flat[: ends[m]], ends[:m]
        marks, out = np.zeros(1 << MARK_BITS, np.uint8), []
        for r in range(m, len(role)):
            own = flat[ends[r] : ends[r + 1]]
            marks[own] = 1
            shared = np.add.reduceat(marks[columns], starts, dtype=np.int64)
            marks[own] = 0
            hit = (100 * shared >= percent * (n[:m] + n[r] - shared)) & (comp[:m] != comp[r])
            out += [(min(int(ids[r]), x), max(int(ids[r]), x)) for x in ids[:m][hit].tolist()]
        return out

    def run(batches):
        held, at = [], None
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if s == e:
                    continue
                here = tuple(int(k[s]) for k in keys)
                if held and here != at:
                    found = compared(held)
                    held = []
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)
                at = here
                held.append(batch.slice(s, e - s))
        if held and (found := compared(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return rows.mapInArrow(run, "a long, b long").distinct()


def with_id(docs: DataFrame) -> DataFrame:
    """``docs`` with id: the doc_id, or a negative number made from the text where it is missing."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.lit(-(1 << 62)) - F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1))
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), own))


def resolved(spark: SparkSession, docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, id, n_shingles, d1, d2, bands) of each row; (d1, d2, component_id, first_id) of each class of equal sets.

    first_id is component_id, or the smallest made-up id of a component without any doc_id.
    """
    base = with_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows_ = written(spark, sketched(base, k, bands, rows), "sketches")
    classes = rows_.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.min("doc_id").alias("least_doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(spark, classes, "classes")

    keys = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    postings = written(spark, keys.join(shared, "key", "left_semi"), "postings")

    wanted = postings.select("id").distinct()
    sets = shingles(base.join(wanted, "id", "left_semi").select("id", "text"), k).where("n > 0")
    sets = written(spark, sets.groupBy("id", F.xxhash64("grams").alias("h")).agg(F.first("n").alias("n"), F.first("grams").alias("grams")).drop("h"), "sets")

    pivots = postings.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"))
    pairs = spread_join(postings, pivots, ["key"], postings.count()).where("id <> p.id").where(sizes_fit(F.col("n"), F.col("p.n"), percent))
    pairs = written(spark, pairs.select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    edges = confirmed(spark, pairs, sets, percent)
    comps = components(spark, edges)
    more = [confirmed(spark, found.join(pairs, ["a", "b"], "left_anti"), sets, percent) for found in open_pairs(spark, postings, comps, sets, percent)]
    if more:
        comps = components(spark, reduce(DataFrame.unionByName, more, edges))

    members = classes.select("d1", "d2", "least_doc", "id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    members = written(spark, members, "members")
    least = members.groupBy("comp").agg(F.min("least_doc").alias("component_id"))
    named = spread_join(members, least, ["comp"], members.count()).select("d1", "d2", "component_id", F.coalesce("component_id", "comp").alias("first_id"))
    return rows_, named


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 56, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text)."""
    rows_, named = resolved(spark, docs, k, percent, bands, rows)
    # the empty set has no class: such documents stand alone
    out = spread_join(rows_.select("doc_id", "n_shingles", "d1", "d2"), named.drop("first_id"), ["d1", "d2"], rows_.count(), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 56, rows: int = 6) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged: of each component one, the one with the smallest doc_id.

    Rows that share a doc_id are one document, of which one row stays; rows without doc_id are told apart by their text.
    """
    rows_, named = resolved(spark, docs, k, percent, bands, rows)
    stay = named.select(F.col("first_id").alias("id")).unionByName(rows_.where("n_shingles = 0").select("id")).distinct()
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], "doc_id", "text")
    out = with_id(held).drop("doc_id", "text").join(stay, "id", "left_semi")
    repeated = rows_.groupBy("id").count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        out = out.dropDuplicates(["id"])
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
