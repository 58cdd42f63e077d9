"""MinHash near-dedup with min-max hashing.

Each of ``PERMUTATIONS`` universal hash functions gives two signature values, the least and the greatest
hash of a document's shingles, so a signature costs half the hash evaluations. Bands of ``ROWS`` values
are buckets.

1. Documents of equal shingle sets are one class (a 128-bit key of the set); its smallest id stands for it.
2. In each bucket, every member is compared with the member of smallest id: a star, however large the
   bucket. Sets are read from the documents again and the links confirmed on them.
3. Components of the confirmed links are found. Members of one bucket in different components are then
   compared with each other; sizes, a sketch and the full sets are all tested inside the join, so that only
   confirmed links leave it. The sketch passes over a link with a chance of about 1e-9 (six standard errors).
4. Components of all links.

A link that both steps would find within one component is looked at once only: it could not change any
component. Pairs that share no bucket are not compared; at the threshold 0.85 a pair is missed with a
chance below 1e-6, at 0.8 below 4e-5.

Defined cases: null, empty and wordless texts have an empty set, link with nothing and are kept; with
fewer than five words the whole sequence is the one shingle; rows equal in doc_id and text are one
document, different texts under one doc_id, or none, several, in the order of a hash; a null doc_id counts as the smallest id; an empty table gives no rows; ties do not arise, as
components are named by their smallest id; other columns pass through ``dedup`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
PERMUTATIONS = 65
ROWS = 5
AT_ONCE = 100_000

SKETCHED = "doc_id long, n_shingles long, key1 long, key2 long, bits1 long, bits2 long, buckets array<long>"


def _functions(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(common.shingle_hashes(common.text_hashes(text), words))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """2 * PERMUTATIONS values for each (not empty) set: the minima, then the maxima."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    values = np.concatenate(sets)
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for k, (a, b) in enumerate(zip(*_functions(), strict=True)):
        x = values * a
        x += b
        x ^= x >> np.uint64(32)  # the low bits of a product are poor, its order is that of the high ones
        x *= np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = np.minimum.reduceat(x, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(x, starts)
    return out


def buckets(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of ROWS values; bands differ in their hashes."""
    n, m = signature.shape
    rows = signature[:, : m // ROWS * ROWS].reshape(n, -1, ROWS)
    out = np.broadcast_to(np.arange(1, rows.shape[1] + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        out = common.mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return out


def _bits(signature: np.ndarray) -> np.ndarray:
    """The lowest bit of each of the first 128 values, mixed, as two numbers."""
    bit = common.mixed(signature[:, :128]) & np.uint64(1)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return np.stack([(bit[:, :64] * weight).sum(1, dtype=np.uint64), (bit[:, 64:] * weight).sum(1, dtype=np.uint64)])


def sketched(docs: DataFrame, words: int) -> DataFrame:
    def flush(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [k for k, s in enumerate(sets) if len(s)]
        keys, bands = np.zeros((4, len(ids)), np.uint64), [[]] * len(ids)
        if full:
            own = [sets[k] for k in full]
            sig = signatures(own)
            keys[0, full] = [common.mixed(s).sum(dtype=np.uint64) for s in own]
            keys[1, full] = [common.mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in own]
            keys[2:, full] = _bits(sig)
            for k, b in zip(full, buckets(sig).view(np.int64), strict=True):
                bands[k] = b
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(k.view(np.int64)) for k in keys), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "key1", "key2", "bits1", "bits2", "buckets"],
        )

    def run(batches):
        for batch in batches:
            ids, sets, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc_id)
                sets.append(shingles(text.as_py(), words))
                held += len(sets[-1])
                if held > AT_ONCE:
                    yield flush(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield flush(ids, sets)

    return docs.select("doc_id", "text").mapInArrow(run, SKETCHED)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, set) of the wanted documents. The texts are dealt out by document at any size, as no broadcast holds what grows with the corpus."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                sets = [shingles(t.as_py(), words).view(np.int64) for t in part.column("text")]
                sizes = pa.array(np.cumsum([0, *(len(s) for s in sets)]), pa.int32())
                yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(sets)))], names=["node", "set"])

    return docs.join(wanted.hint("merge"), docs["doc_id"] == wanted["node"], "left_semi").select("doc_id", "text").mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"])


def _linked(x: Column, y: Column, nx: Column, ny: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, on distinct arrays."""
    return F.size(F.array_intersect(x, y)) * (100 + percent) >= (nx + ny) * percent


def links(docs: DataFrame, percent: int, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Gives each document's sketch (doc_id, n_shingles, rep), and (a, b): enough links
    between documents of different sets that their components are those of all links."""
    sketch = common.written(sketched(docs, words), "sketches")
    full = sketch.where("n_shingles > 0")
    reps = common.written(full.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    known = sketch.join(reps.where("copies > 1").select("key1", "key2", "rep"), ["key1", "key2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    alone = full.join(reps.select(F.col("rep").alias("doc_id"), "key1", "key2"), ["doc_id", "key1", "key2"], "left_semi").dropDuplicates(["doc_id", "key1", "key2"])
    members = alone.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bits1", "bits2", F.explode("buckets").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = common.written(members.join(heads, "bucket"), "bucket-members")

    stars = common.written(members.where("node <> head").groupBy("node", "head").agg(F.first("n").alias("n")), "stars")
    sets = common.written(_sets(docs, members.select("node").distinct(), words), "shingle-sets")
    of_node = stars.join(sets, "node").select("head", "node", F.col("set").alias("x"))
    of_head = sets.select(F.col("node").alias("head"), F.col("set").alias("y"))
    confirmed = of_node.join(of_head, "head").where(_linked(F.col("x"), F.col("y"), F.size("x"), F.size("y"), percent)).select(F.col("head").alias("a"), F.col("node").alias("b"))
    confirmed = common.written(confirmed, "links")

    group = common.components(confirmed, "star-components")
    placed = members.drop("head").join(group.withColumnRenamed("component", "own"), "node", "left").withColumn("own", F.coalesce("own", "node"))
    placed = common.written(placed, "placed-members")
    mixed = placed.groupBy("bucket").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("bucket")
    open_ = placed.join(mixed, "bucket").join(sets, "node")
    x, y = open_.alias("x"), open_.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    far = F.bit_count(F.col("x.bits1").bitwiseXOR(F.col("y.bits1"))) + F.bit_count(F.col("x.bits2").bitwiseXOR(F.col("y.bits2")))
    # each of 128 bits differs with chance (1 - similarity) / 2; six standard errors beyond are not a link
    chance = (1 - percent / 100) / 2
    most = int(128 * chance + 6 * (128 * chance * (1 - chance)) ** 0.5)
    more = x.join(
        y,
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.own") != F.col("y.own"))
        & (nx * 100 >= ny * percent)
        & (ny * 100 >= nx * percent)
        & (far <= most)
        & _linked(F.col("x.set"), F.col("y.set"), nx, ny, percent),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = common.written(more.distinct(), "more-links")
    return known, confirmed.union(more)


def grouped(docs: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    rows, names = common.keyed(docs)
    return common.ids_again(_grouped(rows, percent, words), names, "doc_id", "component_id")


def _grouped(rows: DataFrame, percent: int, words: int) -> DataFrame:
    """grouped of keyed documents, with their numbers for ids."""
    known, found = links(rows.select(F.col("__own").alias("doc_id"), F.col("text").cast("string").alias("text")), percent, words)
    known = common.written(known, "known")
    group = common.components(found)
    out = known.join(group, known["rep"] == group["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def dedup(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """The rows of docs, with all columns, whose document is the smallest id of its component."""
    rows, _ = common.keyed(docs)
    gone = _grouped(rows, percent, words).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return rows.join(gone, F.col("__own") == F.col("__gone"), "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: doc_id, n_shingles, component_id, kept, with links of 85 in 100 and more."""
    return grouped(common.documents(spark, sf_dir), 85)


ORACLE = f"""
with recursive w as (select doc_id, {common.sql_words('text')} as words from documents),
sh as (select distinct doc_id, array_to_string(words[p:p + {WORDS - 1}], ' ') as gram from (select doc_id, words, unnest(range(1, greatest(2, len(words) - {WORDS - 2}))) as p from w where len(words) > 0)),
n as (select doc_id, count(*) as n from sh group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(node, seen) as (select doc_id, doc_id from documents union select r.node, e.b from r join e on r.seen = e.a),
g as (select node, min(seen) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, g.component_id, d.doc_id = g.component_id as kept from documents d join g on g.node = d.doc_id left join n on n.doc_id = d.doc_id
"""
