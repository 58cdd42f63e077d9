"""Document fingerprints: MinHash of five-word shingles under many universal hash permutations.

A fingerprint is ``PERMUTATIONS`` values of eight bits, in hex; the likeness of two is the share of equal
values, corrected for those that are equal by chance, an estimate of the sets' Jaccard similarity.
``similar`` joins bands of the signatures in Spark and verifies the candidates on the shingles.

``edited_by_next`` needs each document's successor in the order of falling doc_id. Rows are range-
partitioned and sorted, each task walks through its own range, and only a range's last document waits
for the first of the next range, in a join of as many rows as there are ranges.

Defined cases: a null text is empty; an empty or wordless text has the fingerprint of the empty set, which is like
itself (1) and like nothing else (0); with fewer than five words the whole sequence is the one shingle;
equal doc_ids follow each other in the order of a hash of their texts; a null doc_id comes last; the last
document's successor is the first, a single document is its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
PERMUTATIONS = 128
BAND = 4
AT_ONCE = 100_000


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    return rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    return common.shingle_hashes(common.text_hashes(text), WORDS)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """PERMUTATIONS bytes for each set; zeros for an empty one."""
    out = np.zeros((len(sets), PERMUTATIONS), np.uint8)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    values = np.concatenate(sets)
    least = np.empty((len(full), PERMUTATIONS), np.uint64)
    x = np.empty_like(values)
    for k, (a, b) in enumerate(zip(*_functions(), strict=True)):
        np.multiply(values, a, out=x)
        x += b
        least[:, k] = np.minimum.reduceat(x, starts)
    out[full] = (common.mixed(least) >> np.uint64(56)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray, a_full: np.ndarray, b_full: np.ndarray) -> np.ndarray:
    """0 to 1, row by row; *_full: whether the sets have members."""
    same = (a == b).mean(1)
    found = np.clip((same - 1 / 256) / (1 - 1 / 256), 0, 1)
    return np.where(a_full & b_full, found, (a_full == b_full).astype(np.float64))


def edited(text: str, following: str) -> str:
    """text, with its last half replaced by as much of what follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROWS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_WALK = pa.schema([*ROWS, ("range", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str]) -> dict[str, list]:
    """Columns for all but the last text, whose successor is not here."""
    after = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    sets = [shingles(t) for t in [*texts, *after]]
    sig, full = signatures(sets), np.array([len(s) > 0 for s in sets])
    n = len(after)
    own, ed = slice(0, n), slice(n + 1, 2 * n + 1)
    return {
        "doc_id": ids[:n],
        "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in after],
        "fingerprint": [s.tobytes().hex() for s in sig[own]],
        "edited_fingerprint": [s.tobytes().hex() for s in sig[ed]],
        "near_edited": likeness(sig[own], sig[ed], full[own], full[ed]),
        "near_next": likeness(sig[own], sig[1 : n + 1], full[own], full[1 : n + 1]),
    }


def _walk(batches):
    at = TaskContext.get().partitionId()
    ids: list = []
    texts: list[str] = []
    first: str | None = None

    def flush() -> pa.RecordBatch:
        nonlocal ids, texts, first
        cols = _rows(ids, texts)
        n = len(cols["doc_id"])
        cols |= {"range": [at] * n, "first_text": [first if k == 0 else None for k in range(n)], "last_text": [None] * n}
        first = None if n else first
        ids, texts = ids[-1:], texts[-1:]
        return pa.record_batch(cols, schema=_WALK)

    held = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            if not ids:
                first = text
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
            if held > 6 * AT_ONCE:
                yield flush()
                held = 0
    if ids:
        yield flush()
        blank = {f.name: [None] for f in _WALK}
        yield pa.record_batch(blank | {"doc_id": ids, "range": [at], "first_text": [first], "last_text": texts}, schema=_WALK)


def _last(batches):
    for batch in batches:
        for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "last_text", "following")), strict=True):
            yield pa.record_batch(_rows([doc_id, None], [text, following]), schema=ROWS)


def edited_by_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    keys = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    walked = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(_walk, _DDL + ", range int, first_text string, last_text string")
    walked = common.written(walked, "fingerprints")
    ranges = sorted(r["range"] for r in walked.where("last_text is not null").select("range").collect())  # a number for each task that had rows
    spark = docs.sparkSession
    order = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "range int, following_range int")
    heads = walked.where("first_text is not null").select(F.col("range").alias("following_range"), F.col("first_text").alias("following"))
    ends = walked.where("last_text is not null").select("doc_id", "range", "last_text").join(order, "range").join(heads, "following_range")
    last = ends.select("doc_id", "last_text", "following").mapInArrow(_last, _DDL)
    return walked.where("last_text is null").select(*ROWS.names).union(last)


def similar(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity): pairs of distinct texts, each by its smallest doc_id, that a band of their
    signatures brings together and whose shingle sets have the Jaccard similarity ``threshold`` or more."""
    schema = "text_key string, bands array<string>, shingles array<long>"

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                sets = [np.unique(shingles(t.as_py())) for t in part.column("text")]
                sig = signatures(sets)
                bands = [[f"{k}:{s[k : k + BAND].tobytes().hex()}" for k in range(0, PERMUTATIONS, BAND)] if len(v) else [] for s, v in zip(sig, sets, strict=True)]
                yield pa.record_batch([part.column("text_key"), pa.array(bands, pa.list_(pa.string())), pa.array([v.view(np.int64) for v in sets], pa.list_(pa.int64()))], names=["text_key", "bands", "shingles"])

    keyed = docs.where("text is not null and doc_id is not null").select("doc_id", "text", F.sha2("text", 256).alias("text_key"))
    ids = common.written(keyed.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")), "text-ids")
    marked = common.written(keyed.join(ids, ["text_key", "doc_id"], "left_semi").dropDuplicates(["text_key"]).select("text_key", "text").mapInArrow(run, schema).join(ids, "text_key"), "banded")
    bands = marked.select("doc_id", F.explode("bands").alias("band"))
    pairs = bands.alias("x").join(bands.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.doc_id") < F.col("y.doc_id"))).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    x = marked.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xs"))
    y = marked.select(F.col("doc_id").alias("b"), F.col("shingles").alias("ys"))
    shared = F.size(F.array_intersect("xs", "ys"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", (shared / (F.size("xs") + F.size("ys") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: see edited_by_next."""
    return edited_by_next(common.documents(spark, sf_dir))
