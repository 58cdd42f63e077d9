"""What the training-data operators share: shared-folder tables, words, hashes and components."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = r"[\x20\x09-\x0D]+"


def _tidy() -> None:
    """Collect this process's garbage, and give freed memory back to the system: models and samples that were fitted here would stay otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def trim_native(spark: SparkSession) -> str | None:
    """Have the driver's JVM give freed native memory back to the system, as _tidy does for Python; None where it has no such command.

    What compilers, inflaters and buffers freed stays in malloc's arenas otherwise, and they grow with every plan. Called by
    reflection, as the server's own class is not open to py4j.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        of = jvm.java.lang.Class.forName
        kinds = gateway.new_array(jvm.java.lang.Class, 4)
        for k, c in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = of(c)
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM without the command, or another C library
        return None


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor costs nothing that is done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/braidwork/{tag}-{uuid.uuid4().hex}"
    # Shuffle files of the tables before go when the driver collects its garbage, which may be never. The event
    # queue holds on to the plan of the last query until another one comes.
    spark.range(1).count()
    _tidy()
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


FIRST = -(1 << 63)


def named(column: str) -> Column:
    """A column by its name, whatever the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text, row, __own): row has all columns of docs, __own is a number for each pair of a doc_id and a text, in the order of doc_id, a null one first.

    Where no two texts share a doc_id it is the doc_id itself, FIRST for null, and the second result is None;
    otherwise that is the table of (__own, __id).
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*map(named, docs.columns)).alias("row"))
    own, digest = F.coalesce("doc_id", F.lit(FIRST)), F.xxhash64("text")
    each = base.select(own.alias("__id"), digest.alias("__digest"))
    shared = base.groupBy(own.alias("__id")).agg(F.count("*").alias("n")).where("n > 1").select("__id")
    if shared.isEmpty() or each.join(shared, "__id", "left_semi").groupBy("__id").agg(F.min("__digest").alias("a"), F.max("__digest").alias("b")).where("a <> b").isEmpty():
        return base.withColumn("__own", own), None
    order = ["__id", "__digest"]
    keys = written(each.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__own", F.monotonically_increasing_id()), "keys")
    return base.withColumn("__id", own).withColumn("__digest", digest).join(keys, order).select("doc_id", "text", "row", "__own"), keys.select("__own", "__id")


def ids_again(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """df with the doc_ids in place of the numbers that keyed gave."""
    for c in columns if names is not None else ():
        df = df.join(names, df[c] == names["__own"]).select(*(F.col("__id").alias(c) if x == c else df[x] for x in df.columns))
    return df


def words_of(text: Column | str) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text with A-Z in lower case; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(low, BLANKS), "")


def byte_words(text: str | None) -> list[bytes]:
    """The same words in Python: bytes.lower() and bytes.split() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_mod(doc_id: Column | str, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % n


_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (splitmix64's finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


#: Bytes that are hashed at once; a word's hash depends on none but its own bytes.
SEGMENT = 1 << 18
#: Words longer than this are hashed one by one, by xxh3.
LONG_WORD = 64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * _A)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, 2, ... modulo 2 ** 64."""
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: list[np.ndarray] = []


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row begins and the last one ends. A null has none."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    if column.null_count:
        gone = np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)]
        if gone.any():  # bytes behind a null are nobody's
            return text_bytes(column.fill_null(""))
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words [^\\x20\\x09-\\x0D]+ begin and end; none goes on beyond a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _IS_WORD[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    inner = rows[(rows > 0) & (rows < len(data))]
    inner = np.unique(inner[word[inner] & word[inner - 1]])  # two rows meet within what looks like one word
    turns = np.flatnonzero(edge)
    if len(inner):
        turns = np.sort(np.concatenate([turns, inner, inner]))
    return turns[::2], turns[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z: the sum of its letters' numbers times powers, mixed."""
    if not _tables:
        _tables.extend((powers(_BASE, SEGMENT + LONG_WORD), powers(_BACK, SEGMENT + LONG_WORD)))
    up, down = _tables
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(starts, base + SEGMENT)))
        stop = min(int(ends[hi - 1]), base + SEGMENT + LONG_WORD)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_LETTER[data[base:stop]] * up[: stop - base], dtype=np.uint64, out=sums[1:])
        s = starts[lo:hi] - base
        e = np.minimum(ends[lo:hi] - base, stop - base)
        out[lo:hi] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        lo = hi
    out = mixed(out)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        from xxhash import xxh3_64_intdigest

        out[long] = [xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes().lower()) for k in long.tolist()]
    return out


def column_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a string column, and where each row's begin and the last one's end."""
    data, rows = text_bytes(column)
    starts, ends = word_spans(data, rows)
    return span_hashes(data, starts, ends), np.searchsorted(starts, rows)


def text_hashes(text: str | bytes | None) -> np.ndarray:
    """The hashes of a text's words."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    data = np.frombuffer(raw, np.uint8)
    return span_hashes(data, *word_spans(data, np.array([0, len(data)])))


def row_groups(column: pa.Array, most: int):
    """Slices (start, rows) of a string column of about so many bytes, a row at least."""
    _, rows = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + most, "right")) - 1)
        yield lo, min(hi, len(column)) - lo
        lo = hi


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of k words; with fewer words, one for the whole; none without words."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        out = mixed(out * _A + h[j : n - k + 1 + j])
    return out


def components(edges: DataFrame, tag: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for undirected edges (a, b): the smallest node reachable.

    Alternating large-star and small-star steps; every step is two shuffles of the edges, written to
    the shared folder, and no node's neighbours are ever gathered: both steps need only their minimum.
    A hub's rows meet in a partial minimum first and in a join that AQE can split.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tag)
    last = None
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        e = written(
            small.select(F.col("m").alias("a"), "b").unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
            tag,
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))


class Places:
    """A line's place in the corpus as one column: a number where ids allow it, a struct otherwise. Both compare alike."""

    def __init__(self, docs: DataFrame) -> None:
        lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        self.bits = 32 if lo is None or (lo >= 0 and hi < 1 << 31) else None  # a text has fewer than 2^31 lines
        self.type = "long" if self.bits else "struct<doc_id: long, line_no: int>"

    def id(self, doc_id: str = "doc_id", line_no: str = "line_no") -> Column:
        return F.expr(f"shiftleft({doc_id}, {self.bits}) + {line_no}" if self.bits else f"struct({doc_id} as doc_id, {line_no} as line_no)")

    def doc_id(self, c: str) -> Column:
        return F.expr(f"shiftright({c}, {self.bits})" if self.bits else f"{c}.doc_id")

    def line_no(self, c: str) -> Column:
        return F.expr(f"cast({c} & {(1 << 32) - 1} as int)" if self.bits else f"{c}.line_no")


_LOW = f"translate(coalesce({{}}, ''), '{UPPER}', '{UPPER.lower()}')"


def sql_words(text: str) -> str:
    """The same words in DuckDB's SQL."""
    return f"list_filter(regexp_split_to_array({_LOW.format(text)}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
