"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

A window is as many words of a document as an item has. A document is contaminated by an item if such a
window's weighted shingle similarity with it (five words a shingle, weighted by how often it occurs:
sum of minima over sum of maxima) is 0.8 or more.

1. A window that similar shares a shingle with its item, so only windows on which a document's shingle
   falls in with an item's are built; which item that was is forgotten. Only (document, place, gram) meets the items;
   the windows that this leaves, each once, then fetch their words from the documents.
2. Windows and items get 128-bit SimHashes of their words. Forty-two blocks of three or four bits are joined by
   (size, block): of two fingerprints within 41 bits, one block at least is equal, so none within the radius is missed.
3. Pairs within the radius are verified on their shingles.

The fingerprints are of words, not of shingles: a changed word changes one word in n, but five shingles. At a
similarity of 0.8 a ninth of the words at most is in one text only; two such texts differ in 19 of 128 bits on average, with
a standard deviation of 4, so that the radius is five deviations away and loses about one such window in a million.

The benchmark's shingles, sizes and blocks are broadcast if it has at most ``BROADCAST`` words, and joined
by shuffles otherwise; likewise the windows' places, if at most ``PLACES`` documents have any. A document is never gathered; a
passage that a third of all documents share makes one window in each of them.

Defined cases: null, empty and wordless texts and items match nothing; items with fewer than five words
are one shingle; at a document's ends the window is moved inside, and a document shorter than an item
is its own window; repeated documents and items match alike and give one row for each pair of ids; different items under one id, or none, are
looked at each by itself, and the most similar counts for the id; different texts under one doc_id, or none, are looked at and dropped each by
itself; texts and items may have any length; empty tables give no rows; ``decontaminate`` keeps other columns untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
SIMILARITY = 0.8
BLOCKS = 42
RADIUS = BLOCKS - 1
#: Words of a benchmark that may be broadcast: its shingles are at most as many rows of 20 bytes.
BROADCAST = 2_000_000
#: Documents with windows, and blocks of items, that may be broadcast, of some 50 bytes each.
PLACES = 1 << 20


def _grams(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, m (how many words), place and gram, a hash, of each run of k words. No lambda, so that all is compiled into one stage with what follows."""
    at = rows.select(*keys, "words", F.posexplode("words").alias("place", "word")).where(F.col("place") <= F.size("words") - k)
    return at.select(*keys, F.size("words").alias("m"), "place", F.xxhash64(*(F.get("words", F.col("place") + j) for j in range(k))).alias("gram"))


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fp1 and fp2: the SimHash of the words of each row, a bit where more than half of the words' hashes have it."""

    def half(seed: int) -> Column:
        hashes = f"transform(words, w -> xxhash64({seed}, w))"
        common_bit = "2 * size(filter(h, x -> shiftrightunsigned(x, b) & 1L = 1L)) > size(h)"
        # the array of one array is how SQL names a value
        return F.expr(f"transform(array({hashes}), h -> aggregate(sequence(0, 63), 0L, (fp, b) -> fp | if({common_bit}, shiftleft(1L, b), 0L)))[0]")

    return rows.select(*keys, half(0).alias("fp1"), half(1).alias("fp2"))


def _blocks(rows: DataFrame) -> DataFrame:
    own = BLOCKS // 2  # of each half
    lo, hi = f"64 * (b % {own}) div {own}", f"64 * (b % {own} + 1) div {own}"
    value = f"shiftrightunsigned(if(b < {own}, fp1, fp2), int({lo})) & (shiftleft(1L, int({hi}) - int({lo})) - 1L)"
    each = F.expr(f"transform(sequence(0, {BLOCKS - 1}), b -> struct(b as block, {value} as value))")
    return rows.withColumn("b", F.explode(each)).select("*", "b.block", "b.value").drop("b")


def _shingles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, shingle, times and total: how often each shingle occurs, of how many."""
    k = F.least(F.lit(WORDS), F.size("words"))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))
    return rows.select(*keys, (F.size("words") - k + 1).alias("total"), F.explode(runs).alias("shingle")).groupBy(*keys, "total", "shingle").agg(F.count("*").alias("times"))


def windows(docs: DataFrame, items: DataFrame, small: bool, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, start, n, words): the item-sized windows on which a shingle of an item falls in with one of the document."""
    hint = F.broadcast if small else (lambda df: df)
    sizes = [r["k"] for r in items.select(F.least(F.lit(WORDS), "n").alias("k")).distinct().collect()]  # at most WORDS numbers
    own = docs.select("doc_id", common.words_of("text").alias("words"))
    found = own.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("n")).where("false")
    for k in sorted(sizes):
        of_items = _grams(items.where(F.least(F.lit(WORDS), F.col("n")) == k), ["n"], k).select("n", F.col("place").alias("at"), "gram").distinct()
        hits = _grams(own, ["doc_id"], k).join(hint(of_items), "gram")
        # a window of fewer shingles than that share of the item's is not as similar; only one as long as its document is shorter than n
        hits = hits.where((F.least("m", "n") - k + 1) >= similarity * (F.col("n") - k + 1))
        start = F.greatest(F.lit(0), F.least(F.col("place") - F.col("at"), F.col("m") - F.col("n")))
        found = found.union(hits.select("doc_id", start.alias("start"), "n"))
    places = common.written(found.distinct().groupBy(F.col("doc_id").alias("own")).agg(F.collect_list(F.struct("start", "n")).alias("at")), "places")  # a document's own
    hint = F.broadcast if places.count() <= PLACES else (lambda df: df)
    with_words = own.join(hint(places), F.col("doc_id") == F.col("own")).dropDuplicates(["doc_id"]).select("doc_id", "words", F.explode("at").alias("p"))
    return with_words.select("doc_id", "p.start", "p.n", F.slice("words", F.col("p.start") + 1, F.col("p.n")).alias("words"))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the most similar window of each pair, the first of equals."""
    rows, names = common.keyed(docs)
    found = common.ids_again(_matches(rows, benchmark, similarity), names, "doc_id")
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("start", "n", "similarity"), F.struct("similarity", -F.col("start"))).alias("m"))
    null_again = lambda c: F.when(F.col(c) != common.FIRST, F.col(c)).alias(c)
    return best.select(null_again("doc_id"), null_again("item_id"), F.col("m.start").cast("long").alias("start"), F.col("m.n").cast("long").alias("n_words"), F.col("m.similarity").alias("similarity"))


def _matches(rows: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, n, similarity): the matching windows of keyed documents, with their numbers as doc_id."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(common.FIRST)).alias("item_id"), common.words_of("text").alias("words")).where(F.size("words") > 0)
    items = common.written(items.distinct().withColumn("n", F.size("words")).withColumn("item", F.monotonically_increasing_id()), "items")
    n_items, n_words = items.agg(F.count("*"), F.sum("n")).first()
    small = (n_words or 0) <= BROADCAST
    hint = F.broadcast if small else (lambda df: df)
    found = common.written(windows(rows.select(F.col("__own").alias("doc_id"), "text"), items, small, similarity), "windows")
    keys = ["doc_id", "start", "n"]
    left = _blocks(_fingerprints(found, keys))
    right = _blocks(_fingerprints(items, ["item", "n"])).withColumnsRenamed({"fp1": "item_fp1", "fp2": "item_fp2"})
    far = F.bit_count(F.col("fp1").bitwiseXOR(F.col("item_fp1"))) + F.bit_count(F.col("fp2").bitwiseXOR(F.col("item_fp2")))
    near = left.join(F.broadcast(right) if n_items * BLOCKS <= PLACES else right, ["n", "block", "value"]).where(far <= RADIUS)
    pairs = near.select(*keys, "item").distinct()
    of_windows = _shingles(found, keys).withColumnRenamed("times", "w_times").withColumnRenamed("total", "w_total")
    shared = pairs.join(of_windows, keys).join(hint(_shingles(items, ["item"])), ["item", "shingle"])
    least = shared.groupBy(*keys, "item", "w_total", "total").agg(F.sum(F.least("w_times", "times")).alias("least"))
    close = least.withColumn("similarity", F.col("least") / (F.col("w_total") + F.col("total") - F.col("least"))).where(F.col("similarity") >= similarity)
    return close.join(hint(items.select("item", "item_id")), "item").select("doc_id", "item_id", "start", "n", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that no item contaminates."""
    rows, _ = common.keyed(docs)
    gone = _matches(rows, benchmark).select(F.col("doc_id").alias("__gone")).distinct()
    return rows.join(gone, F.col("__own") == F.col("__gone"), "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: see matches."""
    return matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOW}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: The windows' definition without fingerprints: a window that shares no shingle with its item has similarity 0.
ORACLE = f"""
with w as (select distinct doc_id, {_WORDS} as words from documents),
i as (select item_id, {_WORDS} as words from benchmark),
it as (select item_id, words, len(words) as n, least({WORDS}, len(words)) as k from i where len(words) > 0),
ig as (select item_id, n, k, p, array_to_string(words[p:p + k - 1], ' ') as gram from (select *, unnest(range(1, n - k + 2)) as p from it)),
dg as (select doc_id, m, p, array_to_string(words[p:p + {WORDS - 1}], ' ') as gram from (select doc_id, words, len(words) as m, unnest(range(1, len(words) - {WORDS - 2})) as p from w)),
s as (select distinct doc_id, n, greatest(0, least(dg.p - ig.p, m - n)) as start from dg join ig using (gram)),
win as (select s.*, words[start + 1:start + n] as x from s join w using (doc_id)),
ws as (select doc_id, n, start, len(x) - {WORDS - 1} as total, array_to_string(x[q:q + {WORDS - 1}], ' ') as gram, count(*) as c from (select *, unnest(range(1, len(x) - {WORDS - 2})) as q from win) group by all),
sh as (select item_id, n, n - k + 1 as total, gram, count(*) as c from ig group by all),
m as (select doc_id, item_id, start, ws.n, sum(least(ws.c, sh.c)) as l, any_value(ws.total) as a, any_value(sh.total) as b from ws join sh on ws.gram = sh.gram and ws.n = sh.n group by 1, 2, 3, 4),
r as (select *, l / (a + b - l) as sim, row_number() over (partition by doc_id, item_id order by l / (a + b - l) desc, start) as rn from m where l / (a + b - l) >= {SIMILARITY})
select doc_id, item_id, start::bigint as start, n::bigint as n_words, sim::double as similarity from r where rn = 1
"""
