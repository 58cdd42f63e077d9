"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | history) = P(class | history) * P(part | class, history) * P(word | part). The classes are the commonest
words, one each, then bands of common words, each in parts of like mass, then all rarer and unknown words. The first
two factors are maximum-entropy models with hashed features of the history: the last word, the word before it
(a skip), and both together; for a part, each of these together with the band. P(word | part) is (c + 1) over the
part's counts, plus one for each of its words; the last class is one part, with one more for the unknown word.

1. Texts become rows of word hashes, written once. Words are counted over all training texts in DataFrame
   operations. N, V and all counts are exact.
2. The commonest words, at most ``COMMON`` of them whatever the corpus, are broadcast. The counts of all others
   stay a table that grows with the corpus.
3. The softmaxes are trained in rounds, each over texts of its own (``ROUNDS``), all texts once. Every task of a
   round starts from the shared weights and makes AdaGrad steps over its texts; its changes are averaged, by the
   words they come from, into the next round's weights. Scores differ a little by how texts lie in tasks.
4. Texts are scored in numpy batches. Rarer words leave as rows (row, word), are joined with the
   counts, and their sums come back to the row.

Words are known by 64-bit hashes.

Defined cases: a null or empty text is the end token alone; repeated rows are scored alike, and learned from
as often as they occur; a null doc_id is not held out; ties among the commonest words are broken by their hash; without
training texts N and V are 0 and every token has probability 1; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words whose counts are broadcast, 12 bytes each.
COMMON = 1 << 17
SINGLES = 23
CLASSES = 32
BANDS = CLASSES - 1 - SINGLES
PARTS = CLASSES  # of each band: both softmaxes have rows of one width
#: Hashed features of the last word, of the one before, and of both: for classes, and for parts.
BUCKETS = (2048, 2048, 4096)
PART_BUCKETS = (8192, 4096, 16384)
ROWS = sum(BUCKETS)
ALL_ROWS = ROWS + sum(PART_BUCKETS)
STEP = 8192
RATE = 0.05
#: What a feature's sum of squares starts from: the larger, the less a feature that was seen seldom moves.
START = 1.0
#: Eighths of the texts, by hash, that each round of training reads.
ROUNDS = ((0, 1), (1, 2), (2, 4), (4, 8))
CHUNK = 1024


def tokens(text: str = "text") -> Column:
    """Hashes of a text's words, and of the empty word, its end."""
    return F.transform(F.concat(common.words_of(text), F.array(F.lit(""))), lambda w: F.xxhash64(w))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(common.crc_mod(doc_id, 7) == 2, F.lit(False))


@dataclass
class Vocabulary:
    """The commonest words by hash, and what is known of all."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    classes: np.ndarray
    parts: np.ndarray
    log_in_class: np.ndarray  # log10 P(word | class) by counts; the last entry, without log10(c + 1), for the rest
    priors: np.ndarray
    part_priors: np.ndarray  # of each band
    n: int
    v: int

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, n: int, v: int) -> Vocabulary:
        by_count = np.lexsort((hashes, -counts))
        klass, part = np.full(len(hashes), CLASSES - 2, np.int32), np.zeros(len(hashes), np.int32)
        klass[by_count[:SINGLES]] = np.arange(min(SINGLES, len(hashes)))
        rest = by_count[SINGLES:]
        if len(rest):
            before = (np.cumsum(counts[rest]) - counts[rest]) / counts[rest].sum()  # a word lies where its mass begins
            place = np.minimum((before * BANDS * PARTS).astype(np.int32), BANDS * PARTS - 1)
            klass[rest], part[rest] = SINGLES + place // PARTS, place % PARTS
        sized = lambda at, n: (np.bincount(at, weights=counts, minlength=n), np.bincount(at, minlength=n).astype(np.float64))
        tokens_in, words_in = sized(klass, CLASSES)
        tokens_in[-1], words_in[-1] = n - counts.sum(), v - len(hashes) + 1
        log_total = np.log10(np.maximum(tokens_in + words_in, 1))
        prior = np.log((tokens_in + words_in) / (tokens_in + words_in).sum() + 1e-9)
        in_part = sum(sized(klass * PARTS + part, CLASSES * PARTS)).reshape(CLASSES, PARTS)[SINGLES:-1]
        part_prior = np.log(in_part / np.maximum(in_part.sum(1, keepdims=True), 1) + 1e-9)
        in_class = np.append(np.log10(counts + 1.0) - log_total[klass], -log_total[-1])
        return cls(hashes, counts, klass, part, in_class, prior.astype(np.float32), part_prior.astype(np.float32), n, v)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the words, len(hashes) for all others."""
        if not hasattr(self, "starts"):
            own = (self.hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(46)
            self.starts = np.searchsorted(own, np.arange((1 << 18) + 1, dtype=np.uint64)).astype(np.int32)
        out = np.full(len(h), len(self.hashes), np.int32)
        key = (h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(46)
        at, end = self.starts[key], self.starts[key + np.uint64(1)]
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.hashes[here] == h[left]
            out[left[hit]] = here[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def __getstate__(self) -> dict:
        return {k: x for k, x in self.__dict__.items() if k != "starts"}


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: (h, c) for each word. At most COMMON of them and 64 sums of powers of two come to the driver."""
    band = F.floor(F.log2("c")).cast("int")
    bands = sorted(((r["b"], r["words"], r["n"]) for r in counts.groupBy(band.alias("b")).agg(F.count("*").alias("words"), F.sum("c").alias("n")).collect()), reverse=True)
    held, least = 0, None
    for b, words, _ in bands:
        if held + words > COMMON:
            break
        held, least = held + words, b
    if least is None:
        got = counts.orderBy(F.desc("c"), "h").limit(COMMON).toPandas() if bands else None
    else:
        got = counts.where(F.col("c") >= 2**least).toPandas()
    h, c = (got["h"].to_numpy(np.int64), got["c"].to_numpy(np.float64)) if got is not None else (np.zeros(0, np.int64), np.zeros(0))
    order = np.argsort(h)
    return Vocabulary.of(h[order], c[order], sum(n for _, _, n in bands), sum(w for _, w, _ in bands))


def _history(h: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each token its history's features: the last word, the one before, and both. Before a text's start stands zero."""
    one = np.concatenate([np.zeros(1, np.int64), h[:-1]])
    two = np.concatenate([np.zeros(2, np.int64), h[:-2]])[: len(h)]
    one[starts] = 0
    two[starts] = 0
    second = starts + 1
    two[second[second < len(h)]] = 0
    one, two = common.mixed(one.view(np.uint64)), common.mixed(two.view(np.uint64) ^ np.uint64(0x5555))
    return [one, two, common.mixed(one * np.uint64(3) + two)]


def _rows(history: list[np.ndarray], buckets: tuple[int, ...], at: int) -> list[np.ndarray]:
    """The rows of weights of features; each kind has its own, the first begin at ``at``."""
    out = []
    for x, n in zip(history, buckets, strict=True):
        out.append((x % np.uint64(n)).astype(np.int32) + at)
        at += n
    return out


_BAND = common.mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def _part_rows(history: list[np.ndarray], band: np.ndarray) -> list[np.ndarray]:
    return _rows([x ^ _BAND[band] for x in history], PART_BUCKETS, ROWS)


_ONES = np.ones(CLASSES, np.float32)


def _logits(w: np.ndarray, prior: np.ndarray, feats: list[np.ndarray]) -> np.ndarray:
    z = w.take(feats[0], axis=0)
    z += prior
    for f in feats[1:]:
        z += w.take(f, axis=0)
    return np.clip(z, -80, 80, out=z)  # exp() of these, and sums of it, are single floats


def _class_logs(w: np.ndarray, prior: np.ndarray, feats: list[np.ndarray]) -> np.ndarray:
    z = _logits(w, prior, feats)
    return z - np.log(np.exp(z) @ _ONES)[:, None]


def _target_logs(w: np.ndarray, prior: np.ndarray, feats: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    z = _logits(w, prior, feats)
    own = z[np.arange(len(z)), target]
    return own - np.log(np.exp(z, out=z) @ _ONES)


def _step(w: np.ndarray, squares: np.ndarray, prior: np.ndarray, feats: list[np.ndarray], target: np.ndarray) -> None:
    """One AdaGrad step, with one sum of squares for each feature."""
    grad = _logits(w, prior, feats)
    np.exp(grad, out=grad)
    grad *= (-1 / (grad @ _ONES))[:, None]
    grad[np.arange(len(grad)), target] += 1
    for f in feats:
        order = np.argsort((f - f.min()).astype(np.uint16), kind="stable")  # a kind of feature has at most 65,536 rows
        own = f[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        rows = own[first]
        g = np.add.reduceat(grad.take(order, axis=0), first, axis=0)
        squares[rows] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        g *= (RATE / np.sqrt(squares[rows]))[:, None]
        w[rows] += g


def _flat(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of rows lo to hi, and where each row begins."""
    part = column.slice(lo, hi - lo)
    offsets = part.offsets.to_numpy()
    return part.flatten().to_numpy(zero_copy_only=False), (offsets[:-1] - offsets[0]).astype(np.int64)


def _groups(column: pa.Array, most: int = 200_000):
    """Runs of rows of about so many tokens."""
    offsets = column.offsets.to_numpy()
    lo = 0
    for k in range(1, len(column) + 1):
        if offsets[k] - offsets[lo] >= most or k == len(column):
            yield lo, k
            lo = k


def _round(texts: DataFrame, vocab, w: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round from shared weights, and the weights after it. vocab is a broadcast Vocabulary."""
    shared = texts.sparkSession.sparkContext.broadcast((w, squares))
    schema = "chunk int, seen double, change binary, squares binary"
    columns = ["chunk", "seen", "change", "squares"]

    def learn(batches):
        v, (w0, s0) = vocab.value, shared.value
        w, squares, seen = w0.copy(), s0.copy(), 0
        klass_of, part_of = np.append(v.classes, CLASSES - 1), np.append(v.parts, 0)
        for batch in batches:
            for lo, hi in _groups(batch.column("tokens")):
                h, starts = _flat(batch.column("tokens"), lo, hi)
                at = v.find(h)
                klass, part, history = klass_of[at], part_of[at], _history(h, starts)
                for a in range(0, len(h), STEP):
                    k, past = klass[a : a + STEP], [x[a : a + STEP] for x in history]
                    _step(w, squares, v.priors, _rows(past, BUCKETS, 0), k)
                    inner = np.flatnonzero((k >= SINGLES) & (k < CLASSES - 1))
                    if len(inner):
                        band = k[inner] - SINGLES
                        _step(w, squares, v.part_priors[band], _part_rows([x[inner] for x in past], band), part[a : a + STEP][inner])
                seen += len(h)
        if seen:  # changes travel as half floats
            for k in range(0, ALL_ROWS, CHUNK):
                c = slice(k, k + CHUNK)
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([float(seen)]), pa.array([(w[c] - w0[c]).astype(np.float16).tobytes()], pa.binary()), pa.array([squares[c].tobytes()], pa.binary())], names=columns)

    def mean(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for k, n, change, sq in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                own = total.setdefault(k, [0.0, 0.0, 0.0])
                own[0] += n
                own[1] = own[1] + n * np.frombuffer(change, np.float16).astype(np.float64)
                own[2] = own[2] + n * np.frombuffer(sq, np.float32).astype(np.float64)
        for k, (n, change, sq) in total.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([n]), pa.array([(change / n).astype(np.float32).tobytes()], pa.binary()), pa.array([(sq / n).astype(np.float32).tobytes()], pa.binary())], names=columns)

    w, squares = w.copy(), squares.copy()
    for r in texts.mapInArrow(learn, schema).repartition("chunk").mapInArrow(mean, schema).collect():
        c = slice(r["chunk"], r["chunk"] + CHUNK)
        w[c] += np.frombuffer(r["change"], np.float32).reshape(-1, CLASSES)
        squares[c] = np.frombuffer(r["squares"], np.float32)
    shared.unpersist()
    return w, squares


def train(texts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """texts: tokens. The weights: ALL_ROWS by CLASSES numbers, whatever the corpus."""
    shared = texts.sparkSession.sparkContext.broadcast(vocab)
    w, squares = np.zeros((ALL_ROWS, CLASSES), np.float32), np.full(ALL_ROWS, START, np.float32)
    eighth = F.pmod(F.xxhash64("tokens"), F.lit(8))
    for lo, hi in ROUNDS:
        w, squares = _round(texts.where((eighth >= lo) & (eighth < hi)).select("tokens"), shared, w, squares)
    return w


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    return _scored(_hashed(docs), counts, vocab, weights)


def _scored(rows: DataFrame, counts: DataFrame, vocab: Vocabulary, weights: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((vocab, weights))
    schema = "row long, doc_id long, n_tokens long, known long, base double, model double, rare array<long>"

    def run(batches):
        v, w = shared.value
        log_count = np.append(np.log10(v.counts + 1), 0.0)
        klass_of, part_of = np.append(v.classes, CLASSES - 1), np.append(v.parts, 0)
        for batch in batches:
            for lo, hi in _groups(batch.column("tokens")):
                h, starts = _flat(batch.column("tokens"), lo, hi)
                at = v.find(h)
                model = v.log_in_class[at]
                history = _history(h, starts)
                for a in range(0, len(h), STEP):
                    k, part, past = klass_of[at[a : a + STEP]], part_of[at[a : a + STEP]], [x[a : a + STEP] for x in history]
                    gain = _target_logs(w, v.priors, _rows(past, BUCKETS, 0), k)
                    inner = np.flatnonzero((k >= SINGLES) & (k < CLASSES - 1))
                    band, part = k[inner] - SINGLES, part[inner]
                    gain[inner] += _target_logs(w, v.part_priors[band], _part_rows([x[inner] for x in past], band), part) - v.part_priors[band, part]  # in place of the part's share by counts
                    model[a : a + STEP] += gain / np.log(10)
                rare = at == len(v.hashes)
                per_row = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                sizes = per_row(rare.astype(np.int64))
                yield pa.record_batch(
                    [
                        batch.column("row").slice(lo, hi - lo),
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.diff(np.append(starts, len(h)))),
                        pa.array(per_row((~rare).astype(np.int64))),
                        pa.array(per_row(log_count[at])),
                        pa.array(per_row(model)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(h[rare])),
                    ],
                    names=["row", "doc_id", "n_tokens", "known", "base", "model", "rare"],
                )

    part = common.written(rows.mapInArrow(run, schema), "lm-scores")  # from here on a row keeps its number
    rare = part.select("row", F.explode("rare").alias("h"))
    found = rare.join(counts, "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_log"))
    more, log = F.coalesce("more", F.lit(0)), F.coalesce("more_log", F.lit(0.0))
    total = float(np.log10(vocab.n + vocab.v + 1))
    return part.join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * total).alias("base_score"),
        (F.col("model") + log).alias("score"),
    )


def _hashed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, tokens), written once: counting, training and scoring read hashes, not texts. A row keeps its number."""
    return common.written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), tokens().alias("tokens")), "lm-tokens")


def _fitted(rows: DataFrame) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    counts = common.written(rows.select(F.explode("tokens").alias("h")).groupBy("h").agg(F.count("*").alias("c")), "word-counts")
    vocab = vocabulary(counts)
    return counts, vocab, train(rows.select("tokens"), vocab)


def fit(learned: DataFrame) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """learned: texts to learn from. The counts of all words, the commonest of them, and the weights."""
    return _fitted(_hashed(learned))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    rows = _hashed(common.documents(spark, sf_dir))
    out = _scored(rows, *_fitted(rows.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
