"""Toxicity by multiple-instance learning: sentences are scored, labels are of whole documents.

A sentence's probability is logistic in hashed features of its words (the word, and its first four and
five letters); a document's is the noisy-or of its sentences, 1 - product(1 - p). Only features whose
shares of toxic and of other documents differ far beyond chance are kept; their weights start at the
log of those shares' ratio and are fitted to document labels through the noisy-or, by AdaGrad with L1
shrinkage. Words without evidence weigh nothing, so a long clean text stays clean. The fitted sentence scores locate what offends.

The fit uses a bounded sample of labelled documents (``SAMPLE`` of each label, chosen by a hash of the
id); every whole text is scored.

Defined cases: a null or empty text, or one without letters, has no sentence and scores 0; repeated rows
score alike; labels of 0 and 1 count, others (null too) are left out; a document with both labels counts
as toxic; without labels every text scores 0; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each label that the fit uses, about: the bound of the sample.
SAMPLE = {1: 1500, 0: 3000}
#: Features are hashes of 63 bits.
MASK = (1 << 63) - 1
EPOCHS = 10
RATE = 0.3
DAMP = 1.0
START = -5.0
SHRINK = 2e-4
#: Features of fewer documents in the sample weigh nothing, nor do those that tell nothing.
SEEN_IN = 3
#: So many standard errors apart must a feature's shares of toxic and other documents be.
TELLING = 6.0
THRESHOLD = 0.7
OFFENDING = 0.5

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> tuple[int, ...]:
    import xxhash

    keys = {"w" + word, "4" + word[:4], "5" + word[:5]}
    return tuple(xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) & MASK for k in sorted(keys))


class _Known(dict):
    """Something of each word, remembered for a bounded number of words."""

    def __init__(self, f, limit: int = 300_000) -> None:
        self.f, self.limit = f, limit

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        self[word] = out = self.f(word)
        return out


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each sentence that has words."""
    text = text or ""
    return [(m.start(), m.end(), words) for m in SENTENCE.finditer(text) if (words := WORD.findall(m[0].lower()))]


@dataclass
class Model:
    weights: dict[int, float]  # by feature; the rest weigh nothing
    bias: float

    def prepared(self) -> Model:
        if not hasattr(self, "known"):
            w = self.weights
            self.known = _Known(lambda word: sum(w.get(i, 0.0) for i in features(word)))
        return self

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias}

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability; (start, end, probability) of its offending sentences."""
        weight = self.prepared().known.__getitem__
        found = sentences(text)
        if not found:
            return 0.0, []
        z = self.bias + np.fromiter((sum(map(weight, words)) for _, _, words in found), np.float64, len(found))
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        bad = np.flatnonzero(p >= OFFENDING)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), [(found[k][0], found[k][1], float(p[k])) for k in bad]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """docs: (features of all sentences one after the other, where each sentence begins)."""
    own = [np.unique(f) for f, _ in docs]
    names, at = np.unique(np.concatenate(own), return_inverse=True)
    toxic = np.repeat(labels == 1, [len(f) for f in own])
    found = np.stack([np.bincount(at[~toxic], minlength=len(names)), np.bincount(at[toxic], minlength=len(names))]).astype(np.float64)
    of = np.bincount(labels, minlength=2).astype(np.float64)
    share = (found + 0.5) / (of[:, None] + 1)
    both = found.sum(0) / max(1, of.sum())
    error = np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / max(1, of[0]) + 1 / max(1, of[1])))
    telling = (np.abs(share[1] - share[0]) > TELLING * error) & (found.sum(0) >= SEEN_IN)
    names, w = names[telling], np.log(share[1] / share[0])[telling]
    if not len(names):
        return Model({}, -60.0)
    # from here on a document is its telling features, the sentence of each, and its number of sentences
    small: list[tuple[np.ndarray, np.ndarray, int]] = []
    for feats, starts in docs:
        k = np.minimum(np.searchsorted(names, feats), len(names) - 1)
        ok = names[k] == feats
        sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(feats))))
        small.append((k[ok], sentence[ok], len(starts)))
    g2, bias, bias2 = np.zeros(len(names)), START, 1.0
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), 32):
            batch, y = [small[i] for i in order[lo : lo + 32]], labels[order[lo : lo + 32]]
            counts = np.array([n for _, _, n in batch])
            heads = _starts(counts)
            feats = np.concatenate([f for f, _, _ in batch])
            sentence = np.concatenate([s + h for (_, s, _), h in zip(batch, heads, strict=True)])
            z = np.clip(np.bincount(sentence, weights=w[feats], minlength=counts.sum()) + bias, -30, 30)
            p = np.minimum(1 / (1 + np.exp(-z)), 1 - 1e-9)
            miss = np.exp(np.add.reduceat(np.log1p(-p), heads))  # no sentence offends
            push = np.where(y == 1, miss / np.maximum(1 - miss, 1e-6), -1.0)
            grad = np.repeat(push, counts) * p
            total = np.bincount(feats, weights=grad[sentence], minlength=len(names))
            at = np.flatnonzero(total)
            g2[at] += total[at] ** 2
            step = RATE / np.sqrt(DAMP + g2[at])
            new = w[at] + step * total[at]
            w[at] = np.sign(new) * np.maximum(np.abs(new) - step * SHRINK * len(batch), 0)
            gb = grad.sum()
            bias2 += gb**2
            bias += RATE * gb / np.sqrt(bias2)
    return Model({int(n): float(x) for n, x in zip(names, w, strict=True) if x}, float(bias))


def _sampled(batches):
    known = _Known(features)
    for batch in batches:
        feats, starts, toxic = [], [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            f, s = [], []
            for _, _, words in sentences(text):
                s.append(len(f))
                for word in words:
                    f.extend(known[word])
            if s:
                feats.append(np.array(f, np.int64).tobytes())
                starts.append(np.array(s, np.int32).tobytes())
                toxic.append(label)
        yield pa.record_batch({"feats": pa.array(feats, pa.binary()), "starts": pa.array(starts, pa.binary()), "toxic": pa.array(toxic, pa.int32())})


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Both are expected without what is held out."""
    sample = sample or SAMPLE
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, sample[1] / max(1, n.get(1, 0)))).otherwise(min(1.0, sample[0] / max(1, n.get(0, 0))))
    chosen = marked.where(place < share)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most the sample's ids
    got = rows.select("text", "toxic").mapInArrow(_sampled, "feats binary, starts binary, toxic int").collect()
    if not got:
        return Model({}, -60.0)
    return train([(np.frombuffer(r["feats"], np.int64), np.frombuffer(r["starts"], np.int32)) for r in got], np.array([r["toxic"] for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the offending sentences with their place in the text, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spot = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        m = shared.value
        for batch in batches:
            got = [m.score(x.as_py()) for x in batch.column("text")]
            spots = [[{"start": a, "end": b, "score": p} for a, b, p in bad] for _, bad in got]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array([g[0] for g in got], pa.float64()), "offending": pa.array(spots, pa.list_(spot))})

    schema = "doc_id long, score double, offending array<struct<start: long, end: long, score: double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is not learned from; a null id is."""
    return F.coalesce(common.crc_mod(doc_id, 3) == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: doc_id, held_out, score, predicted and the number of offending sentences."""
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
