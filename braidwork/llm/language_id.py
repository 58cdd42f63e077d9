"""Language identification with interpolated Kneser-Ney character models.

One model per language, estimated from a bounded sample of labelled documents; all n-grams that any
language has seen stand in one sorted array of 64-bit hashes, with a row of log-probabilities, one for
each language. A text's language is the one of lowest cross-entropy per character.

Letters are lower-cased; each run of other characters counts as one space.

Defined cases: null, empty or letterless texts are ``und`` with score 0 and are rejected; ties go to
the language that sorts first; repeated rows give repeated results; extra columns are ignored, or kept
by ``filter_known``; without labelled rows every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 5
#: Labelled documents that each language's model learns from, about: the bound of the sample.
SAMPLE_PER_LANGUAGE = 1000
#: Characters that are worked on at once; longer texts are cut there, with ORDER - 1 characters again.
AT_ONCE = 400_000
#: A table is looked up by as many leading bits of a hash as its size has, up to this.
RADIX = 20
_SPACE = np.uint32(32)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _LOWER, _ALPHA
    try:
        return _LOWER, _ALPHA
    except NameError:
        n = 0x110000
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
        _LOWER = np.fromiter((ord(d) if len(d := chr(i).lower()) == 1 else i for i in range(n)), np.uint32, n)
        return _LOWER, _ALPHA


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, each run of anything else as one space, padded on the left."""
    lower, alpha = _tables()
    cps = lower[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    is_letter = alpha[cps]
    cps = np.where(is_letter, cps, _SPACE)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return np.concatenate([np.full(ORDER - 1, _SPACE), cps[keep]])


def gram_hashes(cps: np.ndarray, k: int) -> np.ndarray:
    """A hash for the k characters that end at each position from ORDER - 1 on."""
    m = len(cps) - ORDER + 1
    out = np.full(m, np.uint64(k), np.uint64)
    wide = cps.astype(np.uint64)
    for j in range(k):
        at = ORDER - k + j
        out = out * np.uint64(0x9E3779B97F4A7C15) + wide[at : at + m] + np.uint64(1)
        out ^= out >> np.uint64(29)
    return common.mixed(out)


@dataclass
class Table:
    """Rows of numbers by sorted hash; the upper bits of a hash say where to look."""

    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self) -> None:
        bits = min(RADIX, max(1, len(self.keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.starts).max()) if len(self.keys) else 0

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "values": self.values}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.__post_init__()

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        at = self.starts[h >> self.shift]
        for _ in range(self.most):
            ok = at < len(self.keys)
            hit = self.keys[np.where(ok, at, 0)] == h
            np.copyto(out, at, where=hit & ok)
            at = at + 1
        return out


@dataclass
class KneserNey:
    """One language's counts; probability() interpolates from the longest to the shortest history."""

    tables: list[Table]  # by order: discounted count of a gram, or continuations below ORDER
    histories: list[Table]  # by order: total and distinct successors of a history
    discounts: list[float]
    alphabet: int

    @classmethod
    def fit(cls, grams: np.ndarray, counts: np.ndarray, alphabet: int) -> KneserNey:
        """grams: rows of ORDER code points, each once."""
        tables, histories, discounts = [], [], []
        here, c = grams, counts.astype(np.float64)
        flat = lambda g: _hash_rows(g)
        for k in range(ORDER, 0, -1):
            h = flat(here)
            order = np.argsort(h, kind="stable")
            here, c, h = here[order], c[order], h[order]
            n1, n2 = float((c == 1).sum()), float((c == 2).sum())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            tables.append(Table(h, c))
            hist, idx = np.unique(flat(here[:, :-1]), return_inverse=True)
            total = np.bincount(idx, weights=c, minlength=len(hist))
            distinct = np.bincount(idx, minlength=len(hist)).astype(np.float64)
            histories.append(Table(hist, np.stack([total, distinct], 1)))
            discounts.append(d)
            if k > 1:  # continuations: how many characters come before each shorter gram
                tail = here[:, 1:]
                _, first, cont = np.unique(flat(tail), return_index=True, return_counts=True)
                here, c = tail[first], cont.astype(np.float64)
        return cls(tables[::-1], histories[::-1], discounts[::-1], alphabet)

    def probability(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), 1.0 / self.alphabet)
        for k in range(1, ORDER + 1):
            own = grams[:, ORDER - k :]
            t, hs, d = self.tables[k - 1], self.histories[k - 1], self.discounts[k - 1]
            row, hist = t.find(_hash_rows(own)), hs.find(_hash_rows(own[:, :-1]))
            c = np.where(row >= 0, t.values[row], 0.0) if len(t.keys) else np.zeros(len(p))
            total, distinct = (hs.values[hist, 0], hs.values[hist, 1]) if len(hs.keys) else (np.ones(len(p)), np.zeros(len(p)))
            seen = hist >= 0
            p = np.where(seen, (np.maximum(c - d, 0) + d * distinct * p) / np.where(seen, total, 1.0), p)
        return p


def _hash_rows(g: np.ndarray) -> np.ndarray:
    out = np.full(len(g), np.uint64(g.shape[1]), np.uint64)
    for j in range(g.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + g[:, j].astype(np.uint64) + np.uint64(1)
        out ^= out >> np.uint64(29)
    return common.mixed(out)


@dataclass
class Model:
    languages: list[str]
    models: list[KneserNey]
    joint: Table  # every gram that any language has seen: its log-probability in each
    temperature: float = 1.0
    limits: np.ndarray | None = None  # by language: cross-entropy from which a text is rejected

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character, by text and language; characters of each text."""
        total, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        parts: list[tuple[int, np.ndarray]] = []
        held = 0
        for i, text in enumerate(texts):
            cps = letters(text)
            for start in range(0, max(1, len(cps) - ORDER + 1), AT_ONCE):
                part = cps[start : start + AT_ONCE + ORDER - 1]
                if len(part) >= ORDER:
                    parts.append((i, part))
                    held += len(part)
                if held > AT_ONCE:
                    self._add(parts, total, size)
                    parts, held = [], 0
        self._add(parts, total, size)
        return -total / np.maximum(size, 1)[:, None], size

    def _add(self, parts: list[tuple[int, np.ndarray]], total: np.ndarray, size: np.ndarray) -> None:
        if not parts:
            return
        sizes = np.array([len(p) - ORDER + 1 for _, p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(p, ORDER) for _, p in parts])
        row = self.joint.find(_hash_rows(grams))
        logs = self.joint.values[np.maximum(row, 0)]
        if len(new := np.flatnonzero(row < 0)):
            logs[new] = np.stack([np.log(m.probability(grams[new])) for m in self.models], 1)
        of = np.array([i for i, _ in parts])
        np.add.at(total, of, np.add.reduceat(logs.astype(np.float64), starts, axis=0))
        np.add.at(size, of, sizes)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, size = self.entropies(texts)
        best = h.argmin(1)
        least = h[np.arange(len(h)), best]
        score = 1 / np.exp((least[:, None] - h) * self.temperature).sum(1)
        limits = self.limits if self.limits is not None else np.full(len(self.languages), np.inf)
        und = size == 0
        return [("und" if u else self.languages[b]) for u, b in zip(und, best, strict=True)], np.where(und, 0.0, score), und | (least > limits[best])


def _counted(batches):
    for batch in batches:
        found: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            cps = letters(text)
            if len(cps) >= ORDER:
                found.setdefault(lang, []).append(np.lib.stride_tricks.sliding_window_view(cps, ORDER))
        for lang, views in found.items():
            grams = np.concatenate(views)
            _, first, n = np.unique(_hash_rows(grams), return_index=True, return_counts=True)
            own = np.ascontiguousarray(grams[first], dtype="<u4")
            yield pa.record_batch({"lang": pa.array([lang] * len(first)), "gram": pa.array([x.tobytes() for x in own], pa.binary()), "n": pa.array(n, pa.int64())})


def _packed(batches):
    """Each language's grams and counts of a batch as two strings of bytes."""
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        grams = np.frombuffer(b"".join(batch.column("gram").to_pylist()), "<u4").reshape(-1, ORDER)
        n = batch.column("n").to_numpy(zero_copy_only=False).astype("<i8")
        names = sorted(set(lang))
        yield pa.record_batch({"lang": pa.array(names, pa.string()), "grams": pa.array([grams[lang == x].tobytes() for x in names], pa.binary()), "n": pa.array([n[lang == x].tobytes() for x in names], pa.binary())})


def fit(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """labelled: doc_id, text, lang. About ``sample`` documents of each language are learned from, chosen
    by a hash of their id; an eighth of them calibrates the score and the rejection."""
    rows = labelled.where("lang is not null").select("doc_id", "text", "lang")
    share = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(share), "lang").withColumn("place", place * F.col("rows")).where(F.col("place") < sample)
    chosen = chosen.withColumn("held", F.col("place") >= F.least("rows", F.lit(sample)) * 0.875).drop("rows", "place")
    chosen = common.written(chosen, "language-sample")
    fitted = chosen.where("not held")
    counted = fitted.select("lang", "text").mapInArrow(_counted, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in counted.mapInArrow(_packed, "lang string, grams binary, n binary").collect():  # in all as large as the sample's distinct grams
        found.setdefault(r["lang"], []).append((np.frombuffer(r["grams"], "<u4").reshape(-1, ORDER), np.frombuffer(r["n"], "<i8")))
    names = sorted(found)
    r = None
    if not names:
        return Model([], [], Table(np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)))
    own = {name: (np.concatenate([g for g, _ in found[name]]), np.concatenate([n for _, n in found[name]])) for name in names}
    found.clear()
    every = np.concatenate([own[name][0] for name in names])
    alphabet = len(np.unique(every)) + 1
    models = [KneserNey.fit(*own[name], alphabet) for name in names]
    own.clear()
    h, first = np.unique(_hash_rows(every), return_index=True)
    logs = np.stack([np.log(m.probability(every[first])) for m in models], 1).astype(np.float32)
    model = Model(names, models, Table(h, logs))
    held = chosen.where("held").select("lang", "text").toPandas()
    if len(held):
        e, size = model.entropies(list(held["text"]))
        truth = np.array([names.index(x) if x in names else -1 for x in held["lang"]])
        ok = (size > 0) & (truth >= 0)
        e, truth = e[ok], truth[ok]
        if len(e):
            true = e[np.arange(len(e)), truth]
            fits = [(-np.log(np.exp((true[:, None] - e) * t).sum(1)).mean(), -t) for t in (1, 2, 4, 8, 16, 32, 64)]
            model.temperature = float(-max(fits)[1])
            # far beyond what any held-back text of the language shows, and no better than a guess among all characters
            worst = np.array([true[truth == k].max(initial=0.0) for k in range(len(names))])
            model.limits = np.maximum(worst + np.array([3 * true[truth == k].std() if (truth == k).any() else np.inf for k in range(len(names))]), np.log(alphabet))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row; the model, bounded by its sample, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, score, rejected = shared.value.predict(batch.column("text").to_pylist())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def filter_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, of texts that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            _, _, rejected = shared.value.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


LEARNED = "crc32 of doc_id, mod 4, is not 2"


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is not learned from; a null id is."""
    return F.coalesce(common.crc_mod(doc_id, 4) == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: doc_id, held_out, lang_pred, score, rejected for every document."""
    docs = common.documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    out = predict(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
