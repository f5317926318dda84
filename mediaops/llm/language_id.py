"""Language identification of texts that may mix languages.

A document's words are drawn from a mixture of languages; a word's likelihood in
a language is the product of its character n-grams' (one to three letters, with the
word's edges). Expectation-maximisation finds the proportions of a set of
languages that make the document likeliest. The set starts as the single best
language and grows by the language that adds most log likelihood, as long
as that is over the penalty of one more proportion. The prediction is the language with the largest proportion.

Most documents need no iteration: the log likelihood is concave in the proportions, so at the
single best language its slopes bound what all other languages together can add.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About so many documents a language are learned from at most, chosen by hash.
MAX_DOCS = 2000
BUCKETS = 1 << 15  # of hashed n-grams, a language
LONGEST = 24  # letters of a word; longer runs are cut into words of that length
SLICE = 1 << 20  # characters looked at together
CACHE = 200_000  # words whose likelihoods a task keeps; it starts anew when they are full
PENALTY = 3.0  # times half the logarithm of the number of words, for each further language
UNDETERMINED = "und"
SEED = 42

_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Iterator[Counter]:
    """Lower-cased words (runs of letters, cut after 24) of a whole text with their counts, a slice at a time."""
    for at in range(0, len(text), SLICE):
        runs = Counter(_RUN.findall(text[at : at + SLICE].lower()))
        if runs and (max(map(len, runs)) > LONGEST or not "".join(runs).isalpha()):
            out: Counter = Counter()
            for run, n in runs.items():
                w = run if run.isalpha() else "".join(filter(str.isalpha, run))
                for i in range(0, len(w), LONGEST):
                    out[w[i : i + LONGEST]] += n
            runs = out
        if runs:
            yield runs


def hashed_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and where each word's begin (3 letters + 1 edge give n-grams of 1, 2 and 3)."""
    text = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = text != 32
    one, two, three = text[1:-1], text[:-1] * np.uint64(0x9E3779B1) + text[1:], (text[:-2] * np.uint64(0x9E3779B1) + text[1:-1]) * np.uint64(0x85EBCA6B) + text[2:]
    at = np.arange(1, len(text) - 1)
    keep = letter[at]
    rows = np.stack([one[keep] + np.uint64(7), two[1:][keep] + np.uint64(77), two[:-1][keep] + np.uint64(77), three[keep] + np.uint64(777)], axis=1).reshape(-1)
    mixed = rows * np.uint64(0x9E3779B97F4A7C15)
    buckets = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)
    begins = 4 * np.cumsum([0, *map(len, words)])[:-1]
    return buckets, begins


# ---- learning ---------------------------------------------------------------------


class Model:
    """Languages, and the log probability of each bucket in each."""

    def __init__(self, counts: dict[str, np.ndarray], smoothing: float = 0.5):
        self.languages = sorted(counts)
        self.log = np.stack([np.log((counts[k] + smoothing) / (counts[k].sum() + smoothing * BUCKETS)) for k in self.languages], axis=1).astype(np.float32) if counts else np.zeros((BUCKETS, 0), np.float32)

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word (row) in each language. An edge's n-grams are counted from both letters beside it, so each letter has four."""
        buckets, begins = hashed_grams(words)
        return np.add.reduceat(self.log[buckets], begins, axis=0, dtype=np.float64) / 2


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, most: int = MAX_DOCS) -> Model:
    """Learn from about ``most`` documents of each language outside the held-out fold; a model has 128 KB a language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and doc_id is not null and text is not null").filter(~is_held_out())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not sizes:
        return Model({})
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, most / n)) for k, n in sizes.items()], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_003)) / 1_000_003.0
    sample = known.join(F.broadcast(shares), "lang").filter(place < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                into = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for words in words_of(text.as_py()):
                    found, begins = hashed_grams(list(words))
                    lengths = np.diff(np.append(begins, len(found)))
                    into += np.bincount(found, weights=np.repeat(np.fromiter(words.values(), np.int64), lengths), minlength=BUCKETS).astype(np.int64)
        for lang, c in counts.items():
            met = np.flatnonzero(c)
            yield pa.record_batch({"lang": pa.array([lang] * len(met), pa.string()), "bucket": pa.array(met, pa.int64()), "n": pa.array(c[met])})

    out = {k: np.zeros(BUCKETS, np.int64) for k in sizes}
    for r in sample.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # at most BUCKETS rows a language
        out[r.lang][r.bucket] = r.n
    return Model(out)


# ---- inference ---------------------------------------------------------------------


def maximise(p: np.ndarray, n: np.ndarray, rounds: int = 60, close: float = 1e-3) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` (likelihoods a word) by expectation-maximisation, and their log likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        mix = np.maximum(p @ share, 1e-300)
        slope = (n / mix) @ p / total  # 1 where a proportion is positive at the optimum
        share = share * slope
        if slope.max() - 1 < close / total:
            break
    return share, float(n @ np.log(np.maximum(p @ share, 1e-300)))


def infer(log_p: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Languages of a document, their proportions, and each single language's log likelihood.

    log_p: log likelihood of each distinct word in each language; n: how often it occurs."""
    single = n @ log_p
    best = int(single.argmax())
    chosen, share = [best], np.ones(1)
    toll = penalty * 0.5 * np.log(n.sum() + 1)
    # no mixture beats this language by more than the steepest slope allows
    slope = n @ np.exp(np.minimum(log_p - log_p[:, [best]], 50.0))
    if slope.max() - n.sum() <= toll or log_p.shape[1] == 1:
        return chosen, share, single
    top = log_p.max(axis=1, keepdims=True)
    p, floor = np.exp(log_p - top), float(n @ top[:, 0])
    value = float(single[best])
    while len(chosen) < p.shape[1]:
        tried = [(*maximise(p[:, [*chosen, j]], n), j) for j in range(p.shape[1]) if j not in chosen]
        grown, reached, j = max(tried, key=lambda t: (t[1], -t[2]))
        if reached + floor - value <= toll:
            break
        chosen, share, value = [*chosen, j], grown, reached + floor
    return chosen, share, single


class Reader:
    """A model with the likelihoods of words met lately, as rows of one matrix."""

    def __init__(self, model: Model):
        self.model, self.places, self.matrix = model, {}, np.zeros((CACHE, len(model.languages)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language."""
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        out = self.matrix[at]
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            out[missing] = self.model.likelihoods(new)
            if len(new) + len(self.places) > CACHE:
                self.places = {}
            if len(new) <= CACHE:
                first = len(self.places)
                self.places.update(zip(new, range(first, first + len(new)), strict=True))
                self.matrix[first : first + len(new)] = out[missing]
        return out

    def predict(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """Language, score, and all languages with their proportions, largest first."""
        slices = [(self.rows(list(words)), np.fromiter(words.values(), np.float64)) for words in words_of(text or "")] if self.model.languages else []
        if not slices:
            return UNDETERMINED, 0.0, [], []
        log_p, n = (np.concatenate(x) for x in zip(*slices, strict=True))
        chosen, share, single = infer(log_p.astype(np.float64), n)
        order = sorted(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
        names, shares = [self.model.languages[chosen[i]] for i in order], [float(share[i]) for i in order]
        sure = 1 / np.exp(np.minimum(single - single.max(), 0)).sum() if len(chosen) == 1 else 1.0
        return names[0], float(min(1.0, shares[0] * sure)), names, shares


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, langs, shares of each row; only its text is looked at.

    ``langs`` and ``shares`` are the languages of the document and their proportions. A
    null text, or one without a letter, is ``und`` with score 0, as is every text if nothing
    could be learned. Whole texts are read, in slices of a million characters (a word may be cut there);
    of a long one, the likelihoods of each slice's distinct words are held. Repeated rows come
    out alike, an empty table gives no rows, further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in batches:
            rows = [reader.predict(t.as_py()) for t in b.column("text")]
            langs, score, all_, shares = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64()), "langs": pa.array(all_, pa.list_(pa.string())), "shares": pa.array(shares, pa.list_(pa.float64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def predict_languages(docs: DataFrame, most: int = MAX_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, langs, shares.

    Learned from the rows whose crc32 of the identifier as text does not leave 2 modulo 4 and whose
    language is not null; a null identifier is not held out, and not learned from. The rest as in ``identify``."""
    out = identify(docs, fit(docs, most))
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "langs", "shares")


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    return predict_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
