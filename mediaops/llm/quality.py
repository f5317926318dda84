"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is w . x for features x of its text. Every labelled pair of a
good and a bad document is a match the good one should win: w minimises the
logistic loss on feature differences. The threshold is the score quantile that
leaves out the labelled share of bad documents; scores are shifted so that it
lies at 0.7.

A pair's loss depends on its two strengths only, by a smooth function. As a
polynomial of either strength (Chebyshev, exact to ten digits or so) it falls apart
into sums over the good and sums over the bad documents, so a pass over the labelled
rows gives the loss's slope over all pairs, and a second one its curvature.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut

CUT = 0.7
#: Matches drawn for each bad document by a model of rows in memory; ``fit`` takes all pairs.
PAIRS_PER_BAD = 12
SEED = 42
L2, ROUNDS = 1e-3, 60
#: A Newton step is shortened if it might move a strength by more.
FURTHEST = 30.0

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "space": b" \t", "line": b"\n",
    "stop": b".?", "shout": b"!", "comma": b",;:", "quote": b"\"'()", "pipe": b"|", "sign": b"#$%&*+/<=>@[\\]^_`{}~-",
    "high": bytes(range(128, 256)), "control": bytes([*range(9), *range(11, 32), 127]),
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _j, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[list(_bytes), _j] = 1
FEATURES = [
    *_CLASSES, *(f"root_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_len", "long_word", "unique", "log_unique", "top_word",
    "repeat", "root_repeat", "pair_unique", "line_len", "line_unique", "shout_words", "title_words", "entropy", "upper_of_letters",
]


def features(text: bytes) -> np.ndarray:
    """Numbers that describe a whole text; zeros for an empty one."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(len(text), 1)
    shares = counts @ _MEMBER / n
    words = text.split()
    n_words = max(len(words), 1)
    tally = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = sum(map(eq, words, words[1:])) / n_words
    p = counts[counts > 0] / n
    letters = shares[0] + shares[1]
    rest = [
        np.log1p(len(text)), np.log1p(len(words)), min(len(text) / n_words, 60) / 10, min(max(map(len, tally), default=0), 200) / 50,
        len(tally) / n_words, np.log1p(len(tally)), max(tally.values(), default=0) / n_words, repeats, repeats**0.5,
        len(set(zip(words, words[1:], strict=False))) / n_words, np.log1p(len(text) / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1),
        sum(c for w, c in tally.items() if len(w) > 1 and w.isupper()) / n_words, sum(c for w, c in tally.items() if w[:1].isupper()) / n_words,
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0, shares[0] / letters if letters else 0.0,
    ]
    return np.concatenate([shares, np.sqrt(shares), rest])


def _feature_rows(texts: pa.ChunkedArray) -> np.ndarray:
    rows = [features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.large_binary())]
    return np.array(rows).reshape(len(rows), len(FEATURES))


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id, y: labels outside the held-out fold, one a document."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    return known.groupBy("doc_id").agg(F.max("quality").alias("y"))


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """y, x of every labelled document outside the held-out fold. Features, not texts, meet the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _feature_rows(b.column("text"))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))})

    known = learnable(labels).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"))
    rows = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")
    # one row of an identifier, however often it repeats
    return found.join(known.hint("merge"), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("y", "x")


class BradleyTerry:
    """w, centre and scale of the features, and the strength at the threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs_per_bad: int = PAIRS_PER_BAD, l2: float = L2, rounds: int = 30):
        self.centre, self.scale = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
        self.w, self.threshold = np.zeros(len(FEATURES)), 0.0
        good, bad = x[y == 1], x[y == 0]
        if not len(good) or not len(bad):
            return
        self.centre, spread = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        good, bad = (good - self.centre) / self.scale, (bad - self.centre) / self.scale
        rng = np.random.default_rng(SEED)
        n = len(bad) * pairs_per_bad
        d = good[rng.integers(len(good), size=n)] - np.repeat(bad, pairs_per_bad, axis=0)
        for _ in range(rounds):  # Newton steps on the logistic loss of differences
            p = 1 / (1 + np.exp(-np.clip(d @ self.w, -30, 30)))
            grad = d.T @ (p - 1) / n + l2 * self.w
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + l2 * np.eye(len(self.w)), grad)
            self.w = self.w - step
            if np.abs(step).max() < 1e-6:
                break

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -20, 20)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return (self.standard(x) * self.w).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.clip(self.strength(x) - self.threshold + np.log(CUT / (1 - CUT)), -700, 700)
        return 1 / (1 + np.exp(-at))


def _arrays(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """x, y of a batch, some rows at a time."""
    x, y = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)), b.column("y").to_numpy()
    for at in range(0, len(y), 1024):
        yield x[at : at + 1024], y[at : at + 1024]


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Of what ``part`` gives for some rows' x, y: the largest number and the sum of the arrays. A task hands on one of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, total = 0.0, None
        for b in batches:
            for x, y in _arrays(b):
                high, more = part(x, y)
                most, total = max(most, high), more if total is None else total + more
        if total is not None:
            yield pa.record_batch({"most": pa.array([most]), "shape": pa.array([list(total.shape)], pa.list_(pa.int32())), "total": pa.array([total.tobytes()], pa.binary())})

    got = rows.mapInArrow(run, "most double, shape array<int>, total binary").collect()
    return max(r.most for r in got), sum(np.frombuffer(r.total).reshape(r.shape) for r in got)


def _coefficients(of: Callable[[np.ndarray], np.ndarray], reach: float, degree: int) -> np.ndarray:
    """c with of(a - b) = sum of c[i, j] T_i(a / reach) T_j(b / reach) for a and b up to ``reach``."""
    n = degree + 1
    u = np.cos(np.pi * (np.arange(n) + 0.5) / n)
    c = of(reach * (u[:, None] - u[None, :]))
    turn = np.exp(-0.5j * np.pi * np.arange(n) / n) / n
    for _ in range(2):  # cosine transform along either side
        c = (np.fft.rfft(np.concatenate([c, c[::-1]]), axis=0)[:n] * turn[:, None]).real
        c[0] /= 2
        c = c.T
    return c


def _lost(v: np.ndarray) -> np.ndarray:
    """Probability that the good document loses, for a lead of v."""
    return 1 / (1 + np.exp(np.clip(v, -700, 700)))


def _fit_pairs(rows: DataFrame, model: BradleyTerry, n_pairs: int) -> None:
    """Newton steps of model.w on the logistic loss over all pairs of a good and a bad row of y, x."""
    standard = model.standard
    longest, _ = _summed(rows, lambda x, y: (float(np.sqrt((standard(x) ** 2).sum(axis=1)).max()), np.zeros(1)))
    w, most, reach = model.w, 0.0, 1.0
    for _ in range(ROUNDS):
        degree = int(8 * reach) + 16

        def basis(z: np.ndarray, w: np.ndarray = w, reach: float = reach, degree: int = degree) -> tuple[np.ndarray, np.ndarray]:
            s = z @ w
            return s, chebvander(np.clip(s / reach, -1, 1), degree)

        def moments(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
            z = standard(x)
            s, t = basis(z)
            z = np.hstack([np.ones((len(z), 1)), z])
            return float(np.abs(s).max()), np.stack([t[y == c].T @ z[y == c] for c in (0, 1)])

        most, (bad, good) = _summed(rows, moments)
        slope = _coefficients(_lost, reach, degree)
        bend = _coefficients(lambda v: _lost(v) * _lost(-v), reach, degree)
        grad = (bad[:, 1:].T @ (slope.T @ good[:, 0]) - good[:, 1:].T @ (slope @ bad[:, 0])) / n_pairs + L2 * w
        cross = good[:, 1:].T @ bend @ bad[:, 1:] / n_pairs
        weights = np.stack([bend.T @ good[:, 0], bend @ bad[:, 0]], axis=1) / n_pairs

        def curvature(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
            z = standard(x)
            weight = (basis(z)[1] @ weights)[np.arange(len(y)), y]
            return 0.0, (z * weight[:, None]).T @ z

        step = np.linalg.solve(_summed(rows, curvature)[1] - cross - cross.T + L2 * np.eye(len(w)), grad)
        far = longest * float(np.sqrt((step**2).sum()))
        step = step * min(1.0, FURTHEST / max(far, 1e-300))
        w, reach = w - step, max(1.0, (most + min(far, FURTHEST)) * (1 + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    model.w = np.round(w, 6)  # the order of adding shows in later digits


def _placed(values: DataFrame, place: int) -> float:
    """The value at a place, from 1, of the ordered column s: of the bucket that it lies in, buckets are made again."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high:
        bucket = F.floor((F.col("s") - low) / (high - low) * 1000)
        parts = values.filter(F.col("s").between(low, high)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
        for part in sorted(parts.collect(), key=lambda r: r.bucket):
            if place <= part.n:
                break
            place -= part.n
        low, high = part.low, part.high
    return low


def fit(docs: DataFrame, labels: DataFrame) -> BradleyTerry:
    """Learn from every labelled row outside the held-out fold, and from all pairs of a good and a bad one; only sums reach the driver."""
    rows = cut(labelled_features(docs, labels))
    model = BradleyTerry(np.empty((0, len(FEATURES))), np.empty(0))
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return model
    of_feature = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread")).orderBy("i").collect()
    model.centre = np.array([float(f"{r.mean:.6g}") for r in of_feature])
    model.scale = np.array([float(f"{r.spread:.6g}") if r.spread > 1e-9 else 1.0 for r in of_feature])
    _fit_pairs(rows, model, n[0] * n[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, _ in _arrays(b):
                yield pa.record_batch({"s": pa.array(model.strength(x))})

    strengths = cut(rows.mapInArrow(run, "s double"))
    model.threshold = (_placed(strengths, n[0]) + _placed(strengths, n[0] + 1)) / 2
    return model


def with_score(docs: DataFrame, model: BradleyTerry, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score for each row, in one pass over them; only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = pa.array(model.score(_feature_rows(b.column(text_col))), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, score], names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def score_documents(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    return with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model).select("doc_id", "score")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    held_out: crc32 of the identifier as text leaves 2 modulo 4; such labels are
    never learned from. A null text scores as an empty one. A null identifier is
    not held out. Every labelled document outside the fold is learned from; of rows of
    one identifier, that with the smallest features. Labels that are null or other than 0 and 1 are ignored; where a
    document has several, the largest counts. With labels of one class only, or
    none, every score is 0.7. Repeated rows score alike; an empty table gives no
    rows; further columns are ignored. Whole texts are looked at, however long: a task holds one with its words."""
    scored = score_documents(docs, fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
