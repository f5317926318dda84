"""Importance resampling towards a target distribution, by hashed word n-grams.

A bucket's gain is the log ratio of its smoothed shares in the target and in the
corpus; a document's weight is the sum of its features' gains, and documents are drawn without
replacement by Gumbel noise on top of it.

Features are never cut out of the text as strings. A dictionary of distinct words, each bounded
by delimiters, is an Aho-Corasick automaton; one scan over the bytes of many documents emits
each word's payload, its CRC and its length. As a CRC is linear, the CRC of words joined by spaces
follows from the payloads of its words: advance the first by the length of what comes next,
then xor. A dictionary holds the commonest words of what its worker has scanned, a
bounded number; words that it lacks get their payload from their bytes, so results
never depend on it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
DICTIONARY = 16_384  # words of a worker's dictionary
WORD_BYTES = 64  # longer words are not put into it
PIECE = 1 << 22  # bytes scanned at once; a longer document comes in slices
QUANTILE_SLACK, ACCURACY = 0.001, 10_000  # the quantile that is asked for lies ten rank errors below the wanted one

#: Lower case for A-Z, a space for every other delimiter: words are digits, a-z and all bytes from 0x80.
LOWER = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


# ---- CRC arithmetic ---------------------------------------------------------


def _tables(most: int) -> tuple[np.ndarray, np.ndarray]:
    """What 0 to ``most`` zero bytes, and 2^0 to 2^31, do to each byte of a CRC: arrays (n, 4, 256)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    each = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    small = [np.stack(each)]
    for _ in range(most):
        small.append((small[-1] >> np.uint32(8)) ^ step[small[-1] & np.uint32(255)])
    powers = [small[1]]
    for _ in range(31):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(small), np.stack(powers)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


_SMALL, _POWERS = _tables(WORD_BYTES + 1)
_FLAT = _SMALL.reshape(-1)


def advanced(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC after n more zero bytes, without the conditioning that cancels out: crc(a + b) = advanced(crc(a), len(b)) ^ crc(b)."""
    at = np.minimum(n, WORD_BYTES + 1).astype(np.int64) << 10
    out = _FLAT[at + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= _FLAT[at + ((k << 8) + ((crc >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64))]
    far = np.flatnonzero(n > WORD_BYTES + 1)
    if len(far):
        value, left = crc[far], n[far].astype(np.int64)
        for table in _POWERS:
            value = np.where(left & 1, _apply(table, value), value)
            left >>= 1
        out[far] = value
    return out


# ---- the automaton ------------------------------------------------------------


class Scanner:
    """Word payloads of lower-cased bytes; its dictionary is made of the text that comes, and made anew when other words come."""

    def __init__(self, size: int = DICTIONARY):
        self.size, self.automaton, self.missed = size, None, 1.0
        self.payloads = np.zeros((0, 2), np.int64)  # CRC and length; the automaton emits their places, as it holds 32 bits a word

    def learn(self, piece: bytes) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        common = [w for w, _ in Counter(w for w in piece.split() if len(w) <= WORD_BYTES).most_common(self.size)]
        for i, w in enumerate(common):
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)
        self.payloads = np.array([(crc32(w), len(w)) for w in common], np.int64).reshape(-1, 2)
        self.automaton.make_automaton()
        self.missed = -1.0  # measured by the next scan

    def words(self, piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, CRC and length of each word, in order. ``piece`` begins and ends with a space."""
        gap = np.frombuffer(piece, np.uint8) == 32
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        ends = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
        length, crc, met = ends - starts, np.zeros(len(ends), np.uint32), np.zeros(len(ends), bool)
        if self.automaton is None and len(ends):
            self.learn(piece)
        if self.automaton:
            emitted = np.fromiter(chain.from_iterable(self.automaton.iter(piece.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(ends, emitted[:, 0])
            payload = self.payloads[emitted[:, 1]]
            crc[at], length[at], met[at] = payload[:, 0], payload[:, 1], True
        rest = np.flatnonzero(~met)
        crc[rest] = [crc32(piece[a:b]) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        if len(piece) > PIECE // 4:
            missed = len(rest) / max(len(ends), 1)
            if self.missed < 0:
                self.missed = missed
            elif missed > 1.5 * self.missed + 0.1:
                self.automaton = None  # other texts: learn from the next piece
        return starts, crc, length


def _pieces(texts: list[bytes], most: int) -> Iterator[tuple[bytes, list[int], list[int], int]]:
    """Lower-cased bytes, the documents in them, where each begins, and how many words at the front were in the document's piece before."""
    parts, docs, at, size = [b" "], [], [], 1
    for i, text in enumerate(texts):
        low = text.translate(LOWER)
        if len(low) <= most:
            docs.append(i)
            at.append(size)
            parts += [low, b" "]
            size += len(low) + 1
            if size <= most:
                continue
        if docs:
            yield b"".join(parts), docs, at, 0
        parts, docs, at, size = [b" "], [], [], 1
        if len(low) > most:
            done, carry = 0, []
            while done < len(low):
                end = low.find(b" ", min(done + most, len(low)))
                end = len(low) if end < 0 else end
                piece = b" ".join([b"", *carry, low[done:end], b""])
                yield piece, [i], [0], len(carry)
                done, carry = end, piece.rsplit(None, LONGEST_RUN - 1)[1 - LONGEST_RUN :]
    if docs:
        yield b"".join(parts), docs, at, 0


def features(texts: list[bytes], scanner: Scanner, buckets: int = BUCKETS, piece_bytes: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Run length, document number and bucket of all features, piece by piece."""
    for piece, docs, at, carried in _pieces(texts, piece_bytes):
        starts, crc, length = scanner.words(piece)
        if not len(starts):
            continue
        doc = np.repeat(np.array(docs), np.diff(np.append(np.searchsorted(starts, at), len(starts))))
        joined = advanced(np.full(len(crc), crc32(b" "), np.uint32), length) ^ crc  # of a space and the word
        run = crc
        for n in range(1, LONGEST_RUN + 1):
            if n > 1:
                run = advanced(run[:-1], length[n - 1 :] + 1) ^ joined[n - 1 :]
            last = doc[n - 1 :]
            keep = doc[: len(last)] == last
            keep[: max(0, carried - n + 1)] = False  # wholly in the words of the piece before
            yield n, last[keep], run[keep] % np.uint32(buckets)
            if len(run) < 2:
                break


_SCANNERS: list[Scanner] = []


def _scanner() -> Scanner:
    """One a Python worker, whatever the number of its tasks."""
    if not _SCANNERS:
        _SCANNERS.append(Scanner())
    return _SCANNERS[0]


def _bytes(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.large_binary())]


# ---- counting, scoring, drawing ---------------------------------------------------


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all whole texts; a task hands on one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, found in features(_bytes(b.column(0)), _scanner(), buckets):
                counts += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.record_batch({"bucket": pa.array(met, pa.int64()), "n": pa.array(counts[met])})

    out = np.zeros(buckets, np.int64)
    parts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares), a bucket."""
    n, t, s = len(corpus), float(target.sum()), float(corpus.sum())
    return np.array([math.floor(1000 * math.log((float(a) + 1) * (s + n) / ((float(b) + 1) * (t + n)))) for a, b in zip(target, corpus, strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            words, count, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for n, doc, bucket in features(_bytes(b.column("text")), _scanner(), len(gain)):
                each = np.bincount(doc, minlength=rows)
                count += each
                words += each if n == 1 else 0
                weight += np.bincount(doc, weights=gain[bucket], minlength=rows).astype(np.int64)  # whole numbers: exact under 2^53
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_words": pa.array(words), "n_features": pa.array(count), "weight": pa.array(weight)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_noise(scored: DataFrame, seed: int = SEED) -> DataFrame:
    """``score``: weight plus Gumbel noise of the identifier's hash (a null identifier hashes as an empty text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return scored.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rank`` 1, 2, 3... of the best ``percent`` of the rows with enough words; null elsewhere.

    ``scored`` must be a written table with a column ``place`` that differs in all rows. Only rows
    above a quantile that lies surely below the wanted one are sorted, by range, so that no task holds more than its range."""
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    able = F.col("n_words") >= least_words
    n, low = scored.filter(able).agg(F.count(F.lit(1)), F.percentile_approx("score", max(0.0, 1 - percent / 100 - QUANTILE_SLACK), ACCURACY)).first()
    quota = percent * n // 100
    if not quota:
        return none
    high = able & (F.col("score") >= low)
    if scored.filter(high).count() < quota:  # the sketch's bound on its rank error rules this out
        high = able
    order = [F.col("score").desc(), "doc_id", "n_features", "weight", "place"]
    ranges = cut(scored.filter(high).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in ranges.groupBy("range").count().orderBy("range").collect():  # a row a partition
        offsets.append((r["range"], before))
        before += r["count"]
    starts = scored.sparkSession.createDataFrame(offsets, "range int, start long")
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("start")
    ranked = ranges.join(F.broadcast(starts), "range").withColumn("rank", rank.cast("long")).drop("range", "start")
    return none.filter(~high).unionByName(ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank"))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank, n_words.

    A null text has no words: weight 0, never drawn, like every text of too few words. Texts are read whole; one of any length is scanned in
    slices, though a single word is held whole. A null identifier hashes as an empty text. Repeated rows count as
    often as they occur and take successive ranks. Ties in score go to the smaller identifier, then to the
    row with fewer features and the smaller weight. An empty table gives no rows; an empty target
    makes all its shares alike. Further columns are ignored. Bucket counts are all that reaches the driver."""
    gain = gains(bucket_counts(target), bucket_counts(docs, text_col))
    scored = with_noise(weighted(docs, gain, id_col, text_col), seed).withColumn("place", F.monotonically_increasing_id())
    return drawn(cut(scored), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The CRC of each distinct feature as the xor of what each byte at its distance from the end contributes.
SQL = r"""WITH RECURSIVE bits(b, k, v) AS (SELECT b, 0, b::BIGINT FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
step AS MATERIALIZED (SELECT b, v FROM bits WHERE k = 8),
w AS MATERIALIZED (SELECT true AS doc, row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
UNION ALL SELECT false, row_number() OVER (), NULL, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
f AS MATERIALIZED (SELECT doc, r, unnest(list_transform(range(1, len(w) + 2 - n), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS f FROM w, (VALUES (1), (2), (3)) k(n)),
d AS MATERIALIZED (SELECT f, encode(f) AS b, octet_length(encode(f)) AS n FROM (SELECT DISTINCT f FROM f)),
top AS (SELECT max(n) AS m FROM d),
far(k, b, v) AS (SELECT 0, b, v FROM step UNION ALL SELECT k + 1, far.b, xor(far.v >> 8, s.v) FROM far JOIN step s ON s.b = far.v & 255 WHERE k + 1 < (SELECT m FROM top)),
init(k, v) AS (SELECT 0, 4294967295 UNION ALL SELECT k + 1, xor(init.v >> 8, s.v) FROM init JOIN step s ON s.b = init.v & 255 WHERE k < (SELECT m FROM top)),
h AS (SELECT f, bit_xor(far.v) AS x, any_value(n) AS n FROM (SELECT f, n, n - i AS k, ('0x' || substr(hex(b), 2 * i - 1, 2))::INT AS b FROM (SELECT f, n, b, unnest(range(1, n + 1)) AS i FROM d)) x JOIN far USING (k, b) GROUP BY f),
c AS MATERIALIZED (SELECT h.f, xor(xor(h.x, init.v), 4294967295) % 10000 AS bucket FROM h JOIN init ON init.k = h.n),
n AS MATERIALIZED (SELECT doc, r, bucket, count(*) AS n FROM f JOIN c USING (f) GROUP BY ALL),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
FROM (SELECT bucket, coalesce(sum(n) FILTER (NOT doc), 0) AS t, coalesce(sum(n) FILTER (doc), 0) AS s FROM n GROUP BY 1)),
s AS (SELECT w.r, doc_id, len(w.w) AS n_words, coalesce(x.n, 0)::BIGINT AS n_features, coalesce(x.weight, 0)::BIGINT AS weight FROM w LEFT JOIN (SELECT r, sum(n) AS n, sum(n * gain) AS weight FROM n JOIN g USING (bucket) WHERE doc GROUP BY 1) x ON x.r = w.r WHERE w.doc),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM s),
o AS (SELECT *, n_words >= 20 AS able, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS rank, 5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS quota FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND rank <= quota THEN rank END AS rank, n_words FROM o"""
