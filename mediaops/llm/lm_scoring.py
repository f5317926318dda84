"""Cross-entropy difference scoring with matched n-gram models.

Two word bigram models of one form, a target and a background model, share the
vocabulary of the corpus and their smoothing. A token's loss difference is its
target loss less its background loss; a document's score is the mean over its
tokens, low where it reads like the target. Tokens are the words of a text and the
mark at its end, which also stands before its first word. Each document is scored
by models that left it out: what it holds itself is taken off every count, so a
target document doesn't read like the target for having been one.

Counts come from every document and grow with the corpus, so no task and no driver
holds them all. Documents are dealt into parts once; each part sends its distinct
n-grams with its own counts to buckets, which add them up and send the sums back in
the same order. N-grams go by 56-bit hashes, packed by part and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

#: Weight of the shorter context in tokens, the same for both models.
BACKOFF = 4.0
PART_BYTES = 8 << 20
_MARK = b"\n"  # the end of a text; no word holds it
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _pack_steps(x: np.ndarray) -> bytes:
    """Ascending numbers below 2^56 as the bytes of their differences, lowest bytes first."""
    return _pack(np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :7].T))


def _unpack_steps(blob: bytes) -> np.ndarray:
    planes = _unpack(blob, np.uint8).reshape(7, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :7] = planes.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    out = v * _M1 + (w ^ (w >> np.uint64(31))) * _M2
    out ^= out >> np.uint64(29)
    out *= _M1
    return out ^ (out >> np.uint64(32))


class Grams:
    """The n-grams of a part: distinct hashes by bucket, and where each token's lie among them."""

    def __init__(self, table: pa.Table, buckets: int):
        targets = set(table.filter(pc.is_null(table["text"]))["doc_id"].to_pylist())  # labels come as rows without a text
        table = table.filter(pc.is_valid(table["text"]))
        texts = [t.as_buffer().to_pybytes() for t in table["text"].cast(pa.large_binary()).combine_chunks()]
        ids = table["doc_id"].to_pylist()
        self.rows = np.array(sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i])), np.int64)  # one order each time
        self.doc_id = table["doc_id"].take(pa.array(self.rows))
        self.is_target = np.array([ids[i] in targets for i in self.rows.tolist()], bool)
        number: dict[bytes, int] = {_MARK: 0}
        tokens, sizes = [], []
        for i in self.rows.tolist():
            words = texts[i].split()  # on the six ASCII spaces
            tokens += [number.setdefault(w, len(number)) for w in words]
            if words:
                tokens.append(0)
            sizes.append(len(words) + bool(words))
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        w = np.array(tokens, np.int64)
        v = np.r_[0, w[:-1]] if len(w) else w  # before a text's first word stands the mark at the end of the text before
        h = np.fromiter(map(_word_hash, number), np.uint64, len(number))
        every = np.concatenate([h[w], _pair(h[v], h[w])]) >> np.uint64(8) if len(w) else np.empty(0, np.uint64)
        self.hashes, at = np.unique(every, return_inverse=True)
        self.bucket = (self.hashes // np.uint64(-(-(1 << 56) // buckets))).astype(np.int64)  # ranges of hashes
        self.unigram, self.bigram = at[: len(w)], at[len(w) :]
        # a context is the word of the token before, or the mark: its last token's
        self.context = np.r_[self._mark(), self.unigram[:-1]] if len(w) else self.unigram

    def _mark(self) -> int:
        return int(self.unigram[-1])  # a part's last token is a mark

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each distinct n-gram occurs in the part, and in its target documents."""
        at, mine = np.r_[self.unigram, self.bigram], np.r_[self.is_target[self.doc], self.is_target[self.doc]]
        return np.bincount(at, minlength=len(self.hashes)), np.bincount(at[mine], minlength=len(self.hashes))

    def cuts(self) -> list[tuple[int, int]]:
        starts = np.flatnonzero(np.r_[True, np.diff(self.bucket) > 0]) if len(self.bucket) else np.empty(0, np.int64)
        return list(zip(starts.tolist(), [*starts[1:].tolist(), len(self.bucket)], strict=True)) if len(starts) else []

    def own(self, at: np.ndarray) -> np.ndarray:
        """For each token, how often its document holds its n-gram."""
        _, back, n = np.unique(self.doc * np.int64(len(self.hashes) + 1) + at, return_inverse=True, return_counts=True)
        return n[back]


def _losses(grams: Grams, counts: np.ndarray, total: int, words: int, has_own: np.ndarray) -> np.ndarray:
    """-log p of each token under counts that its own document is taken off where ``has_own``."""
    mine = has_own[grams.doc]

    def left(at: np.ndarray) -> np.ndarray:
        return counts[at] - np.where(mine, grams.own(at), 0)

    # the words of a document but its last, and the mark before it, are contexts as often as they are tokens
    p1 = (left(grams.unigram) + 1.0) / (total - np.where(mine, grams.sizes[grams.doc], 0) + words)
    own_context = np.zeros(len(grams.doc), np.int64)
    if len(own_context):
        key = grams.doc * np.int64(len(grams.hashes) + 1)
        known, n = np.unique(key + grams.unigram, return_counts=True)
        own_context = n[np.searchsorted(known, key + grams.context)]  # every context is also a token of its document
    context = counts[grams.context] - np.where(mine, own_context, 0)
    return -np.log((left(grams.bigram) + BACKOFF * p1) / (context + BACKOFF))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the different words of each batch."""
    for b in batches:
        seen: set[bytes] = set()
        for t in b.column("text").cast(pa.large_binary()):
            seen.update(t.as_buffer().to_pybytes().split())
        yield pa.record_batch({"word": pa.array(np.fromiter(map(_word_hash, seen), np.uint64, len(seen)).view(np.int64))})


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of ``docs``, in nats a token.

    The background is all documents; the target those whose doc_id is in
    ``target_ids``. A null text counts as empty; an empty one has no tokens and zero
    losses. Rows with a null identifier are background only. Repeated rows count each
    for itself, and each is scored without itself only. Without (other) target
    documents the target model gives all words equal chances. A text longer than a
    part makes a part of its own length, which one task holds whole. An empty table
    gives no rows; further columns are ignored."""
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").alias("text"))
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    n_words = F.regexp_count("text", F.lit(WORD))
    sizes = cut(mine.select("doc_id", F.octet_length("text").alias("bytes"), (n_words + F.least(n_words, F.lit(1))).alias("n")).groupBy("doc_id").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")))
    total_bytes, total, most = sizes.agg(F.sum("bytes"), F.sum("n"), F.max(F.when(F.col("doc_id").isNotNull(), F.col("bytes")))).first()
    target_total = sizes.join(ids, "doc_id", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = mine.select("text").mapInArrow(_distinct_words, "word long").distinct().count() + 1
    parts = max(1, -(-(total_bytes or 0) // part_bytes))
    # an identifier's rows lie in as many parts as the largest needs, and so does its label
    salts = max(1, -(-(most or 0) // part_bytes))

    def part_of(salt: Column) -> Column:
        return F.pmod(F.xxhash64("doc_id", salt), F.lit(parts)).cast("int")

    salt = F.pmod(F.xxhash64("text"), F.when(F.col("doc_id").isNull(), F.lit(parts)).otherwise(F.lit(salts)))
    labels = ids.select("doc_id", F.lit(None).cast("string").alias("text"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")).select("doc_id", "text", part_of(F.col("salt")).alias("part"))
    dealt = mine.withColumn("part", part_of(salt)).unionByName(labels)

    def name(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grams = Grams(table, parts)
        background, target = grams.counts()
        cuts = grams.cuts()
        return pa.table({
            "part": pa.array([key[0].as_py()] * len(cuts), pa.int32()), "bucket": pa.array([int(grams.bucket[s]) for s, _ in cuts], pa.int64()),
            "hashes": pa.array([_pack_steps(grams.hashes[s:e]) for s, e in cuts], pa.binary()),
            "background": pa.array([_pack(background[s:e].astype(np.uint32)) for s, e in cuts], pa.binary()),
            "target": pa.array([_pack(target[s:e].astype(np.uint32)) for s, e in cuts], pa.binary()),
        })

    def add(table: pa.Table) -> pa.Table:
        hashes = [_unpack_steps(x) for x in table["hashes"].to_pylist()]
        ends = np.cumsum([len(x) for x in hashes])
        kinds, at = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([_unpack(x, np.uint32) for x in table[c].to_pylist()]), len(kinds)).astype(np.int64)[at] for c in ("background", "target")]
        return pa.table({
            "part": table["part"], "bucket": table["bucket"],
            **{c: pa.array([_pack(x) for x in np.split(s, ends[:-1])], pa.binary()) for c, s in zip(("background", "target"), sums, strict=True)},
        })

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        grams = Grams(left, parts)
        right = right.sort_by("bucket")  # as the n-grams are
        n, full = grams.sizes, np.flatnonzero(grams.sizes)
        means = {}
        for c, of, own in (("target", target_total, grams.is_target), ("background", total, np.ones(len(n), bool))):
            counts = np.concatenate([np.empty(0, np.int64), *(_unpack(x, np.int64) for x in right[c].to_pylist())])
            means[c] = np.zeros(len(n))
            if len(full):
                means[c][full] = np.add.reduceat(_losses(grams, counts, of, words, own), (np.cumsum(n) - n)[full]) / n[full]
        return pa.table({
            "doc_id": grams.doc_id, "n_tokens": pa.array(n), "target_loss": pa.array(means["target"]), "background_loss": pa.array(means["background"]),
            "score": pa.array(means["target"] - means["background"]),
        })

    named = dealt.groupBy("part").applyInArrow(name, "part int, bucket long, hashes binary, background binary, target binary")
    added = named.groupBy("bucket").applyInArrow(add, "part int, bucket long, background binary, target binary")
    return dealt.groupBy("part").cogroup(added.groupBy("part")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.filter("quality = 1 and toxic = 0"))
    return found.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL), false) AS is_target FROM documents
), tok AS (
  SELECT rid, is_target, unnest(list_concat([chr(10)], words)) AS v, unnest(list_concat(words, [chr(10)])) AS w FROM d WHERE len(words) > 0
), o2 AS (SELECT rid, is_target, v, w, count(*)::DOUBLE AS n FROM tok GROUP BY ALL
), o1 AS (SELECT rid, is_target, w, count(*)::DOUBLE AS n FROM tok GROUP BY ALL
), c2 AS (SELECT v, w, sum(n) AS b, coalesce(sum(n) FILTER (is_target), 0) AS t FROM o2 GROUP BY v, w
), c1 AS (SELECT w, sum(n) AS b, coalesce(sum(n) FILTER (is_target), 0) AS t FROM o1 GROUP BY w
), total AS (SELECT sum(b) AS b, sum(t) AS t, (count(*) FILTER (w <> chr(10)) + 1)::DOUBLE AS words FROM c1
), size AS (SELECT rid, sum(n) AS n FROM o1 GROUP BY rid
), loss AS (
  SELECT o2.rid, o2.n,
    -ln((c2.t - CASE WHEN o2.is_target THEN o2.n ELSE 0 END + 4 * (c1.t - CASE WHEN o2.is_target THEN ow.n ELSE 0 END + 1) / (total.t - CASE WHEN o2.is_target THEN size.n ELSE 0 END + total.words))
        / (cv.t - CASE WHEN o2.is_target THEN ov.n ELSE 0 END + 4)) AS lt,
    -ln((c2.b - o2.n + 4 * (c1.b - ow.n + 1) / (total.b - size.n + total.words)) / (cv.b - ov.n + 4)) AS lb
  FROM o2 JOIN c2 USING (v, w) JOIN c1 ON c1.w = o2.w JOIN c1 cv ON cv.w = o2.v JOIN o1 ow ON ow.rid = o2.rid AND ow.w = o2.w JOIN o1 ov ON ov.rid = o2.rid AND ov.w = o2.v
       JOIN size ON size.rid = o2.rid, total
), s AS (SELECT rid, sum(n) AS n, sum(n * lt) / sum(n) AS t, sum(n * lb) / sum(n) AS b FROM loss GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(coalesce(t, 0), 6) AS target_loss, round(coalesce(b, 0), 6) AS background_loss, round(coalesce(t - b, 0), 6) AS score
FROM d LEFT JOIN s USING (rid)
"""
