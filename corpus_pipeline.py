"""A training corpus from raw documents, in five stages.

Each stage reads what the one before has written. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaops.llm.common import cut, scratch
from mediaops.llm.exact_dedup import exact_groups
from mediaops.llm.minhash import jaccard_groups
from mediaops.llm.mixing import mix
from mediaops.llm.pieces import MODEL, Vocabulary, encode
from mediaops.llm.quality import CUT, fit, with_score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _named(docs: DataFrame) -> DataFrame:
    """documents' columns and a name for each row, so that repeated identifiers stay apart.

    The name is the row's place in its file, which is the same however the files are
    split into tasks. Every stage reads a written table, so its rows have one."""
    place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
    return docs.select(*COLUMNS, place.alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Its labels come from the labels table, outside the held-out fold.

    A null text scores as an empty one; repeated rows score alike; whole texts are looked at, whatever their
    length; an empty table stays empty; columns beside those of documents go."""
    rows = docs.select(*COLUMNS)
    return with_score(rows, fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))).filter(F.col("score") >= CUT).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest doc_id (null last).

    A null text counts as empty; of rows with one doc_id and equal texts that with the smallest hash of
    all columns stays, so that the same rows in other files give the same; texts of any length are compared whole; an empty
    table stays empty; columns beside those of documents go."""
    rows = _named(docs).withColumn("row", F.concat_ws(":", F.hex(F.xxhash64(*COLUMNS)), "row"))
    kept = exact_groups(rows.select("doc_id", "text", "row"), row_col="row").filter("kept").select("row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id (null last).

    Documents are linked if at least 0.8 of their five-word shingles are common; SimHash and
    MinHash name candidates, and the sets themselves are compared. A
    null text counts as empty; all texts without words are one group; a very long text's whole set
    of shingles is compared; an empty table stays empty; columns beside those of documents go."""
    rows = _named(docs)
    groups = jaccard_groups(rows.select("row", "text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS).alias("content"), "row")
    members = cut(rows.select("row", order.alias("order")).join(groups, "row"))
    several = members.groupBy("group").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    dropped = members.join(several, "group").filter("row <> first.row").select("row")
    return rows.join(dropped, "row", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, each as often as it is taken, rounded up.

    A document of which the mix takes a part is in it, whole. Documents without words
    (null text too) and those that the mix takes no word of are not; a very long text counts by
    its words like any other; an empty table stays empty; columns beside those of documents go."""
    rows = _named(docs)
    seed = F.xxhash64(*COLUMNS)  # of the content, so that another run takes the same documents
    taken = mix(rows.select(seed.alias("doc_id"), "text", "source", "row"), row_col="row")
    times = taken.filter("taken > 0").select("row", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    met = rows.join(times, "row")
    return met.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, scores, round_trip of every document in the mix.

    Null and empty texts have no tokens; repeated rows come out alike; whole texts are encoded; an
    empty table stays empty; further columns go, whatever their names."""
    return encode(docs, Vocabulary.read(MODEL))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("sentencepiece", pieces)]

#: The classifier and the piece lattice have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on the documents of a folder; what a stage writes on its way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
