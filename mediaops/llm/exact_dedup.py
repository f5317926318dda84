"""Exact de-duplication by content sort.

Sampled splitters range-partition the rows by normalised text, the sort inside
each partition places equal texts next to each other, and neighbours are then
compared in full. The splitter key is (32-character prefix, digest, length,
identifier), so a group of copies of any size is spread over as many partitions
as it needs, and what the driver samples stays short however long texts are.
Only runs that touch a partition's first or last row can continue elsewhere:
two summaries a partition at most, merged by digest afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, text_of

_RUNS = "doc_id long, row string, sha string, lead_id long, lead_cp long, local_size long, lead boolean, edge boolean, part int"


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition to rows with their run's first row and length.

    Holds identifiers and digests of the open run only, never its texts."""
    part = TaskContext.get().partitionId()
    held: list[pa.Table] = []
    last, finished = None, 0

    def emit(end: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, finished
        if not held:
            return
        run = pa.concat_tables(held).combine_chunks()
        held, size, edge = [], run.num_rows, end or not finished
        finished += 1
        for at in range(0, size, 50_000):
            some = run.slice(at, 50_000)
            n = some.num_rows
            yield from pa.table(
                {
                    "doc_id": some["doc_id"],
                    "row": some["row"],
                    "sha": some["sha"],
                    "lead_id": pa.repeat(run["doc_id"][0], n),
                    "lead_cp": pa.repeat(run["n_cp"][0], n),
                    "local_size": pa.repeat(pa.scalar(size, pa.int64()), n),
                    "lead": pa.array([at == 0] + [False] * (n - 1)),
                    "edge": pa.repeat(edge, n),
                    "part": pa.repeat(pa.scalar(part, pa.int32()), n),
                }
            ).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column("norm")
        same = pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
        starts = [i + 1 for i in range(len(same)) if not same[i]]
        first_continues = last is not None and norm[0].as_py() == last
        bounds = [0, *starts, batch.num_rows]
        small = pa.Table.from_batches([batch.select(["doc_id", "row", "n_cp", "sha"])])
        if not first_continues:
            yield from emit(False)
        held.append(small.slice(0, bounds[1]))
        if len(bounds) > 2:
            yield from emit(False)
            a, b = bounds[1], bounds[-2]
            if b > a:  # runs that begin and end inside the batch
                lens = [y - x for x, y in zip(bounds[1:-2], bounds[2:-1], strict=True)]
                lead = pa.array([x for x, n in zip(bounds[1:-2], lens, strict=True) for _ in range(n)], pa.int64())
                some, size = small.slice(a, b - a), [n for n in lens for _ in range(n)]
                lead_at = lead.to_numpy()
                yield from pa.table(
                    {
                        "doc_id": some["doc_id"],
                        "row": some["row"],
                        "sha": some["sha"],
                        "lead_id": small["doc_id"].take(lead),
                        "lead_cp": small["n_cp"].take(lead),
                        "local_size": pa.array(size, pa.int64()),
                        "lead": pa.array([int(x) == a + i for i, x in enumerate(lead_at)]),
                        "edge": pa.repeat(False, b - a),
                        "part": pa.repeat(pa.scalar(part, pa.int32()), b - a),
                    }
                ).combine_chunks().to_batches()
                finished += len(lens)
            held = [small.slice(b)]
        last = norm[len(norm) - 1].as_py()
    yield from emit(True)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 32, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting spaces, tabs, line feeds,
    vertical tabs, form feeds and carriage returns. The row with most code points
    in its original text stays, then the smallest identifier. A null text counts
    as empty; all empty texts form one group. A null identifier sorts after all
    others. Of rows that agree in length and identifier exactly one is kept: that with the
    smallest ``row_col``, whatever files or tasks the rows come from (without it they
    come out alike). Texts are compared whole; a task holds two texts at a time beside
    a batch. An empty table gives no rows, and further columns of ``docs`` are ignored; ``row_col``,
    a name of the row, is carried along as a column ``row``.
    """
    row = F.col(row_col).cast("string") if row_col else F.lit(None).cast("string")
    norm = F.col("raw")
    for c in SPACES:
        norm = F.replace(norm, F.lit(c), F.lit(""))
    keyed = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), text_of(text_col).alias("raw"))
        .select("doc_id", "row", F.char_length("raw").cast("long").alias("n_cp"), norm.alias("norm"))
        .select("doc_id", "row", "n_cp", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
        .withColumn("prefix", F.substring("norm", 1, prefix_chars))
    )
    order = [F.col("n_cp").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ordered = keyed.repartitionByRange("prefix", "sha", *order).sortWithinPartitions("prefix", "sha", "norm", *order)
    runs = cut(ordered.select("doc_id", "row", "n_cp", "sha", "norm").mapInArrow(_compare_neighbours, _RUNS))

    best = F.min(F.struct((-F.col("lead_cp")).alias("cp"), F.col("lead_id").isNull().alias("none"), "lead_id", "part"))
    merged = (
        runs.filter("lead and edge")
        .groupBy("sha")
        .agg(best.alias("best"), F.sum("local_size").alias("size"))
        .select("sha", F.lit(True).alias("edge"), "best", "size")
    )  # at most two rows a partition; broadcast or not by size
    out = runs.join(merged, ["sha", "edge"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("edge"), F.col("best.lead_id")).otherwise(F.col("lead_id")).alias("keep_id"),
        F.when(F.col("edge"), F.col("size")).otherwise(F.col("local_size")).alias("group_size"),
        (F.col("lead") & (~F.col("edge") | (F.col("lead_id").eqNullSafe(F.col("best.lead_id")) & (F.col("part") == F.col("best.part"))))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["row"] if row_col else []),
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(n) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id NULLS LAST)
"""
