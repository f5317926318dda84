import os
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from mediaops.llm.pieces import MODEL, Vocabulary
from mediaops.llm.common import shared_dir
from tests.llm.test_minhash import brute_components, brute_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def make(tmp_path, spark):
    rng = random.Random(14)
    words = ["river", "slowly", "past", "old", "houses", "nobody", "sees", "light", "under", "bridge", "stone", "water"]
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 5
        t = " ".join(rng.choice(["BUY!!", "NOW###", "x |", "$$$"]) if bad else rng.choice(words) for _ in range(rng.randint(20, 120)))
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, int(not bad), 0))
    texts = [r[1] for r in rows if r[0] % 6 != 5]
    rows += [(300 + i, texts[i].replace(" ", "\n", 3), "en", "s0", 1) for i in range(30)]
    rows += [(400 + i, texts[40 + i] + " water", "en", None, 1) for i in range(30)]
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (None, texts[60], "en", "s2", 5), (7, rows[7][1], "en", "s3", 1), (7, texts[3] + " stone under water", "en", "s3", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return rows, dict((i, q) for i, q, _ in labels)


def order(r):
    return (r[0] is None, r[0] or 0)


def test_stages_against_brute_force(spark, tmp_path):
    rows, truth = make(tmp_path, spark)
    docs, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "sentencepiece" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = [tuple(r) for r in docs.collect()]
    kept = {r[0] for r in got["quality"]}
    assert all((i in kept) == bool(q) for i, q in truth.items())
    groups = {}
    for r in got["quality"]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    want = [min(g, key=lambda r: (-len(r[1] or ""), *order(r))) for g in groups.values()]
    assert sorted(got["exact_dedup"], key=str) == sorted(want, key=str)
    rows = sorted(got["exact_dedup"], key=order)
    first = {}
    for r, group in zip(rows, brute_components([brute_set(r[1]) for r in rows]), strict=True):
        first.setdefault(group, r)
    assert sorted(got["near_dedup"], key=str) == sorted(first.values(), key=str)
    assert set(got["mixing"]) <= {r for r in got["near_dedup"] if (r[1] or "").split()}
    assert max(got["mixing"].count(r) for r in set(got["mixing"])) <= 2
    v = Vocabulary.read(MODEL)
    by_id = {}
    for r in got["mixing"]:
        by_id.setdefault(r[0], []).append(r[1])
    assert len(got["sentencepiece"]) == len(got["mixing"])
    assert all(v.decode(r[1]) in by_id[r[0]] and r[4] for r in got["sentencepiece"])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(str(r) for r in spark.read.parquet(f"{tmp_path}/sentencepiece").collect())


def test_rows_keep_their_names_under_other_parallelism(spark, tmp_path):
    make(tmp_path, spark)
    spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(2).write.parquet(f"{tmp_path}/few")
    got = []
    for size, least in (("128m", "1"), ("8k", "64")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", least)
        docs, kept = spark.read.parquet(f"{tmp_path}/few"), []
        named = corpus_pipeline._named(docs).collect()
        for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.mixture):
            kept.append(sorted(map(str, stage(spark, docs, str(tmp_path)).collect())))
        got.append((sorted(map(str, named)), kept))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert got[0] == got[1]
    assert len({r.row for r in named}) == len(named)


def test_exact_keeps_the_same_rows_of_other_files(spark, tmp_path):
    make(tmp_path, spark)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    tie = docs.filter("doc_id = 7").limit(1)
    for n, many in enumerate((tie.union(tie.withColumn("n_chars", F.lit(99999).cast("long"))), tie.withColumn("n_chars", F.lit(99999).cast("long")).union(tie))):
        docs.filter("doc_id <> 7").union(many).repartition(2 + 3 * n).write.parquet(f"{tmp_path}/tie{n}")
        kept.append(sorted(map(str, corpus_pipeline.exact(spark, spark.read.parquet(f"{tmp_path}/tie{n}"), "").collect())))
    assert kept[0] == kept[1]


def test_stages_on_long_texts_and_further_columns(spark, tmp_path):
    make(tmp_path, spark)
    rng = random.Random(15)
    long = " ".join(rng.choice(["river", "slowly", "past", "old", "houses", "nobody", "stone"]) for _ in range(200_000))
    rows = [(1, long, "en", "a", 1, "x", 9), (2, long + " bridge", "en", None, 1, "y", 9), (3, "a few words of its own", None, "a", None, None, None)]
    spark.createDataFrame(rows, f"{DOCS}, row string, component int").write.parquet(f"{tmp_path}/long")
    docs = spark.read.parquet(f"{tmp_path}/long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, str(tmp_path))
        ids = sorted(r.doc_id for r in out.select("doc_id").distinct().collect())
        want = {"near_dedup": [1, 3], "mixing": [1, 2]}  # a block of source "a" is nearly always the long text's
        assert ids == want.get(name, [1, 2, 3]), name
        assert name == "sentencepiece" or out.columns == corpus_pipeline.COLUMNS


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    make(tmp_path, spark)
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert rows > 100 and len(set(os.listdir(folder)) - before) == len(corpus_pipeline.STAGES) - 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
