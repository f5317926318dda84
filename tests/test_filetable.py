import random

import pytest
from pyspark.sql import functions as F

from mediaops.sources.filetable import Counts, FileTable

SCHEMA = "k int, at int, v string, file string, _rn int"


def table(spark, path, rows, parts=10):
    return FileTable(spark, str(path)).create(spark.createDataFrame(rows, SCHEMA).repartitionByRange(parts, "k"))


def rows(n=200):
    return [(i, 0, f"v{i}", "f", i) for i in range(n)]


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_rewrites_only_touched_files(spark, tmp_path):
    t = table(spark, tmp_path / "t", rows())
    before = t.files()
    counts = t.upsert(spark.createDataFrame([(3, 1, "new", "f", 1), (3, 2, "newest", "f", 1), (7, -1, "old", "f", 1), (900, 1, "added", None, None)], SCHEMA), ["k"], ["at"])
    assert len(before) == 10 and counts[:3] == (9, 1, 0) and set(before) - set(t.files()) and len(set(before) & set(t.files())) == 9
    want = {r[0]: r for r in rows()} | {3: (3, 2, "newest", "f", 1), 900: (900, 1, "added", None, None)}
    assert content(t.read()) == sorted(want.values(), key=str)
    assert content(t.read(0)) == sorted(rows(), key=str) and t.version() == 1  # the version before is still there


def test_update_and_delete(spark, tmp_path):
    t = table(spark, tmp_path / "t", [*rows(), (None, None, None, None, None)])
    assert t.update(F.col("k") == -5, {"v": F.lit("x")}).kept == 10 and t.version() == 0
    c = t.update(F.col("k").between(100, 101), {"v": F.concat("v", F.lit("!")), "at": F.lit(5)})
    assert c.kept >= 8 and c.rewritten == 10 - c.kept and t.read().filter("v like '%!' and at = 5").count() == 2
    c = t.delete(F.col("k") < 70)
    assert c.dropped >= 2 and c.rewritten <= 2 and sum(t.files().values()) == t.read().count() == 131
    assert t.delete(F.col("k") < 70) == Counts(len(t.files()), 0, 0, 0)
    assert t.read().filter("k is null").count() == 1


def test_random_changes_against_a_dict(spark, tmp_path):
    rng = random.Random(3)
    t, want = table(spark, tmp_path / "t", rows(60), 6), {r[0]: r for r in rows(60)}
    for step in range(1, 5):
        change = [(rng.choice([None, *range(80)]), rng.randrange(step + 1), f"s{step}-{i}", "f", i) for i in range(8)]
        change = list({r[0]: r for r in change}.values())
        t.upsert(spark.createDataFrame(change, SCHEMA), ["k"], ["at"])
        for r in change:
            if r[0] not in want or r[1] >= want[r[0]][1]:
                want[r[0]] = r
        assert content(t.read()) == sorted(want.values(), key=str)


def test_empty_tables_and_changes(spark, tmp_path):
    t = table(spark, tmp_path / "t", [])
    assert t.read().count() == 0 and t.read().columns == ["k", "at", "v", "file", "_rn"]
    t.upsert(spark.createDataFrame(rows(3), SCHEMA), ["k"], ["at"])
    assert t.read().count() == 3
    t.upsert(spark.createDataFrame([], SCHEMA), ["k"], ["at"])
    assert t.read().count() == 3
    t.delete(F.lit(True))
    assert t.read().count() == 0 and t.files() == {}


def test_a_version_is_written_once(spark, tmp_path):
    t = table(spark, tmp_path / "t", rows(5), 1)
    with pytest.raises(Exception, match="exists"):
        t._commit(0, {}, t.schema())
    assert t.read().count() == 5
