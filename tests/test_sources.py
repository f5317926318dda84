import datetime as dt

import pytest
from pyspark.sql import functions as F

from mediaops.sources import readers, writers


def test_lines_and_objects(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# sites\n\n https://example.com/a \nexample.org\nhttp://example.org\n")
    assert [r.url for r in readers.lines(spark, str(tmp_path / "list.txt")).collect()] == ["https://example.com/a", "http://example.org"]
    (tmp_path / "d").mkdir()
    for n in ("a.jpg", "b.jpg", "c.txt", "d/best.jpg"):
        (tmp_path / n).write_bytes(b"12")
    found = readers.objects(spark, str(tmp_path), "*.jpg", first="best").collect()
    assert [r.path.rsplit("/", 1)[-1] for r in found] == ["best.jpg", "a.jpg", "b.jpg"] and found[0].length == 2


def test_json_fields(spark):
    df = spark.createDataFrame([('{"k": 3}',), ("broken",), (None,)], "props string")
    assert [r.k for r in readers.json_fields(df, "props", {"k": "int"}).collect()] == [3, None, None]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("t", 1, dt.datetime(2024, 1, 2)), ("u", 2, dt.datetime(2024, 1, 3))], "tenant string, n int, ts timestamp")
    writers.to_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    writers.to_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["tenant", "n", "ts"]
    writers.to_csv(df.limit(0), f"{tmp_path}/e")
    assert sum(f.stat().st_size for f in (tmp_path / "e").glob("*.csv")) <= 20
    writers.append_by_date(df, "ts", f"{tmp_path}/a")
    writers.append_by_date(df, "ts", f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").filter("date = '2024-01-02'").count() == 2
    m = writers.bundle({"x": df, "y": df.filter("n = 1")}, "tenant", f"{tmp_path}/b")
    assert {(r.tenant, r.section): r.n_rows for r in m.collect()} == {("t", "x"): 1, ("u", "x"): 1, ("t", "y"): 1}
    assert spark.read.json(f"{tmp_path}/b/x").count() == 2
    assert writers.sidecar(df, "tenant", ["n"]).first().metadata == '{"n":1}'


@pytest.mark.parametrize(("most", "dry", "stored", "errors"), [(10, True, 0, {"invalid"}), (10, False, 1, {"invalid"}), (1, False, 0, {"batch_too_large"})])
def test_ingest(spark, tmp_path, most, dry, stored, errors):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, good boolean")
    out = writers.ingest_status(df, "id", F.col("good"), most, dry, f"{tmp_path}/s")
    assert {r.error for r in out.collect()} - {None} == errors
    path = tmp_path / "s"
    assert (spark.read.parquet(str(path)).count() if path.exists() else 0) == stored
