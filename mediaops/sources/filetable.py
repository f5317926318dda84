"""A stored table that changes by file: copy on write with a manifest for each version.

A version is a list of Parquet files. A change first finds the files that hold a row it touches, reading
only the columns that takes, rewrites those alone and lists the others again;
readers of an older version keep their files. The manifest is written last and as a whole, so a job that
dies before leaves the table as it was. Files lie in a folder a commit, and are named by it."""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_of() -> Column:
    """Folder and name of the file that a row was read from."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def _free(names: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name."""
    while wanted in names:
        wanted = f"_{wanted}"
    return wanted


class Counts(NamedTuple):
    """Files of the version before that were kept, rewritten, and dropped without a rewrite, and files added."""

    kept: int
    rewritten: int
    dropped: int
    added: int


class FileTable:
    """The table under a path that all executors share. One writer at a time: a second one fails when it writes the same version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- versions ----

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema("file string, rows long, fields string, version long").parquet(f"{self.path}/manifest")

    def version(self) -> int:
        return self._manifests().agg(F.max("version")).first()[0]

    def files(self, version: int | None = None) -> dict[str, int]:
        """Rows of each file of a version (metadata: a row a file)."""
        v = self.version() if version is None else version
        return {r.file: r.rows for r in self._manifests().filter((F.col("version") == v) & F.col("file").isNotNull()).collect()}

    def _open(self, names: list[str], schema: StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    def schema(self, version: int | None = None) -> StructType:
        v = self.version() if version is None else version
        return StructType.fromJson(json.loads(self._manifests().filter((F.col("version") == v) & F.col("file").isNull()).first().fields))

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self._open(sorted(self.files(v)), self.schema(v))

    # ---- writing ----

    def _put(self, df: DataFrame) -> dict[str, int]:
        """Write rows as new files: their names and rows."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        rows = self.spark.read.schema(df.schema).parquet(folder).select(file_of().alias("file")).groupBy("file").count()
        return {r.file: r["count"] for r in rows.collect()}

    def _commit(self, version: int, files: dict[str, int], schema: StructType) -> None:
        rows = [(f, n, None) for f, n in sorted(files.items())] + [(None, 0, schema.json())]
        self.spark.createDataFrame(rows, "file string, rows long, fields string").coalesce(1).write.parquet(f"{self.path}/manifest/version={version}")

    def create(self, df: DataFrame) -> FileTable:
        self._commit(0, self._put(df), df.schema)
        return self

    def _swap(self, touched: set[str], new: DataFrame) -> Counts:
        """The next version: all files but the touched ones, and new ones with these rows."""
        v, old, schema = self.version(), self.files(), self.schema()
        kept = {f: n for f, n in old.items() if f not in touched}
        added = self._put(new.select(*schema.names)) if new is not None else {}
        self._commit(v + 1, kept | added, schema)
        return Counts(len(kept), len(touched), 0, len(added))

    def _touching(self, rows: DataFrame) -> set[str]:
        return {r[0] for r in rows.select("_of_file").distinct().collect()}  # a row a file

    def _with_file(self, columns: list[str]) -> DataFrame:
        files = self.files()
        of_file = file_of() if files else F.lit(None).cast("string")
        return self._open(sorted(files), self.schema()).select(*columns, of_file.alias("_of_file"))

    # ---- changes ----

    def upsert(self, change: DataFrame, keys: list[str], version: list[str]) -> Counts:
        """Latest row of each key by ``version``; on a tie the change wins, and of several changes of a key the latest.

        Only files that hold a key of the change are rewritten; new keys go into files of their own. A null is a
        key like any other."""
        schema = self.schema()
        rank, is_new = _free(schema.names, "rank"), _free(schema.names, "is_new")
        order = [F.col(c).desc_nulls_last() for c in version]
        latest = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.xxhash64(*schema.names)))
        change = change.select(*schema.names).withColumn(rank, latest).filter(F.col(rank) == 1).drop(rank)
        held, wanted = self._with_file(keys).alias("held"), change.select(*keys).alias("wanted")
        touched = self._touching(held.join(wanted, [F.col(f"held.{k}").eqNullSafe(F.col(f"wanted.{k}")) for k in keys], "left_semi"))
        both = self._open(sorted(touched), schema).withColumn(is_new, F.lit(0)).unionByName(change.withColumn(is_new, F.lit(1)))
        newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.col(is_new).desc()))
        return self._swap(touched, both.withColumn(rank, newest).filter(F.col(rank) == 1))

    def update(self, where: Column, values: dict[str, Column]) -> Counts:
        """Set columns of the rows that meet a condition (a soft delete sets its status)."""
        hit = F.coalesce(where, F.lit(False))
        schema = self.schema()
        touched = self._touching(self._with_file(schema.names).filter(hit))
        if not touched:
            return Counts(len(self.files()), 0, 0, 0)
        kinds = {f.name: f.dataType for f in schema}
        old = self._open(sorted(touched), schema)
        return self._swap(touched, old.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in values else F.col(c) for c in schema.names]))

    def delete(self, where: Column) -> Counts:
        """Rows that meet a condition go. Files of which nothing is left are dropped without being read whole."""
        hit, schema, old = F.coalesce(where, F.lit(False)), self.schema(), self.files()
        gone = {r[0]: r.n for r in self._with_file(schema.names).filter(hit).groupBy("_of_file").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a file
        if not gone:
            return Counts(len(old), 0, 0, 0)
        whole = {f for f, n in gone.items() if n == old[f]}
        parts = set(gone) - whole
        rest = self._open(sorted(parts), schema).filter(~hit) if parts else None
        c = self._swap(set(gone), rest)
        return Counts(c.kept, len(parts), len(whole), c.added)
