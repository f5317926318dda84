"""Sources: JSON payloads, object listings, line lists, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_fields(df: DataFrame, col: str, fields: dict[str, str]) -> DataFrame:
    """Fields of a JSON column as typed columns; null where the text is broken or has none."""
    v = F.try_parse_json(col)
    return df.select("*", *[F.try_variant_get(v, f"$.{name}", kind).alias(name) for name, kind in fields.items()])


def objects(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, first: str | None = None) -> DataFrame:
    """path, length, modificationTime of stored objects, no contents; names that hold ``first`` come first."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", "modificationTime")
    return listed.orderBy(F.when(F.col("path").contains(first), 0).otherwise(1), "path") if first else listed


def lines(spark: SparkSession, path: str) -> DataFrame:
    """http(s) addresses of a text list, without blank lines and comments."""
    trimmed = F.trim("value")
    return spark.read.text(path).select(trimmed.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#") & F.lower("url").rlike("^https?://"))


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
