"""Shared pieces of the corpus operators: tables, scratch tables, texts and words."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from secframe.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, as a regular expression class and as plain characters.
SPACE_CLASS, SPACE_CHARS = r"[\x20\x09-\x0D]", " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables in the shared folder, dropped together when a later one replaces them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, scratch_path(spark, label)
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write once and read back: lineage ends here, and later readers still prune columns.

        Shuffle files of the plan just written go when the driver's garbage is collected, which a
        large heap may put off until the disks are full; so it is asked for here.
        """
        path = self.place(name)
        df.write.option("compression", "zstd").parquet(path)
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def place(self, name: str) -> str:
        """A new folder under this scratch base."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        self.paths[name] = path
        return path

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    ``lower`` does the same on pure ASCII, much faster than ``translate``.
    """
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def space_words(text: Column) -> Column:
    """Words between ASCII white space; an empty array for a text without any."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, SPACE_CLASS + "+"))


def spark_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
