"""Keyed tables that micro-batches change: every batch writes its changed rows, readers take the newest.

A batch writes under its own number and only reads what earlier batches wrote, so a batch repeated
after a failure replaces itself.  Every ``compact_every`` batches the whole table is written once, and
later readers start from there.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class Versions:
    """A table of rows (keys, fields, ``live``): the newest version of a key counts, if it is live.

    ``whole`` names the keys that are replaced together: all rows a batch writes for such a key take
    the place of all earlier ones (by default every row has a key of its own).
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, compact_every: int = 50):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema, self.compact_every = schema, compact_every

    def _folders(self, before: int | None) -> tuple[int | None, list[int]]:
        """(newest whole table, batches after it), of batches before a number."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return None, []
        names = [f.getPath().getName().split("=") for f in fs.listStatus(root)]
        of = lambda kind: sorted(int(n[1]) for n in names if n[0] == kind and (before is None or int(n[1]) < before))
        full = of("full")
        start = full[-1] if full else None
        return start, [b for b in of("batch") if start is None or b > start]

    def current(self, before: int | None = None) -> DataFrame:
        """Live rows as the batches before ``before`` left them."""
        full, batches = self._folders(before)
        read = lambda kind, n: self.spark.read.schema(f"{self.schema}, live boolean").parquet(f"{self.path}/{kind}={n}").withColumn("_batch", F.lit(n))
        parts = ([read("full", full)] if full is not None else []) + [read("batch", b) for b in batches]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) > 1:
            newest = rows.groupBy(*self.keys).agg(F.max("_batch").alias("_newest"))
            rows = rows.join(newest, self.keys).filter(F.col("_batch") == F.col("_newest")).drop("_newest")
        return rows.filter("live").drop("live", "_batch")

    def write(self, rows: DataFrame, batch_id: int, gone: DataFrame | None = None) -> DataFrame:
        """Store a batch's rows, and keys in ``gone`` as no longer there; returns the stored rows."""
        out = rows.withColumn("live", F.lit(True))
        if gone is not None:
            out = out.unionByName(gone.select(*self.keys).withColumn("live", F.lit(False)), allowMissingColumns=True)
        out.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        if batch_id and batch_id % self.compact_every == 0:
            self.current(batch_id + 1).withColumn("live", F.lit(True)).write.mode("overwrite").parquet(f"{self.path}/full={batch_id}")
        return self.spark.read.schema(f"{self.schema}, live boolean").parquet(f"{self.path}/batch={batch_id}").filter("live").drop("live")
