"""Configured sources -> one event stream, loss accounting and sinks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from secframe.schema import EVENT_SCHEMA, FIELDS
from secframe.session import materialize, scratch_path
from secframe.sources.lines import parse_apache, parse_delimited, parse_json, parse_syslog
from secframe.sources.normalize import normalize

# fixed values: the shipped source layout
SOURCES = {
    "auth": {"file": "auth_windows.jsonl", "type": "jsonl", "source_type": "Sysmon",
             "dataset": "authentication"},
    "process": {"file": "process_create.jsonl", "type": "jsonl", "source_type": "Sysmon",
                "dataset": "process_creation"},
    "web": {"file": "web_access.log", "type": "apache", "source_type": "Apache",
            "dataset": "web"},
    "proxy": {"file": "proxy_traffic.jsonl", "type": "jsonl", "source_type": "Proxy",
              "dataset": "proxy"},
    "firewall": {"file": "firewall.csv", "type": "csv", "source_type": "Firewall",
                 "dataset": "firewall"},
    "dns": {"file": "dns_queries.tsv", "type": "csv", "delimiter": "\t", "source_type": "DNS",
            "dataset": "dns"},
    "ssh": {"file": "auth.log", "type": "syslog", "source_type": "SSH", "dataset": "auth"},
}


def alias_tables(table: DataFrame) -> dict:
    """(source_type, vendor, field[, rank]) rows -> {source type: [(vendor field, canonical field)]}.

    A table of vendor names is configuration: it is read on the driver, where plans are built.
    """
    order = ["source_type", *(["rank"] if "rank" in table.columns else []), "vendor"]
    out: dict = {}
    for r in table.orderBy(*order).collect():
        if r.field not in FIELDS:
            raise ValueError(f"{r.source_type}: {r.field!r} is no canonical field")
        out.setdefault(r.source_type, []).append((r.vendor, r.field))
    return out


def with_aliases(sources: dict, tables: dict) -> dict:
    """Sources whose vendor aliases come from tables instead of the built-in ones, where a table has them."""
    return {n: {**spec, "aliases": tables[spec["source_type"]]} if spec.get("source_type") in tables else spec for n, spec in sources.items()}


def parse_lines(lines: DataFrame, spec: dict, source: str | None = None,
                header: str | None = None) -> DataFrame:
    """Lines of one source -> canonical events with bookkeeping columns.

    ``aliases`` in the spec, (vendor field, canonical field) in fill order, replaces the built-in ones
    of its source type.
    """
    kind, dataset, aliases = spec.get("type", "jsonl"), spec.get("dataset"), spec.get("aliases")
    if kind == "apache":
        parsed = parse_apache(lines, dataset or "web")
    elif kind == "syslog":
        parsed = parse_syslog(lines, dataset or "auth", aliases)
    elif kind == "csv":
        parsed = parse_delimited(lines, header or spec["header_line"],
                                 spec.get("delimiter", ","), dataset,
                                 spec.get("source_type"), aliases)
    else:
        parsed = parse_json(lines, dataset, spec.get("source_type"), aliases)
    return normalize(parsed, spec.get("source_type"), source, spec.get("year", 2026),
                     spec.get("offset", "+00:00"), aliases)


#: bits of ``_pos`` below the file number: files of up to 8 TB, a million of them
_PLACE_BITS = 43


def _plain_path(path: Column) -> Column:
    """Spark spells the scheme's slashes in two ways."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")


def located_lines(spark: SparkSession, path: str, first_file: int = 0):
    """(lines with ``_file`` and ``_pos``, number of files).

    ``_pos`` follows file name, then position.  A split of a file starts at a byte offset and holds
    fewer lines than bytes, so offset plus line number in the task grows along the file however
    the scan is cut.
    """
    lines = spark.read.text(path)
    files = sorted(lines.inputFiles())
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(2 ** 33 - 1))
    lines = lines.select("value", _plain_path(F.col("_metadata.file_path")).alias("_file"),
                         (F.col("_metadata.file_block_start") + row).alias("_at"))
    names = spark.createDataFrame([(f, first_file + i) for i, f in enumerate(files)], "name string, ix bigint")
    names = names.select(_plain_path(F.col("name")).alias("_file"), "ix")
    numbered = lines.join(names, "_file").select(
        "value", "_file", (F.shiftleft("ix", _PLACE_BITS) + F.col("_at")).alias("_pos"))
    return numbered, len(files)


def file_headers(lines: DataFrame) -> DataFrame:
    """(_file, header): the first line of each file that is not blank."""
    return (lines.filter(F.trim("value") != "").groupBy("_file")
            .agg(F.min_by("value", "_pos").alias("header")))


def read_source(spark: SparkSession, path: str, spec: dict, source: str, first_file: int = 0):
    """(records of one source, number of files).

    Each delimited file has its own header, unless the spec names one (``header_line``), which
    also saves the pass that looks for them.
    """
    lines, n = located_lines(spark, path, first_file)
    if spec.get("type") != "csv" or "header_line" in spec:
        return parse_lines(lines, spec, source), n
    heads = materialize(file_headers(lines), "headers")
    kinds = [r[0] for r in heads.select("header").distinct().orderBy("header").collect()]
    parts = [parse_lines(lines.join(heads.filter(F.col("header") == h).select("_file"), "_file"), spec, source, h)
             for h in kinds] or [parse_lines(lines, spec, source, "")]
    records = parts[0]
    for p in parts[1:]:
        records = records.unionByName(p, allowMissingColumns=True)
    return records, n


def read_sources(spark: SparkSession, root: str, sources: dict = SOURCES):
    """All configured sources -> (records with bookkeeping, names of missing sources)."""
    frames, missing, files = [], [], 0
    for name, spec in sources.items():
        try:
            records, n = read_source(spark, f"{root.rstrip('/')}/{spec['file']}", spec, name, files)
            frames.append(records)
            files += n
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            missing.append(name)
    records = None
    for f in frames:
        records = f if records is None else records.unionByName(f, allowMissingColumns=True)
    return records, missing


def good_events(records: DataFrame) -> DataFrame:
    """Accepted events with a sequence number that is unique over all sources.

    Records read from files are numbered by source, file and position; others as they come.
    """
    seq = F.col("_pos") if "_pos" in records.columns else F.monotonically_increasing_id()
    numbered = records.withColumn("event_seq", seq)
    return numbered.filter(F.col("_error").isNull() & ~F.col("_blank")).select(
        *[f.name for f in EVENT_SCHEMA.fields])


def ingest_loss(records: DataFrame, by: str = "source") -> DataFrame:
    """Lines, parsed records, errors and loss per source, counted in one pass."""
    bad = F.col("_error").isNotNull()
    return (records.groupBy(by)
            .agg(F.count(F.lit(1)).alias("lines"),
                 F.count_if(~bad & ~F.col("_blank")).alias("parsed"),
                 F.count_if(bad).alias("parse_errors"))
            .withColumn("loss_pct", F.round(100.0 * F.col("parse_errors") / F.col("lines"), 2)))


def error_kinds(records: DataFrame) -> DataFrame:
    return (records.filter(F.col("_error").isNotNull())
            .groupBy("source", F.col("_error").alias("error")).agg(F.count(F.lit(1)).alias("n")))


#: Rows of one file at most; partitions of the write follow the session's advisory size.
FILE_ROWS = 5_000_000


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by day and dataset, so rule scopes prune folders.

    Rows are rebalanced by folder: adaptive execution splits a folder with most of the data over as
    many tasks as its measured size needs, and small folders share tasks.
    """
    (events.withColumn("event_date", F.to_date("ts")).hint("rebalance", "event_date", "event_dataset")
     .write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).partitionBy("event_date", "event_dataset").parquet(path))


def compact_events(spark: SparkSession, path: str, since: str | None = None, before: str | None = None) -> None:
    """Rewrite day folders (from ``since``, before ``before``) whose files appends have left small.

    The days are first written to the shared scratch folder and then replace their old folders, so
    a failure in between loses nothing: either the old or the complete new files are there to copy again.
    """
    days = spark.read.parquet(path)
    if since is not None:
        days = days.filter(F.col("event_date") >= F.lit(since).cast("date"))
    if before is not None:
        days = days.filter(F.col("event_date") < F.lit(before).cast("date"))
    copy = scratch_path(spark, "compact")
    days.hint("rebalance", "event_date", "event_dataset").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("event_date", "event_dataset").parquet(copy)
    fresh = spark.read.schema(days.schema).parquet(copy)
    (fresh.hint("rebalance", "event_date", "event_dataset").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", FILE_ROWS).partitionBy("event_date", "event_dataset").parquet(path))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in EVENT_SCHEMA.fields], "event_date")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
