"""Log lines -> parsed records.

Each parser takes a DataFrame with a string column ``value`` (one line per row) and adds:
``_error`` (null, or why the line was rejected), ``raw`` (vendor fields as a map) and the
canonical columns the format itself determines.  Blank lines stay in the frame with
``_blank = true`` so that loss accounting can count every line in the same pass.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from secframe.functions.values import clean
from secframe.schema import ALIASES, FIELDS

# fixed values: line shapes
APACHE_LINE = (r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (-|\d+)'
               r'(?: "([^"]*)" "([^"]*)")?')
SYSLOG_LINE = (r'^(\w{3}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) ([\w\-\.]+)(?:\[(\d+)\])?: ?(.*)$')
KEY_VALUE = r'(\w+)="((?:[^"\\]|\\.)*)"|(\w+)=([^\s"]+)'

# vendor fields the normalizer reads besides the alias tables
FAMILY_FIELDS = ("EventID", "Image", "SourceImage", "ParentImage", "CommandLine", "TargetImage",
                 "GrantedAccess", "TargetFilename", "TargetObject", "Details", "ProcessCreate")


def vendor_names(source_type: str | None, aliases=None) -> list:
    return [v for v, _ in (ALIASES.get(source_type, []) if aliases is None else aliases)]


def _lines(df: DataFrame) -> DataFrame:
    line = F.regexp_replace("value", "[\r\n]+$", "")
    return df.withColumn("_line", line).withColumn("_blank", F.trim(line) == "")


def _rejected(df: DataFrame, error: Column) -> DataFrame:
    bad = F.when(~F.col("_blank"), error)
    return df.withColumn("_error", bad).withColumn(
        "_rejected", F.when(bad.isNotNull(), F.col("_line")))


def last_wins(pairs: Column) -> Column:
    """Array of (key, value) structs -> map where the last occurrence of a key counts.

    Sorted by key and place, a pair counts where the next one has another key.
    """
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value"))))
    chosen = F.transform(F.array(placed), lambda a: F.filter(a, lambda p, i: ~F.coalesce(F.get(a, i + 1)["key"] == p["key"], F.lit(False))))[0]
    return F.map_from_entries(F.transform(chosen, lambda p: F.struct(p["key"], p["value"])))


def parse_json(df: DataFrame, dataset: str | None = None, source_type: str | None = None, aliases=None) -> DataFrame:
    """JSON objects, one per line.  Anything else on a non-blank line is an error.

    Every line is parsed once.  ``raw`` is a struct of the fields ingest knows (a list as its JSON
    text), all other keys go to ``extra``, vendor fields also to ``vendor``, items of lists to ``lists``.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")      # the last one counts
    df = _lines(df)
    text = F.trim(F.col("_line"))
    vendors = list(dict.fromkeys([*vendor_names(source_type, aliases), *FAMILY_FIELDS]))
    names = list(dict.fromkeys([*FIELDS, *vendors]))
    known = ", ".join(f"`{n}`: string" for n in names)
    object_like = text.startswith("{") & text.endswith("}")
    # as the one element of a list, the line has to be used up by its object
    df = df.withColumn("_json", F.try_parse_json(F.when(object_like, F.concat(F.lit("["), text, F.lit("]")))))
    # ... unless it closes that list itself, which no object can do inside another object
    alone = ~text.rlike(r"\}\s*\]") | F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    only = F.try_variant_get("_json", "$[1]", "variant").isNull() & alone
    df = df.withColumn("_all", F.when(only, F.try_variant_get("_json", "$[0]", "map<string,variant>")))
    df = df.withColumn("raw", F.when(F.col("_all").isNotNull(), F.try_variant_get("_json", "$[0]", f"struct<{known}>")))
    bad = F.col("raw").isNull()
    scalar = F.substring(text, 1, 1).isin("[", '"') | text.rlike(r"^-?[\d.]+$")
    df = _rejected(df, F.when(bad, F.when(scalar, "json not an object").otherwise("bad json")))
    given = clean(F.col("raw").getField("event.dataset"))
    listed = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    as_text = lambda keep: F.transform_values(F.map_filter("_all", keep), lambda k, v: F.try_variant_get(v, "$", "string"))
    items = F.transform_values(F.map_filter("_all", lambda k, v: listed(v)), lambda k, v: F.try_variant_get(v, "$", "array<string>"))
    some = F.col("_all").isNotNull() & text.rlike(r":\s*\[")          # most lines hold no list
    empty = lambda v: listed(v) & F.try_variant_get(v, "$[0]", "variant").isNull()
    there = lambda v: ~F.is_variant_null(v) & ~empty(v)
    return df.withColumns({
        "event_dataset": F.coalesce(given, F.lit(dataset)),
        "extra": as_text(lambda k, v: ~k.isin(names) & there(v)),
        "vendor": as_text(lambda k, v: k.isin(vendors) & there(v)),
        "lists": F.when(some, items)}).drop("_json", "_all")


def parse_apache(df: DataFrame, dataset: str = "web") -> DataFrame:
    """Combined access log: one regex decides, plain splits take the line apart."""
    df = _lines(df)
    line = F.col("_line")
    df = _rejected(df, F.when(~line.rlike(APACHE_LINE), "apache line shape"))
    df = df.withColumn("_q", F.when(F.col("_error").isNull(), F.split(line, '"')))
    piece = lambda i: F.get(F.col("_q"), F.lit(i))
    df = df.withColumns({"_who": F.split(piece(0), " "), "_req": F.split(F.trim(piece(1)), r"\s+"),
                         "_res": F.split(F.trim(piece(2)), " ")})
    word = lambda c, i: F.when(F.get(F.col(c), F.lit(i)) != "", F.get(F.col(c), F.lit(i)))
    status, size = word("_res", 0).try_cast("bigint"), word("_res", 1)
    # the trailing quoted pair (referer, agent) is optional
    agent = F.when(piece(5) != "", piece(5)).otherwise("-")
    return df.select(
        "*", F.regexp_extract(piece(0), r"\[([^\]]+)\] $", 1).alias("_ts"),
        F.lit(dataset).alias("event_dataset"), F.lit("http-request").alias("event_action"),
        F.when(status >= 400, "failure").otherwise("success").alias("event_outcome"),
        word("_who", 0).alias("source_ip"), word("_req", 0).alias("http_request_method"),
        F.lower(word("_req", 1)).alias("url_path"), status.alias("http_response_status_code"),
        F.when(size == "-", F.lit(0)).otherwise(size.try_cast("bigint")).cast("bigint")
        .alias("network_bytes"),
        F.lit("inbound").alias("network_direction"), clean(word("_who", 2)).alias("user_name"),
        F.array(F.concat(F.lit("ua:"), agent)).alias("tags"),
        line.alias("event_original")
    ).drop("_q", "_who", "_req", "_res")


def parse_syslog(df: DataFrame, dataset: str = "auth", aliases=None) -> DataFrame:
    """``Mon d HH:MM:SS host prog[pid]: k=v k="v" ...``

    Plain sshd sentences without key=value pairs still yield an action and a source address.
    """
    df = _lines(df)
    line = F.col("_line")
    part = lambda n: F.regexp_extract(line, SYSLOG_LINE, n)
    df = _rejected(df, F.when(~line.rlike(SYSLOG_LINE), "syslog line shape"))
    df = df.withColumn("_body", part(5)).withColumn("_prog", part(3)).withColumn("_host", part(2)) \
           .withColumn("_ts", part(1))
    body = F.col("_body")
    token = lambda t, n: F.regexp_extract(t, KEY_VALUE, n)
    pairs = F.transform(F.regexp_extract_all(body, F.lit(KEY_VALUE), F.lit(0)), lambda t: F.struct(
        F.when(token(t, 1) != "", token(t, 1)).otherwise(token(t, 3)).alias("key"),
        F.when(token(t, 1) != "", F.regexp_replace(token(t, 2), r'\\"', '"'))
        .otherwise(token(t, 4)).alias("value")))
    df = df.withColumn("_pairs", pairs).withColumn("raw", last_wins(F.col("_pairs")))
    kv = lambda k: F.when(F.col("raw").getItem(k) != "", F.col("raw").getItem(k))
    failed, accepted = body.contains("Failed"), body.contains("Accepted")
    spoken_ip = F.regexp_extract(body, r"\bfrom (\S+)", 1)
    return df.select(
        "*", F.lit(dataset).alias("event_dataset"),
        F.coalesce(kv("action"), F.when(failed, "authentication-failure")
                   .when(accepted, "authentication-success")
                   .otherwise("syslog-message")).alias("event_action"),
        F.coalesce(kv("outcome"), F.when(failed, "failure").otherwise("success"))
        .alias("event_outcome"),
        F.coalesce(kv("ip"), F.when(spoken_ip != "", spoken_ip)).alias("source_ip"),
        kv("user").alias("user_name"), F.col("_host").alias("host_name"),
        F.lower(F.col("_prog")).alias("process_name"),
        line.alias("event_original"),
        F.array(F.concat(F.lit("prog:"), F.col("_prog"))).alias("tags"),
        F.map_filter("raw", lambda k, v: ~k.isin([*vendor_names("SSH", aliases), *FIELDS])).alias("extra"),
        F.map_filter("raw", lambda k, v: k.isin(vendor_names("SSH", aliases))).alias("vendor")
    ).drop("_pairs", "_body", "_prog", "_host")


def _fields(line: Column, delimiter: str) -> Column:
    return F.split(line, "\\Q" + delimiter + "\\E", -1)


def parse_delimited(df: DataFrame, header: str, delimiter: str = ",",
                    dataset: str | None = None, source_type: str | None = None, aliases=None) -> DataFrame:
    """Delimited rows under a known header line.

    One overflow column after the header's own catches rows with too many fields (an error);
    short rows are accepted with nulls.  Header lines count as lines but are no records.
    """
    names = [n.strip() for n in header.rstrip("\r\n").split(delimiter)]
    df = _lines(df).withColumn("_header", F.col("_line") == header.rstrip("\r\n"))
    columns = ", ".join(f"`c{i}` string" for i in range(len(names)))
    row = F.from_csv(F.col("_line"), F.lit(f"{columns}, `_overflow` string"),
                     {"sep": delimiter, "nullValue": "\u0000", "emptyValue": ""})
    df = df.withColumn("_row", row)
    # an empty unquoted overflow field reads as null, so unquoted lines are also counted directly
    too_long = F.col("_row._overflow").isNotNull() | (
        ~F.col("_line").contains('"') & (F.size(_fields(F.col("_line"), delimiter)) > len(names)))
    df = _rejected(df, F.when(too_long & ~F.col("_header"), "csv field count"))
    cell = {n: F.trim(F.col(f"_row.c{i}")) for i, n in enumerate(names)}
    vendors = set(vendor_names(source_type, aliases))

    def cells(wanted):
        some = [F.when(clean(c).isNotNull(), F.struct(F.lit(n).alias("key"), c.alias("value"))) for n, c in cell.items() if wanted(n)]
        return F.map_from_entries(F.array_compact(F.array(*some))) if some else F.lit(None).cast("map<string,string>")
    return df.withColumns({
        "raw": F.struct(*[c.alias(n) for n, c in cell.items()]),
        "extra": cells(lambda n: n not in vendors and n not in FIELDS), "vendor": cells(lambda n: n in vendors),
        "event_dataset": F.lit(dataset), "_blank": F.col("_blank") | F.col("_header"),
    }).drop("_row", "_header")


def raw_field(df: DataFrame):
    """Accessor for vendor fields: ``name -> Column``, or None where the format has no such field."""
    kind = df.schema["raw"].dataType if "raw" in df.columns else None
    def get(name: str):
        if isinstance(kind, T.StructType):
            return F.col("raw").getField(name) if name in kind.fieldNames() else None
        if isinstance(kind, T.MapType) and "." not in name:
            return F.col("raw").getItem(name)
        return None
    return get


def timestamp_text(df: DataFrame) -> Column:
    """The vendor timestamp of a parsed record."""
    if "_ts" in df.columns:
        return F.col("_ts")
    get = raw_field(df)
    return F.coalesce(*[c for c in (get("@timestamp"), get("ts")) if c is not None],
                      F.lit(None).cast("string"))
