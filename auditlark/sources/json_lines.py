"""JSON event logs and JSON records with varying field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import registry as R
from ..functions.text import lstrip, strip
from ..functions.times import coerce_us, iso_utc

STRICT = {"allowSingleQuotes": "false"}
END = "~eol~"


def with_json(df: DataFrame, text: str) -> DataFrame:
    """Add ``_value``, the text of a line that is exactly one JSON value, and ``_json``,
    its fields when the value is an object; null for anything else.

    Each step is a column of its own, so a line is parsed once per step.
    """
    # Only lines that begin like JSON reach the parser.
    likely = F.col(text).rlike(r'^\s*[\[{"\-0-9tfnNI]')
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]')), "array<string>", STRICT)
    whole = (F.size("_w") == 2) & (F.try_element_at("_w", F.lit(2)) == END)
    df = df.withColumn("_w", F.when(likely, wrapped))
    df = df.withColumn("_value", F.when(whole, F.coalesce(F.get("_w", F.lit(0)), F.lit("null")))).drop("_w")
    is_object = F.col("_value").startswith("{") & lstrip(text).startswith("{")
    return df.withColumn("_json", F.when(is_object, F.from_json("_value", "map<string,string>", STRICT)))


def first_field(fields: Column, names: tuple[str, ...]) -> Column:
    """First non-empty value among alternative names."""
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in names])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as rows (``line``); splittable, so large files spread over tasks."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse_jsonl_events(lines: DataFrame, ingest_us: int, line: str = "line") -> DataFrame:
    """Event log lines to events; blank and ``#`` lines are skipped, bad JSON becomes RAW."""
    text = strip(F.col(line))
    rows = lines.withColumn("_t", text).where((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    rows = with_json(rows, "_t").withColumnRenamed("_json", "_f")
    good = F.col("_f").isNotNull()

    def field(name: str, default: Column) -> Column:
        return F.coalesce(F.try_element_at("_f", F.lit(name)), default)

    ts_us = F.coalesce(coerce_us(F.try_element_at("_f", F.lit("ts"))), F.lit(ingest_us))
    return rows.select(
        *[c for c in lines.columns if c != line],
        ts_us.alias("ts_us"),
        F.coalesce(F.try_element_at("_f", F.lit("iso")), iso_utc(ts_us)).alias("iso"),
        F.when(good, F.upper(field("event", F.lit("")))).otherwise("RAW").alias("event"),
        field("user", F.lit("-")).alias("user"),
        field("src_ip", F.lit("0.0.0.0")).alias("src_ip"),
        field("host", F.lit("-")).alias("host"),
        field("asset_class", F.lit(R.CLASS_STANDARD)).alias("asset_class"),
        F.when(good, F.try_element_at("_f", F.lit("msg"))).otherwise(F.substring("_t", 1, 400)).alias("msg"),
        F.try_element_at("_f", F.lit("vector")).alias("vector"),
        F.try_element_at("_f", F.lit("site")).alias("site"),
        F.try_element_at("_f", F.lit("url")).alias("url"),
        F.try_element_at("_f", F.lit("http_status")).try_cast("int").alias("http_status"),
        F.try_element_at("_f", F.lit("user_agent")).alias("user_agent"),
    )


def read_events(spark: SparkSession, path: str, ingest_us: int) -> DataFrame:
    """Batch read of JSONL event logs; the streaming twin is in ``streaming``."""
    return parse_jsonl_events(read_lines(spark, path), ingest_us)


def normalize_fields(rows: DataFrame, fields: str, raw: str, ingest_us: int, parsed: str) -> DataFrame:
    """Canonical columns from a map column of lower-cased names."""
    f = F.col(fields)
    times = [coerce_us(F.try_element_at(f, F.lit(n))) for n in R.TIME_ALIASES]
    ts_us = F.coalesce(*times, F.lit(ingest_us))
    named = {c: first_field(f, a) for c, a in R.FIELD_ALIASES.items()}
    keep = [c for c in rows.columns if c not in (fields, raw)]
    return rows.select(
        *keep,
        ts_us.alias("ts_us"),
        iso_utc(ts_us).alias("iso"),
        F.coalesce(named["event"], F.lit("JSON_LOG")).alias("event"),
        F.coalesce(named["user"], F.lit("-")).alias("user"),
        F.coalesce(named["src_ip"], F.lit("0.0.0.0")).alias("src_ip"),
        F.coalesce(named["host"], F.lit("-")).alias("host"),
        F.coalesce(named["msg"], F.substring(raw, 1, 400)).alias("msg"),
        f.alias("raw_fields"),
        F.lit(parsed).alias("parsed"),
    )


def lower_keys(fields: Column) -> Column:
    return F.transform_keys(fields, lambda k, _: F.lower(k))


def normalize_json_logs(lines: DataFrame, ingest_us: int, line: str = "line") -> DataFrame:
    """JSON records of other tools; lines that are not objects are dropped."""
    rows = (
        with_json(lines.withColumn("_raw", strip(F.col(line))).drop(line), "_raw")
        # Dropping other lines by the generator keeps the filter from repeating the parse.
        .withColumn("_f", F.explode(F.array("_json")))
        .where("_f IS NOT NULL")
        .withColumn("_f", lower_keys(F.col("_f")))
        .drop("_json", "_value")
    )
    return normalize_fields(rows, "_f", "_raw", ingest_us, "json_log")


def check_csv_header(header: list[str]) -> None:
    known = {a for names in R.FIELD_ALIASES.values() for a in names} | set(R.TIME_ALIASES)
    if not {h.strip().lower() for h in header if h} & known:
        raise ValueError(f"no recognizable log columns in {sorted(header)[:8]}")


def normalize_csv_rows(rows: DataFrame, ingest_us: int, columns: list[str] | None = None) -> DataFrame:
    """String columns of a CSV log to canonical events; ``columns`` are the CSV ones."""
    columns = columns or rows.columns
    check_csv_header(columns)
    pairs = [x for c in columns for x in (F.lit(c.strip().lower()), strip(F.col(f"`{c}`")))]
    row_json = F.to_json(F.struct(*[strip(F.col(f"`{c}`")).alias(c.strip()) for c in columns]))
    keep = [c for c in rows.columns if c not in columns]
    mapped = rows.select(*keep, F.create_map(*pairs).alias("_f"), row_json.alias("_raw"))
    return normalize_fields(mapped, "_f", "_raw", ingest_us, "csv_import")


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, first): the records of CSV files whose quoted fields may hold line breaks; ``first`` marks each file's first line.

    Files are read as lines by splits. Whether a line begins inside quotes is the parity of the
    quotes before it: within its split a running sum, before its split the sum of one number per earlier
    split. Most records are one line; only lines of longer ones are brought together.
    An unclosed quote makes the rest of its file one record.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
    ).withColumn("odd", (F.length("value") - F.length(F.translate("value", '"', ""))) % 2)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    open_ = lines.groupBy("file", "split").agg(F.sum("odd").alias("odd"), F.min("id").alias("begin"))
    open_ = open_.select("file", "split", "begin", F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("file", "split").orderBy("id")
    upto = F.coalesce(F.sum("odd").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(open_, ["file", "split"]).withColumn("inside", (F.col("before") + upto) % 2 == 1)
    marked = marked.withColumn("first", (F.col("split") == 0) & (F.col("id") == F.col("begin")))
    whole = ~F.col("inside") & (F.col("odd") == 0)
    # A record of several lines is named by its first one, which may lie in an earlier split.
    broken = marked.where(~whole).withColumn("start", F.when(~F.col("inside"), F.col("id")))
    last = broken.groupBy("file", "split").agg(F.max("start").alias("start"))
    carried = last.select("file", "split", F.last("start", ignorenulls=True).over(earlier).alias("carried"))
    named = broken.join(carried, ["file", "split"]).withColumn("start", F.coalesce(F.max("start").over(own.rowsBetween(Window.unboundedPreceding, 0)), "carried"))
    parts = F.array_sort(F.collect_list(F.struct("split", "id", "value")))
    joined = named.groupBy("file", "start").agg(F.array_join(F.transform(parts, lambda p: p.value), "\n").alias("value"), F.max("first").alias("first"))
    return marked.where(whole).select("file", "value", "first").unionByName(joined.select("file", "value", "first"))


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, first): the records of CSV files whose quoted fields may hold line breaks; ``first`` marks each file's first line.

    Files are read as lines by splits. Whether a line begins inside quotes is the parity of the
    quotes before it: within its split a running sum, before its split the sum of one number per earlier
    split. Most records are one line; only lines of longer ones are brought together.
    An unclosed quote makes the rest of its file one record.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
    ).withColumn("odd", (F.length("value") - F.length(F.translate("value", '"', ""))) % 2)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    open_ = lines.groupBy("file", "split").agg(F.sum("odd").alias("odd"), F.min("id").alias("begin"))
    open_ = open_.select("file", "split", "begin", F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("file", "split").orderBy("id")
    upto = F.coalesce(F.sum("odd").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = lines.join(open_, ["file", "split"]).withColumn("inside", (F.col("before") + upto) % 2 == 1)
    marked = marked.withColumn("first", (F.col("split") == 0) & (F.col("id") == F.col("begin")))
    whole = ~F.col("inside") & (F.col("odd") == 0)
    # A record of several lines is named by its first one, which may lie in an earlier split.
    broken = marked.where(~whole).withColumn("start", F.when(~F.col("inside"), F.col("id")))
    last = broken.groupBy("file", "split").agg(F.max("start").alias("start"))
    carried = last.select("file", "split", F.last("start", ignorenulls=True).over(earlier).alias("carried"))
    named = broken.join(carried, ["file", "split"]).withColumn("start", F.coalesce(F.max("start").over(own.rowsBetween(Window.unboundedPreceding, 0)), "carried"))
    parts = F.array_sort(F.collect_list(F.struct("split", "id", "value")))
    joined = named.groupBy("file", "start").agg(F.array_join(F.transform(parts, lambda p: p.value), "\n").alias("value"), F.max("first").alias("first"))
    return marked.where(whole).select("file", "value", "first").unionByName(joined.select("file", "value", "first"))


def import_csv_logs(spark: SparkSession, path: str, ingest_us: int, delimiter: str = ",",
                    max_rows: int | None = None, multi_line: bool = False) -> DataFrame:
    """CSV log files with a header row; ``multi_line`` keeps quoted line breaks inside a record, and large files are many tasks all the same."""
    options = {"sep": delimiter, "escape": '"'}
    rows = spark.read.options(header=True, **options).csv(path)
    if multi_line:
        records = quoted_records(spark, path).where("NOT first AND value <> ''")
        fields = ", ".join(f"`{c}` string" for c in rows.columns)
        rows = records.select(F.from_csv("value", fields, options).alias("c")).select("c.*")
    if max_rows is not None:
        rows = rows.limit(max_rows)
    return normalize_csv_rows(rows, ingest_us)
