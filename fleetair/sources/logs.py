"""Sensor logs, text lines and parameters: reading and writing."""

from __future__ import annotations

import csv
import json
import re
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetair.schema import (
    LOG,
    LOG_DECIMALS,
    OUTPUT_LINE_FIELDS,
    READINGS,
    SCAN_LINE_FIELDS,
)

# Leading fields that must parse for a line to count.
MIN_GOOD_FIELDS = 10


def scan_sensor_log(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = LOG, bad: str | None = None
) -> DataFrame:
    """Read CSV logs into one table.

    Each file's columns are matched by the names in its own header; one that a file lacks is
    NULL. Headers come from a pass over the files' first blocks, and files of one header are read
    together. The device is the column ``device_id``, or, in logs without it, the file's name
    without ``.csv``. A field that is no value of its column is NULL; ``bad`` names a
    column that then has the line, so that such rows can be counted (see ``plans.losses``).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    groups = _by_header(spark, paths)
    parts = [
        _read_csv(spark, header, paths if len(groups) == 1 else [_literal(f) for f in files], schema, bad)
        for header, files in groups]
    if not parts:
        columns = [T.StructField("device_id", T.StringType()), *schema.fields, *([T.StructField(bad, T.StringType())] if bad else [])]
        return spark.createDataFrame([], T.StructType(columns))
    return union_logs(*parts)


def _by_header(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], list[str]]]:
    """The distinct headers, and the files that have each."""
    lines = spark.read.text(paths).select(
        _file_path().alias("file"), F.col("_metadata.file_block_start").alias("at"), "value",
        F.monotonically_increasing_id().alias("line"))
    heads = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    found = heads.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [(next(csv.reader([r["header"]])), r["files"]) for r in found]


def _file_path() -> Column:
    """The file a row comes from, spelled as the reader wants it."""
    return F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))


def _literal(path: str) -> str:
    """A path whose characters are no pattern."""
    return re.sub(r"([][{}*?\\])", r"\\\1", path)


def _read_csv(spark: SparkSession, header: list[str], files: list[str], schema: T.StructType, bad: str | None) -> DataFrame:
    kinds = {f.name: f.dataType for f in schema.fields}
    found = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if bad:
        found = found.add(bad, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", bad)
    logs = reader.schema(found).csv(files)
    stem = F.regexp_extract(_file_path(), r"([^/]+?)(\.csv)?$", 1)
    device = F.col("device_id") if "device_id" in header else stem
    return logs.select(device.alias("device_id"), *[
        F.col(f.name) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields], *([bad] if bad else []))


def union_logs(*dfs: DataFrame) -> DataFrame:
    """All rows of several logs; a column that one lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


_FLOAT = r"(?i)^[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|nan|inf|infinity)$"
_WHOLE = r"^[+-]?\d+$"


def _number(text: Column, kind: str) -> Column:
    """A field as C's scanf reads it, ``nan`` and ``inf`` included; NULL if it is none.

    A field that ends in a digit and has no hexadecimal x is what a cast makes of it; the pattern
    is for the others alone.
    """
    plain = F.substring(text, -1, 1).between("0", "9") & ~F.contains(F.lower(text), F.lit("x"))
    known = F.when(text.rlike(_FLOAT if kind in ("double", "float") else _WHOLE), text)
    return F.when(plain, text.try_cast(kind)).otherwise(F.regexp_replace(known, r"(?i)^[+-](nan)$", "$1").try_cast(kind))


def _parse(df: DataFrame, col: str, fields: list[tuple[str, str]], min_good: int) -> DataFrame:
    """Positional parse. Fields from the first bad one on are NULL; ``line_ok``
    tells whether enough fields came before it."""
    cut = df.withColumn("_f", F.split(F.btrim(F.col(col), F.lit(" \r\n")), ","))
    values = F.struct(*[
        _number(F.btrim(F.get("_f", F.lit(i))), kind).alias(name) for i, (name, kind) in enumerate(fields)])
    # The explode of one element keeps the filter on the fields above the parse;
    # pushed below, it would parse the line again for each field it looks at.
    parsed = cut.select("*", F.explode(F.array(values)).alias("_v")).drop("_f")
    missing = F.array(*[F.col(f"_v.{name}").isNull() for name, _ in fields])
    parsed = parsed.withColumn("_bad", F.array_position(missing, True))
    before_bad = {
        name: F.when((F.col("_bad") == 0) | (F.col("_bad") > i + 1), F.col(f"_v.{name}"))
        for i, (name, _) in enumerate(fields)
    }
    ok = (F.col("_bad") == 0) | (F.col("_bad") > min_good)
    return parsed.withColumns({**before_bad, "line_ok": F.coalesce(ok, F.lit(False))}).drop("_v", "_bad")


def parse_output_lines(df: DataFrame, col: str = "line", keep_bad: bool = False) -> DataFrame:
    """The 17-field output line to readings.

    A line is accepted when its first ten fields parse. The compensated
    temperature and humidity become ``temperature`` and ``humidity``. With
    ``keep_bad`` rejected lines stay, marked by ``line_ok``.
    """
    parsed = _parse(df, col, OUTPUT_LINE_FIELDS, MIN_GOOD_FIELDS)
    rest = [c for c in df.columns if c != col]
    out = parsed.select(
        *rest, "sens_no", (F.col("timestamp_s") * 1000).alias("timestamp_ms"),
        F.col("comp_temp").alias("temperature"), F.col("comp_hum").alias("humidity"),
        "pressure", "iaq", "iaq_accuracy", "static_iaq",
        F.col("co2").alias("co2_equiv"), F.col("voc").alias("breath_voc"),
        F.col("gas").alias("gas_resistance"),
        "raw_temp", "raw_hum", "gas_pct", "stab", "runin", "status", "line_ok",
    )
    return out if keep_bad else out.where("line_ok").drop("line_ok")


def parse_scan_lines(df: DataFrame, col: str = "line", keep_bad: bool = False) -> DataFrame:
    """The 16-field gas-scan line; accepted by the same rule."""
    parsed = _parse(df, col, SCAN_LINE_FIELDS, MIN_GOOD_FIELDS)
    rest = [c for c in df.columns if c != col]
    out = parsed.select(
        *rest, "sens_no", (F.col("timestamp_s") * 1000).alias("timestamp_ms"),
        *[name for name, _ in SCAN_LINE_FIELDS[2:]], "line_ok",
    )
    return out if keep_bad else out.where("line_ok").drop("line_ok")


def log_decimals(df: DataFrame) -> DataFrame:
    """Round each log column to the decimals it is written with (half up)."""
    return df.withColumns({
        c: F.round(F.col(c).cast("double"), n)
        for c, n in LOG_DECIMALS.items() if c in df.columns
    })


def _fixed(c: str) -> Column:
    """A rounded column as text with all its decimals."""
    return F.round(F.col(c).cast("double"), LOG_DECIMALS[c]).cast(f"decimal(38,{LOG_DECIMALS[c]})")


# Rows per file; a hot device spreads over many files.
MAX_RECORDS_PER_FILE = 5_000_000
# Folders that devices are dealt to. Reading one device's log reads one of them.
BUCKETS = 64


def _bucket(device: Column) -> Column:
    return F.pmod(F.xxhash64(device.cast("string")), F.lit(BUCKETS)).cast("int")


#: What is in force of a log: one row for every change that was completed.
MANIFEST = "generation long, folder string, kind string, device string, columns string"


def write_sensor_log(
    df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet", ts: str = "ts"
) -> None:
    """Write readings to a log, in files by a hash bucket of the device and by month.

    The device stays a column of the data, so that any id comes back as it was. Rows
    are cut by (bucket, device, time) range before the write: each task holds a
    stretch of few devices, so a folder gets few files, and a hot device is shared by
    many tasks. A write is a generation with a folder of its own and counts from the
    moment the manifest names it, the last thing written; with ``overwrite`` the generations
    before it count no more. One job writes a log at a time, any number may read it.

    ``csv`` writes plain files without generations: the device and the log columns, with their fixed
    decimals and a header per file; in it an empty id is NULL.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown log format {fmt!r}")
    if fmt == "csv":
        rounded = df.withColumns({c: _fixed(c) for c in LOG_DECIMALS if c in df.columns})
        columns = ["device_id", *[f.name for f in LOG.fields if f.name in df.columns]]
        _write(rounded.select(*dict.fromkeys([*columns, ts])), path, mode, fmt, ts, columns)
        return
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode must be 'append' or 'overwrite', not {mode!r}")
    _change(log_decimals(df), path, "append" if mode == "append" else "restart", None, ts)


def _write(df: DataFrame, path: str, mode: str, fmt: str, ts: str, columns: list[str]) -> None:
    (
        df.withColumns({"bucket": _bucket(F.col("device_id")), "period": F.date_format(ts, "yyyy-MM")})
        .repartitionByRange("bucket", "device_id", ts)
        # The writer wants its folders in order; with them first it keeps our sort.
        .sortWithinPartitions("bucket", "period", "device_id", ts)
        .select(*columns, "bucket", "period")
        .write.partitionBy("bucket", "period").mode(mode)
        .option("header", True).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .format(fmt).save(path)
    )


def _change(df: DataFrame, path: str, kind: str, device: str | None, ts: str) -> None:
    """Write rows as a new generation, then let it count."""
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    _write(df, f"{path}/rows/folder={folder}", "errorifexists", "parquet", ts, df.columns)
    last = _manifest(spark, path).agg(F.max("generation")).first()[0] or 0
    _publish(spark, path, (last + 1, folder, kind, device, df.schema.json()))


def _publish(spark: SparkSession, path: str, entry: tuple) -> None:
    spark.createDataFrame([entry], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Changes in force: those from the last restart on."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    start = entries.where("kind = 'restart'").agg(F.coalesce(F.max("generation"), F.lit(0)).alias("g")).scalar()
    return entries.where(F.col("generation") >= start)


def replace_log(df: DataFrame, path: str, device: str | None, ts: str = "ts") -> None:
    """Clear one device's log and start it again with its rows of ``df``.

    The rows become a generation that hides the device's earlier ones; no other device is
    read or written. Until the manifest names the generation the old log is what readers
    see, so a job lost on the way leaves it as it was. With no rows the device's log becomes empty.
    """
    wanted = F.col("device_id").cast("string").eqNullSafe(F.lit(device))
    _change(log_decimals(df.where(wanted)), path, "replace", device, ts)


def compact_log(spark: SparkSession, path: str, ts: str = "ts") -> None:
    """Write what is in force as one generation; the folders before it are no longer read."""
    _change(read_log(spark, path).drop("period"), path, "restart", None, ts)


def read_log(spark: SparkSession, path: str, device: str | None = None) -> DataFrame:
    """What is in force of a log; with ``device`` only its bucket is read."""
    manifest = _manifest(spark, path)
    kinds: dict[str, T.StructField] = {}  # every column that a generation has
    for r in manifest.groupBy("columns").agg(F.min("generation").alias("g")).orderBy("g").collect():
        for field in T.StructType.fromJson(json.loads(r["columns"])).fields:
            kinds.setdefault(field.name, T.StructField(field.name, field.dataType))
    folders = [T.StructField(c, k) for c, k in (("folder", T.StringType()), ("bucket", T.IntegerType()), ("period", T.StringType()))]
    log = spark.read.schema(T.StructType([*kinds.values(), *folders])).parquet(f"{path}/rows")
    if device is not None:
        log = log.where((F.col("bucket") == _bucket(F.lit(device))) & (F.col("device_id").cast("string") == device))
    live = manifest.select(F.col("folder").alias("_folder"), "generation")
    cleared = manifest.where("kind = 'replace'").groupBy(F.col("device").alias("_device")).agg(F.max("generation").alias("_since"))
    seen = log.join(live, F.col("folder") == F.col("_folder")).join(
        cleared, F.col("device_id").cast("string").eqNullSafe(F.col("_device")), "left")
    return seen.where("_since IS NULL OR generation >= _since").drop("bucket", "folder", "_folder", "generation", "_device", "_since")


def export_log(spark: SparkSession, path: str, out: str, ts: str = "ts") -> None:
    """The whole log as CSV in device and time order."""
    log = read_log(spark, path).drop("period")
    first = [c for c in ("device_id", ts) if c in log.columns]
    rest = [c for c in log.columns if c not in first]
    (
        log.select(*first, *rest).sort(*first).write.mode("overwrite").option("header", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
    )


def stream_readings(
    spark: SparkSession, path: str, schema: T.StructType = READINGS, fmt: str = "parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """Readings as they arrive in a folder; a bounded number of files per batch."""
    return (
        spark.readStream.schema(schema).format(fmt)
        .option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def save_scaler_params(params: DataFrame, path: str) -> None:
    """Persist (feature, mean, scale): a row per feature, one file."""
    params.coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
