"""CSV, Parquet and JSON scans and sinks, and the materialisation status report."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailsift.functions import fixed_values as V
from mailsift.workspace import sized

SPAM_CORPUS_SCHEMA = "text string, label int, `group` string"
GENERAL_CORPUS_SCHEMA = "`Unnamed: 0` int, `Email Text` string, `Email Type` string"
SYNTHETIC_SCHEMA = "email_type string, subcategory string, subject string, body string, source string"
MAIL_SCHEMA = (
    "row_id bigint, text string, label string, source_dataset string, subcategory string, included_in_training boolean"
)

_CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "enforceSchema": False}


def read_csv(spark: SparkSession, path: str | list[str], schema: str, split_files: bool = True, **options) -> DataFrame:
    """Quoted multi-line CSV with a header and a declared schema; adds a row id from file and place in it.

    ``path`` may be a glob. Files are read in byte ranges by many tasks, which asks that quotes stand in quoted cells only,
    as writers of CSV see to. Without ``split_files`` a file is read whole by one task, stray quotes and all; ids
    are then numbers of rows. A header that does not name the schema's columns is an error unless ``enforceSchema``.
    """
    if split_files:
        return _read_ranges(spark, path, schema, **options)
    settings = {**_CSV, **options}
    rows = spark.read.options(**settings).schema(schema).csv(path)
    rows = rows.withColumn("message_no", F.col("_metadata.file_path"))
    return rows.mapInArrow(_numbered_in_file, rows.schema)


def _numbered_in_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append each row's number within its file to the file's name; a file's rows are in one task and in order."""
    file, number = None, 0
    for batch in batches:
        at = batch.schema.get_field_index("message_no")
        names = []
        for name in batch.column(at).to_pylist():
            file, number = (file, number + 1) if name == file else (name, 0)
            names.append(f"{name}#{number:012d}")
        yield batch.set_column(at, batch.schema.field(at), pa.array(names, batch.schema.field(at).type))


# Parts of records in a byte range: whole records, one that is open at the range's end, a range within one, and its end.
_WHOLE, _OPENS, _WITHIN, _CLOSES = range(4)
_PIECES = "path string, block bigint, place bigint, kind int, text binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the lines of byte ranges, which arrive range by range and in order.

    A line opens a record if the quotes in front of it in the file are even in number; ``odd`` tells that of a range.
    """
    key, held, odd, inside, place, start = None, [], False, False, 0, 0
    out: list[tuple] = []

    def leftover():
        if held:
            out.append((*key, start, _WITHIN if inside else _OPENS, b"\n".join(held)))

    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("path", "block", "odd", "base", "raw"))
        for path, block, range_odd, base, raw in zip(*columns):
            if (path, block) != key:
                leftover()
                key, held, odd, inside, place = (path, block), [], range_odd, range_odd, base
            if not held:
                start = place
            place += len(raw) + 1
            held.append(raw)
            odd ^= raw.count(b'"') % 2 == 1
            if not odd:
                out.append((path, block, start, _CLOSES if inside else _WHOLE, b"\n".join(held)))
                held, inside = [], False
        if out:
            yield _as_batch(out)
            out.clear()
    if key is not None:
        leftover()
    if out:
        yield _as_batch(out)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in _PIECES.split(", ")])


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, place, text``: the records of CSV files and the bytes in front of each in its file.

    Quotes and bytes are first summed by range, so every range knows the parity and the place at its start. Records
    that several ranges hold parts of are put together by file; there are few more of them than ranges.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("path", "block").agg(F.sum(quotes).alias("quotes"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    ranges = sized(ranges.select(
        "path", "block", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1).alias("odd"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base")), "csv-ranges")
    # One short row for each range, about a millionth of the files; a join by broadcast keeps the lines in order.
    pieces = lines.join(F.broadcast(ranges), ["path", "block"]).select(
        "path", "block", "odd", "base", F.col("value").cast("binary").alias("raw")).mapInArrow(_pieces, _PIECES)
    whole = pieces.filter(F.col("kind") == _WHOLE).select("path", "place", F.col("text").cast("string").alias("text"))
    opens = F.col("kind") == _OPENS
    in_file = Window.partitionBy("path").orderBy("block", opens).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = pieces.filter(F.col("kind") != _WHOLE).withColumn("record", F.count_if(opens).over(in_file))
    joined = parts.groupBy("path", "record").agg(
        F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", F.col("text").cast("string").alias("text")))).alias("p"))
    return whole.unionByName(joined.select("path", "place", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")))


def _read_ranges(spark: SparkSession, path: str | list[str], schema: str, **options) -> DataFrame:
    settings = {k: str(v) for k, v in {**_CSV, **options, "header": False}.items()}
    kinds = StructType.fromDDL(schema)
    # A CR in front of a line feed belongs to the line's end; within cells, too, lines end with a line feed.
    text = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r$", "")
    records = _records(spark, path).withColumn("text", text).filter("text <> ''")
    if str(options.get("enforceSchema", _CSV["enforceSchema"])).lower() == "true":
        records = records.filter("place > 0")
    else:
        header = F.from_csv("text", F.lit(", ".join(f"`{n}` string" for n in kinds.names)), settings)
        named = F.array(*[header[n] for n in kinds.names]) == F.array(*map(F.lit, kinds.names))
        wrong = F.raise_error(F.concat(F.lit("the CSV header does not name the schema's columns: "), F.col("text"))).cast("boolean")
        records = records.filter(F.when(F.col("place") > 0, True).when(named, False).otherwise(wrong))
    cells = records.withColumn("cells", F.from_csv("text", F.lit(schema), settings))
    number = F.concat_ws("#", "path", F.lpad(F.col("place").cast("string"), 15, "0"))
    return cells.select("cells.*", number.alias("message_no"))


def read_csv_folder(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All files of a glob as one table; an empty table with the schema if nothing matches."""
    if not path_exists(spark, pattern):
        return spark.createDataFrame([], StructType.fromDDL(schema + ", message_no string"))
    return read_csv(spark, pattern, schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(
        header=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def label_column(df: DataFrame) -> str | None:
    """The first known label column a table has."""
    return next((name for name in V.LABEL_COLUMN_CANDIDATES if name in df.columns), None)


def class_balance(df: DataFrame) -> DataFrame:
    """Row counts by whichever known label column the table has; empty if it has none."""
    name = label_column(df)
    if name is None:
        return df.sparkSession.createDataFrame([], "label string, rows bigint")
    return df.groupBy(F.col(name).cast("string").alias("label")).agg(F.count("*").alias("rows"))


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per row."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def path_exists(spark: SparkSession, pattern: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.globStatus(hadoop))


def materialise_once(df: DataFrame, path: str, name: str) -> DataFrame:
    """Write a Parquet table unless it is already there; report state and row count."""
    spark = df.sparkSession
    present = path_exists(spark, f"{path}/_SUCCESS")
    if not present:
        df.write.mode("ignore").parquet(path)
    return status(spark, path, name, "skipped (already present)" if present else "written fresh")


def status(spark: SparkSession, path: str, name: str, state: str) -> DataFrame:
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return spark.createDataFrame([(name, "MISSING", None)], "dataset string, state string, rows bigint")
    return spark.read.parquet(path).agg(
        F.lit(name).alias("dataset"), F.lit(state).alias("state"), F.count("*").alias("rows")
    )
