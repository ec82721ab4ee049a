"""Readers and writers for untrusted files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = (",", ";", "\t", "|")
# The first bytes of the two spreadsheet containers.
OLE2, ZIP = "D0CF11E0A1B11AE1", "504B0304"


def delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent delimiter of the header line; a comma if there is none."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0]["value"] if first else ""
    best = max(DELIMITERS, key=line.count)
    return best if line.count(best) else ","


def read_wrapped_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV in which each whole line may be quoted, with or without a byte-order mark; each file's header line goes.

    A line is unwrapped if it is one quoted field as a whole; rows that begin and end with quoted fields
    are left as they are, and so are rows that repeat the header.
    """
    line = F.regexp_replace("value", "^\ufeff", "")
    whole = line.rlike('^"([^"]|"")*+"$') & line.contains(sep)
    bare = F.when(whole, F.replace(F.regexp_replace(line, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(line)
    names = T.StructType.fromDDL(schema).fieldNames()
    rows = spark.read.text(path).select(F.trim(bare).alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where("line <> ''")
    is_header = F.lower(F.regexp_replace("line", r"\s", "")) == sep.join(names).lower()
    # only lines like the header meet in the window
    first = rows.where(is_header).withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where("k > 1").select("line")
    kept = rows.where(~is_header).select("line").unionByName(first)
    return kept.select(F.from_csv("line", schema, {"sep": sep}).alias("r")).select("r.*")


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Header names trimmed; columns named `Unnamed...` that hold nothing are dropped."""
    df = df.toDF(*(c.strip() for c in df.columns))
    spare = [c for c in df.columns if c.startswith("Unnamed") or not c]
    if not spare:
        return df
    filled = df.agg(*(F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(spare))).first()
    return df.drop(*(c for i, c in enumerate(spare) if not filled[i]))


#: Kinds of paths whose first bytes tasks can read alone; others are read whole.
RANGED = ("file", "hdfs", "s3", "gs")
HEAD = 512


def read_head(path: str, most: int = HEAD) -> bytes:
    """A file's first bytes, and no more, from a path or address that a listing gave."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        system, name = LocalFileSystem(), "/" + (rest or path).lstrip("/")
    else:
        host, _, name = rest.removeprefix("//").partition("/")
        system, root = FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")
        name = f"{root.rstrip('/')}/{name}"
    with system.open_input_file(name) as f:
        return f.read_at(min(most, f.size()), 0)


def file_heads(spark: SparkSession, path: str, most: int = HEAD) -> DataFrame:
    """(path, length, head): the first bytes of each file under `path`.  Spark lists the files and tasks read only their beginnings, so files may be of any size; empty ones are left out."""
    listed = spark.read.format("binaryFile").load(path)
    scheme = (listed.select("path").head() or [path])[0].split(":", 1)[0]
    if scheme.replace("s3a", "s3") not in RANGED:
        return listed.select("path", "length", F.substring("content", 1, most).alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [read_head(p, most) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(heads, pa.binary())], names=["path", "length", "head"])

    return listed.select("path", "length").mapInArrow(run, "path string, length long, head binary")


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, kind): what files are by their first bytes, whatever their names say; empty files aren't listed."""
    head = F.hex(F.substring("head", 1, 8))
    start = F.lower(F.decode("head", "ISO-8859-1"))
    kind = F.when(head.startswith(OLE2), "ole2").when(head.startswith(ZIP), "zip").when(start.contains("<html") | start.contains("<table"), "html").otherwise("text")
    return file_heads(spark, path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), kind.alias("kind"))


def pretty_json(c: Column) -> Column:
    """JSON text with an indent of two, keys in their order; other text as it is."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                return v if v is None else json.dumps(json.loads(v), indent=2, ensure_ascii=False)
            except ValueError:
                return v

        return values.map(one)

    return run(c)


def read_as_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as a text to work on: JSON files pretty-printed, CSV files with aligned columns, others as they are."""
    docs = read_documents(spark, path)
    name = F.lower("path")
    cells = F.transform(F.filter(F.split("text", "\r?\n"), lambda line: F.trim(line) != ""), lambda line: F.split(line, ","))
    widths = F.aggregate(cells, F.array().cast("array<int>"), lambda acc, row: F.zip_with(acc, F.transform(row, lambda c: F.length(F.trim(c))), lambda a, b: F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))))
    aligned = F.array_join(F.transform(cells, lambda row: F.array_join(F.zip_with(row, widths, lambda c, w: F.lpad(F.trim(F.coalesce(c, F.lit(""))), w, " ")), "  ")), "\n")
    return docs.select("path", F.when(name.endswith(".json"), pretty_json(F.when(name.endswith(".json"), F.col("text")))).when(name.endswith(".csv"), aligned).otherwise(F.col("text")).alias("text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file whole: UTF-8 with or without a mark, else the western code page 1252."""
    raw = spark.read.format("binaryFile").load(path)
    utf8 = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    western = F.translate(F.decode("content", "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), bytes(range(0x80, 0xA0)).decode("cp1252", "replace"))
    return raw.select("path", F.when(F.expr("is_valid_utf8(cast(content as string))"), utf8).otherwise(western).alias("text"))


def ingest_rows(bodies: DataFrame, column: str = "body") -> DataFrame:
    """JSON bodies {dataset, batch_id, rows: [...]} -> (dataset, batch_id, row_no, payload map), a row each; what isn't one gives none."""
    shape = "dataset string, batch_id string, rows array<map<string,string>>"
    b = bodies.select(F.from_json(column, shape).alias("b")).where("b.dataset IS NOT NULL AND b.batch_id IS NOT NULL")
    return b.select("b.dataset", "b.batch_id", F.posexplode("b.rows").alias("row_no", "payload"))


def store(df: DataFrame, path: str, by: str = "dataset") -> None:
    """Events or rows, appended to a table partitioned by data set."""
    df.write.mode("append").partitionBy(by).parquet(path)


def read_text_records(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    source = F.coalesce(F.col("source"), F.lit("unknown")) if "source" in df.columns else F.lit("unknown")
    return df.select(F.trim("text").alias("text"), source.alias("source")).where("text <> ''")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules with or without a header, short rows filled up."""
    schema = "column string, dtype string, min string, max string, allowed_values string, constraints string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path).where("lower(column) <> 'column'")


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a {"policies": [...]} document."""
    schema = "policies array<struct<entity:string,sensitivity_level:string,reason:string,regulation:string,page:string,source_file:string,source:string>>"
    p = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("policies").alias("p")).select("p.*")
    return p.withColumn("source_file", F.coalesce("source_file", "source")).drop("source")


def append_audit(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The newest n audit lines; lines that aren't JSON are kept in `raw`."""
    df = spark.read.schema(schema + ", raw string").option("columnNameOfCorruptRecord", "raw").json(path)
    return df.orderBy(F.desc_nulls_last("ts")).limit(n)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in fixed order, nulls as empty text."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)).write.option("header", True).option("emptyValue", "").csv(path)


def catalogue(spark: SparkSession, path: str, n: int = 200) -> DataFrame:
    """(file, rows, modified) of a folder of text files, newest first."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    return t.groupBy("file").agg(F.count("*").alias("rows"), F.max("modified").alias("modified")).orderBy(F.desc("modified"), "file").limit(n)
