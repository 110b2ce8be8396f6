"""Parquet tables by name, page and chunk files as JSON, question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ordering import positions
from quern.shared import materialize

PAGE = "book string, chapter string, section string, source_url string, title string, text string, char_count int"
CHUNK = "chunk_id string, book string, chapter string, section string, source_url string, text string"
QUESTION = "question string, expected_chapter string, expected_answer string, type string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _listed(spark: SparkSession, path: str, schema: str, what: str, field: str | None = None) -> DataFrame:
    """Rows of a JSON array file with their position; a missing file or no rows raise."""
    try:
        whole = spark.read.text(path, wholetext=True)
        rows = F.from_json("value", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
        if field:
            inner = F.from_json("value", f"{field} array<struct<{schema}>>")[field]
            rows = F.when(F.ltrim("value").startswith("{"), inner).otherwise(rows)
        out = whole.select(F.posexplode(rows).alias("position", "row")).select(F.col("position").cast("long"), "row.*")
        empty = out.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no {what} at {path}") from e
        raise
    if empty:
        raise ValueError(f"no {what} in {path}")
    return out


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records with their position; anything but an array, or an empty one, is a ValueError."""
    return _read_array(spark, path, PAGE, "pages")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _read_array(spark, path, CHUNK, "chunks")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A bare list, or an object whose field ``questions`` is one."""
    return _listed(spark, path, QUESTION, "questions", "questions")


def write_json(rows: DataFrame, path: str, order: list[str]) -> None:
    """A folder of text files that together, in name order, are one JSON array: an object a line, in order.

    Every line but the array's first begins with its comma, so tasks write their parts by themselves. ``read_pages`` and
    ``read_chunks`` read the folder back, null fields included; so does any JSON reader, of the files put together."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    placed = materialize(spark, ordered.select(line.alias("line"), F.monotonically_increasing_id().alias("at")), "json")
    least, most = placed.agg(F.min("at"), F.max("at")).first()
    if least is None:
        spark.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    value = F.concat(F.when(F.col("at") == least, "[").otherwise(","), "line", F.when(F.col("at") == most, "]").otherwise(""))
    # By range again, so that files in name order are in row order whatever the scan's splits were.
    placed.repartitionByRange("at").sortWithinPartitions("at").select(value.alias("value")).write.mode("overwrite").text(path)


def _read_array(spark: SparkSession, path: str, schema: str, what: str) -> DataFrame:
    """Rows with position of a JSON array: a file, or a folder whose files together are one, or are one each, or hold an object a line.

    A folder is read line by line where every line is whole objects between brackets and commas, as ``write_json`` writes it, and as
    JSON lines and arrays on one line are; else file by file, each an array. What is neither is a ValueError, so no row is lost in silence.
    Files count in the order of their names.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        raise FileNotFoundError(f"no {what} at {path}")
    if not fs.getFileStatus(fs_path).isDirectory():
        whole = spark.read.text(path, wholetext=True)
        if not whole.where(F.ltrim("value").startswith("[")).count():
            raise ValueError(f"{path} must hold a list of {what}")
        return _listed(spark, path, schema, what)
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.text(path).select(F.btrim("value", F.lit(_BLANK)).alias("value"), *place).where("value <> ''")
    bare = F.btrim(F.regexp_replace(F.regexp_replace("value", r"^[\[,]", ""), r"[\],]$", ""), F.lit(_BLANK))
    rows = _parsed(spark, lines.withColumn("value", F.when(bare == "", "[]").otherwise(F.concat(F.lit("["), bare, F.lit("]")))), schema, (bare == "") | bare.startswith("{"))
    if rows is None:
        whole = spark.read.text(path, wholetext=True).select(F.btrim("value", F.lit(_BLANK)).alias("value"), *place).where("value <> ''")
        rows = _parsed(spark, whole, schema, F.col("value").startswith("["))
    if rows is None:
        raise ValueError(f"{path} must hold a list of {what}")
    if rows.isEmpty():
        raise ValueError(f"no {what} in {path}")
    return positions(spark, rows, "all", ["file", "block", "at", "pos"]).select("position", "row.*")


_BLANK = " \t\r\n\ufeff"


def _parsed(spark: SparkSession, texts: DataFrame, schema: str, begins: Column) -> DataFrame | None:
    """A row for each object of the arrays in ``value``, written; none at all if a text is not just an array of objects."""
    parsed = F.from_json("value", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    # Syntax alone decides, so that a field of another type is a null and not the end of its row.
    sound = begins & F.try_parse_json("value").isNotNull() & parsed.isNotNull()
    told = materialize(spark, texts.select("file", "block", "at", F.coalesce(sound, F.lit(False)).alias("sound"), parsed.alias("rows")), "lines")
    if told.where(~F.col("sound")).limit(1).count():
        return None
    return told.select(F.lit(0).alias("all"), "file", "block", "at", F.posexplode("rows").alias("pos", "row"))
