"""Keep the vector index of a collection in step with its pages, taking only what is new.

    python -m jobs.keep_index PAGES OUT CHECKPOINT [--config FILE]

PAGES is a folder (or one file) of Parquet that grows: pages are added, or come again in a later file with another text. OUT gets two
tables, both partitioned by the batch that wrote them:

- ``pages``: a row for each page that a batch found new or changed (page_no, book, digest, copies), the job's mark;
- ``chunks``: that page's windows of words with their vectors, also partitioned by book.

A file stream with a checkpoint hands over each file once. In a batch, a page that came several times counts as it
came last: by the file's time, then its name, then its place in it. Pages whose digest is what OUT holds already are left alone, so that only new text is
cut and embedded. ``current`` reads the index as it stands: of each page, the chunks of the last batch that wrote it.

Rerun: a batch that failed, or whose end the checkpoint never heard of, comes again with the same files. It looks only at what earlier
batches wrote, so it finds the same, and writes over its own partitions. Chunks are written before their pages are marked, and unmarked
chunks are not read, so a reader never sees half a batch.

OUT and CHECKPOINT belong together: with another checkpoint, batches would count anew, so that is an error.

Defined results: rows without a page_no are counted, reported and not indexed, as nothing could cite them; a page whose text became empty leaves
the index; a page without text is marked and has no chunks; pages that vanish from PAGES stay; an empty book is the configured title.
"""

from __future__ import annotations

import argparse
import logging
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import shipped
from quern.operators import chunking
from quern.shared import materialize, spread
from quern.sources import index

log = logging.getLogger("jobs.keep_index")
CONFIG = Path(__file__).with_suffix(".toml")
PAGE_COLUMNS = ("page_no", "book", "chapter", "section", "source_url", "text")
MARKS = "page_no long, book string, digest string, copies long, batch long"
CHUNKS = (
    "page_no long, chunk_no long, start_word int, chunk_id string, chapter string, section string, source_url string, text string, embedding array<double>,"
    " batch long, book string"
)
_TOLD = "file_modification_time", "file_path", "row_index"


@dataclass(frozen=True)
class Config:
    """``columns`` says how each column of a page is made of the input's, in SQL."""

    chunk_size: int = 500
    chunk_overlap: int = 100
    max_files_per_batch: int = 64
    columns: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path = CONFIG) -> Config:
        given = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        config = cls(**given)
        chunking.validate(config.chunk_size, config.chunk_overlap)
        if config.max_files_per_batch < 1:
            raise ValueError("a batch takes one file at least")
        if odd := set(config.columns) ^ set(PAGE_COLUMNS):
            raise ValueError(f"columns must name exactly {', '.join(PAGE_COLUMNS)}; see {', '.join(sorted(odd))}")
        return config


def _held(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame | None:
    """What batches have written to ``path``; none before the first. Their columns' types are told, not guessed from names of folders."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _put(rows: DataFrame, path: str, *by: str) -> None:
    """Writes over the partitions that ``rows`` has, and leaves others; files of one size, however uneven the partitions are."""
    out = rows.hint("rebalance", *by)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def changed_pages(arrived: DataFrame, before: DataFrame | None) -> DataFrame:
    """page_no, book, digest, copies and the place of the row that counts, of each page that is new or other than before.

    ``arrived``: narrow rows. Both sides are summed up by page before they meet, so a page that comes a million times is a row.
    """
    place = F.struct(*_TOLD)
    new = arrived.where("page_no is not null").groupBy("page_no").agg(
        F.max_by(F.struct("book", "digest", *_TOLD), place).alias("last"), F.count("*").alias("copies")
    ).select("page_no", "copies", "last.*")
    if before is None:
        return new
    # Marks of other pages go before anything is shuffled, as all batches' marks are many more than one batch's pages.
    known = before.join(new.select("page_no"), "page_no", "left_semi").groupBy("page_no").agg(F.max_by("digest", "batch").alias("known"))
    return new.join(known, "page_no", "left").where(~F.col("digest").eqNullSafe(F.col("known"))).drop("known")


def take_batch(rows: DataFrame, number: int, out: str, config: Config) -> None:
    """Index what a batch of pages brings. The same batch again writes the same over itself."""
    spark = rows.sparkSession
    arrived = rows.select("page_no", "book", "digest", *_TOLD)
    before = _held(spark, f"{out}/pages", MARKS)
    # Written, as three things below ask for it, and the digests behind it read every text.
    new = materialize(spark, changed_pages(arrived, None if before is None else before.where(F.col("batch") < number)), "changed")
    # Which rows count is asked by place, so what meets them holds no text; a batch's pages bound this side.
    kept = spread(rows).join(new.select("file_path", "row_index"), ["file_path", "row_index"], "left_semi").select(*PAGE_COLUMNS)
    chunks = index.vectors(chunking.nonempty(chunking.chunk_pages(kept, config.chunk_size, config.chunk_overlap)))
    batch = F.lit(number).cast("long").alias("batch")
    _put(chunks.select("*", batch), f"{out}/chunks", "batch", "book")
    _put(new.select("page_no", "book", "digest", "copies", batch), f"{out}/pages", "batch")
    told = arrived.agg(F.count("*").alias("rows"), F.count(F.when(F.col("page_no").isNull(), 1)).alias("unnamed"), F.count_distinct("file_path").alias("files")).first()
    marked, wrote = (spark.read.schema(of).parquet(f"{out}/{t}").where(F.col("batch") == number).count() for t, of in (("pages", MARKS), ("chunks", CHUNKS)))
    log.info("batch %d: read %d rows of %d files, %d of them without page_no", number, told["rows"], told["files"], told["unnamed"])
    log.info("batch %d: wrote %d new or changed pages and their %d chunks below %s", number, marked, wrote, out)


def keep_index(spark: SparkSession, pages: str, out: str, checkpoint: str, config: Config | None = None) -> int:
    """Take all files of ``pages`` that ``checkpoint`` does not know, and say how many batches that took."""
    config = config or Config.load()
    schema = spark.read.parquet(pages).schema
    if _held(spark, f"{out}/pages", MARKS) is not None and _held(spark, f"{checkpoint}/metadata", "value string", "text") is None:
        raise ValueError(f"{out} was kept with another checkpoint than {checkpoint}; its batches have numbers of their own")
    columns = [F.expr(config.columns[c]).alias(c) for c in PAGE_COLUMNS]
    # The last letter as a pattern, as a stream takes folders or patterns only, and this may be a file.
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.max_files_per_batch).parquet(f"{pages[:-1]}[{pages[-1]}]")
    rows = source.select(*columns, *[F.col(f"_metadata.{c}").alias(c) for c in _TOLD])
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PAGE_COLUMNS[1:]]
    rows = rows.withColumns({"page_no": F.col("page_no").cast("long"), "digest": F.sha2(F.concat_ws("\x00", *told), 256)})
    done: list[int] = []

    def batch(df: DataFrame, number: int) -> None:
        take_batch(df, number, out, config)
        done.append(number)

    with shipped(spark):
        query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    log.info("took %d batches of %s", len(done), pages)
    return len(done)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The index as it stands: chunks with vectors of each page as the last batch that marked it wrote them.

    Both tables are there once a batch has ended; before that there is no index, which is a FileNotFoundError.
    """
    marked = _held(spark, f"{out}/pages", MARKS)
    if marked is None:
        raise FileNotFoundError(f"no index below {out}")
    last = marked.groupBy("page_no").agg(F.max("batch").alias("batch"))
    return spark.read.schema(CHUNKS).parquet(f"{out}/chunks").join(last, ["page_no", "batch"])


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="jobs.keep_index", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("pages", "out", "checkpoint"):
        parser.add_argument(name)
    parser.add_argument("--config", default=CONFIG)
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("keep-index").getOrCreate()
    try:
        keep_index(spark, given.pages, given.out, given.checkpoint, Config.load(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
