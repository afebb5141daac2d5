"""Helpers that the training-data operators share: shared storage, table reading, words and chunks of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.storage import checkpointed as materialize
from quadrille.storage import shared_folder as scratch

__all__ = ["WHITE_SPACE", "WORD", "chunks", "marked", "materialize", "scratch", "table", "text_or_empty", "without", "words"]

#: White space that separates words, as bytes 0x20 and 0x09-0x0D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bits of the bitmap in front of without(): for each value, and at most (32 MB).
BITS_EACH, MOST_BITS, PAGE = 64, 1 << 28, 1 << 15


def marked(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """rows with a boolean column `_set`: true where `column` is in the one column of `values` (which has distinct values of
    the same name), and for a few others. No row moves.

    A bitmap of the values' hashes goes to all executors, at most MOST_BITS bits in pages. With more values than the bitmap
    can tell apart, it is true for all rows.
    """
    n_bits = min(MOST_BITS, max(PAGE, 1 << (BITS_EACH * values.count()).bit_length()))
    bit = F.pmod(F.xxhash64(column), F.lit(n_bits))
    place, page = (bit % PAGE).cast("int"), F.floor(bit / PAGE).cast("int").alias("_page")
    pages = values.select(page, place.alias("_place")).groupBy("_page").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    pages = materialize(pages, "bitmap")  # MOST_BITS / PAGE rows at most
    placed = rows.select("*", place.alias("_place"), page).join(F.broadcast(pages), "_page", "left")
    byte = F.conv(F.hex(F.substr("_bits", F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col("_place") % 8 + 1)) != 0, F.lit(False))
    return placed.select(*rows.columns, set_.alias("_set"))


def without(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows whose `column` is not in the one column of `values` (which has distinct values of the same name). Only the
    rows to drop and a few more are joined with the values; the others stay where they are."""
    told = marked(rows, column, values)
    kept, doubtful = told.where("not _set").drop("_set"), told.where("_set").drop("_set")
    return kept.unionByName(doubtful.join(values, column, "left_anti").select(*rows.columns))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def chunks(texts: Iterable[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters, at least one text each."""
    run: list[str] = []
    size = 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run
