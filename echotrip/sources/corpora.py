"""Monolingual, parallel and bitext corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrip.functions.text import replace_nbsp
from echotrip.operators.head import first_rows
from echotrip.session import stage

CORPUS_SCHEMA = "doc_id BIGINT, text STRING"
PARALLEL_SCHEMA = "id BIGINT, text STRING"


def read_corpus(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    id_col: str | None = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, text)`` of a corpus; ``doc_id`` carries the stream order.

    Only the two columns are read. ``fmt`` is any Spark file format whose rows have both fields. With ``id_col=None`` the
    records are numbered in the order in which a reader of the files, by path, meets them (see ``numbered_records``); for ``fmt="text"``
    a record is a line.
    """
    reader = spark.read.format(fmt)
    if fmt == "json":  # no inference pass over the corpus
        fields = [f"`{text_col}` STRING"] if id_col is None else [f"`{id_col}` BIGINT", f"`{text_col}` STRING"]
        reader = reader.schema(", ".join(fields))
    rows = reader.load(path)
    if fmt == "text":
        rows = rows.withColumnRenamed("value", text_col)
    if id_col is None:
        return numbered_records(rows, text_col, fmt)
    return rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def numbered_records(rows: DataFrame, text_col: str, fmt: str) -> DataFrame:
    """``(doc_id, text)`` of a file scan, ``doc_id`` counting from 0 over the files by path and the records in them.

    No sort and no exchange of texts: a record's number in its file is known where it is read, and the number of records before a
    file is one small row per file (or per piece of a file that one task reads). Parquet files know the row; of other
    formats the pieces depend on how Spark cuts files for the cores at hand, so the rows are written once with their place in the piece, and
    the numbers that follow are the same for every way of cutting.
    """
    text, file = F.col(text_col).alias("text"), F.col("_metadata.file_path").alias("_file")
    if fmt == "parquet":
        placed = rows.select(text, file, F.lit(0).cast("bigint").alias("_block"), F.col("_metadata.row_index").alias("_row"))
        counts = placed.groupBy("_file", "_block").agg(F.count("*").alias("_count"), F.lit(0).cast("bigint").alias("_first"))
    else:
        block = F.col("_metadata.file_block_start").alias("_block")
        placed = stage(rows.select(text, file, block, F.monotonically_increasing_id().alias("_row")), "records")
        counts = placed.groupBy("_file", "_block").agg(F.count("*").alias("_count"), F.min("_row").alias("_first"))
    counts = stage(counts, "pieces")
    inside = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy("_file").agg(F.sum("_count").alias("_count"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one short row per file
    files = files.select("_file", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_files_before"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_count").over(inside), F.lit(0))).join(files, "_file")
    offsets = offsets.select("_file", "_block", (F.col("_files_before") + F.col("_before") - F.col("_first")).alias("_offset"))
    return placed.join(offsets, ["_file", "_block"]).select((F.col("_row") + F.col("_offset")).alias("doc_id"), "text")


def source_split(split: str | Column, style: str = "parallel") -> Column:
    """Name a corpus uses for "dev" or "test" ("parallel": dev/devtest, "bitext": valid/test)."""
    wanted = F.lit(split) if isinstance(split, str) else split
    # Split names of the two corpus kinds.
    if style == "parallel":
        return F.when(wanted == "test", "devtest").otherwise("dev")
    return F.when(wanted == "dev", "valid").otherwise("test")


def read_parallel(
    spark: SparkSession, path: str, langs: list[str], split: str, fmt: str = "parquet"
) -> DataFrame:
    """``(lang, id, split, text)`` from a table partitioned by ``lang`` and ``split``.

    Language and split are partition columns, so other languages' files are never opened.
    """
    real = "devtest" if split == "test" else "dev"
    rows = spark.read.format(fmt).load(path)
    return rows.where(F.col("lang").isin(*langs) & (F.col("split") == real)).select(
        "lang", "id", "split", "text"
    )


def parallel_pairs(tgt: DataFrame, eng: DataFrame) -> DataFrame:
    """``(lang, id, split, text_tgt, text_eng)``: both sides matched on ``(id, split)``.

    One join serves all target languages of ``tgt``. No-break spaces become plain spaces.
    """
    left = tgt.select("lang", "id", "split", replace_nbsp(F.col("text")).alias("text_tgt"))
    right = eng.select("id", "split", replace_nbsp(F.col("text")).alias("text_eng"))
    return left.join(right, ["id", "split"]).select("lang", "id", "split", "text_tgt", "text_eng")


def read_bitext(
    spark: SparkSession, path: str, lang: str, source: str = "eng_Latn", fmt: str = "parquet"
) -> DataFrame:
    """``(eng, tgt)`` from a table with one sentence column per language."""
    return bitext_pairs(spark.read.format(fmt).load(path), lang, source)


def bitext_pairs(table: DataFrame, lang: str, source: str = "eng_Latn", *keep: str) -> DataFrame:
    return table.select(
        *keep,
        F.col(f"sentence_{source}").alias("eng"),
        F.col(f"sentence_{lang}").alias("tgt"),
    )


def bitext_train(table: DataFrame, order: list[str], n: int, source: str = "eng_Latn") -> DataFrame:
    """First ``n`` English sentences of a bitext, in the given order."""
    return first_rows(table, order, n).select(*order, F.col(f"sentence_{source}").alias("eng"))


def first_pairs(pairs: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """First ``n`` pairs in the given order; ``None`` keeps all."""
    return pairs if n is None else first_rows(pairs, order, n)


def pair_columns(pairs: DataFrame, *keep: str) -> DataFrame:
    """``(eng, tgt)`` of matched pairs."""
    return pairs.select(*keep, F.col("text_eng").alias("eng"), F.col("text_tgt").alias("tgt"))
