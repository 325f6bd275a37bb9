"""Result tables: correlation CSV, metric log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRELATION_SCHEMA = (
    "row_index BIGINT, bleu DOUBLE, roundtrip_bleu DOUBLE, chrf DOUBLE, "
    "roundtrip_chrf DOUBLE, sent_idx BIGINT"
)
METRIC_SCHEMA = (
    "step BIGINT, split STRING, lang STRING, direction STRING, metric STRING, score DOUBLE"
)


def write_correlation(df: DataFrame, path: str) -> None:
    """CSV folder with the row index first; undefined scores are empty fields.

    ``df`` must carry ``row_index`` (operators.numbering.index_rows gives it). With a ``lang``
    column, one folder per language.
    """
    columns = [c.split()[0] for c in CORRELATION_SCHEMA.split(", ")]
    if "lang" in df.columns:
        df.select("lang", *columns).write.partitionBy("lang").csv(path, header=True)
    else:
        df.select(*columns).write.csv(path, header=True)


def read_correlation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CORRELATION_SCHEMA)


def append_metrics(
    report: DataFrame, path: str, step: int, split: str | None = None
) -> None:
    """Write a long report to the metric log, keyed by step and split.

    Missing key columns (split, lang, direction) are written as NULL. The log is partitioned by step and split, and a call replaces just
    the partitions it has rows for: a step that is written again, also after a failure, leaves one set of rows.
    """
    log = report.withColumn("step", F.lit(step).cast("bigint"))
    if split is not None:
        log = log.withColumn("split", F.lit(split))
    for field in METRIC_SCHEMA.split(", "):
        name, kind = field.split()
        value = F.col(name) if name in log.columns else F.lit(None)
        log = log.withColumn(name, value.cast(kind))
    writer = log.select(*[f.split()[0] for f in METRIC_SCHEMA.split(", ")]).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("step", "split").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(METRIC_SCHEMA).parquet(path)
    return rows.select(*[f.split()[0] for f in METRIC_SCHEMA.split(", ")])


def nested_report(report: DataFrame) -> DataFrame:
    """One JSON text per language: ``{direction: {metric: score}}``."""
    def cell(direction: str, metric: str) -> Column:
        wanted = (F.col("direction") == direction) & (F.col("metric") == metric)
        return F.max(F.when(wanted, F.col("score"))).alias(metric)

    return report.groupBy("lang").agg(
        F.to_json(
            F.struct(
                F.struct(cell("forward", "bleu"), cell("forward", "chrf++")).alias("forward"),
                F.struct(cell("backward", "bleu"), cell("backward", "chrf")).alias("backward"),
            )
        ).alias("report")
    )
