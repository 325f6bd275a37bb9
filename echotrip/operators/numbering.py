"""Running numbers over a global order, and what is built on them: sentence index, batches, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrip.session import shuffle_partitions, stage


def index_rows(
    df: DataFrame, order: list[str], name: str = "row_index", within: tuple[str, ...] = ()
) -> DataFrame:
    """Add the 0-based position of each row in ``order``, per group ``within`` (default: overall).

    ``order`` must be unique within a group. No window over all rows: the rows are range
    partitioned and numbered inside their partition, and each partition's offset comes from the
    row counts of those before it, one small row per partition. A group of any size is spread over
    as many partitions as its rows fill. The numbered rows are staged because the range bounds are
    sampled and would move if a partition were computed again.
    """
    keys = [*within, *order]
    ranged = (
        df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    staged = stage(ranged, "index")
    counts = staged.groupBy(*within, "_part").agg(
        F.count("*").alias("_count"), F.min("_row").alias("_first")
    )
    before = F.sum("_count").over(
        Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *within, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_offset")
    )
    # One row per partition; with groups, one per group and partition, whose join is left to adaptive execution.
    numbered = staged.join(offsets if within else F.broadcast(offsets), [*within, "_part"])
    return numbered.select(*df.columns, (F.col("_row") + F.col("_offset")).alias(name))


def sentence_index(candidates: DataFrame, order: list[str], name: str = "sent_idx") -> DataFrame:
    """Dense 0-based index of the sentence, shared by all its candidates.

    The distinct sentence keys are numbered and joined back.
    """
    keys = index_rows(candidates.select(*order).distinct(), order, name)
    return candidates.join(keys, order)


def block_index(row_index: Column, block: int = 10) -> Column:
    """Sentence index of a table without one: consecutive blocks of rows."""
    return F.floor(row_index / block)


def epoch_batches(
    ids: DataFrame, key: str, epochs: int, batch_size: int, seed: int = 0
) -> DataFrame:
    """``(epoch, position, batch, key)``: a fresh shuffle per epoch, cut into batches.

    The order is that of md5("seed:epoch:key"), so it is the same on every run and cluster. The
    last batch of an epoch may be short.
    """
    drawn = ids.select(key).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    )
    drawn = drawn.withColumn(
        "_draw", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.col(key)))
    )
    placed = index_rows(drawn, ["_draw", key], "position", within=("epoch",))
    return placed.select(
        "epoch", "position", F.floor(F.col("position") / batch_size).alias("batch"), key
    )


def shards(
    positions: DataFrame, world_size: int, position: str = "position", pad: bool = True,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``shard`` = position % world_size; with ``pad``, the first rows are repeated at the end
    until all shards are equally long (``is_pad`` marks them)."""
    own = positions.withColumn("is_pad", F.lit(False))
    if pad:
        # A group of n rows lacks k = -n mod world_size rows; pad row j repeats row j mod n.
        sizes = positions.groupBy(*within).agg(F.count("*").alias("_n"))
        missing = F.pmod(-F.col("_n"), F.lit(world_size)).cast("int")
        wanted = sizes.where(missing > 0).select(
            *within, "_n", F.explode(F.sequence(F.lit(0), missing - 1)).alias("_j")
        )
        wanted = wanted.select(
            *within, (F.col("_j") % F.col("_n")).alias(position), (F.col("_n") + F.col("_j")).alias("_at")
        )
        # Fewer than world_size rows per group, of any number of groups: the join is left to adaptive execution.
        extra = (
            positions.join(wanted if within else F.broadcast(wanted), [*within, position])
            .withColumn(position, F.col("_at"))
            .select(*positions.columns, F.lit(True).alias("is_pad"))
        )
        own = own.unionByName(extra)
    return own.withColumn("shard", F.pmod(F.col(position), F.lit(world_size)))
