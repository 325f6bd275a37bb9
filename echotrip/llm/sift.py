"""A fixed-size bitmap of keys, to leave rows out of a join without shuffling them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22  # 2^22 bits are 128 rows of 4 KB, whatever the size of the tables


def with_likely(rows: DataFrame, wanted: DataFrame, keys: list[str], name: str = "likely", bits: int = BITS) -> DataFrame:
    """``rows`` with ``name``: false only where ``wanted`` holds no row of the same ``keys``.

    Keys are hashed to 2^bits places. With more distinct keys than places the bitmap fills up and
    saves nothing, but no row is ever called unlikely that is wanted. Broadcast: the bitmap, of fixed size.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << bits)) + 1
    maps = wanted.select(place.alias("__place")).groupBy(F.bitmap_bucket_number("__place").alias("__bucket"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__map"))
    placed = rows.withColumn("__bucket", F.bitmap_bucket_number(place)).withColumn("__bit", F.bitmap_bit_position(place))
    both = placed.join(F.broadcast(maps), "__bucket", "left")
    byte = "cast(conv(hex(substring(__map, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"coalesce(shiftright({byte}, cast(__bit % 8 as int)) & 1, 0) = 1")
    return both.withColumn(name, hit).select(*rows.columns, name)
