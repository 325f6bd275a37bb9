"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers; per round the squared difference of every dimension, occurring integer and centroid is tabulated, and
distances are gathers from these tables, summed over the dimensions (``dictionaries``). First centroids are the vectors of the smallest hashes of
``seed:<id>``, so they depend on ids only. All arithmetic is exact, so the result does not depend on how rows lie.

Defined results: vectors of another length, null ones and those with null or non-finite components are left out; every row counts, also rows
of one id; rows with a null id are clustered, and begin a centroid only if there are too few others; of equal hashes the smaller vector comes first;
fewer vectors than centroids give as many centroids; distances and sums beyond a long become the largest long; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrip.llm.dictionaries import LONGEST, as_book, chunks, clipped, is_finite, move, read_chunks, total_as_long
from echotrip.session import stage


@dataclass(frozen=True)
class Settings:
    width: int = 64
    scale: int = 1024  # a power of two
    k: int = 8
    rounds: int = 10
    seed: int = 3


@dataclass(frozen=True)
class Clusters:
    assigned: DataFrame  # id, cluster, distance (squared), of every clustered row
    centroids: list[list[int]]
    inertias: list[int]  # summed distance per cluster

    def table(self) -> DataFrame:
        """cluster, centroid (integers as text: they may pass a long), inertia; one row per centroid."""
        rows = [(i, [str(x) for x in c], n) for i, (c, n) in enumerate(zip(self.centroids, self.inertias))]
        return self.assigned.sparkSession.createDataFrame(rows, "cluster int, centroid array<string>, cluster_inertia bigint")


def _assign(book: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, chunk in read_chunks(batch):
                near, distance = chunk.nearest(0, book[0])
                columns = [batch.column("id")[row].values, pa.array(near.astype(np.int32)), pa.array(clipped(distance))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return run


def cluster_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> Clusters:
    s = settings
    named = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    named = named.where((F.size("vector") == s.width) & is_finite(F.col("vector")))
    chunked = stage(chunks(named, s.scale), "chunks")
    hashed = named.withColumn("hash", F.sha2(F.concat(F.lit(f"{s.seed}:"), F.col("id").cast("string")), 256))
    first = hashed.orderBy(F.asc_nulls_last("hash"), "vector").limit(s.k).collect()
    book = as_book([r.vector for r in first], 1, s.scale) if first else np.zeros((1, 0, s.width), object)
    if first:
        for _ in range(s.rounds):
            book = move(chunked, {s.width: book})[s.width]
    kind = named.schema["id"].dataType.simpleString()
    assigned = chunked.mapInArrow(_assign(book), f"id {kind}, cluster int, distance bigint")
    assigned = stage(assigned, "clusters")
    sums = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(total_as_long("distance").alias("total")).collect()}
    centroids = book[0].tolist()
    return Clusters(assigned.withColumnRenamed("id", id_col), centroids, [sums.get(i, 0) for i in range(len(centroids))])


def described(clusters: Clusters) -> DataFrame:
    """Every assigned row with its centroid, the summed distance of its cluster, and that of all clusters (inertia)."""
    total = min(sum(clusters.inertias), LONGEST)
    table = clusters.table().withColumn("inertia", F.lit(total).cast("bigint"))
    return clusters.assigned.join(F.broadcast(table), "cluster")  # one row per centroid
