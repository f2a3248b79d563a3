"""Use all cores on small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Repartition an input that has fewer partitions than the cluster has cores.

    Detection is bound by the processor, and a small file makes one partition however
    many cores are idle. Inputs with enough partitions are returned as they are, so
    nothing large is ever shuffled by this. Planning only; no job is run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * per_core)
