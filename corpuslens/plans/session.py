"""Session settings and cut points shared by all jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.plans.storage import stored

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benches. On a cluster, pass your own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corpuslens")
    settings = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and keep on shared storage, so that a lost executor costs no recomputation."""
    return stored(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by key when the input has fewer partitions than there are cores.

    A corpus in a few files would otherwise be tokenised by a few tasks. A large corpus has
    more scan partitions than cores and is left alone, so its texts are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
