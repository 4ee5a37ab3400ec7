"""Session defaults: UTC, adaptive execution, last-wins map merges."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on; ``configured`` sets them on any session.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}
#: Settings that only speed depends on.
TUNING = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def configured(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("docframe").config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in (SETTINGS | TUNING).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
