"""Session defaults used by tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "doclens", cpus: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with AQE, UTC and Arrow; keyword settings (dots as ``__``) win over the defaults."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.jsonGenerator.ignoreNullFields": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("DOCLENS_DRIVER_MEMORY", "8g"),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
