"""Session defaults shared by tests, the benchmark and interactive use."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "framesift", cores: str = "8", **conf: str) -> SparkSession:
    """A single-JVM session; on a cluster, use the session that spark-submit makes instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": cores,
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="framesift-ckpt-"),
        "spark.sql.warehouse.dir": os.path.join(tempfile.gettempdir(), "framesift-warehouse"),
        **conf,
    }
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once, unless their path has it already."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="framesift-"), "framesift.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted((ROOT / "framesift").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(spark.sparkContext.applicationId)
