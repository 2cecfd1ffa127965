"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of a batch that goes to a Python task, where the session doesn't say; long texts then come in small batches.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that Python tasks can import it anywhere, and bounds
    the session's Arrow batches by ARROW_BATCH unless it has a bound of its own."""
    if spark.conf.get(ARROW_BATCH[0], None) is None:
        spark.conf.set(*ARROW_BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="barloom-")) / "barloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"barloom/{f.relative_to(here)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def local_session(app: str = "barloom", cores: str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session on this machine, as the tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
