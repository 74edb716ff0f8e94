"""The session that the library is meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow. On a cluster leave master to spark-submit."""
    builder = SparkSession.builder.appName("memlake")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}),
        **conf,
    }
    return builder.config(map=settings).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once, wherever the driver was started from."""
    import atexit
    import shutil
    import tempfile
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    here = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="memlake-")
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder, "memlake.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    context.addPyFile(str(archive))
