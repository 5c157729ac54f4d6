"""One place to build a SparkSession, and the shared-folder helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "keyfold", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for a single machine; on a cluster use the one that spark-submit gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once for each application.

    Spark's own file server distributes the archive, so no shared folder is needed.
    """
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="keyfold-"), "keyfold.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"keyfold/{p.relative_to(root)}")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where none is set, a local session gets a temporary folder; on a cluster the
    executors would not share one, so that is an error.
    """
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="keyfold-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    import uuid

    return f"{shared_root(spark)}/keyfold-{name}-{uuid.uuid4().hex}"
