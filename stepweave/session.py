"""Session settings and the shared folder in which long lineages are cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that every job of this package relies on; sizes of partitions stay with the cluster's own settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with DEFAULTS, for tests, benches and single machines."""
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (DEFAULTS | {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stepweave-")
        atexit.register(shutil.rmtree, at[7:], True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir() or at


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per context, so that it needn't be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_stepweave", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="stepweave-"))
    atexit.register(shutil.rmtree, folder, True)
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(folder / "stepweave.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(folder / "stepweave.zip"))
    sc._stepweave = True


def _remove(spark: SparkSession, path: str) -> None:
    """What was cut is removed when the program ends, as far as the session still lives."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001
        pass


def place(spark: SparkSession, name: str) -> str:
    """A new folder for files of a run in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, it survives lost executors, and what
    reads it several times doesn't compute it again. Columnar and compressed, unlike DataFrame.checkpoint()."""
    path = place(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is. It is counted, so it should be cut."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
