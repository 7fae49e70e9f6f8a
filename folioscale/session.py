"""Session construction and the few session-level helpers the operators share."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitting job's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscale")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def _own_folder(what: str) -> str:
    """A temporary folder of this process, removed when Python ends."""
    folder = tempfile.mkdtemp(prefix=f"folioscale-{what}-", dir=os.environ.get("TMPDIR"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that checkpoint() writes to.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that setting wins. A local temporary folder is
    used only where it is unset and the master is local, as in tests; elsewhere its absence is an error.
    """
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own_folder("checkpoint")
    sc.setCheckpointDir(named)
    return named


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application; they need no installed copy.

    The archive goes through the shared folder that ``spark.checkpoint.dir`` names; without one, the driver serves it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_folioscale_shipped", None) != sc.applicationId:
        here = Path(__file__).resolve().parent
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as out:
            for path in sorted(here.rglob("*.py")):
                out.write(path, path.relative_to(here.parent))
        shared = spark.conf.get("spark.checkpoint.dir", None) or _own_folder("code")
        target = f"{shared}/{sc.applicationId}/folioscale.zip"
        where = spark._jvm.org.apache.hadoop.fs.Path(target)
        stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        stream.write(bytearray(data.getvalue()))
        stream.close()
        sc.addPyFile(target)
        sc._folioscale_shipped = sc.applicationId
    return spark
