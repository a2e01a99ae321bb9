"""Session helpers shared by the operators: lineage cuts, size checks and partition counts."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _own_folder(prefix: str) -> str:
    """A temporary folder that goes when the driver's Python does."""
    path = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of `df` through a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset (a local
    test session) is a temporary folder used, because a machine-local folder would be lost with its executor; it is
    removed at the end. In the shared folder ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes what no table
    refers to any more.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local[") or sc.master == "local":
            sc.setCheckpointDir(_own_folder("manyworlds-ckpt-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return df.checkpoint(eager)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application, so that Python functions find it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(_own_folder("manyworlds-code-")) / "manyworlds.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def bounded(df: DataFrame, most: int) -> list:
    """The rows of a table that is known to be small; more than `most` are an error rather than a full driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where few were expected")
    return rows


def pieces(count: int, each: int) -> int:
    """How many pieces of at most `each` hold `count` items (1 at least)."""
    return max(1, math.ceil(count / each))
