"""What the engine needs from a session: workers that can import it, and folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Bytes of a batch that travels to a Python worker, where the session has Spark's default.
BATCH_BYTES = 4 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def prepare(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package, from whatever folder the driver runs.

    Workers of a local master, or of one on this machine, look where the driver found it.  Beyond that the package's files
    are sent to the executors once a session.  Without a session nothing happens.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    if spark.conf.get(_BATCH) == _DEFAULT:  # 64 MB; long texts fill the workers' memory
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    sc = spark.sparkContext
    have, root = sc.environment.get("PYTHONPATH", ""), str(_PACKAGE.parent)
    if root not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    if not sc.master.startswith("local") and sc.applicationId not in _shipped:
        place = Path(SparkFiles.getRootDirectory()) / f"{_PACKAGE.name}-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(place, "w") as out:
            for path in sorted(_PACKAGE.rglob("*.py")):
                out.write(path, path.relative_to(_PACKAGE.parent))
        sc.addPyFile(str(place))
        _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, as checkpoints use it.  Where that is unset a temporary
    folder serves a local master; on a cluster it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillgate-"))
    return sc._jsc.sc().getCheckpointDir().get()
