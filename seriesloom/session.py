"""Session helpers."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once.

    Arrow functions are pickled by reference, so workers need the package; Spark
    serves the archive to executors from the driver.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_seriesloom_shipped", False):
        home = Path(__file__).resolve().parent
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, str(Path(home.name) / p.relative_to(home)))
        path = Path(tempfile.mkdtemp(prefix="seriesloom-")) / "seriesloom.zip"
        path.write_bytes(data.getvalue())
        sc.addPyFile(str(path))
        sc._seriesloom_shipped = True
    return spark


def checkpoints(spark: SparkSession) -> None:
    """Have ``checkpoint`` write to the folder that ``spark.checkpoint.dir`` names; on a single machine any folder will do."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='seriesloom-')}"
    sc.setCheckpointDir(base)
