"""The package for the executors' Python workers, which need not have it installed or share the driver's folder."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch for Python unless the session says another number: of whole documents, a fifth of Spark's number is enough to work on, and a fifth of its memory.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Add this package to the session's Python files, once a SparkContext, by way of spark.checkpoint.dir."""
    sc = spark.sparkContext
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)
    if getattr(sc, "_quern_shipped", False):
        return
    from quern.streaming.enrich import shared_root

    home, raw = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(Path("quern") / p.relative_to(home))), p.read_bytes(), zipfile.ZIP_DEFLATED)
    body = raw.getvalue()
    name = f"{shared_root(spark)}/quern-{hashlib.sha256(body).hexdigest()[:16]}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path) or fs.getFileStatus(path).getLen() != len(body):
        out = fs.create(path, True)
        out.write(bytearray(body))
        out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    sc._quern_shipped = True
