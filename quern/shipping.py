"""Code for the executors: this package, where their PYTHONPATH lacks it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
#: Texts are long, so batches for Python hold fewer rows than Spark's default; another setting is left alone.
BATCH, DEFAULT, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"
#: However long texts are: a worker holds several copies of a batch, and a task has a worker for each function of its plan.
BATCH_BYTES, DEFAULT_BYTES, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"
SMALL = ((BATCH, DEFAULT, ROWS), (BATCH_BYTES, DEFAULT_BYTES, BYTES))


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application, and keep batches small."""
    for name, default, small in SMALL:
        if spark.conf.get(name) == default:
            spark.conf.set(name, small)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    held = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in held:
        return
    out = Path(tempfile.mkdtemp(prefix="quern-code-")) / "quern_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted((ROOT / "quern").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(out))
