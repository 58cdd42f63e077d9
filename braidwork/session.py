"""Sessions, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive execution and UTC, as tests and the bench use it."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("braidwork")
    own = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (own | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Bytes of a batch that goes to Python at once, so that long texts do not fill an executor's memory outside its heap.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once a session, for where it is not installed; batches are kept to BATCH_BYTES where no less is set."""
    if int(spark.conf.get(_BATCH, f"{1 << 30}b").removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parent
        out = tempfile.mkdtemp(prefix="braidwork-")
        atexit.register(shutil.rmtree, out, True)
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(out, "braidwork"), "zip", top.parent, top.name))
    return spark
