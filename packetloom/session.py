"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows here are often whole documents: Arrow batches of Spark's default 10000 would not fit small workers.
BATCH_ROWS = 512
PACKAGE = Path(__file__).resolve().parent


def get_spark(app_name: str = "packetloom", master: str = "local[*]", **conf: object) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use double underscores for dots."""
    b = SparkSession.builder.master(master).appName(app_name)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.sql.streaming.schemaInference": "false"}
    for k, v in (base | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once a context, so that Python workers can import it anywhere; bound Arrow batches."""
    sc = spark.sparkContext
    if getattr(sc, "_packetloom_shipped", None):
        return spark
    folder = tempfile.mkdtemp(prefix="packetloom")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file while it runs
    path = f"{folder}/packetloom_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
    sc.addPyFile(path)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc._packetloom_shipped = True
    return spark


def setup_logging(component: str, level: int = logging.INFO) -> logging.Logger:
    """A logger of one component with UTC times on standard error."""
    form = logging.Formatter(f"%(asctime)sZ %(levelname)s {component} %(message)s", "%Y-%m-%dT%H:%M:%S")
    form.converter = time.gmtime
    out = logging.getLogger(component)
    if not out.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(form)
        out.addHandler(handler)
    out.setLevel(level)
    return out
