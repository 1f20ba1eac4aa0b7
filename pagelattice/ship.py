"""Making the package importable in Python workers that don't find it by themselves."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ensure_on_workers(spark: SparkSession) -> None:
    """Hand the package's sources to the workers through Spark's own file server, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    staged = Path(tempfile.mkdtemp(prefix="pagelattice-src-")) / "pagelattice_src.zip"  # read by the driver only, which serves it
    staged.write_bytes(held.getvalue())
    sc.addPyFile(str(staged))
    _done.add(sc.applicationId)
