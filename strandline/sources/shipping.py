"""Sends this package to the executors, so that their Python workers can import it wherever the driver runs."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: an archive of the package, which executors fetch from the driver."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    path = Path(tempfile.mkdtemp(prefix="strandline-code-")).resolve() / "strandline_library.zip"
    path.write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(str(path))
