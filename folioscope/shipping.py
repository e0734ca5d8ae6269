"""Makes this package importable on the executors, wherever the driver found it."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Hand the package's sources to Spark's own file service, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root, packed = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        target = Path(tempfile.mkdtemp(prefix="folioscope-")) / "folioscope.zip"
        target.write_bytes(packed.getvalue())
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)
    return spark
