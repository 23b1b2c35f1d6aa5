"""Sending this package to the executors, for sessions whose workers can't import it by themselves."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package's modules as a zip through Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = Path(__file__).resolve().parents[2]
    made = Path(tempfile.mkdtemp(prefix="corpusmill-")) / "corpusmill.zip"
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted([*(top / "corpusmill").rglob("*.py"), *top.glob("corpus_pipeline.py")]):
            z.write(path, path.relative_to(top))
    sc.addPyFile(str(made))
    _sent.add(sc.applicationId)
