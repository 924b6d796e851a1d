"""Sends this package to Python workers that can't import it."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session once, so that executors need no shared source folder."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    handle, name = tempfile.mkstemp(prefix="meridian-", suffix=".zip")
    with os.fdopen(handle, "wb") as f:
        f.write(content.getvalue())
    context.addPyFile(name)
    _sent.add(context.applicationId)
