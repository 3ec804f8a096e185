"""Gives this package's code to Python workers that would not find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session, once, unless the workers' path has it anyway."""
    home = Path(__file__).resolve().parent
    root, sc = str(home.parent), spark.sparkContext
    known = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.getcwd()}
    if root in known or sc.applicationId in _done:
        return
    to = Path(tempfile.mkdtemp()) / "plumbline.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(to))
    _done.add(sc.applicationId)
