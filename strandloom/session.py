"""What a session needs to run the package's Python operators on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless their workers find it: on PYTHONPATH or in the folder where they start.

    Once for a session; installed packages and sessions with --py-files need it not, and lose nothing by it.
    """
    app = spark.sparkContext.applicationId
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or _ROOT in on_path or Path.cwd().resolve() == _ROOT:
        return
    path = Path(tempfile.mkdtemp(prefix="strandloom-")) / "strandloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((_ROOT / "strandloom").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
