"""Makes the package importable in Python workers that do not start where the repository is."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_DONE: set[str] = set()


def to_workers(spark: SparkSession) -> None:
    """Send the package with the job, once per application, unless the workers' PYTHONPATH has it already."""
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    _DONE.add(sc.applicationId)
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    path = Path(tempfile.mkdtemp(prefix="prismlake-ship-")) / "prismlake_pkg.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(_ROOT.glob("prismlake/**/*.py")):
            z.write(file, file.relative_to(_ROOT))
    sc.addPyFile(str(path))
