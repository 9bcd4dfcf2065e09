"""Making the package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once for each application, unless they find it on their path anyway."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    paths = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _DONE or root in paths or Path.cwd().resolve() == root:
        return
    target = Path(tempfile.mkdtemp(prefix="packrow-")) / "packrow.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "packrow").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    _DONE.add(sc.applicationId)
