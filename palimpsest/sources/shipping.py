"""The library itself on executors that do not have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the library's modules to the session's executors, once an application, so that their Python workers can import it."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    if context.applicationId in _shipped or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp()) / "palimpsest-modules.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for module in sorted(root.glob("palimpsest/**/*.py")):
            archive.write(module, module.relative_to(root))
        if (root / "corpus_pipeline.py").exists():
            archive.write(root / "corpus_pipeline.py", "corpus_pipeline.py")
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
