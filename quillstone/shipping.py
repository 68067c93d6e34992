"""Makes this package importable on executors that do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
_DONE: set[str] = set()


def ship(spark) -> None:
    """Sends the package to executors once a session's application, unless their environment names its folder or they start in it."""
    known = spark.sparkContext._jvm.System.getenv("PYTHONPATH") or ""
    app = spark.sparkContext.applicationId
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    if app in _DONE or str(ROOT) in known.split(os.pathsep) or (local and spark.sparkContext._jvm.System.getProperty("user.dir") == str(ROOT)):
        return
    _DONE.add(app)
    path = Path(tempfile.mkdtemp(prefix="quillstone-code-")) / "quillstone.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "quillstone").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))


def shipped(query):
    """A query that ships the package before it runs."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
