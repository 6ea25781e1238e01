"""Getting this package to the executors of a session, and names of shared folders."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from ..session import shared_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, so that task functions can be imported there.

    Spark serves the archive from the driver to every executor, late ones too.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp(prefix="ruleweave-code-")).resolve()
    archive = shutil.make_archive(
        os.path.join(folder, package.name), "zip", root_dir=package.parent, base_dir=package.name
    )
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused folder below the one all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/ruleweave-{name}-{uuid.uuid4().hex}"
