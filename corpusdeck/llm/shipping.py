"""Sends this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import corpusdeck

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make ``corpusdeck`` importable in the executors' Python workers, once per application.

    The archive is only the driver's source for Spark's own file distribution: executors fetch it from
    the driver and never read the driver's folder.
    """
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    top = os.path.dirname(os.path.abspath(corpusdeck.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusdeck-code-"), "corpusdeck_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("corpusdeck", os.path.relpath(path, top)))
    context.addPyFile(archive)
    _SENT.add(context.applicationId)
