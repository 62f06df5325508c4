"""Bring this package to Python workers that can't import it, as ``--py-files`` does."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

_sent: set[str] = set()


def ship(spark) -> None:
    """Add the package to the job's Python files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quern-py-"), "quern.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("quern", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)


def shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
