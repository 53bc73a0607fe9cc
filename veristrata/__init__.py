"""Detection-evaluation analytics on Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Sends this package to the executors of a session as a zip, once, so that Python workers on other machines can import it."""
    context = spark.sparkContext
    if getattr(context, "_veristrata_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # it runs from a zip already
        return
    path = os.path.join(tempfile.mkdtemp(prefix="veristrata-"), "veristrata.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("veristrata", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._veristrata_shipped = True
