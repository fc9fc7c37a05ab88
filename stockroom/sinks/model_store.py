"""Model store (K8): fitted models and the stacked churn model, with a manifest and checksums.

``<path>/parts/<n>`` holds what the ML writers make of each part, ``<path>/manifest`` one
JSON line: kind, class and place of every part in order, the settings of the model, and
the SHA-256 of every file of the parts.  ``load`` checks the files against the manifest
and rebuilds the model by class.  The manifest is written last, so a folder without one was not finished.
"""

from __future__ import annotations

import hashlib
import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stockroom.operators.churn import StackedModel
from stockroom.session import forget_folder

MODULES = "pyspark.ml."  # parts are ML classes, nothing else is imported by name


def _digest(spark: SparkSession, path: str) -> str:
    """Of the names and bytes of all files below ``path`` (as many as a model has)."""

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = F.element_at(F.split("path", "/parts/"), -1)
    rows = files.select(names.alias("name"), F.sha2("content", 256).alias("sha")).where("name not like '%/.%' and name not like '%/\\\\_%'").collect()
    return hashlib.sha256("".join(sorted(f"{row.name} {row.sha}\n" for row in rows)).encode()).hexdigest()


def save(model, path: str) -> str:
    """Save a fitted ML model, a pipeline or a ``StackedModel``; an earlier one at ``path`` goes."""

    spark = SparkSession.active()
    stacked = isinstance(model, StackedModel)
    parts = [*model.base_models, model.meta] if stacked else [model]
    forget_folder(spark, path)
    for n, part in enumerate(parts):
        part.write().save(f"{path}/parts/{n}")
    manifest = {
        "kind": "stacked" if stacked else "single",
        "parts": [f"{type(part).__module__}.{type(part).__name__}" for part in parts],
        "settings": {"features": model.features, "meta_inputs": model.meta_inputs} if stacked else {},
        "sha256": _digest(spark, f"{path}/parts"),
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return path


def load(path: str):
    """The model saved at ``path``; a missing or changed file is an error."""

    spark = SparkSession.active()
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if _digest(spark, f"{path}/parts") != manifest["sha256"]:
        raise ValueError(f"files of the model at {path} do not match its manifest")
    parts = []
    for n, name in enumerate(manifest["parts"]):
        if not name.startswith(MODULES):
            raise ValueError(f"{name} is not an ML class")
        module, _, kind = name.rpartition(".")
        parts.append(getattr(importlib.import_module(module), kind).load(f"{path}/parts/{n}"))
    if manifest["kind"] == "single":
        return parts[0]
    return StackedModel(base_models=parts[:-1], meta=parts[-1], **manifest["settings"])
