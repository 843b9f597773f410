"""Session helpers shared by the text operators."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandlight.operators.graph import roots as connected_components
from strandlight.session import kept as cut_lineage
from strandlight.session import shared_folder

__all__ = ["connected_components", "cut_lineage", "groups_for", "shared_folder", "ship_package", "slices", "table"]

PACKAGE_ROOT = Path(__file__).resolve().parents[1]
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}  # what a Python worker is sent at once
SLICE_BYTES = 256 << 10  # of texts that are taken apart at once


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that Python workers can import it, and
    bound the session's Arrow batches by bytes where its configuration doesn't name a bound."""
    context = spark.sparkContext
    for key, value in BATCH.items():
        if not context.getConf().contains(key):
            spark.conf.set(key, value)
    if getattr(context, "_strandlight_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="strandlight-")
    archive = os.path.join(folder, "strandlight_pkg.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(PACKAGE_ROOT.rglob("*.py")):
            out.write(path, str(Path(PACKAGE_ROOT.name) / path.relative_to(PACKAGE_ROOT)))
    context.addPyFile(archive)
    context._strandlight_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[list[str]]:
    """The texts of a string array in runs of about ``most_bytes`` (one text at least); null is the empty text."""
    run, held = [], 0
    for text in texts:
        run.append(text.as_py() or "")
        held += len(run[-1])
        if held >= most_bytes:
            yield run
            run, held = [], 0
    if run:
        yield run


def groups_for(n: int, per_group: int) -> int:
    return max(1, math.ceil(n / per_group))
