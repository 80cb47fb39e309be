"""Session factory with the settings the engine expects, and this package on the executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "graphloom", **settings: str) -> SparkSession:
    """A session with adaptive execution, ANSI mode and UTC; settings override."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in (base | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_shipped: set[str] = set()
#: Rows and bytes that an operator's function sees at a time, whatever batches the session sends.
SLICE_ROWS, SLICE_BYTES = 1000, 16 << 20
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="graphloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "graphloom_ship.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def sliced(batches: Iterator) -> Iterator:
    """Arrow batches cut into slices of at most SLICE_ROWS rows and about SLICE_BYTES, without a copy."""
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow with this package on the executors, in slices that suit texts. The session's settings stay as they are."""
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: run(sliced(batches)), schema)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For an operator's own actions: batches to Python of SLICE_ROWS rows at most, since texts are large and both sides hold
    a batch. The session's setting comes back at the end."""
    before = spark.conf.get(_ARROW)
    if 0 < int(before) <= SLICE_ROWS:
        yield
        return
    spark.conf.set(_ARROW, str(SLICE_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ARROW, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it names none, a session that runs on this machine alone
    gets a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    own = sc._jsc.sc().getCheckpointDir()
    if not named and own.isDefined():
        return own.get()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not own.isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df materialised in the shared checkpoint folder, its lineage cut there. With
    spark.cleaner.referenceTracking.cleanCheckpoints the files go when the table is no longer referenced."""
    checkpoint_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> None:
    """df as Parquet at path, for a later pass over it."""
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
