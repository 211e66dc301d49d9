"""Session settings and the two helpers every distributed operator needs."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "granary", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench, with the package shipped; a cluster brings its own and calls ``ship_package``."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRANARY_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session, once, so that they need no path of their own to it."""
    context = spark.sparkContext
    if getattr(context, "_granary_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="granary-package-")  # on the driver, which serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, "granary_package.zip")
    with zipfile.ZipFile(name, "w") as bundle:
        for place, _, files in os.walk(home):
            for file in sorted(files):
                if file.endswith(".py"):
                    whole = os.path.join(place, file)
                    bundle.write(whole, os.path.relpath(whole, os.path.dirname(home)))
    context.addPyFile(name)
    context._granary_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a session in one process (tests, bench)
    gets a local folder that goes with it; on a cluster it is an error, since no local folder is shared.
    """
    context = spark.sparkContext
    if context.getConf().get("spark.checkpoint.dir") is None and context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="granary-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get() if context._jsc.sc().getCheckpointDir().isDefined() else context.getConf().get("spark.checkpoint.dir")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder all executors share (``shared_folder``) and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Mark ``df`` for broadcast only when it has at most ``max_rows`` rows.

    The check reads no more than ``max_rows + 1`` rows; a larger side is left to the planner, which shuffles it.
    ``df`` should be a table or a checkpointed result, since it is evaluated once for the check.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, then by the other columns, so that ties have one answer.

    It is an aggregate, so each task keeps one row per key before anything is shuffled. Nulls sort lowest.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.`{c}`").alias(c) for c in [*order, *rest]])
