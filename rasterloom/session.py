"""Session helpers: settings the operators expect and code shipping to executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings used by tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("rasterloom")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, once an application.

    The sources go out through Spark's own file distribution, so executors
    need no shared folder and no installation.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(Path(PACKAGE.name) / p.relative_to(PACKAGE)))
    folder = tempfile.mkdtemp(prefix="rasterloom-src-")
    path = os.path.join(folder, "rasterloom_src.zip")
    Path(path).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


@contextmanager
def tagged(spark: SparkSession, tag: str, description: str | None = None) -> Iterator[Callable[[], None]]:
    """Jobs started inside carry ``tag``; the function given cancels them, from any thread."""
    sc = spark.sparkContext
    sc.addJobTag(tag)
    sc.setJobDescription(description or tag)
    try:
        yield lambda: sc.cancelJobsWithTag(tag)
    finally:
        sc.removeJobTag(tag)
        sc.setJobDescription(None)


def progress(spark: SparkSession) -> list[tuple[int, int, int]]:
    """Stage, finished tasks and all tasks of what runs now."""
    tracker = spark.sparkContext.statusTracker()
    found = (tracker.getStageInfo(i) for i in tracker.getActiveStageIds())
    return [(s.stageId, s.numCompletedTasks, s.numTasks) for s in found if s]
