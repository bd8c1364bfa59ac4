"""A SparkSession with the settings this library expects."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "barspark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC time zone and adaptive execution; everything else is the cluster's own configuration or ``conf``."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; only a session on one machine (tests) without it gets one below its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


@contextmanager
def stages(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """``keep(frame)`` writes a frame to the shared folder (by the columns ``by``, if given) and reads it back, so that what is built on it does not compute it again.

    Of a chain of frames two are there at a time: keeping one deletes the one before the last. All are deleted at the end.
    """
    written: list[str] = []

    def delete(path: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    def keep(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        path = f"{_folder(spark)}/{uuid.uuid4().hex}"
        written.append(path)
        frame.write.parquet(path, partitionBy=list(by) or None)
        if len(written) > 2:
            delete(written.pop(0))
        return spark.read.schema(frame.schema).parquet(path)

    try:
        yield keep
    finally:
        for path in written:
            delete(path)


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame``, computed and kept by a reliable checkpoint (``spark.cleaner.referenceTracking.cleanCheckpoints`` deletes it with the frame)."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_folder(frame.sparkSession))
    return frame.checkpoint()
