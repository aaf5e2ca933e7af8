"""Stage boundaries: a table written once, read by several later steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from pingloom.session import shared_folder

_OPEN: list[list[str]] = []  # of the blocks that note their stages, innermost last


def run_folder(spark: SparkSession) -> str:
    """Where this application's stages lie."""
    return f"{shared_folder(spark)}/stages-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, path: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage and read it back.

    The files lie in the shared folder, so a lost executor costs nothing already done, the lineage
    ends here, and the planner sees real sizes. A path is never overwritten. Stages live until
    :func:`discard` or :func:`discard_stages`.
    """
    spark = df.sparkSession
    target = path or f"{run_folder(spark)}/{uuid.uuid4().hex}"
    for noted in _OPEN:
        noted.append(target)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    return spark.read.schema(df.schema).parquet(target)


@contextmanager
def noting() -> Iterator[list[str]]:
    """The paths of the stages written inside the block."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN.remove(paths)


def discard(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete stages nothing will read any more, in whatever store they lie."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def discard_stages(spark: SparkSession) -> None:
    """Delete all of this application's stages: for the end of a job, when its results are written."""
    discard(spark, [run_folder(spark)])
