"""Written intermediate tables.

A table is written when later steps must see exactly the same partition
boundaries, or when a loop would let the plan grow without end. It goes below
the shared folder named by ``spark.checkpoint.dir``, so a lost executor costs
nothing but a re-read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="grainmark-"))
    return sc.getCheckpointDir()


_OPEN: list[list[str]] = []  # the paths written in each open ``temporary`` block


def materialise(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{root(spark)}/grainmark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._grainmark_path = path
    return out


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those put in the list.

    What leaves the block must not read the others any more, so it is written itself.
    A table of an outer block is that block's to delete.
    """
    kept: list[DataFrame] = []
    _OPEN.append([])
    try:
        yield kept
    finally:
        mine = _OPEN.pop()
        stay = {getattr(d, "_grainmark_path", None) for d in kept}
        for path in mine:
            if path not in stay:
                files, there = _files(spark, path)
                files.delete(there, True)
        if _OPEN:
            _OPEN[-1].extend(p for p in mine if p in stay)


def _files(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path; a failure to look is an error, not a no."""
    files, there = _files(spark, path)
    return files.exists(there)


def swap_in(df: DataFrame, path: str) -> None:
    """Make ``path`` hold exactly ``df``; the old table stays whole until the new one is written.

    The rows go to a folder beside the table first, so they may depend on the old
    files. If the last rename fails, the old folder is put back.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    clean = path.rstrip("/")
    df.write.parquet(f"{clean}__new_{mark}")
    files, here = _files(spark, clean)
    _, new = _files(spark, f"{clean}__new_{mark}")
    _, old = _files(spark, f"{clean}__old_{mark}")
    had = files.exists(here)
    if had and not files.rename(here, old):
        raise OSError(f"could not move {clean} aside")
    if not files.rename(new, here):
        if had:
            files.rename(old, here)
        raise OSError(f"could not move the new table to {clean}")
    if had:
        files.delete(old, True)
    spark.catalog.refreshByPath(clean)
