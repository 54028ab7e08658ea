"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage with a table written here. The folder is the
one the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests,
a laptop) a temporary one is made. Losing an executor never loses such a table.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; set here only if the session has none."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quern-scratch-")
        spark.sparkContext.setCheckpointDir(named)
    return named


_open: list[list[Scratch]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are deleted at its end; results that depend on them must be written or collected before.
    Without a scope they stay until the interpreter ends."""
    own: list[Scratch] = []
    _open.append(own)
    try:
        yield
    finally:
        _open.remove(own)
        for s in own:
            s.clear()


class Scratch:
    """Tables of one run. ``write`` returns the table as read back, ``drop`` deletes one early."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self.clear)
        if _open:
            _open[-1].append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        self._delete(self.root)
        atexit.unregister(self.clear)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session is gone; the cluster clears its own folder
            pass
