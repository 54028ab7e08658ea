"""Sinks: reports, overwritten partitions, delimited exports."""

from __future__ import annotations

from pyspark.sql import DataFrame


ONE_FILE_BYTES = 64 << 20


def _fs(df: DataFrame, path: str):
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), p


def write_report(df: DataFrame, folder: str, name: str, order: list | None = None) -> str:
    """A tab-separated report ``folder/name.txt``, replaced if it is there. Rows are sorted by ``order`` where it is given, else they
    keep the order of ``df``. They are written by all tasks; up to ONE_FILE_BYTES the parts are put together to one file, a
    larger report stays a folder of parts in order."""
    staged = f"{folder}/.{name}-staged"
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").csv(staged, sep="\t", emptyValue="", nullValue="")
    jvm, fs, path = _fs(df, staged)
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.txt")
    parts = sorted((s for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
    fs.delete(target, True)
    if sum(s.getLen() for s in parts) > ONE_FILE_BYTES:
        if not fs.rename(path, target):
            raise OSError(f"can't rename {path} to {target}")
        return f"{folder}/{name}.txt"
    whole = fs.create(target)
    for s in parts:
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(s.getPath()), whole, 1 << 16, False)
    whole.close()
    fs.delete(path, True)
    return f"{folder}/{name}.txt"


def overwrite_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Parquet by partition; only the partitions that occur in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def export_delimited(df: DataFrame, path: str, *columns: str, sep: str = "\t") -> None:
    """Delimited text, by partition if columns are named."""
    out = df.write.mode("overwrite").option("sep", sep)
    (out.partitionBy(*columns) if columns else out).csv(path)
