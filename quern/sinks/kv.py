"""Writing rows as items of a key-value store, in batches, with retries.

A store is any picklable object with ``put(domain, items, replace)``, ``items`` being (name, attributes)
pairs whose attributes are name -> list of texts. :class:`FolderStore` is one on files; :class:`ParquetStore` merges whole frames.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Retry:
    """Calls again after an error of one of ``on``, ``times`` times, waiting longer each time; then the error is raised."""

    times: int = 8
    first_wait: float = 4.0
    factor: float = 2.0
    on: tuple[type[BaseException], ...] = (OSError,)
    sleep: Callable[[float], None] = field(default=time.sleep)

    def __call__(self, what: Callable, *args):
        wait = self.first_wait
        for left in range(self.times, -1, -1):
            try:
                return what(*args)
            except self.on:
                if not left:
                    raise
                self.sleep(wait)
                wait *= self.factor


@dataclass
class KVSink:
    """Items named ``prefix`` + the name fields joined by ':'; every other field becomes an attribute.

    Mode 'replace' sets attributes and may be repeated safely; 'append' adds values, so a task that Spark
    runs twice adds them twice. Null and empty fields are no attributes. A batch that still fails after all
    retries fails the job.
    """

    store: object
    domain: str
    name_fields: tuple[str, ...]
    prefix: str = ""
    mode: str = "replace"
    batch: int = 20
    retry: Retry = field(default_factory=Retry)

    def items(self, rows: Iterator) -> Iterator[tuple[str, dict[str, list[str]]]]:
        for row in rows:
            r = row.asDict()
            name = self.prefix + ":".join("" if r[f] is None else str(r[f]) for f in self.name_fields)
            yield name, {k: [str(v)] for k, v in r.items() if k not in self.name_fields and v is not None and v != ""}

    def write(self, df: DataFrame) -> None:
        if self.mode not in ("replace", "append"):
            raise ValueError(self.mode)

        def send(rows: Iterator) -> None:
            held: list = []
            for item in self.items(rows):
                held.append(item)
                if len(held) == self.batch:
                    self.retry(self.store.put, self.domain, held, self.mode == "replace")
                    held = []
            if held:
                self.retry(self.store.put, self.domain, held, self.mode == "replace")

        df.foreachPartition(send)


@dataclass
class FolderStore:
    """A store for :class:`KVSink` on a folder that all executors mount (``file:`` or a plain path): every batch is a file of its own, renamed into
    place once it is written. Reading puts them together; the executors' clocks tell which batch is later."""

    path: str

    def _folder(self, domain: str) -> str:
        return f"{self.path.removeprefix('file://').removeprefix('file:')}/{domain}"

    def put(self, domain: str, items: list, replace: bool) -> None:
        folder, name = self._folder(domain), uuid.uuid4().hex
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/.{name}", "w", encoding="utf-8") as f:
            for item, attributes in items:
                for k, values in attributes.items():
                    f.write(json.dumps({"name": item, "attribute": k, "values": values, "replace": replace, "at": time.time_ns()}) + "\n")
        os.rename(f"{folder}/.{name}", f"{folder}/{name}.json")

    def items(self, spark, domain: str) -> DataFrame:
        """(name, attribute, values in order): of replaced attributes the last batch counts, and what was appended after it."""
        rows = spark.read.schema("name string, attribute string, `values` array<string>, replace boolean, at bigint").json(f"file://{self._folder(domain)}")
        last = rows.groupBy("name", "attribute").agg(F.max(F.when(F.col("replace"), F.col("at"))).alias("last"))
        kept = rows.join(last, ["name", "attribute"]).where("last is null or at >= last")
        return kept.select("name", "attribute", F.explode("values").alias("v")).groupBy("name", "attribute").agg(F.array_sort(F.collect_set("v")).alias("values"))


class ParquetStore:
    """The same item semantics as one Parquet table per domain, (name, attribute, values), in versions. One writer per domain at a time."""

    def __init__(self, path: str):
        self.path = path

    def upsert(self, df: DataFrame, domain: str, name: str, replace: bool = True) -> None:
        """Merge a frame's rows into the domain; attributes of an item that the frame doesn't hold stay."""
        spark = df.sparkSession
        attributes = [c for c in df.columns if c != name]
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in attributes))).alias("x")
        new = df.select(F.col(name).cast("string").alias("name"), each).select("name", "x.*").where("value is not null and value <> ''").groupBy("name", "attribute").agg(F.array_sort(F.collect_set("value")).alias("new"))
        versions = self._versions(spark, domain)
        old = spark.read.parquet(f"{self.path}/{domain}/{versions[-1]}") if versions else None
        if old is None:
            merged = new.withColumnRenamed("new", "values")
        else:
            both = old.join(new, ["name", "attribute"], "full_outer")
            values = F.coalesce("new", "values") if replace else F.array_sort(F.array_union(F.coalesce("values", F.array().cast("array<string>")), F.coalesce("new", F.array().cast("array<string>"))))
            merged = both.select("name", "attribute", values.alias("values"))
        # The new version counts once it is complete; a failure before leaves the old one, which is kept until the next upsert.
        number = int(versions[-1][1:]) + 1 if versions else 0
        merged.write.mode("overwrite").parquet(f"{self.path}/{domain}/v{number:09}")
        fs, path = self._fs(spark, domain)
        for v in versions[:-1]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, v), True)

    def _fs(self, spark, domain: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{domain}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self, spark, domain: str) -> list[str]:
        """The complete versions of a domain, oldest first."""
        fs, path = self._fs(spark, domain)
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
        return [n for n in names if n.startswith("v") and fs.exists(done(done(path, n), "_SUCCESS"))]

    def items(self, spark, domain: str) -> DataFrame:
        """(name, attributes map) of a domain."""
        rows = spark.read.parquet(f"{self.path}/{domain}/{self._versions(spark, domain)[-1]}")
        return rows.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "values"))).alias("attributes"))
