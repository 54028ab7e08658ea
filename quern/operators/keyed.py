"""Keyed counts and names merged into one item table, and activity counts from nested documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import day_token, tab_fields
from ..schemas import ACTIVITY_DOCUMENT

NAMELESS = "empty"


def names_of(lines: DataFrame, line_col: str = "line", marker: str = "/guid/") -> DataFrame:
    """(id, name) from 'name<tab>id' lines with at least two fields whose id holds the marker."""
    f = tab_fields(F.col(line_col))
    return lines.where((F.size(f) >= 2) & F.contains(F.get(f, F.lit(1)), F.lit(marker))).select(F.get(f, F.lit(1)).alias("id"), F.get(f, F.lit(0)).alias("name"))


def kv_merge(counts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, count, name): the item table after both upserts. An id without a count has null there, one without
    a name 'empty'; of several names the first in order stays."""
    one = names.groupBy("id").agg(F.min("name").alias("name"))
    return counts.select("id", "count").join(one, "id", "full_outer").select("id", "count", F.coalesce("name", F.lit(NAMELESS)).alias("name"))


def interactions(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """One row per interaction of each JSON document, flattened, with ``key_date``; text that is no such
    document has none."""
    parsed = documents.select(F.from_json(json_col, ACTIVITY_DOCUMENT).alias("d")).select("d.id", "d.hash", F.explode("d.interactions").alias("x"))
    i = "x.interaction"
    return parsed.select(
        F.col("id").alias("object_id"), "hash", *(F.col(f"{i}.{c}").alias(f"interaction_{c}") for c in ("id", "content", "created_at", "link", "source")),
        *(F.col(f"{i}.author.{c}").alias(f"author_{c}") for c in ("id", "avatar", "link", "name", "username")), F.col(f"{i}.schema.version").alias("schema_version"),
        day_token(F.col(f"{i}.created_at")).alias("key_date"),
    )


def posts_per_day(flat: DataFrame) -> DataFrame:
    """(day, count) of interactions; those without a creation time are left out."""
    return flat.where("key_date is not null").groupBy(F.col("key_date").alias("day")).agg(F.count(F.lit(1)).alias("count"))


def as_json(flat: DataFrame) -> DataFrame:
    """(key_date, json): each interaction as one JSON text, properly escaped."""
    return flat.select("key_date", F.to_json(F.struct(*[c for c in flat.columns if c != "key_date"])).alias("json"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, json) to (id, path, value): one row for each value that is neither an object nor an array."""
    for batch in batches:
        out = []
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                todo = [("", json.loads(text))] if text is not None else []
            except ValueError:
                continue
            while todo:
                path, x = todo.pop()
                inner = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else None
                if inner is None:
                    out.append((ident, path, None if x is None else x if isinstance(x, str) else json.dumps(x)))
                else:
                    todo.extend((f"{path}.{k}" if path else str(k), v) for k, v in inner)
        cols = list(zip(*out)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["id", "path", "value"])


def json_paths(documents: DataFrame, ident: str, json_col: str = "json") -> DataFrame:
    """(id, path, value) of every plain value of JSON documents of any shape, paths being dotted as in ``a.0.b``; the path of
    a document that is a plain value is empty. Text that is no JSON has none, nor have empty objects and arrays."""
    return documents.select(F.col(ident).cast("string").alias("id"), F.col(json_col).alias("json")).mapInArrow(_paths, "id string, path string, value string")
