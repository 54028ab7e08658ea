"""Token counts of texts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VOCABULARY = os.environ.get("QUERN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pre-tokenizing pattern that belongs to byte-level BPE vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _count(path: str, split: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def size(text: str) -> int:
            return len(encoding.encode_ordinary(text))

        for batch in batches:
            prompts, totals = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                cut = text.find(split)
                cut = len(text) if cut < 0 else cut + 1
                prompts.append(size(text[:cut]) if cut else 0)
                totals.append(prompts[-1] + (size(text[cut:]) if cut < len(text) else 0))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(totals, pa.int64()), pa.array(prompts, pa.int64())], [*names, "n_tokens", "n_prompt"])

    return run


def token_counts(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, response_from: str = "\ndiff --git ", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns to keep..., n_tokens, n_prompt) of every whole text: all tokens, and those of the prompt - header and message, up to the
    first file of the diff - which bear no loss; prompt and response are encoded separately. Null and
    empty texts have 0 tokens. The vocabulary file needs to lie on the driver only, which sends it to the executors."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    rows = documents.select(F.col("doc_id").cast("bigint"), *keep, "text")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"]).add("n_tokens", T.LongType()).add("n_prompt", T.LongType())
    return rows.mapInArrow(_count(vocabulary, response_from), schema)
