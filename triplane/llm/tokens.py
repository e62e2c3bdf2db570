"""Text lengths in tokens of a public tokenizer, read from a vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

#: Ranks of a byte-level BPE, one "base64-token rank" a line; every executor must reach the path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How such vocabularies split text before merging. A fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, name: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of the whole ``text`` in place of it. NULL and empty texts have 0. A map over the rows."""
    keep = [c for c in df.columns if c != text]
    schema = StructType([*(df.schema[c] for c in keep), StructField(name, LongType(), False)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns[:-1], pa.array(sizes, pa.int64())], arrow, strict=True)], schema=arrow)

    return df.select(*keep, F.col(text)).mapInArrow(run, schema)
