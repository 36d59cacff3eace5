"""Encoding and decoding with a public byte-pair vocabulary, in Arrow batches."""

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Vocabulary file of a public tokenizer, a parameter everywhere, and the pattern its texts are cut with.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Tokenizer:
    """Column functions of one vocabulary, which is read on the driver and sent to the executors (a file of bounded size)."""

    def __init__(self, spark: SparkSession, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        with open(vocabulary, "rb") as f:
            self.shared = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def _udf(self, each, kind):
        shared, pattern = self.shared, self.pattern

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            code = tiktoken.Encoding("shared", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for values in batches:
                yield values.map(lambda v: None if v is None else each(code, v))

        return F.pandas_udf(run, kind)

    def encode(self, c: Column) -> Column:
        """Token numbers; null stays null."""
        return self._udf(lambda code, v: code.encode_ordinary(v), ArrayType(IntegerType()))(c)

    def decode(self, c: Column) -> Column:
        """Text of token numbers; null stays null."""
        return self._udf(lambda code, v: code.decode([int(x) for x in v]), StringType())(c)

    def count(self, c: Column) -> Column:
        """Number of tokens; null has none."""
        return F.coalesce(self._udf(lambda code, v: len(code.encode_ordinary(v)), IntegerType())(c), F.lit(0))
