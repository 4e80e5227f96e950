"""Sizes of texts in the tokens of a byte-level vocabulary, counted in Arrow batches."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Long white space (Unicode White_Space). The pattern's look-ahead takes a step of a stack for each character of it.
_LONG = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
#: Splits text before the merges; the sizes below rely on how it splits white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """ranks: the lines of a rank file, each the base64 of a token's bytes and its rank."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})

    def size(self, text: str) -> int:
        """The number of tokens of the whole text; names of special tokens are ordinary text. Long white space is a
        piece of its own but for its last character, which stays with what follows, as the pattern has it."""
        n = at = 0
        for found in _LONG.finditer(text):
            start, end = found.span()
            end -= end < len(text)
            n += len(self.encoding.encode_ordinary(text[at:start])) + len(self.encoding._core_bpe.encode_single_piece(text[start:end].encode()))
            at = end
        return n + len(self.encoding.encode_ordinary(text[at:]))


_BUILT: dict[bytes, Tokenizer] = {}


def sized(rows: DataFrame, text: str, ranks: bytes) -> DataFrame:
    """The rows with tokens (bigint) in place of the text; null texts are left out. ranks: the content of a rank file,
    sent to every worker, so that workers need no path; each builds its tokenizer once."""
    rest = [c for c in rows.columns if c != text]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value not in _BUILT:
            _BUILT[shared.value] = Tokenizer(shared.value)
        tokenizer = _BUILT[shared.value]
        for batch in batches:
            sizes = [tokenizer.size(t.decode("utf-8", "replace")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64())], names=[*rest, "tokens"])

    return rows.where(F.col(text).isNotNull()).select(F.col(text).cast("binary"), *rest).mapInArrow(run, f"{kinds}, tokens bigint")
