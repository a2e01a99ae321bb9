"""Text sizes in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie, unless the environment says otherwise.
VOCABULARY = os.environ.get("MANYWORLDS_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-tokenizer of that vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRETOKEN = regex.compile(PATTERN)
#: Characters tokenized at once. Longer texts are cut where the pre-tokenizer cuts them anyway.
PIECE = 100_000


def encoder(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file (base64 token, rank per line)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(encoding: tiktoken.Encoding, text: str) -> int:
    """Tokens of a text; strings of special tokens are ordinary text. Very long texts are counted in pieces between
    pre-tokens, which no token spans; a pre-token longer than a piece is counted by itself."""
    if len(text) <= PIECE:
        return len(encoding.encode_ordinary(text))
    total, start, end = 0, 0, 0
    for m in _PRETOKEN.finditer(text):
        if m.end() - start > PIECE:
            total += len(encoding.encode_ordinary(text[start:end]))
            start = end
            if m.end() - start > PIECE:
                total += len(encoding._encode_single_piece(m[0].encode("utf-8", "replace")))  # noqa: SLF001  ordinary encoding would search it for pre-tokens again
                start = m.end()
        end = m.end()
    return total + len(encoding.encode_ordinary(text[start:]))


def sized(documents: DataFrame, doc_id: str, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """``doc_id``, the columns of `keep` as strings and ``tokens``. A null text has 0 tokens."""
    schema = "doc_id bigint, " + "".join(f"{k} string, " for k in keep) + "tokens bigint"
    cut = documents.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), *(F.col(k).cast("string").alias(k) for k in keep), F.col(text).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = encoder(path)
        for batch in batches:
            sizes = [0 if t is None else token_count(encoding, t) for t in batch["text"]]
            yield batch.drop(columns="text").assign(tokens=sizes)

    return cut.mapInPandas(count, schema)
