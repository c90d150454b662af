"""Sizes of texts in tokens of a public tokenizer read from a vocabulary file."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder and file of the tokenizer; both are parameters of every operator that counts tokens.
TOKENIZERS = os.environ.get("PAGELORE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# --- fixed value: how this family of byte-level vocabularies cuts a text before merging ---------------------------
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# --- end of fixed value -------------------------------------------------------------------------------------------


@lru_cache(2)
def encoder(path: str):
    """The tokenizer of a rank file (tiktoken) or of a JSON file (tokenizers), as a function from texts to sizes."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def token_count(text: Column | str, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> Column:
    """The number of tokens of a text; 0 for null and empty texts."""
    path = os.path.join(folder, vocabulary)

    def count(texts: pa.Array) -> pa.Array:
        return pa.array(encoder(path)([t or "" for t in texts.to_pylist()]), pa.int64())

    return F.arrow_udf(count, "long")(text)
