"""Byte-level BPE inside tasks: one encoder per Python worker, read from a vocabulary file whose path is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401

END_OF_TEXT = "<|endoftext|>"
LONGEST_SPACE = 20_000  # the rank encoder's pattern needs stack for each character of a run of white space


@lru_cache(maxsize=4)
def encoder(ranks_path: str):
    """The encoder of a ``.tiktoken`` vocabulary. It knows no special tokens: their strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def plain_tokenizer(json_path: str):
    """The tokenizer of a ``.json`` vocabulary as its file defines it, special tokens included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def document_ids(text: str, ranks_path: str, json_path: str) -> list[int]:
    """What ``Tokenizer.from_file(json_path).encode(text, add_special_tokens=False)`` gives.

    Both files hold the same merges, and the rank encoder is over three times as fast; a text that holds the string of the
    special token, or a run of more than ``LONGEST_SPACE`` characters of white space, goes to the tokenizer itself.
    """
    if END_OF_TEXT in text or len(text) > LONGEST_SPACE and any(m.end() - m.start() > LONGEST_SPACE for m in re.finditer(r"\s+", text)):
        return plain_tokenizer(json_path).encode(text, add_special_tokens=False).ids
    return encoder(ranks_path).encode_ordinary(text)


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into parts of about ``limit`` bytes of one text column (one row at least), to bound a task's memory."""
    start, held = 0, 0
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(lengths):
        held += n or 0
        if held > limit and i > start:
            yield batch.slice(start, i - start)
            start, held = i, n or 0
    if start < batch.num_rows:
        yield batch.slice(start)
