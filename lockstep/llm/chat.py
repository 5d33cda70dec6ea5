"""Operator 1, chat formatting: token-level assembly of conversations.

Every segment of a turn (role, line end, text) is encoded by itself and the reserved ids are spliced between, so no merge can
cross a border and no content can produce a reserved id. A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. The loss mask is a
prefix sum over +1 and -1 marks at the borders of the texts that are learned. Control strings inside roles and texts are
escaped by one more backslash after their ``<``, which :func:`unescape` takes away again.

Work is row by row until the digest of a whole conversation, which streams through one task in turn order and holds a hash
state only: a conversation with a third of all rows needs no more memory than one with two.

Defined results: null text or role is empty; null turns come first; rows with equal turn are ordered by role, then text;
repeated rows count each; a null conv_id is a conversation of its own; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.encoding import document_ids, encoder, slices

START, END = "<|im_start|>", "<|im_end|>"
_RAW = re.compile(r"<(\\*)\|(?=(?:im_start|im_end|endoftext)\|>)")
_ESCAPED = re.compile(r"<\\(\\*)\|(?=(?:im_start|im_end|endoftext)\|>)")
FORMATTED = "conv_id long, turn long, input_ids array<int>, loss_mask array<tinyint>"
TURNS = "conv_id long, turn long, role string, text string, loss_text string, formatted_chars long, n_tokens long, loss_tokens long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def escape(text: str) -> str:
    return _RAW.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line, so its line ends are escaped too."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(roles: list[str], texts: list[str], learned: tuple[str, ...], ranks_path: str, json_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and mask of all turns, one after the other, and the borders of the turns (one more than there are turns)."""
    encode = lambda text: document_ids(text, ranks_path, json_path)
    start, end = reserved(ranks_path)
    line = encode("\n")
    segments = [s for role, text in zip(roles, texts, strict=True) for s in ([start], encode(escape_role(role)), line, encode(escape(text)), [end], line)]
    borders = np.concatenate([[0], np.cumsum([len(s) for s in segments], dtype=np.int64)])
    ids = np.fromiter((i for s in segments for i in s), np.int32, int(borders[-1]))
    own = np.array([role in learned for role in roles], dtype=np.int64)
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, borders[3:-1:6], own)
    np.add.at(marks, borders[4::6], -own)
    return ids, np.cumsum(marks[:-1]).astype(np.int8), borders[::6]


def reserved(ranks_path: str) -> tuple[int, int]:
    """Two ids after those of the vocabulary and its one special token."""
    after = encoder(ranks_path).max_token_value + 2
    return after, after + 1


def format_chat(turns: DataFrame, ranks_path: str, json_path: str, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn of ``conv_id, turn, role, text`` with its ids and loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, mask, borders = assemble(batch.column("role").to_pylist(), batch.column("text").to_pylist(), learned, ranks_path, json_path)
                at = pa.array(borders, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (ids, mask)]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *lists], names=["conv_id", "turn", "input_ids", "loss_mask"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    return plain.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, ranks_path: str) -> DataFrame:
    """Role, text and learned text of each formatted turn, from its ids and mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, end = reserved(ranks_path)
        decode = lambda ids: encoder(ranks_path).decode_bytes(ids.tolist()).decode()
        for batch in batches:
            rows = []
            for ids, mask in zip(batch.column("input_ids"), batch.column("loss_mask"), strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                (close,) = np.flatnonzero(ids == end)
                if ids[0] != start or np.count_nonzero(ids == start) != 1:
                    raise ValueError("a turn must begin with the start id and hold it once")
                inside, tail = decode(ids[1:close]), decode(ids[close + 1 :])
                role, _, text = inside.partition("\n")
                loss = unescape(decode(ids[mask == 1]))
                rows.append((unescape_role(role), unescape(text), loss, len(START) + len(inside) + len(END) + len(tail), len(ids), int(mask.sum())))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string()] * 3 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in TURNS.split(", ")])

    return formatted.mapInArrow(run, TURNS)


def digest(turns: DataFrame) -> DataFrame:
    """One row per conversation of what :func:`read_back` gives. A digest needs its bytes in order, so a conversation's turns
    pass through one task, sorted, one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        out: list[tuple] = []
        for batch in batches:
            for conv, role, text, loss, chars, tokens, learned in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "formatted_chars", "n_tokens", "loss_tokens")), strict=True):
                if key != (conv,):
                    if key:
                        out.append((key[0], sums[0], every.hexdigest(), sums[1], masked.hexdigest(), *sums[2:]))
                    key, every, masked, sums = (conv,), hashlib.sha256(), hashlib.sha256(), np.zeros(5, np.int64)
                every.update(f"{role}\n{text}\n".encode())
                masked.update(loss.encode())
                sums += (1, len(loss), chars, tokens, learned)
            if len(out) > 1000:
                yield _digests(out)
                out = []
        if key:
            out.append((key[0], sums[0], every.hexdigest(), sums[1], masked.hexdigest(), *sums[2:]))
        yield _digests(out)

    order = ("conv_id", "turn", "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in DIGESTS.split(", ")])
