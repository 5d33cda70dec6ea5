"""Column expressions for FASTA text, interval slices, labels and result rows. None needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_ID = "Seq"
#: White space that is cut at the right end of a line: all of Unicode's, and the four separators U+001C to U+001F.
_RIGHT_SPACE = r"(?U)[\s\u001c-\u001f]+$"


def text_lines(text: Column) -> Column:
    """The lines of a text whose line ends are ``\\n``, ``\\r\\n`` or ``\\r``."""
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def strip_right(line: Column) -> Column:
    return F.regexp_replace(line, _RIGHT_SPACE, "")


def strip(line: Column) -> Column:
    return F.regexp_replace(strip_right(line), r"(?U)^[\s\u001c-\u001f]+", "")


def fasta_id(text: Column) -> Column:
    """The header up to ``|`` without ``>`` and blanks; ``Seq`` where the first line is no header."""
    head = strip_right(F.element_at(text_lines(text), 1))
    return F.when(head.startswith(">"), F.translate(F.substring_index(head, "|", 1), "> ", "")).otherwise(NO_ID)


def fasta_body(text: Column) -> Column:
    """All lines but the first, cut at the right and joined. The first is never data, and later ``>`` lines are."""
    lines = text_lines(text)
    return F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), strip_right), "")


def bounds(n: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Where ``[start:end]`` begins and stops in a sequence of ``n`` letters, by Python's rules; an end of ``L-1`` means up to the last letter."""
    clipped = lambda k: F.when(k < 0, F.greatest(n + k, F.lit(0))).otherwise(F.least(k, n))
    return clipped(start.cast("long")), F.when(end == "L-1", n).otherwise(clipped(end.try_cast("long")))


def interval(seq: Column, start: Column, end: Column) -> Column:
    """``seq[start:end]`` with Python's rules. ``start`` and ``end`` are texts; an end of ``L-1`` means up to the last letter."""
    first, stop = bounds(F.length(seq).cast("long"), start, end)
    return F.substring(seq, (first + 1).cast("int"), F.greatest(stop - first, F.lit(0)).cast("int"))


def letters(seq: Column) -> Column:
    """One element a code point; none for an empty or null sequence."""
    return F.when(seq != "", F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def label(seq_id: Column, ordinal: Column) -> Column:
    """``Seq_`` and the id, or for headerless sequences the 1-based ordinal inside their side."""
    return F.concat(F.lit("Seq_"), F.when(seq_id == NO_ID, ordinal.cast("string")).otherwise(seq_id))


def equal_as_sign(first: Column, seconds: Column) -> Column:
    """Letters equal to the first letter written ``=``; missing ones stay null."""
    return F.transform(seconds, lambda x: F.when(x == first, "=").otherwise(x))


def any_differs(first: Column, seconds: Column) -> Column:
    """Whether at least one letter is there and is not the first letter."""
    return F.coalesce(F.exists(seconds, lambda x: x.isNotNull() & (x != first)), F.lit(False))


def row_text(index: Column, first: Column, seconds: Column) -> Column:
    """A result row as a line: comma-joined, without quotes, blanks, parentheses and brackets; missing letters leave no field."""
    return F.translate(F.concat_ws(",", index.cast("string"), first, F.array_join(seconds, ",")), "' ()[]", "")


def group_name(first: Column, seconds: Column) -> Column:
    """``sequence_i_diff_sequence_j``, or ``sequence_i_diff_sequences_j1_to_jm`` for several."""
    one = F.format_string("sequence_%d_diff_sequence_%d", first, F.element_at(seconds, 1))
    return F.when(F.size(seconds) == 1, one).otherwise(F.format_string("sequence_%d_diff_sequences_%d_to_%d", first, F.element_at(seconds, 1), F.element_at(seconds, -1)))
