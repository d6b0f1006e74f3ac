"""Scalar text functions as Column expressions (JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace removed by Python's str.strip(): Unicode White_Space plus the
# four information separators U+001C..U+001F.
_WS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """Unicode-aware strip (``trim`` only removes U+0020); reads the ends only, where a
    pattern for the end would be tried at every character."""
    return F.btrim(col_(c), F.lit(_WS))


def blank_to_empty(c) -> Column:
    """Missing -> '' (the reference's ``.get(k, '')`` null model)."""
    return F.coalesce(col_(c).cast("string"), F.lit(""))


def strip_echo(c) -> Column:
    """Drop an echoed leading ``Narrative:`` label (any case), then strip."""
    return utrim(F.regexp_replace(col_(c), r"(?i)^Narrative:\s*", ""))


def strip_think(c) -> Column:
    """Remove ``<think>...</think>`` blocks (dot-all, non-greedy); an
    unclosed block is left as it is."""
    return F.regexp_replace(col_(c), r"(?s)<think>.*?</think>", "")


END_MARKER = "<|im_end|>"


def strip_end_marker(c) -> Column:
    return F.replace(col_(c), F.lit(END_MARKER), F.lit(""))


def prefix(c, n: int) -> Column:
    """First ``n`` code points (slicing ``s[:n]``)."""
    return F.substring(col_(c), 1, n)


def ci_equal(a, b) -> Column:
    """``(a or '').lower() == (b or '').lower()``."""
    return F.lower(F.coalesce(col_(a), F.lit(""))) == F.lower(F.coalesce(col_(b), F.lit("")))


def null_safe_equal(a, b) -> Column:
    """Python ``==`` on optional values: None == None is true."""
    return col_(a).eqNullSafe(col_(b))


def code_map(c, table: dict, default: str | None) -> Column:
    """Decode a code through a small constant table (``dict.get(code, default)``)."""
    pairs = []
    for k, v in table.items():
        pairs += [F.lit(k), F.lit(v)]
    looked = F.try_element_at(F.create_map(*pairs), col_(c).cast("string"))
    return looked if default is None else F.coalesce(looked, F.lit(default))


def token_estimate(c) -> Column:
    """``len(text) // 4`` in code points."""
    return F.floor(F.length(col_(c)) / F.lit(4)).cast("long")
