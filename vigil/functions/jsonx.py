"""JSON extraction from model output and JSON text rendering.

Extraction is native: regexes, a brace-depth scan written as an
``aggregate`` over brace-terminated chunks, ``try_parse_json`` to a
VARIANT and ``try_variant_get`` for fields.  Spark's parser is stricter
than Python's: ``NaN`` and duplicate keys give null (documented difference).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import col_, strip_end_marker, strip_think, utrim

FENCE_RE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
GREEDY_RE = r"(?s)(\{.*\})"


def _starts_object(text: Column) -> Column:
    """The parsed value is an object iff its first non-whitespace char is '{'
    (the parser reads the first value), a much cheaper test than rendering
    the value's schema."""
    return text.rlike(r"^[ \t\n\r]*\{")


# A JSON string literal (possessive: no backtracking on long texts).
JSON_STRING_RE = r'"(?:[^"\\]++|\\.)*+"'


def object_end(text: Column) -> Column:
    """1-based position of the brace closing the first top-level object,
    ignoring braces inside JSON strings (escape-aware); 0 if it never closes.

    String literals are first blanked to ``""`` by one JVM regex pass (this
    keeps every brace outside strings and the text's shape), then the depth
    scan visits one element per brace.  Because blanking shortens the text,
    the result is an end position in the blanked text; ``_rest_is_blank``
    checks what follows it there, which is all the strictness check needs."""
    blank = F.regexp_replace(text, JSON_STRING_RE, '""')
    return _brace_end(blank)


def _brace_end(s: Column) -> Column:
    chunks = F.split(s, r"(?<=[{}])")
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"), F.lit(0).alias("e"))

    def step(acc, ch):
        last = F.substring(ch, -1, 1)
        d = acc["d"] + F.when(last == "{", 1).when(last == "}", -1).otherwise(0)
        n = acc["n"] + F.length(ch)
        e = F.when((acc["e"] == 0) & (d == 0) & (last == "}"), n).otherwise(acc["e"])
        return F.struct(d.alias("d"), n.alias("n"), e.alias("e"))

    return F.aggregate(chunks, init, step)["e"]


def _rest_is_blank(text: Column) -> Column:
    """True when the first top-level object closes and only JSON whitespace
    follows it."""
    blank = F.regexp_replace(text, JSON_STRING_RE, '""')
    end = _brace_end(blank)
    return (end > 0) & F.substring(blank, end + 1, 1 << 30).rlike(r"^[ \t\n\r]*$")


def parse_object(text: Column) -> Column:
    """VARIANT of a JSON object, null when the text is not exactly one.

    Spark's JSON readers stop after the first value and ignore trailing
    text; Python's ``json.loads`` rejects it ("Extra data").  So the parse
    only counts when nothing but JSON whitespace follows the object's
    closing brace."""
    v = F.try_parse_json(text)
    return F.when(v.isNotNull() & _starts_object(text) & _rest_is_blank(text), v)


def _group_or_null(text: Column, regex: str) -> Column:
    g = F.regexp_extract(text, regex, 1)
    return F.when(g != "", g)


def extract_json_tiers(c) -> Column:
    """Whole text, else the first fenced block, else the greedy span from
    the first '{' to the last '}' - the first that parses as an object."""
    t = utrim(col_(c))
    return F.coalesce(parse_object(t), parse_object(_group_or_null(t, FENCE_RE)),
                      parse_object(_group_or_null(t, GREEDY_RE)))


def balanced_prefix(c) -> Column:
    """From the first '{', the shortest prefix whose braces balance (braces
    inside JSON strings are counted, like the reference); null if none.

    The text is split after every brace, so the scan touches one element
    per brace, not per character."""
    t = col_(c)
    start = F.instr(t, "{")
    s = F.substring(t, start, F.greatest(F.length(t), F.lit(1)))
    chunks = F.split(s, r"(?<=[{}])")
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"), F.lit(0).alias("e"))

    def step(acc, ch):
        last = F.substring(ch, -1, 1)
        d = acc["d"] + F.when(last == "{", 1).when(last == "}", -1).otherwise(0)
        n = acc["n"] + F.length(ch)
        e = F.when((acc["e"] == 0) & (d == 0) & (last == "}"), n).otherwise(acc["e"])
        return F.struct(d.alias("d"), n.alias("n"), e.alias("e"))

    end = F.aggregate(chunks, init, step)["e"]
    return F.when((start > 0) & (end > 0), F.substring(s, 1, end))


def extract_json_robust(c, strip_marker: bool = False) -> Column:
    """Drop think blocks (T3), optionally the end marker (T4), trim;
    try the first fenced block; else the first balanced block from the first
    '{' - which must parse (no second try)."""
    t = strip_think(col_(c))
    if strip_marker:
        t = strip_end_marker(utrim(t))
    t = utrim(t)
    return F.coalesce(parse_object(_group_or_null(t, FENCE_RE)), parse_object(balanced_prefix(t)))


def field(v: Column, name: str, typ: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", typ)


# ---- T7 / T8: target object and its exact json.dumps(indent=2) bytes ----------
TARGET_KEYS = ["seriousness", "seriousness_criteria", "meddra_pt", "meddra_pt_code", "meddra_soc",
               "meddra_soc_code", "labelling_status", "labelling_evidence", "who_umc_category"]


def target_struct() -> Column:
    """The 9-key target, fixed order, nulls kept."""
    return F.struct(
        F.col("seriousness"),
        F.coalesce(F.col("seriousness_criteria"), F.array().cast("array<string>")).alias("seriousness_criteria"),
        F.col("meddra_pt"), F.col("meddra_pt_code").cast("long").alias("meddra_pt_code"),
        F.coalesce(F.col("meddra_soc"), F.lit("")).alias("meddra_soc"),
        F.col("meddra_soc_code").cast("long").alias("meddra_soc_code"),
        F.col("labelling_status"),
        F.coalesce(F.col("labelling_evidence"), F.lit("")).alias("labelling_evidence"),
        F.col("who_umc_category"))


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if v != v else int(v)
    if hasattr(v, "tolist"):
        return [_plain(x) for x in v.tolist()]
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if hasattr(v, "item"):
        return v.item()
    return v


@F.pandas_udf(StringType())
def target_json(s: pd.DataFrame) -> pd.Series:
    """``json.dumps(obj, indent=2)`` bytes (ASCII escapes, multi-line
    arrays, ``[]`` for empty ones, nulls kept).  Spark's ``to_json`` writes a
    different layout, so this one step runs in an Arrow batch."""
    cols = list(s.columns)
    out = []
    for row in s.itertuples(index=False, name=None):
        obj = {k: _plain(v) for k, v in zip(cols, row)}
        out.append(json.dumps(obj, indent=2))
    return pd.Series(out)


# ---- staged (DataFrame-level) forms: each intermediate is its own column, so
# no large expression is evaluated twice (higher-order functions run
# interpreted; Catalyst will not collapse projections that would duplicate them).
def _parse_staged(df, src: str, out: str):
    v, b, e = out + "_v", out + "_b", out + "_e"
    df = df.withColumn(v, F.try_parse_json(F.col(src)))
    ok_obj = F.col(v).isNotNull() & _starts_object(F.col(src))
    # the strictness scan runs only for texts that parsed as an object
    df = df.withColumn(b, F.when(ok_obj, F.regexp_replace(F.col(src), JSON_STRING_RE, '""')))
    df = df.withColumn(e, _brace_end(F.col(b)))
    ok = (F.col(e) > 0) & F.substring(F.col(b), F.col(e) + 1, 1 << 30).rlike(r"^[ \t\n\r]*$")
    return df.withColumn(out, F.when(F.col(b).isNotNull() & ok, F.col(v))).drop(v, b, e)


def with_json_robust(df, src: str, out: str = "parsed", strip_marker: bool = False):
    """T2 as staged columns; adds VARIANT column ``out`` (null = no object)."""
    t = strip_think(F.col(src))
    if strip_marker:
        t = strip_end_marker(utrim(t))
    df = df.withColumn("_jt", utrim(t))
    df = df.withColumn("_jf", _group_or_null(F.col("_jt"), FENCE_RE))
    df = _parse_staged(df, "_jf", "_jfv")
    df = df.withColumn("_jb", F.when(F.col("_jfv").isNull(), balanced_prefix(F.col("_jt"))))
    df = _parse_staged(df, "_jb", "_jbv")
    return df.withColumn(out, F.coalesce("_jfv", "_jbv")).drop("_jt", "_jf", "_jfv", "_jb", "_jbv")


def with_json_tiers(df, src: str, out: str = "parsed"):
    """T1 as staged columns."""
    df = df.withColumn("_jt", utrim(F.col(src)))
    df = _parse_staged(df, "_jt", "_j1")
    df = df.withColumn("_jf", F.when(F.col("_j1").isNull(), _group_or_null(F.col("_jt"), FENCE_RE)))
    df = _parse_staged(df, "_jf", "_j2")
    df = df.withColumn("_jg", F.when(F.col("_j1").isNull() & F.col("_j2").isNull(),
                                     _group_or_null(F.col("_jt"), GREEDY_RE)))
    df = _parse_staged(df, "_jg", "_j3")
    return df.withColumn(out, F.coalesce("_j1", "_j2", "_j3")).drop("_jt", "_jf", "_jg", "_j1", "_j2", "_j3")


# ---- T8 native fast path ---------------------------------------------------
# Python's ensure_ascii escapes every character outside ' '..'~'; inside that
# range only backslash and double quote need escaping, which is native.
_NOT_PRINTABLE_ASCII = "[^ -~]"


def _jstr(c: Column) -> Column:
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), esc, F.lit('"')))


def _jnum(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def target_json_native(t: Column) -> Column:
    """``json.dumps(target, indent=2)`` bytes for printable-ASCII values."""
    crit = t["seriousness_criteria"]
    arr = F.when(F.size(crit) == 0, F.lit("[]")).otherwise(F.concat(
        F.lit("[\n    "), F.array_join(F.transform(crit, _jstr), ",\n    "), F.lit("\n  ]")))
    parts = [F.lit('{\n  "seriousness": '), _jstr(t["seriousness"]),
             F.lit(',\n  "seriousness_criteria": '), arr,
             F.lit(',\n  "meddra_pt": '), _jstr(t["meddra_pt"]),
             F.lit(',\n  "meddra_pt_code": '), _jnum(t["meddra_pt_code"]),
             F.lit(',\n  "meddra_soc": '), _jstr(t["meddra_soc"]),
             F.lit(',\n  "meddra_soc_code": '), _jnum(t["meddra_soc_code"]),
             F.lit(',\n  "labelling_status": '), _jstr(t["labelling_status"]),
             F.lit(',\n  "labelling_evidence": '), _jstr(t["labelling_evidence"]),
             F.lit(',\n  "who_umc_category": '), _jstr(t["who_umc_category"]),
             F.lit("\n}")]
    return F.concat(*parts)


def with_target_json(df, out: str = "assistant_json"):
    """T7 + T8 over a materialised table: rows whose values are all printable
    ASCII are rendered natively; only the others go through the Arrow UDF
    (a Python UDF under CASE WHEN would still run on every row)."""
    x = df.withColumn("_t", target_struct())
    texts = [F.col(f"_t.{k}") for k in ("seriousness", "meddra_pt", "meddra_soc", "labelling_status",
                                        "labelling_evidence", "who_umc_category")]
    x = x.withColumn("_ascii", ~F.concat_ws("", *texts, "_t.seriousness_criteria").rlike(_NOT_PRINTABLE_ASCII))
    native = x.where(F.col("_ascii")).withColumn(out, target_json_native(F.col("_t")))
    python = x.where(~F.col("_ascii")).withColumn(out, target_json(F.col("_t")))
    return native.unionByName(python).drop("_t", "_ascii")
