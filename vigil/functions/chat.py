"""Chat records: message arrays, flat chat text, narrative / gold pull,
token estimate and response-only loss masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, utrim

# ---- fixed values (must equal the reference's) ---------------------------------
SYSTEM_PROMPT = (
    "You are an expert pharmacovigilance medical reviewer. "
    "Analyze clinical safety narratives and provide structured assessments "
    "according to ICH E2D guidelines and MedDRA coding standards.")
INSTRUCTION = (
    "Analyze the following clinical safety narrative. "
    "Provide a structured medical review covering:\n"
    "1. Seriousness assessment with specific ICH E2D criteria\n"
    "2. MedDRA coding: Preferred Term (PT) and System Organ Class (SOC)\n"
    "3. Labelling status: Expected or Unexpected, with brief evidence\n"
    "4. Causality: WHO-UMC category\n"
    "Return your assessment as a JSON object.")
IM_START, IM_END = "<|im_start|>", "<|im_end|>"
NARRATIVE_MARKERS = ("Narrative:\n", "Narrative: ")     # tried in this order
RESPONSE_TEMPLATE = "<|im_start|>assistant\n"
MAX_SEQ_LENGTH = 2048
IGNORE_INDEX = -100
# Inference prompt user turn (three variants differ; the template id is a column).
INFER_INSTRUCTION = (
    "Analyze the following clinical safety narrative and return a structured JSON assessment "
    "covering seriousness, MedDRA coding, labelling status, and WHO-UMC causality.")
# --------------------------------------------------------------------------------


def user_content(narrative) -> Column:
    return F.concat(F.lit(INSTRUCTION + "\n\nNarrative:\n"), col_(narrative))


def chat_messages(narrative, assistant_json) -> Column:
    """System / user / assistant messages."""
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(msg("system", F.lit(SYSTEM_PROMPT)), msg("user", user_content(narrative)),
                   msg("assistant", col_(assistant_json)))


def flat_text(messages) -> Column:
    """``<|im_start|>role\\ncontent<|im_end|>`` per message, joined by
    newlines, no trailing newline."""
    return F.array_join(F.transform(col_(messages), lambda m: F.concat(
        F.lit(IM_START), m["role"], F.lit("\n"), m["content"], F.lit(IM_END))), "\n")


def _after_marker(content: Column) -> Column:
    a, b = NARRATIVE_MARKERS
    ia, ib = F.instr(content, a), F.instr(content, b)
    return (F.when(ia > 0, utrim(F.substring(content, ia + len(a), 1 << 30)))
            .when(ib > 0, utrim(F.substring(content, ib + len(b), 1 << 30))))


def narrative_from_messages(messages) -> Column:
    """T5: text after the marker in the first user message holding one; ''."""
    users = F.filter(col_(messages), lambda m: m["role"] == "user")
    found = F.filter(F.transform(users, lambda m: _after_marker(m["content"])), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, 0), F.lit(""))


def narrative_after_marker(content) -> Column:
    """T5 for one message (relational form over message rows)."""
    return _after_marker(col_(content))


def first_assistant(messages) -> Column:
    """T6 input: content of the first assistant message (null if none)."""
    return F.get(F.filter(col_(messages), lambda m: m["role"] == "assistant"), 0)["content"]


def infer_prompt(narrative, variant: str = "infer") -> Column:
    """User turn of the inference prompt; variants differ in the
    separator before the narrative (batch and demo turns are alike)."""
    sep = {"eval": "\nNarrative: ", "infer": "\n\nNarrative: ", "demo": "\n\nNarrative: "}[variant]
    return F.concat(F.lit(INFER_INSTRUCTION + sep), utrim(col_(narrative)), F.lit("\n\nOutput:"))


def truncate_ids(ids, max_len: int = MAX_SEQ_LENGTH) -> Column:
    """Truncation of token ids."""
    return F.slice(col_(ids), 1, max_len)


def response_mask(ids, template: list[int], attention=None) -> Column:
    """labels = ids with every position up to and including the LAST
    occurrence of the template set to -100; template absent -> all -100;
    padding positions (attention 0) -> -100.

    The last occurrence is found by a JVM string search (on the reversed
    comma-joined ids), and the labels are built with
    ``array_repeat`` + ``slice``: no per-element lambda on the hot path."""
    x = col_(ids)
    t = len(template)
    n = F.size(x)
    joined = F.concat(F.lit(","), F.array_join(x, ","), F.lit(","))
    pat = "," + ",".join(str(v) for v in template) + ","
    # last occurrence = first occurrence in the reversed string
    rpos = F.instr(F.reverse(joined), F.lit(pat[::-1]))
    found = rpos > 0
    prefix = F.substring(joined, 1, F.length(joined) - rpos - len(pat) + 1)
    # tokens before the match = commas in the prefix (the prefix starts with one)
    start = F.length(prefix) - F.length(F.replace(prefix, F.lit(","), F.lit("")))
    until = F.when(found & (n >= t), start + t).otherwise(n)
    lab = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), until), F.slice(x, until + 1, F.greatest(n - until, F.lit(1))))
    lab = F.when(until >= n, F.array_repeat(F.lit(IGNORE_INDEX), n)).otherwise(lab)
    if attention is not None:
        a = col_(attention)
        lab = F.zip_with(lab, a, lambda v, m: F.when(m == 0, F.lit(IGNORE_INDEX)).otherwise(v))
    return lab


def byte_tokenizer(texts: list[str]) -> list[list[int]]:
    """Default offline tokenizer: UTF-8 bytes as ids (any callable with the
    same signature can be plugged in, e.g. a subword tokenizer)."""
    return [list(t.encode("utf-8")) if t is not None else [] for t in texts]


def _last_end(ids_bytes: bytes, tpl_bytes: bytes, width: int, n: int, t: int) -> int:
    """Index just past the last occurrence of the template (n when absent);
    ``width`` = bytes per id, matches must be id-aligned."""
    if t == 0 or n < t:
        return n
    end = len(ids_bytes)
    while True:
        pos = ids_bytes.rfind(tpl_bytes, 0, end)
        if pos < 0:
            return n
        if pos % width == 0:
            return pos // width + t
        end = pos + len(tpl_bytes) - 1


def _byte_rows(texts, max_len: int):
    """Bytes of the texts of an Arrow string array, each cut at ``max_len`` (null: none), one after the other, the
    lengths kept, and the lengths before the cut.  The array's own buffers are read; no text becomes a Python object."""
    import numpy as np
    import pyarrow as pa
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    whole = np.diff(at)
    lens = np.minimum(whole, max_len)
    if (whole > max_len).any():
        start = at[:-1] - at[0]
        buf = np.concatenate([buf[s:s + n] for s, n in zip(start.tolist(), lens.tolist())])
    return buf, lens, whole


def tokenize(df, text_col: str = "text", tokenizer=byte_tokenizer, max_len: int = MAX_SEQ_LENGTH,
             keep: list[str] | None = None, response_template: list[int] | None = None, count_col: str | None = None):
    """Batched tokenisation, truncated to ``max_len``; the text column is
    dropped.  Adds ``input_ids`` and ``attention_mask``.

    Runs as ``mapInArrow``: ids leave Python as one flat int32 buffer plus
    offsets per batch (no per-row Python lists through pandas).  The attention
    mask, a one for each id, is made from their number where it is read.  The default
    byte tokenizer is vectorised (the texts of a batch viewed as
    one byte buffer); any callable ``list[str] -> list[list[int]]`` plugs in; if it has
    ``packed``, which gives each text's ids as the bytes of int32 numbers, that is used.
    With ``response_template`` it also adds ``mask_until`` (T13 boundary: just
    past the last template occurrence, found by a C-level ``rfind`` in the
    batch) for ``with_response_mask(..., until_col="mask_until")``.  ``count_col``
    names a column for the number of ids before the cut."""
    import itertools

    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
    keep = keep or [c for c in df.columns if c != text_col]
    ints = ArrayType(IntegerType())
    extra = [StructField("mask_until", IntegerType())] if response_template is not None else []
    extra += [StructField(count_col, IntegerType())] if count_col else []
    schema = StructType(list(df.select(*keep).schema.fields) + [StructField("input_ids", ints)] + extra)
    tpl = list(response_template or [])
    byte_tpl = bytes(tpl) if tpl and all(0 <= v < 256 for v in tpl) else None
    int_tpl = np.asarray(tpl, dtype=np.int32).tobytes()
    packed = getattr(tokenizer, "packed", None)

    def run(batches):
        for rb in batches:
            if tokenizer is byte_tokenizer:
                buf, lens, whole = _byte_rows(rb.column(text_col), max_len)
                flat = buf.astype(np.int32)
                if response_template is not None:
                    joined, ends = buf.tobytes(), np.cumsum(lens).tolist()
                    until = [(_last_end(joined[e - n:e], byte_tpl, 1, n, len(tpl)) if byte_tpl is not None else n)
                             for e, n in zip(ends, lens.tolist())]
            elif packed is not None:
                ids = packed(rb.column(text_col).to_pylist())
                whole = [len(x) // 4 for x in ids]
                ids = [x[:4 * max_len] for x in ids]
                lens = np.fromiter((len(x) // 4 for x in ids), dtype=np.int32, count=len(ids))
                flat = np.frombuffer(b"".join(ids), dtype=np.int32)
                if response_template is not None:
                    until = [_last_end(x, int_tpl, 4, len(x) // 4, len(tpl)) for x in ids]
            else:
                ids = tokenizer(rb.column(text_col).to_pylist())
                whole = [len(x) for x in ids]
                ids = [x[:max_len] for x in ids]
                lens = np.fromiter((len(x) for x in ids), dtype=np.int32, count=len(ids))
                flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32, count=int(lens.sum()))
                if response_template is not None:
                    until = [_last_end(np.asarray(x, dtype=np.int32).tobytes(), int_tpl, 4, len(x), len(tpl))
                             for x in ids]
            offsets = np.zeros(len(lens) + 1, dtype=np.int32)
            np.cumsum(lens, out=offsets[1:])
            off = pa.array(offsets)
            cols = [rb.column(c) for c in keep]
            cols.append(pa.ListArray.from_arrays(off, pa.array(flat, type=pa.int32())))
            names = keep + ["input_ids"]
            if response_template is not None:
                cols.append(pa.array(until, type=pa.int32()))
                names.append("mask_until")
            if count_col:
                cols.append(pa.array(whole, type=pa.int32()))
                names.append(count_col)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = df.select(*keep, text_col).mapInArrow(run, schema)
    ones = F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask")
    return out.select(*keep, "input_ids", ones, *[f.name for f in extra])


def with_response_mask(df, ids_col: str, template: list[int], out: str = "labels",
                       attention_col: str | None = None, until_col: str | None = None):
    """T13 as staged columns (each intermediate computed once per row).
    ``until_col`` = a boundary already found while tokenising; otherwise the
    last template occurrence is searched in the JVM."""
    if until_col is not None:
        n = F.size(ids_col)
        u = F.col(until_col)
        lab = F.when(u >= n, F.array_repeat(F.lit(IGNORE_INDEX), n)).otherwise(F.concat(
            F.array_repeat(F.lit(IGNORE_INDEX), u), F.slice(ids_col, u + 1, F.greatest(n - u, F.lit(1)))))
        x = df.withColumn(out, lab)
        if attention_col:
            x = x.withColumn(out, F.zip_with(out, attention_col,
                                             lambda v, m: F.when(m == 0, F.lit(IGNORE_INDEX)).otherwise(v)))
        return x
    t = len(template)
    pat = "," + ",".join(str(v) for v in template) + ","
    x = df.withColumn("_mj", F.concat(F.lit(","), F.array_join(ids_col, ","), F.lit(",")))
    x = x.withColumn("_mr", F.instr(F.reverse("_mj"), F.lit(pat[::-1]))) \
         .withColumn("_mn", F.size(ids_col))
    prefix_len = F.length("_mj") - F.col("_mr") - len(pat) + 1
    start = prefix_len - F.length(F.replace(F.substring("_mj", 1, prefix_len), F.lit(","), F.lit("")))
    x = x.withColumn("_mu", F.when((F.col("_mr") > 0) & (F.col("_mn") >= t), start + t).otherwise(F.col("_mn")))
    lab = F.when(F.col("_mu") >= F.col("_mn"), F.array_repeat(F.lit(IGNORE_INDEX), F.col("_mn"))).otherwise(
        F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.col("_mu")),
                 F.slice(ids_col, F.col("_mu") + 1, F.greatest(F.col("_mn") - F.col("_mu"), F.lit(1)))))
    x = x.withColumn(out, lab)
    if attention_col:
        x = x.withColumn(out, F.zip_with(out, attention_col,
                                         lambda v, m: F.when(m == 0, F.lit(IGNORE_INDEX)).otherwise(v)))
    return x.drop("_mj", "_mr", "_mn", "_mu")
