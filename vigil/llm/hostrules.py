"""Host-level quality rules.

Per-document counts feed a handful of rules; rule failures are aggregated by
host, each host's failure rate is shrunk with an empirical beta prior fitted
over all hosts, and the verdict of the host is joined back to its documents.

Defined results
    null or blank text   counts are 0, the document fails ``short``
    null host            no host evidence: only the document's own base rules count
    repeated rows        every row is counted and returned
    empty table          no rows
    other columns        are not carried; the result has the columns below only
    ties                 a host whose shrunk rate equals the limit passes
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import record_batch, stored

WINDOW = 8
RULES = ("short", "repetitive", "symbols", "word_length", "dup_lines")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list) -> int:
    """Words that lie in a ``WINDOW``-word window occurring twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return total


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes split on exactly \x20 and \x09-\x0D
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)


def document_counts(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One row per input row: key, host and the five counts."""
    src = docs.select(F.col(key).alias("key"), F.col(host).cast("string").alias("host"),
                      F.col(text).cast("string").alias("text"))
    key_type = src.schema["key"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols = list(zip(*map(text_counts, b.column("text").to_pylist()))) or [()] * len(COUNTS)
            schema = pa.schema([b.schema.field("key"), b.schema.field("host"), *((c, pa.int64()) for c in COUNTS)])
            yield record_batch(schema, [b.column("key"), b.column("host"), *cols])

    return src.mapInArrow(run, f"key {key_type}, host string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_failures(max_symbol_pct: int = 10, min_mean_chars: int = 2, max_mean_chars: int = 12,
                  max_dup_line_pct: int = 30) -> dict[str, Column]:
    """Each rule as a boolean column over the counts; integer arithmetic, so that ties are exact."""
    n = F.col("n_words")
    return {
        "short": n < 20,
        "repetitive": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 100 * F.col("n_symbols") > max_symbol_pct * n,
        "word_length": (F.col("word_chars") < min_mean_chars * n) | (F.col("word_chars") > max_mean_chars * n),
        "dup_lines": 100 * F.col("n_dup_lines") > max_dup_line_pct * n,
    }


def beta_prior(hosts: DataFrame, rule: str) -> list[Column]:
    """Aggregates from which the moments of the host rates are taken: totals,
    and the unweighted first two moments of the rates."""
    rate = F.col(f"f_{rule}") / F.col("n_docs")
    return [F.sum(f"f_{rule}").alias(f"f_{rule}"), F.avg(rate).alias(f"m_{rule}"),
            F.avg(rate * rate).alias(f"q_{rule}")]


def fit_prior(failures: int, docs: int, mean: float, square: float, inverse_n: float) -> tuple[float, float]:
    """Method of moments.  The spread between hosts is the observed variance
    of their rates less what binomial sampling alone gives; the strength of
    the prior is held between 1 and 1000 documents."""
    p = min(max(failures / docs, 1e-6), 1 - 1e-6)
    between = max(square - mean * mean - p * (1 - p) * inverse_n, 0.0)
    strength = p * (1 - p) / between - 1 if between > 0 else 1000.0
    strength = min(max(strength, 1.0), 1000.0)
    return p * strength, (1 - p) * strength


def host_verdicts(docs: DataFrame, max_rate: float = 0.5, **limits: int) -> DataFrame:
    """One row per host: number of documents, shrunk failure rate of each
    rule, and ``host_failed``.  ``docs`` has host and the counts."""
    flags = rule_failures(**limits)
    hosts = stored(docs.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *(F.count_if(c).alias(f"f_{r}") for r, c in flags.items())), "hosts")
    whole = hosts.agg(F.sum("n_docs").alias("n_docs"), F.avg(1 / F.col("n_docs")).alias("inverse_n"),
                      *(c for r in RULES for c in beta_prior(hosts, r))).first()
    out = hosts
    for r in RULES:
        a, b = fit_prior(whole[f"f_{r}"], whole["n_docs"], whole[f"m_{r}"], whole[f"q_{r}"], whole["inverse_n"]) \
            if whole["n_docs"] else (0.5, 0.5)
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + a) / (F.col("n_docs") + (a + b)))
    failed = F.lit(False)
    for r in RULES:
        failed = failed | (F.col(f"rate_{r}") > max_rate)
    return out.withColumn("host_failed", failed)


def host_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
               max_rate: float = 0.5, **limits: int) -> DataFrame:
    """Counts, base rules, host rates and verdict for each row of ``docs``.

    Returns key, host, the five counts, ``base_failed``, ``host_failed`` (null
    host: false) and ``kept``.  The documents are read once: their counts are
    a narrow stored table, which the aggregate and the join read.
    """
    counts = stored(document_counts(docs, key, text, host), "counts")
    verdicts = host_verdicts(counts, max_rate, **limits).select("host", "host_failed")
    return (counts.join(verdicts, "host", "left")
            .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
            .withColumnRenamed("key", key if key != "host" else "key"))
