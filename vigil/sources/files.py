"""File sources (dictionary sheets, JSON maps, JSONL, text lines) and sinks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions.text import utrim
from ..schemas import CHAT_RECORD, FLAT_RECORD, TERM_EDGES, TERM_LEVELS, TERM_NAMES

SHEETS = {"names": TERM_NAMES, "levels": TERM_LEVELS, "edges": TERM_EDGES}


def read_sheet(spark: SparkSession, path: str, kind: str, fmt: str = "csv") -> DataFrame:
    """One exported dictionary sheet with its row position ``pos``.
    The export must carry ``pos`` (sheet order decides "first parent" and
    "last name wins"); parsing the workbook itself is out of scope."""
    schema = SHEETS[kind]
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return spark.read.schema(schema).parquet(path)


def read_json_map(spark: SparkSession, path: str, value_schema: StructType | str,
                  key_name: str = "key") -> DataFrame:
    """A JSON object keyed by name (``{"nausea": {...}, ...}``) -> rows.
    A JSON map is one document, so each file is read whole (``wholetext``);
    use it for bounded lookup files, then store them as a keyed table."""
    vs = value_schema if isinstance(value_schema, str) else value_schema.simpleString()
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", f"map<string,{vs}>")
    return raw.select(F.explode(m).alias(key_name, "v")).select(key_name, "v.*")


def read_chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited chat records (blank lines are skipped)."""
    return spark.read.schema(CHAT_RECORD).option("mode", "PERMISSIVE").json(path)


def read_flat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLAT_RECORD).json(path)


# Python's str.splitlines() also breaks on these characters.
_EXTRA_BREAKS = "[\\x{0B}\\x{0C}\\x{1C}\\x{1D}\\x{1E}\\x{85}\\x{2028}\\x{2029}]"


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One narrative per non-blank line, stripped (``splitlines`` parity)."""
    lines = spark.read.text(path)
    parts = lines.select(F.explode(F.split("value", _EXTRA_BREAKS)).alias("line"))
    return parts.select(utrim("line").alias("narrative")).where(F.col("narrative") != "")


# ----------------------------------------------------------------- sinks ----
def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a table (idempotent job commit; re-runs replace)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


@F.pandas_udf(StringType())
def python_json_line(s: pd.DataFrame) -> pd.Series:
    """``json.dumps(record)`` bytes (default separators, ASCII escapes)."""
    from ..functions.jsonx import _plain
    cols = list(s.columns)
    return pd.Series([json.dumps({k: _plain(v) for k, v in zip(cols, row)})
                      for row in s.itertuples(index=False, name=None)])


def write_jsonl(df: DataFrame, path: str, split_col: str | None = "split", exact_bytes: bool = False) -> None:
    """JSONL per split.  ``exact_bytes`` writes Python-identical lines
    through ``.text``; otherwise Spark's JSON writer (same values, compact)."""
    cols = [c for c in df.columns if c != split_col]
    if exact_bytes:
        out = df.select(*([split_col] if split_col else []),
                        python_json_line(F.struct(*cols)).alias("value"))
        w = out.write.mode("overwrite")
        if split_col:
            w = w.partitionBy(split_col)
        w.text(path)
    else:
        write_table(df, path, "json", [split_col] if split_col else None)


def summary_text(metrics: DataFrame, title: str) -> DataFrame:
    """One-row metrics -> the text report (one value per line)."""
    lines = [F.lit("=" * 60), F.lit(f"EVALUATION RESULTS — {title}"), F.lit("=" * 60)]
    for c in metrics.columns:
        lines.append(F.concat(F.lit(f"  {c:<20}: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))))
    lines.append(F.lit("=" * 60))
    return metrics.select(F.concat_ws("\n", *lines).alias("value"))


# ---- fixed values: the lines of the evaluation report (must equal the reference's) ----
REPORT_BAR = "=" * 60
REPORT_TITLE = "EVALUATION RESULTS — "
REPORT_RECORDS = "  Records evaluated  : "
REPORT_PARSED = "  JSON parse rate    : "
REPORT_FIELDS = ("  Field accuracy (on ", " parsed records):")
REPORT_RATES = (("    Seriousness       : ", "seriousness_acc"), ("    MedDRA PT         : ", "meddra_pt_acc"),
                ("    MedDRA SOC        : ", "meddra_soc_acc"), ("    Labelling status  : ", "labelling_acc"),
                ("    All fields correct: ", "all_fields_acc"))
# --------------------------------------------------------------------------------------


def evaluation_report(counters: DataFrame, title: str) -> DataFrame:
    """One row of counters -> the report as rows (pos, line), without the run's time.

    Rates have one decimal, half to even on the shortest decimal form of the number; without records one line says so."""
    from ..operators.evaluate import rates
    pct = lambda c: F.concat(F.format_string("%.1f", F.bround(c, 1)), F.lit("%"))
    text = lambda c: F.col(c).cast("string")
    lines = [F.lit(REPORT_BAR), F.lit(REPORT_TITLE + title), F.lit(REPORT_BAR), F.concat(F.lit(REPORT_RECORDS), text("total")),
             F.concat(F.lit(REPORT_PARSED), pct("parse_rate"), F.lit("  ("), text("json_parse_ok"), F.lit("/"), text("total"), F.lit(")")), F.lit(""),
             F.concat(F.lit(REPORT_FIELDS[0]), text("json_parse_ok"), F.lit(REPORT_FIELDS[1])),
             *(F.concat(F.lit(name), pct(c)) for name, c in REPORT_RATES), F.lit(REPORT_BAR)]
    none = F.array(F.lit("No records evaluated."))
    return rates(counters).select(F.posexplode(F.when(F.col("total") > 0, F.array(*lines)).otherwise(none)).alias("pos", "line"))


def comparison_report(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Both runs' metric rows in one table (A19 adds the deltas)."""
    return base.withColumn("mode", F.lit("base")).unionByName(tuned.withColumn("mode", F.lit("tuned")))
