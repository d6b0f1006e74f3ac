"""Term coding: reported reaction text -> dictionary entry.

J1 exact match on ``lower(trim(term))`` against the lookup (broadcast when
its measured size allows), J2 fuzzy match for the distinct exact misses
only, J3 drop of unmatched rows, J4 post-inference code attach.

Fuzzy matching compares only terms and keys that share a segment which a
similar pair must share (an equi-join), so no pair is lost and not all pairs
are made; edit distances are Spark's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utrim
from ..session import cut_lineage
from .joins import checked_broadcast

LOOKUP_COLS = ["meddra_pt", "meddra_pt_code", "meddra_llt", "meddra_llt_code",
               "meddra_soc", "meddra_soc_code"]
FUZZY_THRESHOLD = 80


def exact_key(col) -> "F.Column":
    return F.lower(utrim(F.col(col) if isinstance(col, str) else col))


def code_exact(df: DataFrame, lookup: DataFrame, term_col: str = "reaction_pt",
               broadcast_lookup: bool = True) -> DataFrame:
    """Left join on the trimmed, lower-cased term; misses keep nulls."""
    lk = lookup.select(F.col("pt_key").alias("_k"), *LOOKUP_COLS)
    if broadcast_lookup:
        lk = checked_broadcast(lk)
    return df.withColumn("_k", exact_key(term_col)).join(lk, "_k", "left").drop("_k")


# ---------------------------------------------------------------- fuzzy ----
def allowed_edits(length: Column, threshold: int) -> Column:
    """Most edits with which strings, the longer of ``length``, score ``threshold`` or more."""
    return F.floor(length * (100 - threshold) / 100).cast("int")


def _segments(n: Column, threshold: int) -> tuple[Column, Column, Column]:
    """For strings of length ``n``: edits allowed to any partner, length of the shorter segments, number of longer ones.

    The partner may be longer, up to ``n * 100 / threshold``."""
    edits = allowed_edits(F.floor(n * 100 / threshold), threshold)
    return edits, F.floor(n / (edits + 1)).cast("int"), (n % (edits + 1)).cast("int")


def _segment(n: Column, i: Column, threshold: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i``; the last ones are the longer."""
    edits, short, longer = _segments(n, threshold)
    before = F.greatest(i - (edits + 1 - longer), F.lit(0))
    return i * short + before, short + (i >= edits + 1 - longer).cast("int")


def similar_keys(terms: DataFrame, keys: DataFrame, threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """term, key, pt_key, key_pos and score of every pair that scores ``threshold`` or more.

    ``terms``: term, t (text compared); ``keys``: pt_key, key_pos, k (text
    compared).  Score = 100 * (longer length - edit distance) / longer length.
    A key is cut into one segment more than the edits it allows, so one segment
    stands unchanged in a similar term, moved by at most as many places: an
    equi-join on (key length, segment number, segment) finds every candidate,
    and the edit distance is taken for these only."""
    n = F.col("n")
    cut = keys.filter(F.length("k") > 0).withColumn("n", F.length("k"))
    cut = cut.withColumn("i", F.explode(F.sequence(F.lit(0), _segments(n, threshold)[0])))
    start, size = _segment(n, F.col("i"), threshold)
    cut = cut.select("pt_key", "key_pos", "k", "n", "i", F.substring("k", start + 1, size).alias("seg"))
    m = F.length("t")
    probe = terms.filter(m > 0).withColumn("n", F.explode(F.sequence(
        F.ceil(m * threshold / 100).cast("int"), F.floor(m * 100 / threshold).cast("int"))))
    edits = _segments(n, threshold)[0]
    probe = probe.withColumn("i", F.explode(F.sequence(F.lit(0), edits)))
    start, size = _segment(n, F.col("i"), threshold)
    probe = probe.withColumns({"at": F.explode(F.sequence(start - edits, start + edits)), "size": size})
    probe = probe.filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= m)) \
        .select("term", "t", "n", "i", F.substring("t", F.col("at") + 1, F.col("size")).alias("seg")).distinct()
    pairs = probe.join(cut, ["n", "i", "seg"]).select("term", "t", "pt_key", "key_pos", "k").distinct()
    longer = F.greatest(F.length("t"), F.length("k"))
    distance = F.levenshtein("t", "k")
    return pairs.withColumn("d", distance).filter(F.col("d") <= allowed_edits(longer, threshold)) \
        .select("term", "pt_key", "key_pos", ((100 * (longer - F.col("d"))).cast("double") / longer.cast("double")).alias("score"))


def token_sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def fuzzy_best(terms: DataFrame, lookup: DataFrame, scorer: str = "weighted", threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """term, pt_key, key_pos and score of the best dictionary key of each distinct
    ``term`` that has one of ``threshold`` or more (ties: lowest key position).

    ``levenshtein``: the edit-distance score.  ``weighted``: the larger of it and
    0.95 times that of the strings with their words sorted."""
    t = terms.select(F.col("term")).distinct()
    k = lookup.select("pt_key", "key_pos")
    found = similar_keys(t.withColumn("t", F.col("term")), k.withColumn("k", F.col("pt_key")), threshold)
    if scorer == "weighted":
        by_words = similar_keys(t.withColumn("t", token_sorted(F.col("term"))), k.withColumn("k", token_sorted(F.col("pt_key"))), threshold)
        found = found.unionByName(by_words.withColumn("score", F.col("score") * 0.95).filter(F.col("score") >= threshold))
    best = found.groupBy("term").agg(F.max_by(F.struct("pt_key", "key_pos", "score"),
                                              F.struct(F.col("score"), (-F.col("key_pos")).alias("neg_pos"))).alias("b"))
    return best.select("term", "b.pt_key", "b.key_pos", "b.score")


def code_terms(df: DataFrame, lookup: DataFrame, term_col: str = "reaction_pt",
               scorer: str = "weighted", threshold: int = FUZZY_THRESHOLD,
               fuzzy: bool = True) -> DataFrame:
    """J1 + J2: each distinct term is resolved once, exactly first, the rest by
    similarity; the rows are joined once.  Adds ``match_type`` in
    {exact, fuzzy, none} and ``match_score``."""
    keys = lookup.select("pt_key", "key_pos", *LOOKUP_COLS)
    terms = cut_lineage(df.select(exact_key(term_col).alias("term")).filter(F.col("term").isNotNull()).distinct()
                        .join(lookup.select(F.col("pt_key").alias("term"), F.lit(True).alias("exact")), "term", "left"))
    resolved = terms.filter("exact").select("term", F.col("term").alias("pt_key"), F.lit("exact").alias("match_type"),
                                            F.lit(100.0).alias("match_score"))
    if fuzzy:
        best = fuzzy_best(terms.filter("exact is null"), lookup, scorer, threshold)
        resolved = resolved.unionByName(best.select("term", "pt_key", F.lit("fuzzy").alias("match_type"), F.col("score").alias("match_score")))
    resolved = cut_lineage(resolved.join(keys, "pt_key").drop("pt_key", "key_pos").withColumnRenamed("term", "_term"))
    coded = df.withColumn("_term", exact_key(term_col)).join(checked_broadcast(resolved), "_term", "left").drop("_term")
    coded = coded.withColumn("match_type", F.coalesce("match_type", F.lit("none")))
    return coded if fuzzy else coded.withColumn("match_score", F.lit(None).cast("double"))


def drop_unmatched(coded: DataFrame) -> DataFrame:
    """Keep coded rows only (the reference drops the record)."""
    return coded.where(F.col("meddra_pt").isNotNull())


def attach_codes(pred: DataFrame, lookup: DataFrame, pt_col: str = "meddra_pt",
                 soc_col: str = "meddra_soc") -> DataFrame:
    """Post-inference attach.  Key = lower(pt) *without* trim; codes are
    null on a miss; the predicted SOC name is replaced only by a non-empty
    dictionary SOC name."""
    lk = checked_broadcast(lookup.select(F.col("pt_key").alias("_k"),
                                         F.col("meddra_pt_code").alias("_pt_code"),
                                         F.col("meddra_soc").alias("_soc"),
                                         F.col("meddra_soc_code").alias("_soc_code")))
    j = pred.withColumn("_k", F.lower(F.coalesce(F.col(pt_col), F.lit("")))).join(lk, "_k", "left")
    return (j.withColumn("meddra_pt_code", F.col("_pt_code"))
             .withColumn("meddra_soc_code", F.col("_soc_code"))
             .withColumn(soc_col, F.when(F.coalesce(F.col("_soc"), F.lit("")) != "", F.col("_soc"))
                         .otherwise(F.col(soc_col)))
             .drop("_k", "_pt_code", "_soc", "_soc_code"))


def coverage(terms: DataFrame, coded_terms: DataFrame) -> DataFrame:
    """A10: distinct terms, matched / unmatched counts and shares (one pass)."""
    return coded_terms.agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.count_if(F.col("meddra_pt").isNotNull()).alias("n_matched"),
        F.count_if(F.col("meddra_pt").isNull()).alias("n_unmatched"),
        (F.count_if(F.col("meddra_pt").isNotNull()).cast("double") / F.count(F.lit(1)).cast("double"))
        .alias("matched_share"))


def unmatched_sample(coded: DataFrame, term_col: str = "reaction_pt", n: int = 15) -> DataFrame:
    """A10: the first ``n`` distinct terms without a code, by name, and how many rows have each."""
    return coded.where(F.col("meddra_pt").isNull()).groupBy(F.col(term_col).alias("term")).agg(F.count(F.lit(1)).alias("n")).orderBy("term").limit(n)
