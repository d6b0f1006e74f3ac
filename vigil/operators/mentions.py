"""Which terms do label texts mention: one pass over the labels instead of one pattern for each report.

A text becomes its words (lower case, split at anything but letters, marks, digits and ``_``); its
word n-grams, of the lengths that the wanted phrases have, are kept once each with the first place, and equi-joined with
the phrases' words.  What a phrase costs doesn't depend on the number of reports that name it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .labels import sentences

NOT_WORD = r"[^\p{L}\p{M}\p{N}_]+"


def words(c: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD), lambda w: w != "")


def phrase(c: Column) -> Column:
    """The words of a term joined by one blank: what is compared."""
    return F.array_join(words(c), " ")


def phrase_lengths(phrases: DataFrame) -> list[int]:
    """Different numbers of words that the phrases have (a few: the names in a dictionary are short)."""
    n = F.size(F.split("phrase", " "))
    return sorted(r.n for r in phrases.where(F.col("phrase") != "").select(n.alias("n")).distinct().collect())


def grams(labels: DataFrame, lengths: list[int], drug: str = "drug_name", text: str = "label_text") -> DataFrame:
    """(drug, phrase, sentence): each word n-gram of a drug's text once, with the number (from 0) of the sentence where it first begins."""
    sentence_words = F.transform(sentences(F.col(text)), lambda s, i: F.transform(words(s), lambda w: F.struct(i.alias("s"), w.alias("w"))))
    all_words = labels.select(drug, F.flatten(sentence_words).alias("ws"))
    sizes = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    n, i = F.col("n"), F.col("i")
    starts = all_words.select(drug, "ws", F.explode(sizes).alias("n")).where(F.size("ws") >= n) \
        .select(drug, "ws", "n", F.explode(F.sequence(F.lit(1), F.size("ws") - n + 1)).alias("i"))
    found = starts.select(drug, F.array_join(F.transform(F.slice("ws", i, n), lambda x: x["w"]), " ").alias("phrase"), F.get("ws", i - 1)["s"].alias("sentence"))
    return found.groupBy(drug, "phrase").agg(F.min("sentence").alias("sentence"))


def mention_table(labels: DataFrame, phrases: DataFrame, drug: str = "drug_name", text: str = "label_text") -> DataFrame:
    """``phrases`` (a column ``phrase`` and others) that each drug's text mentions: drug, ``sentence`` and the columns of ``phrases``."""
    wanted = phrases.where(F.col("phrase") != "")
    texts = labels.where(F.coalesce(F.col(text), F.lit("")) != "")
    return grams(texts, phrase_lengths(wanted), drug, text).join(wanted, "phrase")


def related_names(names: DataFrame, levels: DataFrame, edges: DataFrame) -> DataFrame:
    """(phrase, pt_code, kind) of every preferred term ('pt') and of the lower-level terms below it ('llt').

    ``names`` (term_id, name), ``levels`` (term_id, level): one row a term; ``edges`` (child_id, parent_id).
    Equal phrases of a term count once, its own name first."""
    named = names.join(levels, "term_id").select("term_id", "level", phrase(F.col("name")).alias("phrase"))
    own = named.where("level = 'PT'").select(F.col("term_id").alias("pt_code"), "phrase", F.lit("pt").alias("kind"))
    parents = own.select(F.col("pt_code").alias("parent_id"))
    below = (named.where("level = 'LLT'").join(edges.select(F.col("child_id").alias("term_id"), "parent_id"), "term_id")
             .join(parents, "parent_id").select(F.col("parent_id").alias("pt_code"), "phrase", F.lit("llt").alias("kind")))
    return own.unionByName(below).where(F.col("phrase") != "").groupBy("phrase", "pt_code").agg(F.max("kind").alias("kind"))


def related_findings(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(drug_name, pt_code, kind, phrase, evidence): how a drug's text mentions a preferred term, at best: by its own name, else by
    a lower-level term's; of these the one first in the text, ties by phrase."""
    table = mention_table(labels, names)
    first = F.struct((F.col("kind") != "pt").alias("lower"), "sentence", "phrase")
    best = staged(table.groupBy("drug_name", "pt_code").agg(F.min(first).alias("m")).select("drug_name", "pt_code", "m.*"), "related")
    split = labels.select("drug_name", sentences(F.col("label_text")).alias("parts"))
    return best.join(split, "drug_name").select("drug_name", "pt_code", F.when(F.col("lower"), "llt").otherwise("pt").alias("kind"), "phrase",
                                                F.get("parts", F.col("sentence")).alias("evidence"))
