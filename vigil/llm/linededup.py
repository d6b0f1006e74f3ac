"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line's set is its distinct words (runs other than \\x20 and \\x09-\\x0D).  A line
goes if an earlier line, by (key, line number), has a set of Jaccard similarity
``num / den`` or more; that line may itself be gone.  All lines with a word take
part; with a larger ``min_words`` those of fewer distinct words stay.  Sets too small to be similar to any
other (below four words at 0.8) are settled as equal sets and enter no join.

Sets are ordered by rarity: words fall into ``1 << RARITY_BITS`` hash buckets,
whose counts over the whole corpus give each word its class, so the order needs
no join; ties go by the word's hash.  Any one order is right, a good one is
fast.  Similar sets share a word among their rarest few (prefix filter), their
sizes differ little (length filter), and what stands behind the shared word
must suffice for the overlap (positional filter).  A 128-bit parity signature,
whose distance is at most the size of the symmetric difference, drops most
pairs that are left.  The rest are verified on their words.

Equal sets are one set, of which the first line stays.  Copies with small
changes never make all pairs: where more than ``CROWD`` lines share some rare
words, each is first compared with single ones of them, and what is found similar
to an earlier line is done.  Only lines still open are joined with all earlier ones.

Defined results
    null text            no lines; the text stays null
    empty lines          stay
    null key             the row takes no part: which is earlier can't be said
    repeated rows        rows of one key have the same place, so none removes the other
    ties                 a similarity that exactly reaches the threshold counts
    very long lines      all words count
    empty table          no rows
    documents left with no word, though they had some, go in ``dedup``
    other columns        ``dedup`` keeps them all; own names are chosen apart from theirs
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, fresh, stored

RARITY_BITS = 16
MAP_BITS = 22
LONG = 64
BLANKS = r"[\x20\x09-\x0D]+"
ODD_BLANKS = "\t\x0b\x0c\r"


def words_of(line: Column) -> Column:
    """Words, some of them empty; lines that have only blanks of the common kind are split without a pattern."""
    return F.when(reduce(Column.__or__, (line.contains(x) for x in ODD_BLANKS)), F.split(line, BLANKS)).otherwise(F.split(line, " "))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, l and text of every line of documents with a key."""
    return docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("l", "line"))


def fixed_array(df: DataFrame, size: int) -> Column:
    """The (at, value) rows of ``df``, those of one place joined by their bits, as an array of ``size`` numbers, 0 where there is none, fetched once when the query runs."""
    every = df.sparkSession.range(size).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("value"))
    full = df.select("at", "value").unionByName(every).groupBy("at").agg(F.bit_or("value").alias("value"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("a")).scalar()


def rarity(docs: DataFrame, text: str) -> Column:
    """Class (about 4 log2 of the count, 127 at most) of each hash bucket of words, over all texts: as many numbers whatever the input.

    They come to the driver as one row and stand in the plan as small numbers: rows and long numbers would take some hundred MB of its heap."""
    words = docs.select(F.explode(F.split(F.replace(F.col(text).cast("string"), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(bucket(F.xxhash64("w")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    out = [0] * (1 << RARITY_BITS)
    for x in counts.agg(F.collect_list(F.shiftleft("n", RARITY_BITS).bitwiseOR(F.col("b"))).alias("a")).first().a:
        out[x % len(out)] = min(127, int(4 * math.log2(x >> RARITY_BITS)))
    return F.split(F.lit(",".join(map(str, out))), ",").cast("array<bigint>")  # a constant when it runs


def bucket(h: Column) -> Column:
    return h.bitwiseAND((1 << RARITY_BITS) - 1).cast("int")


def line_sets(docs: DataFrame, key: str, text: str, classes: Column, min_words: int, num: int, den: int) -> DataFrame:
    """k, l, n (set size, 0 for lines that take no part), id (hash of the set), prefix (rarest
    words, as class and hash in one number), star keys and signature.

    The signature is the parity of the words by 64 bits of their hashes (s0), and
    for lines of over ``LONG`` words also that of the words with an odd hash (s1).
    Lambdas are run a word at a time on boxed values: only what needs the word itself stands in one; distinct and sort
    run on plain numbers, so no element may be nullable.  No row is filtered here, as a filter would make the sets twice."""
    rank = lambda h: F.call_function("shiftleft", F.coalesce(classes[bucket(h)], F.lit(0).cast("long")), F.lit(55)).bitwiseOR(F.shiftrightunsigned(h, 9))
    words = F.transform(F.transform(words_of(F.col("line")), lambda x: F.xxhash64(x)), rank)
    ranked = lines_of(docs, key, text).select("k", "l", F.sort_array(F.array_distinct(F.array_remove(words, rank(F.xxhash64(F.lit("")))))).alias("r"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    at = lambda x: x.bitwiseAND(63).cast("int")
    n = F.size("r")
    need = F.floor((num * n + (den - 1)) / den).cast("int")
    joins = den * n >= num * (n + 1)  # a set of n words is similar to another at all: at best to itself with one word more
    rare = F.slice("r", F.lit(1), F.greatest(F.floor(n / 2).cast("int"), F.lit(3)))
    # an order of the words that has nothing to do with their classes
    ordered = ranked.select("k", "l", "r", F.sort_array(F.transform(rare, lambda x: F.call_function("shiftleft", x, F.lit(9)))).alias("o"))
    return ordered.select("k", "l", F.when(n >= max(min_words, 1), n).otherwise(0).alias("n"), F.xxhash64("r").alias("id"), F.slice("r", F.lit(1), F.when(joins, n - need + 1).otherwise(0)).alias("prefix"),
                          F.when(joins, star_keys("o")).otherwise(F.array().cast("array<bigint>")).alias("star"),
                          F.aggregate("r", zero, lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one, at(x)))).alias("s0"),
                          F.when(n > LONG, F.aggregate("r", zero, lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.shiftright(x, 6).bitwiseAND(1), at(x))))).otherwise(zero).alias("s1"))


def star_keys(order: str) -> Column:
    """Hashes, each of two words next to each other among the smallest or the largest
    three of the rarer half, that changes elsewhere in the line leave alone."""
    return F.array_distinct(F.array(*(F.xxhash64(F.slice(order, i, 2)) for i in (1, 2, -2, -3))))


def first_lines(sets: DataFrame) -> DataFrame:
    """The earliest line of each set."""
    w = Window.partitionBy("id").orderBy("k", "l")
    return sets.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def may_be_similar(x: Column, y: Column, num: int, den: int) -> Column:
    """Length filter and signature distance of two lines (structs of ``SIDE``)."""
    every, odd = x["s0"].bitwiseXOR(y["s0"]), x["s1"].bitwiseXOR(y["s1"])
    distance = F.when((x["n"] > LONG) & (y["n"] > LONG), F.bit_count(odd) + F.bit_count(every.bitwiseXOR(odd))).otherwise(F.bit_count(every))
    return ((den * F.least(x["n"], y["n"]) >= num * F.greatest(x["n"], y["n"])) & ((den + num) * distance <= (den - num) * (x["n"] + y["n"])))


SIDE = ("k", "l", "n", "s0", "s1")
CENTERS = 4
CROWD = 4 * CENTERS  # lines that share a key with fewer others are few enough for the prefix join
SLICES = 3  # the prefix join goes through the words in as many parts, one after the other, so that its shuffle stands on disk a part at a time


def star_pairs(first: DataFrame, num: int, den: int) -> DataFrame:
    """Each line with the first few and the last few lines before it that share one of its star keys, where more than ``CROWD`` lines do."""
    w = Window.partitionBy("key").orderBy("k", "l")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct(*SIDE)
    rows = first.select(*SIDE, F.explode("star").alias("key")).withColumn("some", F.count(F.lit(1)).over(whole)).filter(F.col("some") > CROWD) \
        .select(me.alias("x"), *(F.nth_value(me, i).over(whole).alias(f"first{i}") for i in range(1, CENTERS + 1)),
                *(F.lag(me, i).over(w).alias(f"last{i}") for i in range(1, CENTERS + 1)))
    near = F.array(*(f"{a}{i}" for a in ("first", "last") for i in range(1, CENTERS + 1)))
    x = F.col("x")
    before = lambda y: (y["k"] < x["k"]) | ((y["k"] == x["k"]) & (y["l"] < x["l"]))
    rows = rows.select("x", F.explode(F.array_distinct(F.filter(near, lambda y: y.isNotNull() & before(y) & may_be_similar(x, y, num, den)))).alias("y"))
    return rows.select(*(F.col(f"{a}.{c}").alias(f"{a}{c}") for a in "xy" for c in SIDE)).distinct()


def prefix_pairs(first: DataFrame, num: int, den: int, part: int) -> DataFrame:
    """Open lines with the earlier lines that pass prefix, length and positional filter and signature, by the words of one of ``SLICES`` parts.

    Of two similar sets the smaller shares ``2 num / (num + den)`` of its words or more, not just ``num / den``:
    so its prefix is shorter (``small``), and the shorter prefixes meet the whole ones of sets at least as large, each pair once."""
    posts = first.select(*SIDE, "open", F.posexplode("prefix").alias("pos", "tok")).filter(F.pmod("tok", F.lit(SLICES)) == part)
    small = (num + den) * F.col("pos") <= (den - num) * F.col("n")
    a, b = (p.select(*(F.col(c).alias(n + c) for c in ("tok", *SIDE, "open", "pos"))) for n, p in (("a", posts), ("b", posts.filter(small))))
    x, y = ({c: F.col(n + c) for c in ("tok", *SIDE, "open", "pos")} for n in "ab")
    rest = 1 + F.least(x["n"] - x["pos"] - 1, y["n"] - y["pos"] - 1)
    enough = (num + den) * rest >= num * (x["n"] + y["n"])
    before = (y["k"] < x["k"]) | ((y["k"] == x["k"]) & (y["l"] < x["l"]))
    after = (x["k"] < y["k"]) | ((x["k"] == y["k"]) & (x["l"] < y["l"]))
    larger = (x["n"] > y["n"]) | ((x["n"] == y["n"]) & before)
    is_open = F.when(before, x["open"]).when(after, y["open"]) == 1
    both = a.join(b, (x["tok"] == y["tok"]) & larger & enough & may_be_similar(x, y, num, den) & is_open)
    return both.select(*(F.when(before, F.col(p + c)).otherwise(F.col(q + c)).alias(n + c) for n, p, q in (("x", "a", "b"), ("y", "b", "a")) for c in SIDE)).distinct()


def bitmap(ids: DataFrame) -> Column:
    """A bit for each id, in an array of fixed size."""
    at = F.pmod("id", F.lit(1 << MAP_BITS))
    rows = ids.select(at.alias("b")).select(F.shiftright("b", 6).cast("int").alias("at"),
                                            F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(63).cast("int")).alias("value"))
    return fixed_array(rows, 1 << (MAP_BITS - 6))


def in_bitmap(bits: Column, id: Column) -> Column:
    at = F.pmod(id, F.lit(1 << MAP_BITS))
    return F.call_function("shiftright", F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, num: int, den: int) -> DataFrame:
    """(k, l, s0, s1) of the lines ``x`` whose words are similar enough to those of their ``y``, as a stored table.

    Words come from the texts again; fixed-size maps of the documents and places wanted keep other texts from being split and other lines from being moved."""
    pairs = stored(pairs, "line-pairs")
    ids = pairs.select(F.explode(F.array(*(F.struct(F.col(f"{a}k").alias("k"), F.col(f"{a}l").alias("l")) for a in "xy"))).alias("at")).select("at.k", "at.l").distinct()
    place = F.xxhash64("k", "l")
    texts, places = bitmap(ids.select(F.xxhash64("k").alias("id"))), bitmap(ids.select(place.alias("id")))
    lines = lines_of(docs.filter(in_bitmap(texts, F.xxhash64(F.col(key)))), key, text).filter(in_bitmap(places, place))
    lines = stored(lines.join(ids, ["k", "l"], "left_semi").select("k", "l", F.array_distinct(F.array_remove(words_of(F.col("line")), "")).alias("w")), "line-words")
    a, b = (lines.select(*(F.col(c).alias(f"{n}{c}") for c in "klw")) for n in "xy")
    both = pairs.join(a, ["xk", "xl"]).join(b, ["yk", "yl"]).filter((F.size("xw") == F.col("xn")) & (F.size("yw") == F.col("yn")))
    common = F.size(F.array_intersect("xw", "yw"))
    hit = both.filter(den * common >= num * (F.col("xn") + F.col("yn") - common))
    out = stored(hit.select(*(F.col(f"x{c}").alias(c) for c in ("k", "l", "s0", "s1"))).distinct(), "line-done")
    dropped(pairs)
    dropped(lines)
    return out


def repeated_sets(docs: DataFrame, key: str, text: str, sets: DataFrame, num: int, den: int) -> DataFrame:
    """id, first place (fk, fl) and ``gone`` of each set: whether its first line is similar to an earlier one.  Uses up the table ``sets``."""
    first = stored(first_lines(sets), "line-first")
    dropped(sets)
    same = ["k", "l", "s0", "s1"]
    done = verified(star_pairs(first, num, den), docs, key, text, num, den)
    marked = stored(first.drop("star").join(done.withColumn("hit", F.lit(0)), same, "left").withColumn("open", F.coalesce("hit", F.lit(1))).drop("hit"), "line-open")
    dropped(first)
    dropped(done)
    near = [stored(prefix_pairs(marked, num, den, i), "line-near") for i in range(SLICES)]
    more = verified(reduce(DataFrame.unionByName, near).distinct(), docs, key, text, num, den)
    out = stored(marked.join(more.withColumn("hit", F.lit(True)), same, "left").select(
        "id", F.col("k").alias("fk"), F.col("l").alias("fl"), (F.coalesce("hit", F.lit(False)) | (F.col("open") == 0)).alias("gone")), "line-known")
    for table in (marked, more, *near):
        dropped(table)
    return out


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 1, num: int = 4, den: int = 5) -> DataFrame:
    """k (key) and l (line number from 0) of the lines that go; a row for each line of repeated rows."""
    table = stored(line_sets(docs, key, text, rarity(docs, text), min_words, num, den), "line-sets")
    sets = table.filter("n > 0")
    own = stored(sets.select("k", "l", "id"), "line-ids")
    known = repeated_sets(docs, key, text, sets, num, den)
    own = own.join(known, "id")
    return own.filter(F.col("gone") | (F.col("fk") < F.col("k")) | ((F.col("fk") == F.col("k")) & (F.col("fl") < F.col("l")))).select("k", "l", "id")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """``docs`` without the removed lines; documents that thereby lose their last word go."""
    gone, at, had = (fresh(docs, n) for n in ("gone", "at", "had"))
    lists = removed_lines(docs, key, text, **limits).select("k", "l").distinct().groupBy("k").agg(F.collect_set("l").alias(gone)).withColumnRenamed("k", at)
    joined = docs.join(lists, docs[key] == F.col(at), "left").drop(at)
    lines = F.split(F.col(text), "\n")
    left = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone), i)), "\n"))
    word = r"[^\x20\x09-\x0D]"
    return joined.withColumn(had, F.col(gone).isNotNull() & ~left.rlike(word)).withColumn(text, left).filter(~F.col(had)).select(*docs.columns)
