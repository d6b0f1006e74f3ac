"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a
document may be counted for).  Tokens of a pattern flow to the quotas of its
sources; each further repetition of a pattern is an arc of the pattern's size
that costs more than the one before, so the flow uses every token once before
it uses any twice.  The flow says how often each pattern is repeated and how
its tokens are shared out; whole documents are then taken in a seeded order.

Only sizes by source and by pattern reach the driver, in memory that grows with
their number alone.  Patterns that share no source, directly or through others,
don't meet in the flow: each such family is solved by itself, and a pattern
alone with its source has a closed form, so only what overlaps costs a search.

Defined results
    null or empty text   size 0: taken 0
    null source          a source of its own, last in order
    empty membership     the document can be counted for nothing: taken 0
    source of size 0     target 0
    ties                 sources in order of code points; documents in order of their seeded hash, then key
    repeated rows        rows of one key are documents of their own; they follow each other in the order
    empty table          no rows
    other columns        are not carried
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import cut_lineage

from .common import WORD, stored

# The weights of the sources, repeating, and the total as a share of all sizes.
WEIGHTS = (3, 1, 2)
TOTAL_PCT = 150
MAX_REPEAT = 2
SENT = 200_000
ORDER_BITS, DIGIT_BITS = 60, 12
FILLS = 2


def n_words(text: Column) -> Column:
    """Words of a whole text: blanks are squeezed, then counted."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, total: float, max_repeat: float = MAX_REPEAT) -> dict:
    """Shares of ``total`` by weight, none above ``max_repeat`` times its size;
    what exceeds is shared again by weight among the rest."""
    out, open_ = dict.fromkeys(sizes, 0.0), list(sizes)
    left = float(total)
    while open_:
        per = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if per * weights[s] > max_repeat * sizes[s]]
        if not full:
            return out | {s: per * weights[s] for s in open_}
        for s in full:
            out[s] = float(max_repeat * sizes[s])
            left -= out[s]
        gone = set(full)
        open_ = [s for s in open_ if s not in gone]
    return out


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of the cheapest maximal flow:
    shortest augmenting paths in the residual graph, queue-based."""
    to, cap, cost, at = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in arcs:
        at[u].append(len(to))
        to.append(v), cap.append(c), cost.append(w)
        at[v].append(len(to))
        to.append(u), cap.append(0), cost.append(-w)
    while True:
        far, via, queued = [math.inf] * n, [-1] * n, [False] * n
        far[source], queue = 0, deque([source])
        while queue:
            u = queue.popleft()
            queued[u] = False
            for e in at[u]:
                if cap[e] > 0 and far[u] + cost[e] < far[to[e]]:
                    far[to[e]], via[to[e]] = far[u] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if far[sink] == math.inf:
            return [cap[2 * k + 1] for k in range(len(arcs))]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def families(patterns: Iterable[tuple]) -> list[list[tuple]]:
    """Patterns parted so that no two parts share a source."""
    over: dict = {}

    def top(s):
        while over.setdefault(s, s) != s:
            over[s] = over[over[s]]
            s = over[s]
        return s

    for p in patterns:
        for s in p[1:]:
            over[top(s)] = top(p[0])
    out: dict = {}
    for p in patterns:
        out.setdefault(top(p[0]) if p else None, []).append(p)
    return list(out.values())


def shares(patterns: dict[tuple, int], quotas: dict, max_repeat: int = MAX_REPEAT) -> dict[tuple, int]:
    """Tokens that the cheapest flow takes from each pattern, family by family."""
    out = {}
    for family in families(patterns):
        if len(family) == 1 and len(family[0]) == 1:
            p = family[0]
            out[p] = min(round(quotas[p[0]]), max_repeat * patterns[p])
        else:
            names = {s: quotas[s] for s in sorted({s for p in family for s in p})}
            flow = route({p: patterns[p] for p in family}, names, max_repeat)
            out |= {p: sum(to.values()) for p, to in flow.items()}
    return out


def route(patterns: dict[tuple, int], quotas: dict, max_repeat: int = MAX_REPEAT) -> dict[tuple, dict]:
    """Tokens that flow from each pattern to each of its sources.

    Repetition k of a pattern costs k*k a token: the marginal cost rises, so
    repetitions are spread evenly over what can serve a quota."""
    names, groups = list(quotas), list(patterns)
    place = {s: 2 + len(groups) + i for i, s in enumerate(names)}
    arcs, pairs = [], []
    for i, p in enumerate(groups):
        arcs += [(0, 2 + i, patterns[p], k * k) for k in range(max_repeat)]
    for i, p in enumerate(groups):
        for s in p:
            pairs.append((len(arcs), p, s))
            arcs.append((2 + i, place[s], max_repeat * patterns[p], 0))
    arcs += [(place[s], 1, round(quotas[s]), 0) for s in names]
    flow = min_cost_flow(2 + len(groups) + len(names), arcs, 0, 1)
    out: dict[tuple, dict] = {p: {} for p in groups}
    for e, p, s in pairs:
        out[p][s] = flow[e]
    return out


def order_of(key: Column, seed: int) -> Column:
    """Seeded place of a document in its group: a hash of ``ORDER_BITS`` bits."""
    return F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(seed)), 64 - ORDER_BITS)


def digits(order: Column, level: int) -> Column:
    return F.shiftright(order, ORDER_BITS - level * DIGIT_BITS)


def narrowed(rows: DataFrame, cut: DataFrame, level: int, send: Callable) -> DataFrame:
    """One more digit of each group's cut: grp, gap, prefix, s and n (size and
    number of documents in the stretch that holds the cut)."""
    inside = rows.join(send(cut.select("grp", "prefix")), "grp").filter(digits(F.col("order"), level - 1) == F.col("prefix"))
    sums = inside.groupBy("grp", digits(F.col("order"), level).alias("next")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("grp").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)  # 2**DIGIT_BITS rows a group
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(w), F.lit(0)))
    hit = sums.join(send(cut.select("grp", "gap")), "grp").filter(F.col("before") <= F.col("gap")) \
        .groupBy("grp").agg(F.max_by(F.struct("next", "before", "s", "n"), "next").alias("hit"))
    return cut.select("grp", "gap").join(hit, "grp").select(
        "grp", (F.col("gap") - F.col("hit.before")).alias("gap"), F.col("hit.next").alias("prefix"), "hit.s", "hit.n")


def cuts(rows: DataFrame, want: DataFrame, send: Callable) -> DataFrame:
    """For each group of ``want`` (grp, gap) that has rows: ``below``, such that the
    documents with order < below fit the gap and the next one doesn't, and the gap left.

    The cut is narrowed down digit by digit of the order, with partial sums of
    the sizes by digit; no group is sorted or gathered.  Documents that share
    the whole order are taken or left together."""
    cut, level = want.select("grp", "gap", F.lit(0).cast("long").alias("prefix")), 0
    while True:
        level += 1
        cut = cut_lineage(narrowed(rows, cut, level, send))
        if level == ORDER_BITS // DIGIT_BITS or not cut.filter("n > 1").head(1):
            break
    whole = F.col("s") <= F.col("gap")
    return cut.select("grp", F.shiftleft(F.col("prefix") + whole.cast("long"), ORDER_BITS - level * DIGIT_BITS).alias("below"),
                      (F.col("gap") - F.when(whole, F.col("s")).otherwise(0)).alias("left"))


def extra_plan(rows: DataFrame, want: DataFrame, send: Callable) -> list[DataFrame]:
    """What decides which documents of ``rows`` (grp, order, size) get one copy
    more, so that the copies of a group come to about its ``gap``; a row a group.

    The seeded prefix is taken first; what is missing then is filled, ``FILLS``
    times, with the seeded prefix of the documents that are small enough; at last
    the smallest document left is taken if the copies then come nearer.
    ``send`` hints a broadcast where the groups are few."""
    steps: list[DataFrame] = []
    for k in range(1 + FILLS):
        open_ = with_extra(rows, steps).filter(~F.col("extra") & (F.col("size") > 0))
        if k:
            want = steps[-1].select("grp", F.col(f"left{k - 1}").alias("gap"))
            open_ = open_.join(send(want), "grp").filter(F.col("size") <= F.col("gap"))
        found = cuts(open_.select("grp", "order", "size"), want, send).join(want, "grp", "right")
        steps.append(send(cut_lineage(found.select("grp", F.coalesce("below", F.lit(0)).alias(f"below{k}"), F.coalesce("left", "gap").alias(f"left{k}")))))
    gap = steps[-1].select("grp", F.col(f"left{FILLS}").alias("gap"))
    small = with_extra(rows, steps).filter(~F.col("extra") & (F.col("size") > 0)).join(send(gap), "grp").filter(F.col("size") < 2 * F.col("gap"))
    last = small.groupBy("grp").agg(F.min(F.struct("size", "order")).alias("last"))
    return [*steps, send(cut_lineage(last))]


def with_extra(rows: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """``rows`` (grp, order, size, ...) with ``extra``, by the steps planned so far."""
    marked, taken = rows, F.lit(False)
    for k, step in enumerate(steps):
        marked = marked.join(step, "grp", "left")
        if k > FILLS:
            hit = F.col("last").eqNullSafe(F.struct("size", "order"))
        else:
            hit = F.col("order") < F.col(f"below{k}")
            if k:
                hit &= F.col("size") <= F.col(f"left{k - 1}")
        taken = taken | F.coalesce(hit, F.lit(False))
    return marked.withColumn("extra", taken & (F.col("size") > 0)).select(*rows.columns, "extra")


def mix(docs: DataFrame, key: str, size: str, membership: str, weights: tuple = WEIGHTS, total_pct: int = TOTAL_PCT,
        max_repeat: int = MAX_REPEAT, seed: int = 7) -> tuple[DataFrame, dict, dict]:
    """Mixes documents whose ``membership`` is an array of source names.

    Returns the documents (key, size, membership, ``taken`` words), the target
    of each source and its size.  Sources take ``weights`` in turn, in order of
    code points; they share ``total_pct`` per cent of all sizes."""
    rows = stored(placed(docs.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size"), F.col(membership).alias("membership")), seed), "mix-rows")
    plan, steps, goal, sizes = mix_plan(rows, weights, total_pct, max_repeat)
    out = copies(rows, plan, steps)
    return out.select(F.col("key").alias(key), F.col("size").alias(size), F.col("membership").alias(membership),
                      (F.col("size") * F.col("copies")).alias("taken")), goal, sizes


def placed(rows: DataFrame, seed: int = 7) -> DataFrame:
    """``rows`` (key, size, membership, ...) with group (membership pattern) and seeded order."""
    names = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col("membership"), F.array().cast("array<string>")))))
    return rows.withColumn("grp", F.to_json(names)).withColumn("order", order_of(F.col("key"), seed))


def mix_plan(rows: DataFrame, weights: tuple = WEIGHTS, total_pct: int = TOTAL_PCT,
             max_repeat: int = MAX_REPEAT) -> tuple[DataFrame, list[DataFrame], dict, dict]:
    """Flow and cuts for placed rows: copies of each group, steps for the extra copies, targets and sizes of the sources."""
    sums = rows.groupBy("grp").agg(F.sum("size").alias("size")).withColumn("names", F.from_json("grp", "array<string>"))
    patterns = {tuple(r.names): (r.grp, r["size"]) for r in sums.collect()}
    sizes: dict = {}
    for p, (_, n) in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    sizes = dict(sorted(sizes.items()))
    by = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    goal = targets(sizes, by, sum(n for _, n in patterns.values()) * total_pct / 100, max_repeat)
    flow = shares({p: n for p, (_, n) in patterns.items()}, goal, max_repeat)
    plan = [(grp, flow[p] // n if n else 0, flow[p] % n if n else 0) for p, (grp, n) in patterns.items()]
    send = F.broadcast if len(plan) <= SENT else (lambda df: df)
    plan = rows.sparkSession.createDataFrame(plan, "grp string, base long, gap long")
    return send(plan.select("grp", "base")), extra_plan(rows, plan.filter("gap > 0").select("grp", "gap"), send), goal, sizes


def copies(rows: DataFrame, plan: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Placed rows with ``copies``, the times that the mix takes each."""
    return with_extra(rows, steps).join(plan, "grp").withColumn("copies", F.col("base") + F.col("extra").cast("long")).drop("base", "extra")


def source_name(source: Column) -> Column:
    """A name for each source that isn't null; null, as a source of its own, comes last."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("~"))


def repeat_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: rows left out, once or as often as it repeats them.

    A row's copies follow from its own key, size and source, so texts aren't joined or moved."""
    rows = placed(docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), n_words(F.col(text).cast("string")).alias("size"),
                              F.array(source_name(F.col(source))).alias("membership")))
    plan, steps, _, _ = mix_plan(stored(rows.drop("row"), "mix-rows"))
    taken = copies(rows, plan, steps).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("row.*")
