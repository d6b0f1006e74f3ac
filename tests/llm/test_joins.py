import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.llm import linededup, mixing, parity, rpforest, textvec

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_hashed_words_match_words():
    r = random.Random(2)
    texts = ["".join(r.choice("abAB \n\té") for _ in range(r.randint(0, 60))).encode() for _ in range(50)] + [b"x" * (textvec.SLICE + 10), b"ab " * textvec.SLICE]
    hashes, counts = textvec.hashed_words(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    by = {}
    for w, h in zip(words, hashes.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


# parity sketches

def shingles(t, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def slow_classes(rows, k, num, den):
    up = {i: i for i in range(len(rows))}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    sets = [shingles(t, k) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(keys) if keys else None))
    return sorted(out, key=str)


def family(prose, n, words, edits, seed):
    base, r, out = prose(words, seed).split(" "), random.Random(seed), []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"new{r.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_classes_as_by_brute_force(docs_of, prose, k, num):
    texts = [t for s, (n, w, e) in enumerate([(12, 60, 3), (10, 200, 12), (8, 25, 1), (6, 12, 1), (30, 90, 6)]) for t in family(prose, n, w, e, s)]
    texts += [None, "", " \n", "one", "one", "ONE", "One two", "one  two", "a b c", "a b c", *(prose(50, 70 + i) for i in range(20))]
    rows = [*enumerate(texts), (None, texts[0]), (None, "only null"), (5, texts[40])]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in parity.near_duplicates(docs_of(rows), k=k, num=num).collect()), key=str)
    assert got == slow_classes(rows, k, num, 100)


def test_keep_one(docs_of, prose):
    t = prose(60, 1)
    rows = [(3, t), (1, t), (1, t), (2, t + " more"), (None, t), (4, prose(60, 2)), (5, None), (6, ""), (None, "just null here now ok"), (None, "just null here now ok")]
    d = docs_of(rows)
    out = parity.keep_one(d)
    assert out.schema == d.schema
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 4, 5, 6, None]
    assert parity.keep_one(docs_of([])).count() == 0


def test_sketch_distance_bounds_difference(prose):
    join = parity.Join(3, 80, 100)
    a, b = join.shingle_sets([prose(100, 1), " ".join(prose(100, 1).split()[:90]) + " x y z"])
    import numpy as np
    for band in join.bands(len(a)):
        far = int(np.bitwise_count(join.sketch(a, band) ^ join.sketch(b, band)).sum())
        assert far <= len(np.setxor1d(a, b))
        assert (join.sketch_keys(a, band) == join.sketch_keys(b, band)).any()


def test_cross_pairs_in_blocks(llm, docs_of, prose, monkeypatch):
    monkeypatch.setattr(parity, "BLOCK", 4)
    rows = list(enumerate(family(prose, 30, 80, 8, 4)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in parity.near_duplicates(docs_of(rows)).collect())
    assert got == slow_classes(rows, 3, 90, 100) or sorted(got) == sorted(slow_classes(rows, 3, 90, 100))


# line dedup

def slow_removed(rows):
    lines = [(k, i, frozenset(WORD.findall(x))) for k, t in rows if k is not None and t is not None for i, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    return {(k, i) for k, i, w in lines if any((a, b) < (k, i) and 5 * len(w & v) >= 4 * len(w | v) for a, b, v in lines)}


def test_lines_as_by_brute_force(docs_of, prose):
    r = random.Random(5)
    pool = [t for s, (n, w, e) in enumerate([(15, 12, 2), (15, 40, 6), (10, 150, 20), (10, 6, 1)]) for t in family(prose, n, w, e, 20 + s)]
    pool += ["short", "a b c d", "a b c d e", "c b a", "b a", "short", "", "five words stand right here", "tab\tand  blanks stand\x0b here too"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 6)))) for i in range(40)] + [(90, None), (91, ""), (None, pool[0]), (3, pool[1]), (92, pool[1]), (92, pool[1])]
    got = {(x.k, x.l) for x in linededup.removed_lines(docs_of(rows)).collect()}
    assert got == slow_removed(rows)


def test_dedup_rows(docs_of, prose):
    a, b = prose(20, 1), prose(20, 2)
    d = docs_of([(1, f"{a}\n\nhi"), (2, a), (3, f"{b}\n{a}\nhi"), (4, None), (5, ""), (None, a), (6, "hi")])
    out = linededup.dedup(d)
    assert out.schema == d.schema
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: f"{a}\n\nhi", 3: b, 4: None, 5: "", None: a}
    kept = {r.doc_id: r.text for r in linededup.dedup(d, min_words=5).collect()}
    assert kept == {1: f"{a}\n\nhi", 3: f"{b}\nhi", 4: None, 5: "", None: a, 6: "hi"}
    assert linededup.dedup(docs_of([])).count() == 0


def test_short_lines_in_pipeline(llm, docs_of):
    import corpus_pipeline
    d = docs_of([(1, "Les.\nAll rights reserved\na b c d"), (2, "Les.\nLes.\nnew one"), (3, "reserved rights All\nb a\na b c"), (4, "a b c d e\n\nx"), (5, "Les."), (6, "a b\nc d e f g")])
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(llm, d, "").collect()}
    # four words in five reach 0.8, three in four don't
    assert got == {1: "Les.\nAll rights reserved\na b c d", 2: "new one", 3: "b a\na b c", 4: "\nx", 6: "c d e f g"}


def test_short_lines_as_by_brute_force(docs_of):
    r = random.Random(9)
    rows = [(i, "\n".join(" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 7))) for _ in range(4))) for i in range(50)]
    lines = [(k, i, frozenset(x.split())) for k, t in rows for i, x in enumerate(t.split("\n"))]
    want = {(k, i) for k, i, w in lines if w and any((a, b) < (k, i) and 5 * len(w & v) >= 4 * len(w | v) for a, b, v in lines)}
    assert {(x.k, x.l) for x in linededup.removed_lines(docs_of(rows), min_words=1).collect()} == want


def test_line_sets_run_on_plain_numbers(docs_of, prose):
    """Distinct and sort of nullable elements go through boxed values; a filter on the sets would make them twice."""
    d = docs_of([(1, prose(20, 1) + "\n\n  a b a"), (2, None)])
    sets = linededup.line_sets(d, "doc_id", "text", linededup.rarity(d, "text"), 1, 4, 5)
    assert not sets.schema["prefix"].dataType.containsNull
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(array_distinct(") == 1 and "Filter" not in plan.replace("Filter isnotnull(doc_id", "")
    assert sorted((r.k, r.l, r.n) for r in sets.collect()) == [(1, 0, len(set(prose(20, 1).split()))), (1, 1, 0), (1, 2, 2)]


@pytest.mark.parametrize("num,den", [(4, 5), (1, 2), (9, 10)])
def test_each_pair_of_lines_is_compared_once(docs_of, prose, num, den):
    """The shorter prefix of the smaller set finds every similar pair, whichever line is earlier."""
    base, r = prose(40, 3).split(), random.Random(8)
    rows = list(enumerate(" ".join(r.sample(base, r.randint(20, 40)) + [f"new{i}x{j}" for j in range(r.randint(0, 3))]) for i in range(60)))
    d = docs_of(rows)
    sets = linededup.line_sets(d, "doc_id", "text", linededup.rarity(d, "text"), 1, num, den).withColumn("open", F.lit(1))
    found = [(x.xk, x.yk) for i in range(linededup.SLICES) for x in linededup.prefix_pairs(sets, num, den, i).select("xk", "yk").collect()]
    assert all(x > y for x, y in found)
    words = [set(t.split()) for _, t in rows]
    assert {(x, y) for x in range(60) for y in range(x) if den * len(words[x] & words[y]) >= num * len(words[x] | words[y]) and words[x] != words[y]} <= set(found)


def test_crowds_of_near_copies(docs_of, prose):
    """Groups larger than ``CROWD`` are settled by single lines, and the rest by the prefix join, in both orders of size."""
    rows = [(i, t) for i, t in enumerate(family(prose, 80, 40, 3, 31) + family(prose, 40, 9, 1, 32))]
    random.Random(1).shuffle(rows)
    assert {(x.k, x.l) for x in linededup.removed_lines(docs_of(rows)).collect()} == slow_removed(rows)


def test_line_dedup_is_native(docs_of, prose):
    plan = linededup.dedup(docs_of([(1, prose(20, 1)), (2, prose(20, 1))]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


# mixing

def test_targets():
    assert mixing.targets({"a": 10, "b": 100, "c": 0}, {"a": 3, "b": 1, "c": 2}, 165) == {"a": 20.0, "b": 145.0, "c": 0.0}
    assert mixing.targets({}, {}, 0) == {}


def test_flow_is_cheapest():
    # every token once before any twice; the shared pattern serves whom the others can't
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 20})
    used = {p: sum(f.values()) for p, f in flow.items()}
    assert sum(used.values()) == 40 and all(10 <= v <= 20 for v in used.values())
    assert sum(f.get("a", 0) for f in flow.values()) == 20
    flow = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 10, "b": 10})
    assert flow[("a", "b")] == {"a": 0, "b": 10} or sum(flow[("a", "b")].values()) == 10


@pytest.mark.parametrize("seed", [1, 2])
def test_flow_against_all_choices(seed):
    r = random.Random(seed)
    size, quota = {("a",): r.randint(1, 4), ("a", "b"): r.randint(1, 4)}, {"a": r.randint(1, 5), "b": r.randint(1, 5)}
    cost = lambda n, s: max(0, n - s)
    best = max(((x + y + z, -cost(x, size[("a",)]) - cost(y + z, size[("a", "b")])) for x in range(2 * size[("a",)] + 1) for y in range(2 * size[("a", "b")] + 1)
                for z in range(2 * size[("a", "b")] + 1 - y) if x + y <= quota["a"] and z <= quota["b"]))
    flow = mixing.route(size, quota)
    used = {p: sum(f.values()) for p, f in flow.items()}
    assert (sum(used.values()), -sum(cost(used[p], size[p]) for p in size)) == best


def test_families_apart_as_all_together():
    r = random.Random(6)
    patterns = {("a",): 9, ("a", "b"): 5, ("b", "c"): 7, ("d",): 4, ("e",): 6, ("e", "f"): 3, ("f",): 0, (): 2}
    for _ in range(20):
        quotas = {s: r.randint(0, 20) for s in "abcdef"}
        whole = {p: sum(to.values()) for p, to in mixing.route(patterns, quotas).items()}
        apart = mixing.shares(patterns, quotas)
        cost = lambda x: sum(max(0, x[p] - n) for p, n in patterns.items())
        assert (sum(whole.values()), cost(whole)) == (sum(apart.values()), cost(apart))
    assert sorted(map(sorted, mixing.families(patterns))) == [[()], [("a",), ("a", "b"), ("b", "c")], [("d",)], [("e",), ("e", "f"), ("f",)]]


@pytest.mark.parametrize("few", [True, False])
def test_many_patterns(llm, monkeypatch, few):
    if not few:
        monkeypatch.setattr(mixing, "SENT", 10)
    n = 20_001 if few else 300
    d = llm.range(2 * n).selectExpr("id", "10 + id % 7 AS size", f"array(concat('s', id % {n})) AS of")
    out, goal, sizes = mixing.mix(d, "id", "size", "of")
    assert len(goal) == n and out.count() == 2 * n
    rows = out.groupBy(F.col("of")[0].alias("s")).agg(F.sum("taken").alias("t"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert len(rows) == n and all(abs(r.t - goal[r.s]) <= 10 and r.over <= 0 for r in rows)


def test_mix(llm, prose):
    r = random.Random(4)
    rows = [(i, r.randint(0, 50), [["x"], ["y"], ["~"], ["x", "y"]][i % 4]) for i in range(400)] + [(None, 5, ["x"]), (7, 3, ["y"]), (900, 4, []), (901, 4, None)]
    d = llm.createDataFrame(rows, "id long, size long, of array<string>")
    out, goal, sizes = mixing.mix(d, "id", "size", "of")
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= x.taken <= 2 * x["size"] for x in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d, "id", "size", "of")[0].collect()))
    assert sum(x.taken for x in got) == pytest.approx(sum(goal.values()), abs=60)
    assert sum(x.taken for x in got if x.of in (["~"],)) == pytest.approx(goal["~"], abs=20)
    assert mixing.mix(d.limit(0), "id", "size", "of")[0].count() == 0


def test_repeat_documents(docs_of, prose):
    d = docs_of([(i, prose(10 + i % 7, i), ["a", "b", None][i % 3]) for i in range(60)] + [(99, None, "a"), (98, "", None)])
    out = mixing.repeat_documents(d)
    assert out.schema == d.schema
    words = sum(len(WORD.findall(r.text or "")) for r in out.collect())
    assert words == pytest.approx(1.5 * sum(len(WORD.findall(r.text or "")) for r in d.collect()), rel=0.05)


# nearest neighbours

def test_search(llm):
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 12)) * rng.uniform(0.5, 2, (600, 1))
    x[50:250] = x[40]  # a third are copies
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 12), (1002, [1.0, None] + [0.0] * 10), (1003, [float("nan")] * 12), (1004, [float("inf")] * 12), (1005, [1.0]), (None, rows[0][1])]
    d = llm.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {}
    for r in rpforest.search(d.filter("vec_id % 20 = 0"), d, probes=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    v = np.array([r[1] for r in rows])
    hits = 0
    for q, found in got.items():
        found.sort()
        s = (v * v[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[2] for f in found] == pytest.approx([s[f[1]] for f in found], rel=1e-12)
        hits += len(set(want) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * 30
    few = {(r.query_id, r.vec_id) for r in rpforest.search(d.filter("vec_id = 0"), d.filter("vec_id < 3"), k=20).collect()}
    assert few == {(0, 1), (0, 2)}
    assert rpforest.search(d.limit(0), d.limit(0)).count() == 0


def test_recall_with_far_more_leaves_than_probes(llm):
    import numpy as np
    x = np.random.default_rng(3).normal(size=(4000, 16)).astype(np.float32).astype(float)
    d = llm.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = d.filter("vec_id % 40 = 0")
    got = {}
    for r in rpforest.search(q, d, k=10, trees=8, probes=16, leaf=8).collect():  # 4,096 leaves
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[i] & set([j for j in np.argsort(-(x @ x[i]), kind="stable").tolist() if j != i][:10])) for i in range(0, 4000, 40))
    assert hits >= 0.9 * 10 * 100


def test_visits_are_the_most_promising_leaves(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(7)
    forest = rpforest.Forest(rng.normal(size=(900, 9)).astype(np.float32), 6, 5, 1)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    margins = x @ forest.normal[:, :-1].T - forest.at
    for whole in (1 << 16, 0):
        monkeypatch.setattr(rpforest, "WHOLE", whole)
        for count in (1, 7, 100, forest.leaves, forest.leaves + 5):
            assert [sorted(f) for f in forest.visits(x, count).tolist()] == [sorted(forest.probes(m, count)) for m in margins]


@pytest.mark.parametrize("kind,size", [("<f4", 1.0), ("<f8", 1.0), ("<f8", 1e100), ("<f8", 1e-100), ("<f4", 1e-20)])
def test_block_scores_all_vectors_of_the_leaves(kind, size):
    import numpy as np
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(500, 6)) * size).astype(kind)
    x[100:140] = x[100] * (1 + 1e-7 * rng.normal(size=(40, 1)))  # near copies, whose order single precision can't tell
    leaves = np.stack([rng.integers(0, 9, 500), rng.integers(9, 20, 500)], 1).astype(np.int32)
    ids = rng.permutation(500)
    block = rpforest.Block(np.arange(500), ids, x, leaves)
    floor = np.full(30, -np.inf)
    r, c, s = rpforest.best_of(x[100:130].astype(float), x.astype(float), ids, 5, floor)
    for i in range(100, 130):
        q, asked = x[i].astype(float), np.array([leaves[i, 0], 12, 25], np.int32)
        score = (q * x).sum(1)
        inside = [j for j in np.lexsort((ids, -score)).tolist() if set(leaves[j].tolist()) & set(asked.tolist())]
        rows, found = block.best(q, asked, 5)
        assert block.vid[rows].tolist() == inside[:5] and found.tolist() == score[inside[:5]].tolist()
        assert c[r == i - 100].tolist() == np.lexsort((ids, -score))[:5].tolist() and floor[i - 100] == np.sort(score)[-5]


def test_vectors_move_once(llm):
    """Each vector stands in one block and each query once in each block, not once for every tree or leaf."""
    import numpy as np
    x = np.random.default_rng(9).normal(size=(1500, 8)).astype(np.float32)
    d = llm.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "vid long, id long, v array<float>")
    forest, most = rpforest.fit(d, 1500, 8, 16, 1000, 3)
    rows = rpforest.dealt(d, d.filter("id < 20"), forest, most, 40, 3).select("block", "side", "vid", "v", "leaves").collect()
    assert sorted(r.vid for r in rows if not r.side) == list(range(1500)) and {r.block for r in rows} == {0, 1, 2}
    assert sorted((r.block, r.vid) for r in rows if r.side) == [(b, i) for b in range(3) for i in range(20)]
    assert {(r.side, len(r.v), len(r.leaves)) for r in rows} == {(0, 32, 32), (1, 32, 160)}
    assert rpforest.blocks_for(1, 6) == 1 and rpforest.blocks_for(10 * rpforest.BLOCK, 6) == 12


# what the steps leave on disk, and what they move

def test_parity_words_meet_only_where_shingles_do(docs_of, prose):
    join = parity.Join(5, 80, 100)
    apart = docs_of([(i, prose(60 + i % 40, 300 + i)) for i in range(300)])
    assert parity.shared_words(parity.postings(apart, "text", join)).count() == 0


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (2, 85)])
def test_similar_sets_share_a_posted_key(k, num):
    import numpy as np
    join, r = parity.Join(k, num, 100), np.random.default_rng(k)
    for n in [*range(3, 40), 60, 99, 150, 400]:
        for _ in range(20):
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            b = a[:n - int(r.integers(0, n // 3 + 1))]
            b = np.unique(np.concatenate([b, r.integers(0, 1 << 63, int(r.integers(0, n // 3 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= num * (n + len(b) - both) and len(np.setxor1d(a, b)):
                bands = set(join.bands(n)) & set(join.bands(len(b)))
                assert any(set(join.posted_keys(a, x)) & set(join.posted_keys(b, x)) for x in bands)


def test_tables_are_dropped_after_use(llm, docs_of, prose, monkeypatch):
    import os
    made = []
    scratch = linededup.stored.__globals__["scratch"]
    monkeypatch.setitem(linededup.stored.__globals__, "scratch", lambda spark, name: made.append(scratch(spark, name)) or made[-1])
    d = docs_of(list(enumerate(family(prose, 20, 60, 6, 8))))
    lines, near = linededup.dedup(d), parity.near_duplicates(d)
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in made if os.path.exists(p.removeprefix("file:"))}
    assert left <= {"line-ids", "line-known", "parity-rows", "parity-classes", "parity-links"}
    assert lines.count() > 0 and near.count() == 20


def test_single_star_keys_meet_no_window_of_lines(docs_of, prose):
    sets = linededup.line_sets(docs_of([(i, prose(12, i)) for i in range(5)]), "doc_id", "text", linededup.rarity(docs_of([(1, "a")]), "text"), 1, 4, 5)
    plan = linededup.star_pairs(sets, 4, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter .*some#\d+L > 1", plan)


def test_rarity_is_one_row_and_small_numbers(docs_of, monkeypatch):
    from pyspark.sql import functions as F
    from pyspark.sql.classic.dataframe import DataFrame
    collect, most = DataFrame.collect, []
    monkeypatch.setattr(DataFrame, "collect", lambda self: most.append(collect(self)) or most[-1])
    d = docs_of([(1, "a b a\na c"), (2, None), (3, "a\tb a")])
    classes = linededup.rarity(d, "text")
    assert max(map(len, most)) == 1
    one = d.limit(1).select(classes.alias("every"), *(linededup.bucket(F.xxhash64(F.lit(w))).alias(w) for w in "abc"))
    assert len(one._jdf.queryExecution().optimizedPlan().toString()) < 400_000
    r = one.first()
    assert len(r.every) == 1 << linededup.RARITY_BITS
    assert [r.every[r[w]] for w in "abc"] == [8, 0, 0]


def test_places_of_a_map_are_joined_by_their_bits(docs_of, llm):
    ids = llm.createDataFrame([(i,) for i in (0, 5, 63, 64, 64, (1 << linededup.MAP_BITS) + 1, -1)], "id long")
    row = llm.range(1).select(linededup.bitmap(ids).alias("a")).first().a
    assert len(row) == 1 << (linededup.MAP_BITS - 6)
    assert (row[0], row[1], row[-1]) == ((1 | 2 | 1 << 5 | 1 << 63) - (1 << 64), 1, -(1 << 63)) and not any(row[2:-1])
