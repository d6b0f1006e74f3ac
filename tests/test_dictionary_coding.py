"""Dictionary (F4) and term matching."""

from vigil.operators import coding as C
from vigil.operators import dictionary as D

NAMES = [(1, "Nausea", 1), (2, "Vomiting", 2), (3, "Gastrointestinal haemorrhage", 3), (4, "Headache", 4),
         (5, "nausea", 5), (6, "Rash", 6), (7, "  ", 7), (100, "GI disorders", 100), (101, "Skin disorders", 101),
         (102, "Nervous disorders", 102), (200, "Some HLT", 200), (4, "Headache", 40)]
LEVELS = [(1, "PT", 1), (2, "PT", 2), (3, "PT", 3), (4, "PT", 4), (5, "PT", 5), (6, "PT", 6), (7, "PT", 7),
          (100, "SOC", 100), (101, "SOC", 101), (102, "SOC", 102), (200, "HLT", 200)]
EDGES = [(1, 200, 1), (1, 100, 2), (1, 101, 3),      # HLT, SOC-A, SOC-B -> SOC-A
         (2, 101, 4), (2, 100, 5),                   # SOC-B listed first -> SOC-B
         (3, 100, 6), (4, 102, 7), (6, 101, 8)]      # 5 (lower-case nausea) has no SOC parent


def sheets(spark):
    n = spark.createDataFrame(NAMES, "term_id long, name string, pos long")
    lv = spark.createDataFrame(LEVELS, "term_id long, level string, pos long")
    e = spark.createDataFrame(EDGES, "child_id long, parent_id long, pos long")
    return n, lv, e


def test_first_soc_and_lookup(spark):
    n, lv, e = sheets(spark)
    soc = {r.child_id: r.soc_id for r in D.first_soc(e, lv, n).collect()}
    assert soc[1] == 100 and soc[2] == 101
    lk = {r.pt_key: r for r in D.build_lookup(n, lv, e).collect()}
    # 'nausea' appears twice (ids 1 and 5): later one (id 5) wins, without a SOC
    assert lk["nausea"].meddra_pt_code == 5 and lk["nausea"].meddra_soc == "" and lk["nausea"].meddra_soc_code is None
    assert lk["nausea"].key_pos == 1
    assert lk["vomiting"].meddra_llt == lk["vomiting"].meddra_pt and lk["vomiting"].meddra_llt_code == 2
    assert "" not in lk
    cov = D.coverage(n, lv, e).first()
    assert cov.n_pt == 7 and cov.n_skipped == 1 and cov.n_with_soc == 5


def test_exact_fuzzy_attach(spark):
    n, lv, e = sheets(spark)
    lk = D.build_lookup(n, lv, e)
    df = spark.createDataFrame([("a", "Nausea"), ("b", " NAUSEA "), ("c", "Gastrointestinal hemorrhage"),
                                ("d", "zzzz")], "id string, reaction_pt string")
    for scorer in ("levenshtein", "weighted"):
        got = {r.id: r for r in C.code_terms(df, lk, scorer=scorer).collect()}
        assert got["a"].match_type == "exact" and got["b"].match_type == "exact"
        assert got["c"].match_type == "fuzzy" and got["c"].meddra_pt == "Gastrointestinal haemorrhage"
        assert got["d"].match_type == "none"
    pred = spark.createDataFrame([(" NAUSEA ", "x"), ("Headache", "wrong soc"), ("unknown", "kept")],
                                 "meddra_pt string, meddra_soc string")
    out = {r.meddra_pt: r for r in C.attach_codes(pred, lk).collect()}
    assert out[" NAUSEA "].meddra_pt_code is None            # lower-cased, not trimmed
    assert out["Headache"].meddra_soc == "Nervous disorders" and out["Headache"].meddra_pt_code == 4
    assert out["unknown"].meddra_soc == "kept" and out["unknown"].meddra_soc_code is None


def test_fuzzy_ties_lowest_position(spark):
    keys = spark.createDataFrame([("abcx", 5), ("abcy", 2), ("abcz", 9)], "pt_key string, key_pos long")
    best = C.fuzzy_best(spark.createDataFrame([("abcd",)], "term string"), keys, "levenshtein", threshold=75).first()
    assert best.pt_key == "abcy" and best.score == 75.0


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_similar_keys_match_brute_force(spark):
    import random
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randint(0, 14)))
    keys = sorted({word() for _ in range(60)})
    near = [k[:i] + r.choice(["", "x", k[i:i + 1]]) + k[i + 1:] for k in keys for i in (r.randrange(len(k) + 1),)]
    terms = sorted({word() for _ in range(60)} | set(near))
    t = spark.createDataFrame([(x, x) for x in terms], "term string, t string")
    k = spark.createDataFrame([(x, i, x) for i, x in enumerate(keys)], "pt_key string, key_pos long, k string")
    for threshold in (60, 80):
        got = {(x.term, x.pt_key): x.score for x in C.similar_keys(t, k, threshold).collect()}
        want = {(a, b): 100 * (n - _lev(a, b)) / n for a in terms for b in keys
                if a and b and (n := max(len(a), len(b))) and 100 * (n - _lev(a, b)) >= threshold * n}
        assert got == want
