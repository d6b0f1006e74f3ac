"""Dictionary versions, chains, components, drug names, exact quantiles, confidence routing, clocks and drift."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import audit as AU
from vigil.operators import drugnames as DN
from vigil.operators import evaluate as EV
from vigil.operators import graph as G
from vigil.operators import profile as P
from vigil.streaming import clocks as CK
from vigil.streaming import drift as DR


def test_followed(spark):
    steps = [(i, i + 1) for i in range(1, 12)] + [(20, 21), (21, 22), (22, 20), (30, 20), (40, 40), (50, 12), (60, 61), (None, 1), (70, None)]
    got = {r.code: (r.end, r.hops, r.cycle) for r in G.followed(spark.createDataFrame(steps, "code long, new_code long")).collect()}
    assert got == {**{i: (12, 12 - i, False) for i in range(1, 12)}, **{k: (None, None, True) for k in (20, 21, 22, 30, 40)}, 50: (12, 1, False), 60: (61, 1, False)}
    assert G.followed(spark.createDataFrame([], "code long, new_code long")).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("hub", f"x{i}") for i in range(60)] + [(f"r{r.randrange(60)}", f"r{r.randrange(60)}") for _ in range(30)]
    edges += [("z", "z"), (None, "q"), ("n3", "n3")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {x.node: x.component for x in G.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_audit(spark):
    v = "code long, name string, soc long"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", None), (4, "d", 2), (5, "e", 2), (6, "f", None), (None, "n", 1)], v)
    new = spark.createDataFrame([(1, "a", 1), (2, "bb", 1), (3, "c", 7), (4, "dd", 3), (6, "f", None), (9, "new", 1), (None, "n", 1)], v)
    replaced = spark.createDataFrame([(5, 8), (8, 9), (7, 7)], "code long, new_code long")
    records = spark.createDataFrame([("x", 5), ("y", 5), ("z", 2), ("w", None)], "id string, pt long")
    table = AU.audit(old, new, replaced, records, "pt")
    got = {r.code: r for r in table.collect()}
    assert {k: r.change for k, r in got.items()} == {1: "unchanged", 2: "renamed", 3: "moved", 4: "renamed+moved", 5: "removed", 6: "unchanged", 9: "added", None: "unchanged"}
    assert (got[5].final_code, got[5].hops, got[5].final_exists, got[5].n_records) == (9, 2, True, 2) and got[None].n_records == 1
    assert {r.id: r.new_code for r in AU.recode(records, "pt", table).collect()} == {"x": 9, "y": 9, "z": 2, "w": None}


def test_drug_names(spark):
    names = {"Aspirin 500 mg tablets": "aspirin", "ASPIRIN (coated)": "aspirin", "metformin hydrochloride 1,000 mg/5 ml": "metformin", "Sodium chloride 0.9 %": "sodium chloride",
             "codeine sodium phosphate oral solution": "codeine", "sodium": "sodium", "  x-12,  ER ": "x-12", "(500 mg)": "(500 mg)", "": "", "Gel": "gel", "amlodipine besylate": "amlodipine"}
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("acetylsalicylic acid",), ("ASA",)], "name string")
    syn = spark.createDataFrame([("ASA 100 mg", "Acetylsalicylic acid"), ("acetylsalicylic acid", "aspirin"), (None, "y"), ("", "x-12")], "a string, b string")
    got = {r.name: (r.base, r.canonical) for r in DN.canonical_names(df, syn).collect()}
    assert {k: got[k][0] for k in names} == names and None not in got
    assert {k for k, v in got.items() if v[1] == "acetylsalicylic acid"} == {"Aspirin 500 mg tablets", "ASPIRIN (coated)", "acetylsalicylic acid", "ASA"}
    assert got["sodium"][1] == "sodium" and got["  x-12,  ER "][1] == "x-12"


@pytest.mark.parametrize("values", [[5.0], [1, 2], [3.0] * 50 + [1e-9, 1e9], list(range(1000)), "normal", [-1.5, -1.5, 0.0, 1e300, -1e300]])
def test_exact_quantiles(spark, values):
    if values == "normal":
        values = np.random.default_rng(1).normal(size=4000).tolist()
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    assert P.quantiles(df, "x", shares) == pytest.approx(np.quantile(np.array(values, float), shares).tolist(), rel=1e-12)
    d = P.describe_exact(df, "x", 3).first()
    assert d["count"] == len(values) and d.q50 == pytest.approx(round(float(np.quantile(values, 0.5)), 3), rel=1e-9)
    assert P.quantiles(df.limit(0), "x", [0.5]) == [None] and P.describe_exact(df.limit(0), "x").first().q25 is None


def test_risk_coverage(spark):
    r = random.Random(4)
    rows = [(i, s, r.random() < s) for i, s in enumerate([r.random() for _ in range(400)])] + [(900, None, True), (901, 1.0, None), (902, 0.0, True)]
    df = spark.createDataFrame(rows, "i long, s double, ok boolean")
    curve = {x.bucket: (x.covered, x.wrong) for x in EV.risk_coverage(df, "s", "ok", 20).collect()}
    for b, (covered, wrong) in curve.items():
        above = [x for x in rows if x[1] is not None and min(int(x[1] * 20), 19) >= b]
        assert covered == len(above) and wrong == sum(not x[2] for x in above)
    routed = {x.i: x.route for x in EV.route(df, "s", "ok", 25, 20).collect()}
    cuts = [b for b, (c, w) in curve.items() if w * 100 <= c * 25]
    assert {i for i, x in routed.items() if x == "auto"} == {i for i, s, _ in rows if s is not None and min(int(s * 20), 19) >= min(cuts)}
    assert set(x.route for x in EV.route(df.withColumn("ok", F.lit(False)), "s", "ok", 1, 20).collect()) == {"review"}


def test_clock_walk():
    day = CK.DAY_MS
    walk = lambda rows, clock=None: CK.walk(clock, [(int(t * day), i, o) for t, i, o in rows])
    assert walk([(0, 1, False)]) == (None, [])
    assert walk([(0, 1, True), (15, 2, True), (16, 3, True)]) == ((3, 16 * day), [(1, 0, 2, 15 * day, "met")])
    assert walk([(0, 1, True), (15.5, 2, True)]) == ((2, int(15.5 * day)), [(1, 0, None, None, "overdue")])
    assert walk([(2, 5, False), (4, 6, True)], (1, 3 * day)) == (None, [(1, 3 * day, 6, 4 * day, "met")])  # received before the clock was opened
    assert walk([(0, 1, True), (0, 2, True)]) == (None, [(1, 0, 2, 0, "met")])


def test_expedited_stream(spark, tmp_path):
    schema = "case_id long, report_id long, received timestamp, opens boolean"
    at = "2024-01-{:02d} 00:00:00".format
    slices = [[(1, 1, at(1), True), (2, 2, at(1), True), (3, 3, at(2), False), (None, 9, at(2), True)],
              [(1, 4, at(10), False), (3, 5, at(12), True), (4, 6, None, True), (5, 11, at(14), None)],
              [(2, 7, at(20), True), (3, 8, at(27), True), (6, 10, at(31), True)]]
    for k, rows in enumerate(slices):
        df = spark.createDataFrame(rows, "case_id long, report_id long, received string, opens boolean").withColumn("received", F.col("received").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/slice={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    (CK.expedited(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
     .trigger(availableNow=True).start().awaitTermination())
    got = sorted((r.case_id, r.opened_by, r.closed_by, r.status) for r in spark.read.schema(CK.OUT).parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 1, 4, "met"), (2, 2, None, "overdue"), (3, 5, 8, "met")]  # 7 and 10 still run


def test_divergence(spark):
    rows = [(0, "a", 6), (0, "b", 4), (1, "a", 6), (1, "b", 4), (2, "c", 5), (4, "a", 1)]
    counts = spark.createDataFrame(rows, "d int, value string, n long").select(
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, d)").alias("window_start"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, d + 1)").alias("window_end"), "value", "n")
    got = [(r.n, r.n_before, r.js, r.variation, r.drifted) for r in DR.divergence(counts).orderBy("window_start").collect()]
    assert got[0] == (10, None, None, None, False) and got[3] == (1, None, None, None, False)
    assert got[1] == (10, 10, 0.0, 0.0, False)
    assert got[2][:2] == (5, 10) and got[2][2] == pytest.approx(math.log(2)) and got[2][3] == pytest.approx(1) and got[2][4]
