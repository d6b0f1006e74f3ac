"""Driver contract and plan checks."""
import __spark_entry__ as E
from vigil.plans import catalog
from vigil.plans.catalog import QUERIES
from vigil.session import staged

SMOKE = "/root/testdata/sf0.001"
NATIVE_ONLY = ["report_normalize", "causality_distribution", "code_exact", "label_expectedness",
               "json_depth_scan", "eval_rates", "split_exact"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["category", "n", "share"] and len(rows) >= 1
    assert abs(sum(r.share for r in rows) - 1.0) < 1e-9


def test_every_query_has_a_callable_and_most_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60 and len(o) >= 0.85 * len(q)


SHARED = ["clean_reports", "lookup_table", "label_cache", "labelled_reports", "assessed_cases", "generated_cases", "valid_cases", "scored"]


def test_no_cartesian_products(spark, monkeypatch):
    """What many queries begin with is built once; streams are left out, as their result is a table that they have written."""
    held = {}

    def once(name, fn):
        def run(spark, sf, *args):
            key = name, *(a for a in args if isinstance(a, str))
            if key not in held:
                held[key] = staged(fn(spark, sf, *args), name)
            return held[key]
        return run

    for name in SHARED:
        monkeypatch.setattr(catalog, name, once(name, getattr(catalog, name)))
    for name, fn in E.queries().items():
        if name not in QUERIES or name.startswith(("stream_", "source_page", "drift_", "signal_ebgm")):
            continue
        p = _plan(fn(spark, SMOKE))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_native_queries_have_no_python(spark):
    for name in NATIVE_ONLY:
        p = _plan(E.queries()[name](spark, SMOKE))
        assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p and "MapInPandas" not in p, name


def test_exact_coding_broadcasts_the_lookup(spark):
    assert "BroadcastHashJoin" in _plan(E.queries()["code_exact"](spark, SMOKE))
