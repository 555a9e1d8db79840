"""PromQL on a small table, with values worked out by hand."""

import math
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from larkspur.plans import promql as P


@pytest.fixture(scope="module")
def data(spark):
    rows = [(h, c, i * 15000, 15.0 * i + (5 if c == "1" else 0), float(i) if h == "a" else None) for i in range(8) for h in "ab" for c in "01"]
    df = spark.createDataFrame(rows, "host string, core string, ts long, usage double, temp double")
    hist = spark.createDataFrame([("0.1", 0, 2.0), ("0.5", 0, 5.0), ("1", 0, 8.0), ("+Inf", 0, 10.0)], "le string, ts long, req double")
    return P.samples(df, ["host", "core"], ["usage", "temp"]).unionAll(P.samples(hist, ["le"], ["req"])).cache()


def at(data, q, t=105000):
    return {tuple(sorted(r.labels.items())): r.value for r in P.query(data, q, t).collect()}


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("sum by (host) (rate(usage[1m]))", {(("host", "a"),): 2.0, (("host", "b"),): 2.0}),
        ("sum(usage) / count(usage)", {(): 107.5}),
        ("quantile(0.5, usage)", {(): 107.5}),
        ("histogram_quantile(0.5, req)", {(): 0.5}),
        ("histogram_quantile(0.65, req)", {(): 0.75}),
        ("histogram_quantile(0.99, req)", {(): 1.0}),
        ('absent(nope{x="y"})', {(("x", "y"),): 1.0}),
        ('absent(usage{host="a"})', {}),
        ("scalar(sum(temp)) + 1", {(): 15.0}),
        ("1 + 2 * 3 ^ 2 ^ 0", {(): 7.0}),
        ("-2 ^ 2", {(): -4.0}),
        ("time()", {(): 105.0}),
        ('usage{host="a",core="0"} > bool 100', {(("core", "0"), ("host", "a")): 1.0}),
        ('usage{host="a",core="0"} > 105', {}),
        ('sum(usage{host=~"a|b",core!~"[1-9]"})', {(): 210.0}),
        ('usage{host="a",core="0"} offset 30s', {(("__name__", "usage"), ("core", "0"), ("host", "a")): 75.0}),
        ('usage{host="a",core="0"} @ 30', {(("__name__", "usage"), ("core", "0"), ("host", "a")): 30.0}),
        ('max_over_time(rate(usage{host="a",core="0"}[30s])[1m:15s])', {(("core", "0"), ("host", "a")): 1.0}),
        ('changes(usage{host="a",core="0"}[1m]) + resets(usage{host="a",core="0"}[1m])', {(("core", "0"), ("host", "a")): 4.0}),
        ('predict_linear(usage{host="a",core="0"}[1m], 10)', {(("core", "0"), ("host", "a")): 115.0}),
        ('mad_over_time(usage{host="a",core="0"}[1m])', {(("core", "0"), ("host", "a")): 15.0}),
        ('irate(usage{host="a",core="0"}[1m])', {(("core", "0"), ("host", "a")): 1.0}),
        ('sum without (core) (temp)', {(("host", "a"),): 14.0}),
        ('count_values("v", temp)', {(("v", "7"),): 2.0}),
        ('topk(1, usage{host="a"})', {(("__name__", "usage"), ("core", "1"), ("host", "a")): 110.0}),
        ('temp / on(host, core) usage{core="0"}', {(("core", "0"), ("host", "a")): 7 / 105}),
        ('temp * on(host) group_left sum by (host) (usage{host="a"})', {(("core", c), ("host", "a")): 7 * 215.0 for c in "01"}),
        ('label_join(temp{core="0"}, "x", "-", "host", "core")', {(("__name__", "temp"), ("core", "0"), ("host", "a"), ("x", "a-0")): 7.0}),
        ('temp{core="0"} unless usage{host="b"}', {(("__name__", "temp"), ("core", "0"), ("host", "a")): 7.0}),
        ('clamp(usage{host="a",core="0"}, 1, 50)', {(("core", "0"), ("host", "a")): 50.0}),
        ("minute() + hour()", {(): 1.0}),
    ],
)
def test_values(data, query, want):
    got = at(data, query)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_infinities(data):
    got = at(data, 'usage{host="a",core="0"} / 0')
    assert list(got.values()) == [math.inf]
    assert math.isnan(next(iter(at(data, '(usage{host="a",core="0"} - usage{host="a",core="0"}) / 0').values())))
    assert math.isnan(next(iter(at(data, "scalar(usage)").values())))
    assert at(data, "quantile(2, usage)") == {(): math.inf}


def test_range_and_lookback(data):
    got = P.query_range(data, 'usage{host="a",core="0"}', 0, 500000, 100000).collect()
    assert sorted((r.step_ms, r.value) for r in got) == [(0, 0.0), (100000, 90.0), (200000, 105.0), (300000, 105.0), (400000, 105.0)]


def test_metadata(data):
    assert {r.label for r in P.label_names(data).collect()} == {"__name__", "host", "core", "le"}
    assert {r.value for r in P.label_values(data, "host").collect()} == {"a", "b"}
    assert P.series(data, 'usage{host="a"}').count() == 2


def test_errors(data):
    for bad in ("usage[1m]", "nosuch(usage)", "usage{", "1 == 2", "rate(usage)"):
        with pytest.raises((ValueError, TypeError, AttributeError)):
            P.query(data, bad, 0).collect()
    with pytest.raises(ValueError):
        P.query_range(data, "usage", 0, 10**9, 1)
    with pytest.raises(Exception, match="many-to-many"):
        P.query(data, "usage + on(host) temp", 105000).collect()


@pytest.mark.parametrize("step,window,offset", [(7, 30, 0), (40, 25, 11), (1, 1, 0), (13, 300, -20)])
def test_running_functions_equal_gathered_windows(spark, step, window, offset):
    r = random.Random(step)
    odd = [float("nan"), float("inf"), float("-inf")]
    rows = []
    for name, n in (("plain", 60), ("odd", 60), ("twice", 20), ("one", 1)):
        for k in range(n):
            ts = r.randrange(400) if name != "twice" else k // 2 * 9
            rows.append(([("__name__", "m"), ("s", name)], ts, r.choice(odd) if name == "odd" and r.random() < 0.1 else float(r.randrange(12))))
    data = spark.createDataFrame([([{"k": k, "v": v} for k, v in labels], ts, v) for labels, ts, v in rows], "labels array<struct<k:string,v:string>>, ts long, value double")
    ev = P.Evaluator(data, P.Grid(-50, 460, step))
    node = P.Selector([("__name__", "=", "m")], window=window, offset=offset)
    same = lambda a, b: a == b or a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    gathered, ends = ev.windows(node).persist(), ev.ends(node).persist()
    for name in P.RUNNING:
        want = {(x.step, str(x.labels)): x.v for x in gathered.select("step", "labels", P.window_function(name, F.col("w"), F.col("eval"), window, None).alias("v")).collect() if x.v is not None}
        got = {(x.step, str(x.labels)): x.v for x in ends.select("step", "labels", P.running_function(name, F.col("first"), F.col("last"), F.col("step"), window).alias("v")).collect() if x.v is not None}
        assert want.keys() == got.keys(), name
        assert all(same(want[k], got[k]) for k in want), (name, [(k, want[k], got[k]) for k in want if not same(want[k], got[k])][:3])


def test_running_functions_copy_no_samples(spark):
    data = spark.createDataFrame([([{"k": "__name__", "v": "m"}], 5, 1.0)], "labels array<struct<k:string,v:string>>, ts long, value double")
    plan = P.query_range(data, "rate(m[1d])", 0, 86400000, 15000)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("Generate explode") == 2  # steps of a series, and two marks for each


def test_long_windows_take_linear_time(spark):
    """A window's mean, median and moments are worked out once, not for each of its samples."""
    n = 20_000
    data = spark.range(n).select(F.expr("array(named_struct('k', '__name__', 'v', 'm'))").alias("labels"), F.col("id").alias("ts"), (F.col("id") % 1000).cast("double").alias("value")).coalesce(1)
    began, v = time.monotonic(), [float(k % 1000) for k in range(n)]
    x = [(k - n) / 1000 for k in range(n)]
    mx, my = statistics.fmean(x), statistics.fmean(v)
    slope = sum((a - mx) * (b - my) for a, b in zip(x, v, strict=True)) / sum((a - mx) ** 2 for a in x)
    middle = statistics.median(v)
    want = {
        "mad_over_time(m[1h])": statistics.median(abs(a - middle) for a in v), "deriv(m[1h])": slope, "predict_linear(m[1h], 9)": my - slope * mx + slope * 9,
        "stddev_over_time(m[1h])": statistics.pstdev(v), "quantile_over_time(0.5, m[1h])": middle,
    }
    for q, value in want.items():
        assert math.isclose(next(iter(at(data, q, n).values())), value, rel_tol=1e-9), q
    assert time.monotonic() - began < 30
