import numpy as np
import pandas as pd
import pytest

from panelyard.functions import ranks
from panelyard.operators.features import full_mad_winsor

PIECES = [None, 1, 40]


@pytest.fixture(params=PIECES)
def piece(request, monkeypatch):
    """As the session cuts, in one piece and in many: the results must not differ."""
    f = ranks.running_weight
    monkeypatch.setattr(ranks, "running_weight", lambda *a, **k: f(*a, **{"pieces": request.param} | k))
    return request.param


def frame(seed=1, n=400):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.25, 0.05]), "k": [f"k{i:04d}" for i in range(n)], "v": np.round(rng.normal(0, 2, n), 1)})
    pdf.loc[pdf.index % 3 == 0, "v"] = 0.5  # one value holds a third of all rows
    return pdf


def null_rows(spark):
    """A NULL group, a group of NULL values only, a NaN and ties."""
    rows = [(None, "a", 1.0), (None, "b", 3.0), (None, "c", None), ("n", "d", None), ("n", "e", None), ("t", "f", 2.0), ("t", "g", 2.0), ("t", "h", float("nan")), ("t", "i", -1.0)]
    return spark.createDataFrame(rows, "g string, k string, v double")


def test_positions_are_exact(spark, piece):
    pdf = frame()
    d = ranks.positions(spark.createDataFrame(pdf), ["g"], "v", ["k"]).toPandas()
    want = pdf.sort_values(["g", "v", "k"])
    want["pos"] = want.groupby("g").cumcount() + 1
    m = d.merge(want[["k", "pos"]], on="k")
    assert (m["position"] == m["pos"]).all() and len(m) == len(pdf)


def test_average_ranks_match_pandas(spark, piece):
    pdf = frame(2)
    d = ranks.average_ranks(spark.createDataFrame(pdf), ["g"], "v", distinct="nd").toPandas().set_index("k")
    want = pdf.assign(r=pdf.groupby("g")["v"].rank(method="average")).set_index("k")
    assert np.allclose(d.loc[want.index, "rank"], want["r"])
    assert d.groupby("g")["nd"].first().to_dict() == pdf.groupby("g")["v"].nunique().to_dict()


def test_quantiles_match_pandas(spark, piece):
    pdf = frame(3)
    probs = {"q1": 0.1, "q5": 0.5, "q9": 0.93}
    got = ranks.group_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs).toPandas().set_index("g").sort_index()
    for n, p in probs.items():
        assert np.allclose(got[n], pdf.groupby("g")["v"].quantile(p).sort_index())


@pytest.mark.parametrize("rows", [1, 30])
def test_null_groups_and_values_stay(spark, monkeypatch, rows):
    f = ranks.running_weight
    monkeypatch.setattr(ranks, "running_weight", lambda *a, **k: f(*a, **{"pieces": rows} | k))
    d = null_rows(spark)
    r = {x.k: (x["rank"], x.group_n) for x in ranks.average_ranks(d, ["g"], "v").collect()}
    assert r == {"a": (1.0, 2), "b": (2.0, 2), "c": (None, None), "d": (None, None), "e": (None, None), "f": (2.5, 4), "g": (2.5, 4), "h": (4.0, 4), "i": (1.0, 4)}
    p = {x.k: (x.position, x.group_n) for x in ranks.positions(d, ["g"], "v", ["k"]).collect()}
    assert p == {"a": (1, 2), "b": (2, 2), "i": (1, 4), "f": (2, 4), "g": (3, 4), "h": (4, 4)}
    q = {x.g: x.m for x in ranks.group_quantiles(d, ["g"], "v", {"m": 0.5}).collect()}
    assert q == {None: 2.0, "n": None, "t": 2.0}


def test_winsor_keeps_every_row(spark):
    assert full_mad_winsor(null_rows(spark), by=["g"], value="v", out="v").count() == 9


def test_plan_does_not_grow_with_nested_calls(spark):
    d, sizes = null_rows(spark), []
    for i in range(3):
        d = ranks.average_ranks(d, ["g"], "v", out=f"r{i}", total=f"n{i}")
        sizes.append(len(d._jdf.queryExecution().toString()))
    # A call adds its joins, no copy of the plan before it.
    assert sizes[2] - sizes[1] < 1.6 * (sizes[1] - sizes[0]) and sizes[2] < 60_000
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()
    assert {r.k: r.r2 for r in d.collect()}["f"] == 2.5


@pytest.mark.parametrize("pieces", [1, 7, 60])
def test_least_from_here_by_definition(spark, pieces):
    pdf = frame(5, 120)
    d = ranks.least_from_here(spark.createDataFrame(pdf), ["g"], ["v", "k"], lambda r, n: ranks.F.col("v") * n / r, "low", pieces=pieces).toPandas()
    assert list(d.columns) == ["g", "k", "v", "low"] and len(d) == len(pdf)
    want = pdf.sort_values(["g", "v", "k"])
    pos, n = want.groupby("g").cumcount() + 1, want.groupby("g")["v"].transform("size")
    want["want"] = (want["v"] * n / pos)[::-1].groupby(want["g"][::-1]).cummin()[::-1]
    m = d.merge(want[["k", "want"]], on="k")
    assert np.allclose(m["low"], m["want"])


def test_least_from_here_in_one_piece_grows_with_its_rows(spark):
    rows = 100_000
    d = spark.range(rows).select(ranks.F.pmod(ranks.F.col("id") * 7919, ranks.F.lit(rows)).cast("double").alias("v"), ranks.F.col("id").alias("k"))
    got = ranks.least_from_here(d, [], ["v", "k"], lambda r, n: -r, "low", pieces=1)
    # Spark sums such a frame anew for every row of the piece.
    assert "currentrow$(), unboundedfollowing$()" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.filter(f"low = -{rows}").count() == rows
