import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import months
from pyspark.sql import functions as F

from panelyard.operators import aggregates as A
from panelyard.operators import episodes as E
from panelyard.operators import features as X
from panelyard.operators import graph as G
from panelyard.operators import joins as J
from panelyard.operators import keys as K
from panelyard.operators import normalise as N
from panelyard.operators import portfolio as P
from panelyard.operators import similarity as S
from panelyard.plans import studies as R
from panelyard.sources import ledgers as L


def panel(seed=0, n=60, entities=4):
    rng = np.random.default_rng(seed)
    return pd.DataFrame([(d, f"E{i}", "V", float(rng.normal())) for d in months(n) for i in range(entities)], columns=["date", "entity", "variable", "value"])


@pytest.mark.parametrize("op,col", [
    (lambda d: N.expanding_z(d, 5), "z"),
    (lambda d: N.rolling_z(d, 12, 5, prior=True), "z"),
    (lambda d: X.pit_buckets(d, 10, 12), "bucket"),
    (lambda d: X.expanding_percentile(d, 5), "pct"),
    (lambda d: X.rolling_percentile(d, 24, 6), "pct"),
    (lambda d: X.rolling_mad_winsor(d, 24, 6, 2.0, out="w"), "w"),
    (lambda d: X.ewm_mean(d, {"e": ("value", 5)}), "e"),
])
def test_future_rows_never_change_the_past(spark, op, col):
    pdf = panel()
    cut = sorted(pdf.date.unique())[40]
    shocked = pdf.copy()
    shocked.loc[shocked.date > cut, "value"] = 99.0
    key = ["date", "entity"]
    past = lambda p: op(spark.createDataFrame(p)).filter(F.col("date") <= F.lit(cut)).toPandas().sort_values(key)[col].to_numpy(dtype=float)
    a, b = past(pdf), past(shocked)
    assert np.allclose(a, b, equal_nan=True)


def test_full_sample_buckets_do_look_ahead(spark):
    pdf = panel()
    shocked = pdf.copy()
    shocked.loc[shocked.date > sorted(pdf.date.unique())[40], "value"] = 99.0
    f = lambda p: X.full_sample_buckets(spark.createDataFrame(p), 10).filter("date < '2002-01-01'").toPandas().sort_values(["date", "entity"])["bucket"].tolist()
    assert f(pdf) != f(shocked)


def test_prior_percentile_warm_up(spark):
    d = spark.createDataFrame([(m, "E", "V", float(i)) for i, m in enumerate(months(5))], "date date, entity string, variable string, value double")
    p = [r["pct"] for r in X.expanding_percentile(d, 3).orderBy("date").collect()]
    assert p == [None, None, None, 1.0, 1.0]


def test_ewm_outlier_replacement_matches_pandas(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=80)
    x[50] = 60.0
    d = spark.createDataFrame(pd.DataFrame({"date": months(80), "entity": "E", "variable": "V", "value": x}))
    got = X.ewm_outlier_replace(d, sigma=2.0).orderBy("date").toPandas()["value_clean"].to_numpy()
    e = pd.Series(x).ewm(span=20, adjust=False, min_periods=10)
    z = ((pd.Series(x) - e.mean()) / e.std()).abs()
    assert np.allclose(got, pd.Series(x).mask(z > 2, e.mean())) and got[50] != 60.0


def test_asof_matches_merge_asof(spark):
    rng = np.random.default_rng(9)
    days = pd.date_range("2001-01-01", "2001-12-31")
    l = pd.DataFrame({"date": rng.choice(days, 200), "entity": rng.choice(list("ab"), 200)}).assign(i=range(200)).sort_values("date")
    r = pd.DataFrame({"date": rng.choice(days, 25, replace=False)}).assign(entity=lambda d: np.where(d.index % 2, "a", "b"), v=range(25)).sort_values("date")
    for strict in (False, True):
        want = pd.merge_asof(l, r, on="date", by="entity", allow_exact_matches=not strict).sort_values("i")["v"].to_numpy()
        to = lambda p: spark.createDataFrame(p.assign(date=p["date"].dt.date))
        got = J.asof(to(l), to(r), ["entity"], ["v"], strict=strict).toPandas().sort_values("i")["v"].to_numpy(dtype=float)
        assert np.allclose(got, want, equal_nan=True)


def test_pair_correlation_without_pairs(spark):
    rng = np.random.default_rng(2)
    days = months(40)
    x = rng.normal(size=(40, 5)) + rng.normal(size=(40, 1))
    d = spark.createDataFrame(pd.DataFrame([(days[t], f"F{i}", float(x[t, i])) for t in range(40) for i in range(5)], columns=["date", "factor", "value"]))
    got = {r["date"]: r["mean_corr"] for r in A.mean_pair_correlation(d, 12).collect()}
    for t in (12, 25, 39):
        c = np.corrcoef(x[t - 12: t].T)
        assert np.isclose(got[days[t]], c[np.triu_indices(5, 1)].mean())


def test_pair_correlation_over_blocks_gaps_and_constant_series(spark):
    rng = np.random.default_rng(4)
    days, n, w = months(130), 9, 6
    x = rng.normal(size=(130, n)) + rng.normal(size=(130, 1))
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 0], x[40:60, 1], x[:, 2] = 0.1, 3.3, np.nan
    rows = [(days[t], f"F{i}", float(x[t, i])) for t in range(130) for i in range(n)]
    d = spark.createDataFrame(rows, "date date, factor string, value double")
    want = {}
    for t in range(w, 130):
        v = x[t - w:t]
        v = v[:, np.isfinite(v).all(axis=0)]
        v = v[:, v.max(axis=0) > v.min(axis=0)]
        if v.shape[1] > 1:
            want[days[t]] = (v.shape[1], np.corrcoef(v.T)[np.triu_indices(v.shape[1], 1)].mean())
    for size in (2, 4_096):
        got = {r["date"]: (r["n_series"], r["mean_corr"]) for r in A.mean_pair_correlation(d, w, series_per_task=size).collect()}
        assert got.keys() == want.keys() and len(want) > 50
        assert all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)
    assert A.mean_pair_correlation(d.limit(0), w).count() == 0


def test_forward_track_matches_a_loop(spark, daily_returns):
    rng = np.random.default_rng(6)
    r = daily_returns[rng.random(len(daily_returns)) < 0.4].copy()
    # one series with a long gap: its next row is the first one after many starts
    days = sorted(daily_returns.date.unique())
    r = r[(r.entity != "C03") | (r.date < days[50]) | (r.date > days[230])]
    picks = [days[0] - dt.timedelta(days=9), *days[5:290:15], days[-1] + dt.timedelta(days=3)]
    starts = [(f"C{i:02d}", s) for i in (0, 3, 7) for s in picks] + [("C03", picks[4]), ("none", picks[2])]
    got = E.forward_track(spark.createDataFrame(starts, "entity string, start date"), spark.createDataFrame(r), 6).toPandas()
    fwd = {}
    for e, g in r.sort_values("date").groupby("entity"):
        at, x = list(g.date), g.ret.to_numpy()
        for s in picks:
            i = next((i for i, d in enumerate(at) if d > s), None)
            if i is not None and i + 6 <= len(at):
                fwd[e, s] = (at[i], np.prod(1 + x[i:i + 6]) - 1)
    want = []
    for e, s in starts:
        if (e, s) in fwd:
            xs = [v[1] for (_, t), v in fwd.items() if t == s]
            want.append((e, s, fwd[e, s][0], fwd[e, s][1], np.mean(xs), len(xs)))
    got = sorted(got[["entity", "start", "first_date", "cum_return", "xs_mean", "n_entities"]].itertuples(index=False, name=None))
    assert len(got) == len(want) > 40
    for g, x in zip(got, sorted(want)):
        assert g[:3] == x[:3] and np.allclose(g[3:], x[3:])


@pytest.mark.parametrize("classes", [2, 9, 60])
def test_headline_list_leads_every_class(spark, classes):
    rng = np.random.default_rng(classes)
    rows = [(int(i), f"E{i % 40}", "up" if i % 3 else "down", int(rng.integers(classes)), None if i % 17 == 0 else float(rng.integers(30))) for i in range(400)]
    p = pd.DataFrame(rows, columns=["id", "entity", "direction", "cls", "score"])
    o = p.sort_values(["score", "id"], ascending=[False, True], na_position="last")
    o = o.drop_duplicates(["entity", "direction"])
    o["c"] = o.groupby("cls").cumcount() > 0
    want = o.sort_values("c", kind="stable").id.tolist()[:12]
    d = spark.createDataFrame(rows, "id int, entity string, direction string, cls int, score double")
    assert [r["id"] for r in S.diversified(d, "cls", "score", "id", 12).collect()] == want


def test_ranks_inside_themes_keep_null_scores_last(spark):
    rows = [("a", f"e{i}", float(v)) for i, v in enumerate((1, -5, 5, 0, 2))] + [("a", "z", None), ("b", "x", None), (None, "y", 3.0), (None, "w", -4.0)]
    got = G.ranked_discoveries(spark.createDataFrame(rows, "theme string, entity string, score double")).collect()
    assert {(r["theme"], r["entity"]): r["rank_in_theme"] for r in got} == {
        ("a", "e1"): 1, ("a", "e2"): 2, ("a", "e4"): 3, ("a", "e0"): 4, ("a", "e3"): 5, ("a", "z"): 6, ("b", "x"): 1, (None, "w"): 1, (None, "y"): 2}


def test_swapped_source_breaches(spark):
    m = months(6)
    a = spark.createDataFrame([(d, e, v) for d in m for e, v in (("X", 1.0), ("Y", 5.0), ("Z", 2.0))], "date date, entity string, value double")
    b = spark.createDataFrame([(d, e, v) for d in m for e, v in (("X", 5.0), ("Y", 1.0), ("Z", 2.0))], "date date, entity string, value double")
    r = {x["entity"]: x["breach"] for x in A.cross_source_discrepancy(a, b, 6, 0.5).collect()}
    assert r == {"X": True, "Y": True, "Z": False}


def test_blocked_cosine_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 8))
    d = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "id long, vec array<double>")
    got = S.top_k_cosine(d, "id", "vec", 4, block_rows=7).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -1)
    for i in range(60):
        want = [j for j in np.argsort(-sim[i])[:4] if sim[i, j] > 0]
        assert got[got.focal == i].sort_values("rank")["neighbor"].tolist() == want


def test_correlated_pairs_in_blocks(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=50)
    pdf = pd.DataFrame([(d, f"s{i}", float(base[t] * (i % 2) + rng.normal() * 0.3)) for t, d in enumerate(months(50)) for i in range(6)], columns=["date", "variable", "value"])
    got = {(r["a"], r["b"]) for r in S.correlated_pairs(spark.createDataFrame(pdf), 0.7, block_rows=2).collect()}
    c = pdf.pivot(index="date", columns="variable", values="value").corr()
    want = {(a, b) for a in c for b in c if a < b and abs(c.loc[a, b]) >= 0.7}
    assert got == want and got


def test_pagerank_sums_to_one_and_two_hop_mean_drops_the_diagonal(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("c", "d", 1.0), ("b", "a", 3.0)], "src string, dst string, weight double")
    assert np.isclose(G.pagerank(e, 20).agg(F.sum("rank")).first()[0], 1.0)
    m = spark.createDataFrame([(dt.date(2000, 1, 1), n, float(i)) for i, n in enumerate("abcd")], "date date, entity string, value double")
    a = {r["entity"]: r["nbr"] for r in G.two_hop_mean(m, e).collect()}
    b = {r["entity"]: r["nbr"] for r in G.neighbour_mean(m, G.two_hop_edges(e)).collect()}
    assert a.keys() == b.keys() and all(np.isclose(a[k], b[k]) for k in a)


def test_nearest_analog_of_the_first_increasing_key(spark):
    d = spark.createDataFrame([(f"k{i:02d}", f, float(i)) for i in range(12) for f in ("f1", "f2")], "key string, feature string, value double")
    assert S.nearest_analogs(d, "k00", 3).first()["key"] == "k01"


def test_soft_band_weights_sum_to_one_at_every_size(spark):
    rows = [(n, f"e{i:03d}", float(-i)) for n in (1, 3, 4, 7, 20, 34, 101) for i in range(n)]
    w = P.soft_band_weights(spark.createDataFrame(rows, "g int, entity string, value double"), ["g"]).groupBy("g").agg(F.sum("weight")).collect()
    assert all(np.isclose(r[1], 1.0) for r in w) and {r[0] for r in w} >= {7, 20, 34, 101}


def test_month_end_portfolio_matches_a_loop(spark, daily_returns):
    r = daily_returns.copy()
    sig = r.assign(value=r.groupby("entity")["ret"].transform(lambda s: s.rolling(5, min_periods=1).sum()))[["date", "entity", "value"]]
    days = sorted(r.date.unique())
    reb = days[20::40]
    got = P.month_end_portfolio(spark.createDataFrame(sig), spark.createDataFrame(r), 4, spark.createDataFrame([(d,) for d in reb], "date date")).orderBy("rebalance").toPandas()
    sp, rp = sig.pivot(index="date", columns="entity", values="value"), r.pivot(index="date", columns="entity", values="ret")
    old, want = pd.Series(0.0, index=rp.columns), []
    for i, d in enumerate(reb):
        s = sp[sp.index < d].ffill().iloc[-1].sort_index().sort_values(ascending=False, kind="stable")
        w = pd.Series(0.0, index=rp.columns)
        w[s.index[:4]] = 0.25
        turn = (w - old).abs().sum() / 2
        hold = rp[(rp.index >= d) & ((rp.index < reb[i + 1]) if i + 1 < len(reb) else True)]
        hold = rp[(rp.index > d) & ((rp.index <= reb[i + 1]) if i + 1 < len(reb) else True)]
        v = w * (1 + hold).prod()
        want.append((v.sum() - 1, turn))
        old = v / v.sum()
    assert np.allclose(got["period_return"], [x[0] for x in want]) and np.allclose(got["turnover"], [x[1] for x in want])


def test_rebalances_keep_old_signals_and_spread_no_grid(spark, daily_returns):
    rng = np.random.default_rng(8)
    r = daily_returns
    days = sorted(r.date.unique())
    reb = days[20::30]
    sig = r.assign(value=rng.normal(size=len(r)).round(1))[["date", "entity", "value"]]
    sig = sig[(rng.random(len(sig)) < 0.03)]  # signals that stay for several rebalances, with ties
    got = P.month_end_portfolio(spark.createDataFrame(sig), spark.createDataFrame(r), 3, spark.createDataFrame([(d,) for d in reb], "date date")).orderBy("rebalance").toPandas()
    rp, old, want = r.pivot(index="date", columns="entity", values="ret"), pd.Series(0.0, index=sorted(r.entity.unique())), []
    for i, d in enumerate(reb):
        s = sig[sig.date < d].sort_values("date").groupby("entity")["value"].last().sort_index().sort_values(ascending=False, kind="stable")
        w = pd.Series(0.0, index=old.index)
        w[s.index[:3]] = 1 / min(3, len(s))
        hold = rp[(rp.index > d) & ((rp.index <= reb[i + 1]) if i + 1 < len(reb) else True)]
        v = w * (1 + hold).prod()
        want.append((v.sum() - 1, (w - old).abs().sum() / 2))
        old = v / v.sum()
    assert np.allclose(got[["period_return", "turnover"]].to_numpy(), want)


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame([(d, f"E{i}", v, float(rng.normal())) for d in months(48) for i in range(12) for v in ("a", "b")], columns=["date", "entity", "variable", "value"])
    ret = pd.DataFrame([(d, f"E{i}", float(rng.normal())) for d in months(48) for i in range(12)], columns=["date", "entity", "ret"])
    got = P.walk_forward_ridge(spark.createDataFrame(pdf), spark.createDataFrame(ret), ["a", "b"], 1.0, 2, 100).toPandas().set_index(["date", "entity"])["score"]
    z = pdf.assign(z=pdf.groupby(["date", "variable"])["value"].transform(lambda s: (s - s.mean()) / s.std(ddof=0))).pivot_table(index=["date", "entity"], columns="variable", values="z")
    y = ret.sort_values("date").assign(y=lambda d: d.groupby("entity")["ret"].shift(-1)).set_index(["date", "entity"])["y"]
    y = y - y.groupby("date").transform("mean")
    j = z.join(y).reset_index()
    tr = j[(pd.to_datetime(j.date).dt.year < 2003) & j.y.notna()]
    b = np.linalg.solve(tr[["a", "b"]].T @ tr[["a", "b"]] + np.eye(2), tr[["a", "b"]].T @ tr["y"])
    te = j[pd.to_datetime(j.date).dt.year == 2003]
    assert np.allclose(got.loc[list(zip(te.date, te.entity))], te[["a", "b"]] @ b)


def test_absorption_states_and_cap(spark):
    d = spark.createDataFrame([(x,) for x in (-0.05, 0.0, 0.01, 0.019, None)], "r double")
    i = E.absorption_index(F.col("r"), F.lit(0.02))
    got = [r[0] for r in d.select(E.absorption_state(i)).collect()]
    assert got == ["repriced_against", "unabsorbed", "partially_absorbed", "absorbed", "insufficient_signal"]
    assert d.select(F.min(i)).first()[0] == -2.0


def test_ledger_folds_and_unknown_events_raise(spark):
    ev = spark.createDataFrame([("T1", 1, "open", "a", None, None), ("T1", 2, "mark", None, 0.1, None), ("T1", 3, "mark", None, 0.2, None), ("T1", 4, "close", None, None, "hit"), ("T9", 5, "mark", None, 0.5, None)],
                               "id string, seq int, event string, entity string, ret double, status string")
    f = L.fold(L.check_events(ev, ["open", "mark", "close"]), "id", "open", ["entity", "status"], {"close": ["status"]}, lists={"marks": ("mark", ["ret"])}).collect()
    assert len(f) == 1 and f[0]["status"] == "hit" and [m["ret"] for m in f[0]["marks"]] == [0.1, 0.2]
    with pytest.raises(Exception, match="unknown event type"):
        L.check_events(ev, ["open"]).collect()


def test_guards_refuse(spark):
    with pytest.raises(ValueError):
        K.refuse_forward_returns("12MRet")
    with pytest.raises(ValueError):
        K.allow_listed(spark.range(1), ["id", "fwd"], "t", {"t": ["id"]})
    with pytest.raises(Exception, match="unclassified"):
        K.longest_prefix(spark.createDataFrame([("ZZZ",)], "variable string"), {"A": "a"}).collect()


def test_nested_forbidden_keys_are_removed(spark):
    d = spark.createDataFrame([('{"a":1,"x":{"outcome":{"b":2},"c":3},"outcome":[1,2]}',)], "p string")
    assert d.select(K.strip_payload_keys(F.col("p"), "outcome")).first()[0] == '{"a":1,"x":{"c":3}}'


def test_fan_out_repeats_codes(spark):
    d = spark.createDataFrame([("USA", 1.0), ("AUS", 2.0), ("XXX", 3.0)], "code string, v double")
    m = spark.createDataFrame([("USA", "US"), ("USA", "Nasdaq"), ("AUS", "Australia")], "code string, entity string")
    assert sorted(r["entity"] for r in K.fan_out(d, m).collect()) == ["Australia", "Nasdaq", "US"]


def test_interaction_test_finds_an_interaction(spark):
    rng = np.random.default_rng(6)
    rows, reg = [], []
    for d in months(40):
        for i in range(12):
            g = ("Growth", "Recession", "Neutral")[int(rng.integers(3))]
            s = float(rng.normal())
            reg.append((f"E{i}", d, g))
            rows.append(("hit", d, f"E{i}", s, s * (1.5 if g == "Growth" else 0.0) + float(rng.normal())))
            rows.append(("nil", d, f"E{i}", s, float(rng.normal())))
    r = spark.createDataFrame(rows, "factor string, date date, entity string, rank_signal double, rank_ret double")
    g = spark.createDataFrame(reg, "entity string, date date, regime string")
    out = {x["factor"]: x for x in R.interaction_test(r, g, 199).collect()}
    assert out["hit"]["p_boot"] < 0.02 < out["nil"]["p_boot"] and 1.0 < out["hit"]["growth_coef"] < 2.0


def test_hidden_states_find_the_bad_regime(spark):
    rng = np.random.default_rng(12)
    n = 144
    state = np.repeat([0, 1], 12).repeat(1)
    state = np.tile(state, n // 24)
    pdf = pd.DataFrame({"entity": "E", "date": months(n), "f1": np.where(state, 3.0, -3.0) + rng.normal(0, .4, n), "f2": rng.normal(size=n)})
    ret = pdf[["entity", "date"]].assign(ret=np.where(state, -0.04, 0.03) + rng.normal(0, 0.005, n))
    p = R.hidden_states(spark.createDataFrame(pdf), spark.createDataFrame(ret), ["f1", "f2"], 60, states=(2,)).toPandas().sort_values("date")
    s = pd.Series(state, index=months(n)).loc[p["date"]].to_numpy()
    assert ((p["p_adverse"] > 0.5).to_numpy() == (s == 1)).mean() > 0.95


def test_bootstrap_is_deterministic_and_centred(spark):
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(f"c{i % 30}", float(rng.normal(1, 1))) for i in range(300)], "c string, x double")
    a, b = (R.clustered_mean_difference(d.repartition(n), "x", "c", 200).first() for n in (1, 5))
    assert np.allclose([a["ci_lo"], a["ci_hi"]], [b["ci_lo"], b["ci_hi"]]) and a["ci_lo"] < a["mean_diff"] < a["ci_hi"]


def test_f_tail_known_values():
    from panelyard.functions.small_stats import f_tail, t_two_sided

    assert np.isclose(f_tail(4.0, 1, 1e9), 0.04550026, atol=1e-6)
    assert np.isclose(t_two_sided(2.228139, 10), 0.05, atol=1e-6)


def test_local_outliers_match_weighted_moments(spark):
    from panelyard.operators.features import local_outlier_replace

    rng = np.random.default_rng(0)
    rows = []
    for e in range(2):
        x = rng.normal(0, 1, 60)
        x[rng.integers(0, 60, 4)] = 12
        x[rng.integers(0, 60, 4)] = np.nan
        rows += [(d.date(), str(e), "A", None if v != v else float(v)) for d, v in zip(pd.date_range("2000-01-01", periods=60), x)]
    got = local_outlier_replace(spark.createDataFrame(rows, "date date, entity string, variable string, value double")).toPandas().sort_values(["entity", "date"])
    replaced = 0
    for _, p in got.groupby("entity"):
        x = p["value"].to_numpy(float)
        for i, out in enumerate(p["value_clean"].to_numpy(float)):
            near = np.r_[x[max(0, i - 20): i], x[i + 1: i + 21]]
            w = (19 / 21) ** np.arange(len(near) - 1, -1, -1.0)
            w, v = w[~np.isnan(near)], near[~np.isnan(near)]
            m = (w * v).sum() / w.sum()
            s = np.sqrt((w * (v - m) ** 2).sum() / w.sum() * w.sum() ** 2 / (w.sum() ** 2 - (w**2).sum()))
            want = m if abs(x[i] - m) > 4 * s else x[i]
            replaced += want != x[i] and want == want and x[i] == x[i]
            assert (np.isnan(want) and np.isnan(out)) or abs(want - out) < 1e-9
    assert replaced > 3


def test_equal_vectors_give_k_rows_each(spark):
    from panelyard.operators.similarity import top_k_cosine

    d = spark.range(300).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    got = top_k_cosine(d, "id", "v", 5, block_rows=64)
    assert got.count() == 1500
    assert {r.neighbor for r in got.filter("focal = 7").collect()} == {0, 1, 2, 3, 4}


def test_pruning_in_rounds_equals_the_loop(spark):
    from panelyard.operators.similarity import greedy_prune

    rng = np.random.default_rng(2)
    names = [f"n{i:02d}" for i in range(40)]
    pairs = {(a, b) for a in names for b in names if a < b and rng.random() < 0.15}
    kept = []
    for n in names:
        if not any((min(n, k), max(n, k)) in pairs for k in kept):
            kept.append(n)
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, position long")
    clash = spark.createDataFrame(sorted(pairs), "a string, b string")
    assert sorted(r.name for r in greedy_prune(order, clash).collect()) == kept
    assert [r.name for r in greedy_prune(order, clash, 3).orderBy("position").collect()] == kept[:3]


def test_pagerank_raises_if_not_settled(spark):
    from panelyard.operators.graph import pagerank

    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "b", 1.0)], "src string, dst string, weight double")
    r = {x.node: x["rank"] for x in pagerank(e, tolerance=1e-9).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r["b"] > r["a"]
    with pytest.raises(RuntimeError):
        pagerank(e, tolerance=1e-15, most=3)


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_katz_mean_is_that_of_the_dense_matrix(spark, hops):
    rng = np.random.default_rng(hops)
    n = 30
    a = np.where(rng.random((n, n)) < 0.15, rng.random((n, n)), 0.0)
    a[0], a[:, 0] = rng.random(n), rng.random(n)  # a hub
    np.fill_diagonal(a, 0.0)
    a[5] = 0.0  # a node without edges out
    w = a / np.where(a.sum(1, keepdims=True) > 0, a.sum(1, keepdims=True), 1)
    acc, p = np.zeros((n, n)), np.eye(n)
    for _ in range(hops):
        p = p @ (0.5 * w)
        acc += p
    np.fill_diagonal(acc, 0.0)
    x = np.where(rng.random((n, 2)) < 0.3, np.nan, rng.normal(size=(n, 2)))
    e = spark.createDataFrame([(f"n{i}", f"n{j}", float(a[i, j])) for i in range(n) for j in range(n) if a[i, j] > 0], "src string, dst string, weight double")
    m = spark.createDataFrame([(f"n{i}", d, None if np.isnan(x[i, d]) else float(x[i, d])) for i in range(n) for d in range(2)], "entity string, date int, value double")
    got = {(r.entity, r.date): r.nbr for r in G.katz_mean(m, e, hops=hops).collect()}
    here = ~np.isnan(x)
    den = acc @ here
    want = {(f"n{i}", d): (acc @ np.nan_to_num(x))[i, d] / den[i, d] for i in range(n) for d in range(2) if den[i, d] > 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_top_k_cosine_visits_few_blocks_and_misses_nothing(spark, monkeypatch):
    from panelyard.operators import similarity as S

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    v = centres[rng.integers(0, 12, 600)] + rng.normal(scale=0.08, size=(600, 16))
    v[5], v[6] = 0.0, v[7]
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [])], "id long, v array<double>")
    seen = []
    settle = S.settle
    monkeypatch.setattr(S, "settle", lambda df: seen.append(settle(df)) or seen[-1])
    got = {(r.focal, r["rank"]): (r.neighbor, round(r.sim, 9)) for r in S.top_k_cosine(d, "id", "v", 4, block_rows=20).collect()}
    u = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), 1)
    sim = u @ u.T
    np.fill_diagonal(sim, -np.inf)
    for i in range(600):
        best = np.sort(sim[i])[::-1][:4]
        want = [round(float(x), 9) for x in best if x > 0]
        assert [got[i, r + 1][1] for r in range(len(want))] == pytest.approx(want, abs=1e-8)
    assert not [i for i, _ in got if i in (5, 900, 901)]
    assert seen[-1].columns == ["key", "v", "c", "b"] and seen[-1].count() < 0.4 * 600 * (600 / 20)
    assert S.top_k_cosine(d.limit(0), "id", "v", 4).count() == 0 and S.top_k_cosine(d.filter("id = 1"), "id", "v", 4).count() == 0


def test_top_k_cosine_moves_rows_a_fixed_number_of_times(spark, monkeypatch):
    from panelyard.operators import similarity as S

    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 24))  # nothing is ruled out: every row meets every block
    d = spark.createDataFrame([(f"k{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("k007", v[9].tolist()), (None, v[3].tolist())], "id string, v array<double>")
    seen = []
    settle = S.settle
    monkeypatch.setattr(S, "settle", lambda df: seen.append(settle(df)) or seen[-1])
    got = S.top_k_cosine(d, "id", "v", 3, block_rows=20).collect()
    assert sum(x.count() for x in seen) < 3 * 602
    names = [f"k{i:03d}" for i in range(600)] + ["k007", None]
    u = np.vstack([v, v[9], v[3]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sim = u @ u.T
    for name in ("k000", "k003", "k007", "k009", "k599"):
        pairs = [(float(sim[a, b]), names[b] or "") for a in range(602) if names[a] == name for b in range(602) if names[b] != name and sim[a, b] > 0]
        want = sorted(pairs, key=lambda p: (-round(p[0], 9), p[1]))[:3]
        found = sorted((r for r in got if r.focal == name), key=lambda r: r["rank"])
        assert [r.sim for r in found] == pytest.approx([s for s, _ in want], abs=1e-9)
        assert {r.neighbor or "" for r in found} == {n for _, n in want}


def test_blocks_that_angles_rule_out_are_not_read():
    import pyarrow as pa

    from panelyard.operators import similarity as S

    rng = np.random.default_rng(6)
    heads = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    made = {}
    for c in range(8):
        for b in range(3):
            x = S._unit(heads[c] + rng.normal(scale=0.02, size=(10, 8)))
            made[f"{c}-{b}"] = pa.table({"key": pa.array(range(c * 100 + b * 10, c * 100 + b * 10 + 10)), "v": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8)})
    angle = [max(float(np.arccos(S._matrix(made[f"{c}-{b}"]) @ heads[c]).max()) for b in range(3)) for c in range(8)]
    blocks, opened = [(int(n[0]), n) for n in made], []
    got = S._nearest(blocks[3:4], blocks, lambda n: opened.append(n) or made[n], heads, np.array(angle), 5, 4)
    assert set(opened) == {"1-0", "1-1", "1-2"} and len(got) == 50
    x, y = S._matrix(made["1-0"]), np.vstack([S._matrix(made[n]) for n in made])
    sim = x @ y.T
    sim[np.arange(10), np.arange(30, 40)] = -1
    assert got.column("sim").to_numpy().reshape(10, 5) == pytest.approx(np.sort(sim, axis=1)[:, :-6:-1])
