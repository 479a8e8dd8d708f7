"""Gap episodes: candidate scoring, promotion, marks, closures and outcomes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import clip, ratio, so_far
from ..session import settle
from .joins import nearest, numbered, with_boundaries_passed

# Score weights, caps, gates and expected moves by class and horizon.
WEIGHTS_PLUS = {"severity": 0.28, "novelty": 0.12, "prior": 0.10, "expression": 0.14, "catalyst": 0.08}
WEIGHTS_MINUS = {"drag": 0.05, "crowding": 0.08, "staleness": 0.08, "quality": 0.07}
NOVELTY = {"new": 1.0, "intensifying": 0.9, "persisting": 0.55, "fading": 0.30, "resolved": 0.0}
TIER_QUALITY = {"high": 0.95, "medium": 0.80, "low": 0.55, "micro": 0.25, "missing": 0.10}
MAX_AGE, MIN_SEVERITY, MIN_TENSION, AGAINST_CAP = 63, 1.0, 0.35, 0.30
INDEX_CAP, MOVE_FLOOR, CATALYST = 2.0, 0.005, 0.35
HORIZON_DAYS = {"5d": 5, "21d": 21, "63d": 63, "126d": 126}
EXPECTED_MOVE = {
    "G1": (0.006, 0.015, 0.030, 0.050), "G2": (0.008, 0.020, 0.040, 0.060), "G3": (0.006, 0.018, 0.035, 0.050),
    "G4": (0.004, 0.014, 0.030, 0.050), "G5": (0.010, 0.025, 0.045, 0.065), "G6": (0.004, 0.010, 0.020, 0.030),
    "G7": (0.004, 0.012, 0.025, 0.040), "G8": (0.004, 0.012, 0.025, 0.040),
}
RANKED = ("G1", "G2", "G3", "G4", "G5")


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))])


def sign_of(direction: Column) -> Column:
    return F.when(direction == "long", 1).when(direction == "short", -1).otherwise(0)


def expression_quality(tier: Column, basis_z: Column, ticker: Column) -> Column:
    q = F.coalesce(_map(TIER_QUALITY)[tier], F.lit(0.20)) - F.coalesce(F.least(F.lit(0.30), F.abs(basis_z) / 10), F.lit(0.0))
    return clip(F.when(ticker.isNull(), 0.10).otherwise(q), 0, 1)


def staleness_penalty(days: Column, max_age: int = MAX_AGE) -> Column:
    return F.when(days.isNull(), 0.2).otherwise(clip(F.greatest(F.lit(0), days - 5) / max(1, max_age - 5), 0, 1))


def tension(c: dict[str, Column]) -> Column:
    plus = sum(F.lit(w) * c[k] for k, w in WEIGHTS_PLUS.items())
    minus = sum(F.lit(w) * c[k] for k, w in WEIGHTS_MINUS.items())
    return clip(plus - minus, 0, 1)


def score_candidates(det: DataFrame, price: DataFrame) -> DataFrame:
    """Score detections (detector, entity, direction, severity, status, days_active, gap_class,
    horizon, prior) against the price state (entity, ticker, liquidity, basis_z, crowding_z,
    expense_bps)."""
    j = det.join(price.withColumn("_has", F.lit(True)), "entity", "left")
    has = F.coalesce("_has", F.lit(False))
    q = F.when(has, expression_quality(F.col("liquidity"), F.col("basis_z"), F.col("ticker"))).otherwise(0.10)
    j = j.withColumns(
        {
            "has_price": has,
            "severity_score": clip(F.coalesce(F.abs("severity"), F.lit(0.0)) / 3, 0, 1),
            "novelty_score": F.coalesce(_map(NOVELTY)[F.col("status")], F.lit(0.35)),
            "prior_score": clip(F.coalesce("prior", F.lit(0.5)), 0, 1),
            "expression_score": q,
            "drag_score": clip(F.coalesce("expense_bps", F.lit(0.0)) / 100, 0, 1),
            "crowding_score": F.when(~has, 0.2).when(F.col("crowding_z").isNull(), 0.15).otherwise(clip(F.abs("crowding_z") / 3, 0, 1)),
            "staleness_score": staleness_penalty(F.col("days_active")),
        }
    )
    j = j.withColumn("quality_score", F.when(F.col("expression_score") >= 0.25, 0.0).otherwise(0.8))
    c = {k: F.col(f"{k}_score") for k in (*WEIGHTS_PLUS, *WEIGHTS_MINUS) if k != "catalyst"}
    return j.withColumn("tension", tension({**c, "catalyst": F.lit(CATALYST)})).drop("_has")


def expected_move(gap_class: Column, horizon: Column, severity: Column, direction: Column) -> Column:
    table = {f"{g}|{h}": m for g, ms in EXPECTED_MOVE.items() for h, m in zip(HORIZON_DAYS, ms)}
    base = F.coalesce(_map(table)[F.concat_ws("|", gap_class, horizon)], F.lit(0.015))
    return sign_of(direction) * base * clip(F.abs(severity) / 2.0, 0.5, 2.0)


def signature(components: Column, *labels: Column) -> Column:
    """Stable id of a candidate: labels and rounded components in key order."""
    entries = F.array_sort(F.map_entries(F.transform_values(components, lambda k, v: F.round(v, 4))))
    text = F.to_json(F.map_from_entries(entries))
    return F.substring(F.sha1(F.concat_ws("|", *labels, text)), 1, 20)


def shadow_score(candidate_id: Column, seed: str = "shadow_v1") -> Column:
    """Uniform pseudo-random score in [0, 1) that depends on the id alone."""
    h = F.substring(F.sha1(F.concat_ws("|", candidate_id, F.lit(seed))), 1, 13)
    return F.conv(h, 16, 10).cast("double") / float(2**52)


def promote(scored: DataFrame, open_episodes: DataFrame, history: DataFrame, as_of: str, universe: DataFrame) -> DataFrame:
    """Holdout rows of the day with the promotion decision, and the episode each promoted
    candidate opens or belongs to.

    open_episodes (episode_key, gap_id); history (episode_key, episode_instance).  One open
    episode per key: a promoted candidate of an open key joins it, else it opens the next
    instance; the strongest candidate of a key opens it.
    """
    key = F.concat_ws("|", "entity", "gap_class", "direction", "horizon")
    d = scored.withColumn("episode_key", key).join(universe.select("entity").distinct().withColumn("_u", F.lit(True)), "entity", "left")
    eligible = (
        F.col("status").isin("new", "intensifying", "persisting", "fading") & (F.coalesce("archetype", F.lit("")) != "degraded")
        & (F.abs("severity") >= MIN_SEVERITY) & F.coalesce("_u", F.lit(False)) & F.col("direction").isin("long", "short") & F.col("has_price")
    )
    research = ~F.col("gap_class").isin(*RANKED) | (F.col("detector") == "D8")
    d = d.withColumns({"eligible": F.coalesce(eligible, F.lit(False)), "research_only": research})
    d = d.withColumn("promoted", F.col("eligible") & ~F.col("research_only") & (F.col("tension") >= MIN_TENSION))
    w = Window.partitionBy("episode_key", "promoted").orderBy(F.col("tension").desc(), "detector")
    inst = history.groupBy("episode_key").agg(F.max("episode_instance").alias("_last"))
    d = (
        d.withColumn("_r", F.row_number().over(w))
        .join(open_episodes.select("episode_key", F.col("gap_id").alias("_open")), "episode_key", "left")
        .join(inst, "episode_key", "left")
    )
    nxt = F.coalesce("_last", F.lit(0)) + 1
    fresh = F.substring(F.sha1(F.concat_ws("|", "episode_key", F.lit(as_of), nxt.cast("string"))), 1, 20)
    return d.withColumns(
        {
            "gap_id": F.when(F.col("promoted"), F.coalesce("_open", fresh)),
            "opens": F.col("promoted") & F.col("_open").isNull() & (F.col("_r") == 1),
            "episode_instance": F.when(F.col("promoted") & F.col("_open").isNull(), nxt.cast("long")),
            "reason_not_promoted": F.when(~F.col("promoted"), F.when(F.col("research_only"), "research_only").otherwise("below_threshold_or_ineligible")),
            "shadow_score": shadow_score(F.concat_ws("|", F.lit(as_of), "episode_key", "detector")),
        }
    ).drop("_r", "_open", "_last", "_u")


def expression_rows(episodes: DataFrame, tickers: DataFrame) -> DataFrame:
    """One row per ticker of each opened episode: the primary first, then the alternates
    (entity, tickers array)."""
    e = episodes.filter("opens").join(tickers, "entity")
    return e.select("gap_id", "entity", F.posexplode(F.array_distinct("tickers")).alias("_p", "ticker")).select(
        "gap_id", "entity", "ticker", (F.col("_p") == 0).alias("is_primary")
    )


def absorption_index(realized: Column, expected: Column, floor: float = MOVE_FLOOR, cap: float = INDEX_CAP) -> Column:
    ok = (F.abs(expected) >= floor) & realized.isNotNull()
    return F.when(ok, clip(realized / F.greatest(F.abs(expected), F.lit(floor)), -cap, cap))


def absorption_state(index: Column) -> Column:
    return (
        F.when(index.isNull(), "insufficient_signal").when(index < -0.25, "repriced_against").when(index < 0.25, "unabsorbed")
        .when(index < 0.75, "partially_absorbed").otherwise("absorbed")
    )


def mark(episodes: DataFrame, price: DataFrame, as_of: str) -> DataFrame:
    """Mark open episodes: absorption, current tension, and the closure if one is due.

    episodes carry their open scores, expected_move and first_seen; price (entity, ret,
    liquidity, basis_z, ticker, crowding_z)."""
    at = F.lit(as_of).cast("date")
    p = price.select("entity", F.col("ret").alias("_ret"), F.col("liquidity").alias("_liq"), F.col("basis_z").alias("_bz"), F.col("ticker").alias("_tk"), F.col("crowding_z").alias("_cz"), F.lit(True).alias("_has"))
    j = episodes.join(p, "entity", "left")
    s, has = sign_of(F.col("direction")), F.coalesce("_has", F.lit(False))
    j = j.withColumns({"realized": F.when(s != 0, s * F.col("_ret")), "age": F.datediff(at, "first_seen") + 1})
    j = j.withColumn("absorption_index", absorption_index(F.col("realized"), F.col("expected_move")))
    j = j.withColumn("_state", absorption_state(F.col("absorption_index")))
    old = F.col("age") > MAX_AGE
    reason = (
        F.when(old & F.col("_state").isin("unabsorbed", "insufficient_signal"), "max_age_unabsorbed")
        .when(old & (F.col("_state") == "repriced_against"), "max_age_repriced_against")
        .when(F.col("_state") == "absorbed", "absorbed")
    )
    j = j.withColumn("close_reason", reason)
    j = j.withColumn("state", F.when(F.col("close_reason") == "max_age_unabsorbed", "decayed").otherwise(F.col("_state")))
    expr = F.when(has, expression_quality(F.col("_liq"), F.col("_bz"), F.col("_tk"))).otherwise(0.10)
    crowd = F.when(~has, 0.2).when(F.col("_cz").isNull(), 0.15).otherwise(clip(F.abs("_cz") / 3, 0, 1))
    j = j.withColumns({"_q": expr, "_crowd": crowd})
    base = tension({
        "severity": F.coalesce("severity_score", F.lit(0.0)), "novelty": F.coalesce("novelty_score", F.lit(0.0)), "prior": F.coalesce("prior_score", F.lit(0.0)),
        "catalyst": F.lit(CATALYST), "drag": F.coalesce("drag_score", F.lit(0.0)), "expression": F.col("_q"), "crowding": F.col("_crowd"),
        "staleness": staleness_penalty(F.col("age")), "quality": F.when(F.col("_q") >= 0.25, 0.0).otherwise(0.8),
    })
    idx = F.coalesce("absorption_index", F.lit(0.0))
    now = (
        F.when(F.col("state") == "repriced_against", clip(F.least(base, F.lit(AGAINST_CAP)) * (1 - clip(F.abs(idx), 0, 1)), 0, 1))
        .when(F.col("state").isin("partially_absorbed", "absorbed", "decayed"), clip(base * clip(1 - idx, 0, 1), 0, 1))
        .otherwise(base)
    )
    label = _text({"max_age_unabsorbed": "unresolved_decay", "max_age_repriced_against": "falsified", "absorbed": "success_with_absorption"})
    return j.select(
        "gap_id", "entity", at.alias("date"), "realized", "expected_move", "absorption_index",
        F.when(F.col("absorption_index").isNotNull(), clip(1 - F.col("absorption_index"), 0, 1)).alias("unabsorbed"),
        "state", now.alias("tension_now"), F.col("age").cast("long").alias("days_active"), "close_reason", label[F.col("close_reason")].alias("outcome"),
    )


def _text(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def close_episodes(episodes: DataFrame, marks: DataFrame) -> DataFrame:
    c = marks.filter(F.col("close_reason").isNotNull()).select("gap_id", F.col("close_reason").alias("_c"), F.col("date").alias("_d"))
    return episodes.join(c, "gap_id", "left").withColumns(
        {"status": F.when(F.col("_c") == "max_age_unabsorbed", "expired").when(F.col("_c").isNotNull(), "closed").otherwise(F.col("status")),
         "closed_at": F.coalesce("_d", "closed_at"), "close_reason": F.coalesce("_c", "close_reason")}
    ).drop("_c", "_d")


# Fixed value: cost of one crossing.
COST_ONE_WAY = 0.0025


def score_outcomes(episodes: DataFrame, prices: DataFrame, index_returns: DataFrame, cost: float = COST_ONE_WAY) -> DataFrame:
    """Active return of each episode over its horizon.

    episodes (gap_id, entity, direction, opened, horizon_days, ticker); prices (date, ticker,
    close).  Entry is the first price-calendar date after opening, exit ``horizon`` calendar
    rows later; the benchmark is the mean of all tickers with both prices.  The window
    position replaces a date-range join; the index leg is a difference of cumulative logs.
    """
    cal = prices.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))
    # entry position: first calendar row after the opening date, from the short list of dates
    opened = episodes.select(F.col("opened").alias("date")).distinct()
    u = cal.select("date", "_i", F.lit(0).alias("_s")).unionByName(opened.select("date", F.lit(None).cast("int").alias("_i"), F.lit(1).alias("_s")))
    w = Window.orderBy(F.col("date").desc(), F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    entry = u.withColumn("_e", F.last("_i", ignorenulls=True).over(w)).filter("_s = 1").select(F.col("date").alias("opened"), F.col("_e"))
    end = cal.agg(F.max("_i").alias("_end"))
    ep = episodes.join(entry, "opened", "left").join(end).withColumn("_x", F.col("_e") + F.col("horizon_days"))
    ep = ep.withColumn("matured", F.coalesce(F.col("_x") <= F.col("_end"), F.lit(False)))
    px = prices.filter(F.col("close").isNotNull()).join(cal, "date").select("ticker", "_i", "close")
    # window returns are needed only for the (entry, exit) pairs that occur
    pairs = ep.filter("matured").select("_e", "_x").distinct()
    p0 = px.select("ticker", F.col("_i").alias("_e"), F.col("close").alias("_p0"))
    p1 = px.select("ticker", F.col("_i").alias("_x"), F.col("close").alias("_p1"))
    win = pairs.join(p0, "_e").join(p1, ["ticker", "_x"]).filter(F.col("_p0") > 0).withColumn("_r", F.col("_p1") / F.col("_p0") - 1)
    ew = win.groupBy("_e", "_x").agg(F.avg("_r").alias("r_ew"))
    own = win.select("_e", "_x", "ticker", F.col("_r").alias("r_inst"))
    days = cal.select("_i", "date")
    ep = ep.join(own, ["_e", "_x", "ticker"], "left").join(ew, ["_e", "_x"], "left").join(
        days.select(F.col("_i").alias("_e"), F.col("date").alias("entry")), "_e", "left").join(
        days.select(F.col("_i").alias("_x"), F.col("date").alias("exit")), "_x", "left")
    ep = settle(ep)  # its entry and exit dates are looked up below
    # compounded index return over (entry, exit]: cumulative log at the last row <= each end
    from .joins import asof

    c = index_returns.filter(F.col("ret").isNotNull()).withColumns(
        {"cum": F.sum(F.log1p("ret")).over(so_far(Window.partitionBy("entity").orderBy("date"))), "k": F.row_number().over(Window.partitionBy("entity").orderBy("date"))})
    ends = ep.filter("matured").select("entity", F.col("entry").alias("date")).unionByName(ep.filter("matured").select("entity", F.col("exit").alias("date"))).distinct()
    at = asof(ends, c.select("entity", "date", "cum", "k"), ["entity"], ["cum", "k"]).select("entity", "date", F.coalesce("cum", F.lit(0.0)).alias("cum"), F.coalesce("k", F.lit(0)).alias("k"))
    a = at.select("entity", F.col("date").alias("entry"), F.col("cum").alias("_c0"), F.col("k").alias("_k0"))
    b = at.select("entity", F.col("date").alias("exit"), F.col("cum").alias("_c1"), F.col("k").alias("_k1"))
    ep = ep.join(a, ["entity", "entry"], "left").join(b, ["entity", "exit"], "left")
    idx = F.when(F.col("_k1") > F.col("_k0"), F.expm1(F.col("_c1") - F.col("_c0")))
    d = sign_of(F.col("direction"))
    status = (
        F.when(F.col("ticker").isNull(), "no_expression").when(~F.col("matured"), "pending")
        .when(F.col("r_inst").isNull() | F.col("r_ew").isNull(), "no_price_history").otherwise("scored")
    )
    ep = ep.withColumns({"r_index": idx, "status": status})
    live = F.col("status") == "scored"
    gross = F.when(live, d * (F.col("r_inst") - F.col("r_ew")))
    return ep.select(
        "gap_id", "entity", "direction", "ticker", "opened", "horizon_days", "entry", "exit", "status",
        F.when(live, F.col("r_inst")).alias("r_inst"), F.when(live, F.col("r_ew")).alias("r_ew"), F.when(live, F.col("r_index")).alias("r_index"),
        gross.alias("gross_active"), F.when(live, d * (F.col("r_inst") - F.col("r_index"))).alias("capture"),
        F.when(live, d * (F.col("r_index") - F.col("r_ew"))).alias("information"), (gross - 2 * cost).alias("net_active"),
    )


# Dead band of a price response; share of the opening severity that counts as reverted.
NEUTRAL, REVERT = 0.005, 0.5


def signal_persistence(outcomes: DataFrame, detections: DataFrame) -> DataFrame:
    """confirmed / revised_away / unknown: detector severity nearest to exit against open."""
    outcomes = settle(outcomes)  # read three times below
    det = detections.groupBy("entity", "date").agg(F.max_by("severity", F.abs("severity")).alias("severity"))
    o = nearest(outcomes.select("gap_id", "entity", F.col("opened").alias("date")), det, ["entity"], "severity").select("gap_id", F.col("severity").alias("_z0"))
    e = nearest(outcomes.filter(F.col("exit").isNotNull()).select("gap_id", "entity", F.col("exit").alias("date")), det, ["entity"], "severity").select("gap_id", F.col("severity").alias("_z1"))
    j = outcomes.join(o, "gap_id", "left").join(e, "gap_id", "left")
    known = F.col("_z0").isNotNull() & F.col("_z1").isNotNull() & (F.abs("_z0") >= 1e-9)
    return j.withColumn("data_validity", F.when(~known, "unknown").when(F.abs("_z1") < REVERT * F.abs("_z0"), "revised_away").otherwise("confirmed")).drop("_z0", "_z1")


def classify(outcomes: DataFrame) -> DataFrame:
    """Six axes and the headline class of scored outcomes (needs absorbed_at, data_validity)."""
    g, n, i, c, ab = (F.col(x) for x in ("gross_active", "net_active", "information", "capture", "absorbed_at"))
    price = F.when(g > NEUTRAL, "with_thesis").when(g < -NEUTRAL, "against_thesis").otherwise("unresolved")
    timing = F.when(ab.isNull(), "no_absorption").when(ab <= F.col("entry"), "pre_absorbed").otherwise("tradable")
    expr = F.when(i.isNull() | c.isNull(), "unknown").when((i > NEUTRAL) & (c < -NEUTRAL), "basis_failure").otherwise("captured")
    econ = F.when(n > 0, "positive_net").otherwise("negative_net")
    fit = F.when(ab.isNull(), "unresolved").when(ab <= F.col("exit"), "on_time").otherwise("late")
    d = outcomes.withColumns({"price_response": price, "timing": timing, "expression": expr, "economics": econ, "horizon_fit": fit})
    head = (
        F.when(F.col("price_response") == "unresolved", "UNRESOLVED")
        .when((F.col("price_response") == "against_thesis") | (F.col("data_validity") == "revised_away"), "DATA_WRONG")
        .when(F.col("timing") == "pre_absorbed", "DATA_RIGHT_ALREADY_ABSORBED")
        .when(F.col("economics") == "negative_net", "DATA_RIGHT_NOT_CAPTURABLE")
        .otherwise("DATA_RIGHT_CAPTURED")
    )
    return d.withColumn("headline", head)


def mark_theses(theses: DataFrame, returns: DataFrame) -> DataFrame:
    """Signed compounded return since opening, and the mechanical close.

    theses (thesis_id, entity, direction, open_date, horizon_days, invalidation).  The long
    and the short return of each entity accumulate once; a thesis is the difference of two
    cumulative values, not a range join.
    """
    from .joins import asof

    w = so_far(Window.partitionBy("entity").orderBy("date"))
    r = returns.filter(F.col("ret").isNotNull())
    c = r.withColumns({"up": F.sum(F.log1p("ret")).over(w), "dn": F.sum(F.log1p(-F.col("ret"))).over(w), "k": F.row_number().over(Window.partitionBy("entity").orderBy("date"))})
    last = c.groupBy("entity").agg(F.max("date").alias("mark_date"), F.max_by("up", "date").alias("_u1"), F.max_by("dn", "date").alias("_d1"), F.max("k").alias("_k1"))
    t0 = asof(theses.withColumn("date", F.col("open_date")), c.select("entity", "date", "up", "dn", "k"), ["entity"], ["up", "dn", "k"])
    j = t0.join(last, "entity").filter(F.col("_k1") > F.coalesce("k", F.lit(0)))
    z = F.lit(0.0)
    cum = F.when(F.col("direction") == "long", F.expm1(F.col("_u1") - F.coalesce("up", z))).otherwise(F.expm1(F.col("_d1") - F.coalesce("dn", z)))
    j = j.withColumns({"cum_return": F.round(cum, 6), "days_open": F.datediff("mark_date", "open_date").cast("long")})
    status = (
        F.when(F.col("cum_return") <= F.col("invalidation"), "invalidated")
        .when(F.col("days_open") >= F.col("horizon_days"), F.when(F.col("cum_return") > 0, "hit").otherwise("miss")).otherwise("open")
    )
    return j.select("thesis_id", "entity", "direction", "mark_date", "cum_return", "days_open", status.alias("status"))


def forward_track(starts: DataFrame, returns: DataFrame, horizon: int) -> DataFrame:
    """Return of each (entity, start) over its first ``horizon`` rows after start, against the
    mean of all entities with a full window from the same start.

    A row is the first one after every start from the row before it on.  Rows without a start
    in that span drop out; equal spans are summed over entities before they are spread over
    their starts, so the comparison does not grow with entities x starts.
    """
    w = Window.partitionBy("entity").orderBy("date")
    marks = numbered(starts, "start")
    r = with_boundaries_passed(returns.filter(F.col("ret").isNotNull()), marks, out="_hi")
    r = r.withColumns({"_cum": F.sum(F.log1p("ret")).over(so_far(w)), "_lo": F.coalesce(F.lag("_hi").over(w), F.lit(0))})
    r = r.withColumn("_fwd", F.expm1(F.lead("_cum", horizon - 1).over(w) - (F.col("_cum") - F.log1p("ret"))))
    hit = r.filter("_hi > _lo").select("entity", "date", "_fwd", "_lo", "_hi")
    spans = hit.filter("_fwd IS NOT NULL").groupBy("_lo", "_hi").agg(F.sum("_fwd").alias("_s"), F.count("_fwd").alias("_n"))
    spread = spans.select("_s", "_n", F.explode(F.sequence(F.col("_lo") + 1, "_hi")).alias("_i"))
    xs = spread.groupBy("_i").agg((F.sum("_s") / F.sum("_n")).alias("xs_mean"), F.sum("_n").alias("n_entities"))
    # the row of a start: of those whose span ends at its number or later, the earliest
    wanted = starts.join(marks, "start").select("entity", "_i").distinct()
    payload = F.struct(F.col("date").alias("first_date"), F.col("_fwd").alias("cum_return"))
    u = hit.select("entity", F.col("_hi").alias("_at"), F.lit(0).alias("_side"), payload.alias("_p")).unionByName(
        wanted.select("entity", F.col("_i").alias("_at"), F.lit(1).alias("_side")), allowMissingColumns=True)
    later = Window.partitionBy("entity").orderBy(F.col("_at").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    own = u.withColumn("_p", F.last("_p", ignorenulls=True).over(later)).filter("_side = 1 AND _p.cum_return IS NOT NULL")
    own = own.select("entity", F.col("_at").alias("_i"), "_p.first_date", "_p.cum_return").join(xs, "_i").join(marks, "_i").drop("_i")
    return starts.join(own, ["entity", "start"]).withColumn("relative", F.col("cum_return") - F.col("xs_mean"))


def family_ranks(inputs: Sequence[tuple[str, DataFrame, bool]], minimum: int = 5) -> DataFrame:
    """Ranks of several configured signal families (name, panel, higher is better) in one
    tidy panel."""
    from .normalise import oriented_rank

    out = None
    for name, df, up in inputs:
        d = df.withColumn("variable", F.lit(name)).select("date", "entity", "variable", "value")
        r = oriented_rank(d, ("date", "variable"), "value", ("entity",), up, minimum)
        out = r if out is None else out.unionByName(r)
    return out.select("date", "entity", "variable", F.col("rank").cast("double").alias("value"))


def latest_gap_lists(episodes: DataFrame, marks: DataFrame, as_of: str, states: Sequence[str], n: int) -> DataFrame:
    """Open episodes whose latest mark is in one of ``states``, strongest first (top n)."""
    m = marks.filter(F.col("date") <= F.lit(as_of).cast("date")).groupBy("gap_id").agg(
        F.max_by(F.struct("state", "tension_now", "absorption_index"), "date").alias("_m"))
    return (
        episodes.filter("status = 'open'").join(m, "gap_id").select("gap_id", "entity", "direction", "_m.state", "_m.tension_now", "_m.absorption_index")
        .filter(F.col("state").isin(*states)).orderBy(F.col("tension_now").desc_nulls_last(), "gap_id").limit(n)
    )
