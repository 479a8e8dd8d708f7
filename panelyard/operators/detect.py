"""Dislocation detectors and their day-to-day state.

Every detector returns (detector, archetype, entity, direction, severity, components); the
components are a map of named numbers and become JSON only at a sink.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import guarded, last_rows, ratio, series
from .aggregates import dispersion, mean_pair_correlation
from .features import last_z, real_changes, trailing_return

# Trailing window of a detector z and its minimum history.
Z_WINDOW, Z_MINIMUM = 756, 252


def components(**values: Column) -> Column:
    """Named numbers of a row, NULLs left out."""
    pairs = [F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def rows(df: DataFrame, detector: str, archetype: str, direction: Column, severity: Column, comp: Column, entity: str = "entity") -> DataFrame:
    return df.select(
        F.lit(detector).alias("detector"), F.lit(archetype).alias("archetype"), F.col(entity).alias("entity"),
        direction.alias("direction"), F.round(severity, 2).alias("severity"), comp.alias("components"),
    )


def signed(z: Column) -> Column:
    return F.when(z > 0, "long").otherwise("short")


def z_of(df: DataFrame, value: str, name: str, window: int = Z_WINDOW, minimum: int = Z_MINIMUM, by: Sequence[str] = ("entity",)) -> DataFrame:
    """(entity, name, name_last, name_date): z of the last value of each series."""
    d = df.select(*by, "date", F.col(value).alias("value"))
    return last_z(d, window, minimum, by).select(
        *by, F.col("z").alias(name), F.col("last_value").alias(f"{name}_last"), F.col("date").alias(f"{name}_date")
    )


def change_z(df: DataFrame, n: int, name: str, kind: str = "difference", sign: float = 1.0, window: int = Z_WINDOW, minimum: int = Z_MINIMUM) -> DataFrame:
    """z of the n-observation change of each entity's real (not carried) levels."""
    d = real_changes(df, ["entity"])
    p = F.lag("value", n).over(series(["entity"]))
    c = F.col("value") - p if kind == "difference" else ratio(F.col("value"), p) - 1
    return z_of(d.withColumn("_c", sign * c), "_c", name, window, minimum)


def staleness(df: DataFrame, as_of: str, max_age: int, universe: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Age of each entity's last real observation; entities never seen are stale too."""
    last = real_changes(df, ["entity"]).groupBy("entity").agg(F.max("date").alias("last_real"))
    u = universe.select("entity").distinct()
    if skip:
        u = u.filter(~F.col("entity").isin(*skip))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_real"))
    return u.join(last, "entity", "left").withColumns(
        {"age": age.cast("long"), "stale": F.coalesce(age > max_age, F.lit(True))}
    )


def degraded(stale: DataFrame, detector: str, surface: str) -> DataFrame:
    """One loud row naming how many inputs are stale; none if all are fresh."""
    n = stale.filter("stale").agg(F.count("*").alias("n"), F.max("age").alias("worst")).filter("n > 0")
    return n.select(
        F.lit(detector).alias("detector"), F.lit("degraded").alias("archetype"),
        F.lit(f"{detector}_INPUTS:{surface}").alias("entity"), F.lit("flag").alias("direction"), F.lit(0.0).alias("severity"),
        components(n_affected=F.col("n"), worst_age=F.col("worst")).alias("components"),
    )


def tot_impulse(shares: DataFrame, commodity: DataFrame) -> DataFrame:
    """Terms-of-trade series: net shares (entity, category, net_share) x returns
    (date, category, ret).  A missing return counts as 0."""
    dates = commodity.select("date").distinct()
    b = shares.filter(F.col("net_share").isNotNull()).join(commodity.filter(F.col("ret").isNotNull()), "category").groupBy(
        "entity", "date"
    ).agg(F.sum(F.col("net_share") * F.col("ret")).alias("value"))
    return b.join(dates, "date", "left_semi")


def d1_terms_of_trade(
    shares: DataFrame, commodity: DataFrame, own_returns: DataFrame, reer: DataFrame,
    tot_min: float = 1.5, own_max: float = 0.5, reer_max: float = 0.5, window: int = 36, minimum: int = 24,
    own_window: int = Z_WINDOW, own_minimum: int = Z_MINIMUM,
) -> DataFrame:
    """Impulse extreme while own return and real exchange rate stay quiet."""
    t = z_of(tot_impulse(shares, commodity), "value", "tot", window, minimum)
    o = z_of(own_returns, "value", "own", own_window, own_minimum)
    r = change_z(reer, 3, "reer", window=window, minimum=minimum)
    j = t.join(o, "entity").join(r, "entity", "left").filter(
        (F.abs("tot") >= tot_min) & (F.abs("own") < own_max) & (F.coalesce(F.abs("reer"), F.lit(0.0)) < reer_max)
    )
    return rows(j, "D1", "A1", signed(F.col("tot")), F.col("tot"), components(
        tot_impulse=F.col("tot_last"), tot_z=F.col("tot"), own_z=F.col("own"), reer_z=F.col("reer")))


def d2_graph_propagation(
    one_hop: DataFrame, two_hop: DataFrame, own_returns: DataFrame, extreme: float = 1.5, quiet: float = 0.5,
    window: int = Z_WINDOW, minimum: int = Z_MINIMUM,
) -> DataFrame:
    """Neighbours moved and the entity did not (one hop), or a quiet entity at two hops."""
    o = z_of(own_returns, "value", "own", window, minimum)
    g = z_of(one_hop, "value", "gap", window, minimum)
    h = z_of(two_hop, "value", "two", window, minimum)
    a = g.filter(F.abs("gap") >= extreme).join(o, "entity", "left")
    b = h.filter(F.abs("two") >= extreme).join(o, "entity").filter(F.abs("own") < quiet).join(g.select("entity"), "entity", "left_semi")
    return rows(a, "D2", "A2", signed(F.col("gap")), F.col("gap"), components(gap=F.col("gap_last"), gap_z=F.col("gap"), own_z=F.col("own"))).unionByName(
        rows(b, "D2", "A2", signed(F.col("two")), F.col("two"), components(twohop_gap=F.col("two_last"), twohop_z=F.col("two"), own_z=F.col("own")))
    )


def d3_revision_momentum(
    revisions: DataFrame, momentum: DataFrame, minimum_vintages: int = 10, extreme: float = 1.0, follow: float = 0.5,
    window: int = Z_WINDOW, minimum: int = Z_MINIMUM,
) -> DataFrame:
    """Latest forecast revision (vintage, entity, revision; averaged over target years) extreme
    against the entity's earlier ones while momentum has not followed."""
    avg = revisions.filter(F.col("revision").isNotNull()).groupBy("vintage", "entity").agg(F.avg("revision").alias("r"))
    top = revisions.agg(F.max("vintage").alias("_v"))
    d = avg.join(top).withColumn("_cur", F.col("vintage") == F.col("_v"))
    past = F.when(~F.col("_cur"), F.col("r"))
    s = d.groupBy("entity").agg(
        F.max(F.when(F.col("_cur"), F.col("r"))).alias("cur"), F.avg(past).alias("_m"), F.stddev_samp(past).alias("_s"), F.count("*").alias("_n")
    ).filter((F.col("_n") >= minimum_vintages) & F.col("cur").isNotNull() & (F.col("_s") > 0))
    s = s.withColumn("rev", (F.col("cur") - F.col("_m")) / F.col("_s"))
    j = s.join(z_of(momentum, "value", "mom", window, minimum), "entity")
    up = (F.col("rev") >= extreme) & (F.col("mom") < follow)
    down = (F.col("rev") <= -extreme) & (F.col("mom") > -follow)
    return rows(j.filter(up | down), "D3", "A3", F.when(up, "long").otherwise("short"), F.col("rev"), components(
        revision=F.col("cur"), revision_z=F.col("rev"), momentum_z=F.col("mom")))


def d4_cross_asset(equity_z: DataFrame, fx_z: DataFrame, yield_z: DataFrame, credit_z: DataFrame) -> DataFrame:
    """Equity against currency, yield and credit (each (entity, name) of z's): the strongest
    conflicting surface gives the severity."""
    j = equity_z.select("entity", "eq").join(fx_z.select("entity", "fx"), "entity", "left").join(
        yield_z.select("entity", "y"), "entity", "left").join(credit_z.select("entity", "cds"), "entity", "left")
    e, fx, y, c = (F.col(x) for x in ("eq", "fx", "y", "cds"))

    def conflict(cond: Column, kind: str, z: Column) -> Column:
        return F.when(cond, F.struct(F.abs(z).alias("a"), F.lit(kind).alias("kind")))

    found = F.array_compact(F.array(
        conflict((e >= 1) & (fx <= -1), "fx_weak_vs_equity_strong", fx),
        conflict((e <= -1) & (fx >= 1), "fx_strong_vs_equity_weak", fx),
        conflict((e >= 1) & (y >= 1.5), "yields_spiking_vs_equity_strong", y),
        conflict((e >= 1) & (c >= 1.5), "credit_widening_vs_equity_strong", c),
        conflict((e <= -1) & (c <= -1.5), "credit_tightening_vs_equity_weak", c),
    ))
    d = j.withColumn("_f", found).filter(F.size("_f") > 0).withColumn("_top", F.array_max("_f"))
    sev = F.least(F.abs(e), F.col("_top.a")) * F.signum(e)
    return rows(d, "D4", "A4", F.lit("flag"), sev, components(equity_z=e, fx_z=fx, yield_z=y, credit_z=c)).join(
        d.select("entity", F.col("_top.kind").alias("conflict")), "entity"
    )


def d5_attention(attention: DataFrame, tone: DataFrame, own_returns: DataFrame, as_of: str, max_age: int = 7, spike: float = 2.0, quiet: float = 0.5,
                 window: int = Z_WINDOW, minimum: int = Z_MINIMUM) -> DataFrame:
    """Attention spiked recently and the price did not resolve it."""
    last = lambda d, n: d.filter(F.col("value").isNotNull()).groupBy("entity").agg(F.max_by("value", "date").alias(n), F.max("date").alias(f"{n}_date"))
    a = last(attention, "att").filter((F.datediff(F.lit(as_of).cast("date"), "att_date") <= max_age) & (F.col("att") >= spike))
    j = a.join(z_of(own_returns, "value", "own", window, minimum), "entity").filter(F.abs("own") <= quiet).join(last(tone, "tone"), "entity", "left")
    return rows(j, "D5", "A5", F.lit("flag"), F.col("att"), components(attention_z=F.col("att"), own_z=F.col("own"), tone_z=F.col("tone")))


def d7_crowding(characteristics: DataFrame, factor_returns: DataFrame, compressed: float = -1.5, top: int = 10, herding: float = 1.5, span: int = 63,
                window: int = Z_WINDOW, minimum: int = Z_MINIMUM) -> DataFrame:
    """The most compressed factor dispersions, and one row if factor returns herd."""
    d = dispersion(characteristics).withColumnsRenamed({"variable": "entity", "dispersion": "value"})
    z = z_of(d, "value", "disp", window, minimum).filter(F.col("disp") <= compressed).orderBy("disp", "entity").limit(top)
    a = rows(z, "D7", "A7", F.lit("flag"), F.col("disp"), components(dispersion=F.col("disp_last"), dispersion_z=F.col("disp")))
    h = mean_pair_correlation(factor_returns, span).select(F.lit("FACTOR_HERDING").alias("entity"), "date", F.col("mean_corr").alias("value"))
    hz = z_of(h, "value", "herd", window, minimum).filter(F.col("herd") >= herding)
    return a.unionByName(rows(hz, "D7", "A7", F.lit("flag"), F.col("herd"), components(mean_corr=F.col("herd_last"), corr_z=F.col("herd"))))


def d8_stewardship(theses: DataFrame, holdings: DataFrame, own_returns: DataFrame, window: int = Z_WINDOW, minimum: int = Z_MINIMUM) -> DataFrame:
    """Open theses, and the holdings of the latest snapshot with their entity's move."""
    t = rows(theses.filter("status = 'open'"), "D8", "stewardship", F.lit("flag"), F.lit(0.0), components(
        cum_return=F.col("cum_return"), days_open=F.col("days_open"), horizon_days=F.col("horizon_days"), invalidation=F.col("invalidation")))
    last = holdings.agg(F.max("date").alias("date"))
    h = holdings.join(last, "date").join(z_of(own_returns, "value", "own", window, minimum), "entity", "left")
    return t.unionByName(rows(h, "D8", "stewardship", F.lit("flag"), F.lit(0.0), components(weight=F.col("weight"), own_z=F.col("own"))))


def basis_series(a: DataFrame, b: DataFrame, n: int = 5) -> DataFrame:
    """n-row compounded return difference of two return series over their common dates."""
    j = a.select("entity", "date", F.col("ret").alias("_a")).join(b.select("entity", "date", F.col("ret").alias("_b")), ["entity", "date"])
    f = last_rows(series(["entity"]), n)
    c = lambda x: guarded(F.expm1(F.sum(F.log1p(x)).over(f)), x, f, n)
    return j.withColumns({"first": c("_a"), "second": c("_b")}).withColumn("value", F.col("first") - F.col("second")).drop("_a", "_b")


def d9_basis(a: DataFrame, b: DataFrame, as_of: str, max_age: int, n: int = 5, minimum: int = 100, extreme: float = 2.0) -> DataFrame:
    """Two expressions of one entity drifted apart, against the full common history."""
    g = basis_series(a, b, n)
    ok = g.groupBy("entity").agg(F.count("*").alias("_c"), F.max("date").alias("_last")).filter(
        (F.col("_c") >= minimum) & (F.datediff(F.lit(as_of).cast("date"), "_last") <= max_age))
    v = g.filter(F.col("value").isNotNull()).join(ok.select("entity"), "entity", "left_semi")
    s = v.groupBy("entity").agg(
        F.max_by("value", "date").alias("gap"), F.max_by("first", "date").alias("a"), F.max_by("second", "date").alias("b"),
        F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.count("*").alias("n"))
    z = s.withColumn("z", F.when(F.col("_s") > 0, (F.col("gap") - F.col("_m")) / F.col("_s"))).filter(F.abs("z") >= extreme)
    return rows(z, "D9", "basis", F.lit("flag"), F.col("z"), components(first=F.col("a"), second=F.col("b"), gap=F.col("gap"), gap_z=F.col("z"), n_obs=F.col("n")))


def d10_options(rr: DataFrame, iv: DataFrame, ret5: DataFrame, ret21: DataFrame, rr_min: float = 2.0, iv_min: float = 2.5, quiet: float = 0.75, stress: float = -1.5, option_quiet: float = 0.5,
                window: int = Z_WINDOW, minimum: int = Z_MINIMUM) -> DataFrame:
    """Options stressed and equity quiet, or equity stressed and options quiet."""
    last = lambda d, n: d.filter(F.col("value").isNotNull()).groupBy("entity").agg(F.max_by("value", "date").alias(n))
    j = last(rr, "rr").join(last(iv, "iv"), "entity", "left").join(z_of(ret5, "value", "e5", window, minimum), "entity", "left").join(
        z_of(ret21, "value", "e21", window, minimum), "entity", "left")
    first = ((F.col("rr") >= rr_min) | F.coalesce(F.col("iv") >= iv_min, F.lit(False))) & (F.abs("e21") <= quiet)
    second = (F.col("e5") <= stress) & (F.col("rr") <= option_quiet) & (F.col("iv") <= option_quiet)
    d = j.withColumn("conflict", F.when(first, "options_stress_unpriced").when(second, "equity_stress_unconfirmed")).filter(F.col("conflict").isNotNull())
    sev = F.when(F.col("conflict") == "options_stress_unpriced", F.greatest("rr", "iv")).otherwise(F.col("e5"))
    return rows(d, "D10", "A10", F.lit("flag"), sev, components(rr_z=F.col("rr"), iv_z=F.col("iv"), equity_5_z=F.col("e5"), equity_21_z=F.col("e21")))


def merge_state(today: DataFrame, previous: DataFrame, as_of: str, moves: DataFrame | None = None, carry_exempt: Sequence[str] = ("D8",)) -> DataFrame:
    """Today's detections against the previous active rows: status, age and stable id.

    A row missing today is resolved; its note follows from the entity's 5-row move
    (``moves``: entity, move) and the row's direction.  ``today`` has one row per
    (detector, entity); the strongest wins.
    """
    at = F.lit(as_of).cast("date")
    key = ["detector", "entity"]
    w = Window.partitionBy(*key).orderBy(F.abs("severity").desc(), "direction")
    t = today.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*key, "direction", "severity", F.lit(True).alias("_today"))
    p = previous.filter("status <> 'resolved'").select(
        *key, F.col("direction").alias("_pd"), F.col("severity").alias("_ps"), "first_seen", "days_active", "dislocation_id", F.lit(True).alias("_prev"))
    j = t.join(p, key, "full")
    if moves is not None:
        j = j.join(moves.select("entity", "move"), "entity", "left")
    else:
        j = j.withColumn("move", F.lit(None).cast("double"))
    now, was = F.coalesce("_today", F.lit(False)), F.coalesce("_prev", F.lit(False))
    j = j.filter(now | ~F.col("detector").isin(*carry_exempt))
    ps, ns = F.abs("_ps"), F.abs("severity")
    status = (
        F.when(now & ~was, "new").when(~now, "resolved")
        .when((ps > 0) & (ns >= 1.2 * ps), "intensifying").when((ps > 0) & (ns <= 0.8 * ps), "fading").otherwise("persisting")
    )
    first = F.when(was, F.col("first_seen")).otherwise(at)
    did = F.when(was, F.col("dislocation_id")).otherwise(F.substring(F.sha1(F.concat_ws("|", "detector", "entity", at.cast("string"))), 1, 12))
    side = F.col("_pd").isin("long", "short") & F.col("move").isNotNull()
    note = F.when(
        ~now,
        F.when(side & (F.abs("move") < 0.01), "decayed")
        .when(side & ((F.col("move") > 0) == (F.col("_pd") == "long")), "repriced_with")
        .when(side, "repriced_against").otherwise("condition_cleared"),
    )
    return j.select(
        at.alias("date"), did.alias("dislocation_id"), *key, F.coalesce("direction", "_pd").alias("direction"),
        F.when(now, F.col("severity")).otherwise(0.0).alias("severity"), status.alias("status"), first.alias("first_seen"),
        F.when(~now, F.col("days_active")).when(was, F.col("days_active") + 1).otherwise(1).cast("long").alias("days_active"),
        note.alias("resolution_note"),
    )


FIRING = ("new", "intensifying")


def triggers(detections: DataFrame, events: DataFrame, days: int = 2, firing: Sequence[str] = FIRING, exclude: Sequence[str] = ("D8",)) -> DataFrame:
    """What calls for evidence on an entity at each run date, one row per trigger.

    Triggers are the detections of the date (entity, date, detector, status, severity) with a
    firing status, but for the excluded detectors, and the events (entity, event_date, name)
    within ``days`` days of it.  Run dates are the dates of the detections.  Rows are numbered
    within entity and run date, detections first by severity.
    """
    runs = detections.select("date").distinct()
    det = detections.filter(F.col("status").isin(*firing) & ~F.col("detector").isin(*exclude)).select(
        "entity", "date", F.lit("detector").alias("kind"), F.col("detector").alias("name"), "severity")
    near = events.withColumn("_d", F.explode(F.sequence(F.lit(-days), F.lit(days)))).select(
        "entity", F.date_add("event_date", F.col("_d")).alias("date"), F.lit("event").alias("kind"), "name", F.lit(None).cast("double").alias("severity"))
    w = Window.partitionBy("entity", "date").orderBy("kind", F.abs("severity").desc_nulls_last(), "name")
    return det.unionByName(near.join(runs, "date", "left_semi")).withColumn("position", F.row_number().over(w).cast("long"))
