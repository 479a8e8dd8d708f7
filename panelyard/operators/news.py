"""Documents -> entity-day news aggregates -> smoothed composites."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import series
from ..session import settle
from .features import ewm_mean
from .normalise import rolling_z


def tone_fields(raw: Column) -> Column:
    """Comma-separated tone record -> struct; missing tail fields are NULL."""
    p = F.split(raw, ",")
    names = ("tone", "positive", "negative", "polarity", "activity_density", "self_density", "word_count")
    num = [F.try_element_at(p, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)]
    return F.struct(*num)


def location_codes(raw: Column) -> Column:
    """Codes of the well-formed items of a ;-separated location list (third #-field)."""
    items = F.filter(F.split(raw, ";"), lambda x: F.size(F.split(x, "#")) >= 8)
    return F.filter(F.transform(items, lambda x: F.trim(F.split(x, "#")[2])), lambda c: c != "")


def theme_names(raw: Column) -> Column:
    """Theme names of a ;-separated ``name,offset`` list."""
    return F.filter(F.transform(F.split(raw, ";"), lambda x: F.trim(F.split(x, ",")[0])), lambda t: t != "")


def normal_domain(value: Column) -> Column:
    """Lower-cased host of a URL or bare domain without user, port and www prefix."""
    v = F.lower(F.trim(value))
    host = F.regexp_extract(F.when(v.contains("://"), v).otherwise(F.concat(F.lit("http://"), v)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":.*$", "")
    return F.regexp_replace(F.regexp_replace(host, r"^\.+|\.+$", ""), r"^www\d*\.", "")


def domain_suffixes(host: Column) -> Column:
    """Candidate suffixes of a host, longest first, at least two labels."""
    p = F.split(host, r"\.")
    n = F.size(p)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(p, i, n - i + 1), ".")))


def domain_country(df: DataFrame, columns: Sequence[str], lookup: DataFrame, key: str = "doc_id", out: str = "source_code") -> DataFrame:
    """Country code of the longest listed suffix, earlier columns first; lookup (domain, code)."""
    cands = F.flatten(F.array(*[F.coalesce(domain_suffixes(normal_domain(F.col(c))), F.array().cast("array<string>")) for c in columns]))
    d = df.select(key, F.posexplode(cands).alias("_i", "domain"))
    hit = d.join(lookup, "domain").groupBy(key).agg(F.min_by("code", "_i").alias(out))
    return df.join(hit, key, "left")


def entity_day(docs: DataFrame, top_themes: int = 0, key: str = "doc_id") -> DataFrame:
    """Documents (key, date, mentions array, tone struct, source_code, themes array) -> one row
    per (date, code).

    Duplicate documents count once (the first by order key is kept); a document mentioning a
    code several times is one article with several mentions.  Sums and the counts behind the exact
    tone quantiles combine map-side: an entity-day costs one row per different tone.
    """
    d = docs.groupBy("date", key).agg(F.min(F.struct("mentions", "tone", "source_code", "themes")).alias("_d")).select("date", key, "_d.*")
    d = d.filter((F.size("mentions") > 0) & F.col("tone.tone").isNotNull() & F.col("tone.positive").isNotNull() & F.col("tone.negative").isNotNull() & F.col("tone.polarity").isNotNull())
    d = settle(d)
    a = d.select("date", key, F.explode("mentions").alias("code"), "tone", "source_code").groupBy("date", key, "code", "tone", "source_code").agg(F.count("*").alias("m"))
    t, w = F.col("tone.tone"), F.coalesce(F.col("tone.word_count"), F.lit(0.0))
    local = F.col("source_code") == F.col("code")
    foreign = F.col("source_code").isNotNull() & ~local

    def weighted(cond: Column) -> Column:
        num, den = F.sum(F.when(cond & (w > 0), t * w)), F.sum(F.when(cond & (w > 0), w))
        return F.when(den > 0, num / den).otherwise(F.avg(F.when(cond, t)))

    every = F.lit(True)
    g = a.groupBy("date", "code").agg(
        F.count("*").alias("n_articles"), F.sum("m").alias("mentions"), F.sum(w).alias("total_words"), F.avg(t).alias("tone_mean"), weighted(every).alias("tone_weighted"),
        F.avg("tone.positive").alias("positive_mean"), F.avg("tone.negative").alias("negative_mean"), F.avg("tone.polarity").alias("polarity_mean"),
        F.stddev_pop(t).alias("tone_dispersion"), weighted(local).alias("local_tone"), weighted(foreign).alias("foreign_tone"),
        F.percentile(t, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_tones"),
        F.count(F.when(local, 1)).alias("local_articles"), F.count(F.when(foreign, 1)).alias("foreign_articles"), F.count(F.when(F.col("source_code").isNull(), 1)).alias("unknown_articles"))
    src = d.filter(F.col("source_code").isNotNull()).groupBy("date", F.col("source_code").alias("code")).agg(F.count("*").alias("source_total"))
    g = g.join(src, ["date", "code"], "left").withColumns({
        **{name: F.get("_tones", F.lit(i)) for i, name in enumerate(("tone_p10", "tone_p50", "tone_p90"))},
        "source_total": F.coalesce("source_total", F.lit(0)),
        "resolution_rate": (F.col("local_articles") + F.col("foreign_articles")) / F.col("n_articles"),
    }).withColumn("attention_share", F.when(F.col("source_total") > 0, F.col("local_articles") / F.col("source_total")))
    g = g.drop("_tones")
    if top_themes:
        th = d.select("date", F.explode(F.array_distinct("mentions")).alias("code"), "themes").withColumn("theme", F.explode("themes"))
        g = g.join(theme_shares(th, top_themes), ["date", "code"], "left")
    return g


def theme_shares(df: DataFrame, k: int, by: Sequence[str] = ("date", "code"), theme: str = "theme") -> DataFrame:
    """Top-k themes of each group with their shares of all theme mentions, as JSON."""
    by = list(by)
    c = df.groupBy(*by, theme).agg(F.count("*").alias("count"))
    t = c.groupBy(*by).agg(F.sum("count").alias("total_themes"))
    w = Window.partitionBy(*by).orderBy(F.col("count").desc(), theme)
    top = c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).join(t, by)
    item = F.struct("_r", F.struct(F.col(theme).alias("theme"), "count", F.round(F.col("count") / F.col("total_themes"), 6).alias("share")).alias("v"))
    return top.groupBy(*by).agg(F.max("total_themes").alias("total_themes"), F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"])).alias("top_themes"))


def country_signals(df: DataFrame, window: int, minimum: int) -> DataFrame:
    """Sentiment, attention and risk from entity-days (entity, date, local_tone, tone_weighted,
    local_articles, attention_share, tone_dispersion, foreign_tone) with prior-window z's
    over observed days, and the gap to the day before."""
    s = F.coalesce("local_tone", "tone_weighted")
    d = df.withColumns({
        "sentiment_raw": s, "attention": F.log1p("local_articles"), "sentiment_x_attention": s * F.col("attention_share"), "risk_raw": -s + 0.5 * F.col("tone_dispersion")})
    for c, z in (("attention", "attention_shock"), ("local_tone", "local_tone_z"), ("foreign_tone", "foreign_tone_z"), ("tone_dispersion", "dispersion_z"), ("attention_share", "attention_share_z"),
                 ("sentiment_raw", "sentiment"), ("sentiment_x_attention", "sentiment_x_attention_z"), ("risk_raw", "risk")):
        d = rolling_z(d, window, minimum, ("entity",), c, ddof=0, prior=True, out=z)
    return d.withColumn("days_since_prior", F.datediff("date", F.lag("date").over(series(["entity"]))))


BLOCKS = {
    "sentiment_fast": ("sentiment_raw", "fast"), "sentiment_slow": ("sentiment_raw", "slow"), "attention_fast": ("attention_share", "fast"), "attention_slow": ("attention_share", "slow"),
    "risk_fast": ("risk_raw", "risk"), "dispersion_fast": ("tone_dispersion", "risk"), "local_tone_fast": ("local_tone", "fast"), "foreign_tone_fast": ("foreign_tone", "fast"),
}
# Composite weights.
METRONOME = {"sentiment_fast": 0.35, "sentiment_slow": 0.20, "sentiment_trend": 0.20, "attention_fast": 0.15, "risk_fast": -0.10}
RISK = {"risk_fast": 0.45, "dispersion_fast": 0.30, "sentiment_fast": -0.15, "foreign_tone_fast": -0.10}


def metronome(df: DataFrame, fast: int, slow: int, risk: int, window: int, minimum: int, monthly: bool = False) -> DataFrame:
    """Exponentially smoothed blocks, their prior-window z's and the fixed-weight composites;
    ``monthly`` keeps each month's last day before the z's."""
    span = {"fast": fast, "slow": slow, "risk": risk}
    need = sorted({c for c, _ in BLOCKS.values()})
    d = ewm_mean(df.select("entity", "date", *need), {o: (c, span[s]) for o, (c, s) in BLOCKS.items()}, ("entity",))
    d = d.withColumns({
        "sentiment_trend": F.col("sentiment_fast") - F.col("sentiment_slow"), "attention_trend": F.col("attention_fast") - F.col("attention_slow"),
        "local_foreign_gap": F.col("local_tone_fast") - F.col("foreign_tone_fast")})
    if monthly:
        w = Window.partitionBy("entity", F.trunc("date", "month")).orderBy(F.col("date").desc())
        d = d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    names = [*BLOCKS, "sentiment_trend", "attention_trend", "local_foreign_gap"]
    for c in names:
        d = rolling_z(d, window, minimum, ("entity",), c, ddof=0, prior=True, out=f"{c}_z")
    mix = lambda weights: sum(F.lit(v) * F.col(f"{c}_z") for c, v in weights.items())
    return d.withColumns({"metronome": mix(METRONOME), "risk_composite": mix(RISK)}).withColumn("defensive", -F.col("risk_composite")).select("entity", "date", *names, "metronome", "risk_composite", "defensive")
