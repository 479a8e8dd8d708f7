"""Append-only event ledgers (JSON lines) and their fold to the latest state."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a fixed schema; a corrupt line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def check_events(df: DataFrame, known: Sequence[str], event: str = "event") -> DataFrame:
    """Unknown event types raise instead of being dropped."""
    return df.withColumn(
        event,
        F.when(F.col(event).isin(*known), F.col(event)).otherwise(
            F.raise_error(F.concat(F.lit("unknown event type "), F.coalesce(event, F.lit("NULL"))))
        ),
    )


def fold(
    events: DataFrame,
    key: str,
    opening: str,
    state: Sequence[str],
    updates: dict[str, Sequence[str]],
    order: str = "seq",
    event: str = "event",
    lists: dict[str, tuple[str, Sequence[str]]] | None = None,
) -> DataFrame:
    """Latest state per id.

    ``opening`` events set the ``state`` columns; each later event type overwrites the
    columns named in ``updates``; ``lists`` collects events of a type in order as an array of
    structs ({column: (event type, fields)}).  Events of ids never opened, or before the last
    opening, are ignored.  Each ledger id holds a handful of events.
    """
    start = events.filter(F.col(event) == opening).groupBy(key).agg(F.max(order).alias("_start"))
    d = events.join(start, key).filter(F.col(order) >= F.col("_start"))

    def latest(column: str) -> Column:
        sets = [opening] if column in state else []
        sets += [e for e, cols in updates.items() if column in cols]
        return F.max_by(F.col(column), F.when(F.col(event).isin(*sets), F.col(order)))

    columns = list(dict.fromkeys([*state, *[c for cols in updates.values() for c in cols]]))
    aggs = [latest(c).alias(c) for c in columns]
    for name, (ev, fields) in (lists or {}).items():
        entries = F.collect_list(F.when(F.col(event) == ev, F.struct(order, *fields)))
        aggs.append(F.array_sort(entries).alias(name))
    return d.groupBy(key).agg(F.count("*").alias("n_events"), *aggs)


def trial_charge(verdict: Column) -> Column:
    """1 for a tested hypothesis, half for insufficient data, 0 while untested."""
    return F.when(verdict.isNull(), 0.0).when(verdict.startswith("INSUFFICIENT"), 0.5).otherwise(1.0)


def family_trials(hypotheses: DataFrame, family: str = "family", verdict: str = "verdict") -> DataFrame:
    """Trials charged to each family, at least one."""
    return hypotheses.groupBy(family).agg(
        F.greatest(F.lit(1), F.rint(F.sum(trial_charge(F.col(verdict)))).cast("int")).cast("long").alias("n_trials"),
        F.count("*").alias("n_hypotheses"),
    )


# Statuses that end a hypothesis, and closes that count as void.
TERMINAL = ("retired", "rejected")
VOID = ("killed_review", "void")


def effective_view(folded: DataFrame, status: str = "status", verdict: str = "verdict", defaults: dict[str, str] | None = None) -> DataFrame:
    """Folded hypotheses as readers should see them: missing stamps get their defaults, and the
    verdict of a hypothesis that has ended is withheld from ``effective_verdict``."""
    d = folded.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (defaults or {}).items()})
    return d.withColumn("effective_verdict", F.when(~F.coalesce(F.col(status).isin(*TERMINAL), F.lit(False)), F.col(verdict)))


def outcome_label(status: Column) -> Column:
    """Label of a closed thesis: reviews that kill it and void closes are void."""
    return F.when(status.isin(*VOID), "void").otherwise(status)


def ledger_marks(folded: DataFrame, key: str, marks: str = "marks") -> DataFrame:
    """The marks of every thesis as rows, in the order of their events."""
    return folded.select(key, F.posexplode(marks).alias("position", "_m")).select(key, "position", "_m.*")
