"""Open step funnels over an event table.

Semantics: a funnel is an ordered list of step names; each step counts the
distinct entities that emitted it, independently of the other steps (no
per-entity ordering, no time window). Event names outside the list drop out.

Plan shape: every operator first reduces events to distinct
(group, step, entity) or per-(group, entity) flags with a hash aggregate
(map-side partial aggregation absorbs hot entities), then works on at most
#groups × #steps rows. The step list is a literal frame whose size is the
number of steps, so broadcasting it is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from growthlens.functions.exprs import in_values, pct
from growthlens.sources.views import ENTITY, FUNNEL_STEPS


def step_frame(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    """(step, event_name) literal frame, step numbered from 1."""
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("event_name"))
                     for i, s in enumerate(steps)])
    return events.sparkSession.range(1).select(F.inline(rows))


def step_entity_counts(events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS,
                       entity: Sequence[str] = ENTITY, by: Sequence[str] = ()) -> DataFrame:
    """(by..., step, event_name, users): distinct entities per step (and group)."""
    by, entity = list(by), list(entity)
    ev = events.where(F.col("event_name").isin(list(steps)))
    counts = (ev.select(*by, "event_name", *entity).distinct()
                .groupBy(*by, "event_name").agg(F.count(F.lit(1)).alias("users")))
    return counts.join(F.broadcast(step_frame(events, steps)), "event_name", "inner")


def funnel_steps(events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS,
                 entity: Sequence[str] = ENTITY, by: Sequence[str] = ()) -> DataFrame:
    """Per step: users, previous present step's users, step conversion %.

    The LAG runs over the aggregated #groups × #steps rows only.
    """
    by = list(by)
    counts = step_entity_counts(events, steps, entity, by)
    w = Window.partitionBy(*by).orderBy("step") if by else Window.orderBy("step")
    prev = F.lag("users").over(w)
    out = counts.select(
        *by, "step", "event_name", "users",
        prev.alias("prev_step_users"),
        pct(F.col("users"), prev, 2).alias("step_conv_pct"),
    )
    return out.orderBy(*by, "step").drop("step")


def _end_flags(events: DataFrame, first: str, last: str, entity: Sequence[str],
               by: Sequence[str]) -> DataFrame:
    """One row per (group, entity) with flags for the first and last steps."""
    by, entity = list(by), list(entity)
    return events.groupBy(*by, *entity).agg(
        F.max((F.col("event_name") == first).cast("int")).alias("has_first"),
        F.max((F.col("event_name") == last).cast("int")).alias("has_last"),
    )


def funnel_ends(events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS,
                entity: Sequence[str] = ENTITY, by: Sequence[str] = ()) -> DataFrame:
    """(by..., opened, ordered, open_to_order_pct): distinct entities with the
    first step and with the last step, each counted on its own."""
    by = list(by)
    # Without groups only entities with the first or last step matter, so the
    # two steps can be selected up front (pushed to the scan). With groups every
    # group seen in the events keeps its row, so all events are read.
    ev = events if by else events.where(F.col("event_name").isin(steps[0], steps[-1]))
    flags = _end_flags(ev, steps[0], steps[-1], entity, by)
    agg = flags.groupBy(*by).agg(
        F.coalesce(F.sum("has_first"), F.lit(0)).cast("long").alias("opened"),
        F.coalesce(F.sum("has_last"), F.lit(0)).cast("long").alias("ordered"),
    )
    out = agg.select(*by, "opened", "ordered",
                     pct(F.col("ordered"), F.col("opened"), 2).alias("open_to_order_pct"))
    return out.orderBy(F.desc("open_to_order_pct"), *by) if by else out


def funnel_overall(events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS,
                   entity: Sequence[str] = ENTITY) -> DataFrame:
    """One row: opened, ordered, open_to_order_pct over the whole event table."""
    return funnel_ends(events, steps, entity, by=())


def funnel_zero_filled(events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS,
                       entity: Sequence[str] = ENTITY,
                       platforms: Sequence[str] | None = None) -> DataFrame:
    """Every step (0 when absent) under a platform filter, the % of the prior
    step lost, and the step with the biggest loss (first step excluded, ties
    go to the earlier step).

    Loss follows pandas ``pct_change``: prior 0 and now > 0 is an infinite gain
    (loss -inf, never the biggest); 0 → 0 counts as no change.
    """
    ev = events.where(in_values("platform", platforms))
    counts = (ev.where(F.col("event_name").isin(list(steps)))
                .select("event_name", *entity).distinct()
                .groupBy("event_name").agg(F.count(F.lit(1)).alias("n")))
    full = (F.broadcast(step_frame(events, steps))
            .join(counts, "event_name", "left")
            .select("step", "event_name", F.coalesce("n", F.lit(0)).cast("long").alias("users")))
    w = Window.orderBy("step")  # #steps rows
    prev = F.lag("users").over(w)
    change = (F.when(prev.isNull(), F.lit(0.0))
               .when((prev == 0) & (F.col("users") == 0), F.lit(0.0))
               .when(prev == 0, F.lit(float("inf")))
               .otherwise(F.col("users") / prev - F.lit(1.0)))
    with_drop = full.withColumn("drop_raw", change * F.lit(-100.0))
    rank_w = Window.orderBy((F.col("step") == 1).cast("int"), F.desc("drop_raw"), "step")
    return with_drop.select(
        "step", "event_name", "users",
        F.round("drop_raw", 2).alias("drop_pct"),
        ((F.row_number().over(rank_w) == 1) & (F.col("step") > 1)).alias("is_biggest_drop"),
    ).orderBy("step")


def step_pair_baseline(events: DataFrame, from_step: str = FUNNEL_STEPS[-2], to_step: str = FUNNEL_STEPS[-1],
                       entity: Sequence[str] = ENTITY, by: Sequence[str] = ()) -> DataFrame:
    """Distinct entities at two chosen steps and their ratio in % (one row,
    or one row per group of ``by``)."""
    by = list(by)
    counts = step_entity_counts(events, [from_step, to_step], entity, by)
    grouped = counts.groupBy(*by) if by else counts
    row = grouped.agg(
        F.max(F.when(F.col("event_name") == from_step, F.col("users"))).alias("from_step_users"),
        F.max(F.when(F.col("event_name") == to_step, F.col("users"))).alias("to_step_users"),
    )
    out = row.select(*by, "from_step_users", "to_step_users",
                     pct(F.col("to_step_users"), F.col("from_step_users"), 2)
                     .alias("baseline_conversion_pct"))
    return out.orderBy(*by) if by else out


def conversion_contingency(events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS,
                           entity: Sequence[str] = ENTITY,
                           by: Sequence[str] = ("platform",), ordered: bool = True) -> DataFrame:
    """(by..., converted, not_converted) among entities that opened in the group:
    converted = reached the last step too. Both columns are non-negative even
    when the funnel is not a prefix sequence."""
    by = list(by)
    flags = _end_flags(events.where(F.col("event_name").isin(steps[0], steps[-1])),
                       steps[0], steps[-1], entity, by).where(F.col("has_first") == 1)
    out = flags.groupBy(*by).agg(
        F.sum("has_last").cast("long").alias("converted"),
        F.sum(F.lit(1) - F.col("has_last")).cast("long").alias("not_converted"),
    )
    return out.orderBy(*by) if ordered and by else out


def ab_arms(events: DataFrame, from_step: str = FUNNEL_STEPS[-2], to_step: str = FUNNEL_STEPS[-1],
            entity: Sequence[str] = ENTITY) -> DataFrame:
    """Deterministic 50/50 split of the entities that reached ``from_step``
    (md5 of the entity key, first 32 bits, mod 2), with the observed
    conversion to ``to_step`` per arm: arm, users, converted, conversion_pct."""
    entity = list(entity)
    flags = _end_flags(events.where(F.col("event_name").isin(from_step, to_step)),
                       from_step, to_step, entity, by=()).where(F.col("has_first") == 1)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in entity])
    bucket = F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(2))
    arm = F.when(bucket == 0, "control").otherwise("treatment")
    per_arm = flags.groupBy(arm.alias("arm")).agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("has_last").cast("long").alias("converted"),
    )
    return per_arm.select("arm", "users", "converted",
                          pct(F.col("converted"), F.col("users"), 2).alias("conversion_pct")
                          ).orderBy("arm")


__all__ = [
    "step_frame", "step_entity_counts", "funnel_steps", "funnel_ends", "funnel_overall",
    "funnel_zero_filled", "step_pair_baseline", "conversion_contingency", "ab_arms",
]
