"""Savings advice from peak, season and cluster facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.functions.numeric import percent_of
from meterlight.operators.eda import peak_facts
from meterlight.schema import TARGET, TOU_EFFECT_PERCENT

# Thresholds above which an advice applies, in percent.
WEEKEND_GAP = 3
PEER_GAP = 15


def tariff_gap(df: DataFrame) -> DataFrame:
    """Mean energy per tariff type and how far time-of-use lies below standard, in percent."""
    standard = F.avg(F.when(F.col("tariff") == "Std", F.col(TARGET)))
    time_of_use = F.avg(F.when(F.col("tariff") == "ToU", F.col(TARGET)))
    return df.agg(
        standard.alias("std_mean"),
        time_of_use.alias("tou_mean"),
        percent_of(standard - time_of_use, standard).alias("tou_effect_percent"),
    )


def advice_facts(
    df: DataFrame, savings: DataFrame | None = None, segment: list[str] | None = None
) -> DataFrame:
    """Facts the rules look at, one row per segment; the savings gap is null if unknown."""
    facts = peak_facts(df, segment)
    if savings is None:
        return facts.withColumn("pct_saving", F.lit(None).cast("double"))
    if segment:
        return facts.join(savings.select(*segment, "pct_saving"), segment, "left")
    return facts.withColumn("pct_saving", savings.select("pct_saving").scalar())


def recommendations(
    facts: DataFrame, tou_percent: float = TOU_EFFECT_PERCENT, segment: list[str] | None = None
) -> DataFrame:
    """The advice that applies to each row of facts, in order."""

    # Titles and wording of the advice.
    rules: list[tuple[str, Column, Column | None]] = [
        (
            "Shift Heavy Appliances",
            F.format_string(
                "**%s** has the highest average consumption. Schedule heavy appliances on "
                "**%s** to flatten demand peak.",
                "peak_day",
                "lowest_day",
            ),
            None,
        ),
        (
            "Consider Time-of-Use Tariffs",
            F.format_string(
                "Dynamic pricing tariffs (ToU) show a ~%.1f%% lower baseline demand on average, "
                "encouraging consumption shifts to off-peak periods.",
                F.lit(float(tou_percent)),
            ),
            None,
        ),
        (
            "Optimize Winter Heating",
            F.format_string(
                "Winter consumption is significantly higher than %s. Optimize insulation and "
                "heating schedules to close the seasonal gap.",
                "lowest_season",
            ),
            F.col("peak_season") == "Winter",
        ),
        (
            "Weekend Consumption Awareness",
            F.format_string(
                "Weekend usage is **%.1f%%** higher than weekdays. Reduce standby energy and "
                "active appliance usage.",
                "weekend_pct_diff",
            ),
            F.col("weekend_pct_diff") > WEEKEND_GAP,
        ),
        (
            "Benchmark with Efficient Peers",
            F.format_string(
                "The gap between high and low clusters is **%.0f%%**. Track background base "
                "load items.",
                "pct_saving",
            ),
            F.col("pct_saving") > PEER_GAP,
        ),
    ]
    entries = []
    for position, (title, detail, condition) in enumerate(rules):
        entry = F.struct(
            F.lit(position).alias("position"), F.lit(title).alias("title"), detail.alias("detail")
        )
        entries.append(entry if condition is None else F.when(condition, entry))
    applying = F.array_compact(F.array(*entries))
    return facts.select(*(segment or []), F.inline(applying))
