"""Filters, splits and exploratory aggregates over the feature table.

Every aggregate is a grouped or global aggregation with map-side partial results, so a hot
day, household or group costs each task one partial row.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.functions import calendar
from meterlight.functions.moments import correlations
from meterlight.functions.numeric import number_or_null
from meterlight.functions.quantiles import exact_quantiles, lookup
from meterlight.operators.joins import with_scalar
from meterlight.schema import (
    DAY,
    HOLIDAY_FLAG,
    HOUSEHOLD,
    SEASON_NAMES,
    TARGET,
    TEST_DAYS,
    WEEKDAY_NAMES,
    WEEKDAY_SHORT_NAMES,
    numeric_columns,
)

ALL = "All"
ALL_HOUSEHOLDS = "All Households"
AGGREGATED = "AGGREGATED"
# Category codes left out of the group comparison.
UNCLASSIFIED_GROUPS = ["ACORN-", "ACORN-U"]
DAY_TYPES = ["Weekday", "Weekend", "Bank Holiday"]
HEATMAP_COLUMNS = 12


# Filters and splits


def eda_filter(
    df: DataFrame,
    start: str | date | None = None,
    end: str | date | None = None,
    acorn: str = ALL,
    tariff: str = ALL,
) -> DataFrame:
    """Rows between two days (both included) of one category group and tariff."""
    if start:
        df = df.filter(F.col(DAY) >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col(DAY) <= F.lit(end).cast("date"))
    if acorn != ALL and "acorn_grouped" in df.columns:
        df = df.filter(F.col("acorn_grouped") == acorn)
    if tariff != ALL and "tariff" in df.columns:
        df = df.filter(F.col("tariff") == tariff)
    return df


def household_slice(df: DataFrame, household: str = ALL) -> DataFrame:
    if household in (ALL, ALL_HOUSEHOLDS):
        return df
    return df.filter(F.col(HOUSEHOLD) == household)


def household_compare(df: DataFrame, households: str | list[str]) -> DataFrame:
    """Daily series of the listed households (comma-separated text or a list)."""
    ids = households.split(",") if isinstance(households, str) else households
    return df.filter(F.col(HOUSEHOLD).isin(ids)).select(DAY, TARGET, HOUSEHOLD)


def cutoff_day(df: DataFrame, test_days: int = TEST_DAYS) -> Column:
    return df.select(F.date_sub(F.max(DAY), test_days)).scalar()


def time_split(df: DataFrame, test_days: int = TEST_DAYS) -> tuple[DataFrame, DataFrame]:
    """Chronological split; the cutoff is a subquery that is pushed into the scans."""
    cutoff = cutoff_day(df, test_days)
    return df.filter(F.col(DAY) <= cutoff), df.filter(F.col(DAY) > cutoff)


def marked_split(df: DataFrame, test_days: int = TEST_DAYS) -> DataFrame:
    """Both parts in one table, named in column ``split``."""
    late = F.col(DAY) > cutoff_day(df, test_days)
    return df.withColumn("split", F.when(late, "test").otherwise("train"))


def train_val_stack(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Both parts with the fold marker of a fixed split: -1 trains, 0 validates."""
    return train.withColumn("fold", F.lit(-1)).unionByName(
        validation.withColumn("fold", F.lit(0))
    )


def row_sample(df: DataFrame, percent: int = 10, seed: int = 42) -> DataFrame:
    """Repeatable row sample: the same rows however the data is partitioned."""
    key = F.concat_ws("|", HOUSEHOLD, F.col(DAY).cast("string"), F.lit(str(seed)))
    bucket = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 100
    return df.filter(bucket < percent)


def recent_rows(df: DataFrame, n: int = 30) -> DataFrame:
    """The last rows over all households."""
    return df.orderBy(F.desc(DAY), F.desc(HOUSEHOLD)).limit(n)


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct choices of the filters as (kind, value)."""
    kinds = {"acorn_group": "acorn_grouped", "household": HOUSEHOLD, "tariff": "tariff"}
    pairs = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()]
    )
    return (
        df.select(F.explode(pairs).alias("option"))
        .select("option.*")
        .na.drop(subset=["value"])
        .distinct()
        .orderBy("kind", "value")
    )


# Counts and means


def kpis(df: DataFrame) -> DataFrame:
    first, last = (calendar.month_label(f(DAY)) for f in (F.min, F.max))
    return df.agg(
        F.countDistinct(HOUSEHOLD).alias("n_households"),
        F.concat(first, F.lit(" – "), last).alias("date_range"),
        F.round(F.avg(TARGET), 2).alias("avg_daily_energy"),
        F.count("*").alias("total_records"),
    )


def eda_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("record_count"), F.countDistinct(HOUSEHOLD).alias("household_count")
    )


def daily_mean(df: DataFrame) -> DataFrame:
    return df.groupBy(DAY).agg(F.avg(TARGET).alias("mean_energy"))


def monthly_mean(df: DataFrame) -> DataFrame:
    return df.groupBy(calendar.month_key(F.col(DAY)).alias("year_month")).agg(
        F.avg(TARGET).alias("mean_energy")
    )


def day_of_week_mean(df: DataFrame) -> DataFrame:
    means = df.groupBy(calendar.day_of_week(F.col(DAY)).alias("day_of_week")).agg(
        F.avg(TARGET).alias("mean_energy")
    )
    return means.withColumn(
        "day_name", calendar.name_of(F.col("day_of_week"), WEEKDAY_SHORT_NAMES)
    )


def daily_panel_mean(df: DataFrame) -> DataFrame:
    """Mean of every numeric column per day, as one artificial household."""
    means = df.groupBy(DAY).agg(*[F.avg(c).alias(c) for c in numeric_columns(df)])
    return means.withColumn(HOUSEHOLD, F.lit(AGGREGATED))


def acorn_mean_std(df: DataFrame) -> DataFrame:
    return (
        df.filter(~F.col("acorn_grouped").isin(UNCLASSIFIED_GROUPS))
        .groupBy("acorn_grouped")
        .agg(F.avg(TARGET).alias("mean_energy"), F.stddev_samp(TARGET).alias("std_energy"))
        .orderBy(F.desc("mean_energy"), "acorn_grouped")
    )


def day_type(df: DataFrame) -> Column:
    weekend = (
        F.col("is_weekend") == 1
        if "is_weekend" in df.columns
        else calendar.day_of_week(F.col(DAY)) >= 5
    )
    holiday = F.col(HOLIDAY_FLAG) == 1 if HOLIDAY_FLAG in df.columns else F.lit(False)
    weekday, weekend_name, holiday_name = DAY_TYPES
    return F.when(holiday, holiday_name).when(weekend, weekend_name).otherwise(weekday)


def day_type_mean(df: DataFrame) -> DataFrame:
    """Mean per day type; a type without rows is listed with a null mean."""
    kind = day_type(df)
    means = df.agg(*[F.avg(F.when(kind == name, F.col(TARGET))).alias(name) for name in DAY_TYPES])
    return means.unpivot([], DAY_TYPES, "day_type", "mean_energy")


def seasonal_box(df: DataFrame) -> DataFrame:
    """Box-plot figures per season: quartiles, whisker ends within 1.5 IQR, outliers."""
    season = F.col("season") if "season" in df.columns else calendar.season(F.col(DAY))
    data = df.select(season.alias("season"), F.col(TARGET).alias("y"))
    quartiles = exact_quantiles(data, "y", [0.25, 0.5, 0.75], group="season")
    q1, median, q3 = (lookup(F.col("season"), quartiles, i) for i in range(3))
    fenced = data.withColumns({"q1": q1, "median": median, "q3": q3}).withColumn(
        "inside",
        F.col("y").between(
            F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
            F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
        ),
    )
    return (
        fenced.groupBy("season")
        .agg(
            F.count("y").alias("n"),
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(F.col("inside"), F.col("y"))).alias("whisker_low"),
            F.max(F.when(F.col("inside"), F.col("y"))).alias("whisker_high"),
            F.count_if(~F.col("inside")).alias("outliers"),
        )
        .withColumn("season_name", calendar.season_name(F.col("season")))
        .orderBy("season")
    )


# Weather and correlation


def weather_daily(df: DataFrame, weather: str = "temperature_min") -> DataFrame:
    """Mean target and mean of one weather column per day."""
    column = weather if weather in df.columns else "temperature_max"
    return df.groupBy(DAY).agg(
        F.avg(TARGET).alias("mean_energy"), F.avg(column).alias("weather_value")
    )


def weather_trend(daily: DataFrame) -> DataFrame:
    """Least-squares line of the daily means."""
    y, x = F.col("mean_energy"), F.col("weather_value")
    return daily.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def heatmap_columns(df: DataFrame, limit: int = HEATMAP_COLUMNS) -> list[str]:
    return [c for c in numeric_columns(df) if c != "energy_count"][:limit]


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) for every unordered pair of columns, each column with itself included.

    Each pair is taken over the rows that have both values; all come from one scan.
    """
    doubles = df.select(*[number_or_null(F.col(c)).alias(c) for c in columns])
    rows = [(x, y, r) for (x, y), r in correlations(doubles, columns).items()]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairwise Pearson correlation in long form, all ordered pairs."""
    pairs = correlation_pairs(df, columns or heatmap_columns(df))
    mirrored = pairs.filter("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "r")
    return pairs.unionByName(mirrored)


# Histogram and insights


def score_histogram(df: DataFrame, value: str, bins: int = 60) -> DataFrame:
    """Equi-width histogram between the smallest and the largest value."""
    data = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    ends = F.struct(F.min("v").alias("low"), F.max("v").alias("high"))
    ranged = with_scalar(data, data, ends=ends).select("v", "ends.low", "ends.high")
    position = F.try_divide(F.lit(bins) * (F.col("v") - F.col("low")), F.col("high") - F.col("low"))
    bin_number = F.least(F.floor(F.coalesce(position, F.lit(0.0))).cast("int"), F.lit(bins - 1))
    return (
        ranged.withColumn("bin", bin_number + 1)
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"))
        .select(
            "bin",
            (F.col("low") + (F.col("bin") - 1) * (F.col("high") - F.col("low")) / bins).alias(
                "bin_start"
            ),
            "n",
        )
    )


def weekend_gap_percent(day: Column) -> Column:
    """Weekend mean above weekday mean, in percent of the weekday mean."""
    weekend = calendar.day_of_week(day) >= 5
    weekend_mean = F.avg(F.when(weekend, F.col(TARGET)))
    weekday_mean = F.avg(F.when(~weekend, F.col(TARGET)))
    return F.try_divide(weekend_mean - weekday_mean, weekday_mean) * 100


def _first_name(means: Column, extreme: Column, names: list[str]) -> Column:
    return calendar.name_of(F.array_position(means, extreme) - 1, names)


def peak_facts(df: DataFrame, segment: list[str] | None = None) -> DataFrame:
    """Busiest and quietest weekday and season, and the weekend gap, per segment.

    One pass with a conditional mean per weekday and season. Ties go to the first.
    """

    def means(part: Column, names: list[str]) -> Column:
        return F.array(*[F.avg(F.when(part == i, F.col(TARGET))) for i in range(len(names))])

    day, keys = F.col(DAY), segment or []
    facts = df.groupBy(*keys).agg(
        means(calendar.day_of_week(day), WEEKDAY_NAMES).alias("dow"),
        means(calendar.season(day), SEASON_NAMES).alias("season"),
        weekend_gap_percent(day).alias("weekend_pct_diff"),
    )
    dow, season = F.col("dow"), F.col("season")
    return facts.select(
        *keys,
        _first_name(dow, F.array_max(dow), WEEKDAY_NAMES).alias("peak_day"),
        _first_name(dow, F.array_min(dow), WEEKDAY_NAMES).alias("lowest_day"),
        _first_name(season, F.array_max(season), SEASON_NAMES).alias("peak_season"),
        _first_name(season, F.array_min(season), SEASON_NAMES).alias("lowest_season"),
        "weekend_pct_diff",
    )


def peak_insights(df: DataFrame, segment: list[str] | None = None) -> DataFrame:
    """``peak_facts`` with the gap rounded for display."""
    return peak_facts(df, segment).withColumn(
        "weekend_pct_diff", F.round("weekend_pct_diff", 1)
    )
