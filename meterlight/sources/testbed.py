"""Panel tables derived from the order/line-item test tables.

A supplier plays the household, a ship date the day, each line's quantity one intra-day
reading; orders per day play the weather. Some targets are blanked and some household-days
doubled, so that cleaning has work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlight.functions.quantiles import grouped_median
from meterlight.schema import DAY, ENERGY_COLUMNS, HOUSEHOLD, ORDINAL, WEATHER_SOURCE_COLUMNS
from meterlight.sources.readers import scan_table


def _household_id(key: str):
    return F.concat(F.lit("MAC"), F.lpad(F.col(key).cast("string"), 6, "0"))


def readings(spark: SparkSession, folder: str) -> DataFrame:
    lines = scan_table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias(DAY), "l_quantity"
    )
    # The median is the mean of the middle values by rank: one shuffle and sort of narrow rows serves the ranks and the
    # aggregate, where the built-in median would carry a map of values for every day through both.
    quantity = F.col("l_quantity")
    ordered = Window.partitionBy("k", DAY).orderBy(quantity.asc_nulls_last())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = lines.withColumns({"place": F.row_number().over(ordered), "n": F.count(quantity).over(whole)})
    middle = F.col("place").between(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2))
    days = ranked.groupBy("k", DAY).agg(
        F.avg(F.when(middle, quantity.cast("double"))).alias("energy_median"),
        F.avg(quantity).alias("energy_mean"),
        F.max(quantity).alias("energy_max"),
        F.count("*").cast("double").alias("energy_count"),
        F.stddev_samp(quantity).alias("energy_std"),
        F.sum(quantity).alias("energy_sum"),
        F.min(quantity).alias("energy_min"),
    )
    month_day = F.dayofmonth(DAY)
    blank = (F.col("k") % 7 == 0) & (month_day == 13)
    doubled = (F.col("k") % 10 == 0) & (month_day == 1)
    first = F.struct(
        F.lit(1).alias(ORDINAL), F.when(~blank, F.col("energy_sum")).alias("energy_sum")
    )
    second = F.struct(F.lit(2).alias(ORDINAL), (F.col("energy_sum") + 1).alias("energy_sum"))
    copies = F.when(doubled, F.array(first, second)).otherwise(F.array(first))
    return days.withColumn("copy", F.explode(copies)).select(
        _household_id("k").alias(HOUSEHOLD),
        DAY,
        *[F.col("copy.energy_sum") if c == "energy_sum" else F.col(c) for c in ENERGY_COLUMNS],
        f"copy.{ORDINAL}",
    )


def households(spark: SparkSession, folder: str) -> DataFrame:
    supplier, nation, region = (
        scan_table(spark, folder, name) for name in ("supplier", "nation", "region")
    )
    key = F.col("s_suppkey")
    group = F.when(key % 11 == 0, "ACORN-U").when(key % 13 != 0, F.col("r_name"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _household_id("s_suppkey").alias(HOUSEHOLD),
            F.when(key % 4 == 0, "ToU").otherwise("Std").alias("tariff"),
            F.col("n_name").alias("acorn"),
            group.alias("acorn_grouped"),
            F.concat(F.lit("block_"), (key % 5).cast("string")).alias("file"),
        )
    )


def weather(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    orders = scan_table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias(DAY), price, "o_orderstatus"
    )
    days = orders.groupBy(DAY).agg(
        (F.max(price) / 1e4).alias("temperature_max"),
        (F.min(price) / 1e4).alias("temperature_min"),
        F.count("*").cast("double").alias("wind_speed"),
        (F.avg(price) / 5e5).alias("humidity"),
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("cloud_cover"),
        (F.sum(price) / 1e5).alias("pressure"),
        (F.stddev_samp(price) / 1e4).alias("visibility"),
    )
    # A day's orders have no bound, unlike the quantities of a household's day.
    medians = grouped_median(orders, [DAY], "o_totalprice")
    return days.join(medians, DAY, "left").select(
        *days.columns, (F.col("median") / 1e4).alias("dew_point")
    )


def holidays(readings_table: DataFrame) -> DataFrame:
    month, day = F.month(DAY), F.dayofmonth(DAY)
    christmas = (month == 12) & day.isin(25, 26)
    new_year = (month == 1) & (day == 1)
    return readings_table.filter(christmas | new_year).select(DAY).distinct()


# The same tables as raw CSV files would hold them, for the file readers.


def raw_readings(readings_table: DataFrame) -> DataFrame:
    """Three date layouts and a text where the target is missing."""
    day = F.dayofmonth(DAY)
    layout = (
        F.when(day % 3 == 0, F.date_format(DAY, "yyyy-MM-dd"))
        .when(day % 3 == 1, F.date_format(DAY, "M/d/yyyy"))
        .otherwise(F.date_format(DAY, "MMM d, yyyy"))
    )
    target = F.coalesce(F.col("energy_sum").cast("string"), F.lit("Null"))
    return readings_table.withColumns({DAY: layout, "energy_sum": target}).withColumnRenamed(
        HOUSEHOLD, "LCLid"
    )


def raw_weather(weather_table: DataFrame) -> DataFrame:
    """A timestamp text, and every seventh day a second, later row for the same day."""
    names = {ours: theirs for theirs, ours in WEATHER_SOURCE_COLUMNS.items()}
    copies = F.when(F.dayofmonth(DAY) % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    doubled = weather_table.withColumn("copy", F.explode(copies))
    time = F.concat(F.date_format(DAY, "yyyy-MM-dd"), F.lit(" 00:00:00")).alias("time")
    values = [
        (F.col(ours) + F.col("copy")).alias(theirs) for ours, theirs in names.items()
    ]
    return (
        doubled.orderBy(DAY, "copy").select(time, *values, F.lit("rain").alias("precipType"))
    )


def raw_households(households_table: DataFrame) -> DataFrame:
    return households_table.withColumnsRenamed(
        {HOUSEHOLD: "LCLid", "tariff": "stdorToU", "acorn": "Acorn", "acorn_grouped": "Acorn_grouped"}
    )


def raw_holidays(holidays_table: DataFrame) -> DataFrame:
    """Every date twice, in two layouts."""
    layouts = F.array(F.date_format(DAY, "yyyy-MM-dd"), F.date_format(DAY, "d MMMM yyyy"))
    return holidays_table.select(
        F.explode(layouts).alias("Bank holidays"), F.lit("holiday").alias("Type")
    )


def raw_acorn_details(spark: SparkSession, folder: str) -> DataFrame:
    """Category details out of the parts, with an accented heading."""
    return scan_table(spark, folder, "part").select(
        F.concat(F.lit("Catégorie "), F.col("p_brand")).alias("MAIN CATEGORIES"),
        F.col("p_type").alias("CATEGORIES"),
        F.col("p_name").alias("REFERENCE"),
        F.col("p_partkey").cast("string").alias("ACORN-A"),
    )
