"""Exact quantiles without gathering a group in one task.

``percentile`` and ``median`` keep every distinct value of a group in one task's memory.
That is fine for a group with a known bound (one household's days) but not for a whole
table. Here the first scan makes a mergeable quantile sketch (KLL) of each group, which brackets every
rank between two values; the second counts the rows below the bracket and the values inside, and picks
the rank. The sketch only says where to look: a rank that turns out to lie outside its bracket, or a bracket of more than
``FINISH_ROWS`` rows, is searched on by refining a histogram. Each of its passes counts rows per equi-width
bin with map-side partial sums, keeps the bin a rank falls in, and narrows to the smallest
and largest value actually seen there, until no search spans more than ``FINISH_ROWS`` rows. A bracket's first
pass also counts what lies below and above it, so any rank is found from it. The searches are rows of a stored table,
at most two for each group and probability, so any number of groups can be searched, and
the number of passes never changes a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlight.session import materialize

BINS = 1024
FINISH_ROWS = 200_000
#: Items of a sketch, and the share of a group by which a bracket reaches past a rank on both sides: several
#: times the sketch's usual error, which was under 0.1 %.
SKETCH_ITEMS = 4096
REACH = 0.004


def _bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equi-width bin of a value in ``[low, high]``.

    Halving before the subtraction keeps the width finite for any finite pair of ends. The
    two ends always part, so every pass narrows the span.
    """
    position = F.try_divide(value / 2 - low / 2, high / 2 - low / 2) * bins
    inner = F.least(F.greatest(F.floor(position).cast("int"), F.lit(0)), F.lit(bins - 1))
    return F.when(value <= low, 0).when(value >= high, bins - 1).otherwise(inner)


def _narrowed(data: DataFrame, state: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """``state`` with every search moved to the bin its rank falls in.

    ``state`` has one row per key and rank: the rank among the values in ``[low, high]``,
    and how many those are; or, of a ``guessed`` bracket, the rank among all. Then what lies below and above it are
    two more bins.
    """
    search = [*keys, "target"]
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    place = F.when(value < low, -1).when(value > high, bins).otherwise(_bin_of(value, low, high, bins))
    per_bin = (
        data.join(state, keys)
        .filter(F.col("guessed") | value.between(low, high))
        .withColumn("bin", place)
        .groupBy(*search, "rank", "bin")
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    earlier = Window.partitionBy(*search).orderBy("bin").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    return (
        per_bin.withColumn("rank", F.col("rank") - before)
        .filter((F.col("rank") >= 0) & (F.col("rank") < F.col("n")))
        .drop("bin")
        .withColumn("guessed", F.lit(False))
    )


def _picked(data: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target, value) of the searches whose rank lies in their bracket, by counting the values inside."""
    search = [*keys, "target"]
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    inside = (
        data.join(state, keys)
        .filter((value <= high) & (F.col("guessed") | (value >= low)))
        .groupBy(*search, "rank", F.when(value >= low, value).alias("value"))  # null: all that lies below
        .agg(F.count("*").alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy(*search).orderBy(F.asc_nulls_first("value")))
    found = inside.withColumn("upto", upto).filter(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    )
    return found.where("value IS NOT NULL").select(*search, "value")


def quantile_table(
    df: DataFrame,
    keys: list[str],
    value: str | Column,
    probabilities: list[float],
    finish_rows: int = FINISH_ROWS,
    bins: int = BINS,
) -> DataFrame:
    """(keys, quantiles): linear-interpolation quantiles of every group, as an array.

    Groups may have any number and any size; none may be null. Nulls and NaN are left out.
    ``df`` is scanned once per pass, twice for groups of up to FINISH_ROWS / (2 * REACH) rows, so give it a stored table.
    """
    value = F.col(value) if isinstance(value, str) else value
    data = df.select(*keys, value.cast("double").alias("value")).filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    sketched = data.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.kll_sketch_agg_double("value", F.lit(SKETCH_ITEMS)).alias("sketch"),
    )
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probabilities]
    few = F.col("n") * REACH < 2  # a bracket by shares might not reach the next row

    def bracket(p: float, place: Column) -> list[Column]:
        def end(share: float, beyond: str) -> Column:
            if not 0 < share < 1:
                return F.col(beyond)
            return F.when(few, F.col(beyond)).otherwise(F.kll_sketch_get_quantile_double("sketch", F.lit(share)))

        ends = end(float(p) - REACH, "least").alias("low"), end(float(p) + REACH, "most").alias("high")
        return [F.struct(f(place).alias("target"), *ends) for f in (F.floor, F.ceil)]

    brackets = F.array(*[b for p, at in zip(probabilities, places) for b in bracket(p, at)])
    sizes = materialize(sketched.select(*keys, "n", brackets.alias("brackets")), "group-sizes")
    span = F.when(F.col("n") * REACH < 2, F.col("n")).otherwise(F.ceil(F.col("n") * (2 * REACH)))
    state = (
        sizes.select(*keys, span.alias("n"), F.inline("brackets"))
        .groupBy(*keys, "target", "n")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .withColumns({"rank": F.col("target"), "guessed": F.lit(True)})
    )
    found = None
    while True:
        widest = state.agg(F.max(F.when(F.col("low") < F.col("high"), F.col("n")))).first()[0]
        if widest is None or widest <= finish_rows:
            found = materialize(_picked(data, state, keys), "quantiles")
            if found.count() == state.count():
                break
        # Too wide yet, or a rank outside its guessed bracket: what a pass leaves is no guess any more.
        state = materialize(_narrowed(data, state, keys, bins), "quantile-search")
    at_rank = F.map_from_entries(F.collect_list(F.struct("target", "value")))
    by_group = found.groupBy(*keys).agg(at_rank.alias("found")).join(sizes, keys)

    def interpolated(place: Column) -> Column:
        low = F.element_at("found", F.floor(place))
        high = F.element_at("found", F.ceil(place))
        return low + (high - low) * (place - F.floor(place))

    return by_group.select(*keys, F.array(*[interpolated(at) for at in places]).alias("quantiles"))


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    probabilities: list[float],
    group: str | Column | None = None,
    **options,
) -> dict:
    """``{group: [quantile, ...]}`` on the driver, for few groups (seasons, a constant)."""
    value = F.col(value) if isinstance(value, str) else value
    group = F.lit(0) if group is None else F.col(group) if isinstance(group, str) else group
    # Structs compare equal where both hold a null, so a null group is one too.
    keyed = df.select(F.struct(group.alias("of")).alias("group"), value.alias("value"))
    rows = quantile_table(keyed, ["group"], "value", probabilities, **options).collect()
    return {row["group"]["of"]: list(row["quantiles"]) for row in rows}


def exact_median(df: DataFrame, value: str | Column, **options) -> float | None:
    answer = exact_quantiles(df, value, [0.5], **options)
    return answer[0][0] if answer else None


def grouped_median(df: DataFrame, keys: list[str], value: str, **options) -> DataFrame:
    """(keys, median) for any number of groups of any size."""
    table = quantile_table(df, keys, value, [0.5], **options)
    return table.select(*keys, F.col("quantiles")[0].alias("median"))


def lookup(key: Column, table: dict, index: int) -> Column:
    """Quantile ``index`` of the row's group as a CASE over the few groups."""
    branches = [(group, values[index]) for group, values in table.items()]
    if not branches:
        return F.lit(None).cast("double")
    first, *rest = branches
    start = F.when(key.eqNullSafe(F.lit(first[0])), F.lit(first[1]))
    return reduce(lambda c, b: c.when(key.eqNullSafe(F.lit(b[0])), F.lit(b[1])), rest, start)
