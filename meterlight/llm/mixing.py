"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight for every moment of training, piecewise linear over [0, 1]. Its
integral is the source's weight in the whole mix; a source's target is its share by weight,
capped at ``most`` times its own words, the excess reshared by weight until none is above.

A source's documents stand in a fixed random order (a hash of ``doc_id`` and text) and are read as one
stream of words, from the start again when it ends. Its cumulative demand at time t is the
target times the integrated weight up to t; a document's place in the stream, put through the
inverse of that function, is the moment of training at which it is due. The document that a
source's target ends in is taken up to that word. Documents are then range-sorted by moment.

Running sums are taken in two steps, over buckets of a source and inside a bucket, so no source
meets in one task. The table of sources, a row for each, is the recipe and goes to the driver.

Null and empty texts have no words and are never taken. A source without words has target 0.0, and nothing of it
is taken. Null sources form one source, last in
order. Repeated rows are documents of their own. A null ``doc_id`` is ordered before others.
An empty table gives an empty result; further columns are ignored (``mixed_documents`` keeps
them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlight.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
ROWS_OF_BUCKET = 1_000
MOST_SOURCES = 100_000  # the recipe has a row for each and is broadcast

Knots = list[tuple[float, float]]

#: Curricula by weight: heavy sources fade, light ones grow; each integrates to its weight.
FADING: Knots = [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)]
STEADY: Knots = [(0.0, 1.0), (1.0, 1.0)]
GROWING: Knots = [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]


@dataclass
class Source:
    name: str | None
    knots: Knots
    size: int
    rows: int
    target: float = 0.0

    @property
    def weight(self) -> float:
        """The integral of the source's weight over training."""
        pairs = zip(self.knots, self.knots[1:])
        return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pairs)


def set_targets(sources: list[Source], share: float, most: float) -> None:
    """Shares by weight of ``share`` times all words, at most ``most`` times a source's own."""
    left = share * sum(s.size for s in sources)
    open_sources = list(sources)
    while open_sources:
        weight = sum(s.weight for s in open_sources)
        full = [s for s in open_sources if left * s.weight >= most * s.size * weight]
        if not full:
            for s in open_sources:
                s.target = left * s.weight / weight
            return
        for s in full:
            s.target = most * s.size
            left -= s.target
        open_sources = [s for s in open_sources if s not in full]


def cycle(names: list[str | None], weights: tuple[float, ...] = (5, 2, 1)) -> dict:
    """Schedules for sources in order of their code points, null last: weights in turn."""
    shapes = (FADING, STEADY, GROWING)
    ordered = sorted(names, key=lambda n: (n is None, n or ""))
    return {
        name: [(t, w * weights[i % len(weights)]) for t, w in shapes[i % len(shapes)]]
        for i, name in enumerate(ordered)
    }


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _moment() -> Column:
    """Time at which a source's demand, as a share of its target, reaches ``g``."""
    part = F.element_at(
        F.filter("parts", lambda p: (p["g0"] <= F.col("g")) | (p["g0"] == 0)), -1
    )
    slope = part["w1"] - part["w0"]
    more = (F.col("g") - part["g0"]) * F.col("weight")
    root = F.sqrt(F.greatest(part["w0"] * part["w0"] + 2 * slope * more / part["t"], F.lit(0.0)))
    # Root of w0 x + slope x^2 / (2 t) = more, in the form that holds for slope 0 too.
    return part["t0"] + F.when(more <= 0, 0.0).otherwise(2 * more / (part["w0"] + root))


def _recipe(spark, sources: list[Source]) -> DataFrame:
    rows = []
    for s in sources:
        parts, done = [], 0.0
        for (t0, w0), (t1, w1) in zip(s.knots, s.knots[1:]):
            parts.append((float(done / s.weight), t0, t1 - t0, float(w0), float(w1)))
            done += (t1 - t0) * (w0 + w1) / 2
        rows.append((s.name, s.size, s.target, float(s.weight), parts))
    return spark.createDataFrame(
        rows,
        "source string, source_size long, target double, weight double, "
        "parts array<struct<g0: double, t0: double, t: double, w0: double, w1: double>>",
    )


def _order() -> Column:
    """A document's place in its source's fixed random order."""
    return F.xxhash64(F.lit("mixing"), "doc_id", "text")


def mix(docs: DataFrame, schedules=cycle, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each document: sizes, its source's target, and when and how it is taken.

    Columns ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``,
    ``passes``, an array of (``pass``, ``moment``, ``words``), and the ``order`` in its source. ``schedules`` gives a dict of
    knots for a list of source names.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), _order().alias("order"))
    sized = materialize(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    rows = totals.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them before mixing")
    sources = [Source(r["source"], [], r["size"], r["rows"]) for r in rows]
    knots = schedules([s.name for s in sources])
    for s in sources:
        s.knots = knots[s.name]
    set_targets(sources, share, most)
    buckets = max(256, sum(s.rows for s in sources) // ROWS_OF_BUCKET)
    sized = sized.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = sums.select(
        F.col("source").alias("_source"),
        F.col("bucket").alias("_bucket"),
        (F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
        .alias("before"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumn("running", running - F.col("size")).join(
        before,
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")),
    )
    recipe = _recipe(spark, sources).withColumnRenamed("source", "_own")
    placed = placed.join(F.broadcast(recipe), F.col("source").eqNullSafe(F.col("_own")))
    placed = placed.withColumn("start", F.col("before") + F.col("running"))
    passes = max([1, *(-(-int(s.target + 0.5) // s.size) for s in sources if s.size)])
    all_passes = []
    for k in range(passes):
        at = F.col("start") + k * F.col("source_size")
        taken = F.least("size", F.round("target").cast("long") - at)
        g = F.least(F.try_divide(at.cast("double"), F.col("target")), F.lit(1.0))
        all_passes.append((at, taken, g))
    # One array of passes; each moment needs its own ``g``.
    out = placed
    for k, (_, taken, g) in enumerate(all_passes):
        out = out.withColumn("g", g).withColumn(
            f"pass_{k}",
            F.when(
                (taken > 0) & (F.col("size") > 0),
                F.struct(
                    F.lit(k).alias("pass"),
                    _moment().alias("moment"),
                    taken.alias("words"),
                ),
            ),
        )
    taken = F.array_compact(F.array(*[f"pass_{k}" for k in range(passes)]))
    out = out.withColumn("passes", taken)
    total = F.aggregate("passes", F.lit(0).cast("long"), lambda x, p: x + p["words"])
    return out.select(
        "doc_id", "source", "size", "source_size", "target", total.alias("taken"), "passes", "order"
    )


def by_moment(plan: DataFrame) -> DataFrame:
    """The plan range-sorted by the moment of each document's first pass; untaken ones last."""
    first = F.when(F.size("passes") > 0, F.col("passes")[0]["moment"])
    return plan.withColumn("moment", first).orderBy(F.asc_nulls_last("moment"), "doc_id")


def mixed_documents(docs: DataFrame, schedules=cycle, share: float = 1.5, most: float = 2.0):
    """The documents of the mix in training order, repeated and cut as the plan says.

    Keeps the columns of ``docs``; a cut text ends after the last word taken, and a column
    ``n_chars`` is set anew.
    """
    key = F.struct("doc_id", "source", "size", "order").alias("_mix_key")
    plan = mix(docs, schedules, share, most).where("taken > 0").select(key, "passes")
    plan = plan.groupBy("_mix_key").agg(F.sort_array(F.collect_list("passes")).alias("_mix_plans"))
    count = words(F.col("text")).alias("size")
    own = docs.withColumn("_mix_own", F.struct("doc_id", "source", count, _order().alias("order")))
    # Structs are equal where both hold a null. Rows with the same key are equal but for the columns that are
    # carried along, and share its plans; the window rides on the join's shuffle, so texts move once to their plan and once to their place.
    twins = Window.partitionBy("_mix_key").orderBy(F.lit(0))
    due = own.join(plan, F.col("_mix_own") == F.col("_mix_key"))
    due = due.withColumn("_mix_twin", F.row_number().over(twins))
    due = due.where(F.col("_mix_twin") <= F.size("_mix_plans"))
    due = due.withColumn("_mix_due", F.explode(F.element_at("_mix_plans", F.col("_mix_twin"))))
    cut = F.array_join(F.slice(F.split("text", WORD_END), F.lit(1), F.col("_mix_due.words").cast("int")), "")
    due = due.withColumn(
        "text", F.when(F.col("_mix_due.words") < F.col("_mix_key.size"), cut).otherwise(F.col("text"))
    )
    if "n_chars" in docs.columns:
        due = due.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return due.orderBy("_mix_due.moment", "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])
