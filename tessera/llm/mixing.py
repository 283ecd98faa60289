"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words (its weight's share of the whole, at most
``max_repeat`` times what it holds; what is cut off is shared again by weight).
A document's expected number of copies is its source's rate times its own
relative weight. The whole part is given for certain; for the rest one more
copy goes to the documents that come first in Pareto order, the order of

    U / (1 - U)  divided by  p / (1 - p)

with U a random number fixed by seed, id and text and p the fractional part (the inclusion probability). The sample's size is fixed in words:
the order is followed until the source's target is reached (to the nearest document).

The order is never sorted as a whole. A histogram of 65,536 cells per source, pre-aggregated before its shuffle and
summed in two levels of 256, shows the cell in which the target falls; only that cell's documents are sorted. The order is followed as far as
no document goes beyond the target. Where a long document at this cut leaves over ``TOLERANCE`` of the target open, the order is followed further among those of up to
a quarter of what is left, and again, till little is left or nothing fits; what is left at last is filled as nearly as any one document can.

Defined results: null text has size 0; a null source is a source of its own; rows with equal id, text and source share their
fate (each counts), and go through the order as one; equal ranks go together; a very long text is one document and counts whole; an empty table gives an empty
table; a source without words has target 0 and takes nothing; a rate that is a whole number but for rounding gives whole copies only; the
output column replaces an input column of the same name, and other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, but, materialise

#: A table of one row per source is broadcast up to so many sources, else joined by shuffle.
BROADCAST_SOURCES = 100_000
CELLS = 256
#: A rate this near below a whole number is that number.
ROUNDING = 1e-9
#: What may be left open of a target while shorter documents could fill it, but for one document at last.
TOLERANCE = 0.001


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def cyclic_weights(totals: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """weights, repeating, for sources in code point order (null last). totals: a row per source."""
    place = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return totals.withColumn("weight", F.element_at(cycle, ((place - 1) % len(weights) + 1).cast("int")))


def target_words(totals: DataFrame, budget: float = 1.0, max_repeat: float = 3.0) -> DataFrame:
    """totals(src, weight, words) with target: weights share budget * all words, none above max_repeat * words.

    A source is at its cap if the level (words a unit of weight) is above cap / weight. In the order of
    cap / weight the sources at their cap come first, so the level follows from running sums.
    """
    cap = F.col("words") * F.lit(float(max_repeat))
    every = Window.orderBy("fill", F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    out = totals.withColumn("cap", cap.cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    out = (
        out.withColumn("capped_before", F.coalesce(F.sum("cap").over(every), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(every), F.lit(0.0)))
        .withColumn("all_words", F.sum("words").over(whole).cast("double") * F.lit(float(budget)))
        .withColumn("level", (F.col("all_words") - F.col("capped_before")) / F.col("weight_left"))
    )
    # the first source whose own level stays within its cap sets the level of all from there on
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(whole)["level"]
    return out.withColumn("final", level).withColumn(
        "target", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    ).select("src", "weight", "words", "target")


def _draw(df: DataFrame, id_col: str, text_col: str, seed: int) -> Column:
    """A number in (0, 1), fixed by seed, id and text."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col))), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _place(rate: Column, draw: Column) -> tuple[Column, Column]:
    """Certain copies and the Pareto rank, mapped to (0, 1) in its own order."""
    whole = F.floor(rate + ROUNDING)
    p = F.least(F.greatest(rate - whole, F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = (draw / (1 - draw)) / (p / (1 - p))
    return whole, odds / (1 + odds)


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    doc_weight: str | None = None,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    budget: float = 1.0,
    max_repeat: int = 3,
    seed: int = 17,
    into: str = "mix",
) -> DataFrame:
    """docs with a struct column ``into``: size, source_size, target, copies, taken.

    doc_weight: column of relative inclusion weights within a source (null or below 0 counts as 0); None: all alike.
    """
    spark = docs.sparkSession
    own = F.lit(1.0) if doc_weight is None else F.greatest(F.coalesce(F.col(doc_weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = materialise(
        docs.select(
            F.col(source_col).alias("src"),
            word_count(F.col(text_col)).alias("size"),
            _draw(docs, id_col, text_col, seed).alias("draw"),
            own.alias("own"),
        ),
        "mix-sizes",
    )
    totals = sized.groupBy("src").agg(F.sum("size").alias("words"), F.sum(F.col("own") * F.col("size")).alias("mass"))
    totals = materialise(totals, "mix-totals")
    goals = target_words(cyclic_weights(totals.select("src", "words"), weights), budget, max_repeat)
    goals = goals.join(totals.select(F.col("src").alias("src2"), "mass"), F.col("src").eqNullSafe(F.col("src2"))).drop("src2")
    # words a unit of weight: the rate of a document is unit * its weight
    goals = materialise(goals.withColumn("unit", F.when(F.col("mass") > 0, F.col("target") / F.col("mass")).otherwise(0.0)), "mix-goals")
    small = goals.count() <= BROADCAST_SOURCES
    held = (lambda d: F.broadcast(d)) if small else (lambda d: d)

    def with_goal(df: DataFrame, goal: DataFrame) -> DataFrame:
        names = goal.columns
        goal = goal.select(*[F.col(c).alias(f"_g_{c}") for c in names])
        return df.join(held(goal), F.col("src").eqNullSafe(F.col("_g_src")), "left").drop("_g_src")

    rate = F.least(F.col("_g_unit") * F.col("own"), F.lit(float(max_repeat)))
    whole, rank = _place(rate, F.col("draw"))
    open_to_more = (F.col("whole") < max_repeat) & (F.col("own") > 0) & (F.col("size") > 0)
    placed = with_goal(sized, goals.select("src", "unit")).withColumn("whole", whole).withColumn("rank", rank)
    given = placed.groupBy("src").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    need = with_goal(given, goals.select("src", "target")).select("src", (F.col("_g_target") - F.col("certain")).alias("need"))
    need = materialise(need, "mix-need")

    more = with_goal(placed.filter(open_to_more), need)
    cell = F.least((F.col("rank") * (CELLS * CELLS)).cast("int"), F.lit(CELLS * CELLS - 1))
    ranked = more.filter("_g_need > 0").select("src", "size", "rank", cell.alias("cell"))

    def crossing(sums: DataFrame, by: str) -> DataFrame:
        """Of (src, by, more, need): the cell in which the need is met, and the need that is left there."""
        upto = Window.partitionBy("src").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("more").over(upto), F.lit(0))
        found = sums.withColumn("before", before).filter(F.col("before") < F.col("need"))
        last = found.groupBy("src").agg(F.max(F.struct(F.col(by).alias("by"), (F.col("need") - F.col("before")).alias("need"))).alias("at"))
        return last.select("src", F.col("at.by").alias(by), F.col("at.need").alias("need"))

    def follow(some: DataFrame, need: DataFrame) -> DataFrame:
        """(src, cut, closed, rest): how far the order of ``some`` is followed till no more fits the need, and what is left of it."""
        cells = some.groupBy("src", "cell").agg(F.sum("size").alias("more"))
        cells = materialise(cells.withColumn("coarse", F.floor(F.col("cell") / CELLS)), "mix-cells")
        sums = cells.groupBy("src", "coarse").agg(F.sum("more").alias("more"))
        at = crossing(with_goal(sums, need).withColumnRenamed("_g_need", "need"), "coarse")
        at = at.select(F.col("src").alias("_a"), F.col("coarse").alias("_c"), "need")
        fine = cells.join(held(at), F.col("src").eqNullSafe(F.col("_a")) & (F.col("coarse") == F.col("_c")))
        at = materialise(crossing(fine.select("src", "cell", "more", "need"), "cell"), "mix-crossings")
        edge = at.select(F.col("src").alias("_a"), F.col("cell").alias("_c"), "need")
        inner = some.join(held(edge), F.col("src").eqNullSafe(F.col("_a")) & (F.col("cell") == F.col("_c")))
        inner = inner.groupBy("src", "rank").agg(F.sum("size").alias("size"), F.first("need").alias("need"))  # equal rows are one step of the order
        upto = Window.partitionBy("src").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        inner = inner.withColumn("so_far", F.sum("size").over(upto)).filter("so_far <= need")
        cut = inner.groupBy("src").agg(F.max("rank").alias("cut"), F.max("so_far").alias("got"))
        # where no document of the cell fits, the cell's lower border is the cut
        cuts = at.select("src", (F.col("cell") / F.lit(float(CELLS * CELLS))).alias("below"), "need")
        rest = F.col("need") - F.coalesce("_g_got", F.lit(0))
        return with_goal(cuts, cut).select("src", F.coalesce("_g_cut", "below").alias("cut"), F.col("_g_cut").isNotNull().alias("closed"), rest.alias("rest"))

    def within(cut: Column, closed: Column) -> Column:
        return F.when(closed, F.col("rank") <= cut).otherwise(F.col("rank") < cut)

    # (src, steps, rest): the cuts so far, each for documents of up to so many words
    step = lambda limit: F.array(F.struct(limit.cast("double").alias("limit"), "cut", "closed"))
    cuts = materialise(follow(ranked, need).select("src", step(F.lit(float("inf"))).alias("steps"), "rest"), "mix-cuts")
    while True:
        wide = with_goal(cuts, goals.select("src", "target")).filter(F.col("rest") > TOLERANCE * F.col("_g_target"))
        wide = wide.select("src", (F.col("rest") / 4).alias("limit"), "rest", F.element_at("steps", -1).alias("at"))
        left = with_goal(ranked, wide).filter((F.col("size") <= F.col("_g_limit")) & ~within(F.col("_g_at.cut"), F.col("_g_at.closed")))
        left = left.select("src", "size", "rank", "cell")
        if not wide.limit(1).count() or not left.limit(1).count():
            break
        further = with_goal(follow(left, wide.select("src", F.col("rest").alias("need"))), wide.select("src", "limit"))
        further = further.select("src", step(F.col("_g_limit")).alias("more"), "rest")
        both = with_goal(cuts, further)
        new = both.select("src", F.concat("steps", F.coalesce("_g_more", F.slice("steps", 1, 0))).alias("steps"), F.coalesce("_g_rest", "rest").alias("rest"))
        # a source for which nothing was left keeps what it has; no step is made twice, as each leaves at most a quarter or takes all that fits
        cuts = materialise(new, "mix-cuts")

    def taken_by(steps: Column) -> Column:
        return F.exists(steps, lambda s: (F.col("size") <= s["limit"]) & within(s["cut"], s["closed"]))

    # one more of those behind: of the size that is nearest to what is left, and of these the first in order
    behind = with_goal(ranked.select("src", "size", "rank"), cuts).filter(~taken_by(F.col("_g_steps")) & (F.col("size") < 2 * F.col("_g_rest")))
    off = F.abs(F.col("_g_rest") - F.col("size"))
    nearest = behind.groupBy("src").agg(F.min(F.struct(off.alias("off"), F.col("size"))).alias("best")).select("src", F.col("best.size").alias("best"))
    nearest = with_goal(behind.withColumnRenamed("_g_rest", "rest").select("src", "size", "rank", "rest"), nearest).filter(F.col("size") == F.col("_g_best"))
    nearest = nearest.groupBy("src", "rank").agg(F.sum("size").alias("size"), F.first("rest").alias("rest")).filter(F.abs(F.col("rest") - F.col("size")) < F.col("rest"))
    last = nearest.groupBy("src").agg(F.min(F.struct(F.abs(F.col("rest") - F.col("size")).alias("off"), "rank")).alias("best"))
    last = last.select("src", F.col("best.rank").alias("last"))

    final = with_goal(goals.drop("weight", "mass"), cuts.select("src", "steps")).withColumnRenamed("_g_steps", "steps")
    final = materialise(with_goal(final, last).withColumnRenamed("_g_last", "last"), "mix-plan")

    keep = but(docs, into)
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(source_col).alias("src"),
        word_count(F.col(text_col)).alias("size"),
        _draw(docs, id_col, text_col, seed).alias("draw"),
        own.alias("own"),
    )
    out = with_goal(out, final).withColumn("whole", whole).withColumn("rank", rank)
    taken = F.coalesce(taken_by(F.col("_g_steps")), F.lit(False)) | F.coalesce(F.col("rank") == F.col("_g_last"), F.lit(False))
    extra = open_to_more & taken
    copies = (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("int")
    out = out.withColumn("copies", copies)
    return out.select(
        *[F.col("_row")[c].alias(c) for c in keep],
        F.struct(
            F.col("size"),
            F.col("_g_words").alias("source_size"),
            F.col("_g_target").alias("target"),
            F.col("copies"),
            (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        ).alias(into),
    )
