"""Profit of what was closed, and cost of what is held.

Trades as in portfolio. A fill first closes what is held the other way, and opens with what is left of it; so a
holding may cross from long to short in one fill. Fills of one day follow in the order of TIES, then quantity and price. Quantities are taken to
PLACES places, so that sums of them are exact; fills without a quantity don't count. Spans of `bucket` (a unit of trunc) cut holdings with many fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.ordered import recurrence, running_sums
from tallyfold.operators.portfolio import HOLDING, TIES
from tallyfold.sources.scratch import settle

PLACES = 6
EXACT = f"decimal(24, {PLACES})"
SUM = f"decimal(34, {PLACES})"
ORDER = ["trade_date", *TIES, "change", "price"]
#: Openings and closings of a holding that are matched in one go, about.
ROWS = 10_000
#: Fills of a holding that a task puts in order.
MANY = 5_000


def _own(fills: DataFrame) -> DataFrame:
    return fills.where("signed_quantity IS NOT NULL").select(*HOLDING, "trade_date", *TIES, F.col("signed_quantity").cast(EXACT).alias("change"), "price")


def _sizes(held: DataFrame) -> DataFrame:
    size = F.abs("change").cast(SUM)
    closed = F.when(F.signum(F.col("change").cast("double")) * F.signum(F.col("held").cast("double")) < 0, F.least(size, F.abs("held").cast(SUM))).otherwise(F.lit(0).cast(SUM))
    return held.withColumn("closed", closed.cast(SUM)).withColumn("opened", (size - F.col("closed")).cast(SUM))


def _moved(fills: DataFrame, bucket: str) -> DataFrame:
    """Fills with change (signed), held (before the fill), closed and opened (sizes)."""
    return _sizes(running_sums(_own(fills), list(HOLDING), ORDER, {"held": F.col("change").cast(SUM)}, F.trunc("trade_date", bucket)))


def _whole(fills: DataFrame) -> DataFrame:
    """As _moved, for holdings that a task can sort."""
    before = Window.partitionBy(*HOLDING).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum(F.col("change").cast(SUM)).over(before).cast(SUM), F.lit(0).cast(SUM))
    return _sizes(_own(fills).withColumn("held", held))


def _both_ways(fills: DataFrame) -> DataFrame:
    """Fills of the holdings that have buys and sells; nothing is closed in others."""
    sign = F.signum("signed_quantity")
    ways = fills.where("signed_quantity IS NOT NULL").groupBy(*HOLDING).agg(F.min(sign).alias("low"), F.max(sign).alias("high")).where("low < 0 AND high > 0")
    return fills.join(ways.select(*(F.col(c).alias(f"of_{c}") for c in HOLDING)), _same(list(HOLDING)), "left_semi")


def _intervals(fills: DataFrame, bucket: str) -> DataFrame:
    """A row for each opening and closing: holding, long, opens, and [since, until), its place among the openings or closings of its kind."""
    # read twice by the sums
    moved = settle(_moved(_both_ways(fills), bucket))
    buys, none = F.col("change") > 0, F.lit(0).cast(SUM)
    kinds = [("lo", buys, "opened"), ("lc", ~buys, "closed"), ("so", ~buys, "opened"), ("sc", buys, "closed")]
    summed = running_sums(moved, list(HOLDING), ORDER, {n: F.when(c, F.col(s)).otherwise(none) for n, c, s in kinds}, F.trunc("trade_date", bucket))
    of = lambda is_long, opens, since, size: F.struct(is_long.alias("long"), F.lit(opens).alias("opens"), since.alias("since"), size.alias("size"))
    both = F.array(of(buys, True, F.when(buys, F.col("lo")).otherwise(F.col("so")), F.col("opened")), of(~buys, False, F.when(buys, F.col("sc")).otherwise(F.col("lc")), F.col("closed")))
    each = summed.select(*HOLDING, "trade_date", "price", F.explode(both).alias("of")).where("of.size > 0")
    return each.select(*HOLDING, "of.long", "of.opens", "of.since", (F.col("of.since") + F.col("of.size")).cast(SUM).alias("until"), "trade_date", "price")


def fifo_matches(fills: DataFrame, bucket: str = "month") -> DataFrame:
    """What closed what: holding, side (LONG or SHORT, of what was held), quantity, opened_on, open_price, closed_on, close_price and profit.

    Lots close in the order in which they were opened. Laid end to end, the openings of a side and its closings cover the same line
    of quantities from 0 on, and a lot is matched with a closing where they overlap. Both are walked as one sequence of starts that
    carries the last opening and closing along: between two starts neither changes. Nothing is joined pair by pair, and holdings that were
    only bought or only sold leave first. A holding with many
    fills is cut along the line into parts of about ROWS starts; each takes over the last opening and closing of the parts before.
    profit is null where a price is.
    """
    side = [*HOLDING, "long"]
    # read three times: for the sizes, the ends of parts and the walk
    starts = settle(_intervals(fills, bucket))
    sizes = starts.groupBy(*side).agg((1 + F.floor(F.count(F.lit(1)) / ROWS)).alias("parts"), F.max("until").cast("double").alias("total"))
    own = starts.join(sizes.select(*(F.col(c).alias(f"of_{c}") for c in side), "parts", "total"), _same(side))
    part = F.least(F.floor(F.col("since").cast("double") / F.col("total") * F.col("parts")), F.col("parts") - 1).cast("long")
    lot = F.struct("until", "trade_date", "price")
    own = own.select(*side, part.alias("part"), "since", "opens", F.when(F.col("opens"), lot).alias("open"), F.when(~F.col("opens"), lot).alias("close"))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    at = F.struct("since", (~F.col("opens")).alias("closes"))
    ends = own.groupBy(*side, "part").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("open", "close")), F.min("since").alias("begins"))
    parts = Window.partitionBy(*side).orderBy("part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(c).alias(f"of_{c}") for c in (*side, "part")), last("open", earlier).alias("open_before"), last("close", earlier).alias("close_before"), F.lead("begins").over(parts).alias("next_part"))
    walk = Window.partitionBy(*side, "part").orderBy("since", F.col("opens").desc())
    upto = walk.rowsBetween(Window.unboundedPreceding, 0)
    walked = own.join(ends, _same([*side, "part"])).select(*side, "since", F.coalesce(last("open", upto), "open_before").alias("open"), F.coalesce(last("close", upto), "close_before").alias("close"), F.coalesce(F.lead("since").over(walk), "next_part").alias("following"))
    met = walked.withColumn("size", F.least("following", "open.until", "close.until") - F.col("since")).where("open IS NOT NULL AND close IS NOT NULL AND size > 0")
    quantity, gain = F.col("size").cast("double"), F.col("close.price") - F.col("open.price")
    return met.select(
        *HOLDING, F.when(F.col("long"), "LONG").otherwise("SHORT").alias("side"), quantity.alias("quantity"), F.col("open.trade_date").alias("opened_on"), F.col("open.price").alias("open_price"),
        F.col("close.trade_date").alias("closed_on"), F.col("close.price").alias("close_price"), (quantity * F.when(F.col("long"), gain).otherwise(-gain)).alias("profit"),
    )


def _same(names: list[str]) -> Column:
    """Null-safe equality of columns with those of the other side, which are prefixed by of_."""
    same = F.lit(True)
    for name in names:
        same &= F.col(name).eqNullSafe(F.col(f"of_{name}"))
    return same


def realised_profit(matches: DataFrame) -> DataFrame:
    """Profit of each holding, over its matches: closed (quantity), matches, profit; null profits are left out of the sum."""
    return matches.groupBy(*HOLDING).agg(F.sum("quantity").alias("closed"), F.count(F.lit(1)).alias("matches"), F.sum("profit").alias("profit"))


def average_cost(fills: DataFrame, bucket: str = "month") -> DataFrame:
    """Position after each fill and the moving average of what it cost: holding, trade_date, TIES, position, average_cost.

    What opens is averaged in by quantity, what closes leaves the average as it is, and a fill that crosses starts
    anew at its own price; null where nothing is held, and from a fill without a price on until all of it is closed. The cost c = |position| * average obeys c' = (1 - closed / held) * c +
    opened * price, a linear map for each fill, and composing maps is associative. Holdings of more than MANY fills are cut into
    spans, which are composed on their own and joined in order; the others, mostly all, are dealt once and composed whole.
    """
    counts = fills.where("signed_quantity IS NOT NULL").groupBy(*HOLDING).agg(F.count(F.lit(1)).alias("n"))
    # one for each MANY fills at most
    large = settle(counts.where(F.col("n") > MANY).select(*(F.col(c).alias(f"of_{c}") for c in HOLDING)))
    if large.isEmpty():
        return _costs(_whole(fills), bucket, False)
    few, many = (fills.join(F.broadcast(large), _same(list(HOLDING)), how) for how in ("left_anti", "left_semi"))
    both = _costs(_whole(few), bucket, False).unionByName(_costs(_moved(many, bucket), bucket, True))
    # the fills of a large holding are dealt over all tasks again
    return both.repartition(*HOLDING, "trade_date")


def _costs(moved: DataFrame, bucket: str, cut: bool) -> DataFrame:
    zero = F.col("held") == 0
    left = F.when(zero, F.lit(1.0)).otherwise((F.abs("held") - F.col("closed")).cast("double") / F.abs("held").cast("double"))
    # rests of a sum of doubles don't outlive a position that comes to zero
    spent = F.col("opened").cast("double") * F.coalesce("price", F.lit(0.0))
    unknown = F.col("opened").cast("double") * F.col("price").isNull().cast("double")
    scale = F.when(zero, F.lit(0.0)).otherwise(left)
    span = F.trunc("trade_date", bucket) if cut else None
    costs = recurrence(moved, list(HOLDING), ORDER, scale, {"cost": spent, "missing": unknown}, span)
    position = (F.col("held") + F.col("change")).cast("double")
    average = F.when((position != 0) & (F.col("missing") == 0), F.col("cost") / F.abs(position))
    return costs.select(*HOLDING, "trade_date", *TIES, position.alias("position"), average.alias("average_cost"))
