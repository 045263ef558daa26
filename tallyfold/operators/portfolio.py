"""Positions, values, weights and their history.

Trades: account_id, instrument_id, trade_date, side ('BUY' or 'SELL'), quantity, signed_quantity, price and the
tie-breaks TIES, which order fills of one day. Prices: instrument_id, price_date, close.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.numeric import ratio, signed
from tallyfold.functions.packed import squeezed, unsqueezed
from tallyfold.operators.companies import observed
from tallyfold.sources.scratch import ship

TIES = ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
HOLDING = ("account_id", "instrument_id")
#: Years of prices that travel as one row.
YEARS = 30
#: Buckets of accounts for each shuffle partition (O10): a task works out one after the other.
BUCKETS = 8
#: Closes that a task packs or sums at once.
VALUES = 8_000_000


def trades(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """A row for each fill, joined on the order key. Returned lines are sells; the date is the order's."""
    side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    fills = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return fills.select(
        F.col("o_custkey").alias("account_id"), F.col("l_partkey").alias("instrument_id"), F.col("o_orderdate").alias("trade_date"), side.alias("side"),
        F.col("l_quantity").alias("quantity"), signed(side, F.col("l_quantity")).alias("signed_quantity"), ratio("l_extendedprice", "l_quantity").alias("price"), *TIES,
    )


def positions(fills: DataFrame, as_of: date | None = None) -> DataFrame:
    """Net quantity of each account and instrument up to as_of, without those that come to exactly zero."""
    seen = fills if as_of is None else fills.where(F.col("trade_date") <= F.lit(as_of))
    return seen.groupBy(*HOLDING).agg(F.sum("signed_quantity").alias("quantity")).where("quantity <> 0")


def latest_price(prices: DataFrame, as_of: date | None = None) -> DataFrame:
    """The close of the last date on or before as_of that has one."""
    seen = prices if as_of is None else prices.where(F.col("price_date") <= F.lit(as_of))
    return observed(seen).groupBy("instrument_id").agg(F.max_by("close", "price_date").alias("close"))


def market_value(held: DataFrame, latest: DataFrame) -> DataFrame:
    """Positions with close and value; null for instruments without a price."""
    return held.join(latest, "instrument_id", "left").select(*HOLDING, "quantity", "close", (F.col("quantity") * F.col("close")).alias("value"))


def weights(valued: DataFrame) -> DataFrame:
    """Value over the sum of absolute values in the account; null if that sum is 0 or the value is null."""
    gross = F.sum(F.abs("value")).over(Window.partitionBy("account_id"))
    return valued.select(*HOLDING, "value", ratio("value", gross).alias("weight"))


def concentration(weighted: DataFrame) -> DataFrame:
    """Holdings and the sum of squared weights (Herfindahl-Hirschman) of each account."""
    return weighted.groupBy("account_id").agg(F.count(F.lit(1)).alias("holdings"), F.sum(F.col("weight") * F.col("weight")).alias("hhi"))


def allocation(valued: DataFrame, companies: DataFrame) -> DataFrame:
    """Gross value by sector and industry, by sector, and in total; level is 0, 1 and 3 for these.

    level tells the total of a sector from an industry that is null.
    """
    own = companies.select("instrument_id", "sector", "industry")
    grouped = valued.join(own, "instrument_id", "left").rollup("sector", "industry")
    return grouped.agg(F.grouping_id().cast("int").alias("level"), F.sum(F.abs("value")).alias("gross_value"), F.count(F.lit(1)).alias("holdings"))


def running_position(fills: DataFrame) -> DataFrame:
    """Net quantity after each fill, in order of date and tie-breaks."""
    order = Window.partitionBy(*HOLDING).orderBy("trade_date", *TIES).rowsBetween(Window.unboundedPreceding, 0)
    return fills.select(*HOLDING, "trade_date", *TIES, "signed_quantity", F.sum("signed_quantity").over(order).alias("position"))


def price_as_of(fills: DataFrame, prices: DataFrame, bucket: str = "year") -> DataFrame:
    """Fills with the last close on or before the trade date; null if there is none.

    Each instrument is cut into buckets of time, so that one with most of the rows is no single task: the prices of
    a bucket are one row, with the last close of the buckets before, and a fill takes its close from that row. Buckets without prices have a row too, up to the last price of all, and later
    fills go by the last bucket. So fills are neither put in one order with prices nor sorted for more than the join.
    """
    start = lambda day: F.trunc(day, bucket)
    marks = observed(prices).withColumn("bucket", start("price_date"))
    # a date without a close may be the last, which only adds rows
    latest = start(prices.agg(F.max("price_date")).scalar())
    seen = F.sort_array(F.collect_list(F.struct(F.col("price_date").alias("day"), "close")))
    packed = marks.groupBy("instrument_id", "bucket").agg(seen.alias("seen")).withColumn("end", F.element_at("seen", -1)["close"])
    line = Window.partitionBy("instrument_id").orderBy("bucket")
    upto = F.coalesce(F.date_sub(F.lead("bucket").over(line), 1), latest)
    each = packed.withColumns({"before": F.lag("end").over(line), "upto": upto})
    each = each.withColumn("at", F.explode(F.sequence("bucket", "upto", F.expr(f"INTERVAL 1 {bucket}"))))
    own = F.col("at") == F.col("bucket")
    rows = each.select(F.col("instrument_id").alias("of"), "at", *(F.when(own, F.col(f"seen.{c}")).alias(f"{c}s") for c in ("day", "close")), F.when(own, F.col("before")).otherwise(F.col("end")).alias("before"))
    dated = fills.select("account_id", "instrument_id", "trade_date", *TIES, F.when(F.col("trade_date").isNotNull(), F.least(start("trade_date"), latest)).alias("bucket"))
    met = dated.join(rows, (F.col("instrument_id") == F.col("of")) & (F.col("bucket") == F.col("at")), "left")
    last = F.size(F.filter("days", lambda day: day <= F.col("trade_date"))) - 1
    return met.select("account_id", "instrument_id", "trade_date", *TIES, F.coalesce(F.get("closes", last), "before").alias("close"))


def _summed(account: np.ndarray, day: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each account, by its number, and day, in this order."""
    first = int(day.min())
    width = int(day.max()) - first + 1
    cell = account * width + (day - first)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    cell = cell[begin]
    return cell // width, cell % width + first, np.add.reduceat(value[order], begin)


def _together(arrays: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """The numbers of the values of all arrays, and the values by number; null is a value."""
    codes = pa.chunked_array(arrays).combine_chunks().dictionary_encode(null_encoding="encode")
    return codes.indices.to_numpy().astype(np.int64), codes.dictionary


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list of a column begins, with the end of the last, and the values of all."""
    return np.append(0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))), pc.list_flatten(column).to_numpy()


#: What is packed of the spans of a bucket, and what of each day of a span.
SPAN, DAY = {"sizes": np.int32, "year": np.int32, "position": np.float64}, {"days": np.int16, "closes": np.float64}


def _packed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A row for each bucket: the accounts of its spans, and what is packed of these and of their days."""
    table = pa.Table.from_batches(rows)
    # in order of accounts, which compress like that
    table = table.take(pc.sort_indices(table.select(["bucket", "account_id"]), [("bucket", "ascending"), ("account_id", "ascending")])).combine_chunks()
    begin, days = _lists(table["days"].combine_chunks())
    columns = {"sizes": np.diff(begin), "days": np.diff(days, prepend=days.dtype.type(0)), "closes": _lists(table["closes"].combine_chunks())[1]}
    buckets, first = np.unique(table["bucket"].to_numpy(), return_index=True)
    first = np.append(first, len(table))
    packed = [pa.array(buckets, pa.int32()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), table["account_id"].combine_chunks())]
    # the first day of a bucket is told in full
    columns["days"][begin[first[:-1]]] = days[begin[first[:-1]]]
    for kinds, cuts in ((SPAN, first), (DAY, begin[first])):
        for name, kind in kinds.items():
            column = columns[name] if name in columns else table[name].to_numpy()
            packed.append(pa.array([squeezed(column[a:b].astype(kind)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(packed, ["bucket", "accounts", *SPAN, *DAY])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans with their closes packed by buckets of accounts, VALUES closes at once, about."""
    rows, n = [], 0
    for batch in batches:
        if batch.num_rows:
            rows.append(batch)
            n += len(pc.list_flatten(batch.column("days")))
        if n > VALUES:
            yield _packed(rows)
            rows, n = [], 0
    if n:
        yield _packed(rows)


def _unpacked(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Account, day and value of each close of a packed row."""
    sizes, year, position, gaps, closes = (unsqueezed(row[c], kind) for c, kind in (SPAN | DAY).items())
    start = (year - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)
    day = np.cumsum(gaps, dtype=np.int64) + np.repeat(start, sizes)
    return row["accounts"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), day, closes * np.repeat(position, sizes)


def _valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of position times close by account and date; packed rows of a bucket follow each other."""
    bucket, parts, n = None, [], 0

    def merged() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        codes, accounts = _together([p[0] for p in parts])
        codes, day, value = _summed(codes, *(np.concatenate(c) for c in list(zip(*parts, strict=True))[1:]))
        return accounts.take(pa.array(codes)), day, value

    for batch in batches:
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at] for c in batch.schema.names}
            row = {c: v.values if c == "accounts" else v.as_py() for c, v in row.items()}
            if row["bucket"] != bucket:
                if parts:
                    yield _series(*merged())
                bucket, parts, n = row["bucket"], [], 0
            parts.append(_unpacked(row))
            n += len(parts[-1][1])
            # what has been summed is kept and doesn't count again
            if n > VALUES:
                parts, n = [merged()], 0
    if parts:
        yield _series(*merged())


def _series(account: pa.Array, day: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([account, pa.array(day.astype(np.int32)).cast(pa.date32()), pa.array(value)], ["account_id", "price_date", "value"])


def value_series(fills: DataFrame, prices: DataFrame, latest: Column | None = None) -> DataFrame:
    """Value of each account on each date on which an instrument that it holds is priced.

    The last running position of a day holds until the next day with a fill; spans at zero are left out. Spans are
    cut at the ends of each YEARS years, open ones up to the last price of all, and meet prices, one row for each instrument and these
    years, on both: what the range of dates then rejects lies within these years, however long the history is. The spans of a task travel to their accounts with the closes that they take,
    packed in one row for each bucket of accounts and VALUES closes, and only there these become rows: they are by far the most, and would be sorted and written as such.

    latest: a date that no price is later than; without it, it is looked up in prices, which are worked out once more for that.
    """
    ship(fills.sparkSession)
    # dealt once, by holdings, for the sums of days and what follows
    daily = fills.select(*HOLDING, "trade_date", "signed_quantity").repartition(*HOLDING).groupBy(*HOLDING, "trade_date").agg(F.sum("signed_quantity").alias("change"))
    order = Window.partitionBy(*HOLDING).orderBy("trade_date")
    held = F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = daily.select(*HOLDING, F.unix_date("trade_date").alias("since"), F.unix_date(F.lead("trade_date").over(order)).alias("until"), held.cast("double").alias("position")).where("position <> 0")
    start = lambda day: F.year(day) - F.pmod(F.year(day), F.lit(YEARS))
    marks = observed(prices).withColumn("year", start("price_date"))
    # days since the start of these years, in two bytes each
    first = lambda year: F.unix_date(F.make_date(F.col(year), F.lit(1), F.lit(1)))
    closes = F.sort_array(F.collect_list(F.struct((F.unix_date("price_date") - first("year")).cast("smallint").alias("day"), F.col("close").cast("double").alias("close"))))
    # dealt as rows: hardly two of an instrument are in one task before, and lists of one close each are larger
    packed = marks.select("instrument_id", "year", "price_date", "close").repartition("instrument_id", "year").groupBy("instrument_id", "year").agg(closes.alias("marks")).select("instrument_id", "year", F.col("marks.day").alias("days"), F.col("marks.close").alias("closes"))
    since = start(F.date_from_unix_date("since"))
    # a date without a close may be the last, which only adds rows
    latest = prices.agg(F.max("price_date")).scalar() if latest is None else latest
    end = F.coalesce(start(F.date_from_unix_date(F.col("until") - 1)), start(latest))
    years = F.when(end >= since, F.sequence(since, end, F.lit(YEARS)))
    met = spans.withColumn("year", F.explode(years)).join(packed, ["instrument_id", "year"])
    before = lambda day: F.size(F.filter("days", lambda d: d < F.col(day) - first("year")))
    met = met.withColumns({"at": before("since"), "to": F.when(F.col("until").isNull(), F.size("days")).otherwise(before("until"))}).where(F.col("to") > F.col("at"))
    bucket = F.pmod(F.xxhash64("account_id"), F.lit(BUCKETS * int(fills.sparkSession.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    taken = met.select("account_id", bucket.alias("bucket"), "year", "position", *(F.slice(c, F.col("at") + 1, F.col("to") - F.col("at")).alias(c) for c in ("days", "closes")))
    kind = fills.schema["account_id"].dataType.simpleString()
    dealt = taken.mapInArrow(_dealt, f"bucket int, accounts array<{kind}>, {', '.join(f'{c} binary' for c in (*SPAN, *DAY))}")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_valued, f"account_id {kind}, price_date date, value double")


def average_buy_cost(fills: DataFrame) -> DataFrame:
    """Mean price of what was bought, by quantity; null without buys."""
    bought = F.when(F.col("side") == "BUY", F.col("quantity"))
    grouped = fills.groupBy(*HOLDING).agg(F.sum(bought * F.col("price")).alias("spent"), F.sum(bought).alias("bought"))
    return grouped.select(*HOLDING, ratio("spent", "bought").alias("average_cost"))


def drift(weighted: DataFrame, targets: DataFrame, tol: float) -> DataFrame:
    """Weight less target where they differ by more than tol; what is missing on a side counts as 0."""
    both = weighted.select(*HOLDING, "weight").join(targets.select(*HOLDING, "target"), list(HOLDING), "full_outer")
    both = both.select(*HOLDING, F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("target", F.lit(0.0)).alias("target"))
    return both.withColumn("drift", F.col("weight") - F.col("target")).where(F.abs("drift") > tol)


def unpriced(held: DataFrame, prices: DataFrame) -> DataFrame:
    """Positions whose instrument has no price at all."""
    return held.join(observed(prices).select("instrument_id"), "instrument_id", "left_anti").select(*HOLDING, "quantity")
