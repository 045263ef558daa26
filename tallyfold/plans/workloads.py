"""Whole workloads, from tables to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import companies, opportunities, portfolio
from tallyfold.sources.tables import Tables

MIN_OBSERVATIONS = 10
LOOKBACK, SKIP = 10, 1


def fills(tables: Tables) -> DataFrame:
    return portfolio.trades(tables.table("orders"), tables.table("lineitem"))


def prices(tables: Tables) -> DataFrame:
    return companies.daily_prices(tables.fills())


def positions(tables: Tables) -> DataFrame:
    return portfolio.positions(fills(tables))


def valued(tables: Tables) -> DataFrame:
    return portfolio.market_value(positions(tables), portfolio.latest_price(prices(tables)))


def portfolio_concentration(tables: Tables) -> DataFrame:
    """How concentrated each portfolio is: trades, positions, prices, weights, then the sum of squares."""
    return portfolio.concentration(portfolio.weights(valued(tables)))


def returns(tables: Tables) -> DataFrame:
    return companies.returns(prices(tables))


def risk(tables: Tables) -> DataFrame:
    return companies.risk_summary(returns(tables), MIN_OBSERVATIONS)


def last_momentum(tables: Tables) -> DataFrame:
    """The momentum of the last date of each instrument."""
    found = opportunities.momentum(prices(tables), LOOKBACK, SKIP)
    return found.groupBy("instrument_id").agg(F.max_by("momentum", "price_date").alias("momentum"), F.max("price_date").alias("price_date"))


def metrics(tables: Tables) -> DataFrame:
    """Risk of each company with its sector."""
    return risk(tables).join(tables.companies().select("instrument_id", "sector"), "instrument_id")


def opportunity_rules() -> list[Column]:
    return [F.col("mean") > 0, F.col("observations") >= MIN_OBSERVATIONS]


def equal_targets(trades: DataFrame) -> DataFrame:
    """As targets, the same weight for each instrument that the account has ever traded."""
    traded = trades.select("account_id", "instrument_id").distinct()
    return traded.join(traded.groupBy("account_id").agg((1 / F.count(F.lit(1))).alias("target")), "account_id")
