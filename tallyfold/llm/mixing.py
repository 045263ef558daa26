"""Mixes sources to target weights by repeating documents.

Words are summed per source. Sources in code point order, null last, take the weights in turn. Together
they are to have `share` times all words; a source whose part would exceed `most` times its words stops there,
and the excess goes to the rest by weight until none is above. The rate of a source is its target over its
words. Each document is taken floor(rate) times, and once more where its lot, a hash of its identifier in [0, 1),
is below the fraction of the rate. As few long documents can carry most words of a source, a plain draw may land far
from the target (by a third for the smallest sources of the test tables). So the lots of a source are turned, all by
the same step of `turns` around the circle: under each turn a document has its extra copy with the probability of the
fraction, and the turn whose draw comes nearest to the target is used (ties: the lowest). A single aggregation finds it; reruns agree.

Documents are grouped by source with map-side sums, so a source with a third of the rows is no burden. Sources are
ranked and summed up in ranges, so that they may be as many as there are hosts. Few sources are broadcast to the documents, after a check of their
size; many are joined by a shuffle in which the rows of a large source are spread over tasks. Repeating is an explode in place.

Defined results: null text and null source are counted (size 0; the last source); rows that repeat an
identifier share its draw; sources without words have target 0 and rate 0; an empty table gives an empty result. mixture reads the
named columns alone, and mix keeps whole rows packed, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import in_order, is_small, n_words, packed, settle, spread

WEIGHTS = (5.0, 2.0, 1.0)
TURNS = 32


def lot(identifier: Column) -> Column:
    """A number in [0, 1) from the identifier, in steps of 2**-48."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(identifier.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def _drawn(lots: Column, turn: Column, turns: int, fraction: Column) -> Column:
    """Whether the turned lot is below the fraction; sums and differences are exact where turns is a power of 2."""
    turned = lots + turn / F.lit(float(turns))
    return F.when(turned >= 1, turned - 1).otherwise(turned) < fraction


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with weight and target."""
    if share > most:
        raise ValueError("the sources can't have more than most times their words")
    by_name = F.col("source").asc_nulls_last()
    placed = in_order(sizes.select("source", "source_size"), [by_name])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int") + 1)
    own = placed.select("source", "source_size", weight.alias("weight")).withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    # at a level t of words for each unit of weight, source i has min(most * size, t * weight)
    limit = most * F.col("source_size")
    summed = in_order(own, [F.col("full_at"), by_name], {"limit": limit, "weight": F.col("weight"), "size": F.col("source_size")})
    level = (F.col("size_all") * share - F.col("limit_before")) / (F.col("weight_all") - F.col("weight_before"))
    summed = settle(summed.withColumn("level", level))
    # the level is that of the first source, in that order, which it doesn't fill
    first = summed.agg(F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("_rank", "level")))["level"]).first()[0]
    target = limit if first is None else F.least(limit, F.lit(first) * F.col("weight"))
    return summed.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, turns: int = TURNS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, turn."""
    rows = _sized(docs, id_col, text_col, source_col)
    joined = _by_source(rows, plan(rows, weights, share, most, turns))
    copies = _copies(F.col("lot"), F.col("of.turn"), turns, F.col("of.rate"))
    return joined.select("doc_id", "source", "size", "of.source_size", "of.target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "of.turn")


def _by_source(rows: DataFrame, sources: DataFrame, lot: Column | None = None) -> DataFrame:
    """rows with `of`, the row of sources (settled) of their source. Rows are settled, or a number of each row is given as lot."""
    own = F.struct(*(sources[c] for c in sources.columns)).alias("of")
    if is_small(sources):
        few = F.broadcast(sources.select(own))
        return rows.join(few, rows["source"].eqNullSafe(few["of"]["source"]))
    key = {"none": F.col("source").isNull(), "name": F.coalesce(F.col("source").cast("string"), F.lit(""))}
    keyed = rows.withColumns(key)
    counts = settle(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    others = sources.select(*(c.alias(k) for k, c in key.items()), own)
    return spread(keyed, others, list(key), counts, "n", counts.agg(F.sum("n")).first()[0], lot=lot).drop(*key)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), lot(F.col(id_col)).alias("lot")))


def plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, turns: int) -> DataFrame:
    """One row per source: source, source_size, target, rate, turn. rows (settled): source, size, lot."""
    rates = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rates = settle(rates.select("source", "source_size", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate")))
    joined = _by_source(rows, rates).select("size", "lot", "of.*")
    fraction = F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(_drawn(F.col("lot"), F.lit(k), turns, fraction), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(turns)]
    drawn = joined.groupBy("source", "source_size", "target", "rate").agg(*extra)
    miss = [F.struct(F.abs(F.floor("rate") * F.col("source_size") + F.col(f"s{k}") - F.col("target")).alias("miss"), F.lit(k).alias("turn")) for k in range(turns)]
    return settle(drawn.withColumn("turn", F.array_min(F.array(*miss))["turn"]).select("source", "source_size", "target", "rate", "turn"))


def _copies(lots: Column, turn: Column, turns: int, rate: Column) -> Column:
    return (F.floor(rate) + F.when(_drawn(lots, turn, turns, rate - F.floor(rate)), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, turns: int = TURNS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs in their own columns, each row as often as the mix takes it."""
    own, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    rows = packed(docs).withColumn("source", F.col("row").getField(source_col))
    joined = _by_source(rows, plan(_sized(docs, id_col, text_col, source_col), weights, share, most, turns), F.xxhash64(own, text))
    copies = _copies(lot(own), F.col("of.turn"), turns, F.col("of.rate"))
    repeated = joined.select("row", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return repeated.select("row.*")
