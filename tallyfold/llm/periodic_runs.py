"""Stretches of words that repeat with a period, by a dictionary of basic factors.

A run is a stretch of consecutive words whose words `period` apart are identical, for the smallest such period, that is
at least `min_repeats` periods and `min_length` words long and that neither neighbouring word extends.

The dictionary names the factors of each power-of-two length L so that equal factors of a text have equal names: single
words first, then pairs of names L apart. For each L, an occurrence and its two successors that lie d and 2d behind it, with d
within 2L, are an arithmetic progression, which proposes the period d for the words that they cover. Proposals of one
period that touch are one stretch; stretches are extended word by word while the period holds, and those that
come out alike are one. A run of period q has a progression of distance q at each start that leaves 2q + L words of it, for the L with
q <= L < 2q, since a factor that is no shorter than a run's period recurs in it by multiples of the period; min_repeats is 4 at least
for that reason. The same L would have shown a shorter period if there were one, so a stretch that is long enough is proposed by its smallest period.
A factor that is alone in its text can't be part of a longer one that recurs, so few places are left after the first lengths of ordinary prose.

Everything is a map over texts: nothing is shuffled, and a batch of texts shares the sorts.

Defined results: null and empty texts have no words and no runs; repeated rows each give a row; an empty table gives an
empty result. A text is worked through whole, however long. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.common import WORD, n_words, release, ship

MIN_LENGTH = 6
MIN_REPEATS = 4
#: Words that are searched together; a longer text is searched alone.
STEP = 1 << 18
#: Characters that leave a task in one batch.
OUT = 1 << 24
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _by_name(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and ascending places, ordered by name and then place."""
    shift = int(places[-1]).bit_length()
    if int(names.max()).bit_length() + shift <= 63:
        # one number for both sorts many times as fast as an order of places
        both = np.sort((names << shift) | places)
        return both >> shift, both & ((1 << shift) - 1)
    order = np.argsort(names, kind="stable")
    return names[order], places[order]


def _progressions(names: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance and start of each progression of three occurrences; names are in order, and places within each."""
    gap = np.diff(places)
    gap[(names[1:] != names[:-1]) | (gap > 2 * length)] = 0
    at = np.flatnonzero((gap[1:] == gap[:-1]) & (gap[1:] > 0))
    return gap[at], places[at]


def _stretches(period: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of intervals [first, end), those of one period that touch put together."""
    order = np.lexsort((first, period))
    period, first, end = period[order], first[order], end[order]
    # periods lie apart, so that the ends of one never reach into the next
    base = np.cumsum(np.diff(period, prepend=period[:1]) > 0) * (int(end.max(initial=0)) + 2)
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(first), bool)
    new[1:] = (first + base)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return period[at], first[at], (reach - base)[np.append(at[1:], len(first)) - 1] if len(at) else end[:0]


def _extended(words: np.ndarray, period: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of places whose word recurs a period later, as far as they go to both sides."""
    first, end = first.copy(), end.copy()
    moving = np.arange(len(first))
    while len(moving := moving[first[moving] > 0]):
        before = first[moving] - 1
        moving = moving[words[before] == words[before + period[moving]]]
        first[moving] -= 1
    moving = np.arange(len(first))
    while len(moving := moving[end[moving] + period[moving] < len(words)]):
        after = end[moving]
        moving = moving[words[after] == words[after + period[moving]]]
        end[moving] += 1
    return first, end


def runs_of(words: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of all runs of a sequence of numbers, by start and then period.

    Sequences laid end to end are searched at once if they have no number in common.
    """
    if min_repeats < 4:
        raise ValueError("a run has four periods at least")
    n = len(words)
    name_of = np.zeros(n + 1, np.int64)
    names, places = words.astype(np.int64), np.arange(n, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    length = 1
    while len(places):
        names, places = _by_name(names, places)
        gap, at = _progressions(names, places, length)
        # the words of the first and of the second occurrence recur gap later; what one length proposes is put together at once
        at = np.concatenate([at, at + gap])
        found.append(_stretches(np.concatenate([gap, gap]), at, at + length))
        new = np.ones(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        again = ~(new & np.append(new[1:], True))
        name_of[places[again]] = np.cumsum(new)[again]
        places = np.sort(places[again])
        kept, later = name_of[places], name_of[np.minimum(places + length, n)]
        name_of[places] = 0
        goes = later > 0
        shift = int(later.max(initial=0)).bit_length()
        places, names = places[goes], (kept[goes] << shift) | later[goes]
        length *= 2
    period, first, end = _stretches(*(np.concatenate([f[i] for f in found] or [words[:0]]).astype(np.int64) for i in range(3)))
    first, end = _extended(words, period, first, end)
    size = end - first + period
    enough = (size >= min_length) & (size >= min_repeats * period)
    runs = np.unique(np.stack([first, period, size])[:, enough], axis=1)
    return runs[0], runs[2], runs[1]


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """words without those that a run has after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def _searched(texts: list[list[bytes]], min_length: int, min_repeats: int) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Runs and kept words of each of some texts, given in words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers = np.empty(int(sizes.sum()), np.int64)
    held = at = 0
    for words in texts:
        own: dict[bytes, int] = {}
        numbers[at : at + len(words)] = [own.setdefault(w, len(own)) for w in words]
        numbers[at : at + len(words)] += held
        held, at = held + len(own), at + len(words)
    start, length, period = runs_of(numbers, min_length, min_repeats)
    begins = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(start, np.append(begins, at))
    for i, words in enumerate(texts):
        own = slice(cuts[i], cuts[i + 1])
        if own.start == own.stop:
            yield [], words
        else:
            first = start[own] - begins[i]
            yield list(zip(first.tolist(), length[own].tolist(), period[own].tolist(), strict=True)), _collapsed(words, first, length[own], period[own])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period by start and then period) and collapsed.

    collapsed has the words that no run holds after its first period, joined by one space.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([texts.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType())])
    schema = to_arrow_schema(out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, rows, step, held, size = 0, [], [], 0, 0

            def flush(step: list, rows: list) -> None:
                for words, (runs, kept) in zip(step, _searched(step, min_length, min_repeats), strict=True):
                    rows.append((len(words), runs, b" ".join(kept).decode()))

            def made(first: int, rows: list) -> pa.RecordBatch:
                columns = zip(*rows, strict=True)
                runs = lambda v: [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in v]
                n, found, kept = columns
                return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array(n, pa.int64()), pa.array(runs(found), schema.field("runs").type), pa.array(kept, schema.field("collapsed").type)], schema=schema)

            for text in batch.column(1):
                step.append((text.as_py() or "").encode().split())
                held, size = held + len(step[-1]), size + len(text.as_py() or "")
                if held >= STEP:
                    flush(step, rows)
                    step, held = [], 0
                    if size >= OUT:
                        yield made(first, rows)
                        first, rows, size = first + len(rows), [], 0
            if step:
                flush(step, rows)
            if rows:
                yield made(first, rows)
        release()

    return texts.mapInArrow(search, out)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where the text of each tenth identifier by its CRC-32 (h) repeats its words from some word on.

    With n words and g = floor(h / 10), each word i >= a becomes word a + (i - a) % p, for a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). Texts without words and rows without an identifier stay as they are.
    """
    text = F.col(text_col).cast("string")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), h.alias("h"), F.when(h % 10 == 0, n_words(text)).alias("n"))
    g, words = F.floor(F.col("h") / 10), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    a = g % F.col("n")
    rest = F.col("n") - a
    p = 1 + F.floor(rest / (3 + g % 8))
    whole = lambda c: c.cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, whole(a + 1), whole(p)), whole(F.ceil(rest / p))))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), whole(a)), F.slice(again, F.lit(1), whole(rest))), " ")
    return own.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def digested(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without runs) and digests of all runs and of the kept words."""
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    line = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return own.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
