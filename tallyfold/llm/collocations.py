r"""Phrases whose words come together more than their frequencies suggest, by best-first growth of phrases.

A phrase is 2 to 4 words in a row within a piece of a text (pieces end at BREAKS). f counts all its occurrences in the texts of a language, overlapping
ones too. A candidate has f of at least `min_count`; cut after k words it scores floor(2,000,000 * f / (f(first part) + f(rest))), and its
lowest cut counts. It is dropped where a longer candidate contains it with at least `contained` percent of its occurrences.

Growth. All frequent pairs are counted. A phrase that starts with first word x and a prefix of count a scores at most
floor(2,000,000 * a / (f(x) + a)), however it goes on: its count is a at most, and so is the score of its first cut, whose
rest occurs as often as the phrase at least. So pairs and triples are a frontier in the order of this bound. In each round, every
language has a score down to which it is settled: all of its frontier with a bound as high is expanded, that is its
continuations to the right are counted, and those to the left of all candidates that score as much. What a bound rules out can't
score as much, nor can anything grown from it, so all candidates above the score are known, and what drops
them as well, since a longer phrase that contains one contains it with one neighbour more. A language is done when
as many candidates as are asked for survive at or above its score, so that ties of the last one are all known; else the next
round goes to the score of four times as many of its pairs, and at last to 0.

How it runs. Texts are cut once into blocks of numbered words with the hash of each word's language and spelling; blocks are settled
and each count is a map over them. Distinct phrases of a block are counted in the block, and summed by Spark over blocks. Words and phrases go
by 64-bit hashes of words; the table of all distinct words shows whether two share one (then all begins again with another salt), so counts are
exact. Tasks know which phrases to count by bitmaps of at most 2 ** BITS bits: what a bitmap lets through in excess is
counted as well and left out by joins, so nothing depends on its size but speed.

Defined results: null texts are empty; a null language is `und`; a text without frequent phrases gives nothing; repeated rows count as often as they
occur; an empty table gives an empty result. Only the two named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import mix, pack, release, settle, ship, shuffle_partitions, small, unpack

MIN_COUNT = 30
TOP = 2000
CONTAINED = 80
SCALE = 2_000_000
#: Words of a block.
BLOCK_WORDS = 1 << 20
#: Bits of the largest bitmap, as a power of two; 8 MB.
BITS = 26
SEGMENT = 1 << 16
#: Rows that leave a task in one batch.
OUT_ROWS = 1 << 17
#: Bytes that end a piece, and what they become: a byte that no text has.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_END = b"\xff"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + BREAKS, b"abcdefghijklmnopqrstuvwxyz " + _END * len(BREAKS))
WORDS = ("w1", "w2", "w3", "w4")


def pieces_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased in A-Z, with a mark at the end of each piece."""
    return (text or "").encode().translate(_PLAIN).replace(_END, b" \xff ").split()


class _Numbers(dict):
    """Numbers of a language's words, in a count that all languages of a block share."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = n = len(self.words)
        return n


_BLOCK = [("codes", pa.binary()), ("hashes", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]


def _numbered(salt: int):
    schema = pa.schema(_BLOCK)

    def block(codes: list[int], known: dict[str, _Numbers], words: list[bytes]) -> pa.RecordBatch:
        flat = np.array(codes, np.uint32)
        langs, hashes = [""] * len(words), np.zeros(len(words), np.uint64)
        for lang, own in known.items():
            head = lang.encode() + _END
            for word, n in own.items():
                if n:
                    langs[n - 1], hashes[n - 1] = lang, xxhash.xxh3_64_intdigest(head + word, salt)
        counts = np.bincount(flat, minlength=len(words) + 1)[1:]
        columns = [[pack(flat)], [hashes.view(np.int64)], [langs], [[w.decode() for w in words]], [counts]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[int] = []
        words: list[bytes] = []
        known: dict[str, _Numbers] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in known:
                    known[lang] = _Numbers(words)
                    # the mark is no word
                    known[lang][_END] = 0
                codes += map(known[lang].__getitem__, pieces_of(text.as_py()))
                codes.append(0)
                if len(codes) >= BLOCK_WORDS:
                    yield block(codes, known, words)
                    codes, words, known = [], [], {}
        if words:
            yield block(codes, known, words)
        release()

    return number


def phrase_key(hashes: list[np.ndarray]) -> np.ndarray:
    """A hash of phrases, from those of their words in order."""
    key = mix(hashes[0])
    for h in hashes[1:]:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h)
    return key


def _set_bits(bits: int):
    schema = pa.schema([("segment", pa.int32()), ("data", pa.binary())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            place = phrase_key([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]) >> np.uint64(64 - bits)
            np.bitwise_or.at(own, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        for i in range(0, len(own), SEGMENT):
            if own[i : i + SEGMENT].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SEGMENT], pa.int32()), pa.array([own[i : i + SEGMENT].tobytes()])], schema=schema)

    return fill


def _merged(table: pa.Table) -> pa.Table:
    parts = (np.frombuffer(d.as_buffer(), np.uint8) for d in table["data"])
    return pa.table({"segment": table["segment"][:1], "data": [reduce(np.bitwise_or, parts).tobytes()]}, schema=table.schema)


class Bitmap:
    """Hashed phrases as bits: has() is true for all phrases that were put in, and for few others."""

    def __init__(self, phrases: DataFrame) -> None:
        """phrases: settled rows of word hashes. At most 2 ** BITS bits come to the driver, merged beforehand, and go to the tasks."""
        spark = phrases.sparkSession
        self.n = phrases.count()
        self.bits = min(BITS, max(16, (16 * self.n).bit_length()))
        kind = "segment int, data binary"
        few = phrases.coalesce(shuffle_partitions(spark)).mapInArrow(_set_bits(self.bits), kind)
        data = np.zeros(1 << (self.bits - 3), np.uint8)
        for row in few.groupBy("segment").applyInArrow(_merged, kind).collect() if self.n else []:
            data[row.segment * SEGMENT :][: len(row.data)] = np.frombuffer(row.data, np.uint8)
        self.shared = spark.sparkContext.broadcast(data.tobytes())

    def has(self, key: np.ndarray) -> np.ndarray:
        data = np.frombuffer(self.shared.value, np.uint8)
        place = key >> np.uint64(64 - self.bits)
        return (data[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "shared": self.shared}


def _distinct(codes: np.ndarray, at: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the number of the distinct phrases of n words at some places."""
    ids = codes[at]
    for k in range(1, n):
        ids = ids * size + codes[at + k]
        if k < n - 1:
            ids = np.unique(ids, return_inverse=True)[1]
    order = np.argsort(ids)
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
    return at[order[first]], np.diff(np.append(first, len(ids)))


def _phrases(n: int, words: Bitmap, pairs: Bitmap | None, left: Bitmap | None, right: Bitmap | None, whole: Bitmap | None) -> Callable:
    schema = pa.schema([*((w, pa.int64()) for w in WORDS[:n]), ("n", pa.int64())])

    def chosen(codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Places where a phrase to be counted starts."""
        good = np.append(False, words.has(phrase_key([hashes[1:]])))[codes]
        at = np.flatnonzero(reduce(np.logical_and, (good[k : len(good) - n + 1 + k] for k in range(n))) if len(good) >= n else good[:0])
        if pairs is not None:
            two = np.flatnonzero(good[:-1] & good[1:])
            frequent = np.zeros(len(codes), bool)
            frequent[two[pairs.has(phrase_key([hashes[codes[two]], hashes[codes[two + 1]]]))]] = True
            at = at[reduce(np.logical_and, (frequent[at + k] for k in range(n - 1)))]
        key = lambda first, m: phrase_key([hashes[codes[at + first + k]] for k in range(m)])
        if whole is not None:
            return at[whole.has(key(0, n))]
        if left is not None:
            at = at[left.has(key(0, n - 1)) | right.has(key(1, n - 1))]
        return at

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, own in zip(batch.column(0), batch.column(1), strict=True):
                codes = unpack(packed.as_py(), np.uint32).astype(np.int64)
                hashes = np.append(np.uint64(0), own.values.to_numpy(zero_copy_only=False).view(np.uint64))
                at, counts = _distinct(codes, chosen(codes, hashes), n, len(hashes))
                for i in range(0, len(at), OUT_ROWS):
                    part = at[i : i + OUT_ROWS]
                    columns = [hashes[codes[part + k]].view(np.int64) for k in range(n)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(counts[i : i + OUT_ROWS])], schema=schema)
        release()

    return count


def _counted(blocks: DataFrame, n: int, min_count: int, words: Bitmap, pairs: Bitmap | None = None, left: Bitmap | None = None, right: Bitmap | None = None, whole: Bitmap | None = None) -> DataFrame:
    """w1 to wn and n of frequent phrases of n words; words and pairs: all frequent ones; left, right: phrases to continue to the right and to the left."""
    kind = ", ".join(f"{w} long" for w in (*WORDS[:n], "n"))
    each = blocks.select("codes", "hashes").mapInArrow(_phrases(n, words, pairs, left, right, whole), kind)
    return settle(each.groupBy(*WORDS[:n]).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def score(f: str, first: str, rest: str) -> Column:
    """floor(SCALE * f / (first + rest)), in two steps that stay exact in 64 bits for counts up to 4 * 10 ** 15."""
    step, both = 2000, f"({first} + {rest})"
    return F.expr(f"({f} * {step}) div {both} * {SCALE // step} + (({f} * {step}) % {both} * {SCALE // step}) div {both}")


def _lowest(f: str, cuts: list[tuple[str, str]]) -> Column:
    """The lowest-scoring cut, of ties the first: score, place, l, r."""
    return F.array_min(F.array(*(F.struct(score(f, a, b).alias("score"), F.lit(k).alias("place"), F.col(a).alias("l"), F.col(b).alias("r")) for k, (a, b) in enumerate(cuts))))


def _words(blocks: DataFrame) -> DataFrame:
    """h, lang, word and f of all distinct words."""
    each = blocks.select(F.explode(F.arrays_zip("hashes", "langs", "words", "counts")).alias("w"))
    each = each.select(F.col("w.hashes").alias("h"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    return settle(each.groupBy("h", "lang", "word").agg(F.sum("n").alias("f")))


def _cut_into_blocks(docs: DataFrame, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """Blocks, and their distinct words with hashes of which no two are alike."""
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    salt = 0
    while True:
        blocks = settle(own.mapInArrow(_numbered(salt), "codes binary, hashes array<long>, langs array<string>, words array<string>, counts array<long>"))
        words = _words(blocks)
        if words.groupBy("h").count().where("count > 1").isEmpty():
            return blocks, words
        salt += 1


def _pairs(counted: DataFrame, words: DataFrame) -> DataFrame:
    """Frequent pairs with lang, f1, f2, score and bound."""
    one = words.select(F.col("h").alias("w1"), "lang", F.col("f").alias("f1"))
    two = words.select(F.col("h").alias("w2"), F.col("f").alias("f2"))
    return settle(counted.join(one, "w1").join(two, "w2").withColumn("best", _lowest("n", [("f1", "f2")])).withColumn("bound", score("n", "f1", "n")))


def _triples(counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triples with lang, f1, f12, best and bound; bound is their own, first_bound that of the pair they grow from."""
    first = pairs.select("w1", "w2", "lang", "f1", F.col("n").alias("f12"), F.col("bound").alias("first_bound"))
    last = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("n").alias("f23"), F.col("f2").alias("f3"))
    joined = counted.join(first, ["w1", "w2"]).join(last, ["w2", "w3"])
    return joined.withColumn("best", _lowest("n", [("f1", "f23"), ("f12", "f3")])).withColumn("bound", score("n", "f1", "n")).drop("f23", "f3")


def _fours(counted: DataFrame, triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Phrases of four words with lang, f1 and best of the two later cuts."""
    first = triples.select("w1", "w2", "w3", "lang", "f1", "f12", F.col("n").alias("f123"), F.col("bound").alias("first_bound"))
    last = pairs.select(F.col("w1").alias("w3"), F.col("w2").alias("w4"), F.col("n").alias("f34"), F.col("f2").alias("f4"))
    joined = counted.join(first, ["w1", "w2", "w3"]).join(last, ["w3", "w4"])
    return joined.withColumn("later", _lowest("n", [("f12", "f34"), ("f123", "f4")])).drop("f12", "f123", "f34", "f4")


def _contained_in(longer: DataFrame, n: int) -> DataFrame:
    """w1 to wn of phrases and most, the largest count of a longer one that contains them with one neighbour more."""
    left = longer.select(*WORDS[:n], "n")
    right = longer.select(*(F.col(a).alias(b) for a, b in zip(WORDS[1 : n + 1], WORDS[:n], strict=True)), "n")
    return left.union(right).groupBy(*WORDS[:n]).agg(F.max("n").alias("most"))


def _surviving(phrases: DataFrame, longer: DataFrame, n: int, contained: int) -> DataFrame:
    joined = phrases.join(_contained_in(longer, n), [*WORDS[:n]], "left")
    return joined.where(F.coalesce(100 * F.col("most") < contained * F.col("n"), F.lit(True)))


class _Search:
    """Blocks, what has been counted so far, and down to which score each language is settled."""

    def __init__(self, docs: DataFrame, text_col: str, lang_col: str, min_count: int, contained: int) -> None:
        self.min_count, self.contained = min_count, contained
        self.blocks, self.vocabulary = _cut_into_blocks(docs, text_col, lang_col)
        self.words = settle(self.vocabulary.where(F.col("f") >= min_count))
        self.word_map = Bitmap(self.words.select("h"))
        self.pairs = _pairs(_counted(self.blocks, 2, min_count, self.word_map), self.words)
        self.pair_map = Bitmap(self.pairs.select("w1", "w2"))
        self.triples = self.fours = None
        down = Window.partitionBy("lang").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
        # a row for each score that occurs, at most SCALE / 2 + 1 of a language
        self.scores = settle(self.pairs.groupBy("lang", F.col("best.score").alias("score")).agg(F.count(F.lit(1)).alias("n")).withColumn("above", F.sum("n").over(down)))

    def levels(self, k: int, open_: DataFrame) -> DataFrame:
        """lang, level and last: the score of the k-th pair (0 where there are fewer), and the level before."""
        found = self.scores.where(F.col("above") >= k).groupBy("lang").agg(F.max("score").alias("level"))
        return settle(open_.join(found, "lang", "left").select("lang", F.coalesce("level", F.lit(0)).alias("level"), "last"))

    def _new(self, phrases: DataFrame, levels: DataFrame, by: str, n: int) -> DataFrame:
        """Phrases whose score or bound lies in this round's range."""
        joined = phrases.join(small(levels), "lang").where((F.col(by) >= F.col("level")) & (F.col(by) < F.col("last")))
        return settle(joined.select(*WORDS[:n]))

    def _count(self, n: int, grown: DataFrame, levels: DataFrame) -> DataFrame:
        """Continuations of what is new in the frontier, of n - 1 words each."""
        left, right = (Bitmap(self._new(grown, levels, by, n - 1)) for by in ("bound", "best.score"))
        found = _counted(self.blocks, n, self.min_count, self.word_map, self.pair_map, left, right)
        for used in (left, right):
            used.shared.unpersist()
        return found

    def _with(self, known: DataFrame | None, found: DataFrame, n: int) -> DataFrame:
        """What was counted before and now; a phrase that was counted twice has the same count."""
        return found if known is None else settle(known.union(found).groupBy(*WORDS[:n]).agg(F.max("n").alias("n")))

    def round(self, levels: DataFrame) -> DataFrame:
        """All that survive at or above the level of each language: w1 to w4 (null beyond the phrase), n, lang, best."""
        at = small(levels.select("lang", "level"))
        self.triples = self._with(self.triples, self._count(3, self.pairs, levels), 3)
        triples = settle(_triples(self.triples, self.pairs))
        grown = triples.join(at, "lang").where("first_bound >= level").drop("level")
        self.fours = self._with(self.fours, self._count(4, grown, levels), 4)
        # the first cut of four words needs the count of the last three, which needn't have been grown
        fours = settle(_fours(self.fours, triples, self.pairs).join(at, "lang").where("first_bound >= level AND later.score >= level"))
        last = [F.col(a).alias(b) for a, b in zip(WORDS[1:], WORDS[:3], strict=True)]
        asked = settle(fours.select(*last).distinct().join(self.triples, list(WORDS[:3]), "left_anti"))
        counts = self.triples
        if not asked.isEmpty():
            whole = Bitmap(asked)
            counts = counts.union(_counted(self.blocks, 3, self.min_count, self.word_map, self.pair_map, whole=whole).join(asked, list(WORDS[:3]), "left_semi"))
            whole.shared.unpersist()
        rest = counts.select(*(F.col(a).alias(b) for a, b in zip(WORDS[:3], WORDS[1:], strict=True)), F.col("n").alias("f234"))
        fours = fours.join(rest, list(WORDS[1:])).withColumn("first", _lowest("n", [("f1", "f234")]))
        # of ties the first cut, which has place 0 in both
        fours = fours.withColumn("best", F.when(F.col("first.score") <= F.col("later.score"), F.col("first")).otherwise(F.col("later")))
        high = lambda df: df.join(at, "lang").where("best.score >= level")
        parts = [
            _surviving(high(self.pairs), self.triples, 2, self.contained),
            _surviving(high(grown), self.fours, 3, self.contained),
            high(fours.drop("level")),
        ]
        row = lambda n: [*WORDS[:n], *(F.lit(None).cast("long").alias(w) for w in WORDS[n:])]
        return settle(reduce(DataFrame.unionByName, (p.select(*row(n), "n", "lang", "best") for n, p in enumerate(parts, 2))))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, contained: int = CONTAINED) -> DataFrame:
    """The best `top` phrases of each language: lang, rank, phrase, a (its count), l, r (those of its parts), n (of all words), score.

    In order of score, count (both descending) and phrase (by code point).
    """
    ship(docs.sparkSession)
    search = _Search(docs, text_col, lang_col, min_count, contained)
    highest = SCALE // 2 + 1
    open_ = search.pairs.select("lang").distinct().withColumn("last", F.lit(highest))
    done, k = [], 2 * top
    while True:
        levels = search.levels(k, open_)
        if levels.isEmpty():
            break
        found = search.round(levels)
        counted = levels.join(found.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "left")
        settled = settle(counted.withColumn("settled", (F.col("level") == 0) | (F.coalesce("n", F.lit(0)) >= top)).select("lang", "level", "settled"))
        done.append(found.join(small(settled.where("settled").select("lang")), "lang", "left_semi"))
        open_ = settled.where("NOT settled").select("lang", F.col("level").alias("last"))
        k *= 4
    return _ranked(done, search, top)


def _ranked(done: list[DataFrame], search: _Search, top: int) -> DataFrame:
    blank = search.pairs.limit(0).select(*WORDS[:2], *(F.lit(None).cast("long").alias(w) for w in WORDS[2:]), "n", "lang", "best")
    best = reduce(DataFrame.unionByName, done, blank).select(*WORDS, F.col("n").alias("a"), "lang", "best.l", "best.r", "best.score")
    for w in WORDS:
        own = search.words.select(F.col("h").alias(w), F.col("word").alias(f"{w}_word"))
        best = best.join(own, w, "left").drop(w)
    best = best.select("lang", F.concat_ws(" ", *(f"{w}_word" for w in WORDS)).alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = search.vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(small(settle(totals)), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
