"""Near duplicates by fast similarity sketching, banding and exact verification.

The sketch of a set of shingles has COORDINATES bins (Dahlgaard, Knudsen and Thorup, 2017). In each round every
element falls into a hashed bin with a hashed value, later rounds with larger values, and a bin keeps its
smallest; after as many rounds as there are bins, element-independent rounds fill what is left, so that all bins
are full. Two sets agree in a bin with the probability of their Jaccard similarity, concentrated as for
independent hashes. ROWS bins make a band; documents that share a band are candidates, and at a similarity
of 0.8 a pair shares none of the 32 bands with probability 5e-8.

Copies (equal word sequences) are one node, their smallest identifier. A band's group is never paired up:
each member is paired with the most central of the group, which is exact where all are similar to it. Where a group
spans several components after that, pairs across its components are checked too, but for those that an exact bound
rules out: sets need most of their shingles in common, and what each has in common with others, and with
the lead of the group, is known. Every pair is confirmed on the
full sets of words before it links. Components come from the links.

Groups are formed by aggregations with map-side sums and joins that adaptive execution can split, so a group
of any size has no task of its own.

Defined results: texts are lower-cased in A-Z; a text with fewer words than a shingle is one shingle of all
its words; a text without words, or null, has no shingles and links with nothing; rows that repeat an
identifier are one node; a null identifier links with nothing, has a null component and is kept; an empty
table gives an empty result. near_duplicates reads the identifier and text alone, and drop_near_duplicates keeps whole rows packed, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import HOT, distinct, mix, one_row, packed, release, settle, ship, small
from tallyfold.llm.components import components

COORDINATES = 128
ROWS = 4
NGRAM = 5
PERCENT = 80
#: Shingles that are sketched at once.
STEP = 1 << 17
#: Pairs of one text that are confirmed together.
SHARE = 256
#: Classes of shingles, by their hash, in which what two sets can have in common is bounded.
CLASSES = 64
#: Shingles in a class, as a bound that rules nothing out: more than any text has, and its multiples fit 64 bits.
UNBOUNDED = 1 << 40


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], ngram: int) -> set:
    if len(words) < ngram:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(ngram)), strict=False))


def shingle_hashes(words: list[bytes], known: dict[bytes, int], ngram: int) -> np.ndarray:
    """Hashes of the distinct shingles."""
    hashes = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = min(ngram, len(words))
    total = np.full(max(0, len(words) - n + 1) if n else 0, n, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(total)]
    return distinct(mix(total))


class _Hashes(dict):
    """Hashes of words, emptied when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of t bins for each of the sets, none of which is empty."""
    out = np.full((len(sets), t), np.iinfo(np.uint64).max, np.uint64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = out.reshape(-1)
    shift = np.uint64(57)
    for i in range(2 * t):
        h = mix(values + np.uint64((i + 1) * 0x632BE59BD9B4E019 % 2**64))
        # the number of the round above 56 bits of hash
        value = (h & np.uint64((1 << 56) - 1)) | np.uint64(i << 56) if i < 256 else h
        bins = (h >> shift).astype(np.int64) % t if i < t else np.full(len(h), i - t)
        np.minimum.at(flat, owner * t + bins, value)
        open_ = (out == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        left = open_[owner]
        values, owner = values[left], owner[left]
    return out


def bands_of(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band, with its place."""
    parts = sketch.reshape(len(sketch), -1, rows)
    total = np.tile(np.arange(parts.shape[1], dtype=np.uint64), (len(sketch), 1))
    for k in range(rows):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return total.view(np.int64)


def _sketched(ngram: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()

        def flush(rows: list) -> pa.RecordBatch:
            full = [r for r in rows if len(r[2])]
            bands = bands_of(sketches([r[2] for r in full])) if full else np.zeros((0, COORDINATES // ROWS), np.int64)
            place = iter(bands)
            return pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "n_shingles": [len(r[2]) for r in rows], "digest": [r[1] for r in rows], "bands": [next(place) if len(r[2]) else None for r in rows]}, schema)

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                hashes = shingle_hashes(words, known, ngram)
                rows.append((doc_id, hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None, hashes))
                held += len(hashes)
                if held > STEP:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)
        release()

    return sketch


def _confirmed(ngram: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("similar", pa.bool_())])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, set()
        for batch in batches:
            out = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if (a, x.as_py()) != last:
                    last = (a, x.as_py())
                    first = shingles(words_of(last[1]), ngram)
                second = shingles(words_of(y.as_py()), ngram)
                both = len(first & second)
                out.append((a, b, both, both > 0 and 100 * both >= percent * (len(first) + len(second) - both)))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], t) for i, t in enumerate(schema.types)], schema=schema)
        release()

    return confirm


def confirm(pairs: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Each of the pairs (a, b) with both, the size of the intersection of their full sets, and similar. texts: doc_id, text.

    Where an identifier has several texts, their largest intersection counts. An `a` with a large part of the pairs, as the
    lead of many copies is, has them dealt into parts of about SHARE, and its text goes to each; of such there are HOT at most.
    """
    named = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id")
    own = texts.join(named, "doc_id", "left_semi")
    n = F.col("n")
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where((n * HOT >= pairs.count()) & (n > SHARE)).select("a", (1 + F.floor(n / SHARE)).cast("int").alias("parts"))
    hot = F.broadcast(settle(hot))
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    first = own.select(F.col("doc_id").alias("a"), F.col("text").alias("x")).join(hot, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    joined = dealt.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").join(first, ["a", "part"])
    return joined.select("a", "b", "x", "y").mapInArrow(_confirmed(ngram, percent), "a long, b long, both long, similar boolean").groupBy("a", "b").agg(F.max("both").alias("both"), F.max("similar").alias("similar"))


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest reachable), kept.

    Documents link where 100 * intersection >= percent * union of their sets of ngram-word shingles.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = settle(texts.mapInArrow(_sketched(ngram), "doc_id long, n_shingles long, digest binary, bands array<long>"))
    nodes = settle(rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node")))
    members = rows.select("doc_id", "n_shingles", "digest")
    banded = rows.where("digest IS NOT NULL").join(nodes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    banded = banded.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    shared = settle(_led(banded))
    led = settle(shared.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    checked = settle(confirm(led, texts, ngram, percent))
    links = checked.where("similar").select("a", "b")
    labels = components(links)
    sizes = rows.where("n_shingles > 0").groupBy(F.col("doc_id").alias("node")).agg(F.min("n_shingles").alias("size"))
    across = settle(_across(shared, labels, checked, texts, sizes, ngram, percent).join(led, ["a", "b"], "left_anti"))
    links = links.union(confirm(across, texts, ngram, percent).where("similar").select("a", "b"))
    # a document that repeats an identifier of another text ties the nodes of both
    twins = members.join(nodes, "digest").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links.union(twins))
    found = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _led(banded: DataFrame) -> DataFrame:
    """band, node and lead for bands of several nodes; the lead is the node that meets most others in its bands."""
    groups = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = banded.join(groups, "band")
    meets = shared.groupBy("node").agg(F.sum("n").alias("meets"))
    shared = settle(shared.drop("n").join(meets, "node"))
    leads = shared.groupBy("band").agg(F.max_by("node", F.struct("meets", -F.col("node"))).alias("lead"))
    return shared.select("band", "node").join(leads, "band")


def _mixed(own: DataFrame) -> DataFrame:
    """Rows of the bands whose members are of several components."""
    mixed = own.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return own.join(mixed.select("band"), "band", "left_semi")


def _hashed(ngram: int):
    schema = pa.schema([("node", pa.int64()), ("digest", pa.binary()), ("hashes", pa.list_(pa.int64())), ("classes", pa.list_(pa.int64()))])

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                words = [words_of(t.as_py()) for t in part.column(1)]
                digests = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words]
                hashes = [shingle_hashes(w, known, ngram) for w in words]
                classes = [np.bincount((h % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES) for h in hashes]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, schema.types[1]), pa.array([h.view(np.int64) for h in hashes], schema.types[2]), pa.array(classes, schema.types[3])], schema=schema)
        release()

    return shingle


def _common(nodes: DataFrame, texts: DataFrame, ngram: int) -> DataFrame:
    """node, common (how many of its shingles another of the nodes has too) and classes (the same for each class of hashes).

    A shingle that one node alone has is found by a grouped minimum and maximum, so frequent ones gather nowhere.
    """
    own = texts.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    each = settle(own.mapInArrow(_hashed(ngram), "node long, digest binary, hashes array<long>, classes array<long>"))
    holders = each.select("node", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    # hashes are unsigned; CLASSES is a power of two, so the sign doesn't matter
    alone = holders.where("node = other").groupBy("node", F.pmod("hash", F.lit(CLASSES)).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    # at most CLASSES entries for each node
    alone = alone.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("alone"))
    left = F.transform("classes", lambda n, k: n - F.coalesce(F.try_element_at("alone", k), F.lit(0)))
    # an identifier of several texts is never ruled out; rows that repeat one text are one
    left = F.when(F.col("one"), left).otherwise(F.transform("classes", lambda n: F.lit(UNBOUNDED)))
    one = (F.min("digest") == F.max("digest")).alias("one")
    kept = each.groupBy("node").agg(F.max("classes").alias("classes"), one).join(alone, "node", "left").select("node", "one", left.alias("classes"))
    return kept.withColumn("common", F.aggregate("classes", F.lit(0).cast("long"), lambda x, y: x + y))


def _across(shared: DataFrame, labels: DataFrame, checked: DataFrame, texts: DataFrame, sizes: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in a band whose components differ and whose sets can be similar at all.

    Sets of sizes m and n are similar only if they have percent * (m + n) / (100 + percent) shingles in common. A node
    has none in common with another beyond those that occur in another node; and of these, two nodes share no
    more among those of a lead than the one with fewer of them has, and likewise among the others. Nodes for which
    that is too few with even the smallest of a band leave it before pairs are formed. Nor do two nodes share more in
    any class of shingles than the one with fewer of them there has.
    """
    own = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = settle(_mixed(own))
    with_lead = checked.select(F.col("a").alias("lead"), F.col("b").alias("node"), "both")
    counted = own.join(sizes, "node").join(_common(own.select("node").distinct(), texts, ngram), "node").join(with_lead, ["lead", "node"], "left")
    counted = counted.select("band", "node", "component", "size", "classes", "common", F.when(F.col("one"), F.coalesce("both", "size")).otherwise(UNBOUNDED).alias("led"))
    counted = settle(counted.where(100 * F.col("common") >= percent * F.col("size")))
    least = counted.groupBy("band").agg(F.min("size").alias("least"))
    partner = F.greatest(F.col("least"), F.ceil(percent * F.col("size") / 100))
    able = counted.join(least, "band").where((100 + percent) * F.col("common") >= percent * (F.col("size") + partner)).drop("least")
    able = settle(_mixed(able))
    fields = ("node", "component", "size", "common", "led", "classes")
    left, right = (able.select("band", *(F.col(c).alias(f"{side}_{c}") for c in fields)) for side in ("a", "b"))
    led = F.least("a_led", "b_led") + F.least(F.col("a_common") - F.col("a_led"), F.col("b_common") - F.col("b_led"))
    classes = F.aggregate(F.zip_with("a_classes", "b_classes", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda x, y: x + y)
    needed = percent * (F.col("a_size") + F.col("b_size"))
    enough = ((100 + percent) * led >= needed) & ((100 + percent) * classes >= needed)
    pairs = left.join(right, "band").where((F.col("a_component") != F.col("b_component")) & (F.col("a_node") < F.col("b_node")) & enough)
    return pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in their own columns with one row of each component, that of the smallest identifier.

    Here texts are documents: rows of a null or repeated identifier are told apart by their text, so null identifiers
    link too, and stay only where all of their component are null. Of rows that repeat an identifier and its text, the
    smallest by its other columns stays.
    """
    rows = packed(docs)
    own, text = F.col("row").getField(id_col).cast("long"), F.col("row").getField(text_col).cast("string")
    shared = settle(rows.groupBy(own.alias("shared")).agg(F.count(F.lit(1)).alias("n")).where("shared IS NULL OR n > 1"))
    if shared.isEmpty():
        found = near_duplicates(docs, ngram, percent, id_col, text_col)
        gone = small(settle(found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()))
        return rows.join(gone, own == gone["gone"], "left_anti").select("row.*")
    marked = rows.join(small(shared), own.eqNullSafe(F.col("shared")), "left")
    token = F.when(F.col("n").isNotNull(), F.sha2(F.coalesce(text, F.lit("")), 256))
    for salt in itertools.count():
        # a number for each of the texts, another one if it's taken
        node = F.when(F.col("n").isNotNull(), F.xxhash64(token, F.lit(salt))).otherwise(own)
        named = marked.select("row", node.alias("node"), token.alias("token"), own.alias("own"))
        names = settle(named.groupBy("node", "token", "own").agg(F.count(F.lit(1)).alias("n")))
        if names.select("node", "token").distinct().count() == names.select("node").distinct().count():
            break
    found = near_duplicates(named.select("node", text.alias("text")), ngram, percent, "node", "text")
    placed = names.join(found.select(F.col("doc_id").alias("node"), "component_id").distinct(), "node")
    stays = placed.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "token", "node")).alias("best"))
    verdict = settle(placed.join(stays, "component_id").select("node", "own", "n", (F.col("node").eqNullSafe(F.col("best.node")) & F.col("own").eqNullSafe(F.col("best.own"))).alias("stays")))

    def matched(condition: str, how: str) -> DataFrame:
        part = small(verdict.where(condition).select(F.col("node").alias("mark"), F.col("own").alias("mark_id")))
        return named.join(part, (named["node"] == part["mark"]) & named["own"].eqNullSafe(part["mark_id"]), how)

    tied = matched("stays AND n > 1", "left_semi")
    return matched("NOT stays OR n > 1", "left_anti").select("row.*").union(one_row(tied, [tied["node"]], text_col))
