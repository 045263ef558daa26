"""Removes passages that an earlier document has, found through a count-min sketch.

A window is a fixed number of consecutive words. Documents are dealt into blocks by a hash of the row and its number; windows
that several documents of one block share are settled there. For the rest, each block contributes to a
count-min sketch of DEPTH rows: the cells that its distinct windows fall into, sent as sorted, packed lists, dealt
into slices of the sketch. A slice merges the lists of all blocks in bitmaps; the count of a cell, the number of blocks
that touch it, is never below the number of blocks that have a window of the cell. Blocks get back one bit for
each cell of theirs: whether its count is two or more. Windows with this bit in all rows may be elsewhere
too, and only these go to the second pass, with a 128-bit digest and the smallest identifier of the block. The second
pass groups digests exactly and sends back, again one bit each, whether a smaller identifier has the window.

The sketch is as wide as the input is large and is never in one place; blocks and slices grow in number with
the bytes of the input. A passage that all documents share is one entry per block. Texts are shuffled
once, for the blocks, and that exchange is read three times.

Up to BUNDLE blocks, worked through one after the other, share a row to each slice. A bundle has (its bytes / 5) windows to
spread over the slices, so its rows hold 2 MB of input divided by the number of slices: 0.4 million rows for 30 GB, and some
40 windows a row at 10 TB. A row never holds less than one window, so beyond that rows grow as the windows do.

Defined results: null texts have no words; texts of fewer words than a window keep all; a null identifier
comes after all others but the largest 64-bit integer, with which it ties; rows that repeat an identifier don't
remove from each other; an empty table gives an empty result. Only the identifier and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import distinct, mix, pack, pack_sorted, release, ship, shuffle_partitions, text_bytes, unpack, unpack_sorted

BLOCK_BYTES = 8 << 20
#: Blocks that share their rows where there are enough of them to keep all partitions busy.
BUNDLE = 4
#: Input for each slice of the sketch, whose bitmaps take 0.8 bytes for each, and for each slice of the second pass.
SKETCH_BYTES = 128 << 20
SLICE_BYTES = 32 << 20
DEPTH = 2
#: Cells of a row of the sketch for each byte of text; words are rarely below five bytes with their space.
CELLS_PER_BYTE = 1.6
LAST = np.iinfo(np.int64).max


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: Odd multipliers of the two halves of a digest, for bytes of a word and for words of a window.
BYTE_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Texts that are hashed together, in bytes; and the longest word that is hashed with the others.
CHUNK = 1 << 19
LONG = 64


def word_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word of the texts, one after the other, and the number of words of each text.

    A hash is a polynomial of the word's bytes, found for all words at once; words beyond LONG bytes, for which
    such polynomials are weak, are hashed one by one.
    """
    hashes, counts = [], []
    group: list[bytes] = []

    def flush() -> None:
        data = np.frombuffer(b" ".join(group), np.uint8)
        space = (data == 32) | (data - np.uint8(9) < 5)
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        limits = np.cumsum([len(t) + 1 for t in group])
        counts.append(np.diff(np.searchsorted(starts, limits), prepend=0))
        if not len(starts):
            return
        values = np.where(space, np.uint64(0), data + np.uint64(1))  # so that NUL counts too
        out = np.empty((len(starts), 2), np.uint64)
        for half, step in enumerate(BYTE_STEPS):
            sums = np.add.reduceat(values * _powers(step, len(values)), starts)
            out[:, half] = mix(sums * _powers(pow(step, -1, 2**64), len(values))[starts])
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            out[i] = np.frombuffer(xxhash.xxh3_128_digest(data[starts[i] : ends[i]].tobytes()), np.uint64)
        hashes.append(out)

    held = 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held > CHUNK:
            flush()
            group, held = [], 0
    if group:
        flush()
    return np.concatenate([np.zeros((0, 2), np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *counts])


class Block:
    """Documents of a block in order of their identifiers, and the digests of all their windows."""

    def __init__(self, table: pa.Table, width: int) -> None:
        ids = table["doc_id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        self.named = table["doc_id"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)[order]
        texts = table["text"].combine_chunks().cast(pa.binary()).to_pylist()
        self.ids, self.texts = ids[order], [texts[i] or b"" for i in order.tolist()]
        digests, self.lengths = word_digests(self.texts)
        starts = np.cumsum(self.lengths) - self.lengths
        # windows that cross into the next document are taken out
        doc = np.repeat(np.arange(len(ids)), self.lengths)
        last = max(0, len(digests) - width + 1)
        inside = np.flatnonzero(doc[:last] == doc[width - 1 :]) if last else np.zeros(0, np.int64)
        self.doc, self.place = doc[inside], inside - starts[doc[inside]]
        self.high, self.low = (self._rolled(digests[:, half], inside, width, half) for half in (0, 1))

    @staticmethod
    def _rolled(words: np.ndarray, inside: np.ndarray, width: int, half: int) -> np.ndarray:
        step = WORD_STEPS[half]
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _powers(step, len(words)), out=sums[1:])
        return mix((sums[inside + width] - sums[inside]) * _powers(pow(step, -1, 2**64), len(words) + 1)[inside])

    def cells(self, row: int, bits: int) -> np.ndarray:
        return mix(self.high ^ np.uint64(0xD6E8FEB86659FD93 * (row + 1) % 2**64)) >> np.uint64(64 - bits)


def _slices(values: np.ndarray, bits: int, n: int) -> list[tuple[int, slice]]:
    """Where each of n equal ranges of [0, 2**bits) lies in sorted values; empty ones are left out."""
    bounds = np.array([-(-(i << bits) // n) for i in range(1, n)], np.uint64)
    ends = [0, *np.searchsorted(values, bounds).tolist(), len(values)]
    return [(i, slice(a, b)) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]


def _blocks(table: pa.Table) -> Iterator[pa.Table]:
    """The rows of each block of a bundle, in order of the blocks."""
    numbers = table["block"].to_numpy()
    for block in np.unique(numbers):
        yield table.take(pa.array(np.flatnonzero(numbers == block)))


def _sketched(width: int, bits: int, n: int) -> Callable:
    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        lists: list[list[bytes]] = []
        for rows in _blocks(table):
            block = Block(rows, width)
            lists.append([b""] * (DEPTH * n))
            for row in range(DEPTH):
                cells = distinct(block.cells(row, bits))
                for i, part in _slices(cells, bits, n):
                    lists[-1][row * n + i] = pack_sorted(cells[part])
            del block
        used = [i for i in range(DEPTH * n) if any(own[i] for own in lists)]
        release(table.nbytes)
        return pa.table({"slice": used, "bundle": [key[0].as_py()] * len(used), "cells": [[own[i] for own in lists] for i in used]}, schema=pa.schema([("slice", pa.int64()), ("bundle", pa.int64()), ("cells", pa.list_(pa.binary()))]))

    return sketch


BITS = "bundle long, slice long, n array<long>, bits array<binary>"


def among(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which values are in chosen, which is sorted."""
    if not len(chosen):
        return np.zeros(len(values), bool)
    return chosen[np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)] == values


class Bitmaps:
    """Whether cells from `first` on were met once, and twice or more."""

    def __init__(self, first: int, cells: int) -> None:
        self.first = np.uint64(first)
        self.once, self.twice = (np.zeros((cells >> 3) + 1, np.uint8) for _ in range(2))

    def _at(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = cells - self.first
        return (own >> np.uint64(3)).astype(np.int64), np.uint8(1) << (own & np.uint64(7)).astype(np.uint8)

    def add(self, cells: np.ndarray) -> None:
        """Cells of one block, sorted and distinct."""
        if len(cells):
            byte, bit = self._at(cells)
            new = np.flatnonzero(np.diff(byte, prepend=-1))
            byte, bit = byte[new], np.bitwise_or.reduceat(bit, new)
            before = self.once[byte]
            self.twice[byte] |= before & bit
            self.once[byte] = before | bit

    def met_twice(self, cells: np.ndarray) -> np.ndarray:
        byte, bit = self._at(cells)
        return (self.twice[byte] & bit) != 0


def _merged(bits: int, n: int) -> Callable:
    schema = pa.schema([("bundle", pa.int64()), ("slice", pa.int64()), ("n", pa.list_(pa.int64())), ("bits", pa.list_(pa.binary()))])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        i = key[0].as_py() % n
        first, end = (-(-(k << bits) // n) for k in (i, i + 1))
        maps = Bitmaps(first, end - first)
        lists = lambda: ([unpack_sorted(c) if c else np.zeros(0, np.uint64) for c in row.as_py()] for row in table["cells"])
        for row in lists():
            for cells in row:
                maps.add(cells)
        found = [[maps.met_twice(cells) for cells in row] for row in lists()]
        out = {"bundle": table["bundle"], "slice": table["slice"], "n": [[len(f) for f in row] for row in found], "bits": [[np.packbits(f).tobytes() for f in row] for row in found]}
        release(table.nbytes)
        return pa.table(out, schema=schema)

    return merge


def _answers(table: pa.Table) -> list[dict[int, np.ndarray]]:
    """For each block of a bundle, the answers of each slice."""
    out: list[dict[int, np.ndarray]] = []
    for i, n, bits in zip(*(table[c].to_pylist() for c in ("slice", "n", "bits")), strict=True):
        out += [{} for _ in range(len(n) - len(out))]
        for k, (count, packed) in enumerate(zip(n, bits, strict=True)):
            out[k][i] = np.unpackbits(np.frombuffer(packed, np.uint8), count=count).astype(bool)
    return out


def _candidates(block: Block, answers: dict[int, np.ndarray], bits: int, n: int) -> np.ndarray:
    """Distinct windows that the sketch has twice or more, as positions of their first, by digest."""
    maybe = np.ones(len(block.high), bool)
    for row in range(DEPTH):
        own = block.cells(row, bits)
        cells = distinct(own)
        marks = [answers[row * n + i] for i, _ in _slices(cells, bits, n)]
        maybe &= among(own, cells[np.concatenate([*marks, np.zeros(0, bool)])])
    at = np.flatnonzero(maybe)
    at = at[np.lexsort((at, block.low[at], block.high[at]))]
    return at[_new(block.high[at], block.low[at])]


def _new(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which of sorted digests differ from the one before."""
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return new


_LISTS = [(c, pa.list_(pa.binary())) for c in ("high", "low", "least")]


def _estimated(width: int, bits: int, n: int, n_exact: int) -> Callable:
    def estimate(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        lists: list[list[tuple[bytes, bytes, bytes]]] = []
        answered = _answers(answers)
        for k, rows in enumerate(_blocks(table)):
            block = Block(rows, width)
            at = _candidates(block, answered[k] if k < len(answered) else {}, bits, n)
            high, low, least = block.high[at], block.low[at], block.ids[block.doc[at]]
            lists.append([(b"", b"", b"")] * n_exact)
            for i, part in _slices(high, 64, n_exact):
                lists[-1][i] = (pack_sorted(high[part]), pack(low[part]), pack(least[part]))
            del block
        used = [i for i in range(n_exact) if any(own[i][0] for own in lists)]
        columns = {c: [[own[i][f] for own in lists] for i in used] for f, (c, _) in enumerate(_LISTS)}
        release(table.nbytes)
        return pa.table({"slice": used, "bundle": [key[0].as_py()] * len(used)} | columns, schema=pa.schema([("slice", pa.int64()), ("bundle", pa.int64()), *_LISTS]))

    return estimate


def _unpacked(data: bytes, dtype, unpacker: Callable) -> np.ndarray:
    return unpacker(data) if data else np.zeros(0, dtype)


def _grouped(table: pa.Table) -> pa.Table:
    rows = [len(x) for x in table["high"].to_pylist()]
    flat = {c: [d for x in table[c].to_pylist() for d in x] for c, _ in _LISTS}
    high = [_unpacked(d, np.uint64, unpack_sorted) for d in flat["high"]]
    low = [_unpacked(d, np.uint64, lambda v: unpack(v, np.uint64)) for d in flat["low"]]
    least = [_unpacked(d, np.int64, lambda v: unpack(v, np.int64)) for d in flat["least"]]
    order = np.lexsort((all_least := np.concatenate(least), all_low := np.concatenate(low), all_high := np.concatenate(high)))
    new = _new(all_high[order], all_low[order])
    smallest = np.empty_like(all_least)
    smallest[order] = all_least[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.split(smallest < all_least, np.cumsum([len(h) for h in high])[:-1])
    gone = {"high": [pack_sorted(h[x]) if x.any() else b"" for h, x in zip(high, later, strict=True)], "low": [pack(v[x]) if x.any() else b"" for v, x in zip(low, later, strict=True)]}
    ends = np.cumsum(rows).tolist()
    out = {"bundle": table["bundle"]} | {c: [v[a:b] for a, b in zip([0, *ends], ends, strict=False)] for c, v in gone.items()}
    release(table.nbytes)
    return pa.table(out, schema=pa.schema([("bundle", pa.int64()), *_LISTS[:2]]))


def _removed(block: Block, answers: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Which windows a smaller identifier has, in the block or, by the answers of the second pass, in another."""
    empty = np.zeros(0, np.uint64)
    outer = [np.concatenate([empty, *(unpack_sorted(h) for h, _ in answers if h)]), np.concatenate([empty, *(unpack(v, np.uint64) for _, v in answers if v)])]
    high = np.sort(block.high)
    shared = distinct(np.concatenate([high[1:][high[1:] == high[:-1]], outer[0]]))
    at = np.flatnonzero(among(block.high, shared))
    # the answers, then documents in order of their identifiers: the first of a run has the smallest
    n = len(outer[0])
    highs, lows = np.concatenate([outer[0], block.high[at]]), np.concatenate([outer[1], block.low[at]])
    ids = np.concatenate([np.full(n, np.iinfo(np.int64).min), block.ids[block.doc[at]]])
    order = np.lexsort((np.arange(len(ids)), lows, highs))
    new = _new(highs[order], lows[order])
    least = np.empty_like(ids)
    least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = np.zeros(len(block.high), bool)
    gone[at] = (least < ids)[n:]
    return gone


def _cut(width: int, schema: pa.Schema) -> Callable:
    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
        answered = list(zip(answers["high"].to_pylist(), answers["low"].to_pylist(), strict=True))
        for k, rows in enumerate(_blocks(table)):
            block = Block(rows, width)
            gone = _removed(block, [(h[k], v[k]) for h, v in answered])
            ends = np.searchsorted(block.doc, np.arange(len(block.ids) + 1))
            for d, (words, n) in enumerate(zip(map(bytes.split, block.texts), block.lengths.tolist(), strict=True)):
                first = block.place[ends[d] : ends[d + 1]][gone[ends[d] : ends[d + 1]]]
                if len(first):
                    edges = np.zeros(n + 1, np.int64)
                    edges[first] += 1
                    edges[first + width] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                for c, v in (("doc_id", int(block.ids[d]) if block.named[d] else None), ("n_words", n), ("n_removed", n - len(words)), ("kept", b" ".join(words).decode())):
                    out[c].append(v)
            del block
        release(table.nbytes)
        return pa.table(out, schema=schema)

    return cut


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the kept words, joined by one space).

    A word goes if a window of `width` words that covers it also starts in a document with a smaller identifier.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = text_bytes(texts, "text")
    n_blocks, n, n_exact = 1 + size // BLOCK_BYTES, 1 + size // SKETCH_BYTES, 1 + size // SLICE_BYTES
    bits = max(16, int(size * CELLS_PER_BYTE).bit_length())
    # windows are compared by identifier, so any dealing is right; rows that repeat whole, or have neither identifier nor text, are dealt by their number
    numbered = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n_blocks)))
    bundles = numbered.withColumn("bundle", F.floor(F.col("block") / bundled(n_blocks, shuffle_partitions(docs.sparkSession)))).groupBy("bundle")
    cells = bundles.applyInArrow(_sketched(width, bits, n), "slice long, bundle long, cells array<binary>")
    counted = cells.groupBy("slice").applyInArrow(_merged(bits, n), BITS)
    digests = bundles.cogroup(counted.groupBy("bundle")).applyInArrow(_estimated(width, bits, n, n_exact), "slice long, bundle long, high array<binary>, low array<binary>, least array<binary>")
    settled = digests.groupBy("slice").applyInArrow(_grouped, "bundle long, high array<binary>, low array<binary>")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    return bundles.cogroup(settled.groupBy("bundle")).applyInArrow(_cut(width, schema), "doc_id long, n_words long, n_removed long, kept string")


def bundled(n_blocks: int, partitions: int) -> int:
    """Blocks of a bundle."""
    return max(1, min(BUNDLE, n_blocks // partitions))
