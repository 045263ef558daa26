"""Byte-level BPE by way of the distinct words of the corpus.

Texts are cut into pre-tokens by the vocabulary's pattern. A block (texts of about BLOCK_BYTES) numbers its
distinct pre-tokens and keeps, for each text, the numbers in text order; these are its positions. The distinct pre-tokens go out once per block, dealt by a hash into slices. A slice
meets the same word from all blocks, encodes it once, and sends the ids back to the blocks, where the
numbers are replaced in order. What moves is numbers and distinct words, packed, never texts. A word that
every block has is one entry per block, so hot words don't gather.

Blocks grow in number with the bytes of the input, not in size. Slices are as many as the session has shuffle
partitions at most, so a block sends no more rows however large the corpus is; a slice is worked through batch by batch and
holds no more than MEMORY bytes of words. The state between the two passes is
a checkpoint, so that a lost executor can't renumber a block. Ids travel as little-endian unsigned 32-bit integers.

Decoding looks ids up in the table of token bytes, which the vocabulary bounds.

Defined results: null text counts as empty and has no ids; a text longer than a block is a block by itself;
repeated rows each give a row; an empty table gives an empty result. Only the identifier and text are read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.common import free_names, pack, pack_sorted, release, settle, ship, shuffle_partitions, text_bytes, unpack, unpack_sorted

BLOCK_BYTES = 32 << 20
SLICE_BYTES = 32 << 20
#: Bytes that a slice takes for words whose ids it remembers; beyond that it starts anew, which changes no result.
MEMORY = 96 << 20
#: Bytes of Python's objects for a remembered word, besides its own.
ENTRY = 200
#: Numbers that are looked up at once.
PART = 1 << 19
#: Rows of a batch of results.
ROWS = 256

_encodings: dict[int, tiktoken.Encoding] = {}


def read_ranks(path: str) -> bytes:
    """A rank file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as f:
        return f.read()


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def _encoding(data: bytes) -> tiktoken.Encoding:
    """Takes all that it is given for one pre-token. Made once per worker."""
    key = zlib.crc32(data)
    if key not in _encodings:
        _encodings[key] = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks_of(data), special_tokens={})
    return _encodings[key]


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return pack(np.fromiter(map(len, words), np.uint32, len(words))), pack(np.frombuffer(b"".join(words), np.uint8))


def unpack_words(lengths: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(unpack(lengths, np.uint32), dtype=np.int64).tolist()
    whole = unpack(data, np.uint8).tobytes()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class _Block:
    """Distinct pre-tokens of some texts, and the texts as their numbers."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.texts, self.size = [], [], 0

    def add(self, doc_id, words: list[str], size: int) -> None:
        numbers = self.numbers
        self.texts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words)))
        self.ids.append(doc_id)
        self.size += size

    def rows(self, block: int, n_slices: int, schema: pa.Schema) -> pa.RecordBatch:
        """A row with the texts, then one with the words of each slice.

        Words seen more than once are numbered from 1 by frequency, those seen once after them in text order, so
        that in the texts 0 can stand for the next of these.
        """
        lengths = pack(np.array([len(t) for t in self.texts], np.uint32))
        text, self.texts = np.concatenate(self.texts), []
        # in parts, as numpy widens what it counts or looks up
        parts = [text[i : i + PART] for i in range(0, len(text), PART)]
        counts = np.zeros(len(self.numbers), np.int64)
        for part in parts:
            counts += np.bincount(part, minlength=len(counts))
        order = np.argsort(np.where(counts > 1, -counts, 0), kind="stable")
        often = int((counts > 1).sum())
        code = np.empty(len(order), np.uint32)
        code[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
        code[code > often] = 0
        for part in parts:
            part[:] = code[part]
        table = {"block": [block], "slice": [None], "doc_ids": [self.ids], "often": [often], "codes": [pack(text)], "lengths": [lengths], "words": [None]}
        text = parts = part = counts = code = None  # what follows needs room
        words = [w.encode() for w in self.numbers]
        self.numbers = {}
        words = [words[i] for i in order.tolist()]
        dealt = np.fromiter((zlib.crc32(w) % n_slices for w in words), np.int64, len(words))
        # within a slice the numbers ascend
        by_slice = np.argsort(dealt, kind="stable")
        edges = np.flatnonzero(np.diff(dealt[by_slice], prepend=-1, append=n_slices))
        for a, b in zip(edges, edges[1:], strict=False):
            mine = by_slice[a:b]
            lengths, packed = pack_words([words[i] for i in mine.tolist()])
            for name, value in (("block", block), ("slice", int(dealt[mine[0]])), ("doc_ids", None), ("often", None), ("codes", pack_sorted(mine.astype(np.uint64))), ("lengths", lengths), ("words", packed)):
                table[name].append(value)
        return pa.RecordBatch.from_pydict(table, schema)


def _numbered(pattern: str, n_slices: int, schema: pa.Schema) -> Callable:
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        first, made, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for doc_id, text, size in zip(batch.column(0).to_pylist(), batch.column(1), sizes, strict=True):
                if block.ids and block.size + size > BLOCK_BYTES:
                    yield block.rows(first + made, n_slices, schema)
                    made, block = made + 1, _Block()
                block.add(doc_id, find(text.as_py() or ""), size)
        if block.ids:
            yield block.rows(first + made, n_slices, schema)
        release()

    return number


class Ids:
    """The ids of words, each encoded once while it is remembered."""

    def __init__(self, data: bytes) -> None:
        self.encode, self.ids, self.held = _encoding(data).encode_ordinary, {}, 0

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and these ids one after the other."""
        if self.held > MEMORY:
            self.ids, self.held = {}, 0
        ids = self.ids
        for word in words:
            if word not in ids:
                ids[word] = np.array(self.encode(word.decode()), np.uint32).tobytes()
                self.held += len(word) + len(ids[word]) + ENTRY
        found = [ids[w] for w in words]
        return np.fromiter(map(len, found), np.uint32, len(found)) // 4, np.frombuffer(b"".join(found), np.uint32)


def _encoded(data: bytes, schema: pa.Schema) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ids(data)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in ("block", "codes", "lengths", "words")}
                counts, ids = known.of(unpack_words(row["lengths"], row["words"]))
                out = {"block": row["block"], "doc_ids": None, "often": None, "codes": row["codes"], "lengths": pack(counts), "ids": pack(ids)}
                yield pa.RecordBatch.from_pylist([out], schema)

    return encode


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] numbers, then the same for the next."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class TokenBytes:
    """The table of token bytes, by rank."""

    def __init__(self, data: bytes) -> None:
        tokens = {rank: token for token, rank in ranks_of(data).items()}
        self.lengths = np.zeros(max(tokens, default=-1) + 1, np.int64)
        for rank, token in tokens.items():
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens[r] for r in sorted(tokens)), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        return self.flat[runs(self.starts[ids], self.lengths[ids])].tobytes()


def _reassembled(schema: pa.Schema, data: bytes) -> Callable:
    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a block: one with its texts, and one from each slice."""
        texts, places, counts, ids = None, [], [], []
        for batch in batches:
            for k in range(batch.num_rows):
                if batch["doc_ids"][k].is_valid:
                    texts = batch.slice(k, 1)
                else:
                    places.append(unpack_sorted(batch["codes"][k].as_py()).astype(np.int64))
                    counts.append(unpack(batch["lengths"][k].as_py(), np.uint32).astype(np.int64))
                    ids.append(unpack(batch["ids"][k].as_py(), np.uint32).astype("<u4", copy=False))
        n, held = sum(map(len, places)), 0
        of_code, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for place, c, i in zip(places, counts, ids, strict=True):
            of_code[place] = c
            starts[place] = held + np.cumsum(c) - c
            held += len(i)
        all_ids = np.concatenate([*ids, np.zeros(0, "<u4")])
        code = unpack(texts["codes"][0].as_py(), np.uint32)
        once = code == 0
        code[once] = texts["often"][0].as_py() + 1 + np.arange(once.sum(), dtype=np.uint32)
        ends = np.cumsum(unpack(texts["lengths"][0].as_py(), np.uint32), dtype=np.int64)
        doc_ids = texts["doc_ids"].flatten()
        tokens = TokenBytes(data) if "decoded" in schema.names else None
        for first in range(0, len(ends), ROWS):
            encoded = []
            for d in range(first, min(first + ROWS, len(ends))):
                own = code[ends[d - 1] if d else 0 : ends[d]].astype(np.int64) - 1
                encoded.append(all_ids[runs(starts[own], of_code[own])])
            columns = [doc_ids.slice(first, len(encoded)), pa.array([e.tobytes() for e in encoded], pa.binary())]
            if tokens:
                columns.append(pa.array(map(tokens.of, encoded), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        release(len(code))

    return reassemble


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per document: doc_id and ids, binary; with `decoded`, the bytes that these ids stand for, if asked."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    data = read_ranks(ranks_path)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_slices = min(1 + text_bytes(texts, "text") // SLICE_BYTES, shuffle_partitions(spark))
    kind = texts.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    head, tail = "block bigint", f"doc_ids array<{kind.simpleString()}>, often int, codes binary, lengths binary"
    kinds = {"block": pa.int64(), "slice": pa.int32(), "doc_ids": pa.list_(arrow), "often": pa.int32()} | dict.fromkeys(("codes", "lengths", "words", "ids"), pa.binary())
    fields = lambda *names: pa.schema([(n, kinds[n]) for n in names])
    schema = fields("block", "slice", "doc_ids", "often", "codes", "lengths", "words")
    numbered = settle(texts.mapInArrow(_numbered(pattern, n_slices, schema), f"{head}, slice int, {tail}, words binary"))
    words = numbered.where("slice IS NOT NULL").groupBy("slice").applyInArrow(_encoded(data, fields("block", "doc_ids", "often", "codes", "lengths", "ids")), f"{head}, {tail}, ids binary")
    rows = numbered.where("slice IS NULL").select("block", "doc_ids", "often", "codes", "lengths", F.lit(None).cast("binary").alias("ids"))
    binary = ["ids", *["decoded"] * decoded]
    out = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.BinaryType()) for c in binary)])
    return rows.unionByName(words).groupBy("block").applyInArrow(_reassembled(pa.schema([("doc_id", arrow), *((c, pa.binary()) for c in binary)]), data), out)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """encoded with `decoded_col`, the bytes that its ids stand for, in the place of a column of that name; null ids give null."""
    ship(encoded.sparkSession)
    data = read_ranks(ranks_path)
    [name] = free_names(encoded, decoded_col)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenBytes(data)
        for batch in batches:
            out = []
            for ids in batch.column(batch.schema.get_field_index(ids_col)):
                ids = None if ids.as_py() is None else np.frombuffer(ids.as_py(), "<u4")
                out.append(None if ids is None else tokens.of(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, name])

    found = encoded.mapInArrow(look_up, T.StructType([*encoded.schema, T.StructField(name, T.BinaryType())]))
    return found if name == decoded_col else found.drop(decoded_col).withColumnRenamed(name, decoded_col)
