"""Token counts by a shortcut for words that are one token.

Which strings of the vocabulary encode alone, as a whole pre-token, to one token is found once, by encoding each
of them with the library. Texts are cut at ASCII white space, which no token of this kind of
vocabulary spans; each distinct chunk of a batch is normalised and split into pre-tokens, those proved whole
count one each, and only the rest are merged by the library, once each. Chunks with a special string, or with
characters from planes that Unicode hasn't assigned, where pattern engines differ, go to the library whole.

Counting is a map over rows: nothing is shuffled, and a worker's memory of counted chunks is emptied
when it passes MEMORY bytes, which changes no result.

Defined results: null text is empty and has no tokens; repeated rows each give a row; an empty table gives
an empty result. Only the identifier and text are read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import release, ship

#: Bytes that a worker takes for the chunks it remembers, each with ENTRY for Python's objects.
MEMORY = 160 << 20
ENTRY = 140
#: Texts of one step within a task, in characters.
STEP = 8 << 20
UNASSIGNED = "\U00030000"

_counters: dict = {}


def _library(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def prove_whole(vocabulary: str) -> list[str]:
    """The normalised strings that are one pre-token and encode alone to exactly one token."""
    tokenizer = _library(vocabulary)
    suffix = json.loads(vocabulary)["model"].get("end_of_word_suffix") or ""
    table = {c: b for b, c in byte_characters().items()}
    specials = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        body = entry.removesuffix(suffix) if suffix else entry
        if entry.endswith(suffix) and body and all(c in table for c in body):
            try:
                text = bytes(table[c] for c in body).decode()
            except UnicodeDecodeError:
                continue
            if (tokenizer.normalizer is None or tokenizer.normalizer.normalize_str(text) == text) and not any(s in text for s in specials):
                texts.append(text)
    find = pre_token_pattern(vocabulary).findall
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, encoded, strict=True) if len(e.ids) == 1 and find(t) == [t]]


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def pre_token_pattern(vocabulary: str) -> regex.Pattern:
    """The vocabulary's own Split pattern, whose matches are the pre-tokens."""
    steps = json.loads(vocabulary)["pre_tokenizer"]["pretokenizers"]
    split = next(s for s in steps if s["type"] == "Split")
    if split["behavior"] != "Removed" or not split["invert"]:
        raise ValueError("only a Split that keeps its matches is supported")
    return regex.compile(split["pattern"]["Regex"])


def ascii_normaliser(vocabulary: str) -> Callable[[str], str] | None:
    """What the vocabulary's normaliser does to ASCII without white space, where that is known to be no more than lower-casing."""
    own = json.loads(vocabulary)["normalizer"]
    steps = [] if own is None else own["normalizers"] if own["type"] == "Sequence" else [own]
    kinds = [s["type"] for s in steps if not (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"})]
    if not set(kinds) <= {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}:
        return None
    return str.lower if "Lowercase" in kinds else str


class ChunkCounter:
    """Counts tokens of chunks without white space."""

    def __init__(self, vocabulary: str, whole: Iterable[str]) -> None:
        self.library = _library(vocabulary)
        self.normalise = self.library.normalizer.normalize_str if self.library.normalizer else str
        self.ascii = ascii_normaliser(vocabulary) or self.normalise
        self.find = pre_token_pattern(vocabulary).findall
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole = frozenset(whole)
        self.chunks: dict[str, int] = {}
        self.held = 0

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def learn(self, chunks: set[str]) -> None:
        if self.held > MEMORY:
            self.chunks, self.held = {}, 0
        new = [c for c in chunks if c not in self.chunks]
        self.held += sum(map(len, new)) + ENTRY * len(new)
        special = [c for c in new if any(s in c for s in self.specials) or not c.isascii() and max(c) >= UNASSIGNED]
        self.chunks.update(zip(special, self._lengths(special), strict=True))
        open_, merges = [], {}
        for chunk in new:
            if chunk in self.chunks:
                continue
            pieces = self.find((self.ascii if chunk.isascii() else self.normalise)(chunk))
            rest = [p for p in pieces if p not in self.whole]
            self.chunks[chunk] = len(pieces) - len(rest)
            if rest:
                open_.append((chunk, rest))
                merges.update(dict.fromkeys(rest))
        merges = dict(zip(merges, self._lengths(list(merges)), strict=True))
        for chunk, rest in open_:
            self.chunks[chunk] += sum(merges[p] for p in rest)

    def count(self, texts: list[str]) -> list[int]:
        split = [t.translate(_SPACES).split(" ") for t in texts]
        chunks: set[str] = set().union(*split)
        chunks.discard("")
        self.learn(chunks)
        self.chunks[""] = 0
        known = self.chunks.__getitem__
        return [sum(map(known, s)) for s in split]


_SPACES = dict.fromkeys(range(9, 14), " ")


def _counter(vocabulary: str, whole: str) -> ChunkCounter:
    """Made once per worker."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _counters:
        _counters[key] = ChunkCounter(vocabulary, whole.split("\n"))
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(docs.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, "\n".join(prove_whole(vocabulary))))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")).cast("long"), F.lit(0)).alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    out = texts.drop("text").schema.add("n_tokens", "long")
    schema = to_arrow_schema(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*shared.value)
        for batch in batches:
            counts, step, size = [], [], 0
            for text in batch.column(2):
                step.append(text.as_py() or "")
                size += len(step[-1])
                if size > STEP:
                    counts += counter.count(step)
                    step, size = [], 0
            counts += counter.count(step)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], schema=schema)
        release()

    return texts.mapInArrow(count, out)
