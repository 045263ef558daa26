"""Language identification by a convolutional network over bytes.

A window of WINDOW bytes is embedded byte by byte; filters of several widths slide over it, the
maximum of each filter over the window goes through a bias and a rectifier, and a softmax layer gives the
probabilities of the languages. The network is trained in numpy with Adam on windows of labelled texts.
A text is judged by all of its windows, laid end to end: its prediction is the largest of the mean
probabilities, which is its score.

Training reads a window of at most PER_LANGUAGE distinct rows of each label, and of SAMPLE in all, those with the
smallest hashes of identifier and text. How many rows a label has is counted first; by that, only rows whose hash
can be among the smallest leave their task, a few thousand of a label whatever the size of the table. The
network (some thousand numbers) goes out with the tasks; prediction is a map over texts.

Defined results: null texts and texts without a letter are 'und' with score 0; without any labelled text all
are 'und'; ties go to the first label in code point order; repeated rows each give a row; an empty table gives
an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import free_names, release, settle, ship, small

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DEPTH = 8
PER_LANGUAGE = 1500
SAMPLE = 60_000
EPOCHS = 6
BATCH = 64
#: Windows that a task pushes through the network at once.
STEP = 64
UNKNOWN = "und"
#: How far above one over the number of labels, the least that a prediction can score, keep_known wants it, as a part of the way to 1.
#: With four labels that is a score of 0.4; of 10,000 labelled texts of the test tables, 3 lie below, all of a single word of five characters at most.
MARGIN = 0.2


def least_score(n_labels: int) -> float:
    """Score from which keep_known takes a prediction. A single label tells nothing apart: all texts with a letter score 1 and stay."""
    return 1 / n_labels + MARGIN * (1 - 1 / n_labels)


class ByteNetwork:
    """Embedding, filters and output layer. The filters of all widths are laid out as filters of the largest, zero beyond their own."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.widest = labels, max(WIDTHS)
        n = FILTERS * len(WIDTHS)
        self.mask = np.zeros((self.widest * DEPTH, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * DEPTH, i * FILTERS : (i + 1) * FILTERS] = 1
        self.weights = {
            "embedding": rng.normal(0, 0.5, (256, DEPTH)), "filters": rng.normal(0, 0.25, self.mask.shape) * self.mask,
            "bias": np.zeros(n), "out": rng.normal(0, 0.2, (n, len(labels))), "out_bias": np.zeros(len(labels)),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each filter gives at each place (windows, places, filters), and the bytes it saw there."""
        seen = self.weights["embedding"][windows.ravel()]
        rows = len(seen) - self.widest + 1
        patches = np.ascontiguousarray(np.lib.stride_tricks.as_strided(seen, (rows, self.widest * DEPTH), (DEPTH * 4, 4)))
        flat = np.empty((len(seen), self.mask.shape[1]), np.float32)
        np.matmul(patches, self.weights["filters"], out=flat[:rows])
        return flat.reshape(len(windows), WINDOW, -1)[:, : WINDOW - self.widest + 1], seen

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = self.responses(windows)[0].max(axis=1)
        scores = np.maximum(pooled + self.weights["bias"], 0) @ self.weights["out"] + self.weights["out_bias"]
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(windows)
        values, seen = self.responses(windows)
        place = values.argmax(axis=1)
        pooled = np.take_along_axis(values, place[:, None], 1)[:, 0] + w["bias"]
        hidden = np.maximum(pooled, 0)
        scores = hidden @ w["out"] + w["out_bias"]
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), wanted] -= 1
        p /= n
        back = (p @ w["out"].T) * (pooled > 0)
        at = (np.arange(n)[:, None] * WINDOW + place)[..., None] + np.arange(self.widest)
        patch = seen[at].reshape(n, place.shape[1], -1)
        grad = {"out": hidden.T @ p, "out_bias": p.sum(0), "bias": back.sum(0), "filters": np.einsum("bf,bfk->kf", back, patch) * self.mask}
        into = (back[..., None] * w["filters"].T[None]).reshape(-1, DEPTH)
        grad["embedding"] = np.zeros_like(w["embedding"])
        np.add.at(grad["embedding"], windows.ravel()[at.ravel()], into)
        return grad

    def fit(self, windows: np.ndarray, wanted: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> ByteNetwork:
        rng, t = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for batch in np.array_split(order, max(1, len(order) // BATCH)):
                t += 1
                for k, g in self.gradients(windows[batch], wanted[batch]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    step = rate * (1 - epoch / epochs) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                    self.weights[k] -= step.astype(np.float32)
        return self


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, the last of each filled up with zeros, and the number of each text's."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    flat = b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, counts, strict=True))
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), counts


def _drawn(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """lang, lot and text of usable rows whose lot may be among the per_language smallest of the label.

    Lots spread evenly, so of n distinct ones, those in the share (2 k + 100) / n of their range hold the k smallest
    (they are fewer than k with a probability below 1e-7). n is estimated within a twentieth.
    """
    text = F.col(text_col).cast("string")
    rows = docs.where(usable & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), text, F.lit("language")).alias("lot"), text.alias("text"))
    labels = settle(rows.where(has_letter("text")).groupBy("lang").agg(F.approx_count_distinct("lot").alias("n")))
    n_labels = labels.count()
    if n_labels > SAMPLE:
        raise ValueError(f"{n_labels} labels; {SAMPLE} at most can be learned")
    k = min(per_language, SAMPLE // max(1, n_labels))
    shares = labels.select("lang", F.lit(k).alias("k"), ((2 * k + 100) / F.col("n")).alias("share"))
    place = F.col("lot").cast("double") / 2.0**64 + 0.5
    return rows.join(small(shares), "lang").where((place <= F.col("share")) & has_letter("text"))


def training_windows(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """lang, lot and piece: up to per_language pieces of WINDOW characters of distinct usable rows, each where a hash of its row says."""
    start = (F.pmod("lot", F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int")
    drawn = _drawn(docs, usable, id_col, text_col, lang_col, per_language)
    # rows that repeat share their lot and are summed up before they are dealt
    pieces = drawn.groupBy("lang", "lot", "k").agg(F.min(F.substring("text", start, F.lit(WINDOW))).alias("piece"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("lot"))
    return pieces.withColumn("place", place).where("place <= k").select("lang", "lot", "piece")


def has_letter(text: Column | str) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> ByteNetwork | None:
    """A network fitted to rows where usable holds; None if there are none. The sample is bounded by per_language for each label, and by SAMPLE."""
    rows = sorted(map(tuple, training_windows(docs, usable, id_col, text_col, lang_col, per_language).collect()))
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    # every fourth window is cut short, as the last windows of texts are
    cut = [r[2].encode()[: WINDOW if i % 4 else 16 + 12 * (i // 4 % 20)] for i, r in enumerate(rows)]
    return ByteNetwork(labels).fit(windows_of(cut)[0], np.array([labels.index(r[0]) for r in rows]))


def _judged(text: Column, network: ByteNetwork | None) -> Column:
    """A struct of lang and score. Only texts go to the workers, and two values come back for each."""
    if network is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [UNKNOWN, *network.labels]
        for texts in batches:
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for group in _groups([i for i, v in enumerate(texts.is_valid().to_pylist()) if v], texts):
                windows, counts = windows_of([t for _, t in group])
                p = np.concatenate([network.probabilities(windows[i : i + STEP]) for i in range(0, len(windows), STEP)])
                mean = np.add.reduceat(p, np.cumsum(counts) - counts, axis=0, dtype=np.float64) / counts[:, None]
                rows = [i for i, _ in group]
                best[rows], score[rows] = mean.argmax(axis=1) + 1, np.minimum(mean.max(axis=1), 1)
            yield pa.StructArray.from_arrays([pa.array([names[b] for b in best], pa.string()), pa.array(score)], ["lang", "score"])
        release()

    # texts with nothing to judge go to the workers as null
    return F.arrow_udf(judge, "lang string, score double")(F.when(has_letter(text), text))


def predict(docs: DataFrame, network: ByteNetwork | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs without text_col, with pred_col and score_col, in the place of columns of these names."""
    ship(docs.sparkSession)
    [name] = free_names(docs, "judged")
    judged = docs.select(*(docs[c] for c in docs.columns if c not in (text_col, pred_col, score_col)), _judged(docs[text_col].cast("string"), network).alias(name))
    return judged.select(*(judged[c] for c in judged.columns[:-1]), judged[name]["lang"].alias(pred_col), judged[name]["score"].alias(score_col))


def _groups(rows: list[int], texts: pa.Array, size: int = 1 << 20) -> Iterator[list[tuple[int, bytes]]]:
    """(row, bytes of its text) in groups of about size bytes."""
    group, held = [], 0
    for i in rows:
        group.append((i, texts[i].as_py().encode()))
        held += len(group[-1][1])
        if held > size:
            yield group
            group, held = [], 0
    if group:
        yield group


def keep_known(docs: DataFrame, network: ByteNetwork | None, text_col: str = "text", min_score: float | None = None, wanted: list[str] | None = None) -> DataFrame:
    """docs in their own columns, without those whose language the network doesn't tell with a score of min_score (None: least_score).

    wanted: the languages that stay; all that were learned where it is None. Without a network nothing can be told, and
    all texts with a letter stay.
    """
    text = docs[text_col].cast("string")
    if network is None:
        return docs.where(has_letter(text))
    ship(docs.sparkSession)
    [name] = free_names(docs, "judged")
    judged = docs.withColumn(name, _judged(text, network))
    lang, score = judged[name]["lang"], judged[name]["score"]
    told = (lang != UNKNOWN) & (score >= (least_score(len(network.labels)) if min_score is None else min_score))
    if wanted is not None:
        told &= lang.isin(wanted)
    return judged.where(told).drop(name)
