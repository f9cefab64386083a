"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the lines next to it, with
learned transitions; the document's score is the mean of the lines' forward-backward
marginals of "good", weighted by line length.

``fit`` learns from at most ``sample`` labelled documents of each class (those whose ids have the
smallest hashes) with at most ``most_lines`` lines together, whole texts; a document's label stands for each
of its lines. Scoring covers every row, one Arrow batch at a time.

Defined cases: a null or empty text is one empty line and gets that line's score; rows without
a label and labels without a row are not learned from, nor are null labels; without labels of both
classes every score is 0.5. ``with_quality`` keeps all columns and replaces one of its own name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from survperf.llm.common import small_batches, take_worker

#: Labelled documents of each class, and the lines of each class, that are learned from.
SAMPLE, MOST_LINES = 1500, 100_000
STEPS, RATE, RIDGE = 200, 0.1, 1e-3

_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "stop": b".,;:?'\"()-", "bang": b"!", "bar": b"|", "mark": b"#$%&*@^~<>{}[]\\/=+_`"}
#: Class of each byte; what is in none is a letter beyond ASCII.
_OF_BYTE = np.full(256, len(_CLASSES), np.int64)
for _k, _v in enumerate(_CLASSES.values()):
    _OF_BYTE[list(_v)] = _k
N_CLASSES = len(_CLASSES) + 1
#: Own features of a line: class shares, length, words, word length, distinct words, ends with a stop, repeats in the line and document, and those of the document.
N_OWN = N_CLASSES + 11


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, their lengths in bytes, and the number of lines of each text."""
    lines: list[bytes] = []
    per_text, rows = [], []
    for text in texts:
        own = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
        seen: dict[bytes, int] = {}
        words_all: set[bytes] = set()
        total = 0
        at = len(rows)
        for n, line in enumerate(own):
            words = line.split()
            distinct = set(words)
            words_all |= distinct
            total += len(words)
            size = max(1, len(words))
            rows.append([np.log1p(len(line)), np.log1p(len(words)), min(len(line) / size, 60) / 10, len(distinct) / size if words else 1.0, 1.0 if line[-1:] in (b".", b"!", b"?") else 0.0, 1.0 if line and line in seen else 0.0, 1.0 if n and line == own[n - 1] else 0.0, 1.0 if not words else 0.0])
            seen[line] = n
        doc = [len(words_all) / total if total else 1.0, np.log1p(total), len(seen) / len(own)]
        for row in rows[at:]:
            row.extend(doc)
        lines += own
        per_text.append(len(own))
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    data = np.frombuffer(b"".join(lines), np.uint8)
    shares = np.zeros((len(lines), N_CLASSES))
    if len(data):
        ids = np.repeat(np.arange(len(lines)), sizes)
        shares = np.bincount(ids * N_CLASSES + _OF_BYTE[data], minlength=len(lines) * N_CLASSES).reshape(-1, N_CLASSES) / np.maximum(1, sizes)[:, None]
    return np.hstack([shares, np.array(rows, float).reshape(len(lines), -1)]), sizes, np.array(per_text, np.int64)


def with_neighbours(own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after in the same text, and a constant."""
    starts = np.cumsum(per_text) - per_text
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[starts] = own[starts]
    ends = starts + per_text - 1
    after[ends] = own[ends]
    return np.hstack([own, before, after, np.ones((len(own), 1))])


@dataclass
class Model:
    """Mean and scale of the features, weights of "good" against "bad", and the 2 x 2 transitions."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return with_neighbours((own - self.mean) / self.scale, per_text) @ self.weights


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(emit: np.ndarray, per_text: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line by forward-backward, and the expected transitions; label 1 is good, only its emission counts."""
    order = np.argsort(-per_text, kind="stable")
    starts = (np.cumsum(per_text) - per_text)[order]
    sizes = per_text[order]
    score = np.stack([np.zeros_like(emit), emit], 1)
    fwd, bwd = score.copy(), np.zeros_like(score)
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes.max()))] if len(sizes) else []
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        prev = fwd[at - 1]
        fwd[at] += _log_add(prev[:, :1] + moves[0], prev[:, 1:] + moves[1])
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        nxt = score[at] + bwd[at]
        bwd[at - 1] = _log_add(moves[:, 0] + nxt[:, :1], moves[:, 1] + nxt[:, 1:])
        joint = fwd[at - 1][:, :, None] + moves[None] + nxt[:, None, :]
        flat = joint.reshape(-1, 4)
        flat = np.exp(flat - flat.max(1, keepdims=True))
        pairs += (flat / flat.sum(1, keepdims=True)).sum(0).reshape(2, 2)
    both = fwd + bwd
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pairs


def train(own: np.ndarray, per_text: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
    """Maximum conditional likelihood by Adam; a text's label is that of each of its lines."""
    mean, scale = own.mean(0), own.std(0) + 1e-3
    x = with_neighbours((own - mean) / scale, per_text)
    y = np.repeat(labels, per_text).astype(float)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (per_text[labels == k] - 1).sum()
    theta = np.zeros(x.shape[1] + 4)
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(x)
    for step in range(1, steps + 1):
        good, pairs = marginals(x @ theta[:-4], per_text, theta[-4:].reshape(2, 2))
        grad = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / n - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[:-4].copy(), theta[-4:].reshape(2, 2).copy())


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label, h) of at most ``sample`` documents of each label, those of the smallest id hashes ``h``.

    An id with several labels has the smallest, one with several texts the first in order; ``id`` is the id as text.
    """
    ids = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("own")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    ids = ids.withColumn("h", F.xxhash64("own"))
    few = ids.filter("label = 0").orderBy("h").limit(sample).unionAll(ids.filter("label = 1").orderBy("h").limit(sample))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(few), F.col("doc") == F.col("own"))  # at most 2 * sample ids
    return rows.groupBy(F.col("doc").cast("string").alias("id"), "label", "h").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", most_lines: int = MOST_LINES) -> Model | None:
    """The model learned from a bounded sample of ``labels``; None without both classes.

    Sampled texts are taken in the order of their ids' hashes while those of their label have ``most_lines`` lines together;
    a text with more lines than that is passed over.
    """
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, label_col, sample, id_col, text_col)
    sizes = rows.withColumn("lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)))
    so_far = F.sum("lines").over(Window.partitionBy("label").orderBy("h", "id"))
    rows = sizes.filter(F.col("lines") <= most_lines).withColumn("so_far", so_far).filter(F.col("so_far") <= most_lines)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, _, per_text = line_features(b["text"].tolist())
            cuts = np.cumsum(per_text)[:-1]
            yield pd.DataFrame({"id": b["id"].to_numpy(), "label": b["label"].to_numpy(), "x": [x.astype(np.float32).ravel().tolist() for x in np.split(own, cuts)]})

    got = rows.select("id", "label", "text").mapInPandas(features, "id string, label int, x array<float>").toPandas().sort_values("id", kind="stable")
    if got["label"].nunique() < 2:
        return None
    own = np.concatenate([np.asarray(x, np.float64) for x in got["x"]]).reshape(-1, N_OWN)
    per_text = np.array([len(x) // N_OWN for x in got["x"]])
    return train(own, per_text, got["label"].to_numpy())


def scores(texts: list[str], model: Model | None) -> np.ndarray:
    """Length-weighted mean of P(good) of each text's lines."""
    if model is None:
        return np.full(len(texts), 0.5)
    own, sizes, per_text = line_features(texts)
    good, _ = marginals(model.emissions(own, per_text), per_text, model.moves)
    starts = np.cumsum(per_text) - per_text
    weight = sizes + 1.0
    return np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1)


def with_quality(df: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` with the quality of its texts, 0 to 1."""
    small_batches(df.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        take_worker("quality")
        for texts in batches:
            yield pd.Series(scores(texts.tolist(), model) if len(texts) else np.zeros(0))

    return df.withColumn(out_col, score(F.col(text_col)))


def keep_good(df: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose quality is ``least`` or more, with its columns."""
    # the input's columns stay inside a struct, so that none has a name of ours
    rows = df.select(F.struct("*").alias("row"), F.col(text_col).alias("own_text"))
    return with_quality(rows, model, "own_text", "score").filter(F.col("score") >= least).select("row.*")
