"""Document quality by positive-unlabelled learning.

Trusted positives are documents labelled 1, the rest of the sample is unlabelled web
text. A linear model over the shape of a text (shares of kinds of bytes, word lengths,
repetition) minimises the non-negative unbiased risk

    prior * E_pos[l(+f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])

with the sigmoid loss. The class prior is estimated first: a plain positive-against-
unlabelled model, fitted on one half, ranks the other, and the least ratio of
unlabelled to positive mass above a threshold bounds the share of positives. Labels of both values in the training
folds then scale the output to a probability.

The fit uses at most about ``SAMPLE`` labelled documents and as many without a label.
The two are drawn apart by a hash of doc_id, so few labels among many documents are all
used; every document is scored over its whole text. doc_id, source, lang and labels are
no features.

Nulls and ties: a null text is empty; an empty text has features of its own and a
score like any other; a null doc_id or label teaches nothing; a doc_id with labels of
both values counts as unlabelled. Rows that repeat a doc_id teach once, by the text of
least hash, and are scored one by one. Without a positive to learn from, as in empty
tables, a warning is given and every score is 0.5. A very long text takes about thirty
times its bytes in its worker while its words are counted. Columns of documents and
labels that are not named here may have any name.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.langid import HELD_OUT, fold
from lakeward.llm.words import rows_of

SAMPLE = 20_000
THRESHOLD = 0.7
_STEPS = 600


def _kinds() -> np.ndarray:
    """A row for each kind of byte."""
    rows = np.zeros((9, 256))
    for c in range(256):
        ch = chr(c)
        kind = 0 if c >= 0x80 else 1 if ch.islower() else 2 if ch.isupper() else 3 if ch.isdigit() else 4 if ch == "\n" else 5 if ch.isspace() else 6 if ch in ".,;:!?'\"()-" else 7 if c >= 0x20 else 8
        rows[kind, c] = 1
    return rows


_KINDS = _kinds()
#: A symbol that ends a word, common punctuation aside.
_MARKED = re.compile(rb"[#$%&*+/<=>@\\^_`{|}~\[\]](?=\s|$)")


def features(text: bytes | None) -> np.ndarray:
    """The shape of a text; every entry is of the order of 1."""
    text = text or b""
    words = text.split()
    n, size = len(words), max(1, len(text))
    octets = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = _KINDS @ octets / size
    p = octets[octets > 0] / size
    lines = [line for line in text.split(b"\n") if line.strip()]
    length = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    spans = [words[i : i + 200] for i in range(0, n, 200)]
    variety = [len(set(s)) / len(s) for s in spans if len(s) >= 50] or [len(set(words)) / max(1, n)]
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    marked = len(_MARKED.findall(text)) / max(1, n)
    stuck = sum(map(eq, words, words[1:])) / max(1, n - 1)
    barred = text.count(b" | ") / max(1, n)
    shouted = sum(map(bytes.isupper, words)) / max(1, n)
    once = max(Counter(words).values(), default=0) / max(1, n)
    x = np.array([
        *np.sqrt(share), float((-p * np.log2(p)).sum()) / 8, np.log1p(n) / 8, length.mean() / 8, np.log1p(length.max()) / 4, length.std() / 8,
        np.mean(variety), min(variety), pairs, *np.sqrt([marked, stuck, barred, shouted]), once, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)) / 4,
        float(n == 0), float(0 < n < 20), (length == 1).mean(),
    ])
    return np.concatenate([x, x[:24] ** 2])


@dataclass
class Model:
    """A standardised linear score and its scaling to a probability."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return z @ self.weights[1:] + self.weights[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margins(x) + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _descent(gradient, size: int, steps: int = _STEPS, rate: float = 0.02) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of unlabelled to positive mass above a threshold that keeps half
    of the positives."""
    cuts = np.quantile(positive, np.linspace(0, 0.5, 11))
    ratios = [(unlabelled >= c).mean() / max((positive >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.98))


def _ranked_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The prior by rankings that were fitted on the other half of both sets, since a
    ranking sets the rows it was fitted on apart."""
    if min(len(pos), len(unl)) < 20:
        return 0.5
    out: list[list[np.ndarray]] = [[], []]
    for half in (0, 1):
        p, u = pos[half::2], unl[half::2]
        side = np.repeat([1.0, 0.0], [len(p), len(u)])
        w = _logistic(np.vstack([p, u]), side, np.where(side > 0, 1 / len(p), 1 / len(u)), 1e-2)
        for place, rest in enumerate((pos[1 - half :: 2], unl[1 - half :: 2])):
            out[place].append(rest @ w[1:] + w[0])
    return float(np.mean([estimated_prior(a, b) for a, b in zip(*out, strict=True)]))


def non_negative(pos: np.ndarray, unl: np.ndarray, prior: float, decay: float = 1e-3) -> np.ndarray:
    """Weights (first the offset) of least non-negative unbiased risk."""
    p, u = (np.hstack([np.ones((len(x), 1)), x]) for x in (pos, unl))

    def gradient(w: np.ndarray) -> np.ndarray:
        # l(z) = sigmoid(-z), so d l(f) = -s and d l(-f) = +s with s = slope at f.
        fp, fu = _sigmoid(p @ w), _sigmoid(u @ w)
        sp, su = fp * (1 - fp), fu * (1 - fu)
        gain, loss = p.T @ sp / len(p), u.T @ su / len(u)
        negative = fu.mean() - prior * fp.mean()
        step = -prior * gain + (loss - prior * gain) if negative >= 0 else -(loss - prior * gain)
        return step + decay * np.concatenate([[0], w[1:]])

    return _descent(gradient, p.shape[1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    a = np.hstack([np.ones((len(x), 1)), x])
    return _descent(lambda w: a.T @ (weight * (_sigmoid(a @ w) - y)) / weight.sum() + decay * np.concatenate([[0], w[1:]]), a.shape[1])


def fit(x: np.ndarray, label: np.ndarray) -> Model | None:
    """``label``: 1 and 0 as labelled, -1 for unlabelled rows."""
    if not (label == 1).any():
        return None
    deviation = x.std(axis=0)
    model = Model(x.mean(axis=0), np.where(deviation > 1e-9, deviation, 1.0), np.zeros(x.shape[1] + 1), 0.5)
    z = np.clip((x - model.mean) / model.deviation, -8, 8)
    pos, unl = z[label == 1], z[label == -1]
    known = np.flatnonzero(label >= 0)
    if not len(unl):
        unl = z[known]
    model.prior = _ranked_prior(pos, unl)
    model.weights = non_negative(pos, unl, model.prior)
    zeros = int((label == 0).sum())
    if zeros:
        margin = model.margins(x[known])[:, None]
        model.offset, model.slope = _logistic(margin, label[known].astype(float), np.ones(len(known)), 0.0).tolist()
        if model.slope <= 0:
            model.slope, model.offset = 1.0, 0.0
    return model


def _labels(labels: DataFrame) -> DataFrame:
    clean = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    clean = clean.where((fold(F.col("label_id")) != HELD_OUT) & F.col("quality").isin(0, 1))
    return clean.groupBy("label_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi").select("label_id", F.col("lo").alias("quality"))


def drawn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, y (1 or 0 as labelled, else -1) and text of the documents to learn from.

    Only doc_ids are joined to the labels; the ids that are drawn, of which ``sample``
    bounds either kind, are then looked for among the texts.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(fold(F.col("doc_id")) != HELD_OUT)
    marked = usable.select("doc_id").distinct().join(_labels(labels), F.col("doc_id") == F.col("label_id"), "left")
    every, known = marked.agg(F.count("*"), F.count("quality")).first()
    share = F.when(F.col("quality").isNull(), sample / max(1, every - known)).otherwise(sample / max(1, known))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    chosen = marked.where(place < share).select(F.col("doc_id").alias("chosen"), F.coalesce("quality", F.lit(-1)).alias("y"))
    rows = usable.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "y")), pa.array([features(t).tolist() for t in texts], pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = drawn(docs, labels, sample).mapInArrow(shape, "doc_id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    model = fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])) if rows else None
    if model is None:
        warnings.warn("no document is labelled 1: quality is not learned", stacklevel=2)
    return model


def scored(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a column for the score and one for the predicted class."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            if held.value is None or not texts:
                score = np.full(len(texts), 0.5)
            else:
                score = held.value.scores(np.array([features(t) for t in texts]))
            yield batch.append_column(names[0], pa.array(score)).append_column(names[1], pa.array((score >= threshold).astype(np.int32)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(judge, f"{kinds}, `{names[0]}` double, `{names[1]}` int")


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return scored(slim, fitted(docs, labels, sample), threshold).drop("text")


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents the classifier does not reject, whole rows; all of them where the
    labels have nothing to fit it on."""
    model = fitted(docs, labels, sample)
    if model is None:
        return docs
    own = "_" * (1 + max(map(len, docs.columns)))  # no column has so long a name
    names = (f"{own}score", f"{own}predicted")
    return scored(docs, model, threshold, names).where(F.col(names[1]) == 1).drop(*names)
