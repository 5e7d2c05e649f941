"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

Both are interpolated character models over words of letters between boundary marks. The
longest n-grams are counted for each class apart; what they leave goes to shorter ones
whose continuation counts are shared, taken from every document, labelled or not, so a
rare expression costs about the same under both. A passage is as many words in a row as
``PASSAGE``; its toxic minus its ordinary log-likelihood is divided by its length in
characters. A text's greatest passage, its mean and its length are scaled to a
probability on a fold of labelled documents that no class count has seen.

Counts cover all documents and all usable labels and are made, joined and smoothed by
Spark; no table of them passes the driver whole, and none is cut: every n-gram of the
documents has its log ratio of both classes. The most frequent ``MOST`` at most are
broadcast as one array. A text with a rarer one is kept with the n-grams it lacks, which
are joined to it; a rare n-gram stands in few texts, so no key of that join is large.
Labels are broadcast up to ``LABELS`` rows, counted first, and joined beyond. The scaling
is fitted on at most about ``SAMPLE`` documents, drawn by a hash of doc_id.

``judged`` works that way. ``fitted`` and ``scored`` are for texts that were not counted,
such as those of a stream: they pack the same model into arrays for broadcasting, and
there n-grams and contexts of less than 1 / ``SHARE`` of all counts of their table (of
both classes) leave their mass to the shorter ones, so that probabilities add up to one.

Nulls and ties: a null text is empty; a text without letters has the same score as any
other such text; a null doc_id or label and a doc_id labelled both 0 and 1 teach nothing.
Rows that repeat a doc_id count and are scored one by one. Without a label of either
class, as in empty tables, a warning is given and every score is 0. The words of a text
are held together while it is worked on, about ten times its bytes. Columns of documents
and labels that are not named here may have any name.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.langid import CALIBRATION, HELD_OUT, counts_of, fold, gram_hashes, words_of
from lakeward.llm.shared import discard, stored

ORDER = 5
SHARE = 1 << 18
#: N-grams whose log ratio is broadcast.
MOST = 1 << 19
LABELS = 1 << 20
SAMPLE = 20_000
PASSAGE = 8
THRESHOLD = 0.3
CLASSES = ("ordinary", "toxic")
#: Entries a task's counters hold before they are given away, and words whose value it keeps.
_HELD, _CACHE = 1_000_000, 400_000


# ---- counts ---------------------------------------------------------------------------


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELS) -> DataFrame:
    """doc_id, text and y (0 or 1 as labelled, else null; null throughout the held-out
    fold)."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("y")).where((fold(F.col("label_id")) != HELD_OUT) & F.col("y").isin(0, 1))
    known = known.groupBy("label_id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).where("y = _most").drop("_most")
    known = F.broadcast(known) if known.count() <= most else known
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.join(known, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")


def counted(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, shared, ordinary and toxic: how often each ``order``-gram stands in the words
    of all documents and of those of each class, the calibration fold aside. A word
    counts once a document, so that one that repeats it is no evidence for its class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[Counter] = [Counter(), Counter(), Counter()]

        def given() -> pa.RecordBatch:
            grams = [counts_of(w, order) for w in words]
            for w in words:
                w.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(grams[0]), pa.string()), *(pa.array([g[k] for k in grams[0]], pa.int64()) for g in grams)], ["gram", "shared", *CLASSES])

        for batch in batches:
            for text, which in zip(*(batch.column(c).to_pylist() for c in ("text", "which")), strict=True):
                found = set(words_of(text))
                words[0].update(found)
                if which is not None:
                    words[1 + which].update(found)
                if len(words[0]) > _HELD:
                    yield given()
        yield given()

    which = F.when(fold(F.col("doc_id")) != CALIBRATION, F.col("y"))
    grams = rows.select("text", which.alias("which")).mapInArrow(count, "gram string, shared long, ordinary long, toxic long")
    return grams.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("shared", *CLASSES)))


# ---- models ---------------------------------------------------------------------------


Table = tuple[np.ndarray, np.ndarray]


def discount(n1: int, n2: int) -> float:
    return min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.9)


def learned(rows: DataFrame, order: int) -> dict[int, DataFrame] | None:
    """By order: the stored counts of n-grams of ``labelled`` rows, those of the classes for
    the longest and continuation counts for the others. None, with a warning, where a
    class has none to learn from."""
    grams = stored(counted(rows, order), "toxicity-grams")
    if not all(grams.agg(*(F.sum(c) for c in CLASSES)).first()):
        discard(rows.sparkSession, grams)
        warnings.warn("no document is labelled in one of the classes: toxicity is not learned", stacklevel=4)
        return None
    levels = {order: grams}
    for size in range(order - 1, 0, -1):  # in how many longer n-grams each one ends
        levels[size] = stored(levels[size + 1].groupBy(F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n")), f"toxicity-{size}-grams")
    return levels


def valued(levels: dict[int, DataFrame]) -> DataFrame:
    """gram, n and value: the count of each longest n-gram in all documents, and its toxic
    minus its ordinary log probability after its context. Shorter n-grams are all in
    ``levels``, so each one finds its context and what it ends in. The joins are merged, as
    broadcasts of that many n-grams are built in the driver."""
    order = max(levels)

    def beside(size: int, columns: tuple[str, ...], below: DataFrame | None) -> tuple[DataFrame, dict[str, Column]]:
        grams = levels[size].withColumn("context", F.substring("gram", 1, size - 1))
        once = grams.agg(*(F.count_if(F.col(c) == n) for c in columns for n in (1, 2))).first()
        totals = [F.sum(c).alias(f"{c}_total") for c in columns] + [F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in columns]
        out = grams.join(grams.groupBy("context").agg(*totals).hint("merge"), "context")
        if below is None:
            out = out.withColumn("below", F.lit(1.0 / (grams.count() + 1)))
        else:
            out = out.withColumn("end", F.substring("gram", 2, size - 1)).join(below.select(F.col("gram").alias("end"), F.col("p").alias("below")).hint("merge"), "end")
        p = {}
        for i, c in enumerate(columns):
            d = F.lit(discount(*once[2 * i : 2 * i + 2]))
            mixed = (F.greatest(F.col(c) - d, F.lit(0.0)) + d * F.col(f"{c}_kinds") * F.col("below")) / F.col(f"{c}_total")
            p[c] = F.when(F.col(f"{c}_total") > 0, mixed).otherwise(F.col("below"))
        return out, p

    below = None
    for size in range(1, order):
        out, p = beside(size, ("n",), below)
        below = out.select("gram", p["n"].alias("p"))
    out, p = beside(order, CLASSES, below)
    return out.select("gram", F.col("shared").alias("n"), (F.log(p["toxic"]) - F.log(p["ordinary"])).alias("value"))


def common(values: DataFrame, most: int = MOST) -> DataFrame:
    """The most frequent of ``valued`` n-grams, at most ``most``: those from the least count
    on, in steps of an eighth of a power of two, that leaves no more."""
    step = F.floor(F.log2("n") * 8)
    least, held = None, 0
    for row in values.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += row["count"]
        if held > most:
            break
        least = row["step"]
    return values.where(step >= least) if least is not None else values.limit(0)


def smoothed(grams: DataFrame, count: str, order: int, share: int = SHARE, beside: tuple[str, ...] = ()) -> tuple[Table, Table]:
    """Discounted probabilities of the n-grams of ``count`` and back-off weights of their
    contexts, as sorted hash arrays: those of at least 1 / ``share`` of all its counts, or
    of the counts ``beside`` it, so that classes keep the same ones."""
    every = grams.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in (count, *beside)), F.count_if(F.col(count) == 1), F.count_if(F.col(count) == 2)).first()
    d, least = discount(*every[-2:]), {c: n / share for c, n in zip((count, *beside), every[:-2], strict=True)}

    def frequent() -> Column:
        return reduce(or_, (F.col(c) >= n for c, n in least.items()))

    marked = grams.select("gram", F.substring("gram", 1, order - 1).alias("context"), *least, frequent().alias("kept")).withColumn("p", F.greatest(F.col(count) - d, F.lit(0.0)))
    sums = marked.groupBy("context").agg(*(F.sum(c).alias(c) for c in least), F.sum(F.when(F.col("kept"), F.col("p")).otherwise(0.0)).alias("given"))
    sums = sums.where((F.col(count) > 0) & frequent())
    contexts = sums.select("context", (1 - F.col("given") / F.col(count)).alias("weight")).toPandas()
    kept = marked.where("kept").select("gram", "context", "p").where("p > 0")
    p = kept.join(sums.select("context", F.col(count).alias("total")), "context").select("gram", (F.col("p") / F.col("total")).alias("p")).toPandas()
    return hashed(p["gram"], p["p"], order), hashed(contexts["context"], contexts["weight"], order - 1)


def hashed(keys, values, size: int) -> Table:
    """Values by the hash of their n-gram of ``size`` characters, in order of the hash."""
    points = gram_hashes("".join(keys), size)[size]
    # The hash of a gram does not depend on what stands before it.
    h = points[size - 1 :: size] if size else np.full(len(keys), points[0] if len(points) else gram_hashes("\x02", 0)[0][0])
    order = np.argsort(h)
    return h[order], np.asarray(values, np.float64)[order]


def looked_up(held: Table, wanted: np.ndarray, missing: float) -> np.ndarray:
    hashes, values = held
    if not len(hashes):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[at] == wanted, values[at], missing)


def placed(words: list[str], order: int) -> tuple[str, list[np.ndarray], np.ndarray, np.ndarray]:
    """The words between their marks, ``gram_hashes`` of that text, the places where an
    n-gram of a word ends, and which of these is each word's first."""
    pad = "\x02" * (order - 1)
    marked = "".join(f"{pad}{w}\x03" for w in words)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    places = np.arange(lengths.sum()) + np.repeat((np.arange(len(words)) + 1) * len(pad), lengths)
    return marked, gram_hashes(marked, order), places, np.concatenate([[0], np.cumsum(lengths)[:-1]])


@dataclass
class Common:
    """Log ratios of the most frequent n-grams."""

    order: int
    values: Table

    @classmethod
    def of(cls, values: DataFrame, order: int) -> Common:
        """Of all ``values``, hashed in the tasks so that 16 bytes each reach the driver."""

        def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, held = hashed(batch.column("gram").to_pylist(), batch.column("value").to_numpy(), order)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(held)], ["h", "value"])

        rows = values.select("gram", "value").mapInArrow(points, "h long, value double").toPandas()
        h = rows["h"].to_numpy(np.int64).view(np.uint64)
        at = np.argsort(h)
        return cls(order, (h[at], rows["value"].to_numpy(np.float64)[at]))

    def ratios(self, words: list[str], rare: dict[str, float] | None = None) -> np.ndarray:
        """Toxic minus ordinary log probability of each word; NaN where it has an n-gram
        that is neither held nor ``rare``."""
        marked, hashes, places, first = placed(words, self.order)
        found = looked_up(self.values, hashes[self.order][places], np.nan)
        if rare is not None:
            at = np.flatnonzero(np.isnan(found))
            found[at] = [rare[marked[i - self.order + 1 : i + 1]] for i in places[at]]
        return np.add.reduceat(found, first)

    def lacking(self, words: list[str]) -> list[str]:
        """The distinct n-grams of ``words`` that are not held."""
        marked, hashes, places, _ = placed(words, self.order)
        at = places[np.isnan(looked_up(self.values, hashes[self.order][places], np.nan))]
        return list(dict.fromkeys(marked[i - self.order + 1 : i + 1] for i in at))


@dataclass
class Models:
    """Shared tables by order, and the longest order of each class."""

    order: int
    shared: list[tuple[Table, Table]]
    classes: list[tuple[Table, Table]]
    floor: float
    scale: np.ndarray | None = None

    def ratios(self, words: list[str]) -> np.ndarray:
        """Toxic minus ordinary log probability of each word."""
        _, hashes, places, starts = placed(words, self.order)
        _, first, kind = np.unique(hashes[self.order][places], return_index=True, return_inverse=True)
        at = places[first]

        def mixed_in(tables: tuple[Table, Table], size: int, below: np.ndarray) -> np.ndarray:
            return looked_up(tables[0], hashes[size][at], 0.0) + looked_up(tables[1], hashes[size - 1][at - 1], 1.0) * below

        p = np.full(len(at), self.floor)
        for size, tables in enumerate(self.shared, 1):
            p = mixed_in(tables, size, p)
        ordinary, toxic = (np.log(mixed_in(t, self.order, p)) for t in self.classes)
        return np.add.reduceat((toxic - ordinary)[kind], starts)


def measures(values: np.ndarray, words: list[str]) -> list[float]:
    """Greatest passage, mean and log of the length of a text of ``words`` of ``values``."""
    if not words:
        return [0.0, 0.0, 0.0]
    sums = np.concatenate([[0.0], np.cumsum(values)])
    chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    k = min(PASSAGE, len(words))
    return [float(((sums[k:] - sums[:-k]) / (chars[k:] - chars[:-k])).max()), float(sums[-1] / chars[-1]), float(np.log1p(len(words)))]


def scaling(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The scaling of greatest likelihood, by Newton's method with halved steps."""
    if len(set(y.tolist())) < 2:  # nothing to scale by: a passage that is likelier toxic counts as such
        return np.array([0.0, 4.0, 0.0, 0.0, 0.0])
    a = _columns(x)
    decay = np.array([1e-6] + [1e-2] * (a.shape[1] - 1))

    def cost(w: np.ndarray) -> float:
        f = a @ w
        return float((np.logaddexp(0, f) - y * f).sum() + (decay * w * w).sum() / 2)

    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = _sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(decay), a.T @ (p - y) + decay * w)
        while cost(w - step) > cost(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _columns(x: np.ndarray) -> np.ndarray:
    """1, the passage and its square root, the mean, the length."""
    x = np.asarray(x, np.float64).reshape(-1, 3)
    passage = np.clip(x[:, 0], -1, 2)
    return np.column_stack([np.ones(len(x)), passage * 4, np.sqrt(np.maximum(passage, 0)) * 2, np.clip(x[:, 1], -1, 1) * 10, x[:, 2] / 4])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fitted(rows: DataFrame, order: int = ORDER, share: int = SHARE, sample: int = SAMPLE) -> Models | None:
    """Models of ``labelled`` rows for texts that were not counted, or None where a class
    has none to learn from."""
    levels = learned(rows, order)
    if levels is None:
        return None
    classes = [smoothed(levels[order], c, order, share, tuple(x for x in CLASSES if x != c)) for c in CLASSES]
    shared = [smoothed(levels[size], "n", size, share) for size in range(1, order)]
    models = Models(order, shared, classes, 1.0 / (levels[1].count() + 1))
    discard(rows.sparkSession, *levels.values())
    models.scale = calibrated(measured(rows.where(usable()), models), sample)
    return models


def usable() -> Column:
    return (fold(F.col("doc_id")) == CALIBRATION) & F.col("y").isNotNull()


def calibrated(measured_rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The scaling by a sample of the usable of ``measured`` rows."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    n = measured_rows.where(usable()).count()
    drawn = measured_rows.where(usable() & (place < sample / max(1, n))).select("doc_id", "y", "x").toPandas()
    drawn["key"] = drawn["x"].map(tuple)
    drawn = drawn.sort_values(["doc_id", "key"])
    return scaling(np.array(drawn["x"].tolist()).reshape(-1, 3), drawn["y"].to_numpy(np.float64))


def remember(texts: list[list[str]], models: Models | Common, cache: dict[str, float]) -> None:
    """Put the value of every word into the cache."""
    if len(cache) > _CACHE:
        cache.clear()
    fresh = list(dict.fromkeys(w for words in texts for w in words if w not in cache))
    for i in range(0, len(fresh), 20_000):
        part = fresh[i : i + 20_000]
        cache.update(zip(part, models.ratios(part).tolist(), strict=True))


def measured(rows: DataFrame, models: Models | Common) -> DataFrame:
    """doc_id, y and ``x``, the measures of every row. Where a word of it has no value, x is
    null and ``text`` and ``lacking``, the n-grams that are not held, are not."""
    held = rows.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [words_of(t) for t in texts]
            remember(found, held.value, cache)
            x, kept, lacking = [], [], []
            for text, words in zip(texts, found, strict=True):
                values = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
                at = np.flatnonzero(np.isnan(values))
                x.append(None if len(at) else measures(values, words))
                kept.append(text if len(at) else None)
                lacking.append(held.value.lacking(list(dict.fromkeys(words[i] for i in at))) if len(at) else None)
            columns = [batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64())), pa.array(kept, pa.string()), pa.array(lacking, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "y", "x", "text", "lacking"])

    return rows.select("doc_id", "y", "text").mapInArrow(measure, "doc_id long, y int, x array<double>, text string, lacking array<string>")


def completed(first: DataFrame, values: DataFrame, models: Common) -> DataFrame:
    """doc_id, y and x of all ``measured`` rows, by joins to the n-grams that they lack. An
    n-gram that is not held is rare, and so is each text that has it."""
    held = first.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            found = [words_of(t) for t in batch.column("text").to_pylist()]
            remember(found, held.value, cache)
            x = []
            for words, rare in zip(found, batch.column("rare").to_pylist(), strict=True):
                values = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
                at = np.flatnonzero(np.isnan(values))
                values[at] = held.value.ratios([words[i] for i in at], dict(rare))
                x.append(measures(values, words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    left = first.where(F.col("lacking").isNotNull()).withColumn("key", F.sha2("text", 256))
    needed = left.dropDuplicates(["key"]).select("key", F.explode("lacking").alias("gram")).join(values.select("gram", "value"), "gram")
    found = needed.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("gram", "value"))).alias("rare"))
    rest = left.join(found, "key").select("doc_id", "y", "text", "rare").mapInArrow(measure, "doc_id long, y int, x array<double>")
    return first.where(F.col("lacking").isNull()).select("doc_id", "y", "x").unionByName(rest)


def graded(measured_rows: DataFrame, scale: np.ndarray, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted and passage, the log ratio by character of the
    worst passage, for every measured row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, 3)
            score = _sigmoid(_columns(x) @ scale)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(x[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "passage"])

    return measured_rows.select("doc_id", _held_out(), "x").mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int, passage double")


def _held_out() -> Column:
    return F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")


def unlearned(docs: DataFrame) -> DataFrame:
    """The columns of ``graded``, a score of 0 for every document."""
    zero = F.lit(0.0)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", _held_out(), zero.alias("score"), F.lit(0).alias("predicted"), zero.alias("passage"))


def scored(docs: DataFrame, models: Models | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and passage of every document by ``fitted``
    models."""
    if models is None:
        return unlearned(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("int").alias("y"), "text")
    return graded(measured(slim, models), models.scale, threshold)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, order: int = ORDER, most: int = MOST) -> DataFrame:
    """Fit on the training folds and score every document, over all n-grams."""
    rows, spark = labelled(docs, labels), docs.sparkSession
    levels = learned(rows, order)
    if levels is None:
        return unlearned(docs)
    values = stored(valued(levels), "toxicity-values")
    discard(spark, *levels.values())
    models = Common.of(common(values, most), order)
    first = stored(measured(rows, models), "toxicity-measured")
    if first.where(F.col("lacking").isNotNull()).isEmpty():
        discard(spark, values)
        complete = first
    else:
        complete = stored(completed(first, values, models), "toxicity-measures")
        discard(spark, values, first)
    return graded(complete, calibrated(complete), threshold)
