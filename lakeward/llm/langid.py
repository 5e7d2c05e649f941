"""Language identification by interpolated Kneser-Ney character models.

One model for each language value, over words of letters between boundary marks. The
n-grams of all languages stand in one sorted hash array for each order, with a column
for each language; contexts likewise. The language with the lowest cross-entropy per
character wins. The spread of cross-entropies on a fold that was not counted gives
the temperature of the score and, for each language, the level beyond which a text is
rejected as written in none (its score is lowered and ``rejected`` is true).

Models are fitted on a sample of at most about ``SAMPLE`` documents a language, drawn
by a hash of doc_id; every document is scored over its whole text.

Nulls and ties: null or letterless texts are ``und`` with score 0; rows with a null
lang, text or doc_id teach nothing; rows that repeat a document count each; a language
with rows in the calibration fold alone is learned from them; equal cross-entropies go
to the first language in code-point order. Without a document to learn from, as in an
empty table, every text is ``und``. The words of a text are held together while it is
worked on, about ten times its bytes. Other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.rolling import mixed

ORDER = 4
#: Documents of a language that are counted, and as many at most to calibrate on.
SAMPLE = 2_000
HELD_OUT = 2
CALIBRATION = 3
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHE = 400_000


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters. A run without one, such as of fractions, is none."""
    if not text:
        return []
    words = _LETTERS.findall(text.lower())
    return words if text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


_FACTOR, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)


def gram_hashes(text: str, order: int) -> list[np.ndarray]:
    """Entry k: for each place of ``text`` the hash of the k characters that end there."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = [np.full(len(points), _SEED)]
    for _ in range(order):
        before = np.concatenate([[_SEED], out[-1][:-1]])
        out.append(mixed(before * _FACTOR + points))
    return out


def _hash(gram: str) -> int:
    return int(gram_hashes(gram, len(gram))[-1][-1]) if gram else int(_SEED)


def counts_of(words: Counter, order: int) -> Counter:
    """Counts of the ``order``-grams that end in a letter or the end mark; shorter ones
    follow from them."""
    out: Counter = Counter()
    for word, n in words.items():
        marked = "\x02" * (order - 1) + word + "\x03"
        for end in range(order, len(marked) + 1):
            out[marked[end - order : end]] += n
    return out


def smoothed(counts: dict[str, float], order: int) -> tuple[list[dict[str, float]], list[dict[str, float]], float]:
    """By order: discounted probability of each n-gram and back-off weight of each
    context; the floor is the probability of an unseen letter."""
    by_order: list[dict[str, float]] = [*(defaultdict(float) for _ in range(order)), counts]
    for size in range(order - 1, 0, -1):
        for gram in by_order[size + 1]:
            by_order[size][gram[1:]] += 1  # continuation counts
    alphas, lambdas = [], []
    for size in range(1, order + 1):
        held = by_order[size]
        once, twice = (sum(1 for v in held.values() if v == k) for k in (1, 2))
        discount = once / (once + 2 * twice) if once else 0.5
        discount = min(max(discount, 0.1), 0.9)
        total: dict[str, float] = defaultdict(float)
        kinds: dict[str, int] = defaultdict(int)
        for gram, n in held.items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        alphas.append({g: max(n - discount, 0.0) / total[g[:-1]] for g, n in held.items()})
        lambdas.append({c: discount * kinds[c] / total[c] for c in total})
    return alphas, lambdas, 1.0 / (len(by_order[1]) + 1)


@dataclass
class Models:
    """All languages' models in sorted hash arrays."""

    languages: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floors: np.ndarray
    scale: float = 1.0
    limits: np.ndarray | None = None

    @classmethod
    def fitted(cls, counts: dict[str, dict[str, int]], order: int) -> Models:
        languages = sorted(counts)
        parts = [smoothed(counts[name], order) for name in languages]

        def stacked(which: int, size: int, missing: float) -> tuple[np.ndarray, np.ndarray]:
            rows = [{_hash(g): v for g, v in p[which][size].items()} for p in parts]
            hashes = np.array(sorted(set().union(*rows)), np.uint64)
            values = np.full((len(hashes), len(rows)), missing)
            for column, row in enumerate(rows):
                at = np.searchsorted(hashes, np.fromiter(row, np.uint64, len(row)))
                values[at, column] = np.fromiter(row.values(), np.float64, len(row))
            return hashes, values

        return cls(
            languages, order, [stacked(0, k, 0.0) for k in range(order)], [stacked(1, k, 1.0) for k in range(order)],
            np.array([p[2] for p in parts]),
        )

    def word_costs(self, words: list[str]) -> np.ndarray:
        """Negative log probability of each word under each language.

        A character's probability depends on the last ``order`` characters alone, so it
        is worked out once for each different n-gram.
        """
        pad = "\x02" * (self.order - 1)
        hashes = gram_hashes("".join(f"{pad}{w}\x03" for w in words), self.order)
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        skip = np.repeat((np.arange(len(words)) + 1) * len(pad), lengths)
        places = np.arange(len(skip)) + skip
        _, first, kind = np.unique(hashes[self.order][places], return_index=True, return_inverse=True)
        at = places[first]
        p = np.broadcast_to(self.floors, (len(at), len(self.languages)))
        for k in range(self.order):
            p = self._looked(self.grams[k], hashes[k + 1][at], 0.0) + self._looked(self.contexts[k], hashes[k][at - 1] if k else hashes[0][at], 1.0) * p
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.add.reduceat(-np.log(p)[kind], starts, axis=0)

    @staticmethod
    def _looked(held: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, missing: float) -> np.ndarray:
        hashes, values = held
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return np.where((hashes[at] == wanted)[:, None], values[at], missing)

    def entropies(self, texts: list[list[str]], cache: dict[str, int], costs: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy per character of each word list; infinite for an empty one."""
        if len(cache) > _CACHE:
            cache.clear()
            costs.clear()
        fresh = list(dict.fromkeys(w for words in texts for w in words if w not in cache))
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            base = len(cache)
            cache.update((w, base + i) for i, w in enumerate(part))
            costs.append(self.word_costs(part))
        table = np.concatenate(costs) if costs else np.zeros((0, len(self.languages)))
        costs[:] = [table]
        out = np.full((len(texts), len(self.languages)), np.inf)
        for i, words in enumerate(texts):
            if words:
                at = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
                out[i] = table[at].sum(axis=0) / (sum(map(len, words)) + len(words))
        return out

    def calibrated(self, entropies: np.ndarray, truth: np.ndarray) -> Models:
        """With the temperature of greatest likelihood, and a limit three deviations
        above the mean of each language's own texts."""
        ok = np.isfinite(entropies).all(axis=1)
        entropies, truth = entropies[ok], truth[ok]
        self.limits = np.full(len(self.languages), np.inf)
        if not len(truth):
            self.scale = 10.0
            return self
        grid = 2.0 ** np.arange(-1, 9)
        spread = entropies - entropies.min(axis=1, keepdims=True)
        own = spread[np.arange(len(truth)), truth]
        likely = [(-s * own - np.log(np.exp(-s * spread).sum(axis=1))).mean() for s in grid]
        self.scale = float(grid[int(np.argmax(likely))])
        for i in range(len(self.languages)):
            mine = entropies[truth == i, i]
            if len(mine) > 1:
                self.limits[i] = mine.mean() + 3 * max(mine.std(), 0.02)
        return self

    def judged(self, entropies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score and rejection of each row of finite entropies."""
        best = entropies.argmin(axis=1)
        least = entropies[np.arange(len(best)), best]
        score = 1 / np.exp(-self.scale * (entropies - least[:, None])).sum(axis=1)
        over = least - self.limits[best]
        return best, score * np.exp(-np.maximum(over, 0)), over > 0


def fitted(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> Models | None:
    """Models of the languages of ``docs``, or None where nothing can be learned."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("doc_id is not null and lang is not null and text is not null")
    usable = usable.withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
    calibrating = F.col("fold") == CALIBRATION
    sizes = usable.groupBy("lang", calibrating.alias("calibrating")).count().collect()
    if not sizes:
        return None
    shares = [F.when((F.col("lang") == r["lang"]) & (calibrating == r["calibrating"]), min(1.0, sample / r["count"])) for r in sizes]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    drawn = usable.where(draw < F.coalesce(*shares)).select("lang", calibrating.alias("calibrating"), "text")
    lone = sorted({r["lang"] for r in sizes} - {r["lang"] for r in sizes if not r["calibrating"]})  # of one fold: count that one
    counted = ~F.col("calibrating") | F.col("lang").isin(lone) if lone else ~F.col("calibrating")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                words[lang].update(words_of(text))
            for lang, found in words.items():
                grams = counts_of(found, order)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    grams = drawn.where(counted).select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"]][r["gram"]] = r["n"]
    if not counts:
        return None
    models = Models.fitted(dict(counts), order)
    held = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        costs: list[np.ndarray] = []
        for batch in batches:
            h = held.value.entropies([words_of(t) for t in batch.column("text").to_pylist()], cache, costs)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(h.tolist(), pa.list_(pa.float64()))], ["lang", "h"])

    rows = drawn.where("calibrating").select("lang", "text").mapInArrow(measure, "lang string, h array<double>").collect()
    rows = [r for r in rows if r["lang"] in counts]
    place = {name: i for i, name in enumerate(models.languages)}
    grid = np.array([r["h"] for r in rows]).reshape(-1, len(place))
    order_of = np.lexsort(grid.T) if len(rows) else []
    return models.calibrated(grid[order_of], np.array([place[r["lang"]] for r in rows], np.int64)[order_of])


def predicted(docs: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every document."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        costs: list[np.ndarray] = []
        models = held.value
        for batch in batches:
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            some = [i for i, words in enumerate(texts) if words] if models else []
            if some:
                best, score[some], rejected[some] = models.judged(models.entropies([texts[i] for i in some], cache, costs))
                for i, b in zip(some, best.tolist(), strict=True):
                    lang[i] = models.languages[b]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score), pa.array(rejected)],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return slim.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    """Fit on the documents' training folds and predict all of them."""
    return predicted(docs, fitted(docs, order, sample))
