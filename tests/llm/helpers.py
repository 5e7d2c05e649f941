"""Small document frames with the odd cases every operator has to bear."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "a row without an id", "en", "s1", 19), (5, None, None, None, None), (6, "", "en", "s0", 0), (7, "   \n\t ", "en", "s0", 6), (8, "one", "en", "s1", 3), (8, "one", "en", "s1", 3),
    (9, "...!!!", None, "s2", 6), (10, "Ünïcode ßtraße déjà-vu 世界 \U0001f600", "de", None, 30), (11, "x" * 3000, "en", "s1", 3000),
]


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))


def corpus(seed: int = 0, n: int = 40) -> list[tuple]:
    """Texts with exact copies, near copies and shared passages, and the odd rows."""
    rng = random.Random(seed)
    passage = prose(999, 80)
    out = []
    for i in range(100, 100 + n):
        text = prose(i, rng.choice([5, 30, 120, 300]))
        if i % 5 == 0 and out:
            text = rng.choice(out)[1]
        elif i % 7 == 0:
            words = prose(i, 150).split()
            words[20:20] = passage.split()
            text = "  ".join(words[:90]) + "\n" + " ".join(words[90:])
        elif i % 11 == 0 and len(out) > 2:
            words = out[-2][1].split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        out.append((i, text, "en", f"s{i % 3}", len(text)))
    return out + ODD + [(500, prose(1, 60) * 400, "en", "s0", 0)]


def frame(spark, rows=None, clash=True):
    """The documents frame, with extra columns whose names operators might use."""
    df = spark.createDataFrame(corpus() if rows is None else rows, DOCS)
    if clash:
        for c in ("score", "row", "key", "fp", "shard", "size", "n"):
            df = df.selectExpr("*", f"'own' AS {c}")
    return df
