"""Toxicity, filter audit and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from helpers import ODD, corpus, frame, prose

from lakeward.llm import filter_audit, periodic, toxicity

LABELS = "doc_id long, quality int, toxic int"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


# ---- toxicity -------------------------------------------------------------------------


def rude(n=500, seed=2):
    """Texts of which a fifth hold one to three insults, inflected, some in long texts."""
    rng = random.Random(seed)
    syllables = ("ka", "lo", "mi", "tu", "re", "san")
    docs, labels, truth = [], [], {}
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([5, 30, 100, 600]))]
        bad = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["zwurg", "blarft"]) + rng.choice(["", "en", "ka", "!"])
        docs.append((i, " ".join(words), "en", "s", 1))
        truth[i] = int(bool(re.search("zwurg|blarft", docs[-1][1])))
        if rng.random() < 0.6:
            labels.append((i, 1, truth[i]))
    return docs, labels, truth


def test_toxic_texts_are_found_on_held_out_rows(spark):
    docs, labels, truth = rude()
    got = toxicity.judged(frame(spark, docs), spark.createDataFrame([*labels, (None, 1, 1), (3, 0, None)], LABELS)).collect()
    out = [r for r in got if r.held_out]
    assert len(out) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    again = toxicity.judged(frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in again}


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels, _ = rude(200)
    flipped = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    scores = [{r.doc_id: r.score for r in toxicity.judged(frame(spark, docs), spark.createDataFrame(rows, LABELS)).collect()} for rows in (labels, flipped)]
    assert scores[0] == scores[1]


def test_toxicity_of_odd_rows_and_empty_tables(spark):
    docs, labels, _ = rude(200)
    marks, none = spark.createDataFrame(labels, LABELS), spark.createDataFrame([], LABELS)
    got = toxicity.judged(frame(spark, [*docs, *ODD]), marks).collect()
    assert len(got) == len(docs) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (5, 6, 7, 9) and not r.passage}) >= 1
    with pytest.warns(UserWarning, match="not learned"):
        assert {(r.score, r.predicted) for r in toxicity.judged(frame(spark, docs), none).collect()} == {(0.0, 0)}
    with pytest.warns(UserWarning, match="not learned"):
        assert not toxicity.judged(frame(spark, []), none).count()


def test_labels_are_joined_beyond_the_bound(spark):
    docs, labels, _ = rude(60)
    marks = spark.createDataFrame([*labels, (7, 1, 0), (7, 1, 1)], LABELS)
    rows = [sorted(map(tuple, toxicity.labelled(frame(spark, docs), marks, most).collect()), key=str) for most in (1, 1 << 20)]
    assert rows[0] == rows[1] and len(rows[0]) == 60
    assert {d: y for d, _, y in rows[0]} == {d: None for d, *_ in docs} | {d: t for d, _, t in labels if not held(d) and d != 7}


def plain_classes(docs, labels, order):
    """Probability of a character under each class, straight from the definition."""
    marks = {d: t for d, _, t in labels if not held(d)}
    counts = [Counter(), Counter(), Counter()]
    for d, text, *_ in docs:
        for word in set(toxicity.words_of(text)):
            marked = "\x02" * (order - 1) + word + "\x03"
            grams = [marked[i - order + 1 : i + 1] for i in range(order - 1, len(marked))]
            counts[0].update(grams)
            if d in marks and zlib.crc32(str(d).encode()) % 4 != 3:
                counts[1 + marks[d]].update(grams)
    levels = {order: counts[0]}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def part(held, gram, below):
        n1, n2 = (sum(v == n for v in held.values()) for n in (1, 2))
        d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.9)
        seen = [n for g, n in held.items() if g[:-1] == gram[:-1]]
        return (max(held[gram] - d, 0) + d * len(seen) * below) / sum(seen) if seen else below

    def p(which, gram):
        out = 1 / (len(levels[1]) + 1)
        for k in range(1, order):
            out = part(levels[k], gram[order - k :], out)
        return part(counts[1 + which], gram, out)

    return p


def test_ratios_are_those_of_a_plain_model(spark):
    docs, labels, _ = rude(60, 5)
    models = toxicity.fitted(toxicity.labelled(frame(spark, docs), spark.createDataFrame(labels, LABELS)))
    p = plain_classes(docs, labels, toxicity.ORDER)
    words = ["kalo", "zwurg", "blarften", "mitu", "qqq", "s"]
    for word, ratio in zip(words, models.ratios(words), strict=True):
        marked = "\x02" * (toxicity.ORDER - 1) + word + "\x03"
        grams = [marked[i - toxicity.ORDER + 1 : i + 1] for i in range(toxicity.ORDER - 1, len(marked))]
        assert abs(sum(np.log(p(1, g)) - np.log(p(0, g)) for g in grams) - ratio) < 1e-9


def test_rare_grams_leave_their_mass_to_shorter_ones(spark):
    docs, labels, _ = rude(120, 6)
    rows = toxicity.labelled(frame(spark, docs), spark.createDataFrame(labels, LABELS))
    models = toxicity.fitted(rows, order=2, share=100)
    whole = toxicity.fitted(rows, order=2)
    assert 0 < len(models.classes[1][0][0]) < len(whole.classes[1][0][0])
    letters = sorted({c for _, text, *_ in docs for word in toxicity.words_of(text) for c in word}) + ["\x03", "\u4e16"]
    for m in (models, whole):
        for which in (0, 1):
            total = 0.0
            for c in letters:
                hashes = toxicity.gram_hashes("k" + c, 2)
                low = toxicity.looked_up(m.shared[0][0], hashes[1][1:], 0.0) + toxicity.looked_up(m.shared[0][1], hashes[0][1:], 1.0) * m.floor
                total += (toxicity.looked_up(m.classes[which][0], hashes[2][1:], 0.0) + toxicity.looked_up(m.classes[which][1], hashes[1][:1], 1.0) * low)[0]
            assert abs(total - 1) < 1e-9


def test_no_gram_is_left_out_however_rare(spark):
    """Passages of every document against plain counts, where a class has more than 2^18
    counts, so that an n-gram that occurs once has less than 1 / 2^18 of them, and where
    few n-grams are broadcast."""
    rng = random.Random(8)
    common = ["".join(rng.choice("abcdef") for _ in range(9)) for _ in range(3000)]
    docs, labels = [], []
    for i in range(260):
        words = [*rng.sample(common, 400), *("".join(rng.choice("uvwxyz") for _ in range(4)) for _ in range(3)), f"zw{'ur' * (i % 3)}g"]
        rng.shuffle(words)
        docs.append((i, " ".join(words if i % 4 else words[:3] + words[-3:]), "en", "s", 1))
        labels.append((i, 1, int(i % 9 == 0)))
    docs += [(1, docs[1][1], "en", "s", 1), (900, "zwurg " * 20, "en", "s", 1), (901, "", "en", "s", 1), (902, None, "en", "s", 1), (None, "zwurg \U0001d4b3\u4e16 uvwx", "en", "s", 1)]
    order = toxicity.ORDER
    marks, counts = {d: t for d, _, t in labels if not held(d) and zlib.crc32(str(d).encode()) % 4 != 3}, [Counter(), Counter(), Counter()]

    def grams_of(word):
        marked = "\x02" * (order - 1) + word + "\x03"
        return [marked[i - order + 1 : i + 1] for i in range(order - 1, len(marked))]

    for d, text, *_ in docs:
        for word in set(toxicity.words_of(text)):
            counts[0].update(grams_of(word))
            if d in marks:
                counts[1 + marks[d]].update(grams_of(word))
    assert sum(counts[1].values()) > 1 << 18
    levels = {order: counts[0]}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    contexts = {}
    for name, table in [*levels.items(), ("ordinary", counts[1]), ("toxic", counts[2])]:
        once, twice = (sum(v == n for v in table.values()) for n in (1, 2))
        totals, kinds = Counter(), Counter()
        for g, n in table.items():
            totals[g[:-1]] += n
            kinds[g[:-1]] += 1
        contexts[name] = (table, min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9), totals, kinds)

    def part(name, gram, below):
        table, d, totals, kinds = contexts[name]
        n = totals[gram[:-1]]
        return (max(table[gram] - d, 0) + d * kinds[gram[:-1]] * below) / n if n else below

    def ratio(gram):
        p = 1 / (len(levels[1]) + 1)
        for k in range(1, order):
            p = part(k, gram[order - k :], p)
        return np.log(part("toxic", gram, p)) - np.log(part("ordinary", gram, p))

    want = Counter()
    for d, text, *_ in docs:
        words = toxicity.words_of(text)
        values = [sum(map(ratio, grams_of(w))) for w in words]
        k = min(8, len(words))
        passages = [sum(values[i : i + k]) / sum(len(w) + 1 for w in words[i : i + k]) for i in range(len(words) - k + 1)] if words else [0.0]
        want[(d, round(max(passages), 9))] += 1
    rows, marked = frame(spark, docs), spark.createDataFrame(labels, LABELS)
    scores = []
    for more in ({}, {"most": 500}, {"most": 0}):
        got = toxicity.judged(rows, marked, **more).collect()
        assert Counter((r.doc_id, round(r.passage, 9)) for r in got) == want
        scores.append(sorted((r.doc_id or -1, r.score, r.predicted) for r in got))
    assert scores[0] == scores[1] == scores[2]


# ---- filter audit ---------------------------------------------------------------------


def plain_audit(docs, labels):
    lo, good, toxic = {}, Counter(), Counter()
    for d, text, *_ in docs:
        if d is not None:
            lo[text or ""] = min(d, lo.get(text or "", d))
    for d, q, t in labels:
        good[d] |= q == 1
        toxic[d] |= t == 1
    rows = []
    for d, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text), d is not None and d > lo[text]]
        rows.append((lang or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}, d is not None and good[d], d is not None and toxic[d]))
    out, removed_by = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in mine)
                out[part, order, step] = (len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(map(bool, (r[2] for r in gone))), sum(map(bool, (r[3] for r in gone))))
                removed_by[part, f] += len(gone)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_audit_is_that_of_running_every_order(spark):
    docs = [*corpus(), (None, "UPPER | CASE", "de", "s", 1), (None, "UPPER | CASE", "de", "s", 1), (3, "UPPER | CASE", "", "s", 1), (900, prose(3, 200, 10**6) + " &", "de", "s", 1)]
    labels = [(d, i % 2, i % 3 == 0) for i, (d, *_) in enumerate(docs) if d is not None] + [(8, 1, 1), (8, 0, None), (None, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    got = filter_audit.audited(frame(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(audited(got)) and audited(got) == plain_audit(docs, labels)


def test_audit_of_repeated_rows_and_an_empty_table(spark):
    labels = spark.createDataFrame([], LABELS)
    assert not filter_audit.audited(frame(spark, []), labels).count()
    docs = [(i % 3 or None, "same text", "en", "s", 1) for i in range(30)] + [(4, "same text", None, "s", 1)] * 5
    got = audited(filter_audit.audited(frame(spark, docs), labels).collect())
    assert got == plain_audit(docs, [])
    assert got["", "EABCD", 1][1] == 5 and got["en", "EABCD", 1][1] == 10


def test_no_key_of_the_audit_is_a_group_of_copies(spark):
    docs = frame(spark, [(i if i % 2 else None, "copy", "en", "s", 1) for i in range(400)])
    plan = filter_audit.cells(docs, spark.createDataFrame([(1, 1, 1)], LABELS))
    assert plan.count() == 2 and plan.groupBy().sum("n").first()[0] == 400


# ---- periodic runs --------------------------------------------------------------------


def plain_runs(w):
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repeating(rng):
    n, letters = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 4, 7])
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 3 else 0):
        p, at = rng.randint(1, 9), rng.randrange(n)
        for i in range(at + p, min(n, at + rng.randint(1, 60))):
            w[i] = w[i - p]
    return w


def test_runs_are_those_of_comparing_every_period():
    rng, seen = random.Random(7), 0
    for _ in range(3000):
        w = repeating(rng)
        plain = plain_runs(w)
        assert [(s, e - s, q) for s, e, q in periodic.runs_in(w)] == sorted(plain, key=lambda r: (r[0], r[0] + r[1]))
        assert periodic.runs_of([b"%d" % x for x in w]) == plain
        seen += len(plain)
    assert seen > 2000


def test_factors_are_the_longest_that_stand_earlier():
    rng = random.Random(8)
    for _ in range(300):
        w, at = repeating(rng), 0
        for start, end, source in periodic.factors(w):
            earlier = [max(k for k in range(len(w) - start + 1) if w[i : i + k] == w[start : start + k]) for i in range(start)]
            best = max(earlier, default=0)
            assert start == at and end - start == max(1, best) and (source < 0 if not best else source < start and w[source : source + best] == w[start:end])
            at = end
        assert at == len(w)


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped))


def test_rows_are_those_of_a_plain_scan(spark):
    docs = [r for r in corpus() if r[0] != 500] + [(i, prose(i, 40 + i % 50), "en", "s", 1) for i in range(1000, 1120)]
    docs += [(2, "a b " * 30 + "c", "en", "s", 1), (2, "a b " * 30 + "c", "en", "s", 1), (None, "x " * 9, None, None, 1), (500, prose(1, 60) * 7, "en", "s", 1)]
    got = periodic.scanned(frame(spark, docs), periodic.planted, texts=False)
    assert Counter(map(tuple, got.collect())) == Counter(plain_row(d, t) for d, t, *_ in docs)
    assert sum(r.n_runs > 0 for r in got.collect()) > 8
    assert not periodic.scanned(frame(spark, []), periodic.planted).count()


def test_texts_are_collapsed_to_one_period(spark):
    docs = [(1, "say it once more " * 5 + "and stop", "en", "s", 1), (2, None, "en", "s", 1)]
    got = {r.doc_id: r for r in periodic.scanned(frame(spark, docs)).collect()}
    assert got[1].collapsed == "say it once more and stop" and [tuple(r) for r in got[1].runs] == [(0, 20, 4)]
    assert got[2].collapsed == "" and got[2].runs == [] and got[2].start is None


def test_a_long_periodic_text_is_linear():
    words = [b"%d" % i for i in range(20_000)] * 10
    assert periodic.runs_of(words) == [(0, 200_000, 20_000)]
    assert periodic.runs_of([b"a"] * 300_000) == [(0, 300_000, 1)]
