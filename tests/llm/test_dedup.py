"""Decontamination, SimHash, substring and suffix deduplication against brute force."""

import hashlib
import pickle
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import DOCS, corpus, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeward.llm import components, decontaminate, repeats, rolling, simhash, substrings, suffix_dedup, suffixes
from lakeward.llm.words import plain_words


def raw(text):
    return (text or "").encode()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# ---- decontamination ------------------------------------------------------------------


def plain_contamination(docs, items, width=13):
    grams = {}
    for item, text in items:
        words = plain_words(raw(text))
        for i in range(max(1, len(words) - width + 1) if words else 0):
            grams.setdefault(tuple(words[i : i + min(width, len(words))]), set()).add(str(item) if item is not None else "")
    out = Counter()
    for doc_id, text, *_ in docs:
        words = plain_words(raw(text))
        hit, found = set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(words) - size + 1):
                owners = grams.get(tuple(words[i : i + size]))
                if owners:
                    hit |= set(range(i, i + size))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[(doc_id, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words))] += 1
    return out


ITEMS = [(1, prose(999, 30)), (2, "One"), (3, None), (4, "..."), (12, prose(101, 20)), (13, prose(999, 30)), (None, "déjà vu"), (7, "")]


@pytest.mark.parametrize("bound", [100_000, 0])
def test_contamination_is_that_of_brute_force(spark, bound):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS w")
    got = decontaminate.contamination(frame(spark), items, max_index_bytes=bound)
    assert rows_of(got) == plain_contamination(corpus(), ITEMS)


def test_the_index_is_smaller_than_its_bound():
    items = [(str(i), raw(prose(i, 40, 5000))) for i in range(2000)] + [("same", raw(prose(1, 40, 5000)))] * 3
    index = decontaminate.NgramIndex(items, 13)
    assert index.nbytes() <= sum(len(t) + 40 * len(t.split()) + len(i) + 64 for i, t in items)
    assert len(pickle.dumps(index)) < 1.1 * index.nbytes()
    hit, found = index.scan(raw(prose(1, 40, 5000)))
    assert hit.all() and found == {"1", "same"}


def test_windows_over_the_edge_of_a_piece(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    items = [("a", raw(prose(5, 13))), ("b", b"two words"), ("c", raw(prose(6, 14)))]
    text = f"{prose(7, 3)} {prose(5, 13)} two words {prose(6, 14)} {prose(8, 3)} two"
    hit, found = decontaminate.NgramIndex(items, 13).scan(raw(text))
    assert found == {"a", "b", "c"} and np.flatnonzero(hit).tolist() == list(range(3, 32))


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.contamination(frame(spark), none).where("contaminated or n_hit > 0").count()
    assert not decontaminate.contamination(frame(spark, []), none).count()


@pytest.mark.parametrize("bound", [100_000, 0])
def test_cleaning_drops_documents_or_spans(spark, bound):
    items = spark.createDataFrame([(1, "Alpha beta, gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "See: ALPHA  beta gamma! And more", "en", "s", 1), (2, "alpha gamma", "en", "s", 1)], DOCS)
    assert [r.doc_id for r in decontaminate.clean(docs, items, max_index_bytes=bound).collect()] == [2]
    spans = {r.doc_id: r.text for r in decontaminate.clean(docs, items, mode="span", max_index_bytes=bound).collect()}
    assert spans == {1: "See: ! And more", 2: "alpha gamma"}


# ---- SimHash --------------------------------------------------------------------------


def plain_fingerprint(text):
    words = raw(text).lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_of_brute_force(spark):
    got = simhash.near_duplicates(frame(spark), radius=2).collect()
    docs = corpus()
    fps = [plain_fingerprint(t) for _, t, *_ in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    least = {}
    for (doc_id, *_), r in zip(docs, root):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d[0], f"{f:016x}", least.get(r)) for d, f, r in zip(docs, fps, root))


def test_links_join_all_near_fingerprints(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(-(1 << 62), 1 << 62, 20)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(30):  # a chain of small steps away from each seed
            s = int(s) ^ (1 << int(rng.integers(0, 63)))
            fps.add(s)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    for large in (1024, 3):
        root = {r.u: r.v for r in components.roots(simhash.links(nodes, 2, large)).collect()}
        names = {f: root.get(f, f) for f in fps}
        expected = plain_components(sorted(fps), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
        assert len(set(names.values())) == len(set(expected.values()))
        assert all(len({names[f] for f in group}) == 1 for group in groups_of(expected))


def plain_components(nodes, near):
    root = {n: n for n in nodes}
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = root[a], root[b]
                root = {k: x if v == y else v for k, v in root.items()}
    return root


def groups_of(root):
    out = {}
    for n, r in root.items():
        out.setdefault(r, []).append(n)
    return out.values()


@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=80), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_bit_sliced_distances(fps, radius):
    a = np.array(fps, np.uint64)
    b = np.array([f ^ (1 << (i % 64)) ^ (1 << (i * 7 % 64)) if i % 2 else fps[0] for i, f in enumerate(fps)], np.uint64)
    planes = simhash.bit_planes(np.concatenate([a, b]))
    n = np.arange(len(a))
    got = simhash.close_lanes(planes, n, n + len(a), radius)
    assert got.tolist() == [int(x ^ y).bit_count() <= radius for x, y in zip(a.tolist(), b.tolist())]


def test_one_document_of_each_group_stays(spark):
    text = prose(3, 200)
    rows = [(4, text, "en", "s", 1), (2, text, "en", "s", 1), (2, text, "en", "s", 1), (9, prose(4, 200), "en", "s", 1), (None, text, "en", "s", 1), (None, prose(5, 90), "en", "s", 1), (None, prose(5, 90), "fr", "s", 1)]
    kept = simhash.deduplicated(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text[:9]) for r in kept) == sorted([(2, text[:9]), (9, prose(4, 200)[:9]), (0, prose(5, 90)[:9])])
    assert kept[0].score == "own"
    assert not simhash.deduplicated(frame(spark, [])).count()
    assert not simhash.near_duplicates(frame(spark, [])).count()


def test_groups_of_a_repeated_id_are_judged_apart(spark):
    a, b, c = prose(6, 200), prose(7, 200), prose(8, 200)
    rows = [(2, a, "en", "s", 1), (2, b, "en", "s", 1), (2, b, "en", "s", 1), (5, a, "en", "s", 1), (6, b, "en", "s", 1), (1, c, "en", "s", 1), (3, c, "en", "s", 1), (3, prose(9, 200), "en", "s", 1)]
    for given in (rows, [(d, {a: b, b: a}.get(t, t), *rest) for d, t, *rest in rows]):
        kept = simhash.deduplicated(frame(spark, given)).collect()
        assert Counter((r.doc_id, r.text) for r in kept) == Counter([(2, a), (2, b), (1, c), (3, prose(9, 200))])


# ---- repeats --------------------------------------------------------------------------


def plain_substrings(docs, window=50):
    first = {}
    parts = [raw(t).split() for _, t, *_ in docs]
    for (doc_id, *_), words in zip(docs, parts):
        for i in range(len(words) - window + 1):
            if doc_id is not None:
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = Counter()
    for (doc_id, *_), words in zip(docs, parts):
        gone = set()
        for i in range(len(words) - window + 1):
            at = first.get(tuple(words[i : i + window]))
            if at is not None and (doc_id is None or at < doc_id):
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[(doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_substrings_of_brute_force(spark):
    got = substrings.deduplicated(frame(spark)).drop("n_spans")
    assert rows_of(got) == plain_substrings(corpus())
    small = substrings.deduplicated(frame(spark), window=8, block=3).drop("n_spans")
    assert rows_of(small) == plain_substrings(corpus(), 8)
    assert not substrings.deduplicated(frame(spark, [])).count()


def repeated_sections(n):
    """An earlier passage of n words, in a section that a later document has twice, and
    in one that rows of equal and of no doc_id share."""
    passage = prose(900, n)
    twice, equal, none = (f"{prose(s, 80)} {passage} {prose(s + 1, 80)}" for s in (910, 920, 930))
    texts = [(3, f"{prose(901, 60)} {passage} {prose(902, 60)}"), (5, f"{twice} {prose(903, 70)} {twice}")]
    texts += [(7, f"{prose(s, 40)} {equal}") for s in (904, 905)] + [(None, f"{prose(s, 40)} {none}") for s in (906, 907)]
    return [(d, t, "en", "s", 1) for d, t in texts]


@pytest.mark.parametrize("n", [50, 52, 55, 80])
def test_every_place_of_an_earlier_passage_goes(spark, n):
    rows = repeated_sections(n)
    got = substrings.deduplicated(frame(spark, rows))
    assert rows_of(got.drop("n_spans")) == plain_substrings(rows)
    assert {r.n_removed for r in got.where("doc_id = 5").collect()} == {2 * n}


def plain_suffixes(docs, width):
    seen = Counter()
    texts = [raw(t) for _, t, *_ in docs]
    for t in texts:
        seen.update(t[i : i + width] for i in range(len(t) - width + 1))
    out = Counter()
    for (doc_id, *_), t in zip(docs, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[(doc_id, len(t), int(gone.sum()), len(rolling.runs(gone)[0]), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("large", [512, 3, 1])
def test_suffixes_of_brute_force(spark, large):
    rows = corpus()[:-1] + [(501, prose(1, 60) * 3, "en", "s0", 0)]
    got = suffix_dedup.deduplicated(frame(spark, rows), width=60, block=16, shard_bytes=3000, large_key=large)
    assert rows_of(got) == plain_suffixes(rows, 60)


def test_suffixes_of_the_contract_width(spark):
    rows = corpus()[:-1]
    got = suffix_dedup.deduplicated(frame(spark, rows), with_text=True)
    assert rows_of(got.drop("kept")) == plain_suffixes(rows, 400)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())
    assert not suffix_dedup.deduplicated(frame(spark, [])).count()


@pytest.mark.parametrize(("n", "passage"), [(50_000, 395), (3_000, 300), (3_000, 500)])
def test_a_passage_in_very_many_documents(spark, n, passage):
    rng = np.random.default_rng(n + passage)
    shared = bytes(rng.integers(97, 123, passage, np.uint8)).decode()
    rows = []
    for i in range(n):  # few letters beside the passage, so some windows recur and some do not
        left, right = ("".join(map(chr, rng.integers(65, 73, 6))) for _ in range(2))
        rows.append((i, left + shared + right, "en", "s", 1))
    rows += [(None, "xy" + shared * 3, "en", "s", 1)] * 2
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, DOCS))
    assert rows_of(got) == plain_suffixes(rows, 400)


def test_long_documents_go_in_pieces(spark):
    rows = corpus()[:-1] + [(501, prose(1, 60) * 3, "en", "s0", 0)]
    for large in (512, 1):
        rule = repeats.Rule(60, 16, earlier=False, words=False, large_key=large, piece=150)
        got = repeats.removal(frame(spark, rows), rule, lambda parts: suffix_dedup.repeated(parts, rule))
        assert Counter((r.doc_id, r.n, r.removed, r.spans, r.sha) for r in got.collect()) == plain_suffixes(rows, 60)
    rule = repeats.Rule(8, 3, earlier=True, words=True, piece=40)
    got = repeats.removal(frame(spark, rows), rule, lambda parts: repeats.compared(parts, rule))
    assert Counter((r.doc_id, r.n, r.removed, r.sha) for r in got.collect()) == plain_substrings(rows, 8)


@given(st.binary(min_size=1, max_size=400), st.sampled_from([24, 25, 40, 61]), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_difference_cover_finds_repeats(text, depth, letters):
    text = bytes(97 + b % letters for b in text)
    x = np.frombuffer(text, np.uint8)
    wanted = np.arange(0, len(text) - depth + 1)[::2] if len(text) > depth else np.empty(0, np.int64)
    seen = Counter(text[i : i + depth] for i in wanted)
    assert suffixes.repeated(x, wanted, depth).tolist() == [seen[text[i : i + depth]] > 1 for i in wanted]


@given(st.lists(st.binary(min_size=0, max_size=120), min_size=1, max_size=4), st.integers(2, 20))
@settings(max_examples=80, deadline=None)
def test_every_window_has_one_cell(texts, width):
    xs = [np.frombuffer(bytes(b % 3 for b in t), np.uint8).astype(np.uint64) for t in texts]
    for block in {1, width // 2 or 1}:
        doc, key, content, starts, ends, at = repeats.cells(xs, repeats.Rule(width, block, False, False))
        windows = sorted((d, s) for d, a, b in zip(doc, starts, ends) for s in range(a, b - width + 1))
        assert windows == [(d, s) for d, x in enumerate(xs) for s in range(max(0, len(x) - width + 1))]
        # Equal windows are under equal keys, in whatever document.
        by_window = {}
        for d, k, a, b in zip(doc, key.tolist(), starts, ends):
            for s in range(a, b - width + 1):
                by_window.setdefault(xs[d][s : s + width].tobytes(), set()).add(k)
        assert all(len(keys) == 1 for keys in by_window.values())


@given(st.binary(min_size=30, max_size=400), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_pieces_of_a_long_document_have_the_same_windows(text, piece):
    x = np.frombuffer(bytes(b % 3 for b in text), np.uint8)
    rule = repeats.Rule(20, 6, False, False, piece=piece)
    keys = []
    for cells in (repeats.cells([x], rule), repeats.long_cells(x, rule)):
        _, key, _, starts, ends, _ = cells
        keys.append({s: k for k, a, b in zip(key.tolist(), starts, ends) for s in range(a, b - rule.width + 1)})
        assert sum(int(b - a) - rule.width + 1 for a, b in zip(starts, ends)) == len(x) - rule.width + 1
    assert keys[0] == keys[1]


@given(st.text(alphabet=" \t\n\x0babc\u00e9\u3000", max_size=60))
def test_word_hashes_are_those_of_split(text):
    data = text.encode()
    words = data.split()
    hashes = rolling.word_hashes(data).tolist()
    assert len(hashes) == len(words)
    assert hashes == rolling.word_hashes(data, 7).tolist()
    assert len({*zip(words, hashes)}) == len(set(words)) == len(set(hashes))
