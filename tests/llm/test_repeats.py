import itertools
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowsieve.llm import near_dedup, substring_dedup

from .helpers import awkward, prose, table, words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=12), min_size=1, max_size=4), st.text("abc", max_size=14))
def test_matching_statistics(references, query):
    automaton = substring_dedup.SuffixAutomaton()
    for r in references:
        automaton.add(list(r))
    want = [max(n for n in range(i + 2) if any(query[i + 1 - n : i + 1] in r for r in references)) for i in range(len(query))]
    assert automaton.matches(list(query)) == want
    assert len(automaton.next) <= 2 * sum(map(len, references)) + 1


def without_repeats(texts, window):
    first = {}
    for i, t in sorted(texts.items()):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in texts.items():
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_passages_against_brute_force(spark):
    rng = random.Random(3)
    texts = dict(enumerate(awkward(rng)))
    passage = prose(rng, 30, 40).split(" ")
    for i in range(40, 90):  # many cuts of one passage, in few words, with repeats inside a document
        a, b = sorted(rng.sample(range(31), 2))
        texts[i] = " ".join([*prose(rng, 5, 6).split(" "), *passage[a:b], *prose(rng, 5, 6).split(" "), *passage[a:b]])
    for window, gram in ((13, 5), (6, 2)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(table(spark, texts), window, gram).collect()}
        assert got == without_repeats(texts, window)


def test_shards_of_a_frequent_word_sequence_are_split(spark):
    rng = random.Random(18)
    hashes = near_dedup.Words(pa.array([prose(rng, 4000, 10**6)]))
    grams = near_dedup.sequence_hash(hashes.hashes(), 5)
    phrase = hashes.text(int(grams.argmin()), int(grams.argmin()) + 5).decode()  # the anchor of nearly every window it is in
    texts = {i: f"{prose(rng, 20)} {phrase} {prose(rng, 20)}" for i in range(300)}
    texts |= {400 + i: f"{texts[7 * i]} {prose(rng, 3)}" for i in range(20)}
    texts[500] = " ".join(f"{prose(rng, 9)} {phrase}" for _ in range(200))  # one document with many stretches of one anchor
    texts[501] = texts[500][300:]
    for heavy in (30, 4096):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(table(spark, texts), heavy=heavy).collect()}
        assert got == without_repeats(texts, 13)
    docs = table(spark, texts).selectExpr("doc_id AS id", "doc_id AS key", "text")
    largest = [max(r.n for r in substring_dedup.dealt(docs, docs, 13, 5, heavy).groupBy("anchor").agg(F.countDistinct("words").alias("n")).collect()) for heavy in (30, 4096)]
    assert largest[0] <= 30 < 200 < largest[1]


def test_repeated_rows_nulls_and_nothing(spark):
    text = prose(random.Random(4), 40)
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(0, 40, 40), (1, 40, 0), (1, 40, 0), (5, 0, 0)]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_passages_of_rows_without_id_and_of_one_id_twice(spark):
    rng = random.Random(31)
    a, b, c = (prose(rng, 30, 10**5) for _ in range(3))
    near = " ".join([*prose(rng, 4).split(" "), *a.split(" ")[:20], *prose(rng, 4).split(" ")])
    rows = [(1, a), (2, f"{b} x {a}"), (2, f"y {a} {c}"), (None, f"{c} z {b}"), (None, f"{a} w {c}"), (None, a), (None, f"{a} w {c}"), (7, f"q {a} {b}"), (None, near), (8, near), (None, prose(rng, 30, 10**5))]
    order = lambda i: 10**9 if i is None else i
    want = []
    for i, t in rows:
        w, gone = words(t), set()
        earlier = {tuple(v[k : k + 13]) for j, u in rows if order(j) < order(i) for v in [words(u)] for k in range(len(v) - 12)}
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in earlier:
                gone.update(range(k, k + 13))
        want.append((order(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for heavy in (1, 4096):
        assert sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, heavy=heavy).collect()) == sorted(want)


def shingles(text, size):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    texts = dict(enumerate(awkward(rng)))
    base = prose(rng, 150).split(" ")
    for i in range(100, 160):  # copies with 0 to 12 changed words: some linked to their origin, some through others, some alone
        copy = list(base)
        for k in rng.sample(range(150), rng.randrange(13)):
            copy[k] = f"n{rng.randrange(10**6)}"
        texts[i] = " ".join(copy)
    for i in range(160, 175):  # a chain: neighbours are similar, the ends are not
        texts[i] = " ".join(base[: 150 - (i - 160)] + [f"c{k}" for k in range(i - 160)])
    for size, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, texts), size, percent).collect()}
        assert got == components(texts, size, percent)


def test_near_duplicates_of_several_rows_without_id(spark):
    rng = random.Random(32)
    a, b = (prose(rng, 40, 10**5) for _ in range(2))
    rows = [(6, f"{a} t"), (None, a), (None, f"{b} t"), (None, b), (None, b), (9, prose(rng, 30, 10**5)), (None, prose(rng, 30, 10**5))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 0), (0, 0), (0, 6), (6, 6), (9, 9)]
    assert sum(r.kept for r in got) in (4, 5) and len({r.node for r in got}) == 6  # 6, 9, the lone row, and one text of the three rows of b


def test_near_duplicates_of_repeated_rows_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(3, "A b c d"), (3, "A b c d"), (None, "a B c d"), (9, None), (9, None), (4, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(0, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (4, 1, 4, True), (9, 0, 9, True), (9, 0, 9, True)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(6)
    for n in (1, 2, 10, 500):
        assert near_dedup.sketch(rng.integers(1, 1 << 63, n, dtype=np.uint64), 96).max() < 1 << 63
    close = []
    for _ in range(60):
        pool = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
        a, b = near_dedup.sketch(pool[:350], 96), near_dedup.sketch(pool[50:], 96)
        close.append((a == b).mean())
    assert abs(np.mean(close) - 300 / 400) < 0.02 and np.std(close) < 0.07
