import random
import re
from collections import Counter

import numpy as np
import pytest

from flowsieve.llm import collocations as C

from .helpers import LOWER, awkward, prose


def plain(rows, longest, least, top, percent):
    counts, n = {}, Counter()
    for lang, text in rows:
        f = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        f = {p: c for p, c in f.items() if c >= least}
        found = []
        for p, a in f.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * f[q] >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in f):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    texts = awkward(rng)
    texts += [f"{rng.choice(['alpha beta', 'Gamma delta, epsilon', 'in the house of'])} {prose(rng, 6, 12)}{rng.choice('.;!? ')}\n{prose(rng, 3, 5)}" for _ in range(150)]
    texts += ["of the", "x\x0bof the\x0cof the", "É été, É été", "a\x00b a\x00b", "..,,", "a" * 70000 + " b"]
    return [(rng.choice(["en", "de", None, "und"]), t) for t in texts]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 2000, "bucket_bytes": 3000}])
def test_phrases_equal_brute_force(spark, sizes):
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, lang, 1, "p", 0.5) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, phrase string, score double").repartition(3)
    for longest, least, top, percent in ((4, 8, 2000, 80), (3, 3, 7, 50)):
        got = sorted(tuple(r) for r in C.collocations(docs, longest, least, top, percent, **sizes).collect())
        assert got == plain(rows, longest, least, top, percent) and len(got) > 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(docs).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None, None), (1, "", "en"), (2, " \t", "en")], docs.schema)).count() == 0


def test_index_extends_to_both_sides():
    rng = random.Random(1)
    text = " ".join(rng.choice("abcd") for _ in range(300)) + ". " + " ".join(rng.choice("abc") for _ in range(200))
    sequence, words = C.numbered([text.encode(), b"a b, c"])
    name = [b"", *words.to_pylist()]
    pieces = [p.split() for p in re.split("[.,]", text)] + [["a", "b"], ["c"]]
    count = lambda k: Counter(tuple(p[i : i + k]) for p in pieces for i in range(len(p) - k + 1))
    index = C.Index.of(sequence)
    p = index.words()
    for k in range(1, 5):
        assert {tuple(name[x].decode() for x in w): n for w, n in zip(p.words, p.size)} == count(k)
        if k < 4:
            a, b = index.extend(p, "left"), index.extend(p, "right")
            order = np.argsort(a.left), np.argsort(b.left)
            for field in ("words", "size", "left", "right"):
                assert np.array_equal(getattr(a, field)[order[0]], getattr(b, field)[order[1]])
            p = index.longer(p)


def test_planes():
    x = np.array([0, 1, 255, 256, 70000, 2**31 - 1], np.int32)
    assert np.array_equal(C._from_planes(C._planes(x)), x)
