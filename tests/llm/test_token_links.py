import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowsieve.llm import bpe, queries
from flowsieve.llm import token_links as L

from .helpers import awkward, table

A = Tokenizer.from_file(bpe.default_tokenizer())
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=L.default_pieces())
CHARS = bpe.byte_of_char()
NONE = ([], [])


def plain_tokens(text):
    """(id, bytes) of both sides, or nothing."""
    if not text:
        return NONE
    a = [(i, bytes(CHARS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda p: bytes([int(p[1:-1], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    b = [(i, piece(B.id_to_piece(i))) for i in B.encode(text)]
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else NONE


def plain_groups(text):
    a, b = plain_tokens(text)
    found, x, y, i, j = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x == y and found[-1] != ([], []):
            found.append(([], []))
        if x <= y:
            found[-1][0].append(a[i][0])
            x, i = x + len(a[i][1]), i + 1
        else:
            found[-1][1].append(b[j][0])
            y, j = y + len(b[j][1]), j + 1
    return found if found != [([], [])] else []


def plain(texts):
    grouped = [plain_groups(t) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in grouped]
    count = Counter(p for doc in links for p in doc)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for g, doc in zip(grouped, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(doc.values()), sum(n for p, n in doc.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in doc.items()), said))
    return out


@pytest.mark.parametrize("rows,links", [(4096, 3 << 20), (5, 400), (64, 50)])
def test_rows_equal_brute_force(spark, rows, links):
    texts = awkward(random.Random(8))
    texts += ["a▁b", "<s> <unk> <0x41>", "ﬁ ² \r\n", "日本語テキスト" * 40, "  lead", "trail  ", "the the the", "the the the"] + [f"the cat {i % 7} sat" for i in range(300)]
    docs = table(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id in (4, 5)").selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    all_ids = [*range(len(texts)), 3, None, None]
    want = sorted(((-1 if i is None else i), *r) for i, r in zip(all_ids, plain([*texts, texts[3], texts[4], texts[5]])))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, bytes(r.described).decode()) for r in L.link(docs, block_rows=rows, block_links=links).collect())
    assert got == want


def test_empty_table_and_texts(spark):
    docs = table(spark, ["", None])
    assert sorted(tuple(r)[1:] for r in L.link(docs).collect()) == [(0, 0, 0, 0, 0, 0, b"")] * 2
    assert L.link(docs.limit(0)).count() == 0


def test_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, *r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[6] else "") for (i, _), r in zip(texts, plain([t for _, t in texts])))
    got = queries.op12_token_links(spark, sf)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 99)), max_size=300, unique=True), st.sampled_from([100, 1000, 4000]))
def test_bitmaps(found, rows):
    found = sorted(found)
    of, row = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
    bitmap = L.compress(of, row, 7, rows)
    assert L.popcounts(bitmap, rows).tolist() == [sum(f[0] == k for f in found) for k in range(7)]
    assert sorted(zip(*(x.tolist() for x in L.entries(bitmap, rows)))) == found


def test_wide_groups():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 30, 500), rng.integers(0, 30, 400)
    group_a, group_b = np.sort(rng.integers(0, 3, 500)), np.sort(rng.integers(0, 3, 400))
    whole = Counter((int(x), int(y)) for x, g in zip(a, group_a) for y, h in zip(b, group_b) if g == h)
    for wide in (10, 10**9):
        pairs, times = L.pairs_of(a, b, group_a, group_b, wide)
        found = Counter()
        for p, n in zip(pairs.tolist(), times.tolist()):
            found[p >> 22, p & ((1 << 22) - 1)] += n
        assert found == whole
