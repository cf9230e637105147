import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowsieve.llm import bpe, token_counts

from .helpers import awkward, table

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
ids_of = lambda t: LIBRARY.encode(t, add_special_tokens=False).ids


def test_fast_encoder_equals_library_over_all_pairs_of_its_characters():
    c = bpe.codec(PATH)
    for a in range(256):
        text = "".join(f"a{chr(a)}{chr(b)}b" for b in range(256))
        assert c.encode(text).tolist() == ids_of(text)
        assert token_counts.pre_tokens(text, c) == [text[x:y] for _, (x, y) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab z'sé 世\n\t0#<|>endoftx"), max_size=120), st.integers(1, 9))
def test_joined_halves_are_the_encoding_of_the_whole(text, leaf):
    c = bpe.codec(PATH)
    assert bpe.join_tree([c.encode(p) for p in bpe.leaves(text, leaf)], c).tolist() == ids_of(text)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3001, "ab" * 2000 + "#" * 500, "<|endoftext|>" * 200, "é" * 999, "世界" * 700, "thtionhe" * 800])
def test_long_unsplit_text(text):
    c = bpe.codec(PATH)
    for leaf in (7, 64, 1000):
        assert bpe.join_tree([c.encode(p) for p in bpe.leaves(text, leaf)], c).tolist() == ids_of(text)


def test_documents(spark):
    texts = awkward(random.Random(1))
    docs = table(spark, texts)
    docs = docs.unionByName(docs.where("doc_id in (3, 25)")).unionByName(docs.where("doc_id = 4").selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    rows = bpe.decode(bpe.encode(docs, leaf=512, long=2000)).collect()
    assert len(rows) == docs.count() and sum(r.doc_id == 25 for r in rows) == 2
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids_of(r.text or "") and r.decoded == LIBRARY.decode(ids_of(r.text or ""), skip_special_tokens=False) and r._row == "z"
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0


def test_counts_equal_the_lengths_of_encodings(spark, monkeypatch):
    texts = awkward(random.Random(2))
    docs = table(spark, texts).unionByName(table(spark, {7: texts[7]}))
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs).collect())
    want = sorted((i, len((t or "").encode()), len(ids_of(t or ""))) for i, t in [*enumerate(texts), (7, texts[7])])
    assert got == want
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_frequencies_beyond_a_byte_and_chunks():
    c = bpe.codec(PATH)
    text = ("zqxj zqxj! " * 700).strip()
    pieces, of, doc, times, _ = token_counts._block([text, "x"], c, None)
    assert sum(int(t) * token_counts.piece_length(pieces[p], c) for p, t, d in zip(of, times, doc) if d == 0) == len(ids_of(text))
    assert list(itertools.chain.from_iterable(token_counts.pre_tokens(p, c) for p in token_counts.chunks(text, 100))) == token_counts.pre_tokens(text, c)
