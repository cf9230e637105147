"""Each stage of the pipeline against a brute-force version on its own input, and the whole."""

import random
import re

import pytest

import __spark_entry__
import corpus_pipeline as P
from flowsieve.llm import bpe, toxicity
from flowsieve.llm.queries import QUERIES, toxicity_model

from .helpers import prose
from .test_repeats import components
from .test_text_models import INSULTS, toxic_tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(21)
    texts, labels = toxic_tables(spark, 300)
    items = {i: prose(rng, 25, 10**5) for i in range(4)}
    copies = {400: texts[1], 401: texts[1] + " more", 402: f"{prose(rng, 10)} {items[2].upper()} {prose(rng, 10)}", 403: f'{prose(rng, 20)} token = "0123456789abcdef0123456789abcdef01234567" {prose(rng, 20)}',
              404: None, 405: "", 406: prose(rng, 12000, 3000), 407: f"a {INSULTS[0]} and a {INSULTS[1]}."}
    copies |= {500 + i: f'{prose(rng, 20)} token = "{rng.randrange(16**40):040x}" {prose(rng, 20)}' for i in range(40)}
    rows = [(i, t, "en", "s", len(t or ""), "z") for i, t in (texts | copies).items()]
    rows += [rows[1], (None, "no id", "en", "s", 5, "z"), (None, texts[2] + " behind", "en", "s", 5, "z"), (None, 'w token = "' + "0123456789abcdef0123456789abcdef01234567" + '" v', "en", "s", 5, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def ids(df):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "bpe"]

    clean = stages["toxicity"](spark, docs, folder)
    scan = toxicity.Scanner(toxicity_model(spark, folder).lexicon)
    assert set(INSULTS) <= set(scan.lexicon) and clean.columns == docs.columns
    assert ids(clean) == ids(docs.where("text is null or not text rlike '%s'" % "|".join(INSULTS)))

    single = stages["near_dedup"](spark, docs, folder)
    group = components({i: t for i, t in texts.items() if i is not None}, P.SHINGLE_WORDS, P.SIMILAR_PERCENT)
    assert single.columns == docs.columns and ids(single) == sorted([(True, i) for i, (_, c) in group.items() if i == c] + [(False, 0)] * 2)  # the copy without doc_id goes
    assert (True, 400) not in ids(single)

    without = stages["decontamination"](spark, docs, folder)
    assert without.columns == docs.columns and set(ids(docs)) - set(ids(without)) == {(True, 402)} and without.count() == docs.count() - 1

    masked = stages["secret_scan"](spark, docs, folder)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert {(r.doc_id, r.text) for r in masked.collect()} == {(r.doc_id, r.text and re.sub(r'(token = )"[0-9a-f]{40}"', r'\1"[SECRET]"', r.text)) for r in docs.collect()}

    coded = stages["bpe"](spark, docs, folder)
    c = bpe.codec(bpe.default_tokenizer())
    assert coded.count() == docs.count()
    for r in coded.collect():
        assert bpe.np.frombuffer(r.ids, "<u4").tolist() == c.library.encode(r.text or "", add_special_tokens=False).ids
        assert c.decode(bpe.np.frombuffer(r.ids, "<u4")) == (r.text or "") and r.n_tokens == len(r.ids) // 4


def test_whole_and_empty(spark, folder, tmp_path):
    out = P.run(spark, folder)
    texts = [r.text or "" for r in out.collect()]
    assert not any(w in t for t in texts for w in INSULTS) and sum("[SECRET]" in t for t in texts) == 42
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and len({n.split("_")[0] for n in QUERIES}) == 13
