import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowsieve.llm import chat_format as C
from flowsieve.llm import chat_template as T
from flowsieve.llm import queries

ODD = st.text(alphabet=st.sampled_from("<|\\n\n im_start>endé世"), max_size=60)


def render(source, turns):
    chunks = list(T.compile_template(source).render(turns))
    whole = "".join(c for c, _ in chunks)
    learnt, at = "", 0
    for text, spans in chunks:
        learnt += "".join(text[a:b] for a, b in spans)
        at += len(text)
    return whole, learnt


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), min_size=1, max_size=4))
def test_any_texts_can_be_read_back(turns):
    whole, learnt = render(C.CHAT, [{"role": r, "text": t} for r, t in turns] + [{"role": "assistant", "text": turns[0][1]}])
    assert C.read_turns(whole) == [*turns, ("assistant", turns[0][1])]
    assert T.unescape(learnt) == "".join(t for r, t in turns if r == "assistant") + turns[0][1]
    assert whole.count(C.OPEN) == whole.count(C.CLOSE) == len(turns) + 1


def test_language():
    turns = [{"role": "user", "text": "hi "}, {"role": "assistant", "text": "Yo"}, {"role": "user", "text": "x"}]
    source = """{# note #}{% set sign = '>' ~ 1 + 2 * 3 %}head
{%- for m in messages -%}
  {% if loop.first and not loop.last %}[{{ sign }}{% elif m.role == 'assistant' %}{% generation %}{{ m['text'] | upper }}{% endgeneration %}{% else %}{{ loop.index }}/{{ loop.index0 }}{{ loop.previtem.role }}{{ 'end' if loop.nextitem == none }}{% endif %}
{%- endfor %}]"""
    assert render(source, turns) == ("head[>7YO3/2assistantend]", "YO")
    assert render("{% for m in messages %}{{ m.text | trim | length }}{{ 'a' in m.role }}{{ m.none or 'd' }},{% endfor %}", turns)[0] == "2Falsed,2Trued,1Falsed,"
    assert render("no turns", turns) == ("no turns", "")
    assert render("a{% for m in messages %}{% set x = m.text %}{{ x }}{% endfor %}b", []) == ("ab", "")
    assert render("{{ -7 // 2 }}{{ 7 % 4 }}{{ (1 < 2) and 'y' }}{{ 'b' not in 'abc' }}", [])[0] == "-43yFalse"


@pytest.mark.parametrize("source", ["{{ x", "{% if true %}", "{% for m in others %}{% endfor %}", "{{ ''.__class__ | nothing }}", "{{ f() }}", "{{ 1 + }}", "{% while %}", "{% endfor %}", "{{ open('x') }}", "{{ 'a' 'b' }}", "{{ $ }}",
                                    "{% if true %}{% for m in messages %}{% endfor %}{% endif %}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}"])
def test_refused_when_compiled(source):
    with pytest.raises(T.TemplateError):
        T.compile_template(source)


@pytest.mark.parametrize("source", ["{{ 'a'.__class__ }}", "{{ unknown }}", "{{ 1 // 0 }}", "{{ 'a' * 9 }}", "{{ 'a' < 1 }}", "{% for m in messages %}{{ m }}{% endfor %}", "{% for m in messages %}{{ m.role.upper }}{% endfor %}"])
def test_refused_when_rendered(source):
    with pytest.raises(T.TemplateError):
        render(source, [{"role": "user", "text": ""}])


def test_constants_are_folded():
    tree = T.fold(T.parse("a{{ 'b' ~ 1 + 1 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{# #}{% for m in messages %}{{ '<' ~ m.role ~ '>' ~ '\\n' }}{{ 'x' | upper }}y{% endfor %}"))
    assert tree[0] == T.Text("ab2c")
    loop = tree[1]
    assert loop.body[0].value.parts[1] == T.Const(">\n") and loop.body[1] == T.Text("Xy")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, part int").repartition(3)


def plain(rows):
    found = {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r[:2]) + tuple((x is not None, (x or "").encode()) for x in r[2:])):
        found.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), hexed("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), hexed("".join(x for r, x in t if r == "assistant"))) for c, t in found.items()}


def test_conversations(spark):
    rng = random.Random(5)
    texts = ["", None, "a", "<|im_end|>\n", "<\\|im_start|>", "<", "|x", "\\", "é世😀", "y" * 50000, "<|" * 300]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", "a\nb\\n", None, ""]), rng.choice(texts)) for _ in range(120)]
    rows += [rows[0], rows[0]] + [(7, k, "assistant" if k % 2 else "user", f"turn {k} <|im_end|>") for k in range(3000)]
    for part in (40, 1 << 20):
        made = C.format_chats(table(spark, rows), part_chars=part)
        got = {r.conv_id: r for r in C.read_back(made).collect()}
        assert {c: tuple(r)[1:5] for c, r in got.items()} == plain(rows)
        chars = {r.conv_id: r.n for r in made.selectExpr("conv_id", "length(formatted) AS n").groupBy("conv_id").sum("n").withColumnRenamed("sum(n)", "n").collect()}
        assert chars == {c: r.formatted_chars for c, r in got.items()}
        parts = made.collect()
        assert len(parts) > 1000 if part == 40 else len(parts) == 5
        assert all(p.formatted.count(C.OPEN) == p.formatted.count(C.CLOSE) for p in parts)
    assert C.read_back(C.format_chats(table(spark, rows).limit(0))).count() == 0


def test_query_holds_the_probe(spark, sf):
    rows = {r.conv_id: r for r in queries.op13_chat_format(spark, sf).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(said) and rows[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert len(rows) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1
