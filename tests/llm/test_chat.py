import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldspan.llm import chat

TEMPLATE = chat.Template()
TEXT = st.lists(st.one_of(st.sampled_from([*chat.CONTROLS, "\\", "\\-", "-", "[", "<", "INST]", "/s>", "a", "\n"]), st.text(max_size=3)), max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=5))
def test_round_trip(turns):
    text, spans = TEMPLATE.render([{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(text) == turns
    assert [chat.unguard(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text == "".join(TEMPLATE.render([{"role": r, "text": t}])[0] for r, t in turns)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_guarded_text_has_no_controls(text):
    assert chat.unguard(chat.guard(text)) == text and not any(c in chat.guard(text) for c in chat.CONTROLS)


def test_language():
    source = "{# c #}{% set x = 'a' + 'b' %}{{ x | upper }}{% for m in messages %}{% if m.role == 'user' and not m.skip or m['role'] == 'x' %}[{{ m.text | trim }}]{% elif m.role != 'user' %}-{% else %}!{% endif %}{% endfor %}"
    assert chat.Template(source).render([{"role": "user", "text": " t "}, {"role": "y"}, {"role": "user", "skip": True}])[0] == "AB[t]-!"
    assert chat.fold(chat._Expression("'a' + 'b' | upper").whole()) == ("const", "aB")
    assert not chat.Template(source).by_turn() and TEMPLATE.by_turn()


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ x | open }}", "{{ f(1) }}", "{% import os %}", "{% for x %}{% endfor %}", "{% if a %}", "{% endif %}", "{{ 'a' 'b' }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad)


def test_rows(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", "a"), (1, None, "system", None), (2, 1, None, "x"), (2, 1, None, "x"), (None, 1, "assistant", "é😀"), (3, 1, "user", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string")
    found = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert {k: r["n_turns"] for k, r in found.items()} == {1: 3, 2: 2, None: 1, 3: 1}
    assert found[1]["turns_sha256"] == hashlib.sha256(b"system\n\nuser\na\nassistant\nb</s>\n").hexdigest()
    assert (found[1]["loss_chars"], found[1]["loss_sha256"]) == (5, hashlib.sha256(b"b</s>").hexdigest())
    assert found[None]["loss_chars"] == 2 and found[3]["loss_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert chat.digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
