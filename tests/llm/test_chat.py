import hashlib

import pytest

from riskweave.llm import chat as C

PLAIN = "conv_id long, turn long, role string, text string"


def expected(turns):
    turns = [(r or "", t or "") for r, t in turns]
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_control_strings_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s><|turn|>x<|says|>y<|end|>", None, "", "a\nb 😀 <|en", "<s><s>"]
    rows = [(1, i, "assistant" if i % 2 else "user<|says|>", t) for i, t in enumerate(said)]
    got = C.digests(C.read_back(C.formatted(spark.createDataFrame(rows, PLAIN)))).collect()
    assert [tuple(r)[1:5] for r in got] == [expected([(r, t) for _, _, r, t in rows])]


@pytest.mark.parametrize("text", ["<|end|>", "<\\|end|>", "[/INST", "[\\\\/INST]", "<<SYS>>", "\\"])
def test_escape_is_reversible_and_harmless(text):
    marked = C.escape(text)
    assert C.unescape(marked) == text
    assert not any(c in marked for c in C.CONTROL)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None, 1), (2, 1, "user", "b", 1), (2, 1, "user", "a", 1), (2, 1, "user", "a", 1), (2, None, "system", "z", 1)]
    df = spark.createDataFrame(rows, PLAIN + ", spans int")
    got = {r.conv_id: tuple(r)[1:5] for r in C.digests(C.read_back(C.formatted(df))).collect()}
    assert got[None] == expected([("", "")])
    assert got[2] == expected([("system", "z"), ("user", "a"), ("user", "a"), ("user", "b")])


def test_empty_table(spark):
    assert C.digests(C.read_back(C.formatted(spark.createDataFrame([], PLAIN)))).collect() == []


def test_template_language():
    render = C.compiled("{% for m in messages %}{% if loop.first %}[{% elif m.role == 'a' and not loop.last %}A{% else %}-{% endif %}"
                        "{{ m.text | trim | upper }}{% generation %}{{ 'x' + 1 }}{% endgeneration %}{% endfor %}")
    assert render({"messages": [{"role": "a", "text": " p "}, {"role": "a", "text": "q"}, {"role": "b"}]}) == (
        "[Px1AQx1-x1", [(2, 4), (6, 8), (9, 11)])
    assert len(C.folded(C.parse("a{{ 'b' }}{% if 'x' == 'x' %}c{% endif %}d"))) == 1


@pytest.mark.parametrize("bad", ["{{ a | run }}", "{{ f() }}", "{% include 'x' %}", "{% if a %}", "{{ a. }}", "{{ 'a' 'b' }}", "{% for x %}{% endfor %}"])
def test_bad_templates_are_refused(bad):
    with pytest.raises(C.TemplateError):
        C.compiled(bad)


def test_no_python_attributes():
    assert C.compiled("{{ m.__class__ }}{{ n.x }}")({"m": "text", "n": {"x": 3}}) == ("3", [])
