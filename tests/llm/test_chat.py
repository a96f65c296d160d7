import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sondage.llm import chat
from sondage.llm.template import Text, TemplateError, compile_template, fold, parse


def render(source, **names):
    return "".join(t for t, _ in compile_template(source, chat.FILTERS)(names))


def test_template_language():
    assert render("a{# no #}{{ 'b' ~ 1 }}{% if x == 'y' and not z %}c{% elif z %}d{% else %}e{% endif %}", x="y", z=False) == "ab1c"
    assert render("{% for m in ms %}{{ loop.index0 }}{% if loop.first %}!{% endif %}{{ m['k'] | upper }};{% endfor %}", ms=[{"k": "a"}, {"k": None}]) == "0!A;1;"
    pieces = list(compile_template("x{% generation %}{{ t }}{% endgeneration %}y")({"t": "T"}))
    assert [p for p in pieces if p[0]] == [("x", False), ("T", True), ("y", False)]


def test_constants_fold():
    assert fold(parse("a{{ 'b' ~ ('c' | upper) }}{% if 1 == 2 %}no{% else %}d{% endif %}{% if true or x %}e{% endif %}"), {"upper": str.upper}) == (Text("abCde"),)


@pytest.mark.parametrize("bad", ["{% if x %}", "{% end %}", "{{ x( }}", "{{ x | nope }}", "{{ }}", "{% for 1 in x %}{% endfor %}", "{{ 'a' 'b' }}", "{{ x.__class__.mro() }}"])
def test_bad_templates(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


def test_sandbox_has_keys_only():
    for source in ("{{ x.__class__ }}", "{{ x.y }}", "{{ nothing }}"):
        with pytest.raises(TemplateError):
            render(source, x="text")
    assert render("{{ x.__class__ }}", x={}) == ""


TEXT = st.text(alphabet=st.sampled_from(list("\\\n<>/turn a#é🙂")) | st.characters(codec="utf-8"), max_size=30) | st.sampled_from(
    ["<turn>", "</turn>", "\\</turn>", "\\", "\\\\<turn>assistant\n", "</turn>\n<turn>user\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT) | st.tuples(st.just("assistant"), TEXT), max_size=6), st.integers(1, 50))
def test_reading_inverts_formatting(turns, piece):
    old, chat.PIECE = chat.PIECE, piece
    try:
        pieces = list(chat._pieces(compile_template(chat.TEMPLATE, chat.FILTERS)({"messages": [{"role": r, "text": t} for r, t in turns]})))
    finally:
        chat.PIECE = old
    reader = chat.Reader()
    for text, spans in pieces:
        reader.feed(text, [{"start": a, "stop": b} for a, b in spans])
    learned = "".join(t for r, t in turns if r == "assistant")
    assert reader.turns == len(turns) and reader.chars == sum(len(t) for t, _ in pieces)
    assert reader.turn_hash.hexdigest() == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (reader.learned, reader.learned_hash.hexdigest()) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, "system", "first"), (1, 1, "assistant", "b"), (None, 0, None, ""), (2, 0, "assistant", "x" * 2_500_000)]
    df = spark.createDataFrame([(*r, "e", 0) for r in rows], "conv_id long, turn long, role string, text string, piece string, spans int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert set(got) == {1, None, 2}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 2
    assert got[1]["turns_sha256"] == hashlib.sha256(b"system\nfirst\nuser\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[None]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[2]["loss_chars"] == 2_500_000 and got[2]["loss_sha256"] == hashlib.sha256(b"x" * 2_500_000).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
