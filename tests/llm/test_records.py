"""Archives, chats and vector search."""

import hashlib
import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliate.llm import archive as A
from foliate.llm import chat as H
from foliate.llm.topk import Lists, top_k


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    records = [A.page_to_arc(5, "http://a.example/x y", b"<html>\n\xc3\xa9</html>"), A.page_to_arc(None, None, b""), A.ArcRecord("dns:a", "1.2.3.4", "20010203", "text/dns", b"answer\n")]
    data = A.arc_start(version) + b"".join(A.arc_record(r, version, 0) for r in records)
    got = list(A.read_arc(io.BytesIO(data)))
    assert [(r.url, r.block) for r in got] == [("http://a.example/x%20y", records[0].block), ("urn:none", records[1].block), ("dns:a", b"answer\n")]
    made = A.convert(got[2]).decode()
    assert "WARC-Type: resource" in made and "WARC-Date: 2001-02-03T00:00:00Z" in made and "Content-Length: 7" in made
    assert "WARC-Type: response" in A.convert(got[0]).decode() and "WARC-Refers-To" in A.convert(got[0], 9).decode()
    with pytest.raises(ValueError):
        list(A.read_arc(io.BytesIO(data[:-3] if version == 1 else data[:-9])))
    with pytest.raises(ValueError):
        list(A.read_arc(io.BytesIO(data.replace(b"\n%d 0 " % version, b"\n7 0 ", 1))))


def test_row_ids_survive():
    for row in (0, 1, -1, -7, 2**62 + 5, 2**63 - 1, -(2**63)):
        urn = A.record_id(row, "0123456789abcdef")
        assert A.row_of_id(urn) == row and urn.split("-")[2][0] == "8"
    assert len({A.record_id(k, "0123456789abcdef") for k in range(1000)}) == 1000


def test_archives_round_trip(spark):
    same, small = "<p>same</p>" * 200, "tiny"
    rows = [(1, "http://a", same), (9, "http://b", same), (4, None, same), (2, "http://c", small), (3, "http://d", small), (5, "u", None), (6, "u", "é" * 600), (6, "again", "é" * 600), (None, "n", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    made = A.archived(pages).collect()
    assert len(made) == len(rows)
    for r in made:
        html = {x[0]: x[2] for x in rows}[r.page_id] or ""
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
        expected = ("revisit", 9) if r.page_id in (1, 4, None) else ("response", None)
        assert (r.record_type, r.refers_to) == expected
        assert r.payload == (None if r.record_type == "revisit" else html.encode())
    assert A.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_template_language():
    render = lambda source, **v: H.Template(source).render(v.pop("messages", []), **v)[0]
    assert render("{{ 1 + 2 * 3 }}{{ 'a' ~ 4 }}{# no #}") == "7a4"
    assert render("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", xs=["a", "b"]) == "1a,2b"
    assert render("{% if n > 2 and n < 5 %}mid{% elif n in [1] %}{% else %}out{% endif %}".replace("n in [1]", "n == 1"), n=3) == "mid"
    assert render("{% set y = xs[1] %}{{ y | upper }}{{ missing | default('-') }}{{ d.k.z }}", xs=["a", "b"], d={"k": {}}) == "B-"
    assert render("{{ 'x' if a is_b else 'y' }}".replace("a is_b", "a == 'b'"), a="b") == "x"
    assert render("{{ xs | join('+') }}{{ xs | length }}{{ 'q' not in xs }}", xs=["a", "b"]) == "a+b2true"
    for bad in ("{{ f(1) }}", "{{ 1 + }}", "{% if x %}", "{% endfor %}", "{{ x | nope }}", "{% while x %}{% endwhile %}", "{{ __import__('os') }}", "{{ 'a }}"):
        with pytest.raises(H.TemplateError):
            H.Template(bad)
    assert render("{{ x.__class__ }}{{ x['upper'] }}", x="s") == ""


def test_constants_are_folded():
    assert H.Template("a{{ 'b' ~ 1 + 1 }}{% if 1 > 2 %}never{% elif true %}c{% else %}d{% endif %}").tree == [("text", "ab2c")] or H.Template("a{{ 'b' }}c").tree == [("text", "abc")]
    assert H.Template("a{{ 'b' | upper }}{% if false %}x{% endif %}c").tree == [("text", "aBc")]
    assert H.Template("{{ 1 % 0 }}").tree[0][0] == "out"


CHATML = "{% for message in messages %}{{'<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
PAIRED = """
{%- set rest = messages -%}
{%- if messages[0]['role'] == 'system' -%}
    {%- set rest = messages[1:] -%}
{%- endif -%}
{%- for m in rest if m.role is not none -%}
    {%- if (m['role'] == 'user') != (loop.index0 % 2 == 0) -%}
        {{ raise_exception('roles must alternate') }}
    {%- endif -%}
    {%- if m.role == 'user' %}{{ bos_token + '[INST] ' + m['content'].strip() + ' [/INST]' }}
    {%- elif m.role == 'assistant' %} {% generation %}{{ m.content }}{% endgeneration %}{{ eos_token }}
    {%- endif -%}
{%- endfor -%}
"""


def test_published_templates():
    talk = [{"role": "system", "content": "Be brief."}, {"role": "user", "content": " Hi\n"}, {"role": "assistant", "content": "Yes?"}, {"role": "user", "content": "Bye"}]
    assert H.Template(CHATML).render(talk[1:3], add_generation_prompt=True)[0] == "<|im_start|>user\n Hi\n<|im_end|>\n<|im_start|>assistant\nYes?<|im_end|>\n<|im_start|>assistant\n"
    text, spans = H.Template(PAIRED).render(talk, bos_token="<s>", eos_token="</s>")
    assert text == "<s>[INST] Hi [/INST] Yes?</s><s>[INST] Bye [/INST]" and [text[a:b] for a, b in spans] == ["Yes?"]
    with pytest.raises(H.TemplateError, match="alternate"):
        H.Template(PAIRED).render([talk[0], talk[2]], bos_token="", eos_token="")


def test_whitespace_control():
    render = lambda source, **v: H.Template(source).render([], **v)[0]
    assert render("a {{- x -}} b", x="X") == "aXb" and render("a {{ x }} b", x="X") == "a X b"
    assert render("a\n  {%- if x -%}\n b {%- endif %}\nc", x=1) == "abc"
    assert render("<\n  {% if x %}\n  y\n  {% endif %}\n>", x=1) == "<\n  y\n>"
    assert H.Template("<\n  {% if x %}\n  y\n  {% endif %}\n>", False, False).render([], x=1)[0] == "<\n  \n  y\n  \n>"
    assert render("a {% if x %} b {% endif %} c", x=1) == "a  b  c" and render("a\n{# note #}\nb {#- x -#} c") == "a\nbc"
    assert render("{{ '}}' ~ \"%}\" }}") == "}}%}"


def test_tests_slices_lists_and_scopes():
    render = lambda source, **v: H.Template(source).render([], **v)[0]
    assert render("{{ x is defined }}{{ y is defined }}{{ x is not none }}{{ x.a is undefined }}{{ x is mapping }}{{ 3 is odd }}{{ 'a' is in ['a'] }}", x={}) == "truefalsetruetruetruetruetrue"
    assert render("{{ [1, 2, 3][1:] | join('-') }}{{ 'abc'[::-1] }}{{ 'abc'[:2] }}{{ {'a': [4]}['a'][0] }}{{ [] | length }}") == "2-3cbaab40"
    assert render("{% for k, v in x.items() %}{{ k }}={{ v }};{% endfor %}", x={"a": 1, "b": 2}) == "a=1;b=2;"
    assert render("{% for i in range(3) %}{{ s }}{% set s = i %}{{ s }}|{% endfor %}{{ s is defined }}") == "0|1|2|false"
    assert render("{% set n = namespace(k=0) %}{% for i in x if i > 1 %}{% set n.k = n.k + i %}{{ loop.index }}{% endfor %}={{ n.k }}", x=[1, 2, 3]) == "12=5"
    assert render("{{ 7 // 2 }}{{ 7 % 4 }}{{ -2 * 3 }}{{ 1 / 2 }}{{ 'A b'.lower().split(' ')[-1] }}{{ 'x'.startswith('x') }}") == "33-60.5btrue"
    for bad in ("{{ x.format }}", "{{ ''.format(1) }}", "{{ x.__class__() }}", "{{ open('f') }}", "{{ x is strange }}", "{% for a b in c %}{% endfor %}", "{% set a.b.c = 1 %}"):
        if bad == "{{ x.format }}":
            assert render(bad, x="{}") == ""
            continue
        with pytest.raises(H.TemplateError):
            H.Template(bad)


@pytest.mark.parametrize("source", ["{{ 'x' * 100000000 }}", "{{ '%1000000000d' % 1 }}", "{{ 9 * 999999999999999999 * 999999999999999999 }}", "{{ range(1000000000) }}", "{{ [0] * 99999999 }}", "{{ 'x'.replace('', y) }}", "{{ 99999999999999999999 }}", "{{ 1 / 0 }}"])
def test_sandbox_is_bounded(source):
    with pytest.raises(H.TemplateError):
        H.Template(source).render([], y="z" * (H.LARGEST_TEXT // 2 + 1))


def test_long_and_clashing_conversations(spark):
    long = "long " * 400_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "</s>"), (2, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"messages": F.lit(1), "formatted": F.lit("x"), "m": F.lit(2)})
    read = {r.conv_id: r for r in H.read_conversations(H.format_conversations(turns)).collect()}
    assert read[1].loss_text == long + "</s>" and [t.text for t in read[1].turns] == [long, long + "</s>"] and [tuple(t) for t in read[2].turns] == [("", "")]
    assert H.read_conversations(H.format_conversations(turns.limit(0))).collect() == []


def test_loss_spans():
    text, spans = H.Template("{% for m in messages %}<{{ m.role }}>{% generation %}{{ m.text }}{% endgeneration %}{% endfor %}").render([{"role": "é", "text": "🎉x"}, {"role": "b", "text": ""}])
    assert [text[a:b] for a, b in spans] == ["🎉x", ""]


pieces = st.lists(st.sampled_from([*H.CONTROLS, "\\", "\\\\", "[", "<", "[INS", "text", "\n", "é", "</s", "[/ROLE", ""]), max_size=6).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool"]), pieces), pieces), max_size=5))
def test_turns_read_back(turns):
    text, spans = H.Template().render([{"role": r, "text": t} for r, t in turns])
    assert H.read_turns(text) == turns
    assert [H.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a [INST]"), (2, 0, None, None), (2, 0, "user", "x"), (None, 5, "system", "s"), (1, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("messages", F.lit(1))
    made = {r.conv_id: r for r in H.read_conversations(H.format_conversations(turns)).collect()}
    assert [tuple(t) for t in made[1].turns] == [("user", "a [INST]"), ("assistant", "b"), ("assistant", "b")] and made[1].loss_text == "bb"
    assert [tuple(t) for t in made[2].turns] == [("", ""), ("user", "x")] and made[None].loss_text == ""
    assert H.format_conversations(turns.limit(0)).collect() == []
    for bad in ("loose", "[INST]a</s>", "[ANS]a", "[ROLE]a[TEXT]b"):
        with pytest.raises(ValueError):
            H.read_turns(bad)


def brute(vectors, k=10):
    sound = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in x]) for i, x in vectors if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for q, x in {i: x for i, x in sorted(sound, reverse=True)}.items():
        if q % 100 == 0:
            x = min(y for i, y in sound if i == q)
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in sound if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("size,values", [(300, 5), (250, 10**6), (7, 3)])
def test_search_against_brute_force(spark, size, values):
    rng = random.Random(size)
    vectors = [(k * 10, [rng.randint(-values, values) / values for _ in range(6)]) for k in range(size)]
    vectors += [(7, None), (8, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (9, [float("nan")] * 6), (11, [float("inf")] * 6), (13, [0.0] * 6), (14, []), (15, [0.5, 0.5]), (20, vectors[0][1]), (None, vectors[0][1]), (5000, [1.0] * 6)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash"))
    got = sorted(tuple(r) for r in top_k(frame, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(vectors)


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty, F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")
    assert top_k(one, F.col("vec_id") % 100 == 0).collect() == []


def test_large_components_stay_exact_and_search_stops_early():
    rng = np.random.default_rng(0)
    x = np.zeros((3000, 8))
    x[:, 0] = rng.permutation(3000)
    lists = Lists(np.arange(3000), x)
    assert lists.top(np.array([2.0] + [0.0] * 7), 2, -1) == [(5998, int(np.argmax(x[:, 0]))), (5996, int(np.argsort(x[:, 0])[-2]))]
    big = Lists(np.array([1, 2]), np.array([[2.0**31 - 1, 1.0], [2.0**31, -1.0]]))
    assert big.top(np.array([2.0**31 - 3, 3.0]), 2, 0) == [((2**31 - 3) * 2**31 - 3, 2), ((2**31 - 3) * (2**31 - 1) + 3, 1)]
