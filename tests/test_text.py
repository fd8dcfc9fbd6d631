import json
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from servops.functions.params import default_params, merge_params, params_json
from servops.functions.text import py_strip, py_word_count, re_escape, unescape_unicode

EDGE = ["", " ", "a b", "  lead and trail \t\n", "x\x1cy\x1dz\x1e w\x1f", "a\x85b\xa0c　d e",
        "no-space", "​ zero width is not space", "tab\tsep\x0bvt\x0cff\rcr"]


def test_strip_and_word_count_match_python(spark):
    df = spark.createDataFrame([(s,) for s in EDGE], "s string")
    got = df.select("s", py_strip("s").alias("st"), py_word_count("s").alias("wc")).collect()
    for r in got:
        assert r.st == r.s.strip(), repr(r.s)
        assert r.wc == len(r.s.split()), repr(r.s)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x3001), max_size=40), min_size=1, max_size=8))
def test_strip_word_count_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", py_strip("s").alias("st"), py_word_count("s").alias("wc")).collect():
        assert r.st == r.s.strip()
        assert r.wc == len(r.s.split())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=150), min_size=1, max_size=8))
def test_re_escape_matches_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", re_escape("s", 100).alias("e")).collect():
        assert r.e == re.escape(r.s[:100])


def test_unescape_unicode(spark):
    cases = {"plain": "plain", "bar \\u2588\\u2588 50%": "bar ██ 50%", "emoji \\ud83d\\ude00!": "emoji 😀!",
             "mixed \\u00e9t\\u00E9": "mixed été", "cut \\u12": "cut \\u12", "": ""}
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert {r.s: r.u for r in df.select("s", unescape_unicode("s").alias("u")).collect()} == cases


def test_params_merge_override_wins_and_keeps_order(spark):
    df = spark.createDataFrame([({"temperature": "0.2", "stop": '"END"'},), (None,), ({},)],
                               "o map<string,string>")
    got = [r.j for r in df.select(params_json(merge_params(default_params(), F.col("o"))).alias("j")).collect()]
    exp = []
    for o in [{"temperature": 0.2, "stop": "END"}, None, {}]:
        d = {"temperature": 0.7, "max_tokens": 1024, "top_p": 0.95}
        d.update(o or {})
        exp.append(json.dumps(d))
    assert got == exp
