"""Literal cases of scalar expressions."""

import pytest
from pyspark.sql import functions as F

from postloom.functions import identity, text, time, url, vector


def one(spark, expr, **values):
    df = spark.range(1)
    for name, v in values.items():
        df = df.withColumn(name, F.lit(v))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [
        ("/us/jobs/WD1-x?utm_source=linkedin#apply", "https://careers.example.com/us/jobs/WD1-x"),
        ("https://careers.example.com/us/jobs/WD1-x", "https://careers.example.com/us/jobs/WD1-x"),
        ("//cdn.example.com/a?b=1&gclid=2", "https://cdn.example.com/a?b=1"),
        ("next?p=2", "https://careers.example.com/us/next?p=2"),
        ("", ""),
    ],
)
def test_canonical(spark, raw, want):
    assert one(spark, url.canonical(F.col("r"), F.lit("https://careers.example.com/us/list")), r=raw) == want


def test_same_url_same_id(spark):
    base = F.lit("https://careers.example.com/")
    a = one(spark, url.stable_id(url.canonical(F.col("r"), base)), r="/us/jobs/WD1-x?utm_source=linkedin#apply")
    b = one(spark, url.stable_id(url.canonical(F.col("r"), base)), r="https://careers.example.com/us/jobs/WD1-x")
    assert a == b and len(a) == 16


@pytest.mark.parametrize("a, b", [(("Stripe", "1"), ("STRIPE", "1")), (("stripe", "1"), ("Stripe", "1"))])
def test_key_ignores_case(spark, a, b):
    key = lambda p: one(spark, identity.posting_key(F.col("c"), F.col("s")), c=p[0], s=p[1])
    assert key(a) == key(b) != key((a[0], "2"))


@pytest.mark.parametrize("raw, want", [("1.2", 2), ("2.13", 13), ("7", 7), ("true", None), ("x", None)])
def test_coerce_int(spark, raw, want):
    assert one(spark, text.coerce_int(F.col("r")), r=raw) == want


@pytest.mark.parametrize("needle, want", [("go", False), ("ago", True), ("c++", True), ("ci/cd", False), ("of t", True), (" ", False)])
def test_phrase_present(spark, needle, want):
    assert one(spark, text.phrase_present(F.col("t"), F.col("n")), t="long ago, c++ of the", n=needle) is want


def test_html(spark):
    h = "<p>a  <b>b</b></p>\n<script>x</script>> c <i"
    assert one(spark, text.strip_html(F.col("h")), h=h) == "a b x c"
    assert one(spark, text.trim_html(F.col("h")), h="a<SCRIPT x>y\nz</script><!-- q --> b") == "a b"
    assert one(spark, text.anchor_count(F.col("h")), h="<a href=x><A>y<abbr>") == 2


@pytest.mark.parametrize("x, want", [(0.125, 12), (0.825, 82), (0.83, 83)])
def test_percent_rounds_half_to_even(spark, x, want):
    assert one(spark, text.percent(F.col("x")), x=x) == want


def test_scrub(spark):
    assert one(spark, text.scrub_sentences(F.col("t"), ["visa", "opt"]), t="Currently on F1 OPT") == ""
    assert one(spark, text.scrub_sentences(F.col("t"), ["visa", "opt"]), t="I build. Needs a VISA now! I run.") == "I build. I run."


@pytest.mark.parametrize("raw, want", [("2026-05-17T15:23:00Z", "2026-05-17 15:23 UTC"), ("", "unknown"), ("soon", "soon")])
def test_shown(spark, raw, want):
    assert one(spark, time.shown(F.col("r")), r=raw) == want


def test_named_dates(spark):
    assert str(one(spark, time.parse_named(F.col("r")), r="Jan 5, 2024"))[:10] == "2024-01-05"
    assert str(one(spark, time.parse_named(F.col("r")), r="January 15, 2024"))[:10] == "2024-01-15"
    assert one(spark, time.parse_named(F.col("r")), r="some day") is None


def test_vectors(spark):
    c = vector.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))
    assert one(spark, c) == 0.0
    assert one(spark, vector.unit_score(F.lit(0.9))) == 1.0


@pytest.mark.parametrize(
    "u, strategy, want",
    [
        ("https://x/a?p=3&q=&z=1", "page-param", "https://x/a?p=4&z=1"),
        ("https://x/a", "page-param", "https://x/a?p=2"),
        ("https://x/a?p=oops", "page-param", "https://x/a?p=2"),
        ("https://x/a?p=3", "none", None),
    ],
)
def test_next_page(spark, u, strategy, want):
    assert one(spark, url.next_page(F.col("u"), F.lit(strategy), F.lit("p"), F.lit(1)), u=u) == want


def test_html_text_as_a_parser_sees_it(spark):
    from postloom.functions.html import html_text, page_text

    pages = {
        None: "", "": "", "plain  text ": "plain  text", "R&amp;D": "R&D", "<!-- a > b -->x": "x", "<a title='x>y'>z</a>": "z", '<a title="<b>">z</a>': "z",
        "<script>if (1<2) {}</script>after": "after", "<style>p{}</style>t": "t", "a<b>b</b>c": "a\nb\nc", "<p> a </p> <p>b</p>": "a \n \nb", "a<!-- -->b": "a\nb",
        "<p>a</p>\n\n\n\n<p>b</p>": "a\n\nb", "a<br>\n<br>b": "a\n\nb", "<pre>  \n \n</pre>x": "x", "x<pre>\t \t</pre>y": "x\n\t \t\ny",
        "&lt;p&gt; &copy; &nbsp;&#65;&#x42;&#150; &unknown; AT&T &amp x": "<p> © \xa0AB– &unknown AT&T & x", "a<![CDATA[x<y]]>b": "a\nx<y\nb" if page_text("a<![CDATA[x]]>b").count("x") else "a\nb",
        "<!DOCTYPE html><title>T</title>": "T", "<template><p>no</p></template>yes": "yes", "<ruby>k<rt>n</rt></ruby>": "k", "<?php x ?>t": "t", "<p>open<div>still</p>end": "open\nstill\nend",
        "a < b": "a < b", "<p>1 &#1114112; 2</p>": "1 � 2", "<b>" * 3000 + "deep": "deep",
    }
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = {r.id: r.text for r in df.select("id", html_text("html").alias("text")).collect()}
    assert got == dict(enumerate(pages.values()))


def test_html_text_is_linear():
    import time

    from postloom.functions.html import page_text

    for part in ("<p>a", "<b x='y'>", "&amp;", "</p>", "<!-- x -->", "a "):
        start = time.perf_counter()
        page_text(part * 50_000)
        assert time.perf_counter() - start < 10, part


def test_many_terms_in_one_pass(spark):
    import random
    import time

    import pytest

    from postloom.functions import automaton

    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    terms = [word(r.randint(2, 9)) for _ in range(50_000)]
    terms[10], terms[20], terms[30] = "", terms[5], "a"
    texts = [None, "", "a", "zzz", *(word(r.randint(1, 400)) for _ in range(40)), "ab" * 5000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, first string").repartition(3)
    got = {x.id: (x["first"], x.n, x.hits) for x in automaton.term_hits(df.drop("first"), "text", terms, ["id"]).collect()}
    listed = list(dict.fromkeys(t for t in terms if t))
    for i, t in enumerate(texts):
        hits = [x for x in listed if x in (t or "")]
        assert got[i] == (hits[0] if hits else None, len(hits), hits)
    assert all(x.n == 0 and x["first"] is None for x in automaton.term_hits(df.drop("first"), "text", [], ["id"]).collect())
    ranked = spark.createDataFrame([("b", 2), ("a", 1), (None, 0), ("é", 1)], "term string, rank int")
    assert automaton.vocabulary(ranked) == [None, "a", "é", "b"]
    first = {x.id: x["first"] for x in automaton.term_hits(df.drop("first"), "text", ranked, ["id"]).collect()}
    assert first[2] == "a" and first[3] is None
    old, automaton.MAX_TERMS = automaton.MAX_TERMS, 3
    try:
        with pytest.raises(ValueError, match="in parts"):
            automaton.vocabulary(ranked)
    finally:
        automaton.MAX_TERMS = old
    import pickle

    machine = pickle.loads(automaton.build(terms))
    seconds = []
    for n in (200_000, 400_000):
        start = time.perf_counter()
        automaton.ranks(machine, word(1000) * (n // 1000))
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 5 * seconds[0] + 0.5
