from pyspark.sql import functions as F
import pytest

from tripleloom.functions import text


def value(spark, raw, fn):
    return spark.createDataFrame([(raw,)], "x string").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw, clean",
    [
        (
            "Ada[1] wrote (in 1843) notes (long ones).\n\n\nShe  lived [22]in London.",
            "Ada wrote .\nShe lived in London.",
        ),
        ("A (b) c (d) e\nSee also:", "A e"),
        ("one line:", "one line"),
        ("", ""),
    ],
)
def test_clean_text(spark, raw, clean):
    assert value(spark, raw, text.clean_text) == clean


def test_html(spark):
    page = (
        '<h1 id="x">no</h1><h1 id="firstHeading">Ada &amp; Co</h1><p> one <b>two</b>[3] </p>'
        "<p class='k'>a &#233;&#x41; &lt;b&gt; &#99999999;</p><p>open"
    )
    assert value(spark, page, text.html_paragraphs) == "one two \na éA <b> &#99999999;\nopen"
    assert value(spark, page, text.html_title) == "Ada & Co"


def test_norm_key(spark):
    assert value(spark, "  Straße ÆØ Ångström Łódź ", text.norm_key) == "strasse aeo angstrom lodz"
    assert value(spark, "Ti\u1ebfng Vi\u1ec7t e\u0301", text.norm_key) == "tieng viet e"
    assert value(spark, "Plain ASCII", text.norm_key) == "plain ascii"


def test_tokens_and_labels(spark):
    assert value(spark, "What's the café, (really)?", text.tokenize_question) == ["what's", "the", "cafe", "really"]
    assert value(spark, "__label__12", text.parse_label) == 12
    assert value(spark, "m/emb_idec_clusters_58_partialTrue_predicate.fth", text.cluster_count_of_path) == 58
    assert value(spark, "m/emb_idec_clusters_58_partialTrue_predicate.fth", text.partial_flag_of_path) is True
    assert value(spark, "http://x/y/Q42", text.last_uri_segment) == "Q42"
    assert value(spark, " New  York ", text.surface_underscore) == "New_York"


def test_pair_and_triple(spark):
    row = spark.createDataFrame([("ada", "london", 0.12361)], "s string, o string, p double")
    out = row.select(
        text.pair_key(F.col("s"), F.col("o")),
        text.format_triple(F.lit("a"), F.lit("b"), F.lit("c"), F.col("p")),
        text.tag_relation_by_object(F.lit("born"), F.lit(True), F.lit(False)),
    ).first()
    assert list(out) == ["ada ::: london", "(a)-[b]->(c) <=> |0.1236|", "born date"]


def test_sitelink(spark):
    doc = (
        '{"entities":{"Q1":{"sitelinks":{"enwiki":{"site":"enwiki","title":"A","url":"https://e/A%20%C3%A9+b"},'
        '"dewiki":{"site":"dewiki","title":"A","url":""}}}}}'
    )
    assert value(spark, doc, lambda c: text.sitelink(c, F.lit("Q1"))) == "https://e/A é+b"
    assert value(spark, doc, lambda c: text.sitelink(c, F.lit("Q2"))) is None
    assert value(spark, doc, lambda c: text.sitelink(c, F.lit("Q1"), None)) == {"enwiki": "https://e/A é+b"}


@pytest.mark.parametrize("tokens, out", [("x x", "x"), ("a b a b", "a b"), ("a b c", "a b c"), ("a", "a")])
def test_halve(spark, tokens, out):
    halved = value(spark, tokens, lambda c: F.array_join(text.halve_repetition(F.split(c, " ")), " "))
    assert halved == out


def test_paragraphs_end_at_blocks_and_names_are_decoded(spark):
    assert value(spark, "<p>alpha<div>x</div>", text.html_paragraphs) == "alpha"
    assert value(spark, "<p>one<p>two</p><p>three &eacute;", text.html_paragraphs) == "one\ntwo\nthree é"
    assert value(spark, '<script>var t="<p>no</p>";</script><!-- <p>no --><P class=a>yes<table>', text.html_paragraphs) == "yes"
    assert value(spark, "&euro; &amp;lt; &lt; &#38;gt; &nosuch; &NotEqualTilde; &amp", text.unescape_html) == "€ &lt; < &gt; &nosuch; ≂̸ &amp"
