"""Tokeniser cases: texts composed from the rules, and edge cases of the rules."""

import pytest
from pyspark.sql import functions as F

from glossa.functions import text as tx

def _composed():
    """Texts built from a rule each: what the rule makes of two words with something between or behind them."""
    pairs = [("lantern", "Ochre"), ("Zürich", "quay"), ("k9", "row_7")]
    low = lambda *ws: [w.lower() for w in ws]
    for one, two in pairs:
        for gap in (" ", "-", "/", "...", " ;(", "\t\n", "\u2014", "<p>", "<br />", "<wbr>", "</td><td class=x>", "&quot;", " &ndash; ", "&amp;"):
            yield f"{one}{gap}{two}", low(one, two)
        for mark in ("'", "\u2019"):
            yield f"{one} ca{f'n{mark}t'} {two}", low(one, "can", "not", two)
            yield f"{one} wo{f'n{mark}t'} {two}", low(one, "will", "not", two)
            for stem in ("did", "Is", "SHOULD"):
                yield f"{stem}n{mark}t {two}", low(stem, "not", two)
            yield f"{one}{mark}s {two}", low(one, "s", two)
    for figures in ("3.25", "12/40", "7:30"):
        yield f"x {figures}", ["x", *figures.replace("/", ".").replace(":", ".").split(".")]


GOLDEN = [
    *_composed(),
    ("", []),
    (" \r\n ;;--(?) \t", []),
    # quirks of the rule
    ("certain't", ["certis", "not"]),
    ("DON'TS n't don't", ["don", "ts", "n", "t", "do", "not"]),
    ("_n't an't", ["_", "not", "a", "not"]),
    ("x n't 5n't", ["x", "n", "t", "5", "not"]),
    ("½ ² x²", ["½", "²", "x²"]),
    ("İstanbul", ["i", "stanbul"]),
    ("a<b>c", ["a", "c"]),
    ("won'tx", ["will", "notx"]),
    ("&lt;b&gt;bold&lt;/b&gt;", ["b", "bold", "b"]),
    ("caf&eacute; &#233;t&#xE9; &amp", ["café", "été"]),
]


@pytest.fixture(scope="module")
def tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, text string")
    rows = df.select("i", tx.tokenize("text").alias("t")).collect()
    return {r["i"]: r["t"] for r in rows}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(tokens, i):
    assert tokens[i] == GOLDEN[i][1], GOLDEN[i][0]


def test_null_text_gives_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(tx.tokenize("text").alias("t")).first()["t"] is None


def test_bigrams_and_features(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b"],), (["x"],), ([],)], "t array<string>")
    rows = df.select(tx.bigrams("t").alias("b"), F.array_sort(tx.feature_set("t")).alias("f")).collect()
    assert rows[0]["b"] == ["a b", "b a", "a b"]
    assert rows[0]["f"] == ["a", "a b", "b", "b a"]
    assert rows[1]["b"] == [] and rows[1]["f"] == ["x"]
    assert rows[2]["b"] == [] and rows[2]["f"] == []


def test_word_count_and_buckets(spark):
    cases = [(None, 0, 0), ("", 0, 0), ("one", 1, 0), (" ".join(["w"] * 100), 100, 0), (" ".join(["w"] * 101), 101, 1),
             (" ".join(["w"] * 400), 400, 3), (" ".join(["w"] * 401), 401, 4), ("a b c\x1cd\x85e", 5, 0)]
    df = spark.createDataFrame([(c[0],) for c in cases], "text string")
    rows = df.select(tx.word_count("text").alias("n")).select("n", tx.length_bucket_id("n").alias("b"),
                                                              tx.length_bucket_label(tx.length_bucket_id("n")).alias("l")).collect()
    for (text, n, b), row in zip(cases, rows):
        assert (row["n"], row["b"]) == (n, b), text
    assert rows[0]["l"] == "1-100 words" and rows[-2]["l"] == "More than 400 words"


def test_python_rule_agrees_on_documents(spark):
    """The Spark tokeniser equals a Python statement of the rule on every sf0.001 document and page."""
    import html
    import re

    w = re.compile(r"\b(\w+)n't\b")

    def py_tok(s):
        s = re.sub(r"<[^>]+>", " ", s)
        s = html.unescape(s).lower().replace("’", "'")
        for a, b in tx.IRREGULAR_CONTRACTIONS:
            s = s.replace(a, b)
        return re.findall(r"\b\w+\b", w.sub(r"\1 not", s))

    from conftest import SF001
    for name, col in (("documents", "text"), ("pages", "html")):
        df = spark.read.parquet(f"{SF001}/{name}.parquet").select(col, tx.tokenize(col).alias("t"))
        for row in df.collect():
            assert row["t"] == py_tok(row[col])
