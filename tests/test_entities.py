"""Character references by SQL functions against the interpreter's own decoder."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from glossa.functions import text as tx


def _decoded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(8)
    return dict(df.select("k", tx.unescape_entities("t")).collect())


def _same(spark, texts):
    got = _decoded(spark, texts)
    wrong = [(t, got[k], html.unescape(t)) for k, t in enumerate(texts) if got[k] != html.unescape(t)]
    assert len(got) == len(texts) and not wrong, wrong[:5]


def test_every_name_with_and_without_semicolon(spark):
    names = sorted({n.rstrip(";") for n in html5})
    _same(spark, [f"&{n};" for n in names] + [f"&{n}" for n in names] + [f"a &{n}x;b" for n in names] + [f"&{n}=1&{n};;" for n in names])


def test_numbers(spark):
    codes = [*range(0x120), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFDF0, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600,
             0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 99_999_999, 100_000_000, 10 ** 30]
    _same(spark, [f for c in codes for f in (f"x&#{c};y", f"&#{c}", f"&#x{c:x};", f"&#X{c:X} &#000{c};")])
    _same(spark, ["&#;", "&#x;", "&#xg;", "&#", "&# 1;", "&#1a;", "&#-1;", "&#x00000000041;", "&#0000000000;"])


def test_random_texts_and_edges(spark):
    rng = random.Random(4)
    parts = ["&", "&amp;", "&ampamp;", "#", "&#", "x41;", "65", ";", "lt", "&notit;", "&notin;", "&amp;lt;", " ", "\n", "<", "é", "&Zfr;",
             "&AMP", "&" + "a" * 40 + ";", "&amp-x;", "$1", "\\", "&#x1F600;", "&&"]
    _same(spark, ["", "&", "&&", "no reference", "a" * 10_000 + "&lt;"] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3_000)])
    assert spark.createDataFrame([(None,)], "t string").select(tx.unescape_entities("t")).first()[0] is None


def test_tokeniser_plan_has_no_python(spark):
    plan = spark.createDataFrame([("a &lt; b",)], "t string").select(tx.tokenize("t").alias("w"), F.size(tx.tokenize("t")))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text
    assert plan.first()["w"] == ["a", "b"]
