"""References of the quality rules: documents without language, and references thinned by junk."""

import random

from glossa.llm import quality_rules

SYLLABLES = ["ba", "do", "mi", "ru", "ten", "gor", "sal", "vep", "lin", "cho"]


def _words(rng, n, lang=None, share=0.176):
    """``n`` words, a ``share`` of them common words of ``lang``, the rest invented."""
    common = lambda: rng.random() < share and rng.choice(quality_rules.COMMON_WORDS[lang])
    return " ".join((lang and common()) or "".join(rng.choice(SYLLABLES) for _ in range(3)) for _ in range(n))


def _kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"]: r["_q_kept"] for r in quality_rules.judge(df, ["doc_id"]).collect()}


def test_clean_prose_without_language_is_kept(spark):
    rng = random.Random(11)
    rows = [(100 * i + k, _words(rng, 300, lang), lang) for i, lang in enumerate(quality_rules.COMMON_WORDS) for k in range(40)]
    rows += [(1000 + 100 * i + k, _words(rng, 300, lang), None) for i, lang in enumerate(quality_rules.COMMON_WORDS) for k in range(10)]
    got = _kept(spark, rows + [(5000, " ".join(["#1"] * 1 + ["%9 $%& 42 77"] * 60), None)])
    assert all(got[r[0]] for r in rows) and not got[5000]


def test_all_documents_without_language(spark):
    rng = random.Random(12)
    rows = [(100 * i + k, _words(rng, 300, lang), None) for i, lang in enumerate(quality_rules.COMMON_WORDS) for k in range(20)]
    junk = [(5000 + k, _words(rng, 300), None) for k in range(5)]
    got = _kept(spark, rows + junk)
    assert all(got[r[0]] for r in rows) and not any(got[r[0]] for r in junk)


def test_language_without_a_list_keeps_its_own_reference(spark):
    rng = random.Random(13)
    rows = [(k, _words(rng, 300, "en"), "en") for k in range(20)] + [(100 + k, _words(rng, 300), "xx") for k in range(20)]
    rows += [(200 + k, _words(rng, 300, "en"), "yy") for k in range(2)]
    assert all(_kept(spark, rows).values())


def test_a_third_of_the_rows_without_common_words(spark):
    rng = random.Random(14)
    rows = [(1000 * i + k, _words(rng, n, lang), lang) for i, lang in enumerate(quality_rules.COMMON_WORDS)
            for k, n in enumerate([60, 100, 140, 200, 300, 600] * 8)]
    junk = [(5000 + 100 * i + k, _words(rng, n), lang) for i, lang in enumerate(quality_rules.COMMON_WORDS)
            for k, n in enumerate([60, 100, 140, 200, 300, 600] * 4)]
    got = _kept(spark, rows + junk)
    assert not any(got[r[0]] for r in junk)
    assert sum(got[r[0]] for r in rows) >= 0.97 * len(rows) and all(got[r[0]] for r in rows if len(r[1].split()) >= 100)


def test_clean_prose_stays_beside_a_majority_of_junk(spark):
    rng = random.Random(15)
    rows = [(k, _words(rng, 300, "en"), "en") for k in range(20)]
    junk = [(5000 + k, _words(rng, 300), "en") for k in range(80)]
    got = _kept(spark, rows + junk)
    assert all(got[r[0]] for r in rows) and not any(got[r[0]] for r in junk)
