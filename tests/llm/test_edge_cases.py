"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from itertools import product

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossa.llm import (cotraining, cover_tree, language_id, line_templates, mixing, packing, quality_rules, secret_scan, simhash,
                        url_filter)

LONG = " ".join(f"w{i % 700}x{i % 13}" for i in range(30_000))
NAMES = ["".join(p) for p in product(["ba", "do", "mi", "ru"], ["lan", "ser", "tov"], ["der", "nic", "pal", "gum", "lo"])]
PROSE = " ".join(f"the {a} of {b} and {c}" for a, b, c in zip(NAMES, NAMES[7:], NAMES[19:]))
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "word", "en", "a"), (None, "two words", None, "b"),
    (6, LONG, "xl", "a"), (7, PROSE, "en", "b"), (7, PROSE, "en", "b"), (8, PROSE, "en", "b"), (9, "two words", "xx", ""),
    (10, "😀 中文 café", "fr", "é"), (-5, "line one\nline one\nline two", None, "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    clash = ["n_words", "kept", "fp", "hash", "node", "root", "u", "v", "size", "copies", "_s_key", "_m_key", "label", "count", "c_id"]
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in clash])


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """Every stage over what the one before kept, written and read again."""
    folder, out, current = tmp_path_factory.mktemp("stages"), {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, current, "").write.parquet(str(folder / name))
        current = spark.read.parquet(str(folder / name))
        out[name] = current
    return out


def test_stages_keep_the_columns(docs, stages):
    for name in list(stages)[:-1]:
        assert stages[name].columns == docs.columns, name
        assert stages[name].filter("n_words <> 'own n_words' or c_id <> 'own c_id'").isEmpty()


def test_stage_results(stages):
    ids = lambda name: sorted(r["doc_id"] for r in stages[name].collect())
    assert ids("quality_rules") == [7, 7, 8]
    texts = {r["doc_id"]: r["text"] for r in stages["line_dedup"].collect()}
    assert texts[7] == PROSE and texts[8] == ""  # the first occurrence of a line stays
    assert sorted(ids("simhash")) == sorted(set(ids("quality_rules")))  # equal rows: one of them
    assert set(ids("mixing")) <= set(ids("simhash"))


def test_empty_table_through_all_stages(spark, docs, tmp_path):
    current = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, current, "").write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        assert current.count() == 0


def test_every_stage_takes_the_raw_rows(spark, docs):
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, "").count() >= 1, name


def test_secret_and_language_rows(spark, docs):
    got = secret_scan.scan(docs.select("doc_id", "text", "kept"))
    assert got.count() == len(ROWS) and got.filter("size(_x_assign) + size(_x_entropy) > 0").isEmpty()
    model = {"langs": [], "masks": None, "rates": None, "slot_bits": 20}
    fitted = language_id.fit(docs.filter("false"))
    assert fitted["langs"] == model["langs"]
    pred = language_id.predict(docs.select("doc_id", "text"), fitted).select("_g_pred.*").collect()
    assert {r["lang"] for r in pred} == {"und"} and {r["score"] for r in pred} == {0.0}


def test_classifier_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    few = spark.createDataFrame([(4, 1), (None, 0), (99, 0), (7, None)], "doc_id long, quality int")
    for labels, share in ((none, 0.5), (few, 0.5)):
        model = cotraining.fit(docs.select("doc_id", "text", "lang", "source"), labels)
        got = cotraining.score(docs.select("doc_id", "text", "lang", "source"), model).select("_k_score.score").collect()
        assert {r["score"] for r in got} == {share} and len(got) == len(ROWS)


def test_packing_null_ids_and_repeats(docs):
    got = packing.pack_documents(docs.select("doc_id", "text")).collect()
    assert sorted((r["doc_id"] or 0) for r in got if r["piece"] == 0) == sorted((r[0] or 0) for r in ROWS)
    assert {(r["length"], r["start"]) for r in got if r["doc_id"] in (1, 2)} == {(1, 0)}  # the closing id alone


def test_urls(spark):
    rules = url_filter.rule_table(spark)
    rows = [(1, None, None), (2, "no scheme", "<a>"), (3, "", None), (None, "http://a.com/de/1", None), (5, "http://a.com/de/1", None),
            (5, "http://a.com/de/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("x")).withColumn("node", F.lit(1))
    got = sorted((r["page_id"] or 0, r["verdict"], r["rule"]) for r in url_filter.judge(pages, rules).collect() if r["page_id"] != 1 or True)
    assert got == sorted([(1, "allow", None), (2, "allow", None), (3, "allow", None), (0, "block", "com/de/"), (5, "block", "com/de/"),
                          (5, "block", "com/de/")], key=lambda x: x[0])
    assert url_filter.judge(pages.filter("false"), rules).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1),
            (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0, 0.0], 1),
            (None, [1.0, 0.1], 1), (11, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cid", F.lit("x"))
    got = {}
    for r in cover_tree.near_duplicates(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got.pop(None) == [(3, 1, False)]
    assert got.pop(1) == [(3, 1, True)] and got.pop(2) == [(3, 1, False)] * 2
    assert all(v == [(0, k, True)] for k, v in got.items()) and len(got) == 9
    assert cover_tree.near_duplicates(df.filter("false")).count() == 0


def test_quality_and_lines_by_row(docs):
    rows = quality_rules.judge(docs.select("doc_id", "text", "lang"), ["doc_id"]).collect()
    assert len(rows) == len(ROWS) and {r["_q_n"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    lines = {r["doc_id"]: (r["text"], r["_d_before"], r["_d_dropped"]) for r in line_templates.drop_recurring_lines(docs).collect()}
    assert lines[1] == (None, 0, 0) and lines[2] == ("", 1, 0)
    assert lines[None][0] == "two words" and lines[9] == ("", 1, 1)  # a null id sorts first
    assert lines[-5] == ("line one\nline one\nline two", 3, 0)  # recurring within one document only


def test_simhash_and_mix_by_row(docs):
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert got[1] == got[2] == got[3] == {(0, 1)}
    assert {c for _, c in got[None]} == {9} and {c for _, c in got[7] | got[8]} == {7}
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(ROWS) and all(0 <= r["copies"] <= 2 for r in mixed)
    assert {r["copies"] for r in mixed if r["size"] == 0} <= {0, 1, 2} and {r["size"] for r in mixed if r["doc_id"] in (1, 2, 3)} == {0}
