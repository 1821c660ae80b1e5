"""Links, suppressed runs, repeated rows and prior of the operators 1, 3, 4, 8 and 9; the SQL on rows that use every branch."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossa.llm import language_id, mixing, packing, secret_scan, url_filter
from glossa.llm.common import numbered

PAGES = [
    (1, "http://bad.com/de/x", None),
    (2, "http://bad.com/fold/y", '<link rel="canonical" href="../de/x">'),
    (3, "http://two.net/b", "<LINK rel='alternate canonical' href='http://bad.com/./fold/.././de/x'>"),
    (4, "http://three.net/c", '<link rel="canonical" href="/c"><p></p><link rel="canonical" href="http://bad.com/de/x">'),
    (5, "http://four.net/d", '<link rel="canonical" href="?of=1">'),
    (6, "http://four.net/d?of=1", '<meta http-equiv="refresh" content="1; url=//bad.com/de/x">'),
    (7, "http://up.net/a/b/c", '<link rel="canonical" href="../../../../z/..">'),
    (8, "http://up.net/", '<meta http-equiv="refresh" content="1; url=/k"><meta http-equiv="refresh" content="1; url=http://bad.com/de/x">'),
    (9, "http://free.net/", '<link rel="non-canonical" href="http://bad.com/de/x">'),
    (10, None, '<link rel="canonical" href="http://bad.com/de/x">'),
    (11, "http://ok.com/fr/1", '<link rel="canonical" href="http://bad.com/de/x">')]


def sql_rows(sql: str, **tables: pd.DataFrame) -> list[tuple]:
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return sorted(map(tuple, con.execute(sql).fetchall()), key=repr)


def test_links_of_all_shapes_carry_the_block(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filter.op1_redirect_filter(spark, str(tmp_path)).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {1, 2, 3, 4, 5, 6, 7, 8}
    want = sql_rows(url_filter.ORACLE_SQL, pages=pd.DataFrame(PAGES, columns=["page_id", "url", "html"]))
    assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("target, absolute", [
    ("x", "http://h.n/a/b/x"), ("./x", "http://h.n/a/b/x"), ("../x", "http://h.n/a/x"), ("../../../x", "http://h.n/x"), ("..", "http://h.n/a/"),
    (".", "http://h.n/a/b/"), ("../..", "http://h.n/"), ("?q=../1", "http://h.n/a/b/c?q=../1"), ("/r/./s/../t?u#v", "http://h.n/r/t?u#v"),
    ("x.y/..z", "http://h.n/a/b/x.y/..z"), ("https://O.n/p/../q", "https://O.n/q"), ("#f", None)])
def test_targets(spark, target, absolute):
    assert spark.range(1).select(url_filter.resolve(F.lit(target), F.lit("HTTP://H.n/a/b/c?d=e"))).first()[0] == absolute


def test_runs_beside_dates_base_spans_and_without_digits(spark, tmp_path):
    rng = random.Random(5)
    key = "".join(rng.sample(secret_scan.ALPHABET[:62], 32))
    letters = "QzXmWvBtRkLpYsHdNcGfJwTe"
    hexed = "0123456789abcdef01234567"
    texts = [f"2024-01-02-{key}", "2024-01-02T03-04-05Z/2024-02-03T00", f"see {hexed}/{key} and", f"{letters} end", "thisisalongrunofwordswithoutdigits",
             f"token={hexed} {key}", f"AKIA{'Q7' * 8}-{key}", None, "", f"{key}/{hexed}/{key}"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, secret_scan.op3_entropy_secrets(spark, str(tmp_path)).collect()), key=repr)
    spans = {r[0]: [s for s in r[5].split(",") if s.startswith("entropy")] for r in got}
    assert [len(spans[i]) for i in range(len(texts))] == [1, 0, 1, 1, 0, 1, 1, 0, 0, 2]
    assert spans[2] == [f"entropy:{4 + 24}:{4 + 24 + 33}"]
    assert got == sql_rows(secret_scan.ORACLE_SQL, documents=pd.DataFrame(rows, columns=["doc_id", "text"]))


def test_numbers_among_equal_rows(spark):
    df = spark.createDataFrame([(None, "a")] * 70 + [(1, "a")] * 3 + [(2, None)], "i long, t string")
    got = sorted(map(tuple, numbered(df, block=16).collect()), key=repr)
    assert got == sorted([(None, "a", k) for k in range(70)] + [(1, "a", k) for k in range(3)] + [(2, None, 0)], key=repr)


def test_one_row_in_a_third_of_the_table_is_traded_in_many_chunks(spark):
    rows = [(1, "s", "w " * 7)] * 400 + [(i, "s" if i % 2 else "t", "w " * (1 + i % 9)) for i in range(2, 802)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    first, again = (sorted(map(tuple, mixing.mix(d, chunk=32).collect()), key=repr) for d in (docs, docs.repartition(5)))
    assert first == again and len(first) == len(rows)
    parts = numbered(docs.select("doc_id", F.xxhash64("text").alias("hash"))).withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id", "hash", "nr"), F.lit(38))).filter("doc_id = 1").groupBy("chunk").count().collect()
    assert len(parts) > 30 and max(r["count"] for r in parts) < 40


def test_last_open_document_keeps_its_chance(spark):
    rows = [(i, f"s{i}", "w w w w") for i in range(600)]  # one document a source: its fraction is the only one
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights=(1,), share=1.3).collect()
    taken = sum(r["copies"] for r in got)
    assert set(r["copies"] for r in got) == {1, 2} and abs(taken - 780) < 60


def test_repeated_rows_are_packed_in_several_shards(spark):
    items = spark.createDataFrame([("1", 0, 0, 5, 9)] * 300 + [(str(i), 0, 0, 1 + i % 60, i) for i in range(2, 102)],
                                  "doc_id string, piece int, start long, length long, ids_crc32 long")
    got = packing.pack_pieces(items, capacity=64, shard=64).collect()
    assert len(got) == 400 and set(got[0].asDict()) == {*items.columns, "sequence_id", "offset"}
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len({r["sequence_id"] >> 24 for r in got if r["doc_id"] == "1"}) > 3


def test_sample_bound_holds_for_a_repeated_row_and_the_prior_decides(spark):
    rows = [(8, "one and the same row", "en")] * 500 + [(i, f"text number {i} of many", "de" if i % 5 else "en") for i in range(20, 220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_sample(docs, rows=50).groupBy("lang", "text").count().collect()
    assert max(r["count"] for r in sample) == 1
    model = language_id.fit(docs, rows=1_000)
    common = max(range(len(model["langs"])), key=lambda i: model["prior"][i])
    found, score = language_id.classify(["\u4e2d\u6587\u5b57\u7b26\u4e32", None], model)
    assert found.tolist() == [common, -1] and np.isclose(score[0], model["prior"][common])
