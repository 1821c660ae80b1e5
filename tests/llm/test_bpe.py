"""Operator 12 against the tokenizers library on given, crafted and random texts, and as a round trip."""

import hashlib
import random
from array import array

import pytest
from tokenizers import Tokenizer

from conftest import SF001
from glossa.llm import bpe, catalog

SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(bpe.vocabulary_path())


def _same(encoder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = encoder.encode(text)
    assert list(array("I", got)) == ids, repr(text[:200])
    assert encoder.decode(got) == library.decode(ids, skip_special_tokens=False), repr(text[:200])


def test_crafted_texts(encoder, library):
    # a final capital sigma, a dotted capital I, composed and decomposed accents, separators that are or are not white space
    for text in ["", " ", "\t\n", "Hello World's dog'll", "ΣΑΣ İx", "é é ﬁ", "a\x1cb\x85c　d e​f", "12345 x9y",
                 f"a{SPECIAL}b", f"{SPECIAL}{SPECIAL}", SPECIAL.upper(), "<|startoftext|> <|endoftext", "!!??''''s", "\U0001f600\U0001f468‍\U0001f469", "\x00\x7f",
                 "a" * 3000, "ab" * 700 + "!" * 900, "中文 ไทย", "각", "x̧́"]:
        _same(encoder, library, text)


def test_random_texts(encoder, library):
    rng = random.Random(6)
    pool = [*"abcdefghijklmnopqrstuvwxyzABCXYZ", *" \t\n'.,!?-_0123456789", "'S", "'re", SPECIAL, "the", "ing", "Å", "ß", "́", "Σ", "ا", "中",
            "\U0001f600", " ", " ", "\x1f", "ǅ", "ẞ", "½", "٠", "Ⅰ"]
    for _ in range(3000):
        _same(encoder, library, "".join(rng.choice(pool) for _ in range(rng.randint(0, 40))))


def test_runs_and_kept_words_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 50)
    small = bpe.Encoder(bpe.Vocabulary(bpe.vocabulary_path()), keep=2_000)
    rng = random.Random(7)
    for _ in range(50):
        _same(small, library, " ".join("".join(rng.choice("abcdeé.") for _ in range(rng.randint(1, 9))) for _ in range(200)))


def test_query_over_whole_table(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = catalog.QUERIES["op12_bpe_codec"](spark, SF001).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_defined_cases(spark, library):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, " \n", "c", 3), (4, "Same text", "d", 4), (4, "Same text", "d", 4), (None, "x", None, None), (5, long, "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    path = bpe.vocabulary_path()
    got = []
    for out in (bpe.decode(bpe.encode(df, path), path), bpe.encode_and_decode(df, path)):
        assert out.columns == ["doc_id", "text", "ids", "decoded"]
        got = out.collect() + got
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(array("I", bytes(r["ids"]))) == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert len(got) == 2 * len(rows)
    assert bpe.encode(df.filter("false"), bpe.vocabulary_path()).count() == 0


def test_other_kinds_of_files_are_refused():
    with pytest.raises((ValueError, TypeError, KeyError)):
        bpe.Vocabulary(bpe.vocabulary_path("byte_bpe_50k.json"))
