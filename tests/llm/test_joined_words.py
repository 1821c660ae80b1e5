"""New words of a call of the packing's tokeniser get the ids that they get alone."""

import random

from glossa.llm import packing


def _words(n=20_000):
    rng = random.Random(3)
    pool = "abcXYZ019.,;:!?'\"-_/\\()[]{}<>|@#$%^&*+=~`éßñ中文日本😀ﬁ٣²½\t\x0b ‍\u0085"
    words = ("".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(n))
    return [w for w in dict.fromkeys([*words, "'s", "don't", "!!!", "1234567"]) if not w[0].isspace()]


def test_joined_words_have_their_own_ids():
    encoder, words = packing.Encoder(packing.vocabulary()), _words()
    for lead in (" ", ""):
        assert encoder._words(words, lead) == encoder._raw([lead + w for w in words])


def test_new_words_share_calls():
    encoder = packing.Encoder(packing.vocabulary())
    words, seen = [f"w{i}" for i in range(1_000)], []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return inner.encode_batch_fast(texts, **options)

    inner, encoder.tokenizer = encoder.tokenizer, Counting()
    encoder.encode([" ".join(["start", *words])])
    assert len(seen) <= 1_000 // packing.JOINED + 4


def test_a_newline_of_several_ids_joins_nothing():
    encoder, words = packing.Encoder(packing.vocabulary()), _words(500)
    encoder.newlines[1] = encoder._raw(["ab\n\tcd"])[0]
    assert encoder._words(words, " ") == encoder._raw([" " + w for w in words])
