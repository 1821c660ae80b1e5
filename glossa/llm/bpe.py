"""BPE encoding and decoding from a public vocabulary file (operator 12).

The file's own steps are followed: special strings are cut out of the raw
text, the rest is composed (NFC), white space made one space, lower-cased
character by character, split by the file's pattern, and each word's bytes
are written in the vocabulary's alphabet, the last with the word end.  Merges
of a word are taken from a priority queue by rank, then place, over a doubly
linked list of its symbols; an entry whose symbols have changed since it was
queued is skipped.  Decoding concatenates the vocabulary's strings, with the
blank that the file's missing decoder stands for.

No word reaches over white space, and what stands between recurs, so a worker
keeps the ids of such short stretches, in about ``KEEP`` bytes.  Texts are
taken in runs of about ``RUN`` characters that end at a blank; memory beyond
the text and its ids follows the longest word.

Defined cases: null, empty and blank texts have no ids and decode to the empty
text; long texts are encoded whole; symbols that the vocabulary lacks are left
out, as the file has no unknown token; repeated rows are encoded each; ties of
rank go to the first place; empty table: empty result.
"""

from __future__ import annotations

import gc
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import read_table, sealed, unsealed

RUN = 1 << 20
KEEP = 160 << 20
KEPT_WORD = 64        # characters of a stretch that is kept
# fixed values: the white space of the vocabulary's patterns (Unicode White_Space)
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_END = "</w>"
_CONTROLS = regex.compile("[" + "".join(map(chr, range(0x1C, 0x20))) + "]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it has one, else the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Strings, merges and patterns of a tokenizer file of the kind described above."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"], model["end_of_word_suffix"], steps) != ("BPE", _END, ["NFC", "Replace", "Lowercase"]) \
                or model["unk_token"] or model["byte_fallback"] or spec["decoder"] or not split["invert"] or level["use_regex"]:
            raise ValueError(f"{path}: not a lower-casing byte vocabulary with word ends")
        self.ids: dict[str, int] = model["vocab"]
        self.ranks: dict[int, int] = {}  # by pair of ids
        self.made: list[int] = []        # by rank
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.ids[a] << 20 | self.ids[b]] = rank
            self.made.append(self.ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        texts = {**{i: s for s, i in self.ids.items()}, **{i: s for s, i in self.special.items()}}
        self.texts = [texts.get(i, "") for i in range(max(texts) + 1)]
        pattern = split["pattern"]["Regex"].replace(r"\s", BLANKS)
        self.words = regex.compile(pattern)
        self.blanks = regex.compile(f"[{BLANKS}]+")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        alphabet = byte_alphabet()
        self.inside = [self.ids.get(c, -1) for c in alphabet]
        self.last = [self.ids.get(c + _END, -1) for c in alphabet]

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [i for i in [*map(self.inside.__getitem__, raw[:-1]), self.last[raw[-1]]] if i >= 0]
        n, rank_of, made = len(symbols), self.ranks.get, self.made
        queue = []  # rank, then place, in one number
        for at in range(n - 1):
            rank = rank_of(symbols[at] << 20 | symbols[at + 1])
            if rank is not None:
                queue.append(rank << 32 | at)
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while queue:
            entry = heapq.heappop(queue)
            rank, at = entry >> 32, entry & 0xFFFFFFFF
            right = after[at]
            if right < 0 or symbols[at] < 0 or rank_of(symbols[at] << 20 | symbols[right]) != rank:
                continue  # swallowed, now the last, or changed since
            symbols[at], symbols[right] = made[rank], -1
            nxt, prev = after[right], before[at]
            after[at] = nxt
            if nxt >= 0:
                before[nxt] = at
                rank = rank_of(symbols[at] << 20 | symbols[nxt])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | at)
            if prev >= 0:
                rank = rank_of(symbols[prev] << 20 | symbols[at])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | prev)
        return [i for i in symbols if i >= 0]


class Encoder(dict):
    """Ids of stretches without white space as little-endian bytes, those of short ones kept."""

    def __init__(self, vocabulary: Vocabulary, keep: int = KEEP):
        super().__init__()
        self.vocabulary, self.room, self.keep = vocabulary, keep, keep

    def __missing__(self, stretch: str) -> bytes:
        words = self.vocabulary.words.findall(stretch)
        if len(words) == 1:
            ids = array("I", self.vocabulary.merge(words[0])).tobytes()
        else:
            ids = b"".join([self[w] if w != stretch else b"" for w in words])
        if len(stretch) <= KEPT_WORD:
            self.room -= 250 + 2 * len(stretch) + len(ids)
            if self.room < 0:
                self.clear()
                self.room = self.keep
            self[stretch] = ids
        return ids

    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("\u03a3", "\u03c3")  # capital sigma, character by character: no final form
        return text.lower()

    def _stretches(self, text: str) -> Iterator[list[str]]:
        # Python's white space is the vocabulary's and four control characters
        split = self.vocabulary.blanks.split if _CONTROLS.search(text) else str.split
        at = 0
        while len(text) - at > RUN:
            stop = text.find(" ", at + RUN)
            if stop < 0:
                break
            yield split(text[at:stop])
            at = stop
        yield split(text[at:] if at else text)

    def encode(self, text: str) -> bytes:
        v, out = self.vocabulary, []
        for piece in v.cut.split(text) if v.cut else [text]:
            if piece in v.special:
                out.append(array("I", [v.special[piece]]).tobytes())
                continue
            for stretches in self._stretches(self._normal(piece)):
                out.append(b"".join(map(self.__getitem__, stretches)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.vocabulary.texts.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    gc.set_threshold(200_000, 50, 100)  # what is kept are many long-lived objects
    return Encoder(Vocabulary(path))


def _encode_udf(path: str):
    @F.pandas_udf("binary")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([*map(encoder(path).encode, texts)], index=texts.index, dtype=object)

    return udf


def _decode_udf(path: str):
    @F.pandas_udf("string")
    def udf(ids: pd.Series) -> pd.Series:
        return pd.Series([*map(encoder(path).decode, ids)], index=ids.index, dtype=object)

    return udf


def _round_udf(path: str):
    @F.pandas_udf("ids binary, decoded string")
    def udf(texts: pd.Series) -> pd.DataFrame:
        ids = [*map(encoder(path).encode, texts)]
        return pd.DataFrame({"ids": ids, "decoded": [*map(encoder(path).decode, ids)]}, index=texts.index)

    return udf


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` and, as its last column ``out``, the ids of each whole text as little-endian unsigned 32-bit integers.

    A column that already has this name is replaced.
    """
    inner, at = sealed(docs)
    found = inner.withColumn("ids", _encode_udf(path)(F.coalesce(F.col(at[text]).cast("string"), F.lit(""))))
    return found.select(*unsealed({c: v for c, v in at.items() if c != out}), F.col("ids").alias(out))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` and, as its last column ``out``, the text that the ids decode to, special strings included (null ids: empty)."""
    inner, at = sealed(encoded)
    found = inner.withColumn("decoded", _decode_udf(path)(F.coalesce(F.col(at[ids]), F.lit(b""))))
    return found.select(*unsealed({c: v for c, v in at.items() if c != out}), F.col("decoded").alias(out))


def encode_and_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` and its last columns ``ids`` and ``decoded``, as by ``encode`` and ``decode``, with one worker's vocabulary for both."""
    inner, at = sealed(docs)
    found = inner.withColumn("both", _round_udf(path)(F.coalesce(F.col(at[text]).cast("string"), F.lit(""))))
    own = {c: v for c, v in at.items() if c not in ("ids", "decoded")}
    return found.select(*unsealed(own), "both.ids", "both.decoded")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_bpe_codec(spark, sf_dir, path: str | None = None) -> DataFrame:
    path = path or vocabulary_path()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode_and_decode(docs, path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
