"""Language ID with bit-sliced Bloom filters (operator 4).

Every language has a Bloom filter of its n-grams; the filters are stored bit
by bit next to each other: slot i is a mask with one bit per language.  The
masks of an n-gram's slots, ANDed, are all languages that contain it at once.
Summed over a text's n-grams, that is one hit count per language; a filter
with false-positive rate f turns h true hits of n into h + f (n - h), which is
inverted.  N-grams weigh by how few languages share them (an n-gram that every
language holds says nothing).  The language with most corrected hits wins.

The filters are fitted on a bounded sample of labelled rows: about
``FIT_ROWS`` per language, chosen by a hash of doc_id among those allowed for
training.  A language holds an n-gram if at least ``MIN_DOCS`` of its sampled
documents do and its share of documents is no less than ``KEEP`` times the
largest share of any language.  At most ``MAX_GRAMS`` per language, the most
frequent, enter the filters (documented bound of what the driver holds).

Defined cases: null text or no letter: ``und`` with score 0, whatever the
filters say; no training row at all: ``und`` everywhere; ties go to the
language that sorts first; repeated rows get equal results; more than 64
languages take several masks; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import ngrams
from glossa.llm.common import read_table
from glossa.session import cut_lineage

FIT_ROWS = 4_000
MIN_DOCS = 3
KEEP = 0.15
MAX_GRAMS = 50_000
SLOT_BITS = 20
PROBES = 2
MAX_LANGS = 10_000    # counts sent to every task


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def language_counts(docs: DataFrame) -> DataFrame:
    """c_lang, n: documents that may be learnt from, per language."""
    return cut_lineage(learnable(docs).groupBy(F.col("lang").alias("c_lang")).agg(F.count("*").alias("n")))


def training_sample(docs: DataFrame, rows: int = FIT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """text, lang of about ``rows`` documents per language among those that are not held out.

    Equal rows (doc_id and text) are one, so a row repeated over much of the
    table does not pass the bound.  Counts of up to ``MAX_LANGS`` languages
    are sent to the texts, which then stay where they are.
    """
    counts = language_counts(docs) if counts is None else counts
    few = counts.limit(MAX_LANGS + 1).count() <= MAX_LANGS
    key = F.xxhash64("doc_id", "text", F.lit("language"))
    luck = F.pmod(key, F.lit(1 << 30)) / (1 << 30)
    chosen = learnable(docs).join(F.broadcast(counts) if few else counts, F.col("lang") == F.col("c_lang")).filter(luck * F.col("n") < rows)
    return chosen.select("text", "lang", "doc_id").dropDuplicates(["doc_id", "lang", "text"]).select("text", "lang")


def gram_shares(sample: DataFrame) -> DataFrame:
    """lang, gram, docs, share: in how many of a language's sampled documents each n-gram is."""
    def grams(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for lang, part in pdf.groupby("lang", sort=False):
                for k in range(0, len(part), 256):
                    found = []
                    for t in part["text"].iloc[k:k + 256]:
                        each = [np.unique(h) for h in ngrams.hashes(t)]
                        if each:
                            found.append(np.unique(np.concatenate(each)))
                    if found:
                        g, n = np.unique(np.concatenate(found), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "gram": g.view(np.int64), "docs": n.astype(np.int64)})

    counted = sample.mapInPandas(grams, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    totals = sample.groupBy(F.col("lang").alias("t_lang")).agg(F.count("*").alias("n"))
    return counted.join(totals, F.col("lang") == F.col("t_lang")).select("lang", "gram", "docs", (F.col("docs") / F.col("n")).alias("share"))


def fit(docs: DataFrame, rows: int = FIT_ROWS, max_grams: int = MAX_GRAMS, slot_bits: int = SLOT_BITS) -> dict:
    """Languages, bit-sliced filters (masks x slots) and false-positive rates."""
    counts = language_counts(docs)
    shares = cut_lineage(gram_shares(cut_lineage(training_sample(docs, rows, counts))))
    best = shares.groupBy(F.col("gram").alias("b_gram")).agg(F.max("share").alias("best"))
    own = cut_lineage(shares.join(best, F.col("gram") == F.col("b_gram")).filter(
        (F.col("docs") >= MIN_DOCS) & (F.col("share") >= KEEP * F.col("best"))).select("lang", "gram", "docs"))
    langs = sorted(r[0] for r in shares.select("lang").distinct().collect())
    known = {r["c_lang"]: r["n"] for r in counts.filter(F.col("c_lang").isin(langs)).collect()}
    masks = np.zeros((max(1, -(-len(langs) // 64)), 1 << slot_bits), dtype=np.uint64)
    rates = np.zeros(len(langs))
    for i, lang in enumerate(langs):  # at most MAX_GRAMS hashes a language
        top = own.filter(F.col("lang") == lang).orderBy(F.desc("docs"), "gram").limit(max_grams).select("gram").toPandas()["gram"]
        grams = top.to_numpy(dtype=np.int64).view(np.uint64)
        bit = np.uint64(1) << np.uint64(i % 64)
        for s in slots(grams, slot_bits):
            masks[i // 64, s] |= bit
        rates[i] = ((masks[i // 64] & bit) > 0).mean() ** PROBES
    return {"langs": langs, "masks": masks, "rates": rates, "slot_bits": slot_bits,
            "prior": np.array([known[lang] for lang in langs], dtype=float) / max(1, sum(known.values()))}


def slots(h: np.ndarray, slot_bits: int) -> list[np.ndarray]:
    """The slots of each n-gram: disjoint bit fields of its hash."""
    keep = np.uint64((1 << slot_bits) - 1)
    return [((h >> np.uint64(slot_bits * p)) & keep).astype(np.int64) for p in range(PROBES)]


def classify(texts: list, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language or -1, score) of each text."""
    langs, masks, rates = model["langs"], model["masks"], model["rates"]
    n_langs = len(langs)
    # weighted: number of n-grams by (row, languages that hold it); a mask's popcount says how telling it is
    hits = np.zeros((len(texts), n_langs))
    total = np.zeros(len(texts))
    for h, row in ngrams.runs(texts):
        at = slots(h, model["slot_bits"])
        word = np.bitwise_and.reduce([masks[:, s] for s in at])
        held = np.bitwise_count(word).sum(axis=0)
        weight = np.where(held > 0, 1 - np.log(np.maximum(held, 1)) / np.log(max(n_langs, 2)), 0.0) + 0.02 * (held > 0)
        lo, hi = row[0], row[-1] + 1
        total[lo:hi] += np.bincount(row - lo, minlength=hi - lo)
        for i in range(n_langs):
            bit = (word[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[lo:hi, i] += np.bincount(row - lo, weights=weight * bit, minlength=hi - lo)
    true = np.maximum(hits - rates * total[:, None], 0) / np.maximum(1 - rates, 1e-9)
    told = true.sum(axis=1, keepdims=True) > 0
    true = np.where(told, true, model["prior"]) if n_langs else true  # a text without known n-grams: the commonest language
    best = np.argmax(true, axis=1) if n_langs else np.zeros(len(texts), dtype=int)
    has_letter = np.array([any(map(str.isalpha, t)) if t else False for t in texts], dtype=bool)
    if not n_langs:
        return np.full(len(texts), -1), np.zeros(len(texts))
    top = true[np.arange(len(texts)), best]
    score = np.where(true.sum(axis=1) > 0, top / np.maximum(true.sum(axis=1), 1e-12), 1 / n_langs)
    return np.where(has_letter, best, -1), np.where(has_letter, score, 0.0)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` plus ``_g_pred`` (lang, score); only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # masks: 8 MB for each 64 languages

    @F.pandas_udf("lang string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        lang, score = [], []
        for k in range(0, len(texts), 1_024):
            found, s = classify([t if isinstance(t, str) else None for t in texts.iloc[k:k + 1_024]], m)
            lang += [m["langs"][i] if i >= 0 else "und" for i in found]
            score += s.tolist()
        return pd.DataFrame({"lang": pd.Series(lang, dtype=object), "score": pd.Series(score, dtype=float)})

    return docs.withColumn("_g_pred", judge("text"))


def op4_language_id(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_g_pred.lang").alias("lang_pred"),
                      F.col("_g_pred.score").alias("score"))
