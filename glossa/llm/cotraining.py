"""Quality classifier by co-training (operator 6).

Two views of a document: its text (hashed character trigrams, as square roots
of their shares) and its page metadata (size, line layout, symbol and digit
shares, repetition, language, source).  Each view has a logistic classifier.
In every round each labels the documents of an unlabelled pool that it is
surest of and hands them to the other view as training rows.  At the end both
are calibrated on labelled rows that no round has seen, a logistic combination
of the calibrated views is fitted there, and every document is scored.

Fitting uses bounded samples, chosen by hash: about ``FIT_ROWS`` labelled and
``POOL_ROWS`` unlabelled documents (their features, 2 KB a row, are what the
driver holds); scoring runs over all documents in Arrow batches.

Defined cases: several labels of a doc_id are averaged (a tie counts as good),
null labels and labels of unknown documents are left out; null text is empty;
null language or source is a value of its own; with fewer than ``LEAST``
labelled rows of either class every document gets the share of good labels
(0.5 without any); repeated rows get equal scores; empty table: empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import read_table

FIT_ROWS = 5_000
POOL_ROWS = 5_000
ROUNDS = 4
PER_ROUND = 300       # pseudo-labels a view hands over in a round, at most
SURE = 0.95
CALIBRATION = 0.25    # share of the labelled sample kept for calibration
LEAST = 8
BUCKET_BITS = 10
RUN = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_TAGS = 16


# ----------------------------------------------------------------- features

def content(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of hashed trigrams, one row per text."""
    width = 1 << BUCKET_BITS
    out = np.zeros((len(texts), width), dtype=np.float32)
    for i, t in enumerate(texts):
        t = t.lower()
        for k in range(0, max(len(t) - 2, 0), RUN):
            c = np.frombuffer(t[k:k + RUN + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            h = ((c[:-2] * _P + c[1:-1]) * _P + c[2:]) * _P
            out[i] += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=width)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


def metadata(texts: list[str], langs: list, sources: list) -> np.ndarray:
    """Size, layout and origin of each document."""
    rows = []
    for t, lang, source in zip(texts, langs, sources):
        n = max(len(t), 1)
        lines, ws = t.split("\n"), t.split()
        count = lambda chars: sum(map(t.count, chars)) / n
        tags = [0.0] * _TAGS
        tags[zlib.crc32(f"lang {lang}".encode("utf-8", "surrogatepass")) % _TAGS] += 0.5
        tags[zlib.crc32(f"source {source}".encode("utf-8", "surrogatepass")) % _TAGS] += 0.5
        rows.append([
            np.log1p(len(t)), np.log1p(len(lines)), np.log1p(n / len(lines)), min(len(t) / max(len(ws), 1), 50.0),
            len(set(ws)) / max(len(ws), 1) * np.log1p(len(ws)), sum(map(str.__eq__, ws, ws[1:])) / max(len(ws), 1),
            np.sqrt(count("#*$%&|<>")), np.sqrt(count("0123456789")), np.sqrt(count(".,;:!?")),
            1 - len(set(lines)) / len(lines), *tags])
    return np.array(rows, dtype=np.float64).reshape(len(texts), 10 + _TAGS)


# -------------------------------------------------------------- classifiers

def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 160) -> np.ndarray:
    """Weights (last: intercept) of an L2-penalised logistic fit by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    share = weight / weight.sum()
    lipschitz = 0.25 * float(share @ np.einsum("ij,ij->i", x, x)) + l2
    share, y = share.astype(x.dtype), y.astype(x.dtype)
    w = v = np.zeros(x.shape[1], dtype=x.dtype)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        g = x.T @ (share * (p - y))
        g[:-1] += x.dtype.type(l2) * v[:-1]
        new = v - g * x.dtype.type(4 / lipschitz)  # the bound is loose: the trace stands for the largest eigenvalue
        w, v = new, new + x.dtype.type(k / (k + 3)) * (new - w)
    return w.astype(np.float64)


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


class View:
    """One view's classifier: standardised features, weights and Platt scaling."""

    def __init__(self, x: np.ndarray, l2: float):
        self.l2, self.mean, self.scale = l2, x.mean(axis=0), x.std(axis=0) + 1e-3
        self.platt = np.array([1.0, 0.0])
        self.w = np.zeros(x.shape[1] + 1)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).astype(np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        good = y.mean()
        self.w = logistic(self._scaled(x), y, np.where(y > 0, 0.5 / max(good, 1e-6), 0.5 / max(1 - good, 1e-6)), self.l2)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        z = logits(self._scaled(x), self.w)
        self.platt = logistic(z[:, None] / 4, y, np.ones(len(y)), 1e-4, 400) * [0.25, 1.0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(logits(self._scaled(x), self.w) * self.platt[0] + self.platt[1], -30, 30)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def cotrain(views: list[np.ndarray], y: np.ndarray, calibration: np.ndarray, pool: list[np.ndarray]) -> dict:
    """Fitted views and combination; ``views`` and ``pool``: feature matrices (text, metadata)."""
    train = ~calibration
    fitted = [View(np.vstack([v[train], p]) if len(p) else v[train], 1e-2) for v, p in zip(views, pool, strict=True)]
    extra_rows: list[list] = [[], []]
    extra_y: list[list] = [[], []]
    free = [np.ones(len(pool[0]), dtype=bool) for _ in range(2)]  # by the view that would get the row
    for r in range(ROUNDS + 1):
        for k, view in enumerate(fitted):
            rows = np.concatenate(extra_rows[k]).astype(int) if extra_rows[k] else np.zeros(0, int)
            view.fit(np.vstack([views[k][train], pool[k][rows]]), np.concatenate([y[train], *extra_y[k]]))
            view.calibrate(views[k][calibration], y[calibration])
        if r == ROUNDS or not any(f.any() for f in free):
            break
        share = y[train].mean()
        for k, view in enumerate(fitted):
            p = probability(view.score(pool[k]))
            for sign, part in ((1.0, share), (0.0, 1 - share)):
                sure = p if sign else 1 - p
                asked = np.flatnonzero(free[1 - k] & (sure >= SURE))
                asked = asked[np.argsort(-sure[asked], kind="stable")][: int(np.ceil(PER_ROUND * part))]
                free[1 - k][asked] = False
                extra_rows[1 - k].append(asked)
                extra_y[1 - k].append(np.full(len(asked), sign))
    z = np.stack([v.score(x[calibration]) for v, x in zip(fitted, views)], axis=1)
    return {"views": fitted, "mix": logistic(z / 4, y[calibration], np.ones(int(calibration.sum())), 1e-4, 400) * [0.25, 0.25, 1.0],
            "handed": [int(sum(map(len, e))) for e in extra_rows]}


# -------------------------------------------------------------------- Spark

def _luck(salt: str):
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / (1 << 30)


def _featured(df: DataFrame, keep: str) -> DataFrame:
    def make(batches):
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for k in range(0, len(texts), 512):
                part = slice(k, k + 512)
                x = content(texts[part]).astype(np.float16)
                m = metadata(texts[part], pdf["lang"].iloc[part], pdf["source"].iloc[part])
                rest = {c: pdf[c].iloc[part].to_numpy() for c in keep.split()[::2]} if keep else {}
                yield pd.DataFrame({**rest, "x": [r.tobytes() for r in x], "m": list(m)})

    return df.mapInPandas(make, (f"{keep}, " if keep else "") + "x binary, m array<double>")


def _bounded(docs: DataFrame, rows: int) -> DataFrame:
    """``docs`` without repeated (doc_id, text); about 2 * ``rows`` of them if a doc_id with many texts makes them more."""
    key = ["doc_id", F.xxhash64("text").alias("_k_text")]
    n = docs.select(*key).distinct().count()
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit("bounded")), F.lit(1 << 30)) / float(1 << 30)
    return docs.filter(share < 2 * rows / max(n, 1)).withColumn("_k_text", key[1]).dropDuplicates(["doc_id", "_k_text"]).drop("_k_text")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS) -> dict:
    """Model from bounded samples; ``docs``: doc_id, text, lang, source; ``labels``: doc_id, quality."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("double").alias("good"))
    totals = known.agg(F.count("*").alias("n"), F.avg("good").alias("share")).first()
    n_docs = docs.count()
    chosen = known.filter(_luck("labelled") < fit_rows / max(totals["n"], 1))  # about fit_rows pairs of numbers
    rows = _featured(_bounded(docs.join(F.broadcast(chosen), "doc_id"), fit_rows), "good double").toPandas()
    # the order of collected rows must not matter
    rows = rows.assign(h=[zlib.crc32(b) for b in rows["x"]]).sort_values(["h", "x"], kind="stable").reset_index(drop=True)
    y = rows["good"].to_numpy(dtype=float)
    calibration = (rows["h"].to_numpy() // 7 % 100) < 100 * CALIBRATION if len(rows) else np.zeros(0, bool)
    parts = [y[calibration], y[~calibration]]
    if min((min((p > 0).sum(), (p == 0).sum()) for p in parts), default=0) < LEAST:
        return {"share": 0.5 if totals["share"] is None else float(totals["share"])}
    pool = docs.filter(_luck("pool") < pool_rows / max(n_docs, 1)).join(F.broadcast(chosen), "doc_id", "left_anti")
    pool = _featured(_bounded(pool, pool_rows), "").toPandas()
    pool = pool.assign(h=[zlib.crc32(b) for b in pool["x"]]).sort_values(["h", "x"], kind="stable")
    matrix = lambda f: np.frombuffer(b"".join(f["x"]), dtype=np.float16).reshape(len(f), 1 << BUCKET_BITS).astype(np.float32)
    meta = lambda f: np.array(f["m"].tolist(), dtype=np.float64).reshape(len(f), 10 + _TAGS)
    return cotrain([matrix(rows), meta(rows)], y, calibration, [matrix(pool), meta(pool)])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` plus ``_k_score`` (text_score, meta_score, score): calibrated probabilities of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of two linear models

    @F.pandas_udf("text_score double, meta_score double, score double")
    def judge(texts: pd.Series, langs: pd.Series, sources: pd.Series) -> pd.DataFrame:
        m = shared.value
        if "share" in m:
            return pd.DataFrame({c: np.full(len(texts), m["share"]) for c in ("text_score", "meta_score", "score")})
        out = []
        for k in range(0, len(texts), 512):
            part = slice(k, k + 512)
            plain = [t if isinstance(t, str) else "" for t in texts.iloc[part]]
            z = np.stack([m["views"][0].score(content(plain)), m["views"][1].score(metadata(plain, langs.iloc[part], sources.iloc[part]))], axis=1)
            out.append(np.column_stack([probability(z), probability(logits(z, m["mix"]))]))
        return pd.DataFrame(np.vstack(out) if out else np.zeros((0, 3)), columns=["text_score", "meta_score", "score"])

    return docs.withColumn("_k_score", judge("text", "lang", "source"))


def op6_cotraining(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = score(docs, fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return out.select("doc_id", "_k_score.text_score", "_k_score.meta_score", "_k_score.score", (F.col("_k_score.score") >= 0.5).alias("kept"))
