"""Mixing sources to target weights by pivotal dependent rounding (operator 8).

A source's target over its size is the expected number of copies of each of
its documents; the whole part is taken outright, the fraction is decided by
the pivotal method: two documents with fractional probabilities trade expected
words until one of them is certain (0 or 1), at random so that no document's
probability changes in expectation, and the other goes on to meet the next.
The words expected from a pair never change, so the words taken miss the
target by less than one document per source.

The trades run in chunks of a source (documents dealt by hash, so a source
with a third of all rows is many chunks); each leaves one fractional document
at most, and these residuals meet in the next level of a reduction tree, until
one is left per source, which is taken with the probability it has left.
Random numbers are hashes of the document and of its number among equal rows,
so reruns agree and rows repeated over a third of the table fall into many
chunks.

Defined cases: null or blank text has size 0 and takes nothing; long texts are
counted whole; ties between sources cannot occur, ties between documents in
size are traded in the order of their hashes; null is a
source of its own that ranks last; a source of size 0 has target 0; repeated
rows are decided one by one (which of equal rows is taken makes no
difference); empty table: empty result; a null doc_id is an id like others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import SPACE, numbered, read_table, sealed, unsealed
from glossa.plans.ranking import dense_index
from glossa.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
CHUNK = 4_096
SEED = 8


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """t_source, source_size, t_docs, target: one row per source; only sums reach the driver."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("t_docs"))
    ranked = dense_index(sources, [F.col("source").isNull().alias("last"), F.col("source")], "t_rank")
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("t_rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = cut_lineage(ranked.withColumn("cap", (max_copies * F.col("source_size")).cast("double")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rate, full = 0.0, -1
    while True:
        above = F.col("w") * F.lit(rate) > F.col("cap")
        got = ranked.agg(F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("capped"),
                         F.sum(F.when(above, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if got["n"] == full or not got["open"]:
            break
        full, rate = got["n"], max(0.0, share * total - got["capped"]) / got["open"]
    return ranked.select(F.col("source").alias("t_source"), "source_size", "t_docs", F.least("cap", F.col("w") * F.lit(rate)).alias("target"))


def pivot(size: np.ndarray, part: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Probabilities after pairwise trades in the given order: all 0 or 1, but for one at most."""
    p = part.tolist()
    s = size.tolist()
    u = chance.tolist()
    carry = -1
    for k in range(len(p)):
        if not 0.0 < p[k] < 1.0:
            continue
        if carry < 0:
            carry = k
            continue
        a, b, sa, sb = p[carry], p[k], s[carry], s[k]
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)  # words moved to, or from, the carried one
        if u[k] * (up + down) < down:
            a_done, b_done = (1 - a) * sa <= b * sb, b * sb <= (1 - a) * sa
            p[carry], p[k] = (1.0 if a_done else a + up / sa), (0.0 if b_done else b - up / sb)
        else:
            a_done, b_done = a * sa <= (1 - b) * sb, (1 - b) * sb <= a * sa
            p[carry], p[k] = (0.0 if a_done else a - down / sa), (1.0 if b_done else b + down / sb)
        a_open, b_open = 0.0 < p[carry] < 1.0, 0.0 < p[k] < 1.0
        carry = carry if a_open else k if b_open else -1
    return np.array(p)


def _trade(pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk: large documents first, so that what stays open at the end is small."""
    pdf = pdf.sort_values(["size", "hash", "id", "no_id", "nr"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    pdf["part"] = pivot(pdf["size"].to_numpy(), pdf["part"].to_numpy(), (pdf["luck"].to_numpy(dtype=np.int64) & ((1 << 53) - 1)) / (1 << 53))
    return pdf.drop(columns="chunk")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, hash (of the text), size, source_size, target and copies, one row per row of ``docs``."""
    size = F.coalesce(F.regexp_count("text", F.lit("[^" + SPACE[1:] + "+")), F.lit(0)).cast("long")
    sized = cut_lineage(numbered(docs.select("doc_id", "source", F.xxhash64("text").alias("hash"), size.alias("size"))))
    goal = targets(sized, weights, share, max_copies)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(goal, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("each", each)
    rows = rows.withColumn("whole", F.floor("each").cast("int"))
    rows = rows.withColumn("part", F.when(F.col("size") > 0, F.col("each") - F.col("whole")).otherwise(0.0))
    # a null among integers would turn the column into floating point in pandas
    rows = rows.withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))}).drop("each", "doc_id")
    most = goal.agg(F.max("t_docs")).first()[0] or 0
    schema = rows.withColumn("luck", F.lit(0).cast("long")).schema
    is_open = (F.col("part") > 0) & (F.col("part") < 1)
    settled, level, per = [], 0, 1
    while most > 1:
        most, per = -(-most // chunk), per * chunk
        dealt = rows.withColumn("luck", F.xxhash64("id", "no_id", "hash", "nr", F.lit(SEED + level)))
        n = F.ceil(F.col("t_docs") / per)
        part = dealt.withColumn("chunk", F.pmod(F.xxhash64("luck", F.lit("chunk")), n))
        traded = cut_lineage(part.groupBy("source", "chunk").applyInPandas(_trade, schema)).drop("luck")
        settled.append(traded.filter(~is_open))
        rows, level = traded.filter(is_open), level + 1
    out = rows
    for s in settled:
        out = out.unionByName(s)
    chance = F.pmod(F.xxhash64("id", "no_id", "hash", "nr", F.lit("last")), F.lit(1 << 53)) / (1 << 53)  # for the last one of a source
    return out.withColumns({
        "doc_id": F.when(~F.col("no_id"), F.col("id")),
        "copies": (F.col("whole") + (chance < F.col("part")).cast("int")).cast("long"),
    }).drop("t_docs", "whole", "part", "id", "no_id", "nr")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, all columns kept."""
    of = lambda d, s, h: F.xxhash64(d, F.coalesce(s, F.lit("null")), s.isNull(), h)
    plan = mix(docs.select("doc_id", "source", "text"), **options).select(
        of(F.col("doc_id"), F.col("source"), F.col("hash")).alias("m_key"), "copies")
    plan = plan.withColumn("m_nth", F.row_number().over(Window.partitionBy("m_key").orderBy("copies"))).filter("copies > 0")
    left, at = sealed(docs)
    left = left.withColumn("key", of(F.col(at["doc_id"]), F.col(at["source"]), F.xxhash64(at["text"])))
    # rows that agree in doc_id, source and text are told apart by their place among them
    left = left.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    out = left.join(plan, (F.col("key") == F.col("m_key")) & (F.col("nth") == F.col("m_nth")))
    return out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*unsealed(at))


def op8_pivotal_mix(spark, sf_dir) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")
