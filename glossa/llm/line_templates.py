"""Line dedup by a log-template tree (operator 2).

Every line goes down a tree of fixed depth: its token count, then its first
``DEPTH`` tokens (tokens with a digit count as the wildcard).  Lines that meet
in a leaf share a template: at each position the token that more than half of
the leaf's lines hold, else the wildcard, so numbers, names and edited words
become variable fields.  A line belongs to its leaf's template if at least
``SIMILARITY`` of its positions agree with the template's tokens.  The wordings
that do not form further templates of the leaf: of wordings that hold the same
tokens in a band of positions the most frequent one is a seed; seeds are taken
as templates by falling frequency, and each wording joins the first one that
it agrees with itself in ``SIMILARITY`` of all positions.  Nothing is joined
through a third wording, so every member of a template agrees with the seed.
Any other line is a template of its own.  A template found in two documents
or more is dropped, but for its first occurrence (smallest doc_id, then line),
so that no content leaves the corpus altogether.

Only hashes of lines are shuffled to find leaves and templates; token hashes
are fetched for one line of each distinct wording in leaves that hold several,
and a bit filter of these lines spares all others the second tokenising.
The texts themselves are shuffled once, to take the lines out.

Defined cases: null text stays null and has no lines; lines without a token
are never judged and stay; repeated rows (same doc_id and text) count as one
document and are treated alike; a null doc_id is an id of its own that sorts
first; empty table: empty result; all further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import let, read_table, sealed, unsealed
from glossa.operators.membership import bit_filter, maybe_members
from glossa.session import cut_lineage, land

DEPTH = 3
SIMILARITY = 0.8
WILD = "<*>"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text hash and text: the key of a document needs no unique doc_id."""
    return docs.select(F.col("doc_id").alias("_l_id"), F.xxhash64("text").alias("_l_hash"), F.col("text").alias("_l_text"))


def _tokens(line: Column) -> Column:
    masked = F.when(line.rlike(r"\d"), F.regexp_replace(line, r"[^ ]*\d[^ ]*", WILD))
    return F.array_remove(F.split(F.coalesce(masked, line), " "), "")


def _lines(keyed: DataFrame) -> DataFrame:
    """One row per line, all white space in it made spaces: splitting at one character needs no pattern."""
    text = F.col("_l_text")
    spaced = F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text)
    return keyed.select("_l_id", "_l_hash", F.posexplode(F.split(spaced, "\n")).alias("_l_no", "_l_line"))


def _tokenised(lines: DataFrame) -> DataFrame:
    """Lines with a token: key, line number, masked tokens."""
    lines = lines.withColumn("_l_tokens", _tokens(F.col("_l_line")))
    return lines.filter(F.size("_l_tokens") > 0)


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), *[F.get(tokens, F.lit(i)) for i in range(DEPTH)])


def line_leaves(keyed: DataFrame) -> DataFrame:
    """Narrow rows: document key, line number, leaf and hash of the masked wording."""
    t = F.col("_l_tokens")
    return _tokenised(_lines(keyed)).select("_l_id", "_l_hash", "_l_no", _leaf(t).alias("_l_leaf"),
                                   F.xxhash64(t).alias("_l_exact"))


def leaf_members(keyed: DataFrame, leaves: DataFrame) -> DataFrame:
    """For wordings that share a template: m_leaf, m_exact, m_template."""
    wordings = leaves.groupBy("_l_leaf", "_l_exact").agg(
        F.count("*").alias("_l_times"), F.min(F.struct("_l_id", "_l_hash", "_l_no")).alias("_l_at"))
    several = wordings.groupBy("_l_leaf").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("_l_leaf").alias("_l_busy"))
    chosen = wordings.join(several, F.col("_l_leaf") == F.col("_l_busy"), "left_semi").select(
        "_l_leaf", "_l_exact", "_l_times", F.col("_l_at._l_id").alias("c_id"), F.col("_l_at._l_hash").alias("c_hash"),
        F.col("_l_at._l_no").alias("c_no"))
    chosen = land(chosen)
    at = lambda *names: F.struct(*[F.col(n) for n in names])
    lines = maybe_members(_lines(keyed), at("_l_id", "_l_hash", "_l_no"), bit_filter(chosen, at("c_id", "c_hash", "c_no")))
    texts = _tokenised(lines).select("_l_id", "_l_hash", "_l_no", F.transform("_l_tokens", lambda t: F.xxhash64(t)).alias("_l_t"))
    # repeated rows give the same line twice; one suffices
    found = texts.join(chosen, F.col("_l_id").eqNullSafe(F.col("c_id")) & (F.col("_l_hash") == F.col("c_hash"))
                       & (F.col("_l_no") == F.col("c_no"))).groupBy("_l_leaf", "_l_exact").agg(
        F.first("_l_times").alias("_l_times"), F.first("_l_t").alias("_l_t"))
    found = land(found)
    support = found.select("_l_leaf", "_l_times", F.posexplode("_l_t").alias("pos", "tok")).groupBy("_l_leaf", "pos", "tok").agg(
        F.sum("_l_times").alias("n"))
    fields = support.groupBy("_l_leaf", "pos").agg(F.max(F.struct("n", "tok")).alias("top"), F.sum("n").alias("all"))
    fixed = F.when(2 * F.col("top.n") > F.col("all"), F.col("top.tok"))
    template = fields.groupBy(F.col("_l_leaf").alias("t_leaf")).agg(
        F.array_sort(F.collect_list(F.struct("pos", fixed.alias("tok")))).alias("t_fields"))
    both = found.join(template, F.col("_l_leaf") == F.col("t_leaf"))
    agree = _agreeing(F.col("_l_t"), F.transform("t_fields", lambda f: f["tok"]))
    judged = both.select("_l_leaf", "_l_exact", "_l_times", "_l_t", (agree >= SIMILARITY * F.size("_l_t")).alias("_l_member"))
    judged = land(judged)
    further = joined_seeds(judged).select(F.col("_l_leaf").alias("j_leaf"), F.col("_l_exact").alias("j_exact"), "seed")
    named = F.when(F.col("_l_member"), F.col("_l_leaf")).otherwise(F.xxhash64("_l_leaf", "seed"))
    placed = judged.join(further, (F.col("_l_leaf") == F.col("j_leaf")) & (F.col("_l_exact") == F.col("j_exact")), "left")
    return placed.filter(F.col("_l_member") | F.col("seed").isNotNull()).select(
        F.col("_l_leaf").alias("m_leaf"), F.col("_l_exact").alias("m_exact"), named.alias("m_template"))


def _agreeing(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _bands(t: Column) -> Column:
    """Hashes of groups of positions; two wordings that agree in ``SIMILARITY`` of all positions share one at least.

    There is one group more than positions may differ, so one holds no
    difference; neighbouring groups taken together stand beside the single ones.
    """
    n = F.size(t)
    count = (n - F.ceil(SIMILARITY * n) + 1).cast("int")
    band = lambda b: F.filter(t, lambda x, i: (i >= DEPTH) & ((i - DEPTH) % count == b))
    single = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.xxhash64(b, band(b)))
    return let(single, lambda s: F.concat(s, F.transform(s, lambda x, i: F.xxhash64(x, F.get(s, (i + 1) % count), F.lit("two")))))


def seed_pairs(judged: DataFrame) -> DataFrame:
    """(_l_leaf, _l_exact, seed, rank): wordings outside their leaf's template and the seeds they agree with; a seed agrees with itself.

    The seed of each group of wordings that hold the same tokens in a band is
    its most frequent one; a wording is compared with seeds, never with every other.
    """
    # fewer than five tokens agree in 0.8 only if equal
    pool = judged.filter((F.size("_l_t") >= 5) & ~F.col("_l_member"))
    banded = land(pool.select("_l_leaf", "_l_exact", "_l_times", F.explode(_bands(F.col("_l_t"))).alias("_l_band")))
    seeds = banded.groupBy(F.col("_l_leaf").alias("s_leaf"), F.col("_l_band").alias("s_band")).agg(
        F.max(F.struct("_l_times", "_l_exact")).alias("rank"), F.count("*").alias("s_n")).filter("s_n > 1")
    pairs = banded.join(seeds, (F.col("_l_leaf") == F.col("s_leaf")) & (F.col("_l_band") == F.col("s_band"))).select(
        F.col("_l_leaf").alias("p_leaf"), F.col("_l_exact").alias("p_exact"), "rank").distinct()
    side = lambda k: pool.select(*[F.col(f"_l_{c}").alias(f"{k}_{c}") for c in ("leaf", "exact", "t")])
    both = pairs.join(side("w"), (F.col("p_leaf") == F.col("w_leaf")) & (F.col("p_exact") == F.col("w_exact"))).join(
        side("z"), (F.col("p_leaf") == F.col("z_leaf")) & (F.col("rank._l_exact") == F.col("z_exact")))
    return both.filter(_agreeing(F.col("w_t"), F.col("z_t")) >= SIMILARITY * F.size("w_t")).select(
        F.col("p_leaf").alias("_l_leaf"), F.col("p_exact").alias("_l_exact"), F.col("rank._l_exact").alias("seed"), "rank")


def joined_seeds(judged: DataFrame) -> DataFrame:
    """(_l_leaf, _l_exact, seed): each wording's template among the seeds, taken by falling rank (frequency, then hash).

    A round takes every seed that no better open seed agrees with, lets all
    wordings that agree with it join the best such seed, and closes them; the
    best open seed of each leaf is always taken, so the rounds end.
    """
    open_pairs, out = land(seed_pairs(judged)), None
    while not open_pairs.isEmpty():
        best = open_pairs.groupBy("_l_leaf", "_l_exact").agg(F.max("rank").alias("best"))
        taken = land(best.filter(F.col("_l_exact") == F.col("best._l_exact")).select(F.col("_l_leaf").alias("t_leaf"), F.col("_l_exact").alias("t_exact")))
        fits = open_pairs.join(taken, (F.col("_l_leaf") == F.col("t_leaf")) & (F.col("seed") == F.col("t_exact")), "left_semi")
        joined = land(fits.groupBy("_l_leaf", "_l_exact").agg(F.max("rank").alias("to")).select("_l_leaf", "_l_exact", F.col("to._l_exact").alias("seed")))
        out = joined if out is None else out.unionByName(joined)
        closed = joined.select(F.col("_l_leaf").alias("c_leaf"), F.col("_l_exact").alias("c_exact"))
        rest = open_pairs.join(closed, (F.col("_l_leaf") == F.col("c_leaf")) & (F.col("_l_exact") == F.col("c_exact")), "left_anti")
        rest = rest.join(closed, (F.col("_l_leaf") == F.col("c_leaf")) & (F.col("seed") == F.col("c_exact")), "left_anti")
        open_pairs = land(rest)
    return out if out is not None else open_pairs.select("_l_leaf", "_l_exact", "seed")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """_d_id, _d_hash and the array _d_lines of line numbers to drop, one row per document with any."""
    keyed = _keyed(docs)
    leaves = cut_lineage(line_leaves(keyed))
    members = leaf_members(keyed, leaves)
    named = leaves.join(members, (F.col("_l_leaf") == F.col("m_leaf")) & (F.col("_l_exact") == F.col("m_exact")), "left").select(
        "_l_id", "_l_hash", "_l_no", F.coalesce("m_template", F.xxhash64("_l_leaf", "_l_exact")).alias("_l_template"))
    document = F.struct("_l_id", "_l_hash")
    recurring = named.groupBy(F.col("_l_template").alias("r_template")).agg(
        F.min(F.struct("_l_id", "_l_hash", F.col("_l_no").alias("no"))).alias("first"), F.min(document).alias("least"),
        F.max(document).alias("most")).filter(~F.col("least").eqNullSafe(F.col("most"))).select("r_template", "first")
    first = F.struct("_l_id", "_l_hash", F.col("_l_no").alias("no"))
    return named.join(recurring, F.col("_l_template") == F.col("r_template")).filter(~first.eqNullSafe(F.col("first"))).distinct().groupBy(
        F.col("_l_id").alias("_d_id"), F.col("_l_hash").alias("_d_hash")).agg(F.collect_list("_l_no").alias("_d_lines"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, plus ``_d_before`` and ``_d_dropped`` (line counts)."""
    gone = dropped_lines(docs)
    df, at = sealed(docs)
    text = F.col(at["text"])
    df = df.join(gone, F.col(at["doc_id"]).eqNullSafe(F.col("_d_id")) & (F.xxhash64(text) == F.col("_d_hash")), "left")
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_d_lines"))
    cut = let(F.split(text, "\n"), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))
    number = lambda c, otherwise: F.when(c, F.lit(0)).otherwise(otherwise).cast("long")
    df = df.withColumns({
        "_d_before": number(text.isNull(), F.size(F.split(text, "\n"))),
        "_d_dropped": number(F.col("_d_lines").isNull(), F.size("_d_lines")),
        at["text"]: F.when(F.col("_d_lines").isNull(), text).otherwise(cut),
    })
    return df.select(*unsealed(at), "_d_before", "_d_dropped")


def op2_line_templates(spark, sf_dir) -> DataFrame:
    out = drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_d_before").alias("n_lines"), F.col("_d_dropped").alias("n_dropped"))


_GAP = r"[\x20\x09-\x0D]"

ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, i AS no, ls[i] AS line FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
toks AS (
  SELECT rid, doc_id, no, list_filter(regexp_split_to_array(
    regexp_replace(line, '[^{_GAP[1:-1]}]*[0-9][^{_GAP[1:-1]}]*', '{WILD}', 'g'), '{_GAP}+'), lambda x: x <> '') AS w FROM lines),
keyed AS (
  SELECT rid, doc_id, no, w, concat_ws(chr(10), len(w), coalesce(w[1], ''), coalesce(w[2], ''), coalesce(w[3], '')) AS leaf,
    array_to_string(w, ' ') AS wording FROM toks WHERE len(w) > 0),
wordings AS (SELECT leaf, wording, count(*) AS times, any_value(w) AS w FROM keyed GROUP BY leaf, wording),
busy AS (SELECT * FROM wordings WHERE leaf IN (SELECT leaf FROM wordings GROUP BY leaf HAVING count(*) > 1)),
places AS (SELECT leaf, wording, times, len(w) AS n, generate_subscripts(w, 1) AS pos, unnest(w) AS tok FROM busy),
support AS (SELECT leaf, pos, tok, sum(times) AS n FROM places GROUP BY ALL),
fields AS (SELECT leaf, pos, CASE WHEN 2 * max(n) > sum(n) THEN max_by(tok, n) END AS tok FROM support GROUP BY leaf, pos),
members AS (
  SELECT p.leaf, p.wording FROM places p JOIN fields f ON p.leaf = f.leaf AND p.pos = f.pos
  GROUP BY p.leaf, p.wording HAVING count(*) FILTER (p.tok = f.tok) >= {SIMILARITY}::DOUBLE * any_value(p.n)),
named AS (
  SELECT k.rid, k.doc_id, k.no, CASE WHEN m.leaf IS NULL THEN 'w' || k.leaf || chr(10) || k.wording ELSE 'l' || k.leaf END AS template
  FROM keyed k LEFT JOIN members m ON k.leaf = m.leaf AND k.wording = m.wording),
recurring AS (
  SELECT template, min({{'doc_id': doc_id, 'no': no}}) AS first FROM named GROUP BY template HAVING count(DISTINCT rid) > 1),
gone AS (
  SELECT n.rid, n.no FROM named n JOIN recurring r ON n.template = r.template WHERE {{'doc_id': n.doc_id, 'no': n.no}} <> r.first),
kept AS (
  SELECT l.rid, string_agg(l.line, chr(10) ORDER BY l.no) AS text FROM lines l ANTI JOIN gone g ON l.rid = g.rid AND l.no = g.no GROUP BY l.rid),
counts AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  coalesce(len(t.ls), 0)::BIGINT AS n_lines, coalesce(counts.n, 0)::BIGINT AS n_dropped
FROM t LEFT JOIN kept ON kept.rid = t.rid LEFT JOIN counts ON counts.rid = t.rid
"""
