"""Registered queries over the driver tables and their DuckDB statements.

Each query is ``(spark, sf_dir) -> DataFrame`` over whole tables; the SQL
next to it is the independent statement of the same result used as the
oracle.  Floating results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.operators import nb, split, vocab
from glossa.plans import sqltext as S
from glossa.session import cut_lineage, land
from glossa.sources.tables import labelled_documents, read_labelled_csv, spread, table, text_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ALPHA = 0.1
SEED = 42


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- shared plans

def docs_tokens(spark, sf) -> DataFrame:
    """docs with tokens (doc_id, label, tokens)."""
    return labelled_documents(spark, sf).select("doc_id", "label", tx.tokenize("text").alias("tokens"))


def docs_split(spark, sf) -> DataFrame:
    """E1 split of docs with tokens: (doc_id, label, tokens, split).

    The split ranks (doc_id, label) only (a doc_id-only document scan), so
    the range sampler never runs the tokeniser; the text is then joined to
    its split, tokenised once and materialised for every consumer
    (vocabularies, features, sequences).
    """
    assign = split.stratified_split(labelled_documents(spark, sf).select("doc_id", "label"), seed=SEED)
    text = text_table(spark, sf, "documents", "doc_id", "text")
    toks = text.join(assign, "doc_id").select("doc_id", "label", tx.tokenize("text").alias("tokens"), "split")
    return cut_lineage(toks)


def train_tokens(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = docs_split(spark, sf)
    return s, s.filter(F.col("split") == "train")


DOCS = S.DOCS_CTE
TOK = S.tokens_sql
SPLIT_ONLY = f"""{DOCS},
split AS (
  SELECT doc_id, label, text,
    CASE WHEN rk <= (n * 500000) // 1000000 THEN 'test'
         WHEN rk <= (n * 550000) // 1000000 THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT doc_id, label, text,
          row_number() OVER (PARTITION BY label ORDER BY md5('42|' || doc_id), doc_id) AS rk,
          count(*) OVER (PARTITION BY label) AS n FROM docs))"""
SPLIT_CTE = f"""{SPLIT_ONLY},
stok AS (SELECT doc_id, label, split, {TOK('text')} AS t FROM split)"""


# ---------------------------------------------------------------- text

@register("html_tokens", f"""
SELECT page_id, {TOK('html')} AS tokens FROM pages
""")
def q_html_tokens(spark, sf):
    return text_table(spark, sf, "pages", "page_id", "html").select("page_id", tx.tokenize("html").alias("tokens"))


@register("doc_tokens", f"""
SELECT doc_id, t AS tokens, CAST(len(t) AS INTEGER) AS n_tokens
FROM (SELECT doc_id, {TOK('text')} AS t FROM documents)
""")
def q_doc_tokens(spark, sf):
    t = text_table(spark, sf, "documents", "doc_id", "text").select("doc_id", tx.tokenize("text").alias("tokens"))
    return t.select("doc_id", "tokens", F.size("tokens").alias("n_tokens"))


@register("doc_bigrams", f"""
SELECT doc_id, {S.bigrams_sql('t')} AS bigrams
FROM (SELECT doc_id, {TOK('text')} AS t FROM documents)
""")
def q_doc_bigrams(spark, sf):
    t = text_table(spark, sf, "documents", "doc_id", "text").select("doc_id", tx.tokenize("text").alias("tokens"))
    return t.select("doc_id", tx.bigrams("tokens").alias("bigrams"))


@register("doc_features", f"""
SELECT doc_id, list_sort(list_distinct(list_concat(t, {S.bigrams_sql('t')}))) AS features
FROM (SELECT doc_id, {TOK('text')} AS t FROM documents)
""")
def q_doc_features(spark, sf):
    t = text_table(spark, sf, "documents", "doc_id", "text").select("doc_id", tx.tokenize("text").alias("tokens"))
    return t.select("doc_id", F.array_sort(tx.feature_set("tokens")).alias("features"))


@register("validate_labels", """
SELECT count(*) AS rows,
       CAST(count(*) FILTER (WHERE d.text IS NULL OR l.quality IS NULL) AS BIGINT) AS missing,
       CAST(count(*) FILTER (WHERE l.quality IS NOT NULL AND l.quality NOT IN (0, 1)) AS BIGINT) AS bad_label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def q_validate_labels(spark, sf):
    from glossa.sources.tables import label_problems
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return label_problems(docs.join(labels, "doc_id", "left"))


# ---------------------------------------------------------------- split

@register("stratified_split", f"""
WITH {SPLIT_ONLY}
SELECT doc_id, label, split FROM split
""")
def q_stratified_split(spark, sf):
    return split.stratified_split(labelled_documents(spark, sf).select("doc_id", "label"), seed=SEED)


@register("holdout_split", f"""
WITH {DOCS}
SELECT doc_id, label,
  CASE WHEN rk <= (n * 100000 + 999999) // 1000000 THEN 'validation' ELSE 'train' END AS split
FROM (SELECT doc_id, label,
        row_number() OVER (PARTITION BY label ORDER BY md5('42|' || doc_id), doc_id) AS rk,
        count(*) OVER (PARTITION BY label) AS n FROM docs)
""")
def q_holdout_split(spark, sf):
    return split.holdout_split(labelled_documents(spark, sf).select("doc_id", "label"), 0.1, seed=SEED)


@register("split_counts", f"""
WITH {SPLIT_ONLY}
SELECT split, label, count(*) AS samples FROM split GROUP BY split, label
""")
def q_split_counts(spark, sf):
    return split.split_counts(q_stratified_split(spark, sf))


@register("seeded_shuffle", f"""
WITH {DOCS}
SELECT doc_id, row_number() OVER (ORDER BY md5('42|0|' || doc_id), doc_id) - 1 AS shuffle_pos FROM docs
""")
def q_seeded_shuffle(spark, sf):
    return split.seeded_shuffle(labelled_documents(spark, sf).select("doc_id"), seed=SEED, epoch=0)


# ---------------------------------------------------------------- vocabularies

NB_VOCAB_SQL = f"""{SPLIT_CTE},
f AS (SELECT DISTINCT unnest(list_concat(t, {S.bigrams_sql('t')})) AS feature FROM stok WHERE split = 'train'),
vocab AS (
  SELECT row_number() OVER (ORDER BY CASE WHEN feature LIKE '% %' THEN 1 ELSE 0 END, feature) - 1 AS feature_id,
         CASE WHEN feature LIKE '% %' THEN 'bigram' ELSE 'unigram' END AS kind,
         split_part(feature, ' ', 1) AS w1,
         CASE WHEN feature LIKE '% %' THEN split_part(feature, ' ', 2) END AS w2,
         feature
  FROM f)"""

SEQ_VOCAB_SQL = f"""{SPLIT_CTE},
w AS (SELECT DISTINCT unnest(t) AS token FROM stok WHERE split = 'train'),
svocab AS (
  SELECT * FROM (VALUES (0, '[PAD]'), (1, '[UNK]'), (2, '[BOS]'), (3, '[EOS]')) r(token_id, token)
  UNION ALL
  SELECT row_number() OVER (ORDER BY token) + 3 AS token_id, token FROM w
  WHERE token NOT IN ('[PAD]', '[UNK]', '[BOS]', '[EOS]'))"""


@register("nb_vocabulary", f"""
WITH {NB_VOCAB_SQL}
SELECT CAST(feature_id AS BIGINT) AS feature_id, kind, w1, w2 FROM vocab
""")
def q_nb_vocabulary(spark, sf):
    _, train = train_tokens(spark, sf)
    return vocab.nb_vocabulary(train).drop("feature")


@register("seq_vocabulary", f"""
WITH {SEQ_VOCAB_SQL}
SELECT CAST(token_id AS BIGINT) AS token_id, token FROM svocab
""")
def q_seq_vocabulary(spark, sf):
    _, train = train_tokens(spark, sf)
    return vocab.seq_vocabulary(train)


@register("vocab_sizes", f"""
WITH {NB_VOCAB_SQL}
SELECT count(*) FILTER (WHERE kind = 'unigram') AS unigram_features,
       count(*) FILTER (WHERE kind = 'bigram') AS bigram_features,
       count(*) AS total_features FROM vocab
""")
def q_vocab_sizes(spark, sf):
    _, train = train_tokens(spark, sf)
    return vocab.vocab_sizes(vocab.nb_vocabulary(train))


@register("feature_ids", f"""
WITH {NB_VOCAB_SQL},
occ AS (SELECT DISTINCT doc_id, unnest(list_concat(t, {S.bigrams_sql('t')})) AS feature FROM stok),
ids AS (SELECT o.doc_id, list_sort(list(v.feature_id)) AS fids FROM occ o JOIN vocab v ON o.feature = v.feature GROUP BY o.doc_id)
SELECT s.doc_id, s.split, coalesce(CAST(ids.fids AS BIGINT[]), CAST([] AS BIGINT[])) AS feature_ids
FROM stok s LEFT JOIN ids ON s.doc_id = ids.doc_id
""")
def q_feature_ids(spark, sf):
    s, train = train_tokens(spark, sf)
    v = vocab.nb_vocabulary(train)
    featured = s.withColumn("features", tx.feature_set("tokens"))
    return vocab.feature_ids(featured, v, keep_cols=("split",))


CONV_TOK = f"SELECT conv_id, turn, {TOK('text')} AS t FROM conversations"


@register("token_ids", f"""
WITH {SEQ_VOCAB_SQL},
ct AS ({CONV_TOK}),
occ AS (SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM ct),
ids AS (SELECT o.conv_id, o.turn, list(CAST(coalesce(v.token_id, 1) AS BIGINT) ORDER BY o.pos) AS tids
        FROM occ o LEFT JOIN svocab v ON o.token = v.token GROUP BY o.conv_id, o.turn)
SELECT ct.conv_id, ct.turn, coalesce(ids.tids, CAST([] AS BIGINT[])) AS token_ids
FROM ct LEFT JOIN ids ON ct.conv_id = ids.conv_id AND ct.turn = ids.turn
""")
def q_token_ids(spark, sf):
    _, train = train_tokens(spark, sf)
    sv = vocab.seq_vocabulary(train)
    conv = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select(
        "conv_id", "turn", tx.tokenize("text").alias("tokens"))
    return vocab.token_ids(conv, sv, key=("conv_id", "turn"))


@register("reverse_lookup", f"""
WITH {SEQ_VOCAB_SQL},
ct AS ({CONV_TOK}),
occ AS (SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM ct),
dec AS (SELECT o.conv_id, o.turn,
               list(CASE WHEN v.token_id IS NULL THEN '[UNK]' ELSE o.token END ORDER BY o.pos) AS d
        FROM occ o LEFT JOIN svocab v ON o.token = v.token GROUP BY o.conv_id, o.turn)
SELECT ct.conv_id, ct.turn, coalesce(dec.d, CAST([] AS VARCHAR[])) AS decoded
FROM ct LEFT JOIN dec ON ct.conv_id = dec.conv_id AND ct.turn = dec.turn
""")
def q_reverse_lookup(spark, sf):
    _, train = train_tokens(spark, sf)
    sv = vocab.seq_vocabulary(train)
    conv = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select(
        "conv_id", "turn", tx.tokenize("text").alias("tokens"))
    ids = vocab.token_ids(conv, sv, key=("conv_id", "turn"))
    return vocab.decode_ids(ids, sv, key=("conv_id", "turn"))


@register("oov_rate", f"""
WITH {SEQ_VOCAB_SQL},
occ AS (SELECT unnest(t) AS token FROM ({CONV_TOK}))
SELECT CAST(count(*) AS BIGINT) AS tokens,
       CAST(count(*) FILTER (WHERE token NOT IN (SELECT token FROM svocab)) AS BIGINT) AS oov_tokens,
       round(count(*) FILTER (WHERE token NOT IN (SELECT token FROM svocab)) / count(*), 6) AS oov_rate
FROM occ
""")
def q_oov_rate(spark, sf):
    _, train = train_tokens(spark, sf)
    sv = vocab.seq_vocabulary(train)
    conv = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select(
        "conv_id", "turn", tx.tokenize("text").alias("tokens"))
    out = vocab.oov_rate(conv, sv)
    return out.select("tokens", "oov_tokens", r6("oov_rate").alias("oov_rate"))


# ---------------------------------------------------------------- NB statistics

COUNTS_SQL = f"""{DOCS},
tok AS (SELECT doc_id, label, {TOK('text')} AS t FROM docs),
feat AS (SELECT DISTINCT doc_id, label, unnest(list_concat(t, {S.bigrams_sql('t')})) AS feature FROM tok),
cnt AS (SELECT feature, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg
        FROM feat GROUP BY feature),
tot AS (SELECT sum(n_pos) + {ALPHA} * count(*) AS pos_total, sum(n_neg) + {ALPHA} * count(*) AS neg_total FROM cnt)"""


def _docs_counts(spark, sf) -> DataFrame:
    featured = docs_tokens(spark, sf).select("doc_id", "label", tx.feature_set("tokens").alias("features"))
    return nb.class_doc_freq(nb.doc_features(featured))


@register("log_count_ratio", f"""
WITH {COUNTS_SQL}
SELECT feature, CASE WHEN feature LIKE '% %' THEN 'bigram' ELSE 'unigram' END AS kind, n_pos, n_neg,
       round(ln(((n_pos + {ALPHA}) / pos_total) / ((n_neg + {ALPHA}) / neg_total)), 6) AS ratio
FROM cnt, tot
""")
def q_log_count_ratio(spark, sf):
    ratio = nb.log_count_ratio(_docs_counts(spark, sf), ALPHA)
    return ratio.select("feature", F.when(F.col("feature").contains(" "), "bigram").otherwise("unigram").alias("kind"),
                        "n_pos", "n_neg", r6("ratio").alias("ratio"))


@register("class_doc_freq", f"""
WITH {COUNTS_SQL}
SELECT feature, n_pos, n_neg, round(n_pos + {ALPHA}, 6) AS pos_smoothed, round(n_neg + {ALPHA}, 6) AS neg_smoothed,
       round(pos_total, 6) AS pos_total, round(neg_total, 6) AS neg_total
FROM cnt, tot
""")
def q_class_doc_freq(spark, sf):
    counts = cut_lineage(_docs_counts(spark, sf))
    a = F.lit(ALPHA)
    pos_total, neg_total = nb.smoothed_totals(counts, ALPHA)
    return counts.select(
        "feature", "n_pos", "n_neg", r6(F.col("n_pos") + a).alias("pos_smoothed"),
        r6(F.col("n_neg") + a).alias("neg_smoothed"), r6(F.lit(pos_total)).alias("pos_total"),
        r6(F.lit(neg_total)).alias("neg_total"))


@register("class_rows", f"""
WITH {DOCS}
SELECT label, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM docs WHERE label = 1 GROUP BY label
""")
def q_class_rows(spark, sf):
    pos = nb.class_rows(labelled_documents(spark, sf), 1)
    return pos.groupBy("label").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).cast("bigint").alias("chars"))


# ---------------------------------------------------------------- sequences

from glossa.operators import sequence as seq  # noqa: E402

ENC_SQL = f"""{SEQ_VOCAB_SQL},
occ AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM stok),
ids AS (SELECT o.doc_id, list(CAST(coalesce(v.token_id, 1) AS BIGINT) ORDER BY o.pos) AS tids
        FROM occ o LEFT JOIN svocab v ON o.token = v.token GROUP BY o.doc_id),
enc AS (SELECT s.doc_id, s.label,
          list_concat(list_concat([CAST(2 AS BIGINT)], coalesce(ids.tids, CAST([] AS BIGINT[]))[1:398]),
                      [CAST(3 AS BIGINT)]) AS input_ids
        FROM stok s LEFT JOIN ids ON s.doc_id = ids.doc_id)"""


def _encoded(spark, sf) -> DataFrame:
    s, train = train_tokens(spark, sf)
    sv = vocab.seq_vocabulary(train)
    return seq.encode(s, sv, keep_cols=("label",))


@register("seq_encoded", f"""
WITH {ENC_SQL}
SELECT doc_id, label, input_ids FROM enc
""")
def q_seq_encoded(spark, sf):
    return _encoded(spark, sf)


@register("seq_padded", f"""
WITH {ENC_SQL}
SELECT doc_id, list_resize(input_ids, (SELECT max(len(input_ids)) FROM enc), CAST(0 AS BIGINT)) AS input_ids FROM enc
""")
def q_seq_padded(spark, sf):
    return seq.pad_to_longest(_encoded(spark, sf)).select("doc_id", "input_ids")


LENGTH_BATCHES = """placed AS (SELECT *, (row_number() OVER (ORDER BY len(input_ids), doc_id) - 1) // 64 AS batch FROM enc),
wide AS (SELECT doc_id, label, batch, input_ids, max(len(input_ids)) OVER (PARTITION BY batch) AS w FROM placed)"""


@register("seq_batch_padded", f"""
WITH {ENC_SQL}, {LENGTH_BATCHES}
SELECT doc_id, batch, list_resize(input_ids, w, CAST(0 AS BIGINT)) AS input_ids FROM wide
""")
def q_seq_batch_padded(spark, sf):
    return seq.pad_batches(_encoded(spark, sf), 64).select("doc_id", "batch", "input_ids")


@register("padding_cells", f"""
WITH {ENC_SQL}, {LENGTH_BATCHES}
SELECT count(*) AS n_rows, count(DISTINCT batch) AS n_batches, CAST(sum(len(input_ids)) AS BIGINT) AS tokens,
       CAST(sum(w) - sum(len(input_ids)) AS BIGINT) AS padded_by_batch,
       CAST(max(w) * count(*) - sum(len(input_ids)) AS BIGINT) AS padded_globally FROM wide
""")
def q_padding_cells(spark, sf):
    return seq.padding_cells(seq.pad_batches(_encoded(spark, sf), 64))


@register("seq_lengths", f"""
WITH {ENC_SQL}
SELECT doc_id, CAST(len(list_filter(input_ids, lambda x: x <> 0)) AS INTEGER) AS length,
       CAST((SELECT max(len(input_ids)) FROM enc) AS INTEGER) AS padded_length FROM enc
""")
def q_seq_lengths(spark, sf):
    padded = seq.pad_to_longest(_encoded(spark, sf))
    return padded.select("doc_id", seq.true_length("input_ids").alias("length"),
                         F.size("input_ids").alias("padded_length"))


@register("batches", f"""
WITH {SPLIT_ONLY}
SELECT doc_id, (row_number() OVER (ORDER BY md5('42|0|' || doc_id), doc_id) - 1) // 64 AS batch
FROM split WHERE split = 'train'
""")
def q_batches(spark, sf):
    train = q_stratified_split(spark, sf).filter(F.col("split") == "train")
    hashed = train.withColumn("h", split.seeded_hash(SEED, F.lit(0), "doc_id"))
    return seq.assign_batches(hashed, 64, ["h", "doc_id"]).select("doc_id", "batch")


# ---------------------------------------------------------------- evaluation

from glossa.operators import evaluate as ev  # noqa: E402

MODELS = ["m1", "m2", "m3"]
# Fixed values of the pseudo-prediction fixture: first md5 hex digit that flips the label.
FLIP_DIGITS = {"m1": ["0", "1"], "m2": ["0", "1", "2"], "m3": ["0"]}


def predictions(spark, sf, drop_m2_f: bool = False) -> DataFrame:
    """Deterministic pseudo-predictions of three models over docs (model, doc_id, text, label, prediction)."""
    d = labelled_documents(spark, sf)
    p = d.select("doc_id", "text", "label", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))
    digest = F.md5(F.concat_ws("|", "model", F.col("doc_id").cast("string")))
    first = F.substring(digest, 1, 1)
    flip = None
    for m, digits in FLIP_DIGITS.items():
        cond = (F.col("model") == m) & first.isin(*digits)
        flip = cond if flip is None else (flip | cond)
    p = p.withColumn("prediction", F.when(flip, F.lit(1) - F.col("label")).otherwise(F.col("label")).cast("tinyint"))
    if drop_m2_f:
        p = p.filter(~((F.col("model") == "m2") & (F.substring(digest, 2, 1) == "f")))
    return p.select("model", "doc_id", "text", "label", "prediction")


def _flip_sql(drop_m2_f: bool = False) -> str:
    h = "md5(m.model || '|' || d.doc_id)"
    conds = " OR ".join(
        f"(m.model = '{m}' AND substr({h}, 1, 1) IN ({', '.join(repr(x) for x in ds)}))" for m, ds in FLIP_DIGITS.items())
    where = f"WHERE NOT (m.model = 'm2' AND substr({h}, 2, 1) = 'f')" if drop_m2_f else ""
    return f"""preds AS (
  SELECT m.model, d.doc_id, d.text, d.label,
         CAST(CASE WHEN {conds} THEN 1 - d.label ELSE d.label END AS TINYINT) AS prediction
  FROM docs d CROSS JOIN (VALUES ('m1'), ('m2'), ('m3')) m(model) {where})"""


PREDS_SQL = f"{DOCS},\n{_flip_sql()}"
LABELS_SQL = "[" + ", ".join(repr(x) for x in tx.LENGTH_LABELS) + "]"
BUCKETS_SQL = f"""{PREDS_SQL},
b AS (SELECT model, label, prediction, {S.bucket_sql(S.word_count_sql('text'))} AS bucket_id FROM preds),
agg AS (SELECT model, bucket_id, count(*) AS samples,
               avg(CAST(coalesce(label = prediction, false) AS INTEGER)) AS accuracy FROM b GROUP BY model, bucket_id),
grid AS (SELECT model, bucket_id FROM (SELECT DISTINCT model FROM preds) CROSS JOIN range(5) r(bucket_id)),
summary AS (SELECT g.model, CAST(g.bucket_id AS INTEGER) AS bucket_id, {LABELS_SQL}[g.bucket_id + 1] AS length_bucket,
                   CAST(coalesce(a.samples, 0) AS BIGINT) AS samples, a.accuracy
            FROM grid g LEFT JOIN agg a ON g.model = a.model AND g.bucket_id = a.bucket_id)"""


@register("accuracy", f"""
WITH {PREDS_SQL}
SELECT model, count(*) AS samples, round(avg(CAST(coalesce(label = prediction, false) AS INTEGER)), 6) AS accuracy
FROM preds GROUP BY model
""")
def q_accuracy(spark, sf):
    return ev.accuracy(predictions(spark, sf)).withColumn("accuracy", r6("accuracy"))


@register("confusion", f"""
WITH {PREDS_SQL},
c AS (SELECT model, CAST(label AS INTEGER) AS label, CAST(prediction AS INTEGER) AS prediction, count(*) AS n
      FROM preds WHERE label IN (0, 1) AND prediction IN (0, 1) GROUP BY ALL),
g AS (SELECT model, l.label, p.prediction FROM (SELECT DISTINCT model FROM preds)
      CROSS JOIN (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) p(prediction))
SELECT g.model, CAST(g.label AS INTEGER) AS label, CAST(g.prediction AS INTEGER) AS prediction,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN c ON g.model = c.model AND g.label = c.label AND g.prediction = c.prediction
""")
def q_confusion(spark, sf):
    return ev.confusion(predictions(spark, sf))


@register("accuracy_by_length", f"""
WITH {BUCKETS_SQL}
SELECT model, bucket_id, length_bucket, samples, round(accuracy, 6) AS accuracy FROM summary
""")
def q_accuracy_by_length(spark, sf):
    return ev.accuracy_by_length(predictions(spark, sf)).withColumn("accuracy", r6("accuracy"))


@register("accuracy_pivot", f"""
WITH {BUCKETS_SQL}
SELECT bucket_id, length_bucket,
       round(max(accuracy) FILTER (WHERE model = 'm1'), 6) AS m1,
       round(max(accuracy) FILTER (WHERE model = 'm2'), 6) AS m2,
       round(max(accuracy) FILTER (WHERE model = 'm3'), 6) AS m3
FROM summary GROUP BY bucket_id, length_bucket
""")
def q_accuracy_pivot(spark, sf):
    pv = ev.accuracy_pivot(ev.accuracy_by_length(predictions(spark, sf)), MODELS)
    return pv.select("bucket_id", "length_bucket", *[r6(m).alias(m) for m in MODELS])


def _pairs_sql() -> str:
    parts = []
    for a, b in [(MODELS[i], MODELS[j]) for i in range(len(MODELS)) for j in range(i + 1, len(MODELS))]:
        parts.append(f"""SELECT '{a}' AS model_left, '{b}' AS model_right,
       count(*) FILTER (WHERE l.doc_id IS NULL) AS missing_left,
       count(*) FILTER (WHERE r.doc_id IS NULL) AS missing_right,
       count(*) FILTER (WHERE l.label <> r.label) AS label_mismatch,
       count(*) FILTER (WHERE l.doc_id IS NULL OR r.doc_id IS NULL OR l.label <> r.label) = 0 AS same_examples
FROM (SELECT doc_id, label FROM preds WHERE model = '{a}') l
FULL OUTER JOIN (SELECT doc_id, label FROM preds WHERE model = '{b}') r ON l.doc_id = r.doc_id""")
    return "\nUNION ALL\n".join(parts)


@register("same_examples", f"""
WITH {DOCS},
{_flip_sql(drop_m2_f=True)}
{_pairs_sql()}
""")
def q_same_examples(spark, sf):
    return ev.same_examples(predictions(spark, sf, drop_m2_f=True), MODELS)


@register("same_examples_repeated", f"""
WITH {DOCS},
{_flip_sql(drop_m2_f=True)},
again AS (
  SELECT model, doc_id, label FROM preds
  UNION ALL SELECT model, doc_id, CASE WHEN model = 'm1' AND doc_id % 3 = 0 THEN 1 - label ELSE label END FROM preds WHERE doc_id % 5 < 2),
ex AS (SELECT model, doc_id, count(*) AS n, min(label) AS lo, max(label) AS hi FROM again GROUP BY model, doc_id),
pairs AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in combinations(MODELS, 2))}) p(model_left, model_right)),
sides AS (
  SELECT p.model_left, p.model_right, coalesce(l.doc_id, r.doc_id) AS doc_id, l.n AS ln, l.lo AS llo, l.hi AS lhi, r.n AS rn, r.lo AS rlo, r.hi AS rhi
  FROM pairs p JOIN (SELECT DISTINCT doc_id FROM ex) d ON true
  LEFT JOIN ex l ON l.model = p.model_left AND l.doc_id = d.doc_id LEFT JOIN ex r ON r.model = p.model_right AND r.doc_id = d.doc_id)
SELECT model_left, model_right, count(*) FILTER (WHERE ln IS NULL AND rn IS NOT NULL) AS missing_left,
  count(*) FILTER (WHERE rn IS NULL AND ln IS NOT NULL) AS missing_right,
  count(*) FILTER (WHERE ln IS NOT NULL AND rn IS NOT NULL AND (ln <> rn OR llo <> lhi OR rlo <> rhi OR llo <> rlo)) AS label_mismatch,
  count(*) FILTER (WHERE (ln IS NULL) <> (rn IS NULL) OR ln <> rn OR llo <> lhi OR rlo <> rhi OR llo <> rlo) = 0 AS same_examples
FROM sides WHERE ln IS NOT NULL OR rn IS NOT NULL GROUP BY ALL
""")
def q_same_examples_repeated(spark, sf):
    """C6 on result tables that hold some documents twice, one model with both labels."""
    pred = predictions(spark, sf, drop_m2_f=True).select("model", "doc_id", F.col("label").cast("int").alias("label"))
    turned = F.when((F.col("model") == "m1") & (F.col("doc_id") % 3 == 0), 1 - F.col("label")).otherwise(F.col("label"))
    twice = pred.filter(F.col("doc_id") % 5 < 2).withColumn("label", turned)
    return ev.same_examples(pred.unionByName(twice), MODELS)


@register("align_check", f"""
WITH {SPLIT_ONLY},
{_flip_sql()},
e AS (SELECT doc_id, label FROM split WHERE split = 'test'),
o AS (SELECT doc_id, label FROM preds WHERE model = 'm1')
SELECT count(*) FILTER (WHERE o.doc_id IS NULL) AS only_expected,
       count(*) FILTER (WHERE e.doc_id IS NULL) AS only_observed,
       count(*) FILTER (WHERE e.label <> o.label) AS label_mismatch,
       count(*) FILTER (WHERE o.doc_id IS NULL OR e.doc_id IS NULL OR e.label <> o.label) = 0 AS aligned
FROM e FULL OUTER JOIN o ON e.doc_id = o.doc_id
""")
def q_align_check(spark, sf):
    test = q_stratified_split(spark, sf).filter(F.col("split") == "test")
    observed = predictions(spark, sf).filter(F.col("model") == "m1")
    return ev.align_check(test, observed)


@register("model_comparison", f"""
WITH {PREDS_SQL}
SELECT model, count(*) AS samples,
       round(avg(CAST(coalesce(label = prediction, false) AS INTEGER)), 6) AS accuracy,
       printf('%.2f%%', 100 * avg(CAST(coalesce(label = prediction, false) AS INTEGER))) AS accuracy_label,
       count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
       count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
       count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
       count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
FROM preds GROUP BY model
""")
def q_model_comparison(spark, sf):
    return ev.model_comparison(predictions(spark, sf)).withColumn("accuracy", r6("accuracy"))


# ---------------------------------------------------------------- history

from glossa.operators import history as hist  # noqa: E402


def scoring_log(spark, sf) -> DataFrame:
    """events as a per-row scoring log: epoch = day of month, logit = (value-50)/25, label = event_id % 2."""
    e = table(spark, sf, "events")
    return e.select(F.dayofmonth("ts").alias("epoch"), F.col("event_id").alias("row_id"),
                    ((F.col("value") - 50) / 25).alias("logit"), (F.col("event_id") % 2).cast("int").alias("label"))


LOG_SQL = """log AS (SELECT CAST(dayofmonth(ts) AS INTEGER) AS epoch, event_id AS row_id, (value - 50) / 25 AS logit,
                CAST(event_id % 2 AS INTEGER) AS label FROM events),
s AS (SELECT *, greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit))) AS loss,
             CAST(CAST(1 / (1 + exp(-logit)) >= 0.5 AS INTEGER) = label AS INTEGER) AS correct FROM log),
val AS (SELECT epoch, count(*) AS samples, avg(loss) AS val_loss, avg(correct) AS val_accuracy FROM s GROUP BY epoch),
bt AS (SELECT epoch, avg(loss) AS bl FROM (SELECT epoch, loss,
          (row_number() OVER (PARTITION BY epoch ORDER BY row_id) - 1) // 64 AS batch FROM s) GROUP BY epoch, batch),
tr AS (SELECT epoch, avg(bl) AS train_loss, count(*) AS batches FROM bt GROUP BY epoch),
h AS (SELECT tr.epoch, train_loss, val_loss, val_accuracy FROM tr JOIN val ON tr.epoch = val.epoch)"""


@register("weighted_loss", f"""
WITH {LOG_SQL}
SELECT epoch, samples, round(val_loss, 6) AS val_loss, round(val_accuracy, 6) AS val_accuracy FROM val
""")
def q_weighted_loss(spark, sf):
    w = hist.weighted_loss(scoring_log(spark, sf))
    return w.select("epoch", "samples", r6("val_loss").alias("val_loss"), r6("val_accuracy").alias("val_accuracy"))


@register("batch_mean_loss", f"""
WITH {LOG_SQL}
SELECT epoch, round(train_loss, 6) AS train_loss, batches FROM tr
""")
def q_batch_mean_loss(spark, sf):
    b = hist.batch_mean_loss(scoring_log(spark, sf))
    return b.select("epoch", r6("train_loss").alias("train_loss"), "batches")


def _history(spark, sf) -> DataFrame:
    return hist.check_history(hist.history_from_log(scoring_log(spark, sf)))


@register("improved_epochs", f"""
WITH {LOG_SQL}
SELECT epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, round(val_accuracy, 6) AS val_accuracy,
       coalesce(val_loss < min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
         AS improved
FROM h
""")
def q_improved_epochs(spark, sf):
    h = hist.improved_epochs(_history(spark, sf))
    return h.select("epoch", *[r6(c).alias(c) for c in ("train_loss", "val_loss", "val_accuracy")], "improved")


@register("best_epoch", f"""
WITH {LOG_SQL}
SELECT first(epoch ORDER BY val_loss, epoch) AS best_epoch, round(min(val_loss), 6) AS best_val_loss,
       first(epoch ORDER BY val_accuracy DESC, epoch) AS best_accuracy_epoch,
       round(max(val_accuracy), 6) AS best_val_accuracy
FROM h
""")
def q_best_epoch(spark, sf):
    b = hist.best_epoch(_history(spark, sf))
    return b.select("best_epoch", r6("best_val_loss").alias("best_val_loss"), "best_accuracy_epoch",
                    r6("best_val_accuracy").alias("best_val_accuracy"))


@register("history_long", f"""
WITH {LOG_SQL}
SELECT epoch, metric, round(value, 6) AS value
FROM (UNPIVOT h ON train_loss, val_loss, val_accuracy INTO NAME metric VALUE value)
""")
def q_history_long(spark, sf):
    return hist.history_long(_history(spark, sf)).withColumn("value", r6("value"))


# ---------------------------------------------------------------- NB-SVM scoring

from glossa.functions import scores as sc  # noqa: E402
from glossa.operators import score as scoring  # noqa: E402

ALPHAS = [0.1, 0.2, 0.3, 0.4]
CS = [0.05, 0.1, 0.15, 0.2]


def nb_model(spark, sf):
    """(split tokens, vocabulary, model table (feature_id, feature, ratio, w=1)) from the train part."""
    s, train = train_tokens(spark, sf)
    featured = train.select("doc_id", "label", tx.feature_set("tokens").alias("features"))
    ratio = nb.log_count_ratio(nb.class_doc_freq(nb.doc_features(featured)), ALPHA)
    # the count table's keys are exactly the training features: index it directly (D3 ids)
    indexed = vocab.index_features(ratio, keep=("ratio",))
    v = indexed.select("feature_id", "kind", "w1", "w2", "feature")
    model = indexed.select("feature_id", "feature", "ratio", F.lit(1.0).alias("w"))
    return s, v, model


def presence(part: DataFrame, v: DataFrame) -> DataFrame:
    featured = part.select("doc_id", tx.feature_set("tokens").alias("features"))
    return vocab.feature_id_rows(featured, v)


MODEL_SQL = f"""{NB_VOCAB_SQL},
occ AS (SELECT DISTINCT doc_id, split, label, unnest(list_concat(t, {S.bigrams_sql('t')})) AS feature FROM stok),
cnt AS (SELECT feature, sum(label) AS n_pos, sum(1 - label) AS n_neg FROM occ WHERE split = 'train' GROUP BY feature),
tot AS (SELECT sum(n_pos) + {ALPHA} * count(*) AS pt, sum(n_neg) + {ALPHA} * count(*) AS nt FROM cnt),
model AS (SELECT v.feature_id, v.feature, ln(((c.n_pos + {ALPHA}) / pt) / ((c.n_neg + {ALPHA}) / nt)) AS ratio
          FROM vocab v JOIN cnt c ON v.feature = c.feature, tot),
scores AS (SELECT s.doc_id, s.label, s.split, coalesce(x.sm, 0.0) + 0.0 AS score
           FROM stok s LEFT JOIN (SELECT o.doc_id, sum(m.ratio) AS sm FROM occ o JOIN model m ON o.feature = m.feature
                                  GROUP BY o.doc_id) x ON s.doc_id = x.doc_id)"""


@register("linear_score", f"""
WITH {MODEL_SQL}
SELECT doc_id, round(score, 6) AS score FROM scores WHERE split = 'test'
""")
def q_linear_score(spark, sf):
    s, v, model = nb_model(spark, sf)
    test = s.filter(F.col("split") == "test")
    out = scoring.linear_scores(presence(test, v), test.select("doc_id"), model, 0.0)
    return out.select("doc_id", r6("score").alias("score"))


@register("nbsvm_predict", f"""
WITH {MODEL_SQL}
SELECT doc_id, label, CAST(score > 0 AS TINYINT) AS prediction,
       CAST(coalesce(label = CAST(score > 0 AS TINYINT), false) AS INTEGER) AS correct
FROM scores WHERE split = 'test'
""")
def q_nbsvm_predict(spark, sf):
    s, v, model = nb_model(spark, sf)
    test = s.filter(F.col("split") == "test")
    out = scoring.nbsvm_predict(presence(test, v), test.select("doc_id", "label"), model, 0.0)
    return out.select("doc_id", "label", "prediction", "correct")


@register("weighted_features", f"""
WITH {MODEL_SQL}
SELECT o.doc_id, m.feature_id, round(m.ratio, 6) AS value
FROM occ o JOIN model m ON o.feature = m.feature WHERE o.split = 'test'
""")
def q_weighted_features(spark, sf):
    s, v, model = nb_model(spark, sf)
    test = s.filter(F.col("split") == "test")
    w = nb.weight_features(presence(test, v), model)
    return w.select("doc_id", "feature_id", r6("value").alias("value"))


@register("feature_store", f"""
WITH {MODEL_SQL}
SELECT o.doc_id, o.split, count(*) AS n_features, round(sum(m.ratio), 6) + 0.0 AS ratio_sum
FROM occ o JOIN model m ON o.feature = m.feature GROUP BY o.doc_id, o.split
""")
def q_feature_store(spark, sf):
    """The presence and ratio tables written bucketed by feature, read back and joined without an exchange."""
    from glossa.sources.sinks import read_feature_store, work_folder, write_feature_store

    s, v, model = nb_model(spark, sf)
    featured = s.select("doc_id", "split", tx.feature_set("tokens").alias("features"))
    path = work_folder(spark, "features")
    write_feature_store(vocab.feature_id_rows(featured, v, keep_cols=("split",)), model.select("feature_id", "ratio"), path)
    stored, weights = read_feature_store(spark, path)
    return stored.join(weights, "feature_id").groupBy("doc_id", "split").agg(
        F.count(F.lit(1)).alias("n_features"), (F.round(F.sum("ratio"), 6) + F.lit(0.0)).alias("ratio_sum"))


@register("labelled_csv", """
SELECT d.doc_id, d.text, CAST(l.quality AS INTEGER) AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL
""")
def q_labelled_csv(spark, sf):
    """A1: the labelled corpus written as quoted CSV and read back in byte ranges."""
    from pyspark.sql import types as T

    from glossa.sources.sinks import work_folder

    docs = table(spark, sf, "documents").select("doc_id", "text").join(
        table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").filter("text is not null")
    path = work_folder(spark, "csv")
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])
    return read_labelled_csv(spark, path, schema)


@register("feature_space_check", f"""
WITH {MODEL_SQL},
pr AS (SELECT o.doc_id, o.split, v.feature_id FROM occ o JOIN vocab v ON o.feature = v.feature)
SELECT split, count(*) AS nnz, count(*) FILTER (WHERE feature_id NOT IN (SELECT feature_id FROM model)) AS violations
FROM pr GROUP BY split
""")
def q_feature_space_check(spark, sf):
    s, v, model = nb_model(spark, sf)
    featured = s.select("doc_id", "split", tx.feature_set("tokens").alias("features"))
    rows = vocab.feature_id_rows(featured, v, keep_cols=("split",))
    bad = rows.join(model.select("feature_id", F.lit(1).alias("_k")), "feature_id", "left")
    return bad.groupBy("split").agg(F.count(F.lit(1)).alias("nnz"), F.count_if(F.col("_k").isNull()).alias("violations"))


@register("feature_space_by_split", f"""
WITH {MODEL_SQL}
SELECT split, count(*) AS features, count(*) FILTER (WHERE feature NOT IN (SELECT feature FROM vocab)) AS unknown_features,
       count(DISTINCT doc_id) FILTER (WHERE feature NOT IN (SELECT feature FROM vocab)) AS docs_with_unknown
FROM occ GROUP BY split
""")
def q_feature_space_by_split(spark, sf):
    """C8 on features of every split against the vocabulary of the training split."""
    s, v, _ = nb_model(spark, sf)
    return nb.feature_space_by_split(s.select("doc_id", "split", tx.feature_set("tokens").alias("features")), v)


@register("matrix_stats", f"""
WITH {MODEL_SQL},
pr AS (SELECT o.doc_id, o.split, v.feature_id FROM occ o JOIN vocab v ON o.feature = v.feature)
SELECT s.split, count(DISTINCT s.doc_id) AS rows, (SELECT count(*) FROM vocab) AS columns,
       (SELECT count(*) FROM pr WHERE pr.split = s.split) AS nnz
FROM stok s GROUP BY s.split
""")
def q_matrix_stats(spark, sf):
    s, v, _ = nb_model(spark, sf)
    featured = s.select("doc_id", "split", tx.feature_set("tokens").alias("features"))
    rows = vocab.feature_id_rows(featured, v, keep_cols=("split",))
    nnz = rows.groupBy("split").agg(F.count(F.lit(1)).alias("nnz"))
    docs = s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    width = v.count()
    return docs.join(nnz, "split", "left").select(
        "split", "rows", F.lit(width).cast("bigint").alias("columns"), F.coalesce("nnz", F.lit(0)).alias("nnz"))


def _grid_cells():
    return [(ci * len(ALPHAS) + ai, c, a, ai) for ci, c in enumerate(CS) for ai, a in enumerate(ALPHAS)]


def grid_accuracy(spark, sf) -> DataFrame:
    """Accuracy on the validation part of every (C, alpha) cell with the weights of one diagonal Newton step.

    Counts are computed once; the weights of all sixteen cells are projections
    of the same count table, and the cells conditional averages of one pass
    over the validation scores (nine decimals, so that cancelling sums are
    zero in any order).  The fitted grid is ``svm_grid_search``.
    """
    s, train = train_tokens(spark, sf)
    featured = train.select("doc_id", "label", tx.feature_set("tokens").alias("features"))
    ratios = nb.ratios_for_alphas(nb.class_doc_freq(nb.doc_features(featured)), ALPHAS)
    val = s.filter(F.col("split") == "validation")
    occ = nb.doc_features(val.select("doc_id", "label", tx.feature_set("tokens").alias("features")))
    steps = ratios.select("feature", *[nb.first_step(F.col(f"ratio_{ai}"), c).alias(f"w_{n}") for n, c, _, ai in _grid_cells()])
    sums = occ.join(steps, "feature").groupBy("doc_id").agg(*[F.sum(f"w_{n}").alias(f"s_{n}") for n, _, _, _ in _grid_cells()])
    scored = val.select("doc_id", "label").join(sums, "doc_id", "left")
    cells = []
    for cell_no, c, a, _ in _grid_cells():
        score = F.round(F.coalesce(F.col(f"s_{cell_no}"), F.lit(0.0)), 9)
        pred = sc.svm_label(score)
        short = F.greatest(F.lit(0.0), F.lit(1.0) - (F.lit(2) * F.col("label") - F.lit(1)) * score)
        cells.append(F.struct(F.lit(cell_no).alias("cell_no"), F.lit(c).alias("C"), F.lit(a).alias("alpha"),
                              F.avg(tx.correct_flag("label", pred).cast("double")).alias("accuracy"),
                              F.avg(short * short).alias("mean_loss")))
    return scored.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


GRID_SQL = f"""{MODEL_SQL},
alphas AS (SELECT * FROM (VALUES {', '.join(f'({i}, CAST({a} AS DOUBLE))' for i, a in enumerate(ALPHAS))}) a(ai, alpha)),
cs AS (SELECT * FROM (VALUES {', '.join(f'({i}, CAST({c} AS DOUBLE))' for i, c in enumerate(CS))}) c(ci, C)),
gt AS (SELECT a.ai, a.alpha, sum(n_pos) + a.alpha * count(*) AS pt, sum(n_neg) + a.alpha * count(*) AS nt
       FROM cnt CROSS JOIN alphas a GROUP BY a.ai, a.alpha),
gr AS (SELECT cnt.feature, n_pos, n_neg, gt.ai, ln(((n_pos + gt.alpha) / pt) / ((n_neg + gt.alpha) / nt)) AS r FROM cnt CROSS JOIN gt),
wt AS (SELECT gr.feature, gr.ai, cs.ci, 2 * C * r * r * (n_pos - n_neg) / (1 + 2 * C * r * r * (n_pos + n_neg)) AS w FROM gr CROSS JOIN cs),
vs AS (SELECT o.doc_id, wt.ai, wt.ci, sum(wt.w) AS sm FROM occ o JOIN wt ON o.feature = wt.feature
       WHERE o.split = 'validation' GROUP BY o.doc_id, wt.ai, wt.ci),
grid AS (SELECT CAST(c.ci * {len(ALPHAS)} + a.ai AS INTEGER) AS cell_no, c.C, a.alpha,
                avg(CAST(coalesce(label = CAST(round(coalesce(vs.sm, 0.0), 9) > 0 AS TINYINT), false) AS INTEGER)) AS accuracy,
                avg(pow(greatest(0.0, 1.0 - (2 * label - 1) * round(coalesce(vs.sm, 0.0), 9)), 2)) AS mean_loss
         FROM stok d CROSS JOIN alphas a CROSS JOIN cs c LEFT JOIN vs ON vs.doc_id = d.doc_id AND vs.ai = a.ai AND vs.ci = c.ci
         WHERE d.split = 'validation' GROUP BY c.ci, a.ai, c.C, a.alpha)"""


@register("grid_accuracy", f"""
WITH {GRID_SQL}
SELECT cell_no, C, alpha, round(accuracy, 6) AS accuracy, round(mean_loss, 6) AS mean_loss FROM grid
""")
def q_grid_accuracy(spark, sf):
    return grid_accuracy(spark, sf).withColumns({"accuracy": r6("accuracy"), "mean_loss": r6("mean_loss")})


@register("grid_best", f"""
WITH {GRID_SQL}
SELECT first(cell_no ORDER BY accuracy DESC, cell_no) AS best_cell,
       first(C ORDER BY accuracy DESC, cell_no) AS best_C,
       first(alpha ORDER BY accuracy DESC, cell_no) AS best_alpha,
       round(max(accuracy), 6) AS best_accuracy
FROM grid
""")
def q_grid_best(spark, sf):
    g = grid_accuracy(spark, sf)
    key = F.struct(F.col("accuracy"), -F.col("cell_no"))
    return g.agg(F.max_by("cell_no", key).alias("best_cell"), F.max_by("C", key).alias("best_C"),
                 F.max_by("alpha", key).alias("best_alpha"), r6(F.max("accuracy")).alias("best_accuracy"))


def _sigmoid_model():
    import numpy as np

    def model(pdf):
        return 1.0 / (1.0 + np.exp(-pdf["score"].to_numpy(dtype=float)))
    return model


@register("batch_score", f"""
WITH {MODEL_SQL}
SELECT doc_id, label, round(1 / (1 + exp(-score)), 6) AS probability_positive,
       CAST(1 / (1 + exp(-score)) >= 0.5 AS TINYINT) AS prediction,
       CAST(coalesce(label = CAST(1 / (1 + exp(-score)) >= 0.5 AS TINYINT), false) AS INTEGER) AS correct,
       'linear' AS model
FROM scores WHERE split = 'test'
""")
def q_batch_score(spark, sf):
    s, v, model = nb_model(spark, sf)
    test = s.filter(F.col("split") == "test")
    scored = scoring.linear_scores(presence(test, v), test.select("doc_id", "label"), model, 0.0)
    probs = scoring.batch_score(scored, _sigmoid_model, ["score"], keep_cols=("doc_id", "label"))
    out = scoring.evaluate_scored(probs, model_name="linear")
    return out.select("doc_id", "label", r6("probability_positive").alias("probability_positive"), "prediction",
                      "correct", "model")


@register("single_text", f"""
WITH {MODEL_SQL},
ct AS ({CONV_TOK}),
co AS (SELECT DISTINCT conv_id, turn, unnest(list_concat(t, {S.bigrams_sql('t')})) AS feature FROM ct),
cs AS (SELECT co.conv_id, co.turn, sum(m.ratio) AS sm FROM co JOIN model m ON co.feature = m.feature GROUP BY ALL)
SELECT ct.conv_id, ct.turn, round(coalesce(cs.sm, 0.0), 6) AS score, CAST(coalesce(cs.sm, 0.0) > 0 AS TINYINT) AS prediction
FROM ct LEFT JOIN cs ON ct.conv_id = cs.conv_id AND ct.turn = cs.turn
""")
def q_single_text(spark, sf):
    _, v, model = nb_model(spark, sf)
    conv = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return score_texts(conv, v, model)


def score_texts(texts: DataFrame, v: DataFrame, model: DataFrame) -> DataFrame:
    """H7 as a stateless column pipeline (works unchanged on a stream): (conv_id, turn, score, prediction)."""
    feats = texts.select("conv_id", "turn", tx.feature_set(tx.tokenize("text")).alias("features"))
    occ = tx.explode_items(feats, "features", "feature", "conv_id", "turn")
    u = model.select("feature", "ratio")
    sums = occ.join(u, "feature").groupBy("conv_id", "turn").agg(F.sum("ratio").alias("_s"))
    out = texts.select("conv_id", "turn").join(sums, ["conv_id", "turn"], "left")
    score = F.coalesce(F.col("_s"), F.lit(0.0))
    return out.select("conv_id", "turn", r6(score).alias("score"), sc.svm_label(score).alias("prediction"))


# ---------------------------------------------------------------- score functions

@register("sigmoid_threshold", """
SELECT event_id, round(1 / (1 + exp(-((value - 50) / 25))), 6) AS probability,
       CAST(1 / (1 + exp(-((value - 50) / 25))) >= 0.5 AS TINYINT) AS prediction
FROM events
""")
def q_sigmoid_threshold(spark, sf):
    z = (F.col("value") - 50) / 25
    return table(spark, sf, "events").select("event_id", r6(sc.sigmoid(z)).alias("probability"),
                                             sc.sigmoid_label(z).alias("prediction"))


@register("bce_rows", """
SELECT event_id, round(greatest((value - 50) / 25, 0) - (value - 50) / 25 * (event_id % 2)
                       + ln(1 + exp(-abs((value - 50) / 25))), 6) AS loss
FROM events
""")
def q_bce_rows(spark, sf):
    z = (F.col("value") - 50) / 25
    return table(spark, sf, "events").select("event_id", r6(sc.bce_with_logits(z, F.col("event_id") % 2)).alias("loss"))


@register("softmax_binary", """
WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS l FROM embeddings),
p AS (
  SELECT vec_id,
         list_transform(l[1:3], lambda x: exp(x - list_max(l[1:3]))) AS e3,
         list_transform(l[1:2], lambda x: exp(x - list_max(l[1:2]))) AS e2
  FROM d)
SELECT vec_id,
       round((e3[3] / list_sum(e3)) / (e3[1] / list_sum(e3) + e3[3] / list_sum(e3) + 1e-9), 6) AS p_pos3,
       round(e2[2] / list_sum(e2), 6) AS p_pos2,
       CAST((e3[3] / list_sum(e3)) / (e3[1] / list_sum(e3) + e3[3] / list_sum(e3) + 1e-9) >= 0.5 AS TINYINT) AS pred3,
       CAST(e2[2] / list_sum(e2) >= 0.5 AS TINYINT) AS pred2
FROM p
""")
def q_softmax_binary(spark, sf):
    e = table(spark, sf, "embeddings")
    lg = F.transform("embedding", lambda x: x.cast("double"))
    p3 = sc.positive_probability(sc.softmax(F.slice(lg, 1, 3)))
    p2 = sc.positive_probability(sc.softmax(F.slice(lg, 1, 2)))
    return e.select("vec_id", r6(p3).alias("p_pos3"), r6(p2).alias("p_pos2"),
                    sc.probability_label(p3).alias("pred3"), sc.probability_label(p2).alias("pred2"))


@register("head_truncate", f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, t[1:128] AS head, len(t) > 128 AS truncated
FROM (SELECT doc_id, {TOK('text')} AS t FROM documents)
""")
def q_head_truncate(spark, sf):
    t = text_table(spark, sf, "documents", "doc_id", "text").select("doc_id", tx.tokenize("text").alias("tokens"))
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), tx.head_truncate("tokens", 128).alias("head"),
                    (F.size("tokens") > 128).alias("truncated"))


# ---------------------------------------------------------------- vectors

from glossa.operators import vectors as vec  # noqa: E402

EMBED_DIM = 64


def pretrained_vectors(spark, sf, sv: DataFrame) -> DataFrame:
    """The embeddings table as pretrained vectors: vec_id v belongs to the token with sequence id v + 4."""
    e = table(spark, sf, "embeddings").select((F.col("vec_id") + 4).alias("token_id"), F.col("embedding").alias("vec"))
    return e.join(sv, "token_id").select("token", "vec")


VEC_SQL = f"""{SEQ_VOCAB_SQL},
pre AS (SELECT s.token, e.embedding AS vec FROM embeddings e JOIN svocab s ON s.token_id = e.vec_id + 4),
vecs AS (
  SELECT CAST(s.token_id AS BIGINT) AS token_id, s.token,
         CASE WHEN s.token = '[PAD]' THEN 'pad' WHEN p.vec IS NOT NULL THEN 'pretrained' ELSE 'random' END AS source,
         CASE WHEN s.token = '[PAD]' THEN list_transform(range({EMBED_DIM}), lambda k: CAST(0 AS FLOAT))
              WHEN p.vec IS NOT NULL THEN p.vec
              ELSE list_transform(range({EMBED_DIM}), lambda k: CAST(
                (CAST(CAST('0x' || substr(md5(s.token || '|' || k), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967295.0 AS DOUBLE)
                 - CAST(0.5 AS DOUBLE)) * CAST(0.02 AS DOUBLE) AS FLOAT)) END AS vec
  FROM svocab s LEFT JOIN pre p ON s.token = p.token)"""


def _vectors(spark, sf):
    s, train = train_tokens(spark, sf)
    sv = vocab.seq_vocabulary(train)
    return s, sv, vec.lookup_vectors(sv, pretrained_vectors(spark, sf, sv), EMBED_DIM)


@register("vector_lookup", f"""
WITH {VEC_SQL}
SELECT token_id, token, source, vec FROM vecs
""")
def q_vector_lookup(spark, sf):
    return _vectors(spark, sf)[2]


@register("attention_pool", f"""
WITH {VEC_SQL},
proj AS (SELECT list(m ORDER BY k) AS p FROM (SELECT k, avg(x) AS m FROM
          (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY k)),
occ AS (SELECT doc_id, unnest(t) AS token FROM stok WHERE split = 'test'),
ids AS (SELECT o.doc_id, coalesce(v.token_id, 1) AS token_id FROM occ o LEFT JOIN svocab v ON o.token = v.token),
j AS (SELECT i.doc_id, vv.vec, list_sum(list_transform(range({EMBED_DIM}), lambda k: vv.vec[k + 1] * proj.p[k + 1])) AS e
      FROM ids i JOIN vecs vv ON i.token_id = vv.token_id CROSS JOIN proj),
aw AS (SELECT doc_id, vec, exp(e - max(e) OVER (PARTITION BY doc_id)) AS w FROM j),
z AS (SELECT doc_id, sum(w) AS z FROM aw GROUP BY doc_id),
d AS (SELECT doc_id, k, sum(w * x) AS sm FROM
       (SELECT doc_id, w, unnest(vec) AS x, generate_subscripts(vec, 1) AS k FROM aw) GROUP BY doc_id, k)
SELECT d.doc_id, list(round(d.sm / z.z, 6) + 0.0 ORDER BY d.k) AS context FROM d JOIN z ON d.doc_id = z.doc_id GROUP BY d.doc_id
""")
def q_attention_pool(spark, sf):
    s, sv, vecs = _vectors(spark, sf)
    test = s.filter(F.col("split") == "test")
    occ = tx.explode_items(test, "tokens", "token", "doc_id", with_pos="pos")
    occ = occ.join(sv, "token", "left").select("doc_id", "pos", F.coalesce("token_id", F.lit(1)).alias("token_id"))
    e = table(spark, sf, "embeddings")
    dims = e.select(F.posexplode("embedding").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"))
    # the projection has one entry per embedding dimension (bounded by the vector width)
    proj = [r["m"] for r in dims.orderBy("k").collect()]
    pooled = vec.attention_pool(occ, vecs, F.array(*[F.lit(float(x)) for x in proj]))
    return pooled.select("doc_id", F.transform("context", lambda x: F.round(x, 6) + F.lit(0.0)).alias("context"))


@register("halves_sum", f"""
SELECT vec_id, list_transform(range({EMBED_DIM // 2}), lambda i: embedding[i + 1] + embedding[i + {EMBED_DIM // 2 + 1}]) AS halves
FROM embeddings
""")
def q_halves_sum(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", vec.halves_sum("embedding", EMBED_DIM // 2).alias("halves"))


# ---------------------------------------------------------------- metadata and set operations

@register("run_metadata", f"""
WITH {NB_VOCAB_SQL}
SELECT 'stratified 45% train, 5% validation, 50% test split' AS split_method, 42 AS seed,
       (SELECT count(*) FROM split WHERE split = 'train') AS train_samples,
       (SELECT count(*) FROM split WHERE split = 'validation') AS validation_samples,
       (SELECT count(*) FROM split WHERE split = 'test') AS test_samples,
       (SELECT count(*) FROM vocab WHERE kind = 'unigram') AS unigram_features,
       (SELECT count(*) FROM vocab WHERE kind = 'bigram') AS bigram_features,
       (SELECT count(*) FROM vocab) AS total_features,
       '{{"negative":0,"positive":1}}' AS labels
""")
def q_run_metadata(spark, sf):
    from glossa.operators.metadata import run_metadata
    s, train = train_tokens(spark, sf)
    return run_metadata(s, vocab.nb_vocabulary(train), seed=SEED).withColumn("labels", F.to_json("labels"))


@register("corpus_union", f"""
SELECT 'documents' AS origin, doc_id AS id, CAST(len({TOK('text')}) AS INTEGER) AS n_tokens FROM documents
UNION ALL
SELECT 'benchmark' AS origin, item_id AS id, CAST(len({TOK('text')}) AS INTEGER) AS n_tokens FROM benchmark
""")
def q_corpus_union(spark, sf):
    from glossa.operators.metadata import union_corpora
    d = text_table(spark, sf, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")
    b = text_table(spark, sf, "benchmark", "item_id", "text").withColumnRenamed("item_id", "id")
    u = union_corpora({"documents": d, "benchmark": b})
    return u.select("origin", "id", F.size(tx.tokenize("text")).alias("n_tokens"))


@register("prepare_corpus", f"""
WITH pooled AS (
  SELECT 'd' || CAST(d.doc_id AS VARCHAR) AS doc_id, d.text, CAST(l.quality AS TINYINT) AS label, 'documents' AS origin
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT 'c' || CAST(d.doc_id AS VARCHAR), d.text, CAST(l.quality AS TINYINT), 'copies'
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1),
split AS (
  SELECT doc_id, origin, label, text,
    CASE WHEN rk <= (n * 500000) // 1000000 THEN 'test' WHEN rk <= (n * 550000) // 1000000 THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || doc_id), doc_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM pooled)),
tok AS (SELECT doc_id, origin, label, split, {TOK('text')} AS t FROM split),
feats AS (SELECT DISTINCT doc_id, split, unnest(list_concat(t, {S.bigrams_sql('t')})) AS feature FROM tok),
known AS (SELECT DISTINCT feature FROM feats WHERE split = 'train'),
found AS (SELECT doc_id, count(*) AS n FROM feats JOIN known USING (feature) GROUP BY doc_id)
SELECT t.doc_id, t.origin, t.label, t.split, CAST(len(t.t) AS INTEGER) AS n_tokens, coalesce(f.n, 0) AS n_features
FROM tok t LEFT JOIN found f ON t.doc_id = f.doc_id
""")
def q_prepare_corpus(spark, sf):
    """H8 over two corpora that share texts (and come with ids that are unique only together with their origin's letter)."""
    from glossa.operators.prepare import prepare_corpus
    from glossa.sources.sinks import read_splits, work_folder
    from glossa.sources.versions import published

    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    part = lambda letter, df: df.select(
        F.concat(F.lit(letter), F.col("doc_id").cast("string")).alias("doc_id"), "text", F.col("quality").alias("label"))
    out = work_folder(spark, "prepare")
    prepare_corpus({"documents": part("d", both), "copies": part("c", both.filter("toxic = 1"))}, out, seed=SEED)
    counts = published(spark, f"{out}/features").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_features"))
    # the tokens are counted before the join, so that it does not move them
    rows = read_splits(spark, f"{out}/splits").select("doc_id", "origin", "label", "split", F.size("tokens").alias("n_tokens"))
    return rows.join(counts, "doc_id", "left").select(
        "doc_id", "origin", "label", "split", "n_tokens", F.coalesce("n_features", F.lit(0)).alias("n_features"))


@register("stored_predictions", f"""
WITH {PREDS_SQL}
SELECT model, doc_id, label, CASE WHEN model = 'm2' THEN label ELSE prediction END AS prediction FROM preds
""")
def q_stored_predictions(spark, sf):
    """Three models stored, one of them written again, all read back."""
    from glossa.sources import sinks

    out = sinks.work_folder(spark, "predictions")
    all_models = predictions(spark, sf)
    sinks.write_predictions(all_models, out)
    sinks.write_predictions(all_models.filter("model = 'm2'").withColumn("prediction", F.col("label")), out)
    return sinks.read_predictions(spark, out).select("model", "doc_id", "label", "prediction")


@register("summary_union", f"""
WITH {BUCKETS_SQL}
SELECT model, CAST(NULL AS INTEGER) AS bucket_id, 'all' AS length_bucket, CAST(sum(samples) AS BIGINT) AS samples
FROM summary GROUP BY model
UNION ALL
SELECT model, bucket_id, length_bucket, samples FROM summary
""")
def q_summary_union(spark, sf):
    per_bucket = ev.accuracy_by_length(predictions(spark, sf)).select("model", "bucket_id", "length_bucket", "samples")
    totals = per_bucket.groupBy("model").agg(F.sum("samples").cast("bigint").alias("samples")).select(
        "model", F.lit(None).cast("int").alias("bucket_id"), F.lit("all").alias("length_bucket"), "samples")
    return totals.unionByName(per_bucket)


# ---------------------------------------------------------------- SVM fit (H1-H3)

from glossa.operators import jobs, svm  # noqa: E402

SVM_C = 0.05
SVM_TOL = 1e-4  # of the gradient at zero weights
STEP = 0.001


def svm_cells() -> list:
    """The grid, C-major, in the order of ``_grid_cells``."""
    return [svm.Cell(c, f"ratio_{ai}") for _, c, _, ai in _grid_cells()]


def svm_inputs(spark, sf, alphas=tuple(ALPHAS), parts=("train", "validation", "test")):
    """(vocabulary, ratios per alpha, presence and document list by part) from one count table; presence is looked up once and landed."""
    s, train = train_tokens(spark, sf)
    featured = train.select("doc_id", "label", tx.feature_set("tokens").alias("features"))
    counted = nb.ratios_for_alphas(nb.class_doc_freq(nb.doc_features(featured)), list(alphas))
    names = tuple(f"ratio_{i}" for i in range(len(alphas)))
    indexed = cut_lineage(vocab.index_features(counted, keep=names))
    v = indexed.select("feature_id", "kind", "w1", "w2", "feature")
    part = lambda name: s.filter(F.col("split") == name)
    held = land(vocab.feature_id_rows(s.filter(F.col("split").isin(*parts)).select("doc_id", "split", tx.feature_set("tokens").alias("features")),
                                      v, keep_cols=("split",)))
    rows = {name: (held.filter(F.col("split") == name).select("doc_id", "feature_id"), part(name).select("doc_id", "label")) for name in parts}
    return v, indexed.select("feature_id", *names), rows


FIXED_SQL = f"""{GRID_SQL},
wv AS (SELECT feature_id, feature, 0.01::DOUBLE * (feature_id % 7 - 3) AS w FROM vocab),
rw AS (SELECT wv.feature_id, wv.feature, wv.w, gr.ai, gr.r FROM wv JOIN gr ON wv.feature = gr.feature),
td AS (SELECT doc_id, 2.0::DOUBLE * label - 1 AS y FROM stok WHERE split = 'train'),
tocc AS (SELECT doc_id, feature FROM occ WHERE split = 'train'),
mm AS (SELECT o.doc_id, rw.ai, sum(rw.r * rw.w) AS m FROM tocc o JOIN rw ON o.feature = rw.feature GROUP BY ALL),
sl AS (SELECT td.doc_id, td.y, a.ai, greatest(0, 1 - td.y * (coalesce(mm.m, 0) + 0.1::DOUBLE)) AS s
       FROM td CROSS JOIN alphas a LEFT JOIN mm ON mm.doc_id = td.doc_id AND mm.ai = a.ai),
pull AS (SELECT o.feature, sl.ai, sum(-2 * sl.y * sl.s) AS g FROM tocc o JOIN sl ON o.doc_id = sl.doc_id GROUP BY ALL),
gw AS (SELECT rw.feature_id, rw.ai, rw.w, rw.r * coalesce(pull.g, 0) AS g FROM rw LEFT JOIN pull ON pull.feature = rw.feature AND pull.ai = rw.ai)"""


def _fixed_state(ratios: DataFrame, cells) -> DataFrame:
    return ratios.withColumns({f"w{k}": 0.01 * ((F.col("feature_id") % 7) - 3) for k in range(len(cells))})


@register("svm_objective", f"""
WITH {FIXED_SQL},
per AS (SELECT ai, sum(s * s) AS l, sum(-2 * y * s) AS b FROM sl GROUP BY ai)
SELECT CAST(c.ci * {len(ALPHAS)} + a.ai AS INTEGER) AS cell_no, c.C, a.alpha,
  round(0.5 * ((SELECT sum(w * w) FROM wv) + 0.1::DOUBLE * 0.1::DOUBLE) + c.C * per.l, 3) AS objective,
  round((SELECT sum((gw.w + c.C * gw.g) * (gw.w + c.C * gw.g)) FROM gw WHERE gw.ai = a.ai) + pow(0.1::DOUBLE + c.C * per.b, 2), 3) AS grad_sq
FROM alphas a CROSS JOIN cs c JOIN per ON per.ai = a.ai
""")
def q_svm_objective(spark, sf):
    """H1, H2: objective and squared gradient norm of every cell at one fixed (w, b)."""
    _, ratios, rows = svm_inputs(spark, sf, parts=("train",))
    cells = svm_cells()
    _, got = svm.evaluate(svm.Matrix(*rows["train"], ratios), _fixed_state(ratios, cells), cells, [0.1] * len(cells))
    return spark.createDataFrame([(no, c, al, round(r["objective"], 3), round(r["grad_sq"], 3)) for (no, c, al, _), r in zip(_grid_cells(), got)],
                                 "cell_no int, C double, alpha double, objective double, grad_sq double")


@register("svm_step", f"""
WITH {FIXED_SQL}
SELECT feature_id, round(w - {STEP} * (w + {SVM_C}::DOUBLE * g), 6) + 0.0 AS w FROM gw WHERE ai = 0
""")
def q_svm_step(spark, sf):
    """H1: the weights after one fixed step against the gradient of the first cell."""
    _, ratios, rows = svm_inputs(spark, sf, ALPHAS[:1], ("train",))
    cells = [svm.Cell(SVM_C, "ratio_0")]
    state, _ = svm.evaluate(svm.Matrix(*rows["train"], ratios), _fixed_state(ratios, cells), cells, [0.1])
    return state.select("feature_id", (F.round(F.col("w0") - STEP * F.col("n0"), 6) + F.lit(0.0)).alias("w"))


@register("svm_fit")
def q_svm_fit(spark, sf):
    """H1 + H3: fit on the train part, report objective, convergence and accuracies (one row)."""
    v, ratios, rows = svm_inputs(spark, sf, [ALPHA], ("train", "validation"))
    cells = [svm.Cell(SVM_C, "ratio_0")]
    fitted = svm.fit(svm.Matrix(*rows["train"], ratios), ratios, cells, tol=SVM_TOL)
    right = lambda part: svm.scores(*rows[part], fitted, cells).agg(
        F.avg(((F.col("score0") > 0) == (F.col("label") == 1)).cast("double"))).first()[0]
    return spark.createDataFrame(
        [(ALPHA, SVM_C, v.count(), fitted.iterations, fitted.converged[0], fitted.objectives[0], fitted.grad_ratios[0], fitted.biases[0],
          right("train"), right("validation"))],
        "alpha double, C double, n_features long, iterations long, converged boolean, objective double, grad_ratio double, "
        "intercept double, train_accuracy double, validation_accuracy double")


@register("svm_predict")
def q_svm_predict(spark, sf):
    """H3 + H4: the training job saves its best cell, the evaluation job loads it and scores the test part."""
    from glossa.sources.sinks import load_model, work_folder

    v, ratios, rows = svm_inputs(spark, sf, [ALPHA])
    path = work_folder(spark, "svm")
    jobs.train(rows["train"], rows["validation"], ratios, [svm.Cell(SVM_C, "ratio_0")], [ALPHA], path, tol=SVM_TOL)
    out = jobs.evaluate(spark, path, *rows["test"], v.count())
    _, params = load_model(spark, path)
    return out.select("doc_id", "label", "score", "prediction", "correct", F.lit(params["converged"]).alias("converged"))


# ---------------------------------------------------------------- streaming form of H7

@register("stream_score", f"""
WITH {MODEL_SQL},
ct AS ({CONV_TOK}),
co AS (SELECT DISTINCT conv_id, turn, unnest(list_concat(t, {S.bigrams_sql('t')})) AS feature FROM ct),
cs AS (SELECT co.conv_id, co.turn, sum(m.ratio) AS sm FROM co JOIN model m ON co.feature = m.feature GROUP BY ALL)
SELECT ct.conv_id, ct.turn, round(coalesce(cs.sm, 0.0), 6) AS score, CAST(coalesce(cs.sm, 0.0) > 0 AS TINYINT) AS prediction
FROM ct LEFT JOIN cs ON ct.conv_id = cs.conv_id AND ct.turn = cs.turn
""")
def q_stream_score(spark, sf):
    """The conversations file read as a stream and scored per micro-batch with the batch pipeline."""
    from glossa.streaming.scoring import read_scored, score_stream, table_stream

    _, v, model = nb_model(spark, sf)
    schema = table(spark, sf, "conversations").select("conv_id", "turn", "text").schema
    stream = table_stream(spark, sf, "conversations", schema)
    query, out = score_stream(stream, lambda b: score_texts(b, v, model))
    query.awaitTermination()
    return read_scored(spark, out).select("conv_id", "turn", "score", "prediction")


@register("svm_grid_search")
def q_svm_grid_search(spark, sf):
    """H2 + D16: SVM fits of every (C, alpha) cell, validation accuracy, best cell flagged.

    The alpha-free counts are computed once; each alpha is a projection of
    them, and all sixteen fits share every data pass.
    """
    _, ratios, rows = svm_inputs(spark, sf, parts=("train", "validation"))
    cells = svm_cells()
    results, _ = svm.grid_search(svm.Matrix(*rows["train"], ratios), ratios, cells, *rows["validation"], tol=SVM_TOL)
    return spark.createDataFrame(
        [(r["cell_no"], r["C"], alpha, r["validation_accuracy"], r["objective"], r["grad_ratio"], r["converged"], r["is_best"])
         for r, (_, _, alpha, _) in zip(results, _grid_cells())],
        "cell_no int, C double, alpha double, validation_accuracy double, objective double, grad_ratio double, converged boolean, is_best boolean")
