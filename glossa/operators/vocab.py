"""Vocabularies and id lookups.

Vocabularies are tables, never driver dictionaries.  Distinct features come
from a grouped shuffle (partial de-duplication per task first), ids from the
distributed dense index in code-point order, exactly like sorting in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions.text import explode_items, feature_set
from glossa.operators.membership import bit_filter, maybe_members, surely_absent
from glossa.plans.ranking import dense_index

# The reserved sequence tokens and their ids.
PAD_TOKEN, UNK_TOKEN, BOS_TOKEN, EOS_TOKEN = "[PAD]", "[UNK]", "[BOS]", "[EOS]"
RESERVED_TOKENS = [PAD_TOKEN, UNK_TOKEN, BOS_TOKEN, EOS_TOKEN]
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3


def distinct_tokens(tokenized: DataFrame, tokens_col: str = "tokens", token_col: str = "token") -> DataFrame:
    """Distinct unigrams of a tokenised table."""
    return explode_items(tokenized, F.array_distinct(tokens_col), token_col).distinct()


def distinct_features(tokenized: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """D1+D2: distinct unigrams and bigrams (bigram = 'w1 w2'), with their kind."""
    feats = explode_items(tokenized, feature_set(tokens_col), "feature").distinct()
    return feats.withColumn("kind", F.when(F.col("feature").contains(" "), F.lit("bigram")).otherwise(F.lit("unigram")))


def nb_vocabulary(tokenized: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """D3: unigrams sorted get ids 0..U-1, bigrams sorted get U..U+B-1.

    Output ``(feature_id BIGINT, kind, w1, w2, feature)``; ``w2`` null for unigrams.
    """
    return index_features(distinct_features(tokenized, tokens_col))


def index_features(feats: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """D3 ids for a table of distinct ``feature`` strings (any extra columns in ``keep`` ride along).

    Used directly on the class-count table, whose keys are exactly the
    training features, so the vocabulary needs no pass of its own.
    """
    is_bigram = F.col("feature").contains(" ")
    ranked = dense_index(feats.select("feature", *keep, F.when(is_bigram, F.lit(1)).otherwise(F.lit(0)).alias("_ko")),
                         ["_ko", "feature"], index_col="feature_id")
    return ranked.select(
        "feature_id",
        F.when(is_bigram, F.lit("bigram")).otherwise(F.lit("unigram")).alias("kind"),
        F.substring_index("feature", " ", 1).alias("w1"),
        F.when(is_bigram, F.substring_index("feature", " ", -1)).alias("w2"),
        "feature", *keep,
    )


def seq_vocabulary(tokenized: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """[PAD]=0, [UNK]=1, [BOS]=2, [EOS]=3, then the sorted tokens from 4.

    A corpus token equal to a reserved one keeps the reserved id.
    """
    spark = tokenized.sparkSession
    reserved = spark.createDataFrame([(i, t) for i, t in enumerate(RESERVED_TOKENS)],
                                     T.StructType([T.StructField("token_id", T.LongType(), False),
                                                   T.StructField("token", T.StringType(), False)]))
    words = distinct_tokens(tokenized, tokens_col).filter(~F.col("token").isin(*RESERVED_TOKENS))
    ranked = dense_index(words, ["token"], index_col="token_id", start=len(RESERVED_TOKENS))
    return reserved.unionByName(ranked.select("token_id", "token"))


def vocab_sizes(nb_vocab: DataFrame) -> DataFrame:
    """Feature counts by kind and in total (one row)."""
    return nb_vocab.agg(
        F.count_if(F.col("kind") == "unigram").alias("unigram_features"),
        F.count_if(F.col("kind") == "bigram").alias("bigram_features"),
        F.count(F.lit(1)).alias("total_features"),
    )


def feature_ids(featured: DataFrame, nb_vocab: DataFrame, features_col: str = "features",
                keep_cols: tuple[str, ...] = (), key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """C1 + B11: per document the sorted ids of its known features; unknown dropped.

    Documents without any known feature keep an empty array, exactly like an
    empty CSR row: the outer explode leaves them a null feature, the left join
    no id, and ``collect_list`` skips it, so no join back to the documents.
    """
    exploded = featured.select(*key, *keep_cols, F.explode_outer(features_col).alias("feature"))
    looked = exploded.join(nb_vocab.select("feature", "feature_id"), "feature", "left")
    return looked.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in keep_cols], F.sort_array(F.collect_list("feature_id")).alias("feature_ids"))


def feature_id_rows(featured: DataFrame, nb_vocab: DataFrame, features_col: str = "features",
                    keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """C1 long form: ``(doc_id, feature_id)`` presence rows (the sparse matrix)."""
    exploded = explode_items(featured, features_col, "feature", "doc_id", *keep_cols)
    return exploded.join(nb_vocab.select("feature", "feature_id"), "feature").drop("feature")


def token_ids(tokenized: DataFrame, seq_vocab: DataFrame, tokens_col: str = "tokens",
              keep_cols: tuple[str, ...] = (), key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids in text order, unknown -> [UNK]=1.

    Occurrences are exploded with their position, left-joined to the
    vocabulary (AQE splits the partitions of very frequent tokens) and
    re-assembled per document by position.  Empty documents keep []: their
    null position of the outer explode gives no pair to collect.
    """
    occ = tokenized.select(*key, *keep_cols, F.posexplode_outer(tokens_col).alias("pos", "token"))
    looked = occ.join(seq_vocab.select("token", "token_id"), "token", "left")
    pair = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(UNK_ID)).alias("id")))
    return looked.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in keep_cols], F.sort_array(F.collect_list(pair)).alias("_p")
    ).withColumn("token_ids", F.col("_p.id")).drop("_p")


def reverse_lookup(ids: DataFrame, vocab: DataFrame, id_col: str = "token_id", token_col: str = "token") -> DataFrame:
    """Id -> token (inner equi join on the id)."""
    return ids.join(vocab.select(id_col, token_col), id_col)


def decode_ids(encoded: DataFrame, seq_vocab: DataFrame, ids_col: str = "token_ids",
               key: tuple[str, ...] = ("doc_id",), out_col: str = "decoded") -> DataFrame:
    """C3 on sequences: id arrays back to token arrays (itos), order kept."""
    occ = explode_items(encoded, ids_col, "token_id", *key, with_pos="pos")
    named = reverse_lookup(occ, seq_vocab)
    per_doc = named.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_p"))
    per_doc = per_doc.select(*key, F.col("_p.token").alias(out_col))
    return encoded.select(*key).join(per_doc, list(key), "left").withColumn(
        out_col, F.coalesce(out_col, F.array().cast("array<string>")))


def oov_tokens(tokenized: DataFrame, seq_vocab: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """C4: occurrences whose token is not in the vocabulary (left anti join); the token arrays stay behind.

    Occurrences that the vocabulary's bit filter rules out are unknown without
    a join; only the others are shuffled for the exact anti join.
    """
    occ = explode_items(tokenized, tokens_col, "token", *[c for c in tokenized.columns if c != tokens_col])
    bits = bit_filter(seq_vocab, F.col("token"))
    rest = maybe_members(occ, F.col("token"), bits).join(seq_vocab.select("token"), "token", "left_anti")
    return surely_absent(occ, F.col("token"), bits).unionByName(rest)


def oov_rate(tokenized: DataFrame, seq_vocab: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """C4: occurrences, unknown occurrences and their share (one row).

    Counting by distinct token first keeps the join small: each distinct
    token is looked up once, weighted by its frequency.
    """
    freq = explode_items(tokenized, tokens_col, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    marked = freq.join(seq_vocab.select("token", F.lit(1).alias("_known")), "token", "left")
    return marked.agg(
        F.sum("n").alias("tokens"),
        F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(F.lit(0))).alias("oov_tokens"),
    ).withColumn("oov_rate", F.col("oov_tokens") / F.col("tokens"))
