"""Quality rules by distribution divergence (operator 5).

Each document's histogram of character classes and its histogram of common
words are compared with the reference of its language (the pooled histograms
of every document of that language) by the Jensen-Shannon distance.  A
document is rejected when a distance exceeds its limit, and only if it is long
enough for that histogram to mean something; the plain length and repetition
rules stand beside it.

The limit of the common words follows the reference: a text without any common
word has a distance that depends only on the common words' share of the
reference, and where junk or a short list lowers it, the limit sinks with it.
A text that holds common words is excused the sampling noise of its length, up
to the fixed limit; one that holds more of them than the reference, or whose
language has no list, has the fixed limit alone.

One pass over the texts: the per-document counts are checkpointed (a few
dozen numbers a row); references and verdicts are built from them.

Defined cases: null or blank text has no words (rejected by the length rule);
null language: the document is judged against the reference of every listed
language and kept if one of them would keep it (a listed language that no
document names gets its reference from the documents without language that
hold enough of its common words; without any reference only the length and
repetition rules apply); a language without a list is judged against the
listed ones and its own, with the words of all lists; repeated rows are judged
one by one and each counts in the reference; an empty table gives an empty result; further
columns are kept by ``filter_documents`` and ignored by ``judge``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import let, read_table, sealed, unsealed, words
from glossa.session import cut_lineage

# Common words of each language (lists of function words).
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "auf", "für", "ist", "im", "des", "eine"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "para"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"],
}
ALL_WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
CHAR_GUARD = 200      # characters a text needs before its class histogram is judged
WORD_GUARD = 50       # words a text needs before its common-word histogram is judged
MAX_CHAR_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.297
BARE_SHARE = 0.985    # of the distance that a text without any common word has: no limit lies above it
BARE_CHANCE = 0.001   # a text has none by chance more often than this: the limit stays
NOISE = 4             # standard deviations of sampling noise that a text's length excuses
GUESS_SHARE = 0.08    # share of a list's words that makes a text without language count as that language


def _repeat_words(ws: Column, n: Column) -> Column:
    """Words lying in a 3-word window that the text holds twice or more.

    Windows are hashed; one long packs a window's hash (upper bits) with its
    position (as few lower bits as the text needs), so that sorting a plain
    long array brings equal windows together, hot windows included.
    """
    def packed(bits: Column, hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda h, i: F.call_function(
            "shiftleft", F.call_function("shiftright", h, bits), bits).bitwiseOR(i.cast("long"))))

    def positions(keys: Column, bits: Column) -> Column:
        top = lambda x: F.call_function("shiftrightunsigned", x, bits)
        same = lambda x, y: F.coalesce(top(x.bitwiseXOR(y)) == 0, F.lit(False))
        twice = F.filter(keys, lambda x, i: same(x, F.get(keys, i - 1)) | same(x, F.get(keys, i + 1)))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask)))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - p, F.lit(3).cast("long"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        bits = F.length(F.bin(n.cast("long")))
        some = let(packed(bits, hashes), lambda keys: let(positions(keys, bits), covered))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), some).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]))
    return F.when(n >= 4, let(hashes, count)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``keep`` plus the counts of every whole text, in columns ``_q_*``."""
    t, n = F.col("_q_text"), F.col("_q_n")
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_q_text"), F.col(lang).alias("_q_lang"))
    df = df.withColumns({"_q_words": words(t), "_q_lines": F.split(t, "\n")})
    listed = F.create_map(*[x for k, ws in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))])
    df = df.withColumns({
        "_q_n": F.size("_q_words"),
        "_q_word_chars": F.length(F.array_join("_q_words", "")),
        "_q_list": F.coalesce(F.try_element_at(listed, F.col("_q_lang")), F.array(*map(F.lit, ALL_WORDS))),
    })
    counts = {c: F.regexp_count(t, F.lit(p)) for c, p in
              (("symbols", r"[#*$%&|<>]"), ("digits", r"\d"), ("upper", r"\p{Lu}"), ("points", r"[.,;:!?'\x22()\-]"))}
    solid = F.filter(F.col("_q_lines"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = let(
        F.filter(F.col("_q_words"), lambda w: w.isin(ALL_WORDS)),
        lambda found: F.transform(F.col("_q_list"), lambda w: F.size(F.filter(found, lambda x: x == w))))
    return df.select(
        *keep, "_q_lang", F.length(t).alias("_q_chars"),
        n.cast("long").alias("_q_n"), F.col("_q_word_chars").cast("long"),
        *[v.cast("long").alias(f"_q_{c}") for c, v in counts.items()],
        let(solid, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("_q_dup_lines"),
        _repeat_words(F.col("_q_words"), n).alias("_q_repeat"), common.alias("_q_common"))


def _histograms(df: DataFrame) -> DataFrame:
    """Adds ``_q_hc`` (character classes) and ``_q_hw`` (common words, then all others)."""
    rest = F.greatest(F.lit(0), F.col("_q_word_chars") - F.col("_q_symbols") - F.col("_q_digits") - F.col("_q_upper")
                      - F.col("_q_points"))
    classes = [F.col("_q_chars") - F.col("_q_word_chars"), "_q_symbols", "_q_digits", "_q_upper", "_q_points", rest]
    others = F.col("_q_n") - F.aggregate("_q_common", F.lit(0), lambda a, x: a + x)
    as_double = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return df.withColumns({
        "_q_hc": F.array(*map(as_double, classes)),
        "_q_hw": F.concat(F.transform("_q_common", lambda x: x.cast("double")), F.array(as_double(others)))})


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _of_list(hw: Column, places: Column) -> Column:
    """The histogram over the words at ``places`` (and all others) from the one over the words of all lists."""
    return let(F.transform(places, lambda i: F.get(hw, i)), lambda found: F.concat(found, F.array(_total(hw) - _total(found))))


def _places(lang: str) -> Column:
    return F.array(*[F.lit(ALL_WORDS.index(w)) for w in COMMON_WORDS[lang]])


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of equal length; 0 if either is empty."""
    share = lambda a: let(_total(a), lambda s: F.transform(a, lambda x: x / s))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = lambda a, b: F.sqrt(F.greatest(F.lit(0.0), _total(F.zip_with(
        a, b, lambda x, y: 0.5 * (term(x, (x + y) / 2) + term(y, (x + y) / 2))))))
    return F.when((_total(p) > 0) & (_total(q) > 0), both(share(p), share(q))).otherwise(0.0)


def word_limit(h: Column, ref: Column, n: Column, highest: float) -> Column:
    """The largest common-word distance to ``ref`` that a text of ``n`` words and histogram ``h`` may have."""
    last = F.size(ref) - 1
    bare = BARE_SHARE * js_distance(F.transform(ref, lambda x, i: F.when(i == last, 1.0).otherwise(0.0)), ref)
    # 8 n ln(2) times the squared distance of a sample to its own source is nearly chi-squared
    noise = F.sqrt((last + NOISE * F.sqrt(2.0 * last)) / (8 * math.log(2) * F.greatest(n, F.lit(1))))
    others = lambda a: F.try_divide(F.element_at(a, -1), _total(a))
    telling = -n * F.log(others(ref)) > -math.log(BARE_CHANCE)
    return F.least(F.lit(highest), F.when(others(h) <= others(ref), highest).when(others(h) < 1, F.greatest(bare, noise))
                   .when(telling, bare).otherwise(highest))


def references(measured: DataFrame) -> DataFrame:
    """One row per language: the summed histograms of all its documents.

    Documents without language are summed by the list whose words they hold
    most (``_q_guess``, null if too few), as histograms of that list.
    """
    sums = lambda c, n: F.array(*[F.sum(F.get(F.col(c), F.lit(i))) for i in range(n)])
    width = max(len(ALL_WORDS), *map(len, COMMON_WORDS.values())) + 1
    hw = F.col("_q_hw")
    most = F.array_max(F.array(*[F.struct((1 - F.element_at(_of_list(hw, _places(k)), -1) / F.col("_q_n")).alias("share"), F.lit(k).alias("lang"))
                                 for k in COMMON_WORDS]))
    guess = F.when(F.col("_q_lang").isNull() & (F.col("_q_n") >= WORD_GUARD), let(
        most, lambda m: F.when(m["share"] >= GUESS_SHARE, m["lang"])))
    df = _histograms(measured).groupBy(F.col("_q_lang").alias("_q_ref"), guess.alias("_q_guess")).agg(
        sums("_q_hc", 6).alias("_q_rc"),
        F.filter(sums("_q_hw", width), lambda x: x.isNotNull()).alias("_q_rw"))
    rw = F.col("_q_rw")
    for k in COMMON_WORDS:
        rw = F.when(F.col("_q_guess") == k, _of_list(F.col("_q_rw"), _places(k))).otherwise(rw)
    return df.withColumn("_q_rw", rw)


def _listed(known: DataFrame) -> Column:
    """The references of the listed languages (two rows each at most reach the driver) as an array of constants."""
    rows = known.filter(F.coalesce("_q_ref", "_q_guess").isin(list(COMMON_WORDS))).collect()
    by_lang = {r["_q_ref"] or r["_q_guess"]: r for r in sorted(rows, key=lambda r: r["_q_ref"] is not None)}
    doubles = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    return F.array(*[F.struct(_places(k).alias("places"), doubles(r["_q_rc"]).alias("rc"), doubles(r["_q_rw"]).alias("rw"))
                     for k, r in sorted(by_lang.items())]).cast(_CANDIDATES)


_CANDIDATES = "array<struct<places:array<int>,rc:array<double>,rw:array<double>>>"


def judge(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang",
          max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """``keep`` plus counts, both distances, ``_q_base_failed`` and ``_q_kept``, one row per input row."""
    measured = cut_lineage(measures(docs, keep, text, lang))
    known = cut_lineage(references(measured))
    df = _histograms(measured).join(known.filter(F.col("_q_ref").isNotNull()), F.col("_q_lang") == F.col("_q_ref"), "left")
    own = F.array(F.struct(F.lit(None).cast("array<int>").alias("places"), F.col("_q_rc").alias("rc"), F.col("_q_rw").alias("rw"))).cast(_CANDIDATES)
    listed = _listed(known)
    against = F.when(F.col("_q_lang").isNull(), listed).when(F.col("_q_lang").isin(list(COMMON_WORDS)), own).otherwise(F.concat(listed, own))

    def verdict(c: Column) -> Column:
        hw = F.when(c["places"].isNull(), F.col("_q_hw")).otherwise(_of_list(F.col("_q_hw"), c["places"]))
        distances = let(hw, lambda h: F.struct(
            js_distance(h, c["rw"]).alias("dw"), js_distance(F.col("_q_hc"), c["rc"]).alias("dc"),
            F.when(c["places"].isNotNull() | F.col("_q_lang").isin(list(COMMON_WORDS)), word_limit(h, c["rw"], F.col("_q_n"), max_word_distance))
            .otherwise(max_word_distance).alias("limit")))
        far = lambda d: ((F.col("_q_chars") >= CHAR_GUARD) & (d["dc"] > max_char_distance)) | (
            (F.col("_q_n") >= WORD_GUARD) & (d["dw"] > d["limit"]))
        return let(distances, lambda d: F.struct(far(d).alias("far"), d["dw"].alias("dw"), d["dc"].alias("dc")))

    none = F.struct(F.lit(False).alias("far"), F.lit(0.0).alias("dw"), F.lit(0.0).alias("dc"))
    df = df.withColumn("_q_best", F.coalesce(F.array_min(F.transform(against, verdict)), none))
    failed = (F.col("_q_n") < MIN_WORDS) | (100 * F.col("_q_repeat") > MAX_REPEAT_PCT * F.col("_q_n"))
    df = df.withColumns({"_q_dc": F.col("_q_best.dc"), "_q_dw": F.col("_q_best.dw"), "_q_base_failed": failed})
    return df.withColumn("_q_kept", ~F.col("_q_base_failed") & ~F.col("_q_best.far"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    Only keys of rejected texts are shuffled against the table: documents of
    the same doc_id, text and language share a verdict, so this key needs no
    unique doc_id.
    """
    kept, at = sealed(docs)
    doc_id, text, lang = (F.col(at[c]) for c in ("doc_id", "text", "lang"))
    judged = judge(docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("_q_hash")), ["doc_id", "_q_hash"])
    rejected = judged.filter(~F.col("_q_kept")).select(
        F.col("doc_id").alias("_q_id"), "_q_hash", F.col("_q_lang").alias("_q_key_lang")).distinct()
    return kept.join(rejected, doc_id.eqNullSafe(F.col("_q_id")) & (F.xxhash64(text) == F.col("_q_hash"))
                     & lang.eqNullSafe(F.col("_q_key_lang")), "left_anti").select(*unsealed(at))


def op5_quality_rules(spark, sf_dir) -> DataFrame:
    """Contract query over ``documents``."""
    out = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return out.select(
        "doc_id", F.col("_q_n").alias("n_words"), F.col("_q_word_chars").alias("word_chars"), F.col("_q_symbols").alias("n_symbols"),
        F.col("_q_dup_lines").alias("n_dup_lines"), F.col("_q_repeat").alias("n_repeat_words"),
        F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"),
        F.round("_q_dc", 6).alias("char_distance"), F.round("_q_dw", 6).alias("word_distance"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SQL_DISTANCE = """CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(
  list_zip(list_transform({p}, lambda x: x / list_sum({p})), list_transform({q}, lambda x: x / list_sum({q}))),
  lambda z: 0.5 * (CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END
                 + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END))))) ELSE 0 END"""

_SQL_COUNT = "length(text) - length(regexp_replace(text, '{}', '', 'g'))"

ORACLE_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
    CASE lang {" ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in COMMON_WORDS.items())} ELSE {_sql_list(ALL_WORDS)} END AS listed
  FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
grams AS (
  SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, lang, length(text) AS chars, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    {_SQL_COUNT.format("[#*$%&|<>]")} AS n_symbols, {_SQL_COUNT.format("[0-9]")} AS digits, {_SQL_COUNT.format("[[:upper:]]").replace("[[:upper:]]", chr(92) + "p{Lu}")} AS upper,
    {_SQL_COUNT.format("[.,;:!?''" + chr(92) + "x22()" + chr(92) + "-]")} AS points,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    list_transform(listed, lambda x: len(list_filter(ws, lambda y: y = x))::DOUBLE) AS common
  FROM w LEFT JOIN covered ON covered.rid = w.rid),
h AS (
  SELECT *, list_transform([chars - word_chars, n_symbols, digits, upper, points,
      greatest(0, word_chars - n_symbols - digits - upper - points)], lambda x: x::DOUBLE) AS hc,
    list_append(common, n_words - coalesce(list_sum(common), 0)) AS hw FROM m),
parts AS (
  SELECT lang, 0 AS kind, generate_subscripts(hc, 1) AS k, unnest(hc) AS x FROM h
  UNION ALL SELECT lang, 1, generate_subscripts(hw, 1), unnest(hw) FROM h),
sums AS (SELECT lang, kind, k, sum(x) AS x FROM parts GROUP BY ALL),
refs AS (SELECT lang, list(x ORDER BY k) FILTER (kind = 0) AS rc, list(x ORDER BY k) FILTER (kind = 1) AS rw FROM sums GROUP BY lang),
far AS (
  SELECT h.*, {_SQL_DISTANCE.format(p="hc", q="rc")} AS dc, {_SQL_DISTANCE.format(p="hw", q="rw")} AS dw,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed
  FROM h JOIN refs ON h.lang IS NOT DISTINCT FROM refs.lang)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, round(dc, 6) AS char_distance, round(dw, 6) AS word_distance, base_failed,
  NOT (base_failed OR (chars >= {CHAR_GUARD} AND dc > {MAX_CHAR_DISTANCE}) OR (n_words >= {WORD_GUARD} AND dw > {MAX_WORD_DISTANCE})) AS kept
FROM far
"""
