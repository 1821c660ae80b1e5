"""Column functions for text normalisation, tokens, n-grams and length buckets.

Every function maps Column -> Column and stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.entities import decode_references

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical tokens.
# Tag pattern, the four irregular contractions in their order of application,
# the general negation rule, and the word class (letters, digits, underscore).
TAG_PATTERN = "<[^>]+>"
IRREGULAR_CONTRACTIONS = [
    ("won't", "will not"),
    ("can't", "can not"),
    ("shan't", "shall not"),
    ("ain't", "is not"),
]
TYPOGRAPHIC_APOSTROPHE = "’"
WORD_CLASS = r"[\p{L}\p{N}_]"
# Length buckets: right-closed edges 100/200/300/400, zero joins the first one.
LENGTH_EDGES = [100, 200, 300, 400]
LENGTH_LABELS = [
    "1-100 words",
    "101-200 words",
    "201-300 words",
    "301-400 words",
    "More than 400 words",
]
# ---------------------------------------------------------------------------

NEGATION_PATTERN = f"(?<!{WORD_CLASS})({WORD_CLASS}+)n't(?!{WORD_CLASS})"
WORD_PATTERN = f"({WORD_CLASS}+)"
# Java white space as Python's str.split() sees it: Unicode white space plus
# the four information separators U+001C..U+001F.
WHITESPACE_PATTERN = r"[\s\p{Z}\u0085\u001c-\u001f]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_tags(text) -> Column:
    """B1: every ``<...>`` tag becomes one space, so words never glue together."""
    t = _col(text)
    return F.when(t.contains("<"), F.regexp_replace(t, TAG_PATTERN, " ")).otherwise(t)


def unescape_entities(text) -> Column:
    """B2: HTML5 character references decoded once (named, decimal, hex).

    A reference starts with ``&`` followed by ``#`` or an ASCII letter (every
    named entity is ASCII); other rows keep their value unread.
    """
    t = _col(text)
    return F.when(t.contains("&") & t.rlike("&[#A-Za-z]"), decode_references(t)).otherwise(t)


def _plain_apostrophe(t: Column) -> Column:
    # not translate(): that looks every character of the text up in a map
    return F.replace(t, F.lit(TYPOGRAPHIC_APOSTROPHE), F.lit("'"))


def _irregular_forms(t: Column) -> Column:
    out = t
    for short, full in IRREGULAR_CONTRACTIONS:
        out = F.replace(out, F.lit(short), F.lit(full))
    return F.when(t.contains("'"), out).otherwise(t)


def _negations(t: Column) -> Column:
    return F.when(t.contains("n't"), F.regexp_replace(t, NEGATION_PATTERN, "$1 not")).otherwise(t)


def expand_contractions(text) -> Column:
    """Typographic apostrophe, the irregular forms, then ``<word>n't`` (each step's text bound once, as the next reads it several times)."""
    bound = F.array(_col(text))
    for step in (_plain_apostrophe, _irregular_forms, _negations):
        bound = F.transform(bound, step)
    return bound.getItem(0)


def normalize(text) -> Column:
    """B1-B6 in the reference order: tags, entities, lower case, apostrophes."""
    return expand_contractions(F.lower(unescape_entities(strip_tags(text))))


def words(text) -> Column:
    """Maximal runs of letters, digits and underscore."""
    return F.regexp_extract_all(_col(text), F.lit(WORD_PATTERN), 1)


def tokenize(text) -> Column:
    """The whole tokeniser; null text gives a null array (caller decides)."""
    return words(normalize(text))


def bigrams(tokens) -> Column:
    """Adjacent pairs joined by one space; empty for fewer than two tokens.

    Space sorts below every word character, so ordering the joined strings
    equals ordering the (w1, w2) pairs.
    """
    t = _col(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def feature_set(tokens) -> Column:
    """Distinct unigrams and bigrams of one document (presence only)."""
    t = _col(tokens)
    return F.array_distinct(F.concat(t, bigrams(t)))


def explode_items(df, array_col, alias: str, *keep, with_pos: str | None = None):
    """One row per array element, nothing for empty or null arrays.

    ``explode_outer`` plus a null filter instead of ``explode``: for a plain
    explode Catalyst infers ``size(array) > 0`` and pushes that predicate,
    with the whole tokeniser expression inlined, below joins and exchanges,
    where it runs the regex chain again for every row.
    """
    arr = F.col(array_col) if isinstance(array_col, str) else array_col
    if with_pos:
        out = df.select(*keep, F.posexplode_outer(arr).alias(with_pos, alias))
    else:
        out = df.select(*keep, F.explode_outer(arr).alias(alias))
    return out.filter(F.col(alias).isNotNull())


def word_count(text) -> Column:
    """White-space separated words; null text counts as 0."""
    parts = F.split(F.coalesce(_col(text), F.lit("")), WHITESPACE_PATTERN)
    return F.size(F.filter(parts, lambda x: x != F.lit("")))


def length_bucket_id(n_words) -> Column:
    """0..4 for (-inf,100], (100,200], (200,300], (300,400], (400,inf)."""
    n = _col(n_words)
    expr = F.when(n <= LENGTH_EDGES[0], F.lit(0))
    for i, edge in enumerate(LENGTH_EDGES[1:], start=1):
        expr = expr.when(n <= edge, F.lit(i))
    return expr.otherwise(F.lit(len(LENGTH_EDGES)))


def length_bucket_label(bucket_id) -> Column:
    """Label text of a bucket id."""
    return F.element_at(F.array(*[F.lit(x) for x in LENGTH_LABELS]), _col(bucket_id) + 1)


def correct_flag(label, prediction) -> Column:
    """1 when label equals prediction, comparison with null gives 0."""
    return F.coalesce(_col(label) == _col(prediction), F.lit(False)).cast("int")


def head_truncate(tokens, max_length: int = 128) -> Column:
    """First ``max_length`` tokens."""
    return F.slice(_col(tokens), 1, max_length)


def percent_label(x, decimals: int = 2) -> Column:
    """``0.9094`` -> ``'90.94%'``."""
    return F.format_string(f"%.{decimals}f%%", _col(x) * 100)
