"""Secret scan with sliding-window entropy (operator 3), in SQL functions only.

Three plain patterns give the base spans.  In the text between base spans,
every run of 20 or more characters of the base64 and url alphabets is a
candidate: its character class (hex, mixed case with digits, one case with
digits, mixed case without digits) sets the limit, and a window of 20 characters slides over the run.
The window's counts are updated by the character that enters and the one that
leaves, and with them the sum of c log2 c that gives its Shannon entropy.  The
run is a secret if any window reaches its class's limit, unless the allow list
matches the whole of it (uuids, digit strings, dates, slugs and paths).

Spans are in code points, end exclusive.  Positions come from the lengths of
what a pattern matches and what lies between, summed in blocks, so a long text
with many matches costs linear work and nothing is shuffled.

Defined cases: null text is empty; repeated rows are scanned each; texts of any
length are scanned whole; empty table: empty result; further columns are
ignored by the query and kept by ``scan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import let, read_table

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 or more from its first AKIA; a shorter one holds no longer match
HEX = r"[0-9a-f]{24,}"
KNOWN = f"{ACCESS}|{HEX}"
MIN_VALUE = 6

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9TZ/_+-]*$",
    r"^/?[A-Za-z]+([/_-]([A-Za-z]+|[0-9]+))+/?$",
]
LIMITS = {"hex": 2.9, "mixed": 3.7, "single": 3.5, "letters": 3.9}
_BLOCK = 256


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it, by blocks."""
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    n = F.size(lengths)
    blocks = upto(F.ceil(n / _BLOCK).cast("int"), lambda b: _total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))))
    bases = let(blocks, lambda t: F.transform(t, lambda _, b: _total(F.slice(t, F.lit(1), b))))
    return let(bases, lambda base: upto(n, lambda i: base[(i / _BLOCK).cast("int")] + _total(
        F.slice(lengths, (i - i % _BLOCK) + 1, i % _BLOCK))))


def _pieces(text: Column, pattern: str) -> Column:
    """Array of (start, between, at, hit): text between matches and the match behind it (null behind the last)."""
    def joined(between: Column, hits: Column) -> Column:
        size = lambda x: F.coalesce(F.length(x), F.lit(0)).cast("long")
        pairs = F.arrays_zip(between.alias("between"), hits.alias("hit"))
        return let(pairs, lambda p: let(
            _sums_before(F.transform(p, lambda x: size(x["between"]) + size(x["hit"]))),
            lambda starts: F.transform(p, lambda x, i: F.struct(
                starts[i].alias("start"), x["between"].alias("between"), (starts[i] + size(x["between"])).alias("at"), x["hit"].alias("hit")))))

    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), text.alias("between"), F.length(text).cast("long").alias("at"),
                             F.lit(None).cast("string").alias("hit")))
    found = let(F.split(text, pattern, -1), lambda b: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: joined(b, h)))
    return F.when(text.rlike(pattern), found).otherwise(whole)


def _spans(pieces: Column, shift: Column | None = None) -> Column:
    """Array of (start, end, hit) of the matches."""
    hits = F.filter(pieces, lambda p: p["hit"].isNotNull())
    shift = F.lit(0).cast("long") if shift is None else shift
    return F.transform(hits, lambda p: F.struct((p["at"] + shift).alias("start"), (p["at"] + shift + F.length(p["hit"])).alias("end"), p["hit"].alias("hit")))


def max_entropy(run: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits) of any window of ``window`` characters of ``run``, by incremental counts."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])

    def slide(codes: Column) -> Column:
        zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))

        def step(state: Column, i: Column) -> Column:
            enters, leaves = codes[i], F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            counts = state["counts"]
            more = F.get(counts, enters)
            less = F.coalesce(F.get(counts, leaves), F.lit(0))
            change = F.when(enters == leaves, F.lit(0.0)).otherwise(
                F.get(weight, more + 1) - F.get(weight, more)
                + F.when(less > 0, F.get(weight, less - 1) - F.get(weight, less)).otherwise(F.lit(0.0)))
            return let(state["sum"] + change, lambda s: F.struct(
                F.transform(counts, lambda c, j: c + (j == enters).cast("int") - (j == leaves).cast("int")).alias("counts"),
                s.alias("sum"),
                F.when((i >= window - 1) & (s < state["least"]), s).otherwise(state["least"]).alias("least")))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda s: F.lit(math.log2(window)) - s["least"] / window)

    codes = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.instr(F.lit(ALPHABET), F.substring(run, i, F.lit(1))) - 1)
    return let(codes, slide)


def _limit(run: Column) -> Column:
    """Entropy that makes a run of its character class a secret; null for classes that are never one."""
    digit, upper, lower = run.rlike("[0-9]"), run.rlike("[A-Z]"), run.rlike("[a-z]")
    return (F.when(~digit & upper & lower, F.lit(LIMITS["letters"]))
            .when(~digit | ~(upper | lower), F.lit(None).cast("double")).when(run.rlike("^[0-9a-fA-F]+$"), F.lit(LIMITS["hex"]))
            .when(upper & lower, F.lit(LIMITS["mixed"])).otherwise(F.lit(LIMITS["single"])))


def _is_secret(run: Column, allow: list[str]) -> Column:
    listed = F.lit(False)
    for p in allow:
        listed = listed | run.rlike(p)
    return F.when(_limit(run).isNull() | listed, F.lit(False)).otherwise(max_entropy(run) >= _limit(run))


def scan(docs: DataFrame, text: str = "text", allow: list[str] | None = None) -> DataFrame:
    """``docs`` plus ``_x_assign``, ``_x_access``, ``_x_hex`` and ``_x_entropy``: arrays of (start, end, hit)."""
    allow = ALLOW if allow is None else allow
    t = F.col("_x_text")
    df = docs.withColumn("_x_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_x_parts", _pieces(t, ASSIGN))
    # between assignments, and there between the other base spans
    runs = lambda part, start: F.filter(_spans(_pieces(part, CANDIDATE), start), lambda s: _is_secret(s["hit"], allow))
    inside = F.transform("_x_parts", lambda p: F.when(p["between"].rlike(CANDIDATE), F.flatten(F.filter(F.transform(
        _pieces(p["between"], KNOWN), lambda q: F.when(q["between"].rlike(CANDIDATE), runs(q["between"], p["start"] + q["start"]))),
        lambda x: x.isNotNull()))))
    valid = F.filter(_spans(F.col("_x_parts")), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= MIN_VALUE)
    return df.withColumns({
        "_x_assign": valid, "_x_access": _spans(_pieces(t, ACCESS)), "_x_hex": _spans(_pieces(t, HEX)),
        "_x_entropy": F.flatten(F.filter(inside, lambda x: x.isNotNull())),
    }).drop("_x_text", "_x_parts")


KINDS = ["assign", "access", "hex", "entropy"]


def _text_of(kinds: list[str]) -> Column:
    """kind:start:end of the spans by start, then kind, comma-joined."""
    def tag(kind: str, number: int) -> Column:
        return F.transform(f"_x_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    tagged = F.concat(*[tag(k, i) for i, k in enumerate(kinds)])
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(tagged), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op3_entropy_secrets(spark, sf_dir) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[F.size(f"_x_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_text_of(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), _text_of(KINDS).alias("spans"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_spans(column: str, pattern: str) -> str:
    """DuckDB list of {s, e, h, p0, pt}: spans of the matches; p0, pt: start and text of what lies before."""
    return f"""(SELECT list_transform(range(1, len(b) + 1), lambda i: {{
      'p0': coalesce(list_sum(list_transform(b[1:i-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0),
      'pt': b[i], 'h': h[i]}}) FROM (SELECT regexp_split_to_array({column}, {_sql(pattern)}) AS b, regexp_extract_all({column}, {_sql(pattern)}) AS h))"""


_SQL_ALLOWED = " OR ".join(f"regexp_matches(h, {_sql(p)})" for p in ALLOW)
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
cut AS (SELECT rid, {_sql_spans('text', ASSIGN)} AS a, {_sql_spans('text', ACCESS)} AS k, {_sql_spans('text', HEX)} AS x FROM t),
flat AS (
  SELECT rid, 0 AS kind, unnest(a) AS m FROM cut UNION ALL SELECT rid, 1, unnest(k) FROM cut UNION ALL SELECT rid, 2, unnest(x) FROM cut),
base AS (
  SELECT rid, kind, (m.p0 + length(m.pt))::BIGINT AS s, (m.p0 + length(m.pt) + length(m.h))::BIGINT AS e FROM flat
  WHERE m.h IS NOT NULL AND (kind > 0 OR length(regexp_extract(m.h, {_sql(ASSIGN)}, 2)) >= {MIN_VALUE})),
rest AS (SELECT rid, m.p0 AS p0, unnest({_sql_spans('m.pt', KNOWN)}) AS m FROM flat WHERE kind = 0),
runs AS (
  SELECT rid, p0, unnest({_sql_spans('pt', CANDIDATE)}) AS m FROM (SELECT rid, p0 + m.p0 AS p0, m.pt AS pt FROM rest)),
cands AS (
  SELECT rid, (p0 + m.p0 + length(m.pt))::BIGINT AS s, m.h AS h,
    regexp_matches(m.h, '[0-9]') AS d, regexp_matches(m.h, '[A-Z]') AS u, regexp_matches(m.h, '[a-z]') AS l FROM runs WHERE m.h IS NOT NULL),
entropies AS (
  SELECT rid, 3 AS kind, s, s + length(h) AS e,
    CASE WHEN regexp_matches(h, '^[0-9a-fA-F]+$') AND d THEN {LIMITS["hex"]} WHEN u AND l AND NOT d THEN {LIMITS["letters"]} WHEN u AND l THEN {LIMITS["mixed"]} ELSE {LIMITS["single"]} END AS lim,
    list_max(list_transform(range(1, length(h) - {WINDOW - 2}), lambda i: list_aggregate(string_split(substr(h, i, {WINDOW}), ''), 'entropy'))) AS ent
  FROM cands WHERE ((d AND (u OR l)) OR (u AND l)) AND NOT ({_SQL_ALLOWED})),
spans AS (SELECT * FROM base UNION ALL SELECT rid, kind, s, e FROM entropies WHERE ent >= lim),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e AS txt FROM spans),
grouped AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(txt, ',' ORDER BY s, kind) FILTER (kind < 3) AS base_text, string_agg(txt, ',' ORDER BY s, kind) AS spans
  FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN grouped USING (rid)
"""
