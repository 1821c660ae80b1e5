"""DuckDB (RE2) statements of the text rules, used only by the oracle SQL.

RE2 has no look-around, so the negation rule consumes the following
character and puts it back (``\\2``).  Entity decoding is a replace chain for
the references that occur in the test pages; ``&amp;`` (with or without the
semicolon) is decoded last so that ``&amp;quot;`` is not decoded twice.
"""

W = r"[\p{L}\p{N}_]"


def unescape_sql(x: str) -> str:
    out = x
    for ref, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
                      ("&#39;", "''"), ("&mdash;", "—")):
        out = f"replace({out}, '{ref}', '{char}')"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


def normalize_sql(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    t = unescape_sql(t)
    t = f"replace(lower({t}), '’', '''')"
    for short, full in (("won''t", "will not"), ("can''t", "can not"), ("shan''t", "shall not"), ("ain''t", "is not")):
        t = f"replace({t}, '{short}', '{full}')"
    return f"regexp_replace({t}, '({W}+)n''t($|[^\\p{{L}}\\p{{N}}_])', '\\1 not\\2', 'g')"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({normalize_sql(x)}, '({W}+)', 1)"


def bigrams_sql(t: str) -> str:
    return f"list_transform(range(len({t}) - 1), lambda i: {t}[i + 1] || ' ' || {t}[i + 2])"


def word_count_sql(x: str) -> str:
    ws = r"[\t\n\x{0B}\f\r \p{Z}\x{85}\x{1C}-\x{1F}]+"
    return f"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '{ws}'), lambda s: s <> ''))"


def bucket_sql(n: str) -> str:
    return (f"CASE WHEN {n} <= 100 THEN 0 WHEN {n} <= 200 THEN 1 WHEN {n} <= 300 THEN 2 "
            f"WHEN {n} <= 400 THEN 3 ELSE 4 END")


DOCS_CTE = ("docs AS (SELECT d.doc_id, d.text, CAST(l.quality AS TINYINT) AS label "
            "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")
