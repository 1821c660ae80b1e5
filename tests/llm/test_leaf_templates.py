"""Several templates in one leaf of the line tree."""

import math
import random
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import xxhash

from glossa.llm import line_templates

START = ["notice", "of", "change"]


def _word(rng):
    return "w" + "".join(rng.choice("abcdefgh") for _ in range(6))


def _variants(rng, base, count):
    return [" ".join(START + [w if k not in edits else _word(rng) for k, w in enumerate(base)])
            for edits in (set(rng.sample(range(len(base)), 2)) for _ in range(count))]


def _dropped(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r["doc_id"]: r["_d_dropped"] for r in line_templates.drop_recurring_lines(df).collect()}


def test_two_templates_in_a_leaf(spark):
    rng = random.Random(21)
    one, two = ([_word(rng) for _ in range(27)] for _ in range(2))
    lines = _variants(rng, one, 12) + _variants(rng, two, 12) + [" ".join(START + [_word(rng) for _ in range(27)]) for _ in range(6)]
    assert _dropped(spark, lines) == {i: int(i not in (0, 12) and i < 24) for i in range(30)}


def test_a_hot_copied_line_beside_a_template(spark):
    rng = random.Random(22)
    hot = " ".join(START + [_word(rng) for _ in range(27)])
    lines = _variants(rng, [_word(rng) for _ in range(27)], 10) + [hot] * 500
    assert _dropped(spark, lines) == {i: int(i not in (0, 10)) for i in range(510)}


def test_short_lines_differ_in_one_token(spark):
    lines = ["a b c d xa", "a b c d xb", "a b c y xc", "a b c z xd", "a b c z xe", "q r s t", "q r s u"]
    assert _dropped(spark, lines) == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0}


def _brute(lines):
    """Documents (one line each, all of one leaf) whose line goes, by the stated rule in plain Python."""
    wordings = Counter(lines)
    n = len(lines[0].split())
    hashed = {w: int(np.uint64(reduce(lambda h, x: xxhash.xxh64_intdigest(x.encode(), h), w.split(), 42)).astype(np.int64)) for w in wordings}
    fixed = []
    for i in range(n):
        (word, times), = Counter(x.split()[i] for x in lines).most_common(1)
        fixed.append(word if 2 * times > len(lines) else None)
    agree = lambda a, b: sum(x == y for x, y in zip(a, b)) >= 0.8 * n
    template = {w: "leaf" for w in wordings if agree(w.split(), fixed)}
    pool = [w for w in wordings if w not in template] if n >= 5 else []
    count, bands = n - math.ceil(0.8 * n) + 1, defaultdict(list)
    for w in pool:
        t = w.split()
        single = [tuple(x for i, x in enumerate(t) if i >= 3 and (i - 3) % count == b) for b in range(count)]
        for b in range(count):
            bands["one", b, single[b]].append(w)
            bands["two", b, single[b], single[(b + 1) % count]].append(w)
    rank = lambda w: (wordings[w], hashed[w])
    near = defaultdict(set)
    for group in bands.values():
        if len(group) > 1:
            seed = max(group, key=rank)
            for w in group:
                if agree(w.split(), seed.split()):
                    near[w].add(seed)
    taken = []
    for seed in sorted({s for v in near.values() for s in v}, key=rank, reverse=True):
        if not near[seed] & set(taken):
            taken.append(seed)
    for w in pool:
        own = near[w] & set(taken)
        template[w] = max(own, key=rank) if own else w
    seen, gone = set(), {}
    for i, line in enumerate(lines):
        t = template.get(line, line)
        gone[i] = int(t in seen)
        seen.add(t)
    return gone


def test_equals_the_stated_rule(spark):
    rng = random.Random(8)
    for n, letters, count in ((5, "abc", 40), (6, "abcd", 60), (12, "ab", 50), (9, "abcdefghij", 30)):
        lines = [" ".join(["x", "y", "z"] + [rng.choice(letters) for _ in range(n - 3)]) for _ in range(count)]
        lines += rng.choices(lines, k=count // 3)
        assert _dropped(spark, lines) == _brute(lines)


def test_nothing_is_joined_through_a_third_line(spark):
    lines = ["we like to eat fresh", "we like to eat bread", "we like to bake bread", "we like to bake cakes"]
    got = _dropped(spark, lines)
    assert got == _brute(lines) and sum(got.values()) < 3
