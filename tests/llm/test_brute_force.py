"""Operators against plain Python statements of their contracts, on small fixtures and on the sf0.001 tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import reference as ref
from pyspark.sql import functions as F

from conftest import SF001
from glossa.llm import (catalog, components, cotraining, cover_tree, language_id, line_templates, mixing, packing, quality_rules,
                        secret_scan, simhash, url_filter)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}


def run(spark, name):
    return catalog.QUERIES[name](spark, SF001)


# ------------------------------------------------------------------- op 5, 3

def test_quality_counts(spark, texts):
    for r in run(spark, "op5_quality_rules").collect():
        want = ref.quality_counts(texts[r["doc_id"]]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_counts_of_crafted_texts(spark):
    rng = random.Random(5)
    rows = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 7, 12, 40, 300)]
    rows += ["x y z x y z", "a\x0bb\x0cc\x1cd e", "l1\n\n l1\nl1\n \nl1 ", "😀# é$ <|>"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], "doc_id long, text string, lang string")
    for r in quality_rules.judge(df, ["doc_id"]).collect():
        assert (r["_q_n"], r["_q_word_chars"], r["_q_symbols"], r["_q_dup_lines"], r["_q_repeat"]) == ref.quality_counts(rows[r["doc_id"]]), rows[r["doc_id"]]


def test_js_distance(spark):
    p, q = [3.0, 1.0, 0.0], [1.0, 1.0, 2.0]
    got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality_rules.js_distance(F.col("p"), F.col("q"))).first()[0]
    a, b = np.array(p) / 4, np.array(q) / 4
    m = (a + b) / 2
    kl = lambda x: sum(v * math.log2(v / w) for v, w in zip(x, m) if v)
    assert abs(got - math.sqrt((kl(a) + kl(b)) / 2)) < 1e-12


def test_secret_base_spans(spark, texts):
    crafted = ["token=token:abcdef", "PASSWORD = 'abc' secret:\"abcdefg.h\" api_key==x12345", "AKIA" + "A" * 15, "AKIA" + "B" * 16 + "c",
               "xx" + "ab12" * 6 + "Z" + "0" * 23, "é😀 token: " + "f" * 30, "apikey=123456 api_key:1234567"]
    rows = [(i, t) for i, t in enumerate(crafted)] + [(1000 + k, r["text"]) for k, r in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by_id = dict(rows)
    found = secret_scan.scan(df).select("doc_id", *[F.size(f"_x_{k}").alias(k) for k in ("assign", "access", "hex")],
                                        F.sha2(secret_scan._text_of(["assign", "access", "hex"]).cast("binary"), 256).alias("sha"))
    for r in found.collect():
        assert ((r["assign"], r["access"], r["hex"]), r["sha"]) == ref.base_spans(by_id[r["doc_id"]]), by_id[r["doc_id"]]


def test_entropy_windows_and_allow_list(spark):
    rng = random.Random(3)
    secret = "".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(32))
    runs = [secret, "a" * 40, "abcdefghij" * 4, "A1" * 15, "123e4567-e89b-12d3-a456-426614174000", "2024-01-02-03-04-05-06-07",
            "some/long/path/with/words", "0123456789" * 3]
    df = spark.createDataFrame([(i, f"été {t}.") for i, t in enumerate(runs)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["_x_entropy"]] for r in secret_scan.scan(df).collect()}
    assert got[0] == [(4, 4 + len(secret))] and all(not got[i] for i in range(1, len(runs)))
    for r in df.select("doc_id", secret_scan.max_entropy(F.lit(secret)).alias("h")).limit(1).collect():
        windows = [Counter(secret[i:i + 20]) for i in range(len(secret) - 19)]
        assert abs(r["h"] - max(-sum(c / 20 * math.log2(c / 20) for c in w.values()) for w in windows)) < 1e-9


def test_positions_of_many_matches(spark):
    text = " ".join("f" * (24 + i % 5) for i in range(700))
    r = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["start"], s["end"]) for s in r["_x_hex"]] == [(m.start(), m.end()) for m in ref.re.finditer("f+", text)]


# ------------------------------------------------------------------- op 1

def test_redirects_carry_blocks_and_allow_stands(spark):
    rows = [
        (1, "http://bad.com/de/x", None), (2, "https://alias.net/a", '<link rel="canonical" href="http://bad.com/de/x#top">'),
        (3, "http://hop.net/b?q=1", '<meta http-equiv="refresh" content="0; url=https://alias.net/a">'),
        (4, "http://fine.org/", '<link rel=canonical href=http://alias.net/a>'), (5, "http://clean.net/c", "<p>canonical</p>"),
        (6, "http://rel.net/d/e", '<link href="/f" rel="canonical">'), (7, "http://rel.net/f", '<link rel="canonical" href="//hop.net/b?q=1">'),
        (8, "http://only.net/g", "<link rel='canonical' href='http://www.example.org/en/12'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "block"}
    crawl = spark.createDataFrame([("http://clean.net/c", "http://hop.net/b?q=1")], "from_url string, to_url string")
    assert {r["page_id"] for r in url_filter.judge(pages, url_filter.rule_table(spark), crawl).collect() if r["verdict"] == "block"} == {1, 2, 3, 5, 6, 7, 8}


def test_longest_rule(spark):
    urls = {"http://X.Example.ORG/en/15": "example.org/en/1", "http://example.org/en/2": "org/", "http://notexample.org/es/1": "org/",
            "http://a.com/fr/": "com/fr/", "http://a.com/fr": None, "http://org": None, "http://a.com/de/1": "com/de/", "HTTP://b.ORG/": "org/"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["rule"] for r in url_filter.match_rules(df, url_filter.rule_table(spark)).collect()}
    assert got == urls


# ------------------------------------------------------------------- op 2

def test_templates_generalise_and_first_occurrence_stays(spark):
    body = "connection from host alpha number {} closed after {} seconds by the remote side without any reason given to us"
    rows = [(i, f"unique line {chr(97 + i) * 9} here we go\n{body.format(i * 7, i)}\ntail {chr(97 + i)} {chr(98 + i)} {chr(99 + i)} only") for i in range(6)]
    rows.append((9, "connection from host beta which has nothing in common with those other lines at all but for its start"))
    out = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["text"] == rows[0][1] and out[9]["text"] == rows[-1][1]
    for i in range(1, 6):
        kept = rows[i][1].split("\n")
        assert out[i]["text"] == "\n".join([kept[0], kept[2]]) and out[i]["_d_dropped"] == 1


def test_near_copies_with_an_edited_word_share_a_template(spark):
    rng = random.Random(2)
    base = ["w" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    rows = []
    for i in range(5):
        words = list(base)
        for k in rng.sample(range(5, 60), 3):
            words[k] = "edit" + chr(97 + i) * 4
        rows.append((i, " ".join(words) + f"\nown text {chr(97 + i) * 3} stays {chr(102 + i) * 4} put"))
    out = {r["doc_id"]: r["_d_dropped"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


# ------------------------------------------------------------------- op 7

def test_fingerprints(texts):
    for r in list(texts.values())[:60]:
        assert simhash.fingerprint(r["text"]) == ref.simhash(r["text"])
    assert simhash.fingerprint("A b\x0bÉ") == ref.simhash("a b\x0bÉ")


def _planted(n_clusters, size, seed):
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 1 << 63, n_clusters, dtype=np.uint64)
    out = []
    for c in centers:
        for _ in range(size):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            out.append(int(c) ^ sum(1 << int(b) for b in flips))
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("shard", [1 << 20, 200, 40])
def test_vantage_point_links_equal_all_pairs(spark, monkeypatch, shard):
    """Shards that hold, shards dealt again by their other bits, and such as go to pairs of blocks."""
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "LEAF", 64)
    pts = _planted(60, 30, shard)
    pts = np.unique(np.concatenate([pts, _planted(1, 900, 9)]))  # one dense group above a shard's size
    df = spark.createDataFrame([(int(x),) for x in pts.view(np.int64)], "fp long")
    edges = [(r["u"], r["v"]) for r in simhash.links(df, 3).collect()]
    order = {int(x): i for i, x in enumerate(pts.view(np.int64).tolist())}
    near = np.argwhere(np.triu(np.bitwise_count(pts[:, None] ^ pts[None, :]) <= 3, 1))
    assert ref.components(len(pts), [(order[a], order[b]) for a, b in edges]) == ref.components(len(pts), near.tolist())
    assert len(edges) < 40 * len(pts)


def test_every_point_goes_once_to_each_slice_tree(spark):
    for n in (50, 5000):
        df = spark.range(n).select(F.xxhash64("id").alias("fp"))
        for bits in (0, 2, 3, 7):
            dealt = simhash.deal(df, bits, 16).select("fp", F.shiftright("shard", 32).alias("tree"))
            assert dealt.count() == (bits + 1) * n == dealt.distinct().count()


def test_slice_tree_parts_all_values():
    for leaves in (1, 7, 64, 1 << 16):
        leaf = simhash.slice_tree(16, leaves)
        assert len(set(leaf.tolist())) == leaves


def test_components_of_a_long_chain(spark):
    """20,000 nodes in random order: the rounds follow the logarithm of the length."""
    nodes = np.random.default_rng(3).permutation(20_000).tolist()
    links = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long")
    got = components.components(links, "a", "b")
    assert got.count() == 20_000 and got.filter("root <> 0").isEmpty()


def test_components_of_chain_star_and_random(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = ref.components(1400, links)
    assert all(want[k] == v for k, v in got.items()) and set(got) == {x for e in links if e[0] != e[1] for x in e}


# ------------------------------------------------------------------- op 10

def test_cover_tree_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(25, 16))
    x = np.concatenate([c + rng.normal(scale=rng.uniform(0.02, 0.5), size=(40, 16)) for c in centers])
    x = np.concatenate([x, np.repeat(x[:1], 30, axis=0)]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in cover_tree.near_duplicates(df, block=64).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    roots = ref.components(len(x), np.argwhere(np.triu(near)).tolist())
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), roots[i], roots[i] == i)


# ------------------------------------------------------------------- op 8, 9

def test_mix_targets_and_closeness(spark, texts):
    rows = run(spark, "op8_pivotal_mix").collect()
    by_source = defaultdict(list)
    for r in rows:
        assert r["size"] == len(ref.words(texts[r["doc_id"]]["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        by_source[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in g) for s, g in by_source.items()}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, full = 1.5 * sum(sizes.values()), set()
    while True:
        rate = (left - sum(2 * sizes[s] for s in full)) / max(sum(weight[s] for s in sizes if s not in full), 1)
        more = {s for s in sizes if s not in full and rate * weight[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    for s, g in by_source.items():
        want = 2 * sizes[s] if s in full else rate * weight[s]
        assert all(abs(r["target"] - want) < 1e-6 * max(want, 1) and r["source_size"] == sizes[s] for r in g)
        assert abs(sum(r["taken"] for r in g) - want) <= max(r["size"] for r in g)
    again = {r["doc_id"]: r["taken"] for r in run(spark, "op8_pivotal_mix").collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_pivot_keeps_the_sum_and_the_chances():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 50, 40).astype(float)
    part = np.full(40, 0.3)
    total = np.zeros(40)
    for _ in range(3000):
        p = mixing.pivot(size, part, rng.random(40))
        assert abs((p * size).sum() - (part * size).sum()) < 1e-6 and ((p > 0) & (p < 1)).sum() <= 1
        total += p
    assert np.abs(total / 3000 - 0.3).max() < 0.05


def test_many_chunks_meet_in_the_tree(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 37), f"s{i % 2}") for i in range(900)], "doc_id long, text string, source string")
    rows = mixing.mix(df, chunk=16).collect()
    for s in ("s0", "s1"):
        g = [r for r in rows if r["source"] == s]
        assert len(g) == 450 and abs(sum(r["copies"] * r["size"] for r in g) - g[0]["target"]) <= 37


def test_packing_ids_and_layout(spark, texts):
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    rows = run(spark, "op9_genetic_packing").collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for k, t in texts.items():
        ids = np.array(tok.encode(t["text"] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        got = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in got] == [(i, a, b - a) for i, (a, b) in enumerate(zip(want, want[1:]))]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) for r in got)
    for g in by_seq.values():
        at = 0
        for r in sorted(g, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_seq) <= math.ceil(sum(r["length"] for r in rows) / 2048) * 1.02 + 1


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    parts = ["a", "bc", "Hello", "été", "x1", "12", ",", ".", "...", "'s", "don't", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "<|endoftext|>",
             "中文", "😀", "a.", "b,", "1.", "_", "\x1c", " ", "-", "\n", " "]
    encoder = packing.Encoder(packing.vocabulary())
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["", "\n", "\n\n", "a\n", "\na", " a", "a ", "a \nb"]
    for k in range(0, len(made), 500):
        for t, ids in zip(made[k:k + 500], encoder.encode(made[k:k + 500])):
            assert ids == np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 2048, 300)
    a = packing.pack(sizes, np.argsort(-sizes, kind="stable"), 2048)
    b = packing.pack(sizes, rng.permutation(300), 2048)
    for _ in range(20):
        child = packing.crossover(sizes, a, b, 2048, rng)
        assert (child >= 0).all() and np.bincount(child, weights=sizes).max() <= 2048
        assert len(np.unique(child)) == child.max() + 1
        b = child
    best = packing.evolve(sizes, [a], 2048, 1)
    assert packing.fitness(sizes, best, 2048) >= packing.fitness(sizes, a, 2048)


# ------------------------------------------------------------------- op 4, 6

def test_language_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in catalog.QUERIES["op4_language_id"](spark, sf).collect() if r["held_out"]]
    assert len(held) > 200 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_bloom_false_positives_are_corrected():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    masks = np.zeros((1, 1 << 12), dtype=np.uint64)
    for s in language_id.slots(grams[:1500], 12):
        masks[0, s] |= np.uint64(1)
    rate = ((masks[0] & np.uint64(1)) > 0).mean() ** language_id.PROBES
    word = np.bitwise_and.reduce([masks[0, s] for s in language_id.slots(grams, 12)])
    hits = int((word & np.uint64(1)).sum())
    assert hits > 1600 and abs((hits - rate * 4000) / (1 - rate) - 1500) < 150


def test_cotraining_recovers_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    seen = labels.filter("doc_id % 3 <> 0")
    scored = {r["doc_id"]: r["s"] for r in cotraining.score(docs, cotraining.fit(docs, seen)).select("doc_id", F.col("_k_score.score").alias("s")).collect()}
    unseen = labels.filter("doc_id % 3 = 0").collect()
    assert sum((scored[r["doc_id"]] >= 0.5) == (r["quality"] == 1) for r in unseen) >= 0.95 * len(unseen)


def test_pseudo_labels_are_exchanged():
    rng = np.random.default_rng(2)
    y = (rng.random(200) < 0.5).astype(float)
    a, b = y[:, None] * 2 + rng.normal(size=(200, 3)) * 0.3, y[:, None] * 2 + rng.normal(size=(200, 2)) * 0.3
    pool_y = (rng.random(300) < 0.5).astype(float)
    pool = [pool_y[:, None] * 2 + rng.normal(size=(300, 3)) * 0.3, pool_y[:, None] * 2 + rng.normal(size=(300, 2)) * 0.3]
    model = cotraining.cotrain([a, b], y, np.arange(200) % 4 == 0, pool)
    assert min(model["handed"]) > 20
    z = np.stack([v.score(p) for v, p in zip(model["views"], pool)], axis=1)
    assert ((cotraining.logits(z, model["mix"]) > 0) == (pool_y > 0)).mean() > 0.97


# ------------------------------------------------------------------- oracles, plans

@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    from oracle_harness import compare

    r = compare(spark, name, SF001)
    assert r["hash_match"] and r["types_match"], r


@pytest.mark.parametrize("name", ["op2_line_templates", "op3_entropy_secrets", "op5_quality_rules"])
def test_native_operators_run_no_python(spark, name):
    plan = run(spark, name)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
