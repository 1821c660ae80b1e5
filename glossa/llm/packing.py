"""Best-fit packing by a grouping genetic algorithm on islands (operator 9).

Texts are tokenised once; each document gives pieces of at most ``CAPACITY``
tokens (a longer one: full pieces behind a shorter first one).  Full pieces
are sequences of their own.  The others are dealt by hash into shards of about
``SHARD`` pieces; several islands, each a task with its own random numbers,
evolve packings of a shard.  An individual is a set of bins.  Crossover
injects whole well-filled bins of one parent into the other, removes the
other's bins that hold a duplicate, and puts the displaced pieces back by best
fit decreasing.  Between epochs the elite of each island migrates to the next
island, which goes on with both.  The best island's packing settles the
shard's full enough bins; the pieces of its slack bins from all shards meet in
the next round, in fewer shards, so that slack gathers in few sequences.

Defined cases: null and empty texts are the closing id alone; repeated rows
are packed each; a null doc_id is kept; very long texts are cut as any longer
than a sequence; empty table: empty result.
"""

from __future__ import annotations

import zlib
from array import array
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import numbered, read_table
from glossa.session import cut_lineage

CAPACITY = 2_048
END_ID = 0
SHARD = 2_048         # pieces evolved together
ISLANDS = 2
POPULATION = 4
GENERATIONS = 5
ROUNDS = 3
SETTLED = 0.995       # bins at least this full are final before the last round
CACHE = 1_200_000     # tokenised words a worker keeps
JOINED = 64           # new words encoded in one call


# --------------------------------------------------------------- tokenising

class Encoder:
    """Token ids of whole texts as little-endian bytes.

    The vocabulary's splitting rule always breaks before a space that is
    followed by another character than white space, around a run of newlines
    between such characters (whose last newline stands alone), and between a
    letter and a comma or full stop.  What stands between is encoded once per
    worker and kept.  A text with other white space next to a space or newline
    is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}   # by word, the space before it implied
        self.firsts: dict[str, bytes] = {}  # by word at the start of a line
        self.newlines: dict[int, bytes] = {0: b""}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = dict(zip(",.", self._raw([",", "."])))

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], lead: str) -> list[bytes]:
        """Each word's ids behind ``lead``, ``JOINED`` words a call.

        Newlines stand between them, at which the splitting rule breaks and which no other id is made of; words with
        white space or control characters, and calls whose newlines do not come back alone, are encoded one by one.
        """
        mark, out = array("I", self._newline(1)), dict.fromkeys(words, b"")
        joined = [w for w in words if w.isprintable()] if len(mark) == 1 else []
        alone = [w for w in words if not w.isprintable()] if joined else words
        calls = [joined[k:k + JOINED] for k in range(0, len(joined), JOINED)]
        made = self.tokenizer.encode_batch_fast(["\n".join([lead + w for w in ws]) for ws in calls], add_special_tokens=False)
        for ws, e in zip(calls, made):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(ids == mark[0]).tolist()
            if len(ends) != len(ws) - 1:
                alone = alone + ws
                continue
            raw = ids.tobytes()
            for w, a, b in zip(ws, [0, *[x + 1 for x in ends]], [*ends, len(ids)]):
                out[w] = raw[4 * a:4 * b]
        out.update(zip(alone, self._raw([lead + w for w in alone])))
        return [out[w] for w in words]

    def _learn(self, into: dict[str, bytes], fresh: set[str], lead: str) -> None:
        """Encodes new words; one that ends in a comma or full stop behind a letter shares its stem's ids."""
        stems = {w: w[:-1] for w in fresh if len(w) > 1 and w[-1] in ",." and w[-2].isalpha()}
        plain = list(fresh.difference(stems).union(stems.values()).difference(into))
        into.update(zip(plain, self._words(plain, lead)))
        into.update((w, into[stem] + self.ends[w[-1]]) for w, stem in stems.items())

    def _newline(self, n: int) -> bytes:
        if n not in self.newlines:
            self.newlines[n] = self._raw(["\n" * n])[0]
        return self.newlines[n]

    def _looked_up(self, text: str, heads: list, missing: list) -> list | None:
        """Lists of ids and newline runs of a text, gaps noted in ``heads`` and ``missing``; None if it must be encoded whole."""
        if any(s in text for s in self.special):
            return None
        out, run, known = [], -1, self.known.get
        for line in text.split("\n"):
            run += 1
            if not line:
                continue
            if line[0].isspace() or line[-1].isspace():
                return None
            if run:
                out.append([self._newline(run - 1), self._newline(1)] if run > 1 else [self._newline(1)])
            run = 0
            head, *ws = line.split(" ")
            got = list(map(known, ws))
            if None in got:
                gaps = [(got, i, ws[i]) for i, x in enumerate(got) if x is None]
                if any(not w or w[0].isspace() for _, _, w in gaps):
                    return None
                missing += gaps
            first = [self.firsts.get(head)]
            if first[0] is None:
                heads.append((first, 0, head))
            out += [first, got]
        if run > 0:
            out.append([self._newline(run)])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known, self.firsts = {}, {}
        heads: list = []
        missing: list = []
        found = [self._looked_up(t, heads, missing) for t in texts]
        for into, gaps, lead in ((self.firsts, heads, ""), (self.known, missing, " ")):
            self._learn(into, {w for _, _, w in gaps}, lead)
            for got, i, w in gaps:
                got[i] = into[w]
        whole = iter(self._raw([t for t, f in zip(texts, found) if f is None]))
        return [next(whole) if f is None else b"".join(chain.from_iterable(f)) for f in found]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One per Python worker, wherever tasks of this module run."""
    if path not in _ENCODERS:
        import gc
        import os

        gc.set_threshold(200_000, 50, 100)  # the kept words are many long-lived objects
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids, closing id included, cut to ``capacity``."""
    tokenizer = tokenizer or vocabulary()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches):
        from glossa.llm import packing

        for pdf in batches:
            encoder = packing._encoder(tokenizer)
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k:k + 256]
                rows = []
                for at, ids in zip(part.index, encoder.encode([t or "" for t in part["text"]])):
                    ids += end
                    n = len(ids) // 4
                    bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    rows += [(at, i, a, b - a, zlib.crc32(memoryview(ids)[4 * a:4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
                made = pd.DataFrame(rows, columns=["at", "piece", "start", "length", "ids_crc32"])
                made.insert(0, "doc_id", part["doc_id"].loc[made["at"]].to_numpy())
                yield made.drop(columns="at").astype({"piece": "int32"})

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")


# ------------------------------------------------------- genetic algorithm

def best_fit(sizes: np.ndarray, order: np.ndarray, room: list[int], capacity: int) -> np.ndarray:
    """Bin of each size of ``order``: the open bin it fills best, else a new one; ``room`` grows with the bins.

    ``mask`` has a bit for every room that some bin has: the best bin is the
    lowest bit not under the size.
    """
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    out = np.empty(len(order), dtype=np.int64)
    for k, s in enumerate(sizes[order].tolist()):
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            bins = by_room[r]
            b = bins.pop()
            if not bins:
                mask &= ~(1 << r)
            left = r - s
        else:
            b, left = len(room), capacity - s
            room.append(left)
        room[b] = left
        if left > 0:
            found = by_room.setdefault(left, [])
            if not found:
                mask |= 1 << left
            found.append(b)
        out[k] = b
    return out


def pack(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins = np.empty(len(sizes), dtype=np.int64)
    bins[order] = best_fit(sizes, order, [], capacity)
    return bins


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean square fill: fewer and fuller bins score higher."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return float((fill ** 2).sum() / max(len(fill), 1))


def crossover(sizes: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng) -> np.ndarray:
    """The mother with whole well-filled bins of the father injected."""
    fill = np.bincount(father, weights=sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[good[rng.random(len(good)) < 0.5]] = True
    injected = chosen[father]
    hit = np.zeros(mother.max() + 1, dtype=bool)
    hit[mother[injected]] = True
    stays = ~injected & ~hit[mother]
    child = np.full(len(sizes), -1, dtype=np.int64)
    _, kept = np.unique(mother[stays], return_inverse=True)
    child[stays] = kept
    _, new = np.unique(father[injected], return_inverse=True)
    child[injected] = new + (kept.max() + 1 if len(kept) else 0)
    placed = child >= 0
    room = (capacity - np.bincount(child[placed], weights=sizes[placed])).astype(np.int64).tolist()
    loose = np.flatnonzero(~placed)
    loose = loose[np.argsort(-sizes[loose], kind="stable")]
    child[loose] = best_fit(sizes, loose, room, capacity)
    return child


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int,
           population: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """Best packing found by one island that starts from ``elites`` and shuffled best-fit packings."""
    rng = np.random.default_rng(seed)
    found = list(elites)
    if not found:
        found.append(pack(sizes, np.argsort(-sizes, kind="stable"), capacity))
    while len(found) < population:
        found.append(pack(sizes, np.argsort(-sizes * rng.uniform(0.8, 1.2, len(sizes)), kind="stable"), capacity))
    scored = sorted(((fitness(sizes, b, capacity), i, b) for i, b in enumerate(found)), key=lambda x: (-x[0], x[1]))
    tick = len(scored)
    for _ in range(generations):
        a, b = rng.choice(len(scored), size=2, replace=False)
        for mother, father in ((a, b), (b, a)):
            child = crossover(sizes, scored[mother][2], scored[father][2], capacity, rng)
            scored.append((fitness(sizes, child, capacity), tick, child))
            tick += 1
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:population]
    return scored[0][2]


# ------------------------------------------------------------ distribution

ITEM = "doc_id string, piece int, start long, length long, ids_crc32 long, nr long, shard long"
_ORDER = ["length", "doc_id", "piece", "start", "ids_crc32", "nr"]


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """The same order of a shard's pieces on every island; rows equal in all columns are interchangeable."""
    return pdf.sort_values(_ORDER, ascending=[False, *[True] * 5], kind="stable").reset_index(drop=True)


def pack_pieces(items: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (pieces shorter than ``capacity``) plus sequence_id and offset."""
    def start(key, pdf):
        pdf = _ordered(pdf)
        seed = (int(key[0]) * islands + int(key[1])) * 2
        sizes = pdf["length"].to_numpy()
        pdf["bin"] = evolve(sizes, [], capacity, seed)
        return pdf

    def migrate(key, pdf):
        own, other = (_ordered(pdf[pdf["origin"] == i]) for i in (key[1], (key[1] - 1) % islands))
        sizes = own["length"].to_numpy()
        elites = [own["bin"].to_numpy()] + ([other["bin"].to_numpy()] if islands > 1 else [])
        own["bin"] = evolve(sizes, elites, capacity, (int(key[0]) * islands + int(key[1])) * 2 + 1)
        own["score"] = fitness(sizes, own["bin"].to_numpy(), capacity)
        return own.drop(columns="origin")

    def choose(last):
        def settle(pdf):
            best = pdf.loc[pdf["score"].idxmax(), "score"]
            pdf = _ordered(pdf[pdf["island"] == pdf.loc[pdf["score"] == best, "island"].min()])
            bins, sizes = pdf["bin"].to_numpy(), pdf["length"].to_numpy()
            fill = np.bincount(bins, weights=sizes)
            pdf["done"] = True if last else fill[bins] >= SETTLED * capacity
            by_bin = np.argsort(bins, kind="stable")
            ends = np.cumsum(sizes[by_bin])
            first = np.append(0, np.cumsum(fill.astype(np.int64))[:-1])
            at = np.empty(len(bins), dtype=np.int64)
            at[by_bin] = ends - sizes[by_bin] - first[bins[by_bin]]
            pdf["offset"] = at
            return pdf.drop(columns=["island", "score"])

        return settle

    targets = [F.col("origin"), (F.col("origin") + 1) % islands][:islands]  # an elite stays and also goes to the next island
    done, left, n = [], numbered(items), items.count()
    for r in range(rounds):
        shards = max(1, -(-n // shard))
        last = r == rounds - 1 or shards == 1
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nr", F.lit(r)), F.lit(shards)))
        spread = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
        first = spread.groupBy("shard", "island").applyInPandas(start, f"{ITEM}, island int, bin long")
        moved = first.withColumn("origin", F.col("island")).withColumn("island", F.explode(F.array(*targets)))
        second = moved.groupBy("shard", "island").applyInPandas(migrate, f"{ITEM}, island int, bin long, score double")
        packed = cut_lineage(second.groupBy("shard").applyInPandas(choose(last), f"{ITEM}, bin long, done boolean, offset long"))
        number = F.lit(r).cast("long") * (1 << 56) + F.col("shard") * (1 << 24) + F.col("bin")
        done.append(packed.filter("done").select(*items.columns, number.alias("sequence_id"), "offset"))
        if last:
            break
        left = packed.filter("not done").select(*items.columns, "nr")
        n = left.count()
        if not n:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType
    cut = cut_lineage(pieces(docs, tokenizer, capacity))
    full = cut.filter(F.col("length") == capacity).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("long"))
    packed = pack_pieces(cut.filter(F.col("length") < capacity), capacity, **options)
    return packed.unionByName(full).withColumn("doc_id", F.col("doc_id").cast(kind))


def op9_genetic_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
