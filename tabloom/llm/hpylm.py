"""Hierarchical Pitman-Yor language model with seatings sampled by Gibbs.

Tokens are words (A-Z lower-cased) and one end per text. Restaurants, from the top:

- spelling: byte trigrams of rare words, over the ALPHABET most frequent bytes;
- rare words: all words but the DISHES most frequent; its parent is the spelling model. What that leaves
  for words never met is the probability of one unknown word, as in the unigram base;
- root: the DISHES most frequent words, one dish that leads to the rare words, one for the end; its
  parent is uniform;
- contexts: one restaurant for every previous word and one for the start of a text, with every next
  word as a dish of its own; the parent of a frequent word is its root dish, that of a rare word the
  rare dish times its probability in the rare restaurant.

Customers are the counts of all training tokens. A Gibbs step seats all customers of one dish in one
restaurant anew, given the other tables: up to EXACT customers from the exact conditional distribution
of the number of tables (generalised Stirling numbers), beyond that along the seating process in
blocks of customers. The root, which gets a customer per table below, is re-seated between sweeps.
Predictive probabilities are averaged over the last SAMPLES of SWEEPS sweeps.

Word pairs are kept in two places. Those of the CONTEXTS most frequent previous words (and the start)
with the DISHES most frequent next words (and the end) are counted in one table of fixed size that all
tasks get, so that no hot pair is shuffled. All other pairs are shuffled once into buckets of about
BUCKET pairs: by pair for the COMMON previous words, whose numbers of tables are summed over buckets,
and by previous word for the others, whose restaurants lie in one bucket. A bucket keeps its cells
(pair, count) and the rows that hold them. Words beyond the COMMON most frequent are known by a 63-bit
hash there, and their rare-word probabilities come from a shuffled join.

Defined cases: null and empty texts consist of an end; a null id counts as the empty text for the
hold-out; rows that repeat are all scored; without training texts every token is unknown (N = V = 0);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod, frequent, stored

CONTEXTS, DISHES, COMMON, ALPHABET = 256, 2048, 1 << 18, 62
SWEEPS, SAMPLES, EXACT = 6, 3, 48
#: Pairs of a bucket, pairs that a task gathers before it deals them to buckets.
BUCKET, GATHER = 500_000, 1_000_000
#: Numbers of a vector that travel together.
SEGMENT = 8192
START, END = COMMON, COMMON + 1  # keys of the start as a previous word and of the end as a next word
OTHER, STOP = 62, 63  # spelling symbols besides the ALPHABET


def log_stirling(most: int, d: float) -> np.ndarray:
    """Log of generalised Stirling numbers S(c, t) for discount d, -inf where t is impossible."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1:c + 2] = np.logaddexp(out[c, t - 1], out[c, t] + np.log(np.maximum(c - d * t, 1e-300)))
    return out


def seat(c: np.ndarray, p: np.ndarray, theta: float, d: float, others: np.ndarray | float,
         rng: np.random.Generator, table: np.ndarray) -> np.ndarray:
    """Draw the number of tables for dishes with `c` customers and parent probability `p`, given
    `others` tables of other dishes."""
    c, p = np.asarray(c, np.int64), np.maximum(p, 1e-300)
    others = np.broadcast_to(np.asarray(others, float), c.shape)
    out = np.minimum(c, 1)
    low = 2
    for high in (2, 3, 4, 6, 10, 20, EXACT):  # as many columns as tables can be
        small = np.flatnonzero((c >= low) & (c <= high))
        low = high + 1
        for at in range(0, len(small), 20_000):
            pick = small[at:at + 20_000]
            t = np.arange(1, high + 1)
            rising = np.cumsum(np.log(theta / d + others[pick, None] + t - 1), 1)
            weight = table[c[pick], 1:high + 1] + t * (np.log(p[pick, None]) + np.log(d)) + rising
            out[pick] = 1 + np.argmax(weight - np.log(-np.log(rng.random(weight.shape))), 1)
    large = np.flatnonzero(c > EXACT)
    if len(large):
        tables, done = np.ones(len(large)), 1
        most = c[large].max()
        while done < most:
            step = max(1, done // 4)
            n = np.clip(c[large] - done, 0, step)
            fresh = (theta + d * (others[large] + tables)) * p[large]
            old = np.maximum(done + n / 2 - d * tables, 1e-9)
            tables += rng.binomial(n, np.clip(fresh / (fresh + old), 0, 1))
            done += step
        out[large] = tables
    return out


def discount(once: int, twice: int) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once + twice else 0.5


class Spelling:
    """Byte trigrams with interpolated bigrams; `symbol` maps bytes to symbols."""

    def __init__(self, symbol: np.ndarray, counts: np.ndarray):
        self.symbol = symbol
        self.spread = np.log(max(1, int((symbol == OTHER).sum())))  # the other bytes share a symbol
        tri = counts.reshape(64, 64, 64).astype(float)
        bi = tri.sum(0)
        one = (bi.sum(0) + 0.5) / (bi.sum() + 32)
        two = (bi + 8 * one) / (bi.sum(1, keepdims=True) + 8)
        self.log = np.log((tri + 8 * two[None]) / (tri.sum(2, keepdims=True) + 8)).ravel()

    @staticmethod
    def codes(words: list[bytes], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trigram codes of all words, one after another, and where each word begins."""
        sizes = np.array([len(w) for w in words])
        flat = symbol[np.frombuffer(b"\0\0".join([b"", *words, b""]), np.uint8)].astype(np.int64)
        begin = 2 + np.concatenate(([0], np.cumsum(sizes + 2)[:-1])) if len(words) else np.zeros(0, int)
        for gap in (begin - 2, begin - 1, begin + sizes):  # two borders before, one after each word
            flat[gap] = STOP
        code = (flat[:-2] << 12 | flat[1:-1] << 6 | flat[2:])
        ends = np.cumsum(sizes + 1)
        index = np.arange(int(ends[-1]) if len(ends) else 0)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        owner = np.repeat(np.arange(len(words)), sizes + 1)
        return code[(begin - 2)[owner] + index - starts[owner]] if len(words) else code[:0], starts

    def log_p(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        code, starts = self.codes(words, self.symbol)
        return np.add.reduceat(self.log[code] - self.spread * ((code & 63) == OTHER), starts)


def _tokens(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def _count_words(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(counts: Counter) -> pa.RecordBatch:
            return pa.record_batch([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
                                   ["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                counts.update(_tokens(raw))
                if len(counts) > 500_000:
                    yield packed(counts)
                    counts = Counter()
        yield packed(counts)

    return docs.select("raw").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _sum_codes(rows: DataFrame, encode, size: int) -> np.ndarray:
    """Sum, over tasks, of a vector of `size` that `encode` makes of each batch; tasks send it in
    compressed segments, which are summed in tasks too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += encode(batch)
        full = [at for at in range(0, size, SEGMENT) if total[at:at + SEGMENT].any()]
        yield pa.record_batch([pa.array(full, pa.int64()),
                               pa.array([_packed(total[at:at + SEGMENT]) for at in full], pa.binary())],
                              ["at", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(_unpacked(x, np.int64) for x in table.column("n").to_pylist())
        return pa.table({"at": table.column("at").slice(0, 1), "n": pa.array([_packed(total)], pa.binary())})

    out = np.zeros(size, np.int64)
    for at, n in rows.mapInArrow(run, "at bigint, n binary").groupBy("at").applyInArrow(add, "at bigint, n binary").collect():
        out[at:at + SEGMENT] = _unpacked(n, np.int64)
    return out


def _packed(x: np.ndarray) -> bytes:
    """The bytes of an array, compressed plane by plane (first bytes of all numbers, then second ones ...)."""
    return zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), 1) if len(x) else b""


def _unpacked(raw: bytes, kind) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _key(word: bytes) -> int:
    """Negative key of a word that is not among the common ones."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "big", signed=True) | -1 << 63


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket(u: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """Rare previous words keep their pairs together; those of common ones are spread."""
    return (_mixed(_mixed(u) + np.where(u < 0, np.uint64(0), _mixed(w))) % np.uint64(buckets)).astype(np.int64)


def _buckets(part: DataFrame, rare_p: DataFrame, pairs_of, buckets: int) -> DataFrame:
    """One row per bucket of the pairs in `part`: its cells, sorted by pair (u, w, n customers, for each
    w beyond the common words its probability g among rare words, NaN where it was never met), and its
    pairs with rows (cell: whether a new one begins, row, k)."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            u, w, row, k = (np.concatenate(x) for x in zip(*held, strict=True))
            at = _bucket(u, w, buckets)
            order = np.lexsort((w, u, at))
            cuts = np.flatnonzero(np.diff(at[order])) + 1
            lists = [[_packed(x) for x in np.split(v[order], cuts)] for v in (u, w, row, k)]
            return pa.record_batch([pa.array([int(x[0]) for x in np.split(at[order], cuts)], pa.int64()),
                                    *[pa.array(x, pa.binary()) for x in lists]], ["bucket", "u", "w", "row", "k"])

        for batch in batches:
            for row, out, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "held_out", "keys")), strict=True):
                pair = np.stack(pairs_of(_unpacked(raw, np.int64)), 1)
                if len(pair):
                    pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
                    first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]).any(1)))
                    k = np.diff(np.append(first, len(pair))).astype(np.int32)
                    # counts of held-out rows are negative: they are scored, not learned
                    held.append((pair[first, 0], pair[first, 1], np.full(len(first), row, np.int64), -k if out else k))
                    size += len(first)
                if size > GATHER:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [pairs_of(_unpacked(raw, np.int64)) for raw in batch.column("keys").to_pylist()]
            pu, pw = (np.concatenate([x[i] for x in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
            key, at = pw[pw < 0], _bucket(pu[pw < 0], pw[pw < 0], buckets)
            order = np.lexsort((at, key))
            key, at = key[order], at[order]
            new = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1]))[:len(key)]
            yield pa.record_batch([pa.array(key[new]), pa.array(at[new])], ["key", "bucket"])

    def gather(table: pa.Table) -> pa.Table:
        given = table.filter(pc.is_valid(table.column("key")))
        rows = table.filter(pc.is_null(table.column("key")))

        def column(name: str, kind) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *[_unpacked(x, kind) for x in rows.column(name).to_pylist()]])

        u, w, row, k = column("u", np.int64), column("w", np.int64), column("row", np.int64), column("k", np.int32)
        key, prob = given.column("key").to_numpy(), given.column("g").to_numpy()
        order = np.lexsort((w, u))
        u, w, row, k = u[order], w[order], row[order], k[order]
        new = np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])) if len(u) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        n = np.add.reduceat(np.maximum(k, 0).astype(np.int64), first) if len(u) else k.astype(np.int64)
        u, w = u[first], w[first]
        rare = np.flatnonzero(w < 0)
        g = np.full(len(rare), np.nan)
        if len(key) and len(rare):
            order = np.argsort(key, kind="stable")
            key, prob = key[order], prob[order]
            at = np.minimum(np.searchsorted(key, w[rare]), len(key) - 1)
            g = np.where(key[at] == w[rare], prob[at], np.nan)
        return pa.table({"bucket": table.column("bucket").slice(0, 1),
                         **{c: pa.array([_packed(x)], pa.binary()) for c, x in (
                             ("u", u), ("w", w), ("n", n), ("g", g), ("cell", new),
                             ("row", row), ("k", np.abs(k)))}})

    keys = part.select("keys").mapInArrow(rare_words, "key bigint, bucket bigint").distinct()
    keys = keys.join(rare_p, "key").select("bucket", "key", "g")
    both = part.select("row", "held_out", "keys").mapInArrow(
        deal, "bucket bigint, u binary, w binary, row binary, k binary").unionByName(keys, allowMissingColumns=True)
    return stored(both.groupBy("bucket").applyInArrow(
        gather, "bucket bigint, u binary, w binary, n binary, g binary, cell binary, row binary, k binary"), "lm-buckets")


@dataclass
class Sweep:
    """What one sweep starts from: root probabilities of the dishes, tables per common context."""

    number: int
    p0: np.ndarray
    tables: np.ndarray


class Cells:
    """The cells of a bucket, seated for a sweep."""

    def __init__(self, row: dict, n_dish: int, own_p: np.ndarray, unknown: float, d: float, theta: float):
        self.bucket, self.d, self.theta = row["bucket"], d, theta
        self.u, w, self.n = (_unpacked(row[c], np.int64) for c in ("u", "w", "n"))
        g = _unpacked(row["g"], float)
        self.g = np.ones(len(w))  # probability of w within its root dish
        self.g[w < 0] = np.where(np.isnan(g), unknown, g)
        common = (w >= n_dish) & (w < len(own_p))
        self.g[common] = own_p[w[common]]
        self.dish = np.where(w == END, n_dish + 1, np.where((w < 0) | (w >= n_dish), n_dish, w))
        self.rare = self.u < 0
        self.local = np.cumsum(np.append(True, self.u[1:] != self.u[:-1])) - 1 if len(self.u) else self.u

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over the cells with the same context, for each cell."""
        return np.bincount(self.local, values)[self.local] if len(values) else values

    def seated(self, sweep: Sweep, seed: int, table: np.ndarray) -> np.ndarray:
        """Rare contexts are seated twice: from one table per dish, then given those tables."""
        rng = np.random.default_rng([seed, sweep.number, self.bucket])
        p = sweep.p0[self.dish] * self.g
        others = np.zeros(len(self.u))
        others[~self.rare] = sweep.tables[self.u[~self.rare]]
        others[self.rare] = self.sums(np.minimum(self.n, 1))[self.rare]
        t = seat(self.n, p, self.theta, self.d, np.maximum(others - 1, 0), rng, table)
        if self.rare.any():
            others = self.sums(t)[self.rare]
            t[self.rare] = seat(self.n[self.rare], p[self.rare], self.theta, self.d, np.maximum(others - 1, 0), rng, table)
        return t


class Contexts:
    """Context restaurants below a root: `counts` of frequent pairs (contexts x dishes; the last row is
    the start), all other pairs in `buckets`. `customers` per common context, START last. `log10` are
    averaged predictive probabilities of the frequent pairs, `scores` adds those of the others."""

    def __init__(self, buckets: DataFrame, counts: np.ndarray, customers: np.ndarray, n_dish: int,
                 own_p, unknown: float, seed: int):
        spark = buckets.sparkSession
        self.buckets, self.n_dish, self.own_p, self.unknown, self.seed = buckets, n_dish, own_p, unknown, seed
        self.customers, dishes = customers, counts.shape[1]
        rng = np.random.default_rng(seed)
        at = np.append(np.arange(len(counts) - 1), START)  # keys of the rows of `counts`

        def kinds(batch: pa.RecordBatch) -> np.ndarray:
            return sum(np.bincount(np.minimum(_unpacked(x, np.int64), 3), minlength=4) for x in batch.column("n").to_pylist())

        seen = _sum_codes(buckets.select("n"), kinds, 4) + np.bincount(np.minimum(counts, 3).ravel(), minlength=4)
        self.d = d = discount(int(seen[1]), int(seen[2]))
        self.theta = theta = 1.0
        root_d, root_theta = 0.5, 1.0
        root_table, table = log_stirling(EXACT, root_d), log_stirling(EXACT, d)
        frame = spark.createDataFrame([(u, counts[u].tolist()) for u in range(len(counts)) if counts[u].any()],
                                      "u int, n array<bigint>").repartition(16, "u")
        cells = buckets.select("bucket", "u", "w", "n", "g")
        size = START + 1

        def sparse_tables(now: Sweep | None):
            """Tables of common contexts and, after them, of dishes; without a sweep, one for each cell."""
            shared = spark.sparkContext.broadcast(now)

            def encode(batch: pa.RecordBatch) -> np.ndarray:
                out = np.zeros(size + dishes, np.int64)
                for row in batch.to_pylist():
                    own = Cells(row, n_dish, own_p.value, unknown, d, theta)
                    t = np.minimum(own.n, 1) if shared.value is None else own.seated(shared.value, seed, table)
                    out[:size] += np.bincount(own.u[~own.rare], t[~own.rare], size).astype(np.int64)
                    out[size:] += np.bincount(own.dish, t, dishes).astype(np.int64)
                return out

            found = _sum_codes(cells, encode, size + dishes)
            return found[:size], found[size:]

        dense = np.minimum(counts, 1)
        tables, below = sparse_tables(None)
        tables[at] += dense.sum(1)
        p0, total, self.samples = np.full(dishes, 1 / dishes), np.zeros(counts.shape), []
        for sweep in range(SWEEPS):
            now = Sweep(sweep, p0, tables)
            shared = spark.sparkContext.broadcast((p0, tables[at]))

            def reseat(batches: Iterator[pa.RecordBatch], shared=shared, sweep=sweep) -> Iterator[pa.RecordBatch]:
                parent, all_tables = shared.value
                for batch in batches:
                    us = batch.column("u").to_pylist()
                    drawn = []
                    for u, n in zip(us, batch.column("n").to_pylist(), strict=True):
                        own, n = np.random.default_rng([seed, sweep, u]), np.array(n)
                        drawn.append(seat(n, parent, theta, d, max(0, all_tables[u] - 1), own, table))
                    yield pa.record_batch([pa.array(us, pa.int32()), pa.array(drawn, pa.list_(pa.int64()))], ["u", "t"])

            dense = np.zeros_like(counts)
            for u, t in frame.mapInArrow(reseat, "u int, t array<bigint>").collect():
                dense[u] = t
            tables, below = sparse_tables(now)
            tables[at] += dense.sum(1)
            below = below + dense.sum(0)
            root = seat(below, np.full(dishes, 1 / dishes), root_theta, root_d, dishes, rng, root_table)
            p0 = (np.maximum(below - root_d * root, 0) + (root_theta + root_d * root.sum()) / dishes) \
                / (root_theta + below.sum())
            if sweep >= SWEEPS - SAMPLES:
                c, t = customers[at][:, None], tables[at][:, None]
                total += (np.maximum(counts - d * dense, 0) + (theta + d * t) * p0) / (theta + c)
                self.samples.append((now, p0, tables))
        self.log10 = np.log10(total / SAMPLES).astype(np.float32)

    def scores(self) -> DataFrame:
        """row, own: the sum of log10 probabilities of the pairs that lie in buckets."""
        shared = self.buckets.sparkSession.sparkContext.broadcast((self.samples, self.customers))
        n_dish, own_p, unknown, seed, d, theta = self.n_dish, self.own_p, self.unknown, self.seed, self.d, self.theta

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            samples, customers = shared.value
            table = log_stirling(EXACT, d)
            for batch in batches:
                for line in batch.to_pylist():
                    own = Cells(line, n_dish, own_p.value, unknown, d, theta)
                    pick = ~own.rare
                    c = own.sums(own.n).astype(float)
                    c[pick] = customers[own.u[pick]]
                    total = np.zeros(len(own.u))
                    for sweep, p0, tables in samples:
                        t = own.seated(sweep, seed, table)
                        all_tables = own.sums(t).astype(float)
                        all_tables[pick] = tables[own.u[pick]]
                        total += (np.maximum(own.n - d * t, 0)
                                  + (theta + d * all_tables) * p0[own.dish] * own.g) / (theta + c)
                    log = np.log10(total / len(samples))
                    cell, k = np.cumsum(_unpacked(line["cell"], bool)) - 1, _unpacked(line["k"], np.int32)
                    rows, at = np.unique(_unpacked(line["row"], np.int64), return_inverse=True)
                    yield pa.record_batch([pa.array(rows), pa.array(np.bincount(at, log[cell] * k))], ["row", "own"])

        return self.buckets.mapInArrow(run, "row bigint, own double").groupBy("row").agg(F.sum("own").alias("own"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_mod: int = 10,
          held_is: int = 0, seed: int = 11) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams),
    score (log10 probability of the text under the model) and perplexity."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), as_bytes(text_col).alias("raw"),
                        (crc_mod(id_col, held_mod) == held_is).alias("held_out"))
    learn = texts.where(~F.col("held_out"))
    counts = stored(_count_words(learn), "lm-words")
    ends = learn.count()
    size = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_all, v_all = size["n"] + ends, size["v"] + (1 if ends else 0)
    floor = np.log10(n_all + 0.1 * (v_all + 1))

    top = frequent(counts, COMMON).toPandas().sort_values(["n", "word"], ascending=[False, True], kind="stable")
    words, freq = [bytes(w) for w in top["word"]], top["n"].to_numpy(np.int64)
    common = spark.sparkContext.broadcast((words, freq))
    n_dish = min(DISHES, len(words))
    n_context = min(CONTEXTS, len(words))
    end_dish, dishes = n_dish + 1, n_dish + 2  # n_dish itself leads to the rare words

    def ids_of(raw: bytes, get) -> np.ndarray:
        found = _tokens(raw)
        return np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))

    def places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every token and the end: whether its pair is a frequent one; cells (context, dish) of
        those that are."""
        dish = np.append(np.where(ids < n_dish, ids, -1), end_dish)  # negative keys stay negative
        context = np.append(n_context, np.where(ids < n_context, ids, -1))
        pick = (dish >= 0) & (context >= 0)
        return pick, context[pick] * dishes + dish[pick]

    def bigrams(batch: pa.RecordBatch) -> np.ndarray:
        get = _codes(common).get
        total = np.zeros((n_context + 1) * dishes, np.int64)
        for raw in batch.column("raw").to_pylist():
            cells = places(ids_of(raw, get))[1]
            if len(cells) > 10_000:
                total += np.bincount(cells, minlength=len(total))
            else:
                np.add.at(total, cells, 1)
        return total

    cells = _sum_codes(learn.select("raw"), bigrams, (n_context + 1) * dishes).reshape(n_context + 1, dishes)

    # Rare words: spelling of types, then tables per word.
    kept = spark.createDataFrame([(bytearray(w),) for w in words[:n_dish]], "word binary")
    rare = stored(counts.join(F.broadcast(kept), "word", "left_anti"), "lm-rare")

    def byte_counts(batch: pa.RecordBatch) -> np.ndarray:
        return np.bincount(np.frombuffer(b"".join(batch.column("word").to_pylist()), np.uint8), minlength=256)

    usual = np.argsort(-_sum_codes(rare.select("word"), byte_counts, 256), kind="stable")[:ALPHABET]
    symbol = np.full(256, OTHER, np.uint8)
    symbol[usual] = np.arange(len(usual))

    def trigrams(batch: pa.RecordBatch) -> np.ndarray:
        return np.bincount(Spelling.codes(batch.column("word").to_pylist(), symbol)[0], minlength=1 << 18)

    spelling = spark.sparkContext.broadcast(Spelling(symbol, _sum_codes(rare.select("word"), trigrams, 1 << 18)))
    about = rare.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("t"),
                     F.sum((F.col("n") == 1).cast("int")).alias("one"),
                     F.sum((F.col("n") == 2).cast("int")).alias("two")).first()
    customers, all_tables = about["c"], about["t"]
    d, theta = discount(about["one"] or 0, about["two"] or 0), 1.0

    def drawn(tables: int, sweep: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = log_stirling(EXACT, d)
            for batch in batches:
                found, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                p = np.exp(spelling.value.log_p(found))
                rng = np.random.default_rng([seed, sweep, len(found), int(n.sum())])
                mean, t = np.zeros(len(n)), np.zeros(len(n), np.int64)
                for _ in range(SAMPLES):
                    t = seat(n, p, theta, d, max(0, tables - 1), rng, table)
                    mean += (n - d * t + (theta + d * tables) * p) / (theta + customers)
                yield pa.record_batch([batch.column("word"), batch.column("n"), pa.array(t), pa.array(p),
                                       pa.array(np.log10(mean / SAMPLES)), pa.array([_key(w) for w in found], pa.int64())],
                                      ["word", "n", "t", "p", "log10", "key"])

        return rare.mapInArrow(run, "word binary, n bigint, t bigint, p double, log10 double, key bigint")

    spelled = 0.0  # what the spelling model gives to rare words that were met
    for sweep in range(2):
        all_tables, spelled = drawn(all_tables, sweep).agg(
            F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("p"), F.lit(0.0))).first()
    seated = stored(drawn(all_tables, SWEEPS).select("word", "n", "log10", "key"), "lm-seated")
    unknown = (theta + d * all_tables) / (theta + customers) * max(1 - spelled, 1 / (v_all + 1))

    tail = seated.join(F.broadcast(_words_frame(spark, words[n_dish:])), "word").toPandas() if len(words) > n_dish else None
    code = {w: i for i, w in enumerate(words)}
    own = np.zeros(len(words))
    if tail is not None and len(tail):
        own[[code[bytes(w)] for w in tail["word"]]] = tail["log10"].to_numpy()
    own_p = spark.sparkContext.broadcast(10.0 ** own)
    base = np.log10(freq + 0.1) - floor
    base_all = spark.sparkContext.broadcast(base)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, base_log = _codes(common).get, base_all.value
        for batch in batches:
            n_tokens, n_known, bases, others, packed = [], [], [], [], []
            for raw in batch.column("raw").to_pylist():
                found = _tokens(raw)
                ids = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
                met = ids[ids >= 0]
                rare_at = np.flatnonzero(ids < 0).tolist()
                keys = ids.copy()
                keys[rare_at] = [_key(found[i]) for i in rare_at]
                n_tokens.append(len(ids) + 1)
                n_known.append(len(met) + (1 if ends else 0))
                bases.append(float(base_log[met].sum() + np.log10(ends + 0.1) - floor))
                packed.append(_packed(keys))
                others.append(list(Counter(found[i] for i in rare_at).items()))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens, pa.int64()),
                 pa.array(n_known, pa.int64()), pa.array(bases, pa.float64()), pa.array(packed, pa.binary()),
                 pa.array([[{"word": w, "k": k} for w, k in row] for row in others],
                          pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "keys", "others"])

    part = stored(texts.mapInArrow(known, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, "
                                          "keys binary, others array<struct<word: binary, k: bigint>>")
                  .withColumn("row", F.monotonically_increasing_id()), "lm-part")
    tokens = part.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    rare_p = seated.select("key", F.pow(F.lit(10.0), "log10").alias("g"))

    def other_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pick = ~places(keys)[0]
        return np.append(START, keys)[pick], np.append(keys, END)[pick]

    buckets = _buckets(part, rare_p, other_pairs, max(12, -(-tokens // BUCKET)))
    customers_of = np.zeros(START + 1, np.int64)
    customers_of[:len(freq)], customers_of[START] = freq, ends
    contexts = Contexts(buckets, cells, customers_of, n_dish, own_p, unknown, seed)
    cell_all = spark.sparkContext.broadcast(contexts.log10.ravel())

    def frequent_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [float(cell_all.value[places(_unpacked(x, np.int64))[1]].sum(dtype=float)) for x in batch.column("keys").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in head), pa.array(sums, pa.float64())], [*head, "score"])

    head = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    scored = part.select(*head, "keys").mapInArrow(
        frequent_pairs, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    pairs = part.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.k")
    joined = pairs.join(seated.select("word", "n"), "word", "left")

    n, k = F.coalesce("n", F.lit(0)), F.col("k")
    rest = joined.groupBy("row").agg(
        F.sum(F.when(n > 0, k).otherwise(0)).alias("more"),
        F.sum(k * (F.log10(n + 0.1) - F.lit(float(floor)))).alias("base"))
    zero = F.lit(0.0)
    out = scored.join(rest, "row", "left").join(contexts.scores(), "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("own", zero)).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _words_frame(spark, words: list[bytes]) -> DataFrame:
    return spark.createDataFrame([(bytearray(w),) for w in words], "word binary")


_CODES: dict[int, dict[bytes, int]] = {}


def _codes(common) -> dict[bytes, int]:
    """Ids of the common words, made once per worker."""
    words = common.value[0]
    if id(words) not in _CODES:
        _CODES.clear()
        _CODES[id(words)] = {w: i for i, w in enumerate(words)}
    return _CODES[id(words)]
