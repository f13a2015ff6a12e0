"""N-gram Jaccard join by chosen paths.

A text is the set of its hashed shingles of N words. Texts with equal sets are one class. In each run
a set x goes along the tokens whose hash (of run and path) is below BETA / (threshold * |x|), so that
two similar sets share BETA tokens on average; sets on the same path of two tokens form a bucket.
Buckets of more than SMALL classes are split in the same way by one more token, until they are small,
or hold together (more than half of the parent stays: near copies), or DEPTH is reached. The upper half of
a first key is that of its path of one token, so that the size of that parent is counted from the keys
themselves, and a group that holds together is not split at all. Buckets are then
compared by brute force on the exact sets. A pair at the threshold meets in a run with the probability
`q = 1 - exp(-BETA q')` (q' that of the next level), and the number of runs follows from the target
recall. Every pair counts in the first of its buckets only, so links are counted exactly without
listing the pairs of large groups; what leaves a bucket is a count per class and a spanning forest.

Defined cases: null and empty texts have no shingles and are alone, with themselves as class; texts of
fewer than N words are one shingle; repeated rows are in one class; a null id stays null and is never
the smallest; an empty table gives no rows; other columns are not read by `similar_texts` and pass
through `one_of_each`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, as_bytes, prefiltered, stored
from .components import components

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
BETA, SMALL, DEPTH = 2.0, 48, 4
#: Classes of a bucket compared in one task; larger buckets are compared block by block.
BLOCK = 2048
HEAVY = 1 / 500
#: Words whose hashes a task remembers, and their longest; cells of the arrays of one step, pairs compared at once
#: and cells of a matrix of sets and tokens.
REMEMBERED, LONG, CELLS, PAIRS, SLICE = 150_000, 64, 1 << 16, 1 << 20, 4_000_000

_LOW = np.uint64(0xFFFFFFFF)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = got
        return got


def shingle_set(raw: bytes, hashes: WordHashes, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the runs of `n` words."""
    words = raw.translate(WORD_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - size + 1 + k]
    return np.unique(mix(total))


def path_keys(tokens: np.ndarray, parents: np.ndarray, threshold: float, family: bool = False) -> np.ndarray:
    """Paths one token longer, for a set on each of the parent paths; with `family`, keys that keep the
    upper half of the parent's."""
    limit = BETA / (threshold * len(tokens))
    out = [np.zeros(0, np.uint64)]
    step = max(1, CELLS // len(tokens))
    for at in range(0, len(parents), step):
        some = parents[at:at + step]
        drawn = mix(tokens ^ mix(some)[:, None]).ravel()
        spots = np.arange(len(drawn)) if limit >= 1 else np.flatnonzero(drawn < np.uint64(limit * 2.0 ** 64))
        parent = some[spots // len(tokens)]
        longer = mix(drawn[spots] ^ parent)
        out.append(longer & _LOW | parent & ~_LOW if family else longer)
    return np.concatenate(out)


def runs_for(recall: float) -> int:
    """Runs until a pair at the threshold is missed with probability 1 - recall at most."""
    q = 1.0
    for _ in range(DEPTH):
        q = 1 - math.exp(-BETA * q)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def _roots(runs: int) -> np.ndarray:
    return mix(np.arange(1, runs + 1, dtype=np.uint64) * _M1)


def _packed(keys: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)))


def _sets(docs: DataFrame, n: int, threshold: float, runs: int) -> DataFrame:
    """doc_id and hash of the text, digest of the set, its size and its paths of two tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, roots = WordHashes(), _roots(runs)
        for batch in batches:
            digests, sizes, keys = [], [], []
            for raw in batch.column("raw"):
                tokens = shingle_set(raw.as_py(), hashes, n)
                sizes.append(len(tokens))
                digests.append(hashlib.md5(tokens.tobytes()).digest())
                paths = np.unique(path_keys(tokens, roots, threshold)) if len(tokens) else tokens
                keys.append(np.unique(path_keys(tokens, paths, threshold, family=True)) if len(tokens) else tokens)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(digests, pa.binary()),
                                   pa.array(sizes, pa.int64()), _packed(keys)], ["doc_id", "text_hash", "digest", "n", "keys"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, digest binary, n bigint, keys array<bigint>")


def _longer(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (cls, tokens, parents with their sizes) give (key, cls, size of the parent)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, tokens = batch.column("parents"), batch.column("tokens")
            ends, parts = lists.offsets.to_numpy(), lists.values
            parent, size = (parts.field(k).to_numpy() for k in ("key", "m"))
            cls, up, keys = [], [], []
            for i, c in enumerate(batch.column("cls").to_numpy()):
                own = np.frombuffer(tokens[i].as_buffer(), np.uint64)
                for at in range(ends[i], ends[i + 1]):
                    found = np.unique(path_keys(own, parent[at:at + 1].view(np.uint64), threshold))
                    keys.append(found)
                    cls.append(np.full(len(found), c, np.int64))
                    up.append(np.full(len(found), size[at], np.int64))
            none = np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(np.concatenate([*up, none])),
                                   pa.array(np.concatenate([*keys, none.view(np.uint64)]).view(np.int64)),
                                   pa.array(np.concatenate([*cls, none]))], ["was", "key", "cls"])

    return rows.mapInArrow(run, "was bigint, key bigint, cls bigint").select("key", "cls", "was")


class Incidence:
    """Which sets hold which tokens, for tokens that several sets hold."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = len(sets)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.append(True, flat[1:] != flat[:-1])[:len(flat)]
        uses = np.diff(np.append(np.flatnonzero(new), len(flat)))
        keep = np.repeat(uses > 1, uses)  # others cannot be common
        self.owner, self.size = owner[keep], int((uses > 1).sum())
        self.ids = np.repeat(np.arange(self.size, dtype=np.int32), uses[uses > 1])

    def common(self, rows: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the sets `rows` with all sets, by products of matrices over slices
        of the tokens."""
        out = np.zeros((len(rows), self.sets), np.float32)
        width = max(256, SLICE // max(1, self.sets))
        for at in range(0, self.size, width):
            a, b = np.searchsorted(self.ids, (at, at + width))
            block = np.zeros((self.sets, min(width, self.size - at)), np.float32)
            block[self.owner[a:b], self.ids[a:b] - at] = 1
            out += block[rows] @ block.T
        return out


def _compare(threshold: float):
    """Brute force within a bucket (or two blocks of one)."""
    def run(table: pa.Table) -> pa.Table:
        cls = table.column("cls").to_numpy()
        order = np.argsort(cls)
        cls, copies = cls[order], table.column("copies").to_numpy()[order]
        side, raw, before = table.column("side").to_numpy()[order], table.column("tokens"), table.column("before")
        sets = [np.frombuffer(raw[i].as_buffer(), np.uint64) for i in order]
        m, n = len(cls), np.array([len(s) for s in sets])
        held = Incidence(sets)
        # Buckets that come before this one and are shared by members: those pairs count there.
        met = Incidence([before[i].values.to_numpy().view(np.uint64) for i in order])
        links, similar, edges = np.zeros(m, np.int64), np.zeros(m, np.int64), []
        two = side.min() != side.max() if m else False
        tree = np.arange(m)  # the smallest member of each one's part of the forest

        step = max(64, PAIRS // max(1, m))
        for at in range(0, m, step):
            rows = np.arange(at, min(m, at + step))
            open_pairs = np.minimum(n[rows, None], n) >= threshold * np.maximum(n[rows, None], n)
            open_pairs &= rows[:, None] < np.arange(m)
            if two:  # the blocks' own pairs are compared elsewhere
                open_pairs &= side[rows, None] != side
            open_pairs &= met.common(rows) == 0
            need = np.flatnonzero(open_pairs.any(1))
            if not len(need):
                continue
            both = held.common(rows[need])
            linked = open_pairs[need] & (both >= threshold * (n[rows[need], None] + n - both) - 1e-6)
            links += linked.sum(0)
            links[rows[need]] += linked.sum(1)
            similar += copies[rows[need]] @ linked
            similar[rows[need]] += linked @ copies
            for i, row in zip(rows[need], linked, strict=True):
                others = np.flatnonzero(row)
                for j in others[np.sort(np.unique(tree[others], return_index=True)[1])]:
                    if tree[i] != tree[j]:
                        a, b = sorted((tree[i], tree[j]))
                        tree[tree == b] = a
                        edges.append((cls[i], cls[j]))
        some = np.flatnonzero(links)
        return pa.table({
            "u": pa.array(np.concatenate([cls[some], [e[0] for e in edges]]).astype(np.int64)),
            "v": pa.array(np.concatenate([np.full(len(some), -1), [e[1] for e in edges]]).astype(np.int64)),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(edges))]).astype(np.int64)),
            "similar": pa.array(np.concatenate([similar[some], np.zeros(len(edges))]).astype(np.int64))})

    return run


def _with_parents(buckets: DataFrame) -> DataFrame:
    """First buckets (key, cls, m): large ones with the size of their parent, counted over the classes that
    meet others below it."""
    family = F.shiftright("key", 32)
    large = buckets.where(F.col("m") > SMALL).withColumn("family", family)
    below = buckets.withColumn("family", family).join(large.select("family").distinct(), "family", "left_semi")
    sizes = below.groupBy("family").agg(F.countDistinct("cls").alias("was"))
    return large.join(sizes, "family").drop("family")


def _leaves(first: DataFrame, cand: DataFrame, threshold: float) -> DataFrame:
    """Final buckets (key, cls, m): small ones, those that hold together, and the deepest."""
    members = first.withColumn("was", F.lit(None).cast("bigint"))
    leaves = None
    for depth in range(2, DEPTH + 1):
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.first("was").alias("was")).where("m > 1")
        now = stored(members.drop("was").join(sizes, "key"), "buckets")
        part = now if depth == DEPTH else now.where(F.col("m") <= SMALL)
        part = part.select("key", "cls", "m")
        leaves = part if leaves is None else leaves.unionByName(part)
        if depth == DEPTH:
            return leaves
        large = stored(_with_parents(now.drop("was")), "large") if depth == 2 else now.where(F.col("m") > SMALL)
        whole = F.col("m") * 2 > F.col("was")
        leaves = leaves.unionByName(large.where(whole).select("key", "cls", "m"))
        big = large.where(~whole)
        if big.isEmpty():
            return leaves
        parents = big.groupBy("cls").agg(F.collect_set(F.struct("key", "m")).alias("parents"))
        some = stored(prefiltered(cand, "cls", parents), "split")  # the next Python step gets workers after this one
        members = _longer(some.join(parents, "cls").select("cls", "tokens", "parents"), threshold)
    return leaves


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
                  threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per document: doc_id; class_id, the smallest doc_id of its group of linked texts; set_id, the
    smallest doc_id with the same shingles; n_links, the number of other shingle sets at similarity
    `threshold` or more; n_similar, the number of other documents that are as similar."""
    return _resolved(docs, id_col, text_col, n, threshold, recall).drop("digest", "text_hash")


def _resolved(docs, id_col, text_col, n, threshold, recall) -> DataFrame:
    plain = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), as_bytes(text_col).alias("raw"))
    plain = plain.withColumn("text_hash", F.xxhash64("raw"))
    sets = stored(_sets(plain, n, threshold, runs_for(recall)), "sets")
    own = sets.where("n > 0")
    classes = stored(own.groupBy("digest").agg(
        F.min("doc_id").alias("set_id"), F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("keys").alias("keys")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    paths = classes.select(F.explode("keys").alias("key"), "cls")
    shared = paths.join(paths.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")
    first = stored(shared, "paths")
    wanted = classes.join(first.select("cls").distinct(), "cls", "left_semi").select("cls", "digest", "copies", "set_id", "text_hash")
    wanted = stored(wanted.withColumnRenamed("set_id", "doc_id"), "wanted")
    met = stored(prefiltered(plain.drop("text_hash"), "doc_id", wanted), "texts")  # the tokens get workers after this
    texts = met.join(wanted.drop("text_hash"), "doc_id")
    if not wanted.where("doc_id IS NULL").isEmpty():  # sets of rows without an id: one text of each by its hash
        lost = wanted.where("doc_id IS NULL").drop("doc_id")
        held = prefiltered(plain.where("doc_id IS NULL"), "text_hash", lost).dropDuplicates(["text_hash"])
        texts = texts.unionByName(held.join(lost, "text_hash").select(*texts.columns))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            cls, copies, out = [], [], []
            for c, k, digest, raw in zip(*(batch.column(x).to_pylist() for x in ("cls", "copies", "digest")), batch.column("raw"), strict=True):
                found = shingle_set(raw.as_py(), hashes, n).tobytes()
                if hashlib.md5(found).digest() == digest:  # ids may repeat with other texts
                    cls.append(c)
                    copies.append(k)
                    out.append(found)
            yield pa.record_batch([pa.array(cls, pa.int64()), pa.array(copies, pa.int64()), pa.array(out, pa.binary())],
                                  ["cls", "copies", "tokens"])

    cand = stored(texts.mapInArrow(tokens, "cls bigint, copies bigint, tokens binary"), "candidates")
    cand = cand.dropDuplicates(["cls"]) if docs_repeat(sets) else cand
    leaves = stored(_leaves(first, cand, threshold), "leaves")
    # Buckets in one order for all: larger ones first; a bucket inside an earlier one adds nothing.
    ordered = leaves.select("cls", "m", "key", F.struct(-F.col("m"), F.col("key")).alias("place"))
    lists = ordered.groupBy("cls").agg(F.sort_array(F.collect_list("place")).alias("all"))
    listed = ordered.join(lists, "cls").select(
        "key", "cls", "m", F.transform(F.filter("all", lambda p: p < F.col("place")), lambda p: p["key"]).alias("before"))
    inside = (listed.select("key", "m", F.explode("before").alias("earlier")).groupBy("key", "earlier")
              .agg(F.count(F.lit(1)).alias("both"), F.first("m").alias("m")).where("both = m").select("key").distinct())
    listed = stored(listed.join(inside, "key", "left_anti"), "listed")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    others = F.sequence(F.lit(0), blocks - 1)
    spread = listed.select("key", "cls", "before", block.alias("side"), F.explode(F.transform(
        others, lambda b: F.struct(F.least(b, block).alias("a"), F.greatest(b, block).alias("b")))).alias("pair"))
    pairs = spread.join(prefiltered(cand, "cls", listed), "cls").select("key", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"),
                                            "cls", "copies", "side", "before", "tokens")
    found = stored(pairs.groupBy("key", "a", "b").applyInArrow(
        _compare(threshold), "u bigint, v bigint, links bigint, similar bigint"), "links")
    counts = found.where("v = -1").groupBy(F.col("u").alias("cls")).agg(
        F.sum("links").alias("n_links"), F.sum("similar").alias("n_similar"))
    groups = components(found.where("v >= 0").select("u", "v")).select(F.col("u").alias("cls"), "component")
    marked = classes.join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    heads = marked.groupBy("component").agg(F.min("set_id").alias("class_id"))
    full = stored(marked.join(heads, "component").join(counts, "cls", "left").select(
        "digest", "class_id", "set_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.coalesce("n_similar", F.lit(0)) + F.col("copies") - 1).alias("n_similar"), "copies"), "resolved")
    rows = own.select("doc_id", "text_hash", "digest")
    heavy = max(2, int((full.agg(F.sum("copies")).first()[0] or 0) * HEAVY))
    hot = F.broadcast(full.where(F.col("copies") > heavy))
    cold = rows.join(hot.select("digest"), "digest", "left_anti")
    out = rows.join(hot, "digest").unionByName(cold.join(full.where(F.col("copies") <= heavy), "digest"))
    alone = sets.where("n = 0").select(
        "doc_id", "text_hash", "digest", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"),
        F.lit(0).cast("bigint").alias("n_links"), F.lit(0).cast("bigint").alias("n_similar"))
    names = ["doc_id", "text_hash", "digest", "class_id", "set_id", "n_links", "n_similar"]
    return out.select(*names).unionByName(alone.select(*names))


def docs_repeat(sets: DataFrame) -> bool:
    """Whether ids repeat, so that a class may have met its text twice."""
    return not sets.groupBy("doc_id").count().where("count > 1").isEmpty()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
                threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of `docs` with the smallest id of their group, all columns, one row per group; rows
    without words or id stay."""
    found = _resolved(docs, id_col, text_col, n, threshold, recall)
    own, sha = "__own_id__", "__own_hash__"
    gone = found.where(F.col("doc_id") > F.col("class_id")).select(F.col("doc_id").alias(own), F.col("text_hash").alias(sha)).distinct()
    marked = docs.withColumn(own, F.col(f"`{id_col}`").cast("bigint")).withColumn(sha, F.xxhash64(as_bytes(text_col)))
    left = marked.join(gone, [own, sha], "left_anti")  # an id may repeat with another text
    if docs_repeat(found.select("doc_id", "digest")):
        left = left.dropDuplicates([own, sha])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
