"""Removal of repeated byte strings of SPAN bytes by a depth-limited radix sort of suffixes.

Suffixes are ordered only through SPAN bytes, most significant digit first, and a suffix that is
alone in its group leaves. The first digit is an anchor: of the ANCHOR-byte strings inside a window of
SPAN bytes the one with the least hash, the leftmost if equal. Equal windows have the same anchor at
the same place, so one suffix per anchor (about 2 of 70) stands for all windows around it, and an
anchor that occurs once means that none of its windows repeats. Anchors that repeat carry their
context, the bytes that their windows reach. Of equal contexts in one task only the first occurrence
goes on, the others repeat it. Contexts of a group are told apart window by window; a group of more
than GROUP contexts is first dealt by a longer digit (the bytes common to half of the windows), again
and again, down to single windows.

Which anchors repeat, and which texts have copies, reaches the tasks as bitmaps of a fixed size; a
wrong hit there costs a row that a later pass drops, never a result.

Occurrences are ordered by doc_id, then text hash, then start. Defined cases: null and empty texts
have no bytes; texts under SPAN bytes keep everything; of rows with the same text only one of the
smallest doc_id can keep bytes, the others lose all (if they have SPAN bytes); a null id comes last;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bitmap, marked, stored, with_groups

SPAN, ANCHOR, GROUP = 100, 32, 3000
#: Contexts that a task remembers; contexts compared in one call.
HELD, BUCKET = 60_000, 20_000
LAST = (1 << 63) - 1
_P = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)
#: Bytes of a text looked at in one piece; pieces overlap by SPAN - 1 bytes.
PIECE = 1 << 22


def _hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the string of `size` bytes (a power of two) at every place."""
    h, width, power = raw.astype(np.uint64) + np.uint64(1), 1, _P
    while width < size:
        h = h[:len(h) - width] * power + h[width:]
        width *= 2
        with np.errstate(over="ignore"):
            power = power * power
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(raw: bytes, span: int = SPAN, size: int = ANCHOR, step: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of a text, their hashes, and the first and last start of the windows
    of each. An anchor whose windows begin in two pieces is one anchor."""
    out: list[tuple[np.ndarray, ...]] = []
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(data) - span + 1), step - span + 1):
        piece = data[at:at + step]
        if len(piece) < span:
            break
        h = _hashes(piece, size)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width, need = 1, span - size + 1
        while width * 2 <= need:
            low = np.minimum(low[:len(low) - width], low[width:])
            width *= 2
        if width < need:
            low = np.minimum(low[:len(low) - (need - width)], low[need - width:])
        place = (low & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        out.append((place[first] + at, h[place[first]].view(np.int64), first + at, last + at))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    place, h, first, last = (np.concatenate(c) for c in zip(*out, strict=True))
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[new], h[new], first[new], last[np.append(new[1:], len(place)) - 1]


def _first_texts(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """One row (oid, dkey, raw) of each text of SPAN bytes or more, that of its head. Only texts
    that may have copies are joined with the heads."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(bitmap(heads.where("group_size > 1"), "dkey", 24))

    def picked(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(marked(shared.value, batch.column("dkey").to_numpy()) == want))

        return texts.mapInArrow(run, "oid bigint, dkey bigint, raw binary")

    copies = stored(picked(True).join(heads.select("dkey", "oid"), ["dkey", "oid"], "left_semi")
                    .dropDuplicates(["dkey", "oid"]).select("oid", "dkey", "raw"), "copied-texts")
    return picked(False).unionByName(copies)


def _anchor_counts(texts: DataFrame, piece: int) -> DataFrame:
    """Anchor hashes with their numbers of occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in batch.column("raw").to_pylist():
                pos, h, _, _ = anchors(raw, step=piece)
                found.append(h[np.unique(pos, return_index=True)[1]])
            h, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.record_batch([pa.array(h), pa.array(n)], ["h", "n"])

    return texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


ROWS = "key bigint, lo bigint, hi bigint, a bigint, b bigint, ctx binary, oid bigint, dkey bigint, pos bigint"
FOUND = "dkey bigint, s bigint, e bigint"


def _contexts(texts: DataFrame, often: np.ndarray, piece: int) -> DataFrame:
    """The first radix groups: key, lo, hi (offsets before the anchor that the group deals with), a, b
    (those that this anchor has), ctx (bytes from the start of window b to the end of window a), and
    oid, dkey, pos. An occurrence after another one of the same context in the same task repeats it:
    it comes with a null ctx and the windows' starts, from lo to hi."""
    shared = texts.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, int, bytes], tuple[int, int, int, int]] = {}
        names = ("key", "lo", "hi", "a", "b", "ctx", "oid", "dkey", "pos")

        def packed(cols: list[list]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.binary() if k == "ctx" else pa.int64())
                                    for k, c in zip(names, cols, strict=True)], list(names))

        def held() -> Iterator[pa.RecordBatch]:
            items = list(first.items())
            first.clear()
            for at in range(0, len(items), 20_000):
                part = items[at:at + 20_000]
                yield packed([[v[3] for _, v in part], [0] * len(part), [SPAN - ANCHOR] * len(part),
                              [k[0] for k, _ in part], [k[1] for k, _ in part], [k[2] for k, _ in part],
                              *([v[j] for _, v in part] for j in range(3))])

        for batch in batches:
            gone: list[tuple[int, int, int]] = []
            for oid, key, raw in zip(*(batch.column(k).to_pylist() for k in ("oid", "dkey", "raw")), strict=True):
                pos, h, start, end = anchors(raw, step=piece)
                keep = np.flatnonzero(marked(shared.value, h))
                for p, x, s, e in zip(*(c[keep].tolist() for c in (pos, h, start, end)), strict=True):
                    context = (p - e, p - s, raw[s:e + SPAN])
                    own, known = (oid, key, p, x), first.get(context)
                    if known is None:
                        first[context] = own
                    elif own[:3] == known[:3]:
                        continue
                    elif own[:3] > known[:3]:
                        if gone and gone[-1][0] == key and gone[-1][2] == s - 1:
                            gone[-1] = (key, gone[-1][1], e)
                        else:
                            gone.append((key, s, e))
                    else:
                        gone.append((known[1], known[2] - context[1], known[2] - context[0]))
                        first[context] = own
            if gone:
                none = [None] * len(gone)
                yield packed([none, [g[1] for g in gone], [g[2] for g in gone], none, none, none, none, [g[0] for g in gone], none])
            if len(first) > HELD:
                yield from held()
        yield from held()

    return texts.mapInArrow(run, ROWS)


def _told_apart(table: pa.Table) -> pa.Table:
    """Many groups: the windows that an occurrence before has, in (oid, dkey, pos) order."""
    key = table.column("key").to_numpy()
    _, which, sizes = np.unique(key, return_inverse=True, return_counts=True)
    table = table.filter(pa.array(sizes[which] > 1))  # a suffix that is alone leaves
    rows = sorted(zip(*(table.column(k).to_pylist() for k in ("key", "oid", "dkey", "pos", "a", "b", "ctx")), strict=True))
    met: set[tuple[int, bytes]] = set()
    keys, starts, ends = [], [], []
    last = own = None
    for key, oid, dkey, pos, a, b, ctx in rows:
        if key != last:
            met, last = set(), key
        if (oid, dkey, pos) == own and met:
            continue
        own = (oid, dkey, pos)
        for o in range(b, a - 1, -1):
            window = (o, ctx[b - o:b - o + SPAN])
            if window not in met:
                met.add(window)
            elif keys and keys[-1] == dkey and ends[-1] == pos - o - 1:
                ends[-1] = pos - o
            else:
                keys.append(dkey)
                starts.append(pos - o)
                ends.append(pos - o)
    return pa.table({"dkey": pa.array(keys, pa.int64()), "s": pa.array(starts, pa.int64()), "e": pa.array(ends, pa.int64())})


def _halves(rows: DataFrame) -> DataFrame:
    """The next digit: each half of the offsets, grouped by the bytes common to its windows."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2)
    half = F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")),
                             F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi"))))
    two = rows.withColumn("half", half).withColumn("a2", F.greatest("a", "half.lo")).withColumn("b2", F.least("b", "half.hi"))
    two = two.where("half.lo <= half.hi and a2 <= b2")
    core = F.substring("ctx", (F.col("b") - F.col("half.lo") + 1).cast("int"),
                       (F.col("half.lo") - F.col("half.hi") + SPAN).cast("int"))
    ctx = F.substring("ctx", (F.col("b") - F.col("b2") + 1).cast("int"), (F.col("b2") - F.col("a2") + SPAN).cast("int"))
    return two.select(F.xxhash64("half.lo", "half.hi", core).alias("key"), F.col("half.lo").alias("lo"),
                      F.col("half.hi").alias("hi"), F.col("a2").alias("a"), F.col("b2").alias("b"), ctx.alias("ctx"),
                      "oid", "dkey", "pos")


def repeated_windows(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """Radix passes over anchor contexts; starts (from s to e) of windows that occur earlier."""
    rows = stored(rows, "contexts")
    found = rows.where("ctx is null").select("dkey", F.col("lo").alias("s"), F.col("hi").alias("e"))
    rows = rows.where("ctx is not null")
    buckets = max(64, rows.count() // BUCKET)
    while True:
        large_keys = stored(rows.groupBy("key").count().where(F.col("count") > group).select("key"), "large-groups")
        some_large = not large_keys.isEmpty()
        small = rows.join(large_keys, "key", "left_anti") if some_large else rows
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
        found = found.unionByName(small.groupBy(bucket).applyInArrow(_told_apart, FOUND))
        if not some_large:
            return found
        # Large groups: all but the first of equal contexts repeat, the first ones get a longer digit.
        large = stored(_halves(rows.join(large_keys, "key")), "halves")
        place = F.struct("oid", "dkey", "pos")
        kinds = ["key", "lo", "hi", "a", "b", "ctx"]
        first = stored(large.groupBy(*kinds).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
        later = large.join(first.where("n > 1"), kinds).where(place > F.col("first"))
        found = found.unionByName(later.select("dkey", (F.col("pos") - F.col("b")).alias("s"), (F.col("pos") - F.col("a")).alias("e")))
        rows = first.select(*kinds, "first.oid", "first.dkey", "first.pos")


def _cut(texts: DataFrame) -> DataFrame:
    """Rows (dkey, raw, starts) give n_removed, n_spans, kept_sha256 and the removed spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, shas, where = [], [], [], []
            for raw, starts in zip(batch.column("raw").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                change = np.zeros(len(raw) + 1, np.int32)
                np.add.at(change, [x["s"] for x in starts], 1)
                np.add.at(change, [x["e"] + SPAN for x in starts], -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                removed.append(int(gone.sum()))
                spans.append(len(edges) // 2)
                where.append(edges.tolist())
                shas.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.record_batch([batch.column("dkey"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                                   pa.array(shas, pa.string()), pa.array(where, pa.list_(pa.int64()))],
                                  ["dkey", "n_removed", "n_spans", "kept_sha256", "edges"])

    return texts.mapInArrow(run, "dkey bigint, n_removed bigint, n_spans bigint, kept_sha256 string, edges array<bigint>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and edges (start and end of
    the removed runs, one after another). Texts are looked at in pieces of `piece` bytes, at most PIECE."""
    oid = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LAST))
    raw = as_bytes(text_col)
    texts = docs.select(oid.alias("oid"), raw.alias("raw")).withColumn("dkey", F.xxhash64("raw"))
    rows = stored(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), oid.alias("oid"), F.octet_length(raw).cast("bigint").alias("n_bytes"),
                              F.xxhash64(raw).alias("dkey"), F.sha2(raw, 256).alias("sha"))
                  .withColumn("row", F.monotonically_increasing_id()), "rows")
    heads = stored(rows.groupBy("dkey").agg(F.min(F.struct("oid", "row")).alias("head"), F.count(F.lit(1)).alias("group_size"))
                   .select("dkey", F.col("head.oid").alias("oid"), F.col("head.row").alias("head"), "group_size"), "heads")
    once = _first_texts(texts.where(F.length("raw") >= SPAN).select("oid", "dkey", "raw"), heads)
    often = bitmap(_anchor_counts(once, piece).where("n > 1"), "h", 27)
    windows = repeated_windows(_contexts(once, often, piece))
    starts = stored(windows.groupBy("dkey").agg(F.collect_list(F.struct("s", "e")).alias("starts")), "starts")
    wanted = texts.join(starts.join(heads, "dkey").select("dkey", "oid", "starts"), ["dkey", "oid"])
    cut = stored(_cut(wanted.select("dkey", "raw", "starts")), "cut").dropDuplicates(["dkey"])
    both = heads.drop("oid").join(cut, "dkey", "left")
    total = rows.count()
    full = with_groups(rows, both, "dkey", max(2, total // 500))
    copy = (F.col("row") != F.col("head")) & (F.col("n_bytes") >= SPAN)
    zero = F.lit(0).cast("bigint")
    return full.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(zero, F.col("n_bytes"))).otherwise(F.coalesce("edges", F.array().cast("array<bigint>"))).alias("edges"))
