"""Byte-level BPE: ranked merges over the distinct words of blocks of texts.

Each task cuts its texts into words (matches of the tokenizer's pattern), keeps a list of the distinct
words of a block of documents and one code per word. The words of a list are merged together: the ids
of their pieces lie in one array, and every step joins, in each word, the leftmost pair of lowest rank
and looks up the two new pairs. Words that are in the vocabulary as a whole are one token, as in the
tiktoken library. Then the codes of each document are replaced by the merged words. No text is
shuffled: a list stands before the documents that use it.
Words of many blocks are merged once: Spark counts the words of one text in SHARE, the most frequent
ones (at most COMMON) are merged beforehand, and all tasks get them with their ids; a block merges only
what is not among them. Which words these are decides where a word is merged, not into what.
Decoding concatenates the pieces of the ids: an Arrow array of pieces is taken by the ids, and its bytes are cut
at the ends of the documents. The ids are written as text in the same way.

The rank map is two arrays: a pair (a, b) of ids, as the number a * 65536 + b, stands either at
place `pair % PRIMES[0]` of the first or at `pair % PRIMES[1]` of the second.

Defined cases: null and empty texts have no tokens; words over LONG bytes are merged with a heap
in Python, as these steps would take time with the square of the length; equal rows give equal ids; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frequent, slices, stored

#: A block ends at so many distinct words or word codes; so many words go into one row of its list.
WORDS, CODES, CHUNK = 500_000, 8_000_000, 200
SHARE, COMMON = 16, 1 << 18
LONG, NONE = 200, 1 << 20
#: Ids that are assembled or written at once.
TOKENS = 2_000_000
PRIMES = (130003, 140009)


class Ranks:
    """Vocabulary of a rank file: `pieces` by id, `ids` by piece, and the pair table."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = [b""] * (max(self.ids.values()) + 1)
        for piece, number in self.ids.items():
            self.pieces[number] = piece
        if len(self.pieces) > 1 << 16:
            raise ValueError("a rank file of at most 65,536 pieces is needed")
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)

    @cached_property
    def pairs(self) -> dict[int, int]:
        get = self.ids.get
        return {a << 16 | b: number for piece, number in self.ids.items() for i in range(1, len(piece))
                if (a := get(piece[:i])) is not None and (b := get(piece[i:])) is not None}

    @cached_property
    def tables(self) -> tuple[list[int], list[int]]:
        """Cuckoo tables; an entry is pair * 65536 + merged id, and -1 where free."""
        tables = ([-1] * PRIMES[0], [-1] * PRIMES[1])
        for pair, merged in self.pairs.items():
            entry, side = pair << 16 | merged, 0
            for _ in range(1000):
                place = (entry >> 16) % PRIMES[side]
                entry, tables[side][place] = tables[side][place], entry
                if entry < 0:
                    break
                side ^= 1
            else:
                raise ValueError("the pair table does not hold this vocabulary")
        return tables


def merged(ids: np.ndarray, sizes: np.ndarray, rank_of: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, one word after another, and how many each has, after all merges: a step joins the
    leftmost pair of lowest rank of every word; words without a pair are taken out when they are half."""
    first, ids = np.cumsum(sizes) - sizes, ids.copy()
    out, ends, left = np.full(len(ids), -1, np.int32), np.zeros(len(sizes), np.int64), np.arange(len(sizes))
    rank = np.append(rank_of(ids[:-1], ids[1:]), NONE)
    rank[first + sizes - 1] = NONE
    while len(left):
        starts = np.cumsum(sizes) - sizes
        best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
        some = best < NONE << 32
        if 2 * some.sum() <= len(left):
            own = np.repeat(some, sizes)
            place = np.repeat(first[left] - starts, sizes) + np.arange(len(ids))
            out[place[~own]] = ids[~own]
            ends[left[~some]] = sizes[~some]
            ids, rank, sizes, left = ids[own], rank[own], sizes[some], left[some]
            continue
        at = best[some] & 0xFFFFFFFF
        ids[at] = rank[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids, rank, sizes = ids[keep], rank[keep], sizes - some
        at -= np.arange(len(at))  # every word before has lost a piece
        starts = (np.cumsum(sizes) - sizes)[some]
        last = at + 1 == starts + sizes[some]
        rank[at] = np.where(last, NONE, rank_of(ids[at], ids[np.where(last, at, at + 1)]))
        at = at[at > starts]
        rank[at - 1] = rank_of(ids[at - 1], ids[at])
    return out[out >= 0], ends


def _heap_merged(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges with a heap, for long words."""
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))
            if (r := pairs.get(a << 16 | b)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else len(ids)
        if j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = r, -1, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < len(ids) and (s := pairs.get(ids[x] << 16 | ids[y])) is not None:
                heapq.heappush(heap, (s, x, ids[x], ids[y]))
    return [i for i in ids if i >= 0]


class _Codes(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class _Pieces:
    """Merges words: a list of ids for each."""

    def __init__(self, ranks: Ranks):
        self.ids_of, self.pairs, self.byte_ids = ranks.ids, ranks.pairs, ranks.bytes.astype(np.int64)
        self.first, self.second = (np.array(t) for t in ranks.tables)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << 16 | b
        first, second = self.first[pair % PRIMES[0]], self.second[pair % PRIMES[1]]
        return np.where(first >> 16 == pair, first & 0xFFFF, np.where(second >> 16 == pair, second & 0xFFFF, NONE))

    def __call__(self, words: list[bytes]) -> pa.ListArray:
        sizes = np.array([len(w) for w in words])
        token = np.fromiter(map(self.ids_of.get, words, repeat(-1)), np.int64, len(words))
        whole = token >= 0  # words of the vocabulary are done
        long = np.flatnonzero(~whole & (sizes > LONG))
        plain = np.flatnonzero(~whole & (sizes <= LONG))
        heaps = [_heap_merged(self.byte_ids[np.frombuffer(words[i], np.uint8)].tolist(), self.pairs) for i in long]
        data = np.frombuffer(b"".join([words[i] for i in plain]), np.uint8)
        ids, ends = merged(self.byte_ids[data], sizes[plain], self.rank)
        flat = np.concatenate([token[whole], *heaps, ids]).astype(np.int32)
        ends = np.concatenate(([0], np.ones(int(whole.sum()), np.int64), [len(h) for h in heaps], ends))
        order = np.argsort(np.concatenate((np.flatnonzero(whole), long, plain)))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), pa.array(flat)).take(pa.array(order))


def _lists(words: list[bytes], pieces: _Pieces) -> Iterator[pa.Array]:
    """The words as rows of CHUNK words each, twenty rows at a time."""
    for at in range(0, len(words), CHUNK * 20):
        part = words[at:at + CHUNK * 20]
        ends = np.append(np.arange(0, len(part), CHUNK), len(part)).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pieces(part))


def _common(texts: DataFrame, pattern: str, shared) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The most frequent words of a sample of texts, their ids one after another and how many each has."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        counts: Counter = Counter()

        def packed() -> pa.RecordBatch:
            return pa.record_batch([pa.array([w.encode() for w in counts], pa.binary()),
                                    pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                counts.update(find(text.as_py()))
                if len(counts) > WORDS:
                    yield packed()
                    counts.clear()
        yield packed()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            lists = _lists(words, shared.value) if words else ()
            for i, part in enumerate(lists):
                first = i * CHUNK * 20
                names = pa.ListArray.from_arrays(part.offsets, pa.array(words[first:first + CHUNK * 20], pa.binary()))
                yield pa.record_batch([names, part], ["names", "ids"])

    sample = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARE)) == 0).select("text")
    counts = stored(sample.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
                    .where("n > 1"), "bpe-words")
    tasks = texts.sparkSession.sparkContext.defaultParallelism
    found = (frequent(counts, COMMON).select("word").repartition(tasks, "word")
             .mapInArrow(listed, "names array<binary>, ids array<array<int>>").toArrow())
    names, ids = (found.column(c).combine_chunks().flatten() for c in ("names", "ids"))
    return ([bytes(w).decode() for w in names.to_pylist()], ids.flatten().to_numpy().astype(np.int32),
            ids.value_lengths().to_numpy().astype(np.int64))


def _blocks(texts: DataFrame, pattern: str, shared, common) -> DataFrame:
    """Blocks of texts: rows with lists of the ids of the words that are not common, then doc_id and codes; the common
    words have the first codes."""
    listed = pa.list_(pa.list_(pa.int32()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        pieces = shared.value
        usual = {w: i for i, w in enumerate(common.value)}

        def block(known: dict[str, int], held: list[tuple[pa.Array, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            words = [w.encode() for w in islice(known, len(usual), None)]
            known.clear()
            for at, part in enumerate(_lists(words, pieces)):
                rows = len(part)
                yield pa.record_batch(
                    [pa.nulls(rows, pa.int64()), pa.array([at == 0 and row == 0 for row in range(rows)]),
                     pa.nulls(rows, pa.list_(pa.int32())), part],
                    ["doc_id", "opens", "codes", "words"])
            del words
            for ids, codes in held:
                ends = np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int32)
                flat = np.concatenate([*codes, np.zeros(0, np.int32)])
                yield pa.record_batch([ids, pa.nulls(len(ids), pa.bool_()),
                                       pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                                       pa.nulls(len(ids), listed)], ["doc_id", "opens", "codes", "words"])

        known, held, total = _Codes(usual), [], 0
        for batch in batches:
            column, codes, start = batch.column("text"), [], 0
            for i in range(len(column)):
                found = find(column[i].as_py())
                codes.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                total += len(found)
                full = len(known) - len(usual) >= WORDS or total >= CODES
                if full or len(codes) == 1000:
                    held.append((batch.column("doc_id").slice(start, i + 1 - start), codes))
                    codes, start = [], i + 1
                    if full:
                        yield from block(known, held)
                        known, held, total = _Codes(usual), [], 0
            held.append((batch.column("doc_id").slice(start), codes))
        yield from block(known, held)

    return texts.mapInArrow(cut, "doc_id bigint, opens boolean, codes array<int>, words array<array<int>>")


def _joined(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """Per list of ids, the entries of `table` (large binaries) one after another."""
    found = table.take(ids.flatten())
    ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, found.offset * 8) if len(found) else np.zeros(1, np.int64)
    ends = ends[ids.offsets.to_numpy() - ids.offsets[0].as_py()]
    start = int(ends[0])
    data = found.buffers()[2].slice(start) if len(found) and found.buffers()[2] is not None else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((ends - start).astype(np.int32)), data])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Per document: doc_id and ids (array of token ids)."""
    return _encoded(docs, Ranks(ranks_path), pattern, id_col, text_col, "ids array<int>", lambda ids: [ids])


def _encoded(docs: DataFrame, ranks: Ranks, pattern: str, id_col: str, text_col: str, columns: str,
             made: Callable[[pa.ListArray], list[pa.Array]]) -> DataFrame:
    """Per document: doc_id and what `made` gives for its ids."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(_Pieces(ranks))
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    words, *usual_ids = _common(texts, pattern, shared)
    common, usual = context.broadcast(words), context.broadcast(usual_ids)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, sizes = ([part] for part in usual.value)
        pool = begins = lengths = None
        for batch in batches:
            opens = batch.column("opens")
            is_list = np.asarray(opens.is_valid())
            runs = np.concatenate(([0], np.flatnonzero(is_list[1:] != is_list[:-1]) + 1, [len(is_list)]))
            for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                if is_list[a]:
                    for i, first in enumerate(part.column("opens").to_pylist()):
                        if first:
                            flat, sizes = ([part] for part in usual.value)
                        words = part.column("words").slice(i, 1).flatten()
                        flat.append(words.flatten().to_numpy())
                        sizes.append(np.diff(words.offsets.to_numpy()))
                    pool = None
                    continue
                if pool is None:
                    pool = np.concatenate([*flat, np.zeros(0, np.int32)])
                    lengths = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64)
                    begins = np.cumsum(lengths) - lengths
                codes = part.column("codes")
                sizes_of = np.add.reduceat(np.append(lengths[codes.flatten().to_numpy()], 0),
                                           codes.offsets.to_numpy()[:-1] - codes.offsets[0].as_py())
                sizes_of[codes.value_lengths().to_numpy() == 0] = 0
                for c, e in slices(sizes_of, TOKENS):
                    rows = part.slice(c, e - c)
                    codes = rows.column("codes")
                    ends = codes.offsets.to_numpy()
                    code = codes.flatten().to_numpy()
                    n = lengths[code]
                    stop = np.cumsum(n)
                    index = np.repeat(begins[code] - (stop - n), n) + np.arange(int(n.sum()))
                    bounds = np.concatenate(([0], stop))[ends - ends[0]]
                    ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(pool[index]))
                    yield pa.record_batch([rows.column("doc_id"), *made(ids)], names)

    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]
    return (_blocks(texts, pattern, shared, common)
            .mapInArrow(assemble, f"doc_id bigint, {columns}"))


def _pieces_of(ranks: Ranks) -> pa.Array:
    return pa.array(ranks.pieces, pa.large_binary())


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add raw, the bytes that `ids` stand for."""
    pieces = encoded.sparkSession.sparkContext.broadcast(_pieces_of(Ranks(ranks_path)))
    names = [*encoded.columns, "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("ids").value_lengths().fill_null(0).to_numpy(), TOKENS):
                rows = batch.slice(a, b - a)
                yield pa.record_batch([*rows.columns, _joined(rows.column("ids"), pieces.value)], names)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("raw", T.BinaryType())]))


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode; per document n_tokens and digests of ids and bytes. Without a path, the
    multilingual byte-level vocabulary of the installed tokenizer files."""
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    ranks = Ranks(ranks_path)
    tables = docs.sparkSession.sparkContext.broadcast(
        (pa.array([b",%d" % i for i in range(len(ranks.pieces))], pa.large_binary()), _pieces_of(ranks)))

    def made(ids: pa.ListArray) -> list[pa.Array]:
        return [pa.array(ids.value_lengths(), pa.int64()), *(_joined(ids, table) for table in tables.value)]

    both = _encoded(docs, ranks, pattern, "doc_id", "text", "n_tokens bigint, listed binary, raw binary", made)
    return both.select("doc_id", "n_tokens", F.sha2(F.expr("substring(listed, 2)"), 256).alias("ids_sha256"),
                       F.sha2("raw", 256).alias("decoded_sha256"))
