"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items and texts are folded the same way: A-Z lower-cased, every other byte that is not a digit,
a letter or above 0x7F becomes a space. Every window of `n` item words, bordered by spaces, is a
pattern; each text is scanned once and matches are mapped to words and to byte offsets of the
original text (folding keeps the length).

Defined cases: null or empty texts have no words and no hits; null or empty items give no
windows; items shorter than `n` words are one window; repeated items each count by their id; an
item with a null id is named "null"; an empty benchmark marks nothing; other columns of `docs`
are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, as_bytes, stored, word_spans

#: Windows in one automaton (about 150 MB); a larger benchmark is scanned in several passes.
PATTERNS = 20_000

_BUILT: dict[str, object] = {}


def item_windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows with the ids of the items that hold them."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wins = [], []
            for key, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = raw.translate(WORD_BYTES).split()
                for i in range(max(1, len(words) - n + 1) if words else 0):
                    ids.append(key)
                    wins.append(b" ".join(words[i:i + n]))
            yield pa.record_batch([pa.array(wins, pa.binary()), pa.array(ids, pa.string())], ["win", "item"])

    plain = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"),
                         as_bytes(text_col).alias("raw"))
    return (plain.mapInArrow(cut, "win binary, item string")
            .groupBy("win").agg(F.collect_set("item").alias("items")))


def _automaton(token: str, patterns: list[tuple[bytes, list[str]]]):
    if token not in _BUILT:
        import ahocorasick

        built = ahocorasick.Automaton() if patterns else None
        for win, items in patterns:
            built.add_word(f" {win.decode('latin-1')} ", (win.count(b" ") + 1, items))
        if built is not None:
            built.make_automaton()
        _BUILT.clear()
        _BUILT[token] = built
    return _BUILT[token]


def _scan(raw: bytes, built) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, hit word ranges [from, to) and items found."""
    words = raw.translate(WORD_BYTES).split()
    ranges, items, ends = [], set(), None
    if built is None:
        return len(words), ranges, items
    joined = b" " + b" ".join(words) + b" "
    for end, (size, found) in built.iter(joined.decode("latin-1")):
        if ends is None:  # the word that ends before each space
            ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        last = int(np.searchsorted(ends, end))
        ranges.append((last - size, last))
        items.update(found)
    return len(words), ranges, items


def _merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(docs: DataFrame, items: DataFrame, n: int, item_id: str, item_text: str):
    """The windows in broadcasts of about PATTERNS each, with a name for the automaton."""
    windows = stored(item_windows(items, n, item_id, item_text), "windows")
    blocks = max(1, -(-windows.count() // PATTERNS))
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == block)
        patterns = [(bytes(r["win"]), list(r["items"])) for r in part.collect()]
        yield docs.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, words (hit word ranges, from and to), spans (the same as
    bytes of the original UTF-8 text) and items (ids of the items found, sorted as strings)."""
    blocks = list(_blocks(docs, items, n, item_id, item_text))
    schema = ("doc_id bigint, raw binary, n_words bigint, words array<array<bigint>>, "
              "spans array<array<bigint>>, items array<string>")
    frame = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), as_bytes(text_col).alias("raw"))
    for block, (shared, token) in enumerate(blocks):
        def scan(batches: Iterator[pa.RecordBatch], shared=shared, token=token, first=block == 0,
                 last=block == len(blocks) - 1) -> Iterator[pa.RecordBatch]:
            built = _automaton(token, shared.value)
            for batch in batches:
                texts = batch.column("raw").to_pylist()
                had = [[]] * len(texts) if first else batch.column("words").to_pylist()
                named = [[]] * len(texts) if first else batch.column("items").to_pylist()
                counts, words, spans, items = [], [], [], []
                for raw, before, names in zip(texts, had, named, strict=True):
                    count, ranges, found = _scan(raw, built)
                    merged = _merged([tuple(w) for w in before] + ranges)
                    starts, stops = word_spans(raw.translate(WORD_BYTES)) if merged else ((), ())
                    counts.append(count)
                    words.append(merged)
                    spans.append([[int(starts[a]), int(stops[b - 1])] for a, b in merged])
                    items.append(sorted(found.union(names)))
                pairs = pa.list_(pa.list_(pa.int64()))
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.nulls(len(texts), pa.binary()) if last else batch.column("raw"),
                     pa.array(counts, pa.int64()), pa.array(words, pairs), pa.array(spans, pairs),
                     pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", "raw", "n_words", "words", "spans", "items"])

        frame = frame.mapInArrow(scan, schema)
    return frame.drop("raw")


def flagged(docs: DataFrame, items: DataFrame, n: int = 10, **names: str) -> DataFrame:
    """`contamination` as figures: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, items, n, **names)
    hit = F.aggregate("words", F.lit(0).cast("bigint"), lambda acc, w: acc + w[1] - w[0])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` without any hit, all columns."""
    raw, names = "__own_raw__", docs.columns
    left = docs
    for shared, token in _blocks(docs, items, n, item_id, item_text):
        def clean(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            built = _automaton(token, shared.value)
            for batch in batches:
                hit = [bool(_scan(text, built)[1]) for text in batch.column(raw).to_pylist()]
                yield batch.filter(pa.array([not h for h in hit], pa.bool_())).select(names)

        left = left.withColumn(raw, as_bytes(text_col)).mapInArrow(clean, docs.schema)
    return left
