"""Language identification by averaged hashed subword embeddings and a linear softmax.

Letters are lower-cased (A-Z), all other ASCII becomes spaces; byte n-grams of SIZES are hashed
into BUCKETS, their embeddings are averaged and go through a linear layer. Both are trained by
stochastic gradient descent in numpy on a bounded sample: at most PER_LANG documents of each
language, SNIPPETS pieces of each at hashed places of the whole text. A temperature is fitted on a fifth of the
sample that the training does not see. The whole texts of that fifth also give the two bounds of the
rejection: on the top probability, and on how familiar the n-grams are (their mean log frequency in the
language found, see `LanguageModel.strange`), which works for any number of languages. Scoring is linear in the embeddings, so each bucket is
folded to one number per language and a text is one pass over its bytes.

Defined cases: a null text and a text without a letter are `und` with score 0; empty tables give no
rows; without labelled rows everything is `und`; equal texts get equal results; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod, slices
from .sampling import labelled_sample

#: Documents of a language in the sample, pieces of a document, bytes of a piece.
PER_LANG, SNIPPETS, SNIPPET = 1000, 3, 200
SIZES, BUCKETS, DIM = (2, 3, 4), 1 << 15, 16
EPOCHS, BATCH, RATE = 4, 128, 0.5
#: Each rejection bound leaves out this share of the held-back texts of known languages.
QUANTILE = 0.005
UNKNOWN = "und"

_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20
                  for b in range(256)], np.uint8)


def grams(raw: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram at every place of folded bytes."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    key = np.full(n, size, np.uint32)
    for k in range(size):
        key = key * np.uint32(0x01000193) ^ raw[k:k + n]
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    return (key >> np.uint32(17)).astype(np.int32)


@dataclass
class LanguageModel:
    """`table`: one number per bucket and language; `bias`; temperature; `usual`: log frequency of each
    bucket in each language, `mean` and `spread` of its averages over pieces; rejection bounds."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float
    usual: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    bound: float = 0.0
    most_strange: float = np.inf

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """One row per text; uniform for a text without n-grams."""
        return self.judged(texts)[0]

    def judged(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of every text, and how strange it is for its likeliest language."""
        width = len(self.langs)
        both = np.concatenate([self.table, self.usual], 1)
        sums, counts = np.zeros((len(texts), 2 * width)), np.zeros(len(texts))
        for i, raw in enumerate(_FOLD[np.frombuffer(t, np.uint8)] for t in texts):
            for at in range(0, len(raw), 1 << 18):
                for size in SIZES:  # pieces overlap by size - 1 bytes, so every n-gram counts once
                    found = grams(raw[at:at + (1 << 18) + size - 1], size)
                    sums[i] += np.bincount(found, minlength=BUCKETS) @ both if len(found) > 20_000 \
                        else both[found].sum(0)
                    counts[i] += len(found)
        sums /= np.maximum(counts, 1)[:, None]
        out = (sums[:, :width] + self.bias) / self.heat
        out = np.exp(out - out.max(1, keepdims=True))
        out /= out.sum(1, keepdims=True)
        return out, self.strange(sums[:, width:], counts, out.argmax(1))

    def strange(self, familiar: np.ndarray, counts: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """How far the mean log frequency of the n-grams lies below that of the language, in standard
        deviations of a text of that many n-grams (at least a piece's share of them stays)."""
        wide = np.sqrt(0.5 + 0.5 * len(SIZES) * SNIPPET / np.maximum(counts, 1))
        at = np.arange(len(lang))
        return (self.mean[lang] - familiar[at, lang]) / (self.spread[lang] * wide)

    def rejects(self, top: np.ndarray, strange: np.ndarray) -> np.ndarray:
        return (top < self.bound) | (strange > self.most_strange)

    def calibrate(self, top: np.ndarray, strange: np.ndarray) -> None:
        """Bounds from the top probability and strangeness of held-back whole texts."""
        if len(top):
            self.bound = float(np.quantile(top, QUANTILE, method="lower"))
            self.most_strange = float(np.quantile(strange, 1 - QUANTILE, method="higher"))


def train(texts: list[list[bytes]], labels: list[str], seed: int = 7) -> LanguageModel:
    """`texts`: the pieces of each text."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    rows, owner, target = [], [], []
    for i, (pieces, lang) in enumerate(zip(texts, labels, strict=True)):
        for piece in (_FOLD[np.frombuffer(raw, np.uint8)] for raw in pieces if len(raw) >= min(SIZES)):
            rows.append(np.concatenate([grams(piece, s) for s in SIZES]).astype(np.uint16))
            owner.append(i)
            target.append(langs.index(lang))
    target, held = np.array(target), np.array(owner) % 5 == 0
    embed = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.3, (DIM, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    order = np.flatnonzero(~held)
    steps = max(1, EPOCHS * -(-len(order) // BATCH))
    for step in range(steps if len(order) else 0):
        if step % -(-len(order) // BATCH) == 0:
            rng.shuffle(order)
            at = 0
        pick = order[at:at + BATCH]
        at += BATCH
        sizes = np.array([len(rows[i]) for i in pick])
        found = np.concatenate([rows[i] for i in pick])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        mean = np.add.reduceat(embed[found], starts) / sizes[:, None]
        logits = mean @ weight + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), target[pick]] -= 1
        rate = RATE * (1 - step / steps)
        back = (p @ weight.T / sizes[:, None]).astype(np.float32)
        weight -= rate * (mean.T @ p) / len(pick) * 8
        bias -= rate * p.mean(0)
        pull = np.repeat(back, sizes, 0)
        for d in range(DIM):  # each piece moves its embeddings by its own gradient
            embed[:, d] -= rate * 8 * np.bincount(found, pull[:, d], BUCKETS)
    usual = np.zeros((BUCKETS, len(langs)))
    for k in range(len(langs)):
        own = [rows[i] for i in np.flatnonzero((target == k) & ~held)]
        n = np.bincount(np.concatenate(own), minlength=BUCKETS) if own else np.zeros(BUCKETS)
        usual[:, k] = np.log((n + 0.5) / (n.sum() + 0.5 * BUCKETS))
    fits = np.array([usual[r, k].mean() for r, k in zip(rows, target, strict=True)])
    mean, spread = np.zeros(len(langs)), np.ones(len(langs))
    for k in range(len(langs)):
        own = fits[(target == k) & held] if ((target == k) & held).sum() > 1 else fits[target == k]
        if len(own):
            mean[k], spread[k] = own.mean(), max(own.std(), 0.05)
    model = LanguageModel(langs, (embed @ weight).astype(np.float64), bias.astype(np.float64), 1.0, usual, mean, spread)
    check = [rows[i] for i in np.flatnonzero(held)]
    if check:
        logits = np.array([model.table[r].mean(0) for r in check]) + model.bias
        truth = target[held]

        def loss(heat: float) -> float:
            z = logits / heat
            z = z - z.max(1, keepdims=True)
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).mean())

        model.heat = min(np.geomspace(0.2, 5, 40), key=loss)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        held_mod: int = 3, held_is: int = 1) -> LanguageModel | None:
    """Train on rows with a language whose crc32(id) modulo `held_mod` is not `held_is`."""
    rows = docs.where(crc_mod(id_col, held_mod) != held_is).select(
        F.col(f"`{id_col}`").cast("string").alias("k"), as_bytes(text_col).alias("raw"),
        F.col(f"`{lang_col}`").cast("string").alias("lang")).where(F.length("raw") > 0)
    sample = labelled_sample(with_pieces(rows), "lang", ["k"], PER_LANG)
    if sample.empty:
        return None
    model = train([[bytes(r) for r in own] for own in sample["pieces"]], list(sample["lang"]))
    held = sample["k"][np.arange(len(sample)) % 5 == 0]  # as in train
    whole = rows.where(F.col("lang").isNotNull() & F.col("k").isin(held.dropna().tolist()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, strange = shared.value.judged(batch.column("raw").to_pylist())
            yield pa.record_batch([pa.array(p.max(1)), pa.array(strange)], ["top", "strange"])

    letters = whole.where(F.col("raw").cast("string").rlike(r"\p{L}"))
    found = letters.select("raw").mapInArrow(judge, "top double, strange double").toPandas()
    model.calibrate(found["top"].to_numpy(), found["strange"].to_numpy())
    return model


def with_pieces(rows: DataFrame) -> DataFrame:
    """`pieces` instead of the column `raw`: SNIPPETS pieces of SNIPPET bytes, at places of the whole text that
    follow from a hash of the id `k`; the text itself where it is shorter."""
    room = F.greatest(F.length("raw") - SNIPPET + 1, F.lit(1))
    return rows.withColumn("pieces", F.array_distinct(F.array(*[
        F.col("raw").substr((F.pmod(F.xxhash64("k", F.lit(i)), room) + 1).cast("int"), F.lit(SNIPPET))
        for i in range(SNIPPETS)]))).drop("raw")


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score (calibrated probability of it), rejected (`und`, or
    beyond one of the model's bounds)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column("raw").to_pylist()
            letters = batch.column("letters").to_pylist()
            langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            if own is not None:
                for a, b in slices(np.array([len(t) for t in texts]), 1 << 22):
                    p, strange = own.judged(texts[a:b])
                    no = own.rejects(p.max(1), strange).tolist()
                    for i, k in enumerate(p.argmax(1).tolist(), a):
                        if letters[i]:
                            langs[i], scores[i], rejected[i] = own.langs[k], float(p[i - a, k]), no[i - a]
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), as_bytes(text_col).alias("raw"),
        F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    ).mapInArrow(score, "doc_id bigint, lang_pred string, score double, rejected boolean")


def predictions(docs: DataFrame) -> DataFrame:
    """Train on the learnable documents, predict all."""
    found = identify(docs, fit(docs))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose language is recognised, all columns."""
    model = fit(docs)
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    raw, letters, names = "__own_raw__", "__own_letters__", docs.columns
    read = text_col if docs.schema[text_col].dataType.typeName() == "string" else raw

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.names.index(read)).cast(pa.binary())  # the same bytes
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, 1 << 22):
                part = batch.slice(a, b - a)
                p, strange = own.judged([t or b"" for t in texts.slice(a, b - a).to_pylist()])
                known = np.array(part.column(letters).to_pylist(), bool) & ~own.rejects(p.max(1), strange)
                yield part.filter(pa.array(known)).select(names)

    wide = docs.withColumn(
        letters, F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False)))
    if read == raw:
        wide = wide.withColumn(raw, as_bytes(text_col))
    return wide.mapInArrow(keep, docs.schema)
