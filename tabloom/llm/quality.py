"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded by shape figures (shares
of letter cases, digits, marks, repeated and repeating words, word lengths) and a hidden layer; gated
attention (tanh and sigmoid branches) weighs the passages, and a logistic unit scores the weighted
sum. Only document labels are learned from, by Adam in numpy, on a bounded sample: at most PER_LABEL
documents of each label, of which at most BAG passages, evenly spread, enter the training. Scoring
reads every passage of every text.

Defined cases: null and empty texts are one passage without words; rows without a label are not
learned from; without both labels the score is the share of label 1 (0.5 if there is none); equal
texts get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod, slices
from .sampling import labelled_sample

PASSAGE, PER_LABEL, BAG = 60, 2000, 32
HIDDEN, GATE, EPOCHS, BATCH, RATE = 16, 12, 30, 64, 0.01

# Byte classes: lower, upper, digit, white space, above ASCII, full stop and comma, other marks.
_CLASS = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57
                   else 3 if b == 32 or 9 <= b <= 13 else 4 if b >= 128 else 5 if b in b".,;:?'\"-" else 6
                   for b in range(256)], np.uint8)
FEATURES = 12


def passages(raw: bytes) -> np.ndarray:
    """One row of FEATURES figures per passage."""
    words = raw.split()
    if not words:
        return np.zeros((1, FEATURES))
    groups = [words[i:i + PASSAGE] for i in range(0, len(words), PASSAGE)]
    joined = [b" ".join(g) for g in groups]
    data = np.frombuffer(b"".join(joined), np.uint8)
    ends = np.cumsum([len(j) for j in joined])
    owner = np.repeat(np.arange(len(groups)), np.diff(np.concatenate(([0], ends))))
    shares = np.bincount(owner * 7 + _CLASS[data], minlength=7 * len(groups)).reshape(-1, 7)
    n_bytes = shares.sum(1)
    out = np.zeros((len(groups), FEATURES))
    out[:, :7] = shares / n_bytes[:, None]
    count = np.array([len(g) for g in groups])
    out[:, 7] = 1 - np.array([len(set(g)) for g in groups]) / count
    out[:, 8] = [sum(map(bytes.__eq__, g, g[1:])) / len(g) for g in groups]
    out[:, 9] = n_bytes / count / 20
    out[:, 10] = count / PASSAGE
    lows = [sum(map(bytes.isupper, g)) for g in groups]
    out[:, 11] = np.array(lows) / count
    return out


@dataclass
class BagModel:
    """Parameters; `mean` and `scale` standardise the figures."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Passages of several bags, one after another; `starts` has the first of each bag."""
        w, sizes = self.w, np.diff(np.append(starts, len(x)))
        h = np.tanh((x - self.mean) / self.scale @ w["enc"] + w["enc0"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * g) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        att = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(att[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out0"][0], -30, 30)))
        return {"h": h, "t": t, "g": g, "att": att, "z": z, "p": p}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *[len(b) for b in bags]])[:-1]
        return self.forward(np.concatenate(bags), starts)["p"]


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> BagModel:
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    init = {"enc": (FEATURES, HIDDEN), "enc0": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE),
            "a": (GATE,), "out": (HIDDEN,), "out0": (1,)}
    model = BagModel(every.mean(0), every.std(0) + 1e-3,
                     {k: rng.normal(0, 0.3, s) * (k not in ("enc0", "out0")) for k, s in init.items()})
    w, first, second, step = model.w, {k: 0.0 for k in init}, {k: 0.0 for k in init}, 0
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            starts = np.cumsum([0, *[len(bags[i]) for i in pick]])[:-1]
            x = np.concatenate([bags[i] for i in pick])
            sizes = np.diff(np.append(starts, len(x)))
            f = model.forward(x, starts)
            dp = (f["p"] - labels[pick]) * weight[pick] / len(pick)
            dz = np.repeat(dp[:, None] * w["out"], sizes, 0)
            pull = (dz * f["h"]).sum(1)
            de = f["att"] * (pull - np.repeat(np.add.reduceat(f["att"] * pull, starts), sizes))
            dt = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
            dg = de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["att"][:, None] * dz + dt @ w["v"].T + dg @ w["u"].T) * (1 - f["h"] ** 2)
            grads = {"out": f["z"].T @ dp, "out0": np.array([dp.sum()]), "a": (f["t"] * f["g"]).T @ de,
                     "v": f["h"].T @ dt, "u": f["h"].T @ dg,
                     "enc": ((x - model.mean) / model.scale).T @ dh, "enc0": dh.sum(0)}
            step += 1
            for k, grad in grads.items():
                grad = grad + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad ** 2
                w[k] -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", held_mod: int = 5, held_is: int = 0) -> BagModel | float:
    """Train on labelled rows whose crc32(id) modulo `held_mod` is not `held_is`; a number where
    there is only one label."""
    known = labels.select(F.col(id_col).cast("bigint").alias("k"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & (crc_mod("k", held_mod) != held_is)).dropDuplicates(["k"])
    sample = labelled_sample(known, "y", ["k"], PER_LABEL)
    if sample["y"].nunique() < 2:
        return float(sample["y"].mean()) if len(sample) else 0.5
    wanted = F.broadcast(docs.sparkSession.createDataFrame(sample, "k bigint, y int"))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("k"), as_bytes(text_col).alias("raw"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [passages(raw) for raw in batch.column("raw").to_pylist()]
            bags = [b if len(b) <= BAG else b[np.linspace(0, len(b) - 1, BAG).astype(int)] for b in bags]
            yield pa.record_batch([batch.column("k"), batch.column("y"),
                                   pa.array([b.ravel() for b in bags], pa.list_(pa.float64()))], ["k", "y", "bag"])

    got = rows.join(wanted, "k").mapInArrow(encode, "k bigint, y int, bag array<double>").toPandas()
    got = got.assign(size=got["bag"].map(len)).sort_values(["k", "size"], kind="stable").drop_duplicates("k")
    if got["y"].nunique() < 2:
        return float(got["y"].mean()) if len(got) else 0.5
    return train([np.asarray(b).reshape(-1, FEATURES) for b in got["bag"]], got["y"].to_numpy())


def score(docs: DataFrame, model: BagModel | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score and passages (how many)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, scores, counts = batch.column("raw").to_pylist(), [], []
            for a, b in slices(np.array([len(t) for t in texts]), 1 << 22):
                bags = [passages(t) for t in texts[a:b]]
                counts += [len(g) for g in bags]
                scores += [own] * len(bags) if isinstance(own, float) else own.score(bags).tolist()
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64()),
                                   pa.array(counts, pa.int64())], ["doc_id", "score", "passages"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), as_bytes(text_col).alias("raw")) \
        .mapInArrow(run, "doc_id bigint, score double, passages bigint")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))
