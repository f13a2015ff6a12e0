"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as symbols: insult, threat, target, negation, reporting verb, clause end, other. Each
pattern is a small transducer over symbols that emits an event: an insult; an insult aimed at a
target; a threat at a target; a negation in scope of an insult; a reporting verb before one. Their
composition runs over the clauses of a text, and each matched clause is read as one kind (see KINDS)
by what the transducers emitted. A clause weighs as much as its insults: listed words have a fixed
weight, further words and word beginnings are learned as insults from document labels, with the
lower bound of their log odds as weight (see `learn_insults`). A text's features are the weights of
its matched clauses by kind, and per word; logistic regression in numpy turns them into the score.
All learning uses a bounded sample: at most PER_LABEL documents of a label, SAMPLE_BYTES of each.

Defined cases: null and empty texts match nothing and get the base score; rows without a label are
not learned from; without both labels fixed weights are used; equal texts get equal scores; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod
from .sampling import labelled_sample

PER_LABEL, SAMPLE_BYTES = 3000, 20_000

# Word lists of the grammar.
LEXICON = {
    "insult": "idiot idiots idiotic stupid moron morons moronic dumb dumbass fool fools foolish loser losers clown clowns "
              "trash garbage scum filth filthy vermin pathetic worthless useless disgusting disgrace imbecile cretin "
              "jerk jerks pig pigs rat rats coward cowards liar freak freaks psycho lunatic creep degenerate subhuman "
              "retard retarded bastard bastards asshole bitch shit shitty crap crappy hate despise ugly "
              "dumm idioten arschloch abschaum müll versager wertlos ekelhaft erbärmlich "
              "stupide imbécile crétin ordure minable débile dégoûtant "
              "idiota estúpido estúpida imbécil basura escoria patético inútil asqueroso",
    "threat": "kill hurt destroy beat punch stab shoot burn smash crush strangle hang murder "
              "töten umbringen tuer frapper matar golpear",
    "target": "you your yours yourself u they them their he him his she her women men people everyone "
              "du dich dein sie ihr tu toi ton vous votre ils tú te usted ustedes ellos",
    "negation": "not no never neither nor without isn't aren't don't doesn't didn't won't "
                "nicht kein keine nie ne pas jamais sin nunca jamás",
    "report": "said says say called calls call wrote writes told tells claimed claims quoted quote reported reports "
              "sagte nannte schrieb dit appelle écrit dijo llamó escribió",
}
OTHER, END = 0, 1
SYMBOLS = {name: k for k, name in enumerate(LEXICON, 2)}
INSULT, THREAT, TARGET, NEGATION, REPORT = (SYMBOLS[n] for n in LEXICON)
#: Words by symbol; of a word in two lists the first one counts.
WORDS: dict[bytes, int] = {}
for _name, _text in LEXICON.items():
    for _word in _text.split():
        WORDS.setdefault(_word.encode(), SYMBOLS[_name])

KINDS = ("insult", "aimed_insult", "threat", "negated_insult", "reported_insult")
#: Bytes that keep a word together; the rest of ASCII separates, and CLAUSE bytes end a clause.
CLAUSE = b".!?;:\n\r"
_SPLIT = bytes(10 if b in CLAUSE else b + 32 if 65 <= b <= 90 else b
               if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))
NEAR = 4


class Transducer:
    """States with arcs by symbol; an arc leads to a state and may emit an event. A symbol without
    an arc keeps the state."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, str | None]], start: int = 0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol: int):
        return self.arcs.get((state, symbol), (state, None))


class Composed:
    """Runs transducers side by side over the same symbols; the events of a step come together.
    Pairs of states are made when they are first met and kept as a table."""

    def __init__(self, *parts: Transducer):
        self.parts, self.start = parts, tuple(p.start for p in parts)
        self.table: dict[tuple, tuple[tuple, frozenset]] = {}

    def step(self, state: tuple, symbol: int) -> tuple[tuple, frozenset]:
        key = (state, symbol)
        if key not in self.table:
            moves = [p.step(s, symbol) for p, s in zip(self.parts, state, strict=True)]
            self.table[key] = (tuple(m[0] for m in moves), frozenset(m[1] for m in moves if m[1]))
        return self.table[key]


def _within(opener: int, closer: int, event: str, both_ways: bool = False) -> Transducer:
    """Emits `event` at `closer` when `opener` came at most NEAR words before (or after)."""
    arcs: dict[tuple[int, int], tuple[int, str | None]] = {}
    states = range(-NEAR if both_ways else 0, NEAR + 1)
    for s in states:
        for symbol in range(len(SYMBOLS) + 2):
            left = max(s - 1, 0) if s > 0 else min(s + 1, 0)
            to, said = left, None
            if symbol == END:
                to = 0
            elif symbol == closer:
                said = event if s > 0 else None
                to = -NEAR if both_ways and s <= 0 else left
            elif symbol == opener:
                said = event if s < 0 else None
                to = NEAR
            arcs[s, symbol] = (to, said)
    return Transducer(arcs)


def grammar() -> Composed:
    return Composed(
        Transducer({(0, INSULT): (0, "insult")}),
        _within(TARGET, INSULT, "aimed", both_ways=True),
        _within(THREAT, TARGET, "threat"),
        _within(NEGATION, INSULT, "negated"),
        _within(REPORT, INSULT, "reported"),
    )


def clause_kind(events: set[str]) -> int | None:
    """The kind of a clause by what the grammar emitted in it."""
    if "threat" in events:
        return KINDS.index("threat")
    if "insult" not in events:
        return None
    for event, kind in (("negated", "negated_insult"), ("reported", "reported_insult"), ("aimed", "aimed_insult")):
        if event in events:
            return KINDS.index(kind)
    return KINDS.index("insult")


@dataclass
class Insults:
    """Learned insults: weights of words and of word beginnings."""

    words: dict[bytes, float]
    starts: dict[bytes, float]

    def weight(self, word: bytes) -> float:
        """Weight of a word as an insult; 0 if it is none."""
        if WORDS.get(word) == INSULT:
            return LISTED
        found = self.words.get(word, 0.0)
        return max(found, *(self.starts.get(word[:n], 0.0) for n in STARTS if n < len(word)), 0.0)


#: Weight of a listed insult, and of a threat; lengths in bytes of learned word beginnings.
LISTED, STARTS = 5.0, range(4, 11)
#: Documents that a learned insult must stand in, and how sure (log likelihood ratio) it must be.
LEAST, SURE = 5, 15.0


def folded(raw: bytes) -> bytes:
    return raw.decode("utf-8", "replace").lower().encode().translate(_SPLIT)


def _units(word: bytes) -> list[tuple[bool, bytes]]:
    return [(True, word), *((False, word[:n]) for n in STARTS if n < len(word))]


def learn_insults(texts: list[bytes], labels: list[int]) -> Insults:
    """Words and word beginnings that stand in toxic documents and hardly in others.

    A unit's documents count at most once per pair of neighbouring words, so that copies of one text
    do not make its words insults. Weight: log odds less one standard error."""
    groups: dict[int, list[list[bytes]]] = {0: [], 1: []}
    for raw, label in {(r, y): None for r, y in zip(texts, labels, strict=True)}:
        groups[label].append(folded(raw).split())
    docs: dict[tuple[bool, bytes], int] = {}
    for words in groups[1]:
        for unit in {u for w in set(words) if len(w) >= 3 for u in _units(w)}:
            docs[unit] = docs.get(unit, 0) + 1
    docs = {u: n for u, n in docs.items() if n >= LEAST}
    beside: dict[tuple[bool, bytes], set[int]] = {u: set() for u in docs}
    for words in groups[1]:
        for before, word, after in zip([b"", *words], words, [*words[1:], b""], strict=False):
            for unit in _units(word):
                if unit in beside and len(beside[unit]) <= docs[unit]:
                    beside[unit].add(hash((before, word, after)))
    others = dict.fromkeys(docs, 0)
    for words in groups[0]:
        for unit in {u for w in set(words) for u in _units(w) if u in others}:
            others[unit] += 1
    n1, n0 = len(groups[1]) + 1, len(groups[0]) + 1
    out = Insults({}, {})
    for unit, n in docs.items():
        a, b = min(n, len(beside[unit])), others[unit]
        share, base = a / (a + b) if a + b else 0, n1 / (n1 + n0)
        if a < LEAST or share <= base:
            continue
        sure = a * np.log(share / base) + (b * np.log((1 - share) / (1 - base)) if b else 0)
        odds = np.log((a + 0.5) / n1) - np.log((b + 0.5) / n0) - np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if sure >= SURE and odds >= 1:
            (out.words if unit[0] else out.starts)[unit[1]] = float(min(odds, LISTED))
    return out


class Reader:
    """Composed grammar with the insults' weights; remembers the symbols of words it has met."""

    def __init__(self, insults: Insults):
        self.insults, self.machine = insults, grammar()
        self.known: dict[bytes, tuple[int, float]] = {}

    def symbol(self, word: bytes) -> tuple[int, float]:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            weight = self.insults.weight(word)
            plain = WORDS.get(word, OTHER)
            self.known[word] = (INSULT, weight) if weight else (plain, LISTED if plain == THREAT else 0.0)
        return self.known[word]

    def matched(self, text: bytes) -> list[tuple[int, int, float]]:
        """Matched clauses of a folded text: clause number, kind, weight."""
        if not any(self.symbol(w)[1] for w in set(text.split())):
            return []
        out = []
        for number, clause in enumerate(text.split(b"\n")):
            read = [self.symbol(w) for w in clause.split()]
            weight = sum(w for _, w in read)
            if not weight:
                continue
            state, events = self.machine.start, set()
            for symbol, _ in read:
                state, said = self.machine.step(state, symbol)
                events |= said
            kind = clause_kind(events)
            if kind is not None:
                out.append((number, kind, weight))
        return out

    def features(self, raw: bytes) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        text = folded(raw)
        found = self.matched(text)
        if not found:
            return np.zeros(len(KINDS) + 1), found
        weights = np.bincount([k for _, k, _ in found], [w for _, _, w in found], len(KINDS))
        return np.append(np.log1p(weights), np.log1p(100 * weights.sum() / len(text.split()))), found


@dataclass
class Model:
    insults: Insults
    kinds: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.kinds + self.bias, -30, 30)))


#: Used where nothing can be learned, and the centre that fitted weights are drawn to.
PRIOR_KINDS, PRIOR_BIAS = np.array([2.5, 3.0, 3.0, 1.0, 1.0, 0.5]), -3.0


def train(texts: list[bytes], labels: list[int]) -> Model:
    """Insults first, then logistic regression around the prior by Newton steps."""
    model = Model(learn_insults(texts, labels), PRIOR_KINDS, PRIOR_BIAS)
    reader, y = Reader(model.insults), np.array(labels)
    x = np.column_stack([np.array([reader.features(t)[0] for t in texts]), np.ones(len(texts))])
    centre = np.append(PRIOR_KINDS, PRIOR_BIAS)
    w, pull = centre.copy(), np.append(np.full(len(centre) - 1, 0.5), 0.05)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - centre)
        hess = (x * np.maximum(p * (1 - p), 1e-3)[:, None]).T @ x + np.diag(pull)
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return Model(model.insults, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", held_mod: int = 3, held_is: int = 1) -> Model:
    """Fit on labelled rows whose crc32(id) modulo `held_mod` is not `held_is`."""
    known = labels.select(F.col(id_col).cast("bigint").alias("k"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & (crc_mod("k", held_mod) != held_is)).dropDuplicates(["k"])
    sample = labelled_sample(known, "y", ["k"], PER_LABEL)
    if sample["y"].nunique() < 2:
        return Model(Insults({}, {}), PRIOR_KINDS, PRIOR_BIAS)
    wanted = F.broadcast(docs.sparkSession.createDataFrame(sample, "k bigint, y int"))
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("k"),
                       F.substring(as_bytes(text_col), 1, SAMPLE_BYTES).alias("raw"))
    got = rows.join(wanted, "k").select("k", "y", "raw").toPandas()
    got = got.sort_values(["k", "raw"], kind="stable").drop_duplicates("k")
    if got["y"].nunique() < 2:
        return Model(Insults({}, {}), PRIOR_KINDS, PRIOR_BIAS)
    return train([bytes(r) for r in got["raw"]], [int(y) for y in got["y"]])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score and hits (clause number, kind and weight of matched clauses)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = Reader(own.insults)
        for batch in batches:
            rows = [reader.features(raw) for raw in batch.column("raw").to_pylist()]
            scores = own.score(np.array([f for f, _ in rows]).reshape(len(rows), -1)) if rows else []
            hits = [[{"clause": c, "kind": KINDS[k], "weight": w} for c, k, w in found] for _, found in rows]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(hits, _HITS)],
                                  ["doc_id", "score", "hits"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), as_bytes(text_col).alias("raw")) \
        .mapInArrow(run, "doc_id bigint, score double, hits array<struct<clause: bigint, kind: string, weight: double>>")


_HITS = pa.list_(pa.struct([("clause", pa.int64()), ("kind", pa.string()), ("weight", pa.float64())]))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))
