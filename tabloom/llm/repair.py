"""Repair of conversation structure by the cheapest edits of their rows.

A healthy conversation reads `(s?(ua)+)?` by the initials of its roles. Edits of a row are Keep,
Rerole (to user or assistant) and Delete; an empty row can be Inserted anywhere. The cheapest edit
string, least in ASCII order among equals, is found by iterative-deepening A*: depth-first in the order
D, I, K, R under cost bounds that rise to the least cost that exceeded the last one, with a table of
failed states (row, state of the pattern) that remembers what each is known to cost at least. The
first path that the pattern accepts is the answer.

Rows are range-partitioned by conversation and order, so that one conversation may lie in many
tasks. A conversation inside one task, of at most PIECE rows, is one search. Of others every piece is
searched from each state of the pattern to each other, and a stream over the pieces joins the cheapest
ways; since the letters of a piece that consume its rows are equally many, joined least strings are
least. Texts are read twice: once as digests and codes of one letter, once in order, one
conversation's stream next to its edit string, so no task holds the rows of a conversation.
(SHA-256 of a whole conversation is a chain, hence that last stream runs in one task for each
conversation; it keeps one batch of rows and the edit string, which is a cell of the result.)

Defined cases: null roles and texts are one space; a null conversation id is a conversation; rows
without a turn come first; rows with the same turn are ordered by role, then by the text's SHA-256, and equal
rows count one by one; roles other than those with initials s, u, a can only be reroled or deleted;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows of one search.
PIECE = 128
#: States of the pattern: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (EMPTY, ASSISTANT)
AFTER = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The one user or assistant that may come next.
OWED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, TRUNCATED, INSERT = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
#: Codes of rows: x must go; s, u, a, o (another role) may stay; in capitals they are truncated.
CODES = "xsuaoSUAO"


def _moves(code: str | None) -> list[list[tuple[str, int, int, int]]]:
    """Per state: (letter, rows consumed, next state, cost) in ASCII order; without a code, after the last row."""
    out = []
    for state in range(4):
        moves = [("I", 0, OWED[state], INSERT)]
        if code:
            moves.append(("D", 1, state, DELETE))
        if code and code != "x":
            late = TRUNCATED if code.isupper() else 0
            then = AFTER.get(code.lower(), {}).get(state)
            if then is not None:
                moves.append(("K", 1, then, late))
            moves.append(("R", 1, OWED[state], REROLE + late))
        out.append(sorted(moves))
    return out


MOVES = {code: _moves(code) for code in CODES}
AT_END = _moves(None)
#: What a row costs at least, whatever its neighbours.
LEAST = {"x": DELETE, "s": 0, "u": 0, "a": 0, "o": REROLE, "S": DELETE, "U": DELETE, "A": DELETE, "O": DELETE}


def floor_costs(codes: str, goals: tuple[int, ...]) -> list[int]:
    """Per row and state what the rest costs at least; the table that a search refines."""
    table = [0 if q in goals else INSERT for q in range(4)]
    rest, n = 0, len(codes)
    for code in reversed(codes):
        rest += LEAST[code]
        table.extend([rest] * 4)
    if not set(goals) & {USER, ASSISTANT}:
        # no way back from a user: all rows go, but for one system row
        for i in range(1, n + 1):
            table[4 * i:4 * i + 4] = [DELETE * (i - (EMPTY not in goals)), *[DELETE * i] * 3]
    return [table[4 * (n - i) + q] for i in range(n + 1) for q in range(4)]


def search(codes: str, start: int, goals: tuple[int, ...], least: list[int]) -> tuple[int, str]:
    """Cheapest edits from `start` to one of `goals` and their cost. `least` is `floor_costs` of the
    same goals, and keeps what failed paths have shown."""
    end = 4 * len(codes)
    rows = [MOVES[c] for c in codes] + [AT_END]
    while True:
        bound = least[start]
        trail = [(start, bound, iter(rows[0][start]))]
        over = [1 << 60]
        letters: list[str] = []
        while trail:
            node, rest, moves = trail[-1]
            if node >= end and node - end in goals:
                return bound, "".join(letters)
            for letter, step, state, cost in moves:
                child = ((node >> 2) + step << 2) + state
                need = cost + least[child]
                if need <= rest:
                    trail.append((child, rest - cost, iter(rows[child >> 2][state])))
                    over.append(1 << 60)
                    letters.append(letter)
                    break
                if need < over[-1]:
                    over[-1] = need
            else:
                trail.pop()
                least[node] = over.pop()
                if trail:
                    letters.pop()
                    over[-1] = min(over[-1], least[node] + trail[-1][1] - rest)


def cheapest(codes: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    return search(codes, EMPTY, ACCEPTED, floor_costs(codes, ACCEPTED))


def ways(codes: str) -> list[tuple[int, int, int, str]]:
    """Cheapest edits of a piece between all states: (from, to, cost, edits)."""
    out = []
    for goal in range(4):
        table = floor_costs(codes, (goal,))
        for start in range(4):
            if goal in (EMPTY, SYSTEM) and start != goal and not (
                    start == EMPTY and goal == SYSTEM and ("s" in codes or "S" in codes)):
                continue
            out.append((start, goal, *search(codes, start, (goal,), table)))
    return out


def joined(pieces: Iterator[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and edits of a conversation from the ways through its pieces. What all candidates share
    is set aside, so that only their differing ends are compared."""
    shared: list[str] = []
    best = {EMPTY: (0, "")}
    for options in pieces:
        after: dict[int, tuple[int, str]] = {}
        for start, goal, cost, edits in options:
            if start in best:
                way = (best[start][0] + cost, best[start][1] + edits)
                if goal not in after or way < after[goal]:
                    after[goal] = way
        head = os.path.commonprefix([edits for _, edits in after.values()])
        shared.append(head)
        best = {q: (cost, edits[len(head):]) for q, (cost, edits) in after.items()}
    cost, edits = min(best[q] for q in ACCEPTED if q in best)
    return cost, "".join(shared) + edits


# ---- rows

def _string(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(" "))


def rows_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """The four columns of a conversation table under fixed names, without null roles and texts."""
    return df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                     _string(role_col).alias("role"), _string(text_col).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that a checksum of conversation and turn deals out: of 20 values 0 drops
    a row, 1 empties its text, 2 removes its full stops, 3 repeats it, 4 makes it the user's."""
    dealt = F.crc32(F.concat_ws(":", _string("conv"), _string("turn")).cast("binary")) % 20
    copies = F.when(dealt == 0, 0).when(dealt == 3, 2).otherwise(1)
    return rows.select(
        "conv", "turn", F.when(dealt == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(dealt == 1, F.lit("")).when(dealt == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def _sha(column: str) -> Column:
    return F.unhex(F.sha2(F.col(column).cast("binary"), 256))


ORDER = ["turn", "role", "sha"]


def _sorted_keys(*more: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv", *more, *ORDER)]


def _beside(df: DataFrame, other: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """Join where the keys are equal or both null; the keys of `df` stay."""
    out, on = other.withColumnsRenamed({k: f"__{k}__" for k in keys}), F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}__"))
    return df.join(out, on, how).drop(*[f"__{k}__" for k in keys])


def faults(rows: DataFrame) -> DataFrame:
    """One row per distinct row: its number of copies `n`, whether it is the first with its role and
    text in the conversation, and its own fault (blank, truncated or null)."""
    core = F.btrim("text", F.lit(SPACE))
    fault = F.when(core == "", "blank").when(~F.substring(core, -1, 1).isin(".", "!", "?"), "truncated")
    told = rows.select("conv", "turn", "role", _sha("text").alias("sha"), fault.alias("fault"))
    told = stored(told.groupBy("conv", "turn", "role", "sha", "fault").agg(F.count(F.lit(1)).alias("n")), "turns")
    firsts = told.groupBy("conv", "role", "sha").agg(
        F.min("turn").alias("low"), F.max(F.col("turn").isNull()).alias("unplaced"))
    firsts = firsts.select("conv", "role", "sha", F.when(~F.col("unplaced"), F.col("low")).alias("turn"), F.lit(True).alias("first"))
    # the turn is part of the key, so a row that a conversation repeats very often stays spread
    return _beside(told, firsts, "conv", "turn", "role", "sha").withColumn("first", F.coalesce("first", F.lit(False)))


def counts(found: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated."""
    blank = F.col("fault").eqNullSafe(F.lit("blank"))
    new = F.when(F.col("first"), 1).otherwise(0)
    turns = found.groupBy("conv", "turn").agg(
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).otherwise(F.col("n") - new)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", new).otherwise(0)).alias("truncated"))
    return turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated")])


def _fields(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


class Piece:
    """Consecutive rows of one conversation in one task. `edge`: the conversation may go on beyond it."""

    def __init__(self, conv: object, place: tuple, edge: bool):
        self.conv, self.place, self.edge = conv, place, edge
        self.codes, self.first, self.last, self.illegal, self.size = [], "", "", 0, 0

    def add(self, code: str, initial: str, n: int) -> None:
        if self.last:
            self.illegal += self.last + initial not in LEGAL
        self.first = self.first or initial
        self.last = initial
        self.illegal += n - 1
        self.size += n
        self.codes.append(code + "x" * (n - 1))

    def ways(self, whole: bool) -> list[tuple[int, int, int, str]]:
        codes = "".join(self.codes)
        return [(EMPTY, ASSISTANT, *cheapest(codes))] if whole else ways(codes)


def pieces(rows: Iterator[tuple], size: int) -> Iterator[tuple[Piece, bool]]:
    """Cut sorted rows (conversation, place, initial, code, copies) into pieces of at most `size` rows; a
    piece is whole where the neighbouring rows belong to other conversations."""
    here = None
    for conv, place, initial, code, n in rows:
        if here is None or here.conv != conv:
            if here is not None:
                yield here, not here.edge
            here = Piece(conv, place, here is None)
        while n:
            if here.size == size:
                yield here, False
                here = Piece(conv, place, True)
            take = min(n, size - here.size)
            here.add(code, initial, take)
            n, code = n - take, "x"
    if here is not None:
        yield here, False


def audits(found: DataFrame, piece: int = PIECE) -> DataFrame:
    """Per conversation with rows: illegal (adjacent roles that do not follow each other), cost and
    audit (the edits). `found` comes from `faults`."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = (F.when(~F.col("first") | F.col("fault").eqNullSafe(F.lit("blank")), "x")
            .when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind))
    coded = found.select("conv", *ORDER, kind.alias("kind"), code.alias("code"), "n")
    ranged = coded.repartitionByRange(*_sorted_keys()).sortWithinPartitions(*_sorted_keys())
    step = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    own = [("number", pa.int32()), ("whole", pa.bool_()), ("illegal", pa.int64()), ("first", pa.string()),
           ("last", pa.string()), ("ways", pa.list_(step))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Field] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                kept[:] = [batch.schema.field(c) for c in ("conv", *ORDER)]
                conv, turn, role, sha, kinds, codes, n = (batch.column(c).to_pylist() for c in ("conv", *ORDER, "kind", "code", "n"))
                yield from zip(conv, zip(turn, role, sha, strict=True), kinds, codes, n, strict=True)

        def told(number: int, piece: Piece, whole: bool) -> dict:
            return {"conv": piece.conv, **dict(zip(ORDER, piece.place, strict=True)), "number": number, "whole": whole,
                    "illegal": piece.illegal, "first": piece.first, "last": piece.last,
                    "ways": [dict(zip(("a", "b", "cost", "edits"), way, strict=True)) for way in piece.ways(whole)]}

        numbered = (told(i, *found) for i, found in enumerate(pieces(rows(), piece)))
        while out := list(itertools.islice(numbered, 1000)):
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*kept, *own]))

    kinds = ", ".join(f"{c} {coded.schema[c].dataType.simpleString()}" for c in ("conv", *ORDER))
    cut_up = stored(ranged.mapInArrow(cut, (
        f"{kinds}, number int, whole boolean, illegal bigint, first string, last string, "
        "ways array<struct<a: int, b: int, cost: bigint, edits: string>>")), "pieces")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Field] = []

        def rows() -> Iterator[dict]:
            for batch in batches:
                kept[:] = [batch.schema.field("conv")]
                yield from batch.to_pylist()

        def told(conv: object, group: Iterator[dict]) -> dict:
            illegal, last = 0, ""

            def options() -> Iterator[list[tuple]]:
                nonlocal illegal, last
                for row in group:
                    illegal += row["illegal"] + bool(last and last + row["first"] not in LEGAL)
                    last = row["last"]
                    yield [tuple(way.values()) for way in row["ways"]]

            cost, edits = joined(options())
            return {"conv": conv, "illegal": illegal, "cost": cost, "audit": edits}

        for conv, group in itertools.groupby(rows(), lambda r: r["conv"]):
            yield pa.RecordBatch.from_pylist([told(conv, group)], schema=pa.schema(
                [*kept, ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))

    rest = cut_up.where(~F.col("whole")).select("conv", *ORDER, "number", "illegal", "first", "last", "ways")
    sort = [*_sorted_keys(), F.col("number")]
    linked = rest.repartition("conv").sortWithinPartitions(*sort).mapInArrow(
        link, f"conv {cut_up.schema['conv'].dataType.simpleString()}, illegal bigint, cost bigint, audit string")
    single = F.col("ways")[0]
    return cut_up.where("whole").select(
        "conv", "illegal", single["cost"].alias("cost"), single["edits"].alias("audit")).unionByName(linked)


# ---- what the edits make of a conversation

def replay(audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(edit, row or None, role, text) of every row that stays or is inserted. `rows` are (turn, role,
    text) in order, as many as the edits consume."""
    state = EMPTY
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        role = row[1] if edit == "K" else ROLE[OWED[state]]
        state = AFTER[role[0]][state]
        yield edit, row, role, "" if row is None else row[2]


def _replayed(rows: DataFrame, told: DataFrame, each, columns: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """Stream every conversation in order next to its audit row; `each(audit row, rows)` yields dicts."""
    sorted_rows = rows.withColumn("sha", _sha("text")).withColumns({
        "placed": F.lit(1), "audit": F.lit(None).cast("string"),
        "illegal": F.lit(None).cast("bigint"), "cost": F.lit(None).cast("bigint")})
    heads = told.withColumn("placed", F.lit(0)).select(
        "conv", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text")],
        F.lit(None).cast("binary").alias("sha"), "placed", "audit", "illegal", "cost")
    both = sorted_rows.unionByName(heads).repartition("conv").sortWithinPartitions(*_sorted_keys("placed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Field] = []

        def stream() -> Iterator[tuple]:
            for batch in batches:
                kept[:] = [batch.schema.field(c) for c in ("conv", "turn")]
                yield from zip(*(batch.column(c).to_pylist() for c in (
                    "conv", "turn", "role", "text", "audit", "illegal", "cost")), strict=True)

        def out() -> Iterator[dict]:
            for conv, group in itertools.groupby(stream(), lambda r: r[0]):
                head = next(group)
                for row in each(head[4:], (r[1:4] for r in group)):
                    yield {"conv": conv, **row}

        told = out()
        while some := list(itertools.islice(told, 1000)):
            known = {f.name: f.type for f in kept}
            yield pa.RecordBatch.from_pylist(some, schema=pa.schema([("conv", known["conv"]), *[
                (name, kind or known["turn"]) for name, kind in columns]]))

    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    return both.drop("sha", "placed").mapInArrow(run, schema.format(conv=conv, turn=turn))


def repaired(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv, place from 0, edit (K, R or I), turn (null where
    inserted), role, text. `told` comes from `audits`."""
    def each(head: tuple, group: Iterator[tuple]) -> Iterator[dict]:
        for place, (edit, row, role, text) in enumerate(replay(head[0], group)):
            yield {"place": place, "edit": edit, "turn": row[0] if row else None, "role": role, "text": text}

    columns = [("place", pa.int64()), ("edit", pa.string()), ("turn", None), ("role", pa.string()), ("text", pa.string())]
    return _replayed(rows, told, each, columns, "conv {conv}, place bigint, edit string, turn {turn}, role string, text string")


def digests(rows: DataFrame, told: DataFrame) -> DataFrame:
    """`told` with the SHA-256 of each repaired conversation, its rows as role:text lines."""
    def each(head: tuple, group: Iterator[tuple]) -> Iterator[dict]:
        hashed, between = hashlib.sha256(), ""
        for _, _, role, text in replay(head[0], group):
            hashed.update(f"{between}{role}:{text}".encode())
            between = "\n"
        yield {"illegal": head[1], "cost": head[2], "audit": head[0], "sha256": hashed.hexdigest()}

    columns = [("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("sha256", pa.string())]
    return _replayed(rows, told, each, columns, "conv {conv}, illegal bigint, cost bigint, audit string, sha256 string")


def report(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Per conversation with rows: gaps, blank, duplicate, truncated, illegal, cost, audit and the SHA-256
    of the repaired rows. `rows` has the columns of `rows_of`."""
    found = stored(faults(rows), "faults")
    counted = counts(found)
    told = digests(rows, audits(found, piece))
    return _beside(told, counted, "conv", how="inner")


def damage_report(conversations: DataFrame) -> DataFrame:
    """`report` of the damaged conversations, with a row for each conversation of the table."""
    rows = rows_of(conversations)
    found = report(damaged(rows))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return _beside(rows.select("conv").distinct(), found, "conv").select(
        F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
