"""Conversation repair, filter audit and line dedup against brute force, with odd rows in each."""

import collections
import hashlib
import itertools
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import tabloom.llm.interaction as interaction
import tabloom.llm.linededup as linededup
import tabloom.llm.repair as repair

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


# ---- conversation repair

def cheapest(rows):
    """(cost, edits) by dynamic programming over (initial, fault) rows, from the end."""
    owed = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def inserts(best):
        for _ in range(4):
            for q in range(4):
                if owed[q] in best:
                    cost, edits = best[owed[q]]
                    best[q] = min(best.get(q, (1 << 60, "")), (cost + 5, "I" + edits))
        return best

    best = inserts({0: (0, ""), 3: (0, "")})
    for initial, fault in reversed(rows):
        before = {}
        for q in range(4):
            late = 5 * (fault == "truncated")
            ways = [("D", q, 2)]
            if fault not in ("blank", "duplicate"):
                ways.append(("R", owed[q], 1 + late))
                if q in keeps.get(initial, {}):
                    ways.append(("K", keeps[initial][q], late))
            before[q] = min((best[to][0] + cost, edit + best[to][1]) for edit, to, cost in ways)
        best = inserts(before)
    return best[0]


def brute_report(rows):
    """Everything op11 says about one conversation's rows (turn, role, text)."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults, count = set(), [], collections.Counter()
    for _, role, text in rows:
        core = text.strip(SPACE)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        count[fault] += 1
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cheapest(list(zip(initials, faults, strict=True)))
    out, state, at = [], 0, 0
    for edit in audit:
        row = None
        if edit != "I":
            row, at = rows[at], at + 1
        if edit == "D":
            continue
        role = row[1] if edit == "K" else "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        out.append((role, row[2] if row else ""))
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha), out


def conversation(rng, size):
    texts = ["", " \t", None, "yes.", "no", "what?", "ok! ", "Ünï.", "x" * 5000 + ".", "a\nb", "fine.", "go on!", "right?", "hm."]
    roles = ["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(rng.choice([None, *range(size)]), rng.choice(roles), rng.choice(texts)) for _ in range(size)]


def test_search_against_dynamic_programming():
    rng = random.Random(4)
    kinds = {"x": ("u", "blank"), "s": ("s", ""), "u": ("u", ""), "a": ("a", ""), "o": ("t", ""),
             "S": ("s", "truncated"), "U": ("u", "truncated"), "A": ("a", "truncated"), "O": ("t", "truncated")}
    for _ in range(1500):
        codes = "".join(rng.choice(rng.choice(["xsuaoSUAO", "uauauax"])) for _ in range(rng.randrange(15)))
        want = cheapest([kinds[c] for c in codes])
        assert repair.cheapest(codes) == want
        cut = rng.randrange(1, 6)
        parts = [codes[i:i + cut] for i in range(0, len(codes), cut)]
        assert repair.joined(iter([repair.ways(p) for p in parts])) == want
    assert repair.cheapest("ua" * 2000) == (0, "K" * 4000)


@pytest.mark.parametrize("piece", [2, 128])
def test_repair_report(spark, piece):
    rng = random.Random(9)
    groups = {c: conversation(rng, rng.randrange(1, 12)) for c in [None, *range(40)]}
    groups[77] = [(i, "user" if i % 2 else "assistant", f"t{i}.") for i in range(1000)]
    groups[78] = [(3, "user", "same.")] * 300 + [(None, "system", None)] * 20
    data = [(c, t, r, x, "clash") for c, rows in groups.items() for t, r, x in rows]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, sha string").repartition(7)
    rows = repair.rows_of(df)
    got = {r.conv: tuple(r)[1:] for r in repair.report(rows, piece=piece).select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256").collect()}
    want = {c: brute_report(r) for c, r in groups.items()}
    assert got == {c: w[0] for c, w in want.items()}
    told = repair.audits(repair.faults(rows), piece)
    fixed = repair.repaired(rows, told).orderBy("conv", "place").collect()
    for c in groups:
        assert [(r.role, r.text) for r in fixed if r.conv == c] == want[c][1]


def test_damage_and_empty_tables(spark):
    import zlib
    rows = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate([("system", "be good."), ("user", "hi?"), ("assistant", "yes. no!"), ("tool", None)])]
    rows += [(None, None, None, "a."), (99, 1, "user", "b.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = collections.defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        dealt = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want[c] += [(t, "user" if dealt == 4 else r, "" if dealt == 1 else re.sub("[.!?]", "", x) if dealt == 2 else x)] * {0: 0, 3: 2}.get(dealt, 1)
        want[c] += []
    got = {r.conv_id: tuple(r)[1:] for r in repair.damage_report(df).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert set(got) == {r[0] for r in rows}
    assert got == {c: brute_report(want[c])[0] if want[c] else nothing for c in got}
    assert repair.damage_report(df.limit(0)).count() == 0


# ---- filter audit

def test_shares_are_exact():
    rng = random.Random(2)
    for k in (1, 2, 3, 5):
        cells = [(m, rng.randrange(50)) for m in range(1 << k)]
        v = interaction.coalition_values(cells, k)
        want = [Fraction(0)] * k
        orders = list(itertools.permutations(range(k)))
        for order in orders:
            before = 0
            for i in order:
                want[i] += Fraction(v[before | 1 << i] - v[before], len(orders))
                before |= 1 << i
        assert interaction.shares(v, k) == want


def test_filter_audit(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(60))
    pool = [None, "", "  ", "short", "NO " * 60, long, long + " #", long.upper(), "é" * 30 + " a b", long + "\x0b\x0c|x", "x" * 30_000]
    rows = [(rng.choice([None, *range(25)]), rng.choice(pool), rng.choice(["a", "b", None, ""])) for _ in range(80)]
    rows += rows[:5]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(20)] + [(3, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id bigint, text string, source string, n int, mask string")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}

    def fails(doc_id, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
               "D": bool(re.search("[#$%&*|]", text)),
               "E": any(o is not None and doc_id is not None and o < doc_id and (t or "") == text for o, t, _ in rows)}
        return {k for k, v in out.items() if v}

    parts = collections.defaultdict(list)
    for i, t, s in rows:
        parts[s or ""].append((i, fails(i, t or "")))
    want, total = {}, collections.Counter()
    for part, members in parts.items():
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                here = [i for i, fs in members if f in fs and not fs & gone]
                kept = sum(not fs & (gone | {f}) for _, fs in members)
                want[part, "".join(order), step] = [kept, len(here), sum(f in fs and bool(fs & gone) for _, fs in members),
                    sum(fs == {f} for _, fs in members), sum(i in good for i in here), sum(i in toxic for i in here)]
                total[part, f] += len(here)
                gone |= {f}
    got = interaction.filter_audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in got} == want
    assert all(r.shapley == total[r.part, r.filter_order[r.step - 1]] for r in got)
    assert len(got) == 600 * len(parts)
    assert interaction.filter_audit(docs.limit(0), labels).count() == 0
    assert interaction.filter_audit(docs, labels.limit(0)).where("good_lost > 0").count() == 0


# ---- line dedup

def brute_lines(rows, least=40, docs=5):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    rank = lambda i: (i is not None, i or 0)
    held = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(held.get(key(x), ())) < docs or max(held[key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def test_line_dedup(spark):
    rng = random.Random(8)
    shared = [f"This line number {i} is shared by many documents" for i in range(6)] + ["Ä" * 39, "é" * 40, "Ünïcode line ß that İs longer than forty points"]
    rows = [(rng.choice([None, *range(60)]), "\n".join(
        rng.choice(["", "short", f"own line {rng.random()} of this very document only", "\t" + rng.choice(shared) + " \r",
                    rng.choice(shared).upper(), rng.choice(shared)]) for _ in range(rng.randrange(0, 200)))) for _ in range(70)]
    rows += rows[:4] + [(500, None), (501, ""), (502, "\n\n"), (503, (shared[0] + "\n") * 700)]
    rows += [(600 + i, shared[1]) for i in range(300)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id bigint, text string, pos int, keep string").repartition(9)
    want = sorted(brute_lines(rows), key=str)
    left = sorted(((r.doc_id, r.text) for r in linededup.without_shared_lines(df).collect()), key=str)
    assert left == sorted(((i, text if raw is not None else None) for (i, _, _, text), (_, raw) in zip(brute_lines(rows), rows, strict=True)), key=str)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.line_digests(df).collect()), key=str)
    assert got == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want), key=str)
    assert linededup.without_shared_lines(df).columns == df.columns
    assert linededup.line_digests(df.limit(0)).count() == 0


def test_line_bitmaps_name_the_kept_lines(spark):
    line = "a line of more than forty characters, shared by all"
    df = spark.range(6).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.lit("\n".join(["x"] * 70 + [line, "y"])))
                               .otherwise(F.lit(line)).alias("text"))
    maps = {r.id: (r.n_dropped, [tuple(w) for w in r.keep]) for r in linededup.line_bitmaps(df).collect()}
    assert maps[0] == (1, [(1, ~(1 << 6))]) and maps[4] == (1, [(0, ~1)]) and 5 not in maps
