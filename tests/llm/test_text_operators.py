"""Text operators against brute force, round trips and held-out labels, with odd rows in each."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import tabloom.llm.bytebpe as bytebpe
import tabloom.llm.chosenpath as chosenpath
import tabloom.llm.decontam as decontam
import tabloom.llm.exact as exact
import tabloom.llm.hpylm as hpylm
import tabloom.llm.langid as langid
import tabloom.llm.licenses as licenses
import tabloom.llm.quality as quality
import tabloom.llm.suffix as suffix
import tabloom.llm.toxic as toxic
from tabloom.llm.components import components

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def frame(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame(
        [(i, t, None, 1.5, "x") for i, t in zip(ids, texts, strict=True)],
        "doc_id bigint, text string, lang string, score double, digest string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


ODD = [None, "", " ", "...", "a", "Ünï çödé", "one two three four", "x" * 3000, "a b " * 2000, "it's  \t\n  so!!", "　  z", "日本語テキスト 123"]


# ---- exact copies

def test_exact_groups_and_index(spark, tmp_path):
    texts = ["a  b", "a\tb", "a b", None, "", "c", "c", "a b "]
    got = {r.doc_id: r for r in exact.exact_groups(frame(spark, texts)).collect()}
    assert [got[i].keep_id for i in range(8)] == [0, 0, 0, 3, 3, 5, 5, 7]
    assert [got[i].group_size for i in range(8)] == [3, 3, 3, 2, 2, 2, 2, 1]
    assert got[0].text_sha256 == hashlib.sha256(b"a b").hexdigest() and got[0].kept and not got[1].kept
    path = str(tmp_path / "index")
    first = exact.exact_groups(frame(spark, ["p", "q"], [5, 6]), path=path)
    assert all(r.kept for r in first.collect())
    second = {r.doc_id: r for r in exact.exact_groups(frame(spark, ["q", "r", "r"], [1, 2, 3]), path=path).collect()}
    assert second[1].keep_id == 6 and not second[1].kept and second[2].kept and not second[3].kept
    assert exact.DigestIndex(spark, path).rows().count() == 3


def test_exact_repeated_rows_null_ids_empty(spark):
    rows = frame(spark, ["a", "a", "b", "b", None], [1, 1, None, 4, None])
    left = exact.deduplicated(rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == [("1", "a"), ("4", "b"), ("None", "None")]
    assert left.columns == rows.columns
    assert exact.exact_groups(rows.limit(0)).count() == 0


def test_exact_heavy_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact.exact_groups(rows)
    assert got.count() == 3000 and got.where("group_size = 1000").count() == 1000 and got.where("kept").count() == 2001


# ---- benchmark decontamination

def brute_hits(texts, items, n):
    out = []
    wins = {}
    for key, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add(str(key))
    for text in texts:
        w, hit, found = words(text), set(), set()
        for win, keys in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= keys
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("patterns", [20_000, 5])
def test_decontamination(spark, monkeypatch, patterns):
    monkeypatch.setattr(decontam, "PATTERNS", patterns)
    rng = random.Random(3)
    vocabulary = ["ab", "abc", "bc", "é", "c9", "d"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(60)] + ["AB-abc  Bc!", *ODD]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 7)))) for k in range(12)]
    items += [(10, items[0][1]), (2, None), (3, ""), (70, "ab abc bc"), (None, "d d d d")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_hits(texts, [("null" if k is None else k, t) for k, t in items], 4)
    found = {r.doc_id: r for r in decontam.contamination(frame(spark, texts), bench, 4).collect()}
    flags = {r.doc_id: r for r in decontam.flagged(frame(spark, texts), bench, 4).collect()}
    for i, (n_words, n_hit, keys) in enumerate(want):
        assert (flags[i].n_words, flags[i].n_hit, flags[i].n_items) == (n_words, n_hit, len(keys))
        assert found[i]["items"] == keys and flags[i].contaminated == (n_hit > 0)
        assert flags[i].items_sha256 == hashlib.sha256(",".join(keys).encode()).hexdigest()
        for (a, b), (s, e) in zip(found[i].words, found[i].spans, strict=True):
            assert words(texts[i].encode()[s:e].decode()) == words(texts[i])[a:b]
    clean = decontam.clean_documents(frame(spark, texts), bench, 4)
    assert {r.doc_id for r in clean.collect()} == {i for i, w in enumerate(want) if not w[1]}
    assert clean.columns == frame(spark, texts).columns
    assert decontam.flagged(frame(spark, texts), bench.limit(0), 4).where("contaminated").count() == 0
    assert decontam.flagged(frame(spark, []), bench, 4).count() == 0


# ---- licences

def test_automaton_statistics():
    rng = random.Random(5)
    for _ in range(30):
        templates = [" ".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        sam = licenses.SuffixAutomaton(templates)
        runs = [t.split() for t in templates]
        text = rng.choices("abcde", k=40)
        got = list(sam.statistics([sam.words.get(w.encode(), 0) for w in text]))
        for i, (_, size) in enumerate(got):
            want = max(n for n in range(i + 2) if n == 0 or any(
                text[i + 1 - n:i + 1] == r[k:k + n] for r in runs for k in range(len(r))))
            assert size == want
        places, _ = licenses.scan_words([w.encode() for w in text], sam, len(templates))
        want = [(k, i) for k, r in enumerate(runs) for i in range(len(text)) if text[i:i + len(r)] == r]
        assert sorted(places) == sorted(want)


def test_licence_scan(spark):
    texts = ["CC by CC-BY", "Licensed under the Apache License, Version 2.0.", "all rights. Reserved", "general public",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated "
             "documentation files, to deal in the software without restriction", *ODD]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].score) == (2, 0, 2, "cc-by", 1.0)
    assert got[1].labels == "apache-2" and got[1].base_labels == "" and got[1].first_word is None
    assert got[2].labels == "reserved" and got[3].n_base == 0 and got[4].labels == "mit-text"
    assert all(got[i].n_words == len(words(t)) for i, t in enumerate(texts))
    assert licenses.scan(frame(spark, [])).count() == 0


# ---- byte-level BPE

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_library(spark, tokenizer, monkeypatch):
    path, pattern, library = tokenizer
    monkeypatch.setattr(bytebpe, "WORDS", 60)  # several blocks
    rng = random.Random(9)
    signs = "abcdeéñ  \t\n\r\x0b\x1c\x85\xa0'!?.0123456789ABC日本🙂​ "
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 80))) for _ in range(150)]
    texts += [*ODD, "aaaa" * 700, "the they're don't 's't", "é" * 300]
    encoded = bytebpe.encode(frame(spark, texts), path, pattern)
    got = {r.doc_id: r for r in bytebpe.decode(encoded, path).collect()}
    for i, text in enumerate(texts):
        assert got[i].ids == library.encode_ordinary(text or ""), text
        assert bytes(got[i].raw) == (text or "").encode()
    assert bytebpe.encode(frame(spark, []), path, pattern).count() == 0


def test_bpe_merges_common_words_once(spark, tokenizer, monkeypatch):
    path, pattern = tokenizer[:2]
    blocks, made = [], bytebpe._blocks
    monkeypatch.setattr(bytebpe, "SHARE", 1)
    monkeypatch.setattr(bytebpe, "_blocks", lambda *given: blocks.append(made(*given)) or blocks[-1])
    texts = ["Quetzalcoatlus\u00e4xyz Donaudampfschifffahrt"] * 40 + ["Hapaxlegomenonword"]
    got = {r.doc_id: list(r.ids) for r in bytebpe.encode(frame(spark, texts).repartition(4), path, pattern).collect()}
    assert blocks[0].agg(F.sum(F.size("words"))).first()[0] == 1  # the word that is met once
    monkeypatch.setattr(bytebpe, "SHARE", 1 << 40)  # no word is merged beforehand
    assert got == {r.doc_id: list(r.ids) for r in bytebpe.encode(frame(spark, texts), path, pattern).collect()}


def test_bpe_repeated_and_null_ids(spark, tokenizer):
    path, pattern, library = tokenizer
    got = bytebpe.encode(frame(spark, ["one", "one", "two"], [1, 1, None]), path, pattern).collect()
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == sorted(
        (k, tuple(library.encode_ordinary(t))) for k, t in (("1", "one"), ("1", "one"), ("None", "two")))


def test_bpe_digests_in_slices_and_a_small_plan(spark, tokenizer, monkeypatch):
    path, pattern, library = tokenizer
    monkeypatch.setattr(bytebpe, "TOKENS", 7)  # several slices of a batch
    texts = ["Quetzalcoatlus \u00e4xyz " * 3, "", None, "aaaa" * 90, "\u65e5\u672c\u8a9e text"]
    out = bytebpe.digests(frame(spark, texts), path, pattern)
    assert len(out._jdf.queryExecution().toString()) < 50_000  # no vocabulary in the plan
    got = {r.doc_id: r for r in out.collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


# ---- language, quality, toxicity

def test_language(spark, docs):
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert got.where("rejected").count() <= 0.01 * got.count()
    model = langid.fit(docs)
    odd = {r.doc_id: r for r in langid.identify(frame(spark, ODD), model).collect()}
    assert [odd[i].lang_pred for i in range(4)] == ["und"] * 4 and odd[0].score == 0 and all(0 <= r.score <= 1 for r in odd.values())
    assert langid.identify(frame(spark, []), model).count() == 0
    assert {r.lang_pred for r in langid.predictions(frame(spark, ["abc", None])).collect()} == {"und"}
    marked = docs.limit(20).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    assert langid.accepted(marked).where("text is null").count() == 0


@pytest.mark.parametrize("n_known", [1, 2, 3])
def test_language_left_out(spark, docs, n_known):
    """Texts of a language that was not learned, and gibberish, are rejected; known ones are not."""
    langs = sorted(r[0] for r in docs.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count")).limit(4).collect())
    model = langid.fit(docs.where(F.col("lang").isin(langs[:n_known])))
    found = langid.identify(docs.where("length(text) > 100"), model).join(docs.select("doc_id", "lang"), "doc_id")
    share = {r.lang: r.s for r in found.groupBy("lang").agg(F.avg(F.col("rejected").cast("double")).alias("s")).collect()}
    print(n_known, share, model.bound, model.most_strange)
    assert all(share[x] <= 0.05 for x in langs[:n_known])
    assert all(share[x] >= 0.9 for x in langs[n_known:])
    rng = random.Random(3)
    odd = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(60)) for _ in range(20)]
    assert langid.identify(frame(spark, odd), model).where("rejected").count() >= 19


def test_language_pieces_from_whole_text(spark):
    """Nothing but the end of the texts tells the languages apart."""
    rows = [(i, "0 " * 1050 + ("wald und wiese " if i % 2 else "bosque y prado ") * 2000, "de" if i % 2 else "es") for i in range(1200)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(train)
    assert model.probabilities([b"wald und wiese " * 20, b"bosque y prado " * 20]).argmax(1).tolist() == [0, 1]


def test_quality(spark, docs, labels):
    got = quality.predictions(docs, labels).join(labels, "doc_id")
    held = got.where("held_out")
    assert held.where("quality = predicted").count() >= 0.95 * held.count()
    odd = quality.predictions(frame(spark, ODD), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and all(r.score == 0.5 for r in odd)
    model = quality.fit(docs, labels)
    assert all(0 <= r.score <= 1 for r in quality.score(frame(spark, ODD), model).collect())
    assert quality.score(frame(spark, []), model).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(k, quality.FEATURES)) for k in (1, 4, 7)] * 20
    bags = [b + (i % 2) * np.eye(1, quality.FEATURES) * 3 for i, b in enumerate(bags)]
    model = quality.train(bags, np.arange(len(bags)) % 2)
    assert ((model.score(bags) > 0.5) == np.arange(len(bags)) % 2).mean() > 0.9


def test_toxicity(spark, docs, labels):
    got = toxic.predictions(docs, labels).join(labels, "doc_id")
    assert got.where("toxic = 0 and predicted = 1").count() <= 0.01 * got.where("toxic = 0").count()
    english = got.join(docs.where("lang = 'en' and text rlike '(?i)idiot|stupid|moron|scum|loser'").select("doc_id"), "doc_id").where("toxic = 1")
    assert english.where("predicted = 1").count() >= 0.9 * english.count()
    model = toxic.fit(docs, labels)
    odd = toxic.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(r.score < 0.5 for r in odd)
    assert toxic.score(frame(spark, []), model).count() == 0
    assert toxic.predictions(frame(spark, ["you idiot", None]), labels.limit(0)).where("predicted = 1").count() == 1


@pytest.mark.parametrize("text, kind", [
    ("what an idiot", "insult"), ("you are an idiot", "aimed_insult"), ("idiot that you are", "aimed_insult"),
    ("he is not an idiot", "negated_insult"), ("she called him an idiot", "reported_insult"),
    ("we will kill you", "threat"), ("kill the lights. you know", None), ("not here. idiot", "insult"),
])
def test_grammar(text, kind):
    reader = toxic.Reader(toxic.Insults({}, {}))
    found = [toxic.KINDS[k] for _, k, _ in reader.matched(toxic.folded(text.encode()))]
    assert found == ([kind] if kind else [])


# ---- language model

def test_language_model(spark, docs):
    got = {r.doc_id: r for r in hpylm.score(docs).collect()}
    counts, tokens = collections.Counter(), {}
    for r in docs.collect():
        tokens[r.doc_id] = (r.text or "").encode().lower().split() + [" end "]
        if zlib.crc32(str(r.doc_id).encode()) % 10:
            counts.update(tokens[r.doc_id])
    n, v = sum(counts.values()), len(counts)
    held = [0.0, 0.0]
    for key, found in tokens.items():
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in found)
        row = got[key]
        assert math.isclose(base, row.base_score, rel_tol=1e-9)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(found), sum(counts[t] > 0 for t in found), n)
        assert row.score < 0
        if row.held_out:
            held[0] += row.score
            held[1] += base
    assert held[0] > held[1]


def test_language_model_odd_rows(spark):
    got = {r.doc_id: r for r in hpylm.score(frame(spark, ODD)).collect()}
    assert len(got) == len(ODD) and got[0].n_tokens == 1 and all(r.score < 0 for r in got.values())
    assert hpylm.score(frame(spark, [])).count() == 0
    assert hpylm.score(frame(spark, ["a b"], [None])).count() == 1


def test_language_model_pairs_beyond_frequent_words(spark):
    """Pairs of words that are neither frequent contexts nor frequent dishes count in the score."""
    rng = random.Random(5)
    usual = [f"u{i}" for i in range(hpylm.DISHES)] * 8
    first, second = [f"a{i}" for i in range(600)], [f"b{i}" for i in range(600)]
    train, held = ([i for i in range(400) if (zlib.crc32(str(i).encode()) % 10 == 0) == out] for out in (False, True))
    rng.shuffle(usual)
    texts = {i: " ".join(usual[k::len(train)]) for k, i in enumerate(train)}
    for k, i in enumerate(train):
        places = [(k + s * 37) % 600 for s in range(9)]
        texts[i] += " " + " ".join(f"{first[j]} {second[j]}" for j in places)
    pick = rng.sample(range(600), 40)
    texts[held[0]] = " ".join(f"{first[j]} {second[j]}" for j in pick)
    texts[held[1]] = " ".join(f"{first[j]} {second[k]}" for j, k in zip(pick, pick[1:] + pick[:1]))
    rows = [(i, t) for i, t in texts.items()]
    got = {r.doc_id: r.score for r in hpylm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 20


def test_seating_matches_exact_distribution():
    d, theta, p, c = 0.5, 1.0, 0.2, 6
    weights = np.zeros(c + 1)

    def grow(tables, k, chance):
        if k == c:
            weights[len(tables)] += chance
            return
        for i, size in enumerate(tables):
            grow(tables[:i] + [size + 1] + tables[i + 1:], k + 1, chance * (size - d))
        grow([*tables, 1], k + 1, chance * (theta + d * len(tables)) * p)

    grow([], 0, 1.0)
    weights /= weights.sum()
    drawn = hpylm.seat(np.full(40_000, c), np.full(40_000, p), theta, d, 0, np.random.default_rng(2), hpylm.log_stirling(hpylm.EXACT, d))
    assert np.abs(np.bincount(drawn, minlength=c + 1) / 40_000 - weights).max() < 0.01


def test_spelling_sums_to_one():
    symbol = np.full(256, hpylm.OTHER, np.uint8)
    symbol[97], symbol[98] = 0, 1
    code, starts = hpylm.Spelling.codes([b"ab", b"b", b"aab"], symbol)
    assert starts.tolist() == [0, 3, 5] and len(code) == 9
    model = hpylm.Spelling(symbol, np.bincount(code, minlength=1 << 18))
    total = np.exp(model.log).reshape(64, 64, 64).sum(2)
    assert np.allclose(total[[63, 0, 0], [0, 0, 1]], 1)
    assert model.log_p([b"ab"])[0] > model.log_p([b"ba"])[0] and len(model.log_p([])) == 0


# ---- near copies

def brute_links(texts):
    sets = [frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
            for w in map(words, texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                root[max(top(i), top(j))] = min(top(i), top(j))
                if sets[i] != sets[j]:
                    links[i].add(sets[j])
                    links[j].add(sets[i])
    return [(top(i), len(links[i])) for i in range(len(texts))]


def near_texts(seed, groups, size):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = rng.choices(vocabulary, k=12)
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(20, 120)) + shared
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("small, block", [(48, 2048), (3, 7)])
def test_near_copies(spark, monkeypatch, small, block):
    monkeypatch.setattr(chosenpath, "SMALL", small)
    monkeypatch.setattr(chosenpath, "BLOCK", block)
    texts = near_texts(4, 25, 6) + near_texts(6, 1, 40) + [*ODD, "a b", "a b", "A-b"]
    rows = frame(spark, texts)
    got = {r.doc_id: r for r in chosenpath.similar_texts(rows).collect()}
    want = brute_links(texts)
    assert [(got[i].class_id, got[i].n_links) for i in range(len(texts))] == want
    left = chosenpath.one_of_each(rows)
    assert {r.doc_id for r in left.collect()} == {i for i, (c, _) in enumerate(want) if c == i} and left.columns == rows.columns
    assert chosenpath.similar_texts(frame(spark, [])).count() == 0


def test_group_that_holds_together_is_not_split(spark, monkeypatch):
    split, longer = [], chosenpath._longer
    monkeypatch.setattr(chosenpath, "_longer", lambda *given: split.append(longer(*given)) or split[-1])
    texts = [" ".join(f"w{k}" for k in range(600)) + f" end{i}" for i in range(120)]  # similar at 0.99
    got = chosenpath.similar_texts(frame(spark, texts)).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 119)}
    assert not split or split[0].count() == 0


def test_near_copies_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    got = chosenpath.similar_texts(frame(spark, [text, text, text, "other words stand here now", None], [7, 7, None, 7, None])).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == [("7", "7"), ("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    root = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert got == {i: top(i) for i in root}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# ---- repeated byte strings

def brute_repeats(rows):
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.add(raw[s:s + 100])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[key] = (len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group", [3000, 1])
def test_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(suffix.repeated_windows, "__defaults__", (group,))
    rng = random.Random(2)
    passages = ["".join(rng.choices("abcdefgh é", k=n)) for n in (60, 99, 100, 101, 160, 400)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choices("xyz01 ", k=rng.randint(1, 90))))
        texts.append("".join(parts))
    texts += [*ODD, *texts[:5], "ab" * 500, "q" * 99, "q" * 100, "q" * 101]
    order = list(range(len(texts)))
    rng.shuffle(order)
    got = {r.doc_id: r for r in suffix.remove_repeats(frame(spark, texts, order), piece=230).collect()}
    for key, want in brute_repeats(list(zip(order, [t or "" for t in texts], strict=True))).items():
        assert (got[key].n_bytes, got[key].n_removed, got[key].n_spans, got[key].kept_sha256) == want
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


def test_repeats_repeated_and_null_ids(spark):
    text = "".join(random.Random(1).choices("abcdef", k=150))
    got = suffix.remove_repeats(frame(spark, [text, text, text, "short"], [3, 3, None, None])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("3", 0), ("3", 150), ("None", 0), ("None", 150)]


def test_windows_of_a_border_anchor_stay_together(spark):
    rng = random.Random(12)
    for _ in range(300):
        raw = "".join(rng.choices("abc", k=rng.randint(100, 900))).encode()
        whole, cut = suffix.anchors(raw), suffix.anchors(raw, step=rng.randint(110, 300))
        assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))


def test_near_copies_with_repeated_and_null_ids(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    near = base[:-1] + ["other"]
    text, copy, apart = " ".join(base), " ".join(near), " ".join(f"z{i}" for i in range(80))
    left = chosenpath.one_of_each(frame(spark, [text, copy, apart], [1, 5, 5])).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(1, text), (5, apart)])
    third = " ".join(base[1:])
    rows = chosenpath.similar_texts(frame(spark, [text, copy, third, third, apart], [None, None, 7, None, None])).collect()
    links = sorted((str(r.doc_id), r.n_links, r.n_similar) for r in rows)
    assert links == sorted([("None", 2, 3), ("None", 2, 3), ("7", 2, 3), ("None", 2, 3), ("None", 0, 0)])
