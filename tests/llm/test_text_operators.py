"""Packing, BPE, substring dedup, near dedup, sharding and media against brute force."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, media, near_dedup, packing, sharding, substring_dedup
from tessera.llm.common import store_of
from tessera.llm.files import tokenizer_file, tokenizer_pattern
from tessera.llm.queries import QUERIES

BYTES, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# packing


@given(st.integers(0, 5000), st.integers(0, 10))
def test_spans_are_binary_and_gapless(n, k):
    got = packing.spans(n, 1 << k)
    assert [s for s, _ in got] == list(np.cumsum([0, *(x for _, x in got)])[: len(got)])
    assert sum(x for _, x in got) == n and all(x & (x - 1) == 0 and x <= 1 << k for _, x in got)


def pack(df):
    return packing.pack(df, BYTES, ranks=tokenizer_file("byte_bpe_50k.tiktoken"), pattern=tokenizer_pattern())


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_packing_round_trip(request, which):
    df = request.getfixturevalue(which)
    full = library(BYTES)
    want = collections.Counter((i, tuple(full.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in texts_of(df))
    pieces = pack(df).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    assert all(p["length"] == 1 << p["bucket"] == len(p["ids"]) // 4 <= 1024 and p["offset"] == 0 for p in pieces)
    whole, order = collections.Counter(), sorted(pieces, key=lambda p: p["sequence_id"])
    at = 0
    while at < len(order):
        n, ids = order[at]["doc_tokens"], []
        first = order[at]["doc_id"]
        while len(ids) < n:
            assert order[at]["start"] == len(ids)
            ids += np.frombuffer(order[at]["ids"], "<u4").tolist()
            at += 1
        whole[(first, tuple(ids))] += 1
    assert whole == want


def test_packing_empty_table_and_query(spark, no_docs, base):
    assert pack(no_docs).count() == 0
    rows = QUERIES["op1_packing"](spark, base).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    full = library(BYTES)
    for i, t in texts_of(spark.read.parquet(f"{base}/documents.parquet"))[:40]:
        ids = full.encode(t, add_special_tokens=False).ids + [0]
        for r in by[i]:
            assert r["ids_crc32"] == packing.crc_of(ids[r["start"] : r["start"] + r["length"]])


# BPE


@pytest.fixture(scope="module")
def coder(docs):
    return bpe.coder(WORDS, bpe.build_lexicon(docs, WORDS, size=3000))


ODD = ["", "  a  b ", "<|endoftext|>x <|startoftext|>", "a<|endoftext|>b", "ΣΑΣ Σ", "İstanbul", "éa", "日本語 text", "don't I'LL it's", "1234 a1b2", "\x1c a\x85b", "a b", "!!! ... ?!", "ﬁ Ⅷ", "ß ẞ ŉ", "a\x00b", "😀 x😀y", "﻿x", "a\x0bb\x0cc", "ª º µ", "word." * 50, "x" * 5000, "ab" * 2500 + "c." * 50]


@pytest.mark.parametrize("text", ODD)
def test_bpe_odd_texts(coder, text):
    full = library(WORDS)
    ids = full.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids
    assert coder.decode(coder.encode(text)) == full.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(text):
    c, full = bpe.coder(WORDS, None), library_cached()
    assert np.frombuffer(c.encode(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids


_LIB = []


def library_cached():
    if not _LIB:
        _LIB.append(library(WORDS))
    return _LIB[0]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.binary(min_size=1, max_size=6))
def test_automaton_numbers_words(words, other):
    ordered = sorted(words)
    a = bpe.Automaton.of(ordered)
    assert [a.index(w) for w in ordered] == list(range(len(ordered)))
    assert (a.index(other) >= 0) == (other in words)


def test_automaton_shares_suffixes():
    assert len(bpe.Automaton.of([b"talked", b"talking", b"walked", b"walking"]).final) < 14


@settings(max_examples=60, deadline=None)
@given(st.text("abcdeinorst", min_size=1, max_size=400))
def test_bpe_long_merges_like_short(word):
    v = bpe.coder(WORDS, None).v
    ids = [v.byte_ids[b] for b in word.encode()]
    ids[-1] = v.end_ids[word.encode()[-1]]
    ranks = [v.pair_ranks.get(a << 20 | b, v.none) for a, b in zip(ids, ids[1:], strict=False)]
    whole = np.array(library_cached().encode(word, add_special_tokens=False).ids, "<u4").tobytes()
    assert v._merge_long(ids, ranks) == v.merge(word.encode()) == whole


@pytest.mark.parametrize("text", ["a" * 300_000, "abcdefgh" * 40_000 + " end", " " * 2_000_000, "\n" * 1_100_000 + "x", "word " * 1_000_000])
def test_very_long_texts_take_seconds(text):
    start = time.monotonic()
    got, packed = bpe.coder(WORDS, None).encode(text), packing.encoder(BYTES, tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern())(text)
    took = time.monotonic() - start
    assert np.frombuffer(got, "<u4").tolist() == library_cached().encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == library(BYTES).encode(text, add_special_tokens=False).ids
    assert took < 30


def test_bpe_parts_of_a_long_text(monkeypatch):
    text = "Some words, <|endoftext|> and more.\nOthers\t" * 40
    want = library_cached().encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "BLOCK", 64)
    c = bpe.Coder(bpe.Vocabulary(WORDS), None)
    ids = c.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want and c.decode(ids) == library_cached().decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["Aİ. x", "İ,", "<|EndOfText|> A", "<|endoftext|><|ENDOFTEXT|> B.", "Hello, WORLD. it'S 'LL,", "a,, b.) c.,"])
def test_bpe_stops_and_lowered_texts(text):
    """Stops behind a letter that lowers to two signs, and special tokens in other cases, alone and after one another."""
    c = bpe.Coder(bpe.Vocabulary(WORDS), None)
    for t in (text, text.lower(), text):
        assert np.frombuffer(c.encode(t), "<u4").tolist() == library_cached().encode(t, add_special_tokens=False).ids


def test_bpe_pieces_are_coded_once(monkeypatch):
    """Pieces of earlier blocks aren't looked up again, case apart; a full store keeps those in use, long pieces aren't kept."""
    monkeypatch.setattr(bpe, "PIECES", 6)
    c = bpe.Coder(bpe.Vocabulary(WORDS), None)
    looked, table = [], c._table
    c._table = lambda pieces: looked.append(set(pieces)) or table(looked[-1])
    texts = ["one Two three", "ONE two, x", "one four " + "y" * 100, "four five six seven", "one four"]
    for t in texts:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == library_cached().encode(t, add_special_tokens=False).ids
    assert looked == [{"one", "two", "three"}, {"two,", "x"}, {"four", "y" * 100}, {"five", "six", "seven"}, {"one"}]


def test_bpe_operator(spark, odd_docs, no_docs, base):
    full = library(WORDS)
    want = collections.Counter((i, tuple(full.encode(t or "", add_special_tokens=False).ids)) for i, t in texts_of(odd_docs))
    got = bpe.round_trip(odd_docs, WORDS, size=20).collect()
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    assert bpe.round_trip(no_docs, WORDS).count() == 0
    rows = {r["doc_id"]: r for r in QUERIES["op7_bpe"](spark, base).collect()}
    for i, t in texts_of(spark.read.parquet(f"{base}/documents.parquet"))[:50]:
        ids = full.encode(t, add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(full.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# substring dedup


def sentences(text):
    return [x.strip() for x in re.split(r"(?<=[.!?])\s+|\s*\n\s*| (?=[A-ZÀ-Þ])", text) if x.strip()]


def without_repeats(rows, least):
    seen, out = set(), {}
    for i, t in sorted(rows):
        s = sentences(t)
        n, runs = [sum(max(1, len(w.encode()) // substring_dedup.WORD_BYTES) for w in x.split()) for x in s], set()
        for a in range(len(s)):
            ends = [b for b in range(a, len(s)) if sum(n[a : b + 1]) >= least]
            starts = [b for b in range(a, -1, -1) if sum(n[b : a + 1]) >= least]
            runs |= {(a, ends[0])} if ends else set()
            runs |= {(starts[0], a)} if starts else set()
        gone = set()
        for a, b in sorted(runs):
            key = tuple(s[a : b + 1])
            gone |= set(range(a, b + 1)) if key in seen else set()
            seen.add(key)
        out[i] = " ".join(x for k, x in enumerate(s) if k not in gone).split()
    return out


def test_substring_dedup_matches_brute_force(docs):
    rows = [(i, t) for i, t in texts_of(docs) if len(t) < 20_000]
    small = docs.where("length(text) < 20000")
    got = {r["doc_id"]: r["text"].split() for r in substring_dedup.dedup(small).collect()}
    assert got == without_repeats(rows, substring_dedup.LEAST_WORDS)


def test_substring_dedup_finds_passages_inside_sentences(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(" ".join([word().capitalize(), *(word() for _ in range(11))]) + "." for _ in range(5))
    rows = [(i, f"{' '.join(word() for _ in range(20))} {passage} {' '.join(word() for _ in range(20))}.") for i in range(6)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[0] and all(passage.split()[7] not in got[i] for i in range(1, 6))
    assert all(len(got[i].split()) == 40 for i in range(1, 6))


@pytest.mark.parametrize("before", ["1984", "(see)", '"quoted"', "NATO", "a |", "word", "été", "x)"])
def test_substring_dedup_finds_passages_behind_any_sign(spark, before):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(" ".join([word().capitalize(), *(word() for _ in range(16))]) + "." for _ in range(3))
    rows = [(i, f"{' '.join(word() for _ in range(9))} {before} {passage} {' '.join(word() for _ in range(9))}.") for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[0] and all(not set(passage.split()) & set(got[i].split()) for i in (1, 2))
    assert before == "NATO" or all(before in got[i] for i in got)  # a word in capitals starts a sentence, so it is repeated too


def test_substring_dedup_in_a_language_without_spaces(spark):
    rng = random.Random(9)
    line = lambda: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(70))
    passage = "\n".join(line() for _ in range(3))
    rows = [(i, f"{line()}\n{passage}\n{line()}") for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(not set(passage.split()) & set(got[i].split()) and len(got[i].split()) == 2 for i in (1, 2))


def test_substring_dedup_odd_rows(odd_docs, no_docs):
    got = substring_dedup.dedup(odd_docs, least_words=8)
    assert got.columns == [*odd_docs.columns, "removed_spans", "removed_bytes"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r["text"])
    assert by[3] == [None] and by[4] == [""] and by[2] == ["", ""] and by[1][0].startswith("One two") and len(by[6]) == 1
    assert substring_dedup.dedup(no_docs).count() == 0


# near dedup


def truth(rows, size, threshold=80):
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), t or ""))
    sets = {}
    for i, t in rows:
        w = low(t)
        k = min(size, len(w))
        sets[i] = set(zip(*(w[j:] for j in range(k)), strict=False)) if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= threshold * large and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def components_of(df, size):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, size=size).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup_matches_brute_force(docs, size):
    assert components_of(docs, size) == truth(texts_of(docs), size)


def test_near_dedup_of_a_large_group_edited_apart(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    start, rows = [word() for _ in range(150)], []
    for i in range(160):
        w = list(start)
        for k in rng.sample(range(150), rng.choice((0, 2, 5, 9, 14, 20))):
            w[k] = word()
        rows.append((i * 7 % 160, " ".join(w)))
    assert components_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2) == truth(rows, 2)


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup_of_a_large_group_without_its_original(spark, size):
    """More copies than a bucket's pairs take, all edited, some a lot, and some edited further together."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(4))
    few = [word() for _ in range(40)]
    start, rows = [word() for _ in range(160)], []
    for _ in range(110):
        w = list(start)
        for k in rng.sample(range(160), rng.choice((3, 5, 9, 12, 17, 24))):
            w[k] = rng.choice(few)
        rows.append(w)
        if rng.random() < 0.3:
            w = list(w)
            for k in rng.sample(range(160), 4):
                w[k] = word()
            rows.append(w[: rng.choice((140, 150, 160))])
    rows = [(i * 37 % len(rows), " ".join(w)) for i, w in enumerate(rows)]
    assert components_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size) == truth(rows, size)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_near_dedup_tells_words_apart_that_polynomials_confuse(spark):
    rows = [(1, thue_morse(1024, "a", "b")), (2, thue_morse(1024, "b", "a")), (3, "a" * 70), (4, "a" * 71)]
    assert all(i == c for i, (_, c, _) in components_of(spark.createDataFrame(rows, "doc_id long, text string"), 2).items())


def test_near_dedup_confirms_classes(spark):
    """Members of a class by digest whose sets aren't that of its representative are told apart."""
    rows = [(1, "a b c"), (2, "d e f"), (3, "a  b C"), (4, "a b c")]
    source = spark.createDataFrame(rows, "rep long, text string")
    regs = bytes(2 * near_dedup.BANDS * near_dedup.ROWS)
    sketch = spark.createDataFrame([(i, 2, 7, 7, regs, t.encode()) for i, t in rows], "doc_id long, n_shingles long, d1 long, d2 long, regs binary, th binary")
    classes, unconfirmed = near_dedup.classes_of(sketch, source, 2, 0.8)
    assert [r["rep"] for r in classes.collect()] == [1] and [r["rep"] for r in unconfirmed.collect()] == [2]


def test_near_dedup_odd_rows(odd_docs, no_docs):
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd_docs, size=2).collect())
    assert got[(3, 0, 3, True)] == got[(4, 0, 4, True)] == got[(5, 0, 5, True)] == 1 and got[(6, 1, 6, True)] == 1
    assert [n for (i, _, c, k), n in got.items() if i == 2 and c == 1 and not k] == [2]
    assert [(c, k) for (i, _, c, k) in got if i is None] == [(None, True)]
    kept = near_dedup.drop_near_duplicates(odd_docs, size=2)
    assert kept.columns == odd_docs.columns and collections.Counter(r["doc_id"] for r in kept.collect()) == {i: 1 for i in (1, 3, 4, 5, 6, 7, 8, None)}
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    mul, add = near_dedup._draws(1024)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    b = np.concatenate((a[:3000], rng.integers(0, 2**63, 1000).astype(np.uint64)))
    ra, rb = near_dedup.registers(a, mul, add), near_dedup.registers(b, mul, add)
    assert (near_dedup.merged(ra, rb) == near_dedup.registers(np.union1d(a, b), mul, add)).all()
    _, j = near_dedup.plausible(ra[None], rb[None], np.array([4000]), np.array([4000]), 0.8)
    assert abs(j[0] - 0.6) < 0.06


# sharding


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=5), st.integers(1, 6))
def test_flow_keeps_as_much_as_it_can(supply, parts):
    room = sharding.even(sum(supply), parts)
    flow = sharding.min_cost_flow(supply, room, [[int(i != j) for j in range(parts)] for i in range(len(supply))])
    assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(len(supply))] == supply
    assert all(sum(v for (_, j), v in flow.items() if j == k) <= room[k] for k in range(parts))
    kept = sum(v for (i, j), v in flow.items() if i == j)
    assert kept == sum(min(s, r) for s, r in zip(supply, room, strict=False))


def test_sharding_query(spark, base):
    rows = QUERIES["op10_sharding"](spark, base).collect()
    text = dict(texts_of(spark.read.parquet(f"{base}/documents.parquet")))
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(text) and set(load) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= max(len(t.encode()) + 8 for t in text.values())


def test_sharding_odd_rows(odd_docs, no_docs):
    placed, plan = sharding.reshard(odd_docs, old_shards=2, new_shards=3)
    assert plan.affected
    plan.affected.update(range(3))  # nothing was stored before
    rows = sharding.rewrite(placed, plan).collect()
    assert collections.Counter((r["doc_id"], r["text"], r["score"]) for r in rows) == collections.Counter((r["doc_id"], r["text"], r["score"]) for r in odd_docs.collect())
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["__shard"]].append(r["__slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    placed, plan = sharding.reshard(no_docs, old_shards=2, new_shards=3)
    assert placed.count() == 0 and not plan.affected


def placed_groups(rows):
    where, size = collections.defaultdict(set), collections.Counter()
    for r in rows:
        where[r["text_crc32"], r["size"]].add(r["shard"])
        size[r["text_crc32"], r["size"]] += r["size"]
    return where, size


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sharding_keeps_equal_texts_together(spark, sf):
    rows = QUERIES["op10_sharding"](spark, f"/root/testdata/{sf}").collect()
    where, size = placed_groups(rows)
    mean = sum(size.values()) / 24
    assert all(len(where[g]) == 1 for g in where if size[g] <= sharding.SHARE * mean * 0.99)
    load = collections.Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= max(size.values())


def test_sharding_cuts_only_a_group_that_is_too_large(spark, monkeypatch):
    rows = [(i, "the same text " * 5) for i in range(400)] + [(1000 + i, f"text {i % 150} " * (1 + i % 7)) for i in range(800)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __shard string").repartition(5)
    monkeypatch.setattr(sharding, "ROWS_A_BLOCK", 10)
    placed, plan = sharding.reshard(df, old_shards=3, new_shards=6)
    assert plan.columns == ("___shard", "__slot", "__old") and placed.columns == [*df.columns, *plan.columns]
    got = placed.collect()
    where, load, slots = collections.defaultdict(set), collections.Counter(), collections.defaultdict(list)
    for r in got:
        where[r["text"]].add(r["___shard"])
        load[r["___shard"]] += len(r["text"]) + 8
        slots[r["___shard"]].append(r["__slot"])
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    assert len(where[rows[0][1]]) > 1 and all(len(v) == 1 for t, v in where.items() if t != rows[0][1])
    assert max(load.values()) < 1.2 * min(load.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    plan.affected.update(range(6))
    assert sharding.rewrite(placed, plan).count() == len(rows)


def test_unchanged_shards_move_nothing():
    blocks = {(b, 0): (b % 4, 10) for b in range(40)}
    plan = sharding.plan_blocks(blocks, 4, 4)
    assert plan.moved_bytes == 0 and not plan.affected


# media


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=700))
def test_png_round_trip(raw):
    samples = media.payload(raw)
    image = media.encode_png(samples)
    assert len(samples) % 64 == 0 and samples[: len(raw)] == raw and media.decode_png(image) == samples
    assert media.read_header(image[:33]) == (64, len(samples) // 64, 8, 0)


def test_media(spark, odd_docs, no_docs):
    from tessera.llm.common import work_path

    path = work_path(spark, "media-test")
    rows = media.write_shards(odd_docs, path)
    got = media.with_content(media.addressed(rows), path).collect()
    want = collections.Counter((i, hashlib.sha256(media.payload((t or "").encode())).hexdigest()) for i, t in texts_of(odd_docs))
    assert collections.Counter((r["doc_id"], r["payload_sha256"]) for r in got) == want
    for r in got:
        assert r["media_sha256"] == r["digest"] and r["payload_bytes"] == r["width"] * r["height"]
    same = {(r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["feature"]) for r in got}
    assert len(same) == len({r["payload_sha256"] for r in got})
    store, top = store_of(path)
    names = [n for r in rows.select("shard").distinct().collect() for n in media.members(store.open_input_file(f"{top}/{r[0]}").readall())]
    assert set(names) == {f"{r['digest']}.png" for r in got}
    assert media.unreferenced(rows).count() == len(names) - len(set(names))
    assert media.media_columns(no_docs).count() == 0


def brute_media(text):
    raw = (text or "").encode()
    padded = raw + b"\0" * (64 - len(raw) % 64 if not raw or len(raw) % 64 else 0)
    lines = [padded[i : i + 64] for i in range(0, len(padded), 64)]
    cells = []
    for y in range(8):
        part = lines[y * len(lines) // 8 : (y + 1) * len(lines) // 8]
        cells += [sum(sum(line[8 * x : 8 * x + 8]) for line in part) / max(len(part), 1) / 8 for x in range(8)]
    mean, middle = sum(padded) / len(padded), sum(cells) / 64
    deviation = (max(sum(b * b for b in padded) / len(padded) - mean * mean, 0)) ** 0.5
    bits = int("".join("1" if c > middle else "0" for c in cells), 2)
    return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), f"{len(lines)}:{mean:.4f}:{deviation:.4f}:{bits:016x}"


def test_media_query_matches_brute_force(spark, base, monkeypatch):
    monkeypatch.setattr(media, "HOT_ROWS", 2)
    docs = spark.read.parquet(f"{base}/documents.parquet").limit(120).unionByName(spark.createDataFrame([(9000 + i, "hot", None, None, 1) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")).repartition(4)
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    rows = texts_of(docs)
    assert set(got) == {i for i, _ in rows}
    for i, text in rows:
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]) == brute_media(text)
        assert r["media_sha256"] == r["digest"] == hashlib.sha256(media.encode_png(media.payload((text or "").encode()))).hexdigest()
        assert r["media_bytes"] == len(media.encode_png(media.payload((text or "").encode())))
