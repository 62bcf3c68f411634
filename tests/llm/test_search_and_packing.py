"""Spelling variants, ranked search and vector packing against plain versions of their rules."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinspark.llm import lexical_search, spelling_variants, vector_packing
from tests.llm.conftest import SCHEMA, documents

LOWER = {i: i + 32 for i in range(65, 91)}
CLASHING = "doc_id long, text string, word string, n long, shard int, key string, score long, item_id long, term string, ids string"


def clashing(rows):
    return [(i, t, "w", 1, 2, "k", 3, 4, "t", "i") for i, t in rows]


# 11 ----------------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def variant_rows(seed: int, count: int = 160):
    """Texts over few letters, so that words have many near ones, runs of equal letters and shared starts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abÀ") for _ in range(r.randint(6, 10))) for _ in range(60)]
    words += ["aaaaaaa" + "".join(r.choice("xyz") for _ in range(r.randint(0, 4))) for _ in range(60)]
    words += ["neighbour", "neighbor", "neigbour", "neigbor"] + ["Neighbour"] * 250
    rows = [(i if i % 17 else None, " ".join(r.choice(words) for _ in range(12))) for i in range(count)]
    long = "longword" * 500
    rows += [(900, None), (901, ""), (902, f"{long} {long}"), (903, f"{long}x 9{long}x"), rows[3], rows[3]]
    return rows + [(1000 + i, "éclairage-×÷ÿàaaaaa ÀAAAAAAA日本語" + "neighbours " * 3) for i in range(9)]


@pytest.mark.parametrize(("seed", "shard_words"), [(1, 20_000), (2, 7)])
def test_variants(spark, seed, shard_words):
    rows = variant_rows(seed)
    got = spelling_variants.grouped(spark.createDataFrame(clashing(rows), CLASHING), shard_words)
    got = [tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(plain_vocabulary(rows))


def test_chains_of_forms(spark, stage):
    counts = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20_000, "zzzzzzzz": 7}
    got = spelling_variants.variants(stage.save("w", spark.createDataFrame(list(counts.items()), "word string, n long")), stage)
    got = {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(counts) and ("aaaaaaaa", "aaaaaaab", "aaaabbbb", 2, 1, 20) in got


def test_no_variants(spark, none):
    assert spelling_variants.grouped(none).count() == 0
    assert spelling_variants.grouped(spark.createDataFrame([(1, "Abcdefgh"), (2, None)], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["", "a", "abab" * 30, "a" * 500, "mississippi"])
def test_suffix_array(text):
    symbols = np.array([ord(c) for c in text] + [0], np.int64)
    plain = sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
    assert spelling_variants.suffix_array(symbols).tolist() == plain


@pytest.mark.parametrize("few", [0, 1, 16])
def test_index_finds_each_near_word_once(few, monkeypatch):
    monkeypatch.setattr(spelling_variants, "FEW", few)
    r = random.Random(few)
    words = list({"".join(r.choice("ab") for _ in range(r.randint(7, 9))) for _ in range(150)})
    for by_start in (True, False):
        index = spelling_variants.Index(words, np.arange(len(words)), by_start)
        half = {w: w[: len(w) // 2] if by_start else w[len(w) // 2 :] for w in words}
        for word, n_near, best_n, best in spelling_variants.near_rows(index, words, by_start):
            near = [v for v in words if one_edit(word, v)]
            early = [v for v in near if v.startswith(word[: len(word) // 2])]
            kept = early if by_start else [v for v in near if v not in early and v.endswith(half[word])]
            assert (n_near, best_n) == (len(kept), max(map(words.index, kept))) and words[best_n] == best


# 12 ----------------------------------------------------------------------------------------------


def plain_search(rows, items, k=50):
    cut = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    docs = [(i, Counter(cut.findall((t or "").translate(LOWER)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    total, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(cut.findall((t or "").translate(LOWER)))
    found = set()
    for item, terms in asked.items():
        scored = []
        for doc_id, counts in docs:
            m = 50 + 50 * sum(counts.values()) * total // words
            score = 0
            for t in terms & counts.keys():
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id, score))
        ranked = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        found |= {(item, rank, s[2], s[3]) for rank, s in enumerate(ranked, 1)}
    return found


ITEMS = [(1, "ab cd Abc ÀÉ"), (2, None), (3, ""), (4, "zz zz 日本語 a"), (None, "one b"), (5, "nothing-like this"), (1, "ab EXTRA a")]


@pytest.mark.parametrize(("k", "segment_bytes", "block_items"), [(50, 8 << 20, 4096), (3, 2000, 2), (1, 1, 1)])
def test_search(spark, stage, k, segment_bytes, block_items):
    rows = [(r[0], r[1]) for r in documents(5, 90)] + [(500, "a " * 200_000), (501, "a b"), (502, "a b"), (7, "a b")]
    vocabulary = sorted({w for _, t in rows for w in (t or "").split()})
    r = random.Random(k)
    items = ITEMS + [(10 + i, " ".join(r.choice(vocabulary) for _ in range(15))) for i in range(6)] + [(20, rows[0][1])]
    index = lexical_search.build_index(spark.createDataFrame(clashing(rows), CLASHING).repartition(3), stage, segment_bytes)
    asked = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, rank int, term string")
    got = [tuple(r) for r in lexical_search.search(index, asked, stage, k, block_items).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_search(rows, items, k)


def test_search_of_nothing(spark, stage, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(none, stage), items, stage).count() == 0
    docs = spark.createDataFrame(documents(), SCHEMA)
    found = lexical_search.search(lexical_search.build_index(docs, stage), items.limit(0), stage)
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_strata_that_cannot_reach_the_list_are_not_visited():
    lists = lexical_search.Lists(1, 2)
    docs = [[b"x"] * 5 + [b"y"] * n for n in (0, 0, 0, 400, 900)]
    row = {k: v.to_pylist() if k == "terms" else np.asarray(v) for k, v in lexical_search.segment(list(range(5)), docs).items()}
    seen = []
    add = lists.add
    lists.add = lambda item, scores, ids: (seen.extend(ids.tolist()), add(item, scores, ids))
    lexical_search.visit(row, [np.array([0])], {b"x": 0}, np.array([100]), 5, sum(map(len, docs)), lists)
    assert sorted(lists.ids[0].tolist()) == [0, 1] and set(seen) <= {0, 1, 2}


# 13 ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path(vector_packing.VOCABULARY))


def check_packed(got, examples, limits):
    """Every id of every example is in one place; no sequence is above a limit; full ones but for powers of two."""
    by_sequence, by_example = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        by_example[r.doc_id].append(r)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        assert [r.segment for r in rows] == list(range(len(rows)))
        assert sum(r.length for r in rows) <= limits.tokens and len(rows) <= limits.segments
        assert sum(r.loss_tokens for r in rows) <= limits.loss_tokens
    expected = defaultdict(Counter)
    for key, ids in examples:
        expected[key][tuple(ids)] += 1
    for key, wanted in expected.items():
        rows = by_example.pop(key)
        assert sum(r.length for r in rows) == sum(len(ids) * n for ids, n in wanted.items())
        assert {r.doc_tokens for r in rows} == {len(ids) for ids in wanted}
        pieces = Counter((r.start, tuple(r.ids)) for r in rows)
        for ids, n in wanted.items():
            if len(wanted) == 1 and n == 1:
                assert tuple(i for _, part in sorted(pieces.elements()) for i in part) == ids
    assert not by_example
    return {s: sum(r.length for r in rows) for s, rows in by_sequence.items()}


def test_packed_documents(spark, exact):
    rows = [(r[0], r[1]) for r in documents(3, 80)]
    rows += [(600, "long words " * 30_000), (601, "<|endoftext|> spelt don't’s"), (602, "a\x85b\xa0c\x0bd ½ İΣ 日本"), (603, "x" * 5000)]
    docs = spark.createDataFrame(clashing(rows), CLASHING).repartition(2)
    got = vector_packing.packed(docs, keep_ids=True).collect()
    examples = [(i, [*exact.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    lengths = check_packed(got, examples, vector_packing.Limits())
    padding = sum(4096 - n for n in lengths.values() if n & (n - 1))
    assert padding < vector_packing.MIN_PIECE * len(lengths)
    assert all(r.loss_tokens == r.length for r in got)
    again = vector_packing.packed(docs, keep_ids=True).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("limits", [(64, 3, 64), (64, 100, 20), (128, 4, 40), (1, 1, 1), (7, 2, 3)])
@pytest.mark.parametrize("buffer_tokens", [50, 1 << 20])
def test_packed_instructions(spark, exact, limits, buffer_tokens):
    limits = vector_packing.Limits(*limits)
    r = random.Random(4)
    words = ["tell", "me", "why", "ok", "number", "9", "Été"]
    say = lambda most: " ".join(r.choice(words) for _ in range(r.randint(0, most)))
    rows = [(i, say(70), say(40)) for i in range(70)] + [(70, None, None), (71, None, "yes"), (72, "why " * 300, None)]
    df = spark.createDataFrame(rows, "doc_id int, question string, answer string").coalesce(1)
    got = vector_packing.packed(df, text="answer", prompt="question", limits=limits, keep_ids=True, buffer_tokens=buffer_tokens)
    ids = lambda t: exact.encode(t or "", add_special_tokens=False).ids
    prompts = {i: len(ids(q)) for i, q, _ in rows}
    got = got.collect()
    check_packed(got, [(i, [*ids(q), *ids(a), 2]) for i, q, a in rows], limits)
    for row in got:
        assert row.loss_tokens == sum(p >= prompts[row.doc_id] for p in range(row.start, row.start + row.length))


def test_whole_examples_are_kept_where_they_fit():
    ids = np.zeros(100, "<u4")
    pieces = [vector_packing.Piece(vector_packing.Example(i, ids[:n], 0), 0, n) for i, n in enumerate([60, 40] * 10)]
    full, rest = vector_packing.fill(pieces, vector_packing.Limits(100, 5, 100))
    assert not rest and sorted(sorted(p.length for p in s) for s in full) == [[40, 60]] * 10


def test_the_scarce_dimension_decides():
    ids = np.zeros(100, "<u4")
    made = [vector_packing.Example("loss", ids[:50], 0)] * 4 + [vector_packing.Example("prompt", ids[:50], 50)] * 4
    pieces = [vector_packing.Piece(e, 0, 50) for e in made]
    full, rest = vector_packing.fill(pieces, vector_packing.Limits(100, 5, 50))
    assert not rest and all({p.example.key for p in s} == {"loss", "prompt"} for s in full) and len(full) == 4


def test_tail_is_powers_of_two():
    ids = np.zeros(3000, "<u4")
    pieces = [vector_packing.Piece(vector_packing.Example(i, ids[:n], 0), 0, n) for i, n in enumerate([1700, 900, 61, 3])]
    sizes = [sum(p.length for p in s) for s in vector_packing.tail(pieces)]
    assert sum(sizes) == 2664 and all(n & (n - 1) == 0 for n in sizes) and len(set(sizes)) == len(sizes)


def test_limits_must_hold_something(none):
    assert vector_packing.packed(none).count() == 0
    with pytest.raises(ValueError):
        vector_packing.packed(none, limits=vector_packing.Limits(tokens=0))
