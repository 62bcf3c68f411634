"""Every operator against a plain version of its rule, on small tables with nulls, ties and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinspark.llm import (
    best_fit_packing,
    language_id,
    ngram_jaccard,
    quality_classifier,
    quality_rules,
    source_mixing,
    substring_dedup,
    suffix_dedup,
    top_k_search,
    warc,
)
from kinspark.llm.shingles import Words
from kinspark.sources.stage import Stage
from tests.llm.conftest import documents, words_of


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


# 1 -----------------------------------------------------------------------------------------------


def test_shared_passages_are_found(docs):
    found = substring_dedup.repeats(docs).collect()
    holders = {r[0] for r in documents() if r[1] and "\n" in r[1] and r[0] not in (6,)}
    assert holders - {r.doc_id for r in found} <= {min(h for h in holders)}
    texts = {r[0]: words_of(lower(r[1])) for r in documents()}
    for r in found:
        own = texts[r.doc_id][r.start : r.end]
        other = texts[r.first_doc_id][r.first_start : r.first_end]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (own, other))
        assert len(own) >= 50 and len(a & b) >= 0.8 * len(a | b) and r.first_doc_id < (r.doc_id or 10**9)


def test_cutting_keeps_rows_columns_and_clean_texts(docs):
    out = substring_dedup.cut(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    left = {r.doc_id: r for r in out.collect()}
    assert left[0].text == documents()[0][1] and left[4].text is None
    assert all(r.n_chars == len(r.text) for r in left.values() if r.text is not None)
    # What is left of the shared passage is one copy.
    passage = documents()[3][1].split("\n")[1].split("\t")[0].split(" ")[20:50]
    assert sum(" ".join(passage) in (r.text or "") for r in left.values()) == 1


def test_windows_that_the_heads_refuse_meet_the_others(spark):
    r = random.Random(3)
    word = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    data = []
    for _ in range(60):  # the first has a quote only, the others the passage around it
        quote = word(40)
        passage = word(10) + quote + word(10)
        for own in (quote, passage, passage):
            data.append((len(data), " ".join(word(100) + own + word(100))))
    found = substring_dedup.repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    texts = [words_of(text) for _, text in data]
    sets = [[{tuple(w[i + k : i + k + 5]) for k in range(56)} for i in range(len(w) - 59)] for w in texts]
    expected = set()  # by brute force, over all stretches of 60 words
    for b in range(len(data)):
        for a in range(b // 3 * 3, b):
            common = [(i, j) for i, x in enumerate(sets[a]) for j, y in enumerate(sets[b]) if len(x & y) >= 50]
            if any(len(sets[a][i] & sets[b][j]) >= 0.8 * len(sets[a][i] | sets[b][j]) for i, j in common):
                expected.add((b, a))
    assert len(expected) == 60 and {(r.doc_id, r.first_doc_id) for r in found} == expected


def test_shingles_of_asked_windows_are_not_stored(spark, monkeypatch):
    """Windows get their shingles where the text is read: they pass through one shuffle and no table."""
    r, written, write = random.Random(5), [], Stage.write
    monkeypatch.setattr(Stage, "write", lambda self, name, *a, **k: (written.append(name), write(self, name, *a, **k))[1])
    word = lambda n: [str(r.randrange(10**6)) for _ in range(n)]
    quote = word(25)
    rows = [(i, " ".join(word(40) + quote + word(60))) for i in range(6)]
    substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    asked = written[written.index("members") : written.index("second")]
    assert "links" in asked and asked.index("links") < asked.index("near")
    assert "tokens" not in asked[: asked.index("links")]


def test_windows_are_dealt_with_their_shingles(spark):
    words = [f"w{i}" for i in range(40)]
    window = "struct<sig: bigint, block: int, blocks: int, asks: boolean, f: int, first: string, c: int, l: int, r: int>"
    data = [(7, " ".join(words), [(1, 1, 3, True, 0, "a", 9, 4, 12), (2, 0, 1, False, 1, None, 0, 0, 35)]), (8, "a b", [])]
    texts = spark.createDataFrame(data, f"key long, text string, wanted array<{window}>")
    shingles = Words(pa.array([" ".join(words)]), lower=True).shingles(substring_dedup.SHINGLE)[0] >> np.uint64(32)
    got = {(x.sig, x.i, x.j): x for x in substring_dedup.dealt(texts).collect()}
    assert set(got) == {(1, 0, 1), (1, 1, 1), (1, 1, 2), (2, 0, 0)}
    assert all(np.frombuffer(x.tokens, "<u4").tolist() == shingles[x.l : x.r + 1].tolist() for x in got.values())
    assert {(x.key, x.first, x.asks, x.block) for x in got.values()} == {(7, "a", True, 1), (7, None, False, 0)}


def test_blocks_of_a_signature_meet(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 3)
    monkeypatch.setattr(substring_dedup, "COLUMNS", 16)
    r = random.Random(4)
    word = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    line, passages = word(40), [(word(10), word(10)) for _ in range(12)]
    data = [(i, " ".join(word(100) + line + word(100))) for i in range(5)]
    data += [(5 + i, " ".join(word(100) + a + line + b + word(100))) for i, (a, b) in enumerate(passages * 2)]
    found = substring_dedup.repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == {(17 + i, 5 + i) for i in range(12)}


def test_recall_of_short_passages_with_an_edit(spark):
    r = random.Random(7)
    word = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    data = []
    for _ in range(400):  # 41 of 51 shingles in common
        passage, other = word(50), word(1)
        at = r.randrange(5, 45)
        for own in (passage, passage[:at] + other + passage[at + 1 :]):
            data.append((len(data), " ".join(word(60) + own + word(60))))
    found = substring_dedup.repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    pairs = {(row.doc_id, row.first_doc_id) for row in found}
    print(f"recall {len(pairs)} of 400")
    assert pairs <= {(i + 1, i) for i in range(0, 800, 2)} and len(pairs) >= 396


def test_stretches_with_scattered_other_sides():
    r = np.random.default_rng(5)
    p, q, *noise = (r.integers(0, 1 << 32, n, dtype=np.uint32) for n in (96, 96, 4, 1000, 30, 30))
    own = np.r_[noise[2], p, noise[0], q, noise[3]]
    for other in (np.r_[p, noise[1], q], np.r_[q, noise[1], p]):
        found = substring_dedup.similar_stretches(own, other, 46, 0.8)
        assert [x[:2] for x in found] == [(30, 126), (130, 226)] and all(x[4] == 1 for x in found)
    # A passage and quotes from elsewhere in the other text; a passage whose first words the other text also quotes.
    for other in (np.r_[p, noise[1], q[50:60], noise[2], q[:45]], np.r_[p[:20], noise[1], p]):
        found = substring_dedup.similar_stretches(own, other, 46, 0.8)
        assert any(x[0] <= 30 and x[1] >= 126 and x[4] >= 0.8 for x in found)
    assert [x[:2] for x in found] == [(30, 126)]
    # The widest overlap of intervals with equal shifts, and a text that repeats itself.
    assert [x[:4] for x in substring_dedup.similar_stretches(own, own, 46, 0.8)] == [(0, 256, 0, 256)]
    same = np.zeros(200, dtype=np.uint32)
    assert substring_dedup.similar_stretches(same, same[:60], 46, 0.8)[0][:2] == (0, 200)


def test_passages_that_are_adjacent_in_one_text_only(spark):
    r = random.Random(6)
    word = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    data, passages = [], []
    for _ in range(20):
        p, q = word(100), word(100)
        passages.append((p, q))
        data.append((len(data), " ".join(p + word(1000) + q)))
        data.append((len(data), " ".join(word(100) + p + q + word(100))))
    cut = substring_dedup.cut(spark.createDataFrame(data, "doc_id long, text string")).collect()
    left = {row.doc_id: words_of(row.text) for row in cut}
    for i, (p, q) in enumerate(passages):
        assert len(left[2 * i]) == 1200 and not {*p, *q} & {*left[2 * i + 1]}


def test_compact_windows_are_those_of_the_tree():
    values = np.random.default_rng(3).permutation(500).astype(np.uint64) << np.uint64(40)
    got = substring_dedup.compact_windows(values, 20)
    expected = []
    for c, v in enumerate(values):
        low = max((i for i in range(c) if values[i] < v), default=-1) + 1
        high = min((i for i in range(c + 1, 500) if values[i] < v), default=500) - 1
        if high - low + 1 >= 20:
            expected.append((c, low, high))
    assert got == expected


# 2 -----------------------------------------------------------------------------------------------


def plain_targets(sizes):
    """source -> target: excess over three times the size is reshared by weight until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        target = {s: left * weight[s] / share for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix_meets_its_targets(docs):
    out = source_mixing.mix(docs).collect()
    assert len(out) == docs.count()
    sizes = Counter()
    for r in documents():
        sizes[r[3]] += len(words_of(r[1]))
    targets, taken = plain_targets(sizes), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.03 * targets[s] + 5
    again = source_mixing.mix(docs.repartition(5))
    columns = ["doc_id", "size", "taken"]
    assert rows(again.select(columns)) == rows(source_mixing.mix(docs).select(columns))


def test_mixed_documents_hold_the_words_taken(docs):
    taken = sum(r.taken for r in source_mixing.mix(docs).collect())
    out = source_mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sum(len(words_of(r.text)) for r in out.collect()) == taken


def test_mixed_texts_are_dealt_out_once(spark, docs):
    def dealt(node):
        own = node.nodeName() == "Exchange" and " text#" in " " + node.output().mkString(" ")
        return own + sum(dealt(node.children().apply(i)) for i in range(node.children().size()))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert dealt(source_mixing.mixed(docs)._jdf.queryExecution().executedPlan()) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_targets_of_small_sources(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, " ".join("w" * 3000), "y"), (3, None, "z")], "doc_id long, text string, source string")
    got = {r.source: r.target for r in source_mixing.mix(df).collect()}
    assert got == {"x": 6.0, "y": pytest.approx(2996.0), "z": 0.0}


# 3 -----------------------------------------------------------------------------------------------


def plain_cut(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = [True] * length
        kept = bytes(c for c, m in zip(t, mark) if not m)
        spans = sum(m and not p for m, p in zip(mark, [False, *mark]))
        out.append((len(t), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_substrings_go(docs):
    texts = [(r[1] or "").encode() for r in documents()]
    expected = sorted(((r[0], *x) for r, x in zip(documents(), plain_cut(texts, 400))), key=str)
    assert rows(suffix_dedup.dedup(docs)) == expected


def cancelling():
    """Two printable strings of 163 bytes that have one polynomial hash modulo 2^64, whatever its odd base."""
    product = np.array([1])
    for power, times in ((32, 2), (16, 4), (8, 3), (4, 2), (2, 1)):
        for _ in range(times):
            product = np.convolve(product, [-1, *[0] * (power - 1), 1])
    return tuple("".join(chr(70 + max(int(c) * sign, 0)) for c in product) for sign in (1, -1))


def test_strings_that_cancel_out_are_told_apart(spark):
    a, b = cancelling()
    base = 0x9E3779B97F4A7C15
    sums = {sum((ord(c) + 1) * pow(base, i, 1 << 64) for i, c in enumerate(x)) % (1 << 64) for x in (a, b)}
    assert a != b and len(sums) == 1 and a.isprintable() and b.isprintable()
    r = random.Random(9)
    left, right = ("".join(r.choice("abcdefgh") for _ in range(330)) for _ in range(2))
    thue = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    texts = [left + a + right, left + b + right, thue, thue.translate({97: 98, 98: 97}), thue[:1500] + "c" + thue[1500:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.dedup(df).collect()}
    assert got[0].n_removed == got[1].n_removed == 0
    expected = plain_cut([t.encode() for t in texts], 400)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == expected


def test_hashes_of_substrings():
    data = "".join(random.Random(3).choice("ab") for _ in range(700)).encode() * 2
    content = suffix_dedup.Content(data)
    r = random.Random(4)
    ranges = [(s, r.randint(s, 700)) for s in (r.randrange(700) for _ in range(2000))]
    start, end = (np.array([x[i] for x in ranges]) for i in range(2))
    hashes = content.hash(start, end).tolist()
    assert content.hash(start + 700, end + 700).tolist() == hashes
    by_text = defaultdict(set)
    for (s, e), h in zip(ranges, hashes):
        by_text[data[s:e]].add(h)
    assert all(len(x) == 1 for x in by_text.values()) and len({h for x in by_text.values() for h in x}) == len(by_text)


def test_words_that_cancel_out_do_not_link(spark):
    a, b = cancelling()
    rows = [(1, f"{a} b c"), (2, f"{b} b c"), (3, f"{a} b c"), (4, "y" * 300), (5, "y" * 301)]
    found = ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_periodic_and_self_repeating_texts(spark):
    texts = ["ab" * 500, "x" * 401, "x" * 400, "".join(map(str, range(400))), "".join(map(str, range(150, 400))), "é" * 300 + "q" + "é" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = sorted(((i, *x) for i, x in enumerate(plain_cut([t.encode() for t in texts], 400))), key=str)
    assert rows(suffix_dedup.dedup(df)) == expected


# 4 -----------------------------------------------------------------------------------------------


def test_best_scores(spark):
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in r.normal(0, 1, 8).round(1)]) for i in range(90)]
    bad = [(20, None), (40, [1.0, None]), (60, [float("nan")] * 8), (80, [float("inf")] * 8), (None, [0.0] * 8)]
    vectors += [(3, [0.0]), (5, vectors[5][1])]
    df = spark.createDataFrame(bad + vectors, "vec_id long, embedding array<double>")
    got = rows(top_k_search.search(df))
    quant = [(i, [math.floor(64 * x) for x in v] + [0] * (8 - len(v))) for i, v in vectors]
    expected = []
    for q, (i, v) in enumerate(quant):
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for k, (j, w) in enumerate(quant) if k != q)
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:20])]
    assert got == sorted(expected, key=str)


def test_vectors_are_not_broadcast(spark):
    """The queries are as many times as large once dealt out to all blocks; Spark would still take them for small."""
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in r.normal(0, 1, 4)]) for i in range(50)], "vec_id long, embedding array<double>")
    plan = top_k_search.search(df)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("most", [0, 127, 128, 2**15, 2**31, 2**63 - 1])
def test_packed_numbers(most):
    values = np.array([0, most, -most], dtype=np.int64)
    assert top_k_search.numbers(top_k_search.packed(values)).tolist() == values.tolist()
    assert len(top_k_search.packed(values)) == 1 + 3 * (1 if most < 128 else 2 if most < 2**15 else 4 if most < 2**31 else 8)


def test_blocks_of_few_rows(spark, monkeypatch):
    """Entries of several blocks, of one query in several groups and of scores below zero."""
    monkeypatch.setattr(top_k_search, "BLOCK_ROWS", 16)
    r = np.random.default_rng(4)
    for scale, shift in ((1, 0), (1, -2), (2**24, 0), (2**50, 0)):
        vectors = [(i, [float(x) for x in scale * (r.normal(shift, 1, 5) * [1, 1, 1, -1, 2]).round(1)]) for i in range(75)]
        got = rows(top_k_search.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), k=3, query_step=4))
        quant = [[math.floor(64 * x) for x in v] for _, v in vectors]
        expected = []
        for q in range(0, 75, 4):
            total = {j: sum(a * b for a, b in zip(quant[q], quant[j])) for j in range(75) if j != q}
            total = {j: min(max(x, -(2**63)), 2**63 - 1) for j, x in total.items()}
            best = sorted((-x, j) for j, x in total.items())
            expected += [(q, n + 1, j, -x) for n, (x, j) in enumerate(best[:3])]
        assert got == sorted(expected, key=str)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert rows(top_k_search.search(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema))) == [(0, 1, 1, 64 * 128)]
    assert rows(top_k_search.search(spark.createDataFrame([], schema))) == []
    assert rows(top_k_search.search(spark.createDataFrame([(0, None)], schema))) == []


# 5 -----------------------------------------------------------------------------------------------


def test_languages(spark):
    en, de = "the cat and the dog of that house ", "der hund und die katze von diesem haus "
    data = [(i, (en, de)[i % 2] * (1 + i % 5), ("en", "de")[i % 2]) for i in range(60)]
    odd = [(100, None, "en"), (101, " 12 !", "de"), (None, en, None), (103, de * 4000, None)]
    df = spark.createDataFrame(data + odd, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.identify(df, language_id.dictionaries(df)).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in data)
    assert (out[100].lang_pred, out[101].lang_pred) == ("und", "und") and out[103].lang_pred == "de"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items() if i is not None)
    assert all(0 <= r.score <= 1 for r in out.values())


@pytest.mark.parametrize("text", ["½ 12 ²", "① Ⅷ ٣", "_ . !", "", None])
def test_texts_without_a_letter(text):
    classifier = language_id.Classifier({"en": b"the cat and the dog", "de": b"der hund und die katze"})
    assert classifier.predict(text) == ("und", 0.0)
    assert classifier.predict("ª the dog")[0] == "en" and classifier.predict("日")[0] in ("en", "de")


def test_nothing_to_learn_from(spark, none):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(df, language_id.dictionaries(df)).first().lang_pred == "und"
    assert language_id.identify(none, language_id.dictionaries(none)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs, language_id.dictionaries(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    assert held.filter("lang = lang_pred").count() >= 0.95 * held.count()


# 6 -----------------------------------------------------------------------------------------------


def shingle_sets(size):
    sets = []
    for r in documents():
        w = words_of(lower(r[1]))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    return sets


def plain_groups(sets, percent):
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_sets_tell_hashes_apart_that_share_40_bits():
    hashes = np.array([5 << 24, (5 << 24) + 1, 1 << 63], dtype=np.uint64)
    assert ngram_jaccard.read(ngram_jaccard.written(hashes)).tolist() == hashes.tolist()


def test_neighbours_in_cut_lists(spark, monkeypatch):
    posts = spark.createDataFrame([(c, 10, 7) for c in range(40)] + [(c, 10, 8) for c in (3, 5)], "cls long, n long, token long")
    monkeypatch.setattr(ngram_jaccard, "STRETCH", 16)
    long = spark.createDataFrame([(7, 40)], "token long, length long")
    found = ngram_jaccard.neighbours(posts, long, 90).collect()
    met = Counter((r.u, r.v, r.k) for r in found if {r.u, r.v} == {3, 5})
    assert all(met[3, 5, k] + met[5, 3, k] >= 1 for k in range(ngram_jaccard.ORDERS))
    # A stretch is a chain: in each order every class but the first of each of the three has one before it.
    assert Counter(r.k for r in found) == {k: 37 + 1 for k in range(ngram_jaccard.ORDERS)}


def sketched(spark, sets, percent):
    hashes = np.concatenate([np.sort(s) for s in sets])
    bits = ngram_jaccard.parities(hashes, np.r_[0, np.cumsum([len(s) for s in sets])], percent).to_pylist()
    rows = [(i, (len(s), b)) for i, (s, b) in enumerate(zip(sets, bits))]
    return spark.createDataFrame(rows, "id long, x struct<n: long, bits: array<long>>")


@pytest.mark.parametrize("percent", [80, 90])
def test_sketches_tell_long_sets_apart(spark, percent):
    r = np.random.default_rng(5)
    near = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    near = [near, np.r_[near[: 4000 * percent // 100 + 200], r.integers(0, 1 << 63, 90, dtype=np.uint64)]]
    df = sketched(spark, near + [r.integers(0, 1 << 63, 4000 + i, dtype=np.uint64) for i in range(6)], percent)
    pairs = df.select("id", df.x.alias("a")).crossJoin(df.select(df.id.alias("other"), df.x.alias("b"))).filter("id < other")
    assert [(p.id, p.other) for p in pairs.filter(ngram_jaccard.possible("a", "b", percent)).collect()] == [(0, 1)]


def test_sketches_of_different_lengths_bound_the_difference(spark):
    r = np.random.default_rng(6)
    sets = [r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (3, 400, 900, 3000, 0)]
    sets += [np.r_[sets[2], sets[3][:700]], np.r_[sets[2], sets[1], sets[0]]]
    df = sketched(spark, sets, 50)
    assert len({len(row.x.bits) for row in df.collect()}) > 2
    pairs = df.select("id", df.x.alias("a")).crossJoin(df.select(df.id.alias("other"), df.x.alias("b")))
    for p in pairs.withColumn("least", ngram_jaccard.differ("a", "b")).collect():
        assert p.least <= len(set(sets[p.id].tolist()) ^ set(sets[p.other].tolist()))
        assert p.id != p.other or p.least == 0


def test_only_wanted_texts_are_dealt_out(spark):
    docs = spark.createDataFrame([(i, f"w{i} a b c") for i in range(50)], "doc_id long, text string")
    wanted = docs.filter("doc_id IN (3, 7)").select(F.struct("doc_id", ngram_jaccard.text_hash()).alias("one"))
    df = ngram_jaccard.whole_sets(docs, wanted, 3)
    assert len({r.cls for r in df.collect()}) == df.count() == 2
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2  # by the hash first, without a shuffle of the texts


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (2, 50)])
def test_links_and_groups(docs, size, percent):
    sets, ids = shingle_sets(size), [r[0] for r in documents()]
    group, least = plain_groups(sets, percent), {}
    for i, g in zip(ids, group):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    expected = [(i, len(s), least[g] if s else i) for i, s, g in zip(ids, sets, group)]
    assert rows(ngram_jaccard.join(docs, size, percent)) == sorted(expected, key=str)
    kept = ngram_jaccard.deduplicate(docs, size, percent)
    assert kept.columns == docs.columns
    assert kept.count() == len({g for g, s in zip(group, sets) if s}) + sum(not s for s in sets)


def variants(seed, count, edits):
    """Variants of one text; edits are often the same, and every ninth text is far from the others."""
    r = random.Random(seed)
    words = [f"w{r.randrange(500)}" for _ in range(120)]
    for i in range(count):
        own = list(words)
        for place in r.sample(range(40), r.randint(1, edits)):
            own[place] = r.choice("xyz")
        if i % 9 == 0:
            own[60:] = [f"v{r.randrange(500)}" for _ in range(60)]
        yield " ".join(own)


@pytest.mark.parametrize("size, percent, edits", [(3, 90, 6), (5, 80, 7)])
def test_variants_of_a_text_meet_by_their_deltas(spark, monkeypatch, size, percent, edits):
    texts = list(variants(5, 150, edits))
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in map(str.split, texts)]
    group = plain_groups(sets, percent)
    assert 10 < len(set(group)) < 140
    # Without the sketches, which only thin the pairs out after they have met.
    monkeypatch.setattr(ngram_jaccard, "possible", lambda a, b, percent: F.expr(ngram_jaccard.sizes(a, b, percent)))
    met, probed = [], ngram_jaccard.probed

    def counted(docs, named, pairs, *more):
        met.append(pairs.count())
        return probed(docs, named, pairs, *more)

    monkeypatch.setattr(ngram_jaccard, "probed", counted)
    found = ngram_jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size, percent)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: group.index(g) for i, g in enumerate(group)}
    assert met[1] <= 4 * len(texts)


# 7 -----------------------------------------------------------------------------------------------


def test_quality_of_labelled_documents(spark):
    good, bad = "a plain sentence about nothing much, {} times. ", "BUY!!! $$$ NOW {} "
    data = [(i, (good if i % 3 else bad).format(i) * 5, f"s{i % 7}", None) for i in range(400)]
    data += [(None, None, None, None), (5, data[5][1], "s5", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality_classifier.scored(df, labels).collect()
    assert len(out) == len(data)
    assert all(r.kept == (r.doc_id % 3 > 0) for r in out if r.doc_id is not None)


def plain_posteriors(rows):
    """(site_rate, path_rate, quality) of rows (site, path, p), level by level."""
    mean = sum(p for *_, p in rows) / len(rows)
    sites, paths = defaultdict(list), defaultdict(list)
    for site, path, p in rows:
        sites[site].append(p)
        paths[site, path].append(p)

    def weight(groups, prior):
        n = sum(map(len, groups.values()))
        if len(groups) < 2:
            return 100.0
        rate = {key: sum(own) / len(own) for key, own in groups.items()}
        within = sum(len(own) * rate[key] * (1 - rate[key]) for key, own in groups.items()) / n
        between = sum(len(own) * (rate[key] - prior(key)) ** 2 for key, own in groups.items())
        variance = (between - len(groups) * within) / n
        return min(1e6, max(1.0, within / variance)) if variance > 0 else 1e6

    def logit(p):
        p = min(max(p, 1e-3), 1 - 1e-3)
        return math.log(p / (1 - p))

    k = weight(sites, lambda key: mean)
    site_rate = {site: (sum(own) + k * mean) / (len(own) + k) for site, own in sites.items()}
    k = weight(paths, lambda key: site_rate[key[0]])
    out = []
    for site, path, p in rows:
        own = paths[site, path]
        others = (sum(own) - p + k * site_rate[site]) / (len(own) - 1 + k)  # the document itself is left out
        odds = logit(others) + logit(p) - logit(mean)
        out.append((site_rate[site], others, 1 / (1 + math.exp(-odds))))
    return out


def test_posteriors_of_sites_and_paths(spark):
    """Noisy texts on sites of very different sizes and rates, against the plain rule."""
    r = random.Random(8)
    good, bad = ["a plain sentence about nothing", "more words of this kind"], ["BUY!!! $$$ NOW", "win $$$ a word"]
    data = []
    for i in range(600):
        site = r.choice(["big"] * 12 + ["clean"] * 5 + ["spam"] * 5 + [None] * 2 + [f"small{r.randrange(12)}"])
        share = {"clean": 0.95, "spam": 0.1}.get(site, 0.6)
        kind = r.random() < share
        text = " ".join(r.choice(good if (kind if r.random() < 0.8 else not kind) else bad) for _ in range(r.randint(1, 6)))
        data.append((i, text, site, r.choice(["x", "y", None]), int(kind)))
    df = spark.createDataFrame([d[:4] for d in data], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(d[0], d[4]) for d in data if d[0] % 2], "doc_id long, quality int")
    out = {o.doc_id: o for o in quality_classifier.scored(df, labels).collect()}
    expected = plain_posteriors([(site, path, out[i].evidence) for i, _, site, path, _ in data])
    for (i, *_), (site_rate, path_rate, quality) in zip(data, expected):
        o = out[i]
        assert (o.site_rate, o.path_rate, o.quality) == pytest.approx((site_rate, path_rate, quality), abs=1e-9)
        assert o.kept == (o.quality >= 0.5)
    # A sparse site keeps close to the rate of all, a large one goes its own way.
    mean = sum(o.evidence for o in out.values()) / len(out)
    own = defaultdict(list)
    for i, _, site, _, _ in data:
        own[site].append(out[i].evidence)
    shrunk = {site: (out[next(d[0] for d in data if d[2] == site)].site_rate - mean) / (sum(p) / len(p) - mean) for site, p in own.items()}
    assert all(0 <= shrunk[site] < shrunk["spam"] for site, p in own.items() if len(p) < 6)
    # With the labels' sites, held-out documents are told apart better than by their texts alone.
    right = {name: sum((getattr(out[d[0]], name) >= 0.5) == d[4] for d in data if d[0] % 2 == 0) for name in ("evidence", "quality")}
    assert right["quality"] >= right["evidence"]


def test_quality_without_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.scored(docs, labels).filter("kept").count() == docs.count()
    assert quality_classifier.scored(none, labels).count() == 0


# 8 -----------------------------------------------------------------------------------------------


def check_packing(out, capacity):
    used = defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packed_documents(docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = best_fit_packing.packed(docs, capacity=64).collect()
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    expected, total = Counter(), 0
    for r in documents():
        ids = np.array(exact.encode(r[1] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        total += len(ids)
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)] if len(ids) > 64 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert got == expected
    assert check_packing(out, 64) <= math.ceil(total / 64) * 1.1


def test_special_token_in_a_text(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    row = best_fit_packing.pieces(df, keep_ids=True).first()
    assert 50256 in row.ids and row.ids[-1] == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    r = np.random.default_rng(seed)
    capacity = [10, 97, 2048][seed % 3]
    histogram = {int(n): int(r.integers(1, 50)) for n in r.integers(1, capacity + 1, 60)}
    placed, used = Counter(), Counter()
    for length, low, high, sequence, per, offset in best_fit_packing.plan(histogram, capacity):
        placed[length] += high - low
        for k in range((high - low) // per):
            used[sequence + k] += per * length
    assert placed == histogram and max(used.values()) <= capacity
    # Pairs of large pieces and best fit leave no more than a few percent over what is needed.
    large = sum(c for n, c in histogram.items() if 2 * n > capacity)
    assert len(used) <= 1.25 * max(large, sum(n * c for n, c in histogram.items()) / capacity) + 1


# 9 -----------------------------------------------------------------------------------------------


def plain_measures(text):
    words = words_of(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures(spark, docs):
    extra = [(900, "a b\na b\n\n  \na b c | # <x>", "en", "x", 1, "k", 1), (901, "q w e r t y " * 9, "en", "x", 1, "k", 1)]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = quality_rules.measured(df).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert len(out) == df.count()
    for r in out:
        got = tuple(r[n] for n in names)
        assert got == plain_measures(r.text)
        failed = got[0] < 10 or 100 * got[4] > 20 * got[0]
        assert r.base_failed == failed and (not failed or not r.kept)


def test_distances(spark):
    df = spark.createDataFrame([([1, 3], [0.5, 0.5]), ([0, 4], [1.0, 0.0]), ([0, 0], [0.5, 0.5])], "counts array<int>, shares array<double>")
    got = [r[0] for r in df.select(quality_rules.distance("counts", "shares")).collect()]
    m = [(0.25 + 0.5) / 2, (0.75 + 0.5) / 2]
    jsd = sum(p * math.log2(p / x) / 2 for p, x in zip((0.25, 0.75), m)) + sum(0.5 * math.log2(0.5 / x) / 2 for x in m)
    assert got[0] == pytest.approx(math.sqrt(jsd)) and got[1] == pytest.approx(1.0) and got[2] is None


def test_every_language_has_a_reference_and_null_has_none(spark):
    rng = np.random.default_rng(9)

    def text(letters):
        return " ".join("".join(rng.choice(list(letters), 6)) for _ in range(60))

    rows = [(i, text("abcdefghij" if i % 300 < 299 else "0123456789"), f"l{i % 300}") for i in range(1200)]
    rows += [(1203 + i, text("abcdefghij"), "l0") for i in range(40)]
    rows += [(1200, text("0123456789"), "l0"), (1201, text("0123456789"), None), (1202, text("abcdefghij"), "")]
    out = quality_rules.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows)
    # Digits are the rule in language 299, odd in language 0, and not judged without a language.
    assert {r.doc_id for r in out if not r.kept} == {1200}
    assert [r.class_distance for r in out if r.lang is None] == [None]


def test_rules_keep_the_columns(docs, none):
    assert quality_rules.keep(docs).columns == docs.columns
    assert quality_rules.keep(none).count() == 0


# 10 ----------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>", "", None, "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n" * 50, "<p>a</p>"]
    pages = [(10 - i, f"http://x/{i}\r\n", h, "clash") for i, h in enumerate(html)] + [(None, None, "<p>b</p>", "clash")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    out = rows(warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    first = {}
    for i, _, h, _ in pages:
        first[h or ""] = min((x for x in (first.get(h or ""), i) if x is not None), default=None)
    expected = []
    for i, _, h, _ in pages:
        data, f = (h or "").encode(), first[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((i, len(data), digest, *(("response", None) if i == f else ("revisit", f))))
    assert out == sorted(expected, key=str)
    short = warc.round_trip(df, min_payload=9).filter("record_type = 'revisit'")
    assert short.count() == 0


def test_sidecars_hold_the_index(spark, stage):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 3}</p>" * 40) for i in range(20)], "page_id long, url string, html string")
    raw, whole = stage.new_path("monolithic"), stage.new_path("members")
    manifest = stage.save("manifest", warc.write_archives(pages.repartition(3), raw, 0))
    index = stage.save("index", warc.normalise(manifest, raw, whole))
    beside = warc.read_sidecars(index.select("archive").distinct(), whole)
    assert beside.columns == index.columns and rows(beside) == rows(index) and index.count() == 20
    assert rows(warc.read_records(beside, whole)) == rows(warc.read_records(index, whole))


def test_gzip_streams_of_several_members():
    import gzip
    import io

    records = [warc.record(i, None, b"x" * i * 70_000, "d", None, False) for i in range(5)]
    data = gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:]))
    assert list(warc.records_of(warc.inflated(io.BytesIO(data)))) == records
    with pytest.raises(ValueError):
        list(warc.records_of([records[2][:-5]]))


def test_symbols_and_word_characters_take_no_pass_of_their_own(spark):
    """They come from what the character classes leave: one replacement for each of five classes, one for symbols."""
    df = spark.createDataFrame([(1, "é ä#< >\x0b|\x1c$ Zz9", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    out = quality_rules.measured(df)
    assert {(r.doc_id, r.word_chars, r.n_symbols) for r in out.collect()} == {(1, 11, 5), (2, 0, 0)}
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 6
