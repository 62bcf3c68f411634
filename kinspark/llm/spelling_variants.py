"""Spelling variants: words one edit apart, found by two search schemes on FM-indexes of the vocabulary.

A word pair that differs by one inserted, deleted or replaced code point leaves one half of the searched word
untouched. So each word is searched twice: its first half is matched exactly and the match grows to the right
across the second half with one error, and its second half is matched exactly and the match grows to the left.
Both searches run on suffix-rank intervals over the delimited vocabulary ("|word|word|"): the second one on the
index of the text, the first one on the index of the reversed text. Each scheme starts at a delimiter and grows
one way only, so the two intervals of a state need not be kept in step.

The vocabulary is dealt to shards, once by the first code points and once by the last ones: a word of length M is
indexed under its (M-1) div 2 outer code points, which every word one edit away shares on one side at least, and
is searched under the one or two lengths of its possible partners. A key of more words than fit a shard is split
into a square of parts, each part of its index words meeting each part of its searched words. A shard returns one
row per searched word, never pairs. A task holds one shard's index and streams the words searched in it.

Null texts have no words; a null doc_id counts as an empty string; repeated rows count again; a word without a near
word has n_near 0 and is its own root; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import documents, partitions_for
from kinspark.sources.stage import Stage

LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH = 7  # code points of a word; the shard keys need 3 at least
MIN_COUNT = 2
DELETE_EVERY = 31
FACTOR = 10  # how much more frequent the form of a word is
SHARD_WORDS = 20_000
HOT_KEYS = 10_000  # bound of the broadcast list of keys that are split
FEW = 16  # intervals of up to so many rows are followed row by row

NEAR = "word string, n_near long, best_n long, best string"
END, DELIMITER, FIRST = 0, 1, 2  # symbols of the indexed text; letters start at FIRST


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts, a code point deleted from some of them by the checksum rule."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"{LETTERS}{{{MIN_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("w"))
    rows = rows.withColumn("w", F.translate("w", string.ascii_uppercase, string.ascii_lowercase))
    rows = rows.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "w")))
    at = (F.col("h") % F.length("w")).cast("int")
    shorter = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    word = F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("w"))
    words = rows.select(word.alias("word")).filter(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of the suffixes in order, by prefix doubling. The text ends with its only 0."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    width = 62 // bits  # so many symbols fit the first key
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << bits) | padded[k : k + n]
    rank = np.empty(n, np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[:-width] = rank[width:] + 1
        key = rank * (n + 1) + later
        width *= 2


class Index:
    """FM-index of the words in one reading direction; a match grows by the symbol before it.

    A state is an interval [low, high) of suffix ranks: all suffixes that start with the match so far.
    """

    def __init__(self, words: list[str], counts: np.ndarray, backwards: bool):
        self.words, self.counts = words, counts
        self.order = np.empty(len(words), np.int64)  # rank of a word in code-point order
        self.order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        points, self.lengths = code_points([w[::-1] for w in words] if backwards else words)
        self.letters, codes = np.unique(points, return_inverse=True)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths  # of the words in the text
        self.text = np.full(len(points) + len(words) + 2, DELIMITER, np.int64)
        self.text[-1] = END
        self.text[spread(self.starts, self.lengths)] = codes + FIRST
        suffixes = suffix_array(self.text)
        before = self.text[suffixes - 1]
        size = len(self.text)
        by_symbol = np.argsort(before, kind="stable")
        self.size, self.before, self.suffixes = size, before, suffixes
        self.ranked = before[by_symbol] * size + by_symbol
        self.next = np.empty(size, np.int64)
        self.next[by_symbol] = np.arange(size)

    def encode(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; one past the last letter for those the text has not."""
        at = np.searchsorted(self.letters, points)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == points
        return np.where(known, at + FIRST, len(self.letters) + FIRST)

    def grow(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after putting a symbol before each match; empty ones where it never is there."""
        new_low = np.zeros(len(low), np.int64)
        new_high = np.zeros(len(low), np.int64)
        one = high - low == 1
        fits = one & (self.before[np.minimum(low, self.size - 1)] == symbol)
        new_low[fits] = self.next[low[fits]]
        new_high[fits] = new_low[fits] + 1
        more = ~one
        base = symbol[more] * self.size
        new_low[more] = np.searchsorted(self.ranked, base + low[more])
        new_high[more] = np.searchsorted(self.ranked, base + high[more])
        return new_low, new_high

    def grow_by_any(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """(state, symbol, low, high) for every letter before a match; short intervals give single rows."""
        size = high - low
        few = np.flatnonzero(size <= FEW)
        state = np.repeat(few, size[few])
        row = spread(low[few], size[few])
        parts = [(state, self.before[row], self.next[row], self.next[row] + 1)]
        many = np.flatnonzero(size > FEW)
        if len(many):
            symbols = np.arange(FIRST, FIRST + len(self.letters))
            state, symbol = np.repeat(many, len(symbols)), np.tile(symbols, len(many))
            parts.append((state, symbol, *self.grow(low[state], high[state], symbol)))
        state, symbol, low, high = (np.concatenate(column) for column in zip(*parts))
        real = (symbol >= FIRST) & (high > low)
        return state[real], symbol[real], low[real], high[real]

    def near(self, feed: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of feed, word) pairs one edit apart, the edit behind the first ``exact`` symbols.

        ``feed`` holds the searched words, all of one length, in the order in which their symbols are matched. Of
        equal edits only one is followed: an insertion behind the equal letter, a deletion of a run's last letter.
        """
        count, length = feed.shape
        who = np.arange(count)
        low = np.full(count, np.searchsorted(self.ranked, DELIMITER * self.size))
        high = np.full(count, np.searchsorted(self.ranked, FIRST * self.size))
        for i in range(exact):
            low, high = self.grow(low, high, feed[who, i])
            who, low, high = (column[high > low] for column in (who, low, high))
        edited = [np.empty(0, np.int64)] * 3
        for i in range(exact, length + 1):
            symbol = feed[who, i] if i < length else np.full(len(who), DELIMITER)
            state, other, below, above = self.grow_by_any(low, high)
            differs = other != symbol[state]
            changed = (who[state][differs], below[differs], above[differs])
            edited = [np.concatenate(pair) for pair in zip(edited, changed)]  # inserted before this symbol
            wanted = feed[edited[0], i] if i < length else np.full(len(edited[0]), DELIMITER)
            after = self.grow(edited[1], edited[2], wanted)
            edited = [column[after[1] > after[0]] for column in (edited[0], *after)]
            if i == length:
                break
            last = symbol != feed[who, i + 1] if i + 1 < length else np.ones(len(who), bool)
            skipped = (who[last], low[last], high[last])
            edited = [np.concatenate(parts) for parts in zip(edited, changed, skipped)]
            low, high = self.grow(low, high, symbol)
            who, low, high = (column[high > low] for column in (who, low, high))
        place = self.suffixes[spread(edited[1], edited[2] - edited[1])] + 1
        return np.repeat(edited[0], edited[2] - edited[1]), np.searchsorted(self.starts, place)

    def begins(self, word: np.ndarray, feed: np.ndarray) -> np.ndarray:
        """Whether the words begin with the rows of feed."""
        same = np.ones(len(word), bool)
        for k in range(feed.shape[1]):
            place = np.minimum(self.starts[word] + k, self.size - 1)
            same &= self.text[place] == feed[:, k]
        return same


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words in one array, and the words' lengths."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return points, np.array([len(w) for w in words], np.int64)


def near_rows(index: Index, words: list[str], by_start: bool) -> Iterator[tuple[str, int, int, str]]:
    """word, n_near, best_n, best of the searched words that have a near word in the index.

    ``by_start``: the first half is exact; otherwise the second half is, and words found by the first one
    (they begin with it) are left out.
    """
    by_length: dict[int, list[str]] = {}
    for word in words:
        by_length.setdefault(len(word), []).append(word)
    for length, group in by_length.items():
        half = length // 2
        natural = index.encode(code_points(group)[0]).reshape(len(group), length)
        feed, exact = (natural, half) if by_start else (natural[:, ::-1], length - half)
        who, found = index.near(feed, exact)
        if not by_start:
            new = ~index.begins(found, natural[who, :half])
            who, found = who[new], found[new]
        rank = np.lexsort((index.order[found], -index.counts[found], who))
        who, found = who[rank], found[rank]
        firsts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])[: len(who)])
        for first, last in zip(firsts, [*firsts[1:], len(who)]):
            best = found[first]
            yield group[who[first]], int(last - first), int(index.counts[best]), index.words[best]


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, searched, by_start, word, n) in that order: a shard's index words, then the words to search."""
    words: list[str] = []
    counts: list[int] = []
    index = now = None
    for batch in batches:
        shard, searched, by_start = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        kind = shard * 2 + searched
        edges = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]])
        found: list[tuple] = []
        for a, b in zip(edges[:-1], edges[1:]):
            if shard[a] != now:
                words, counts, index, now = [], [], None, shard[a]
            part = batch.column(3).slice(a, b - a).to_pylist()
            if not searched[a]:
                words += part
                counts += batch.column(4).slice(a, b - a).to_pylist()
            elif words:
                if index is None:
                    index = Index(words, np.array(counts, np.int64), backwards=bool(by_start[a]))
                for at in range(0, len(part), 4096):
                    found += near_rows(index, part[at : at + 4096], bool(by_start[a]))
        if found:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            arrays = [pa.array(column, type=kind) for column, kind in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "n_near", "best_n", "best"])


def _outer(by_start: bool, size: Column) -> Column:
    return F.substring("word", F.lit(1), size) if by_start else F.substring("word", -size, size)


def _halves(length: Column) -> tuple[Column, Column]:
    """Key lengths of the words one edit away; equal ones are made distinct later."""
    least = F.lit((MIN_LENGTH - 1) // 2)
    return F.greatest(F.floor((length - 2) / 2), least).cast("int"), F.floor(length / 2).cast("int")


def dealt(words: DataFrame, total: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """shard, searched, by_start, word, n: index words and words to search, by the keys they share."""
    most = max(shard_words, -(-total // HOT_KEYS))
    shards = partitions_for(2 * total, shard_words)
    length = F.length("word")
    sides = []
    for by_start in (True, False):
        own = _outer(by_start, F.floor((length - 1) / 2).cast("int"))
        own_rows = words.select("word", "n", F.lit(by_start).alias("by_start"), F.lit(False).alias("searched"), own.alias("key"))
        keys = F.array_distinct(F.array(*(_outer(by_start, size) for size in _halves(length))))
        asked = words.select("word", "n", F.lit(by_start).alias("by_start"), F.lit(True).alias("searched"), F.explode(keys).alias("key"))
        sides += [own_rows, asked]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
    # At most HOT_KEYS keys of a side can have more than this number of words.
    sizes = rows.filter(~F.col("searched")).groupBy("by_start", "key").agg(F.count(F.lit(1)).alias("held"))
    hot = sizes.filter(F.col("held") > most).select("by_start", "key", F.ceil(F.col("held") / most).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(hot), ["by_start", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    mine = F.when(F.col("searched"), F.col("other")).otherwise(F.col("own"))
    yours = F.when(F.col("searched"), F.col("own")).otherwise(F.col("other"))
    shard = F.pmod(F.xxhash64("by_start", "key", mine, yours), F.lit(shards)).cast("int")
    shard = F.when(F.col("by_start"), shard).otherwise(shard + shards)
    return rows.select(shard.alias("shard"), "searched", "by_start", "word", "n")


def near_words(words: DataFrame, total: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n_near, best_n, best: the near words of each word that has any, and the most frequent of them."""
    rows = dealt(words, total, shard_words)
    partitions = partitions_for(3 * total, shard_words)
    # Keys and parts of a word that fall into one shard are one search there.
    rows = rows.repartition(partitions, "shard").distinct().sortWithinPartitions("shard", "searched")
    found = rows.mapInArrow(search, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, most: int, stage: Stage) -> DataFrame:
    """word, root of (word, form): the last of its forms. Counts grow by FACTOR a step, which bounds the steps."""
    depth, reach = 0, MIN_COUNT
    while reach * FACTOR <= most:
        depth, reach = depth + 1, reach * FACTOR
    ends = forms.select("word", F.col("form").alias("root"))
    steps = 1
    while steps < depth:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        ends = stage.save("roots", ends)
        steps *= 2
    return ends


def variants(words: DataFrame, stage: Stage, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a stored table (word, n) of distinct words of MIN_LENGTH or more."""
    size = words.agg(F.count(F.lit(1)).alias("total"), F.max("n").alias("most")).first()
    near = near_words(words, size["total"], shard_words)
    chosen = F.col("best_n") >= FACTOR * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word",
        F.when(chosen, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best_n")).alias("form_n"),
    )
    rows = stage.save("forms", rows)
    ends = roots(rows.filter(F.col("form").isNotNull()), size["most"] or 0, stage)
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The variants of all words of the documents."""
    stage = Stage(docs.sparkSession)
    return variants(stage.save("words", vocabulary(docs)), stage, shard_words)


def query(spark, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")
