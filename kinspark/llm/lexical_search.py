"""Ranked lexical search over an index stratified by document length.

The index is a table of segments, a row each. A segment holds the documents of some megabytes of text, sorted by
length, and for each term its runs: documents of one length that hold the term equally often (tf). Once the
collection's counts are known, lengths of equal normaliser m are one stratum; they adjoin, so a term's runs are in
order of strata. A term's impact is computed once per run, from (m, tf). The largest impact of a term in a stratum bounds what
it can add there, and the sum over an item's terms bounds the stratum's scores. A segment's strata are visited from
the highest bound on, until the bound is under the score that the item's list ends with. A task keeps the
lists of the items from segment to segment; the lists of all tasks are merged by rank, in two levels.

Building needs no shuffle: a task makes segments of the rows it reads, of a bounded number of bytes each (or of one
document). Weights need the number of documents of the items' terms only. Items are taken in blocks of bounded
size, each block one pass over the index's postings.

Null texts have no terms. Items of one item_id are one item with the terms of all its rows; an item without
matching documents has no rows. Repeated rows are documents of their own, with equal scores; of equal scores the smallest
doc_id comes first and null (kept as the largest 64-bit number) last. Empty tables give no rows; further columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.common import documents, table
from kinspark.sources.stage import Stage

K = 50
SLOPE = 50  # per cent of a document's normaliser that its length makes
SEGMENT_BYTES = 4 << 20
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20  # an item longer than this is a block of its own
MERGE_GROUPS = 64

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII: in UTF-8, of these bytes.
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))

#: A segment's row. The packed columns are arrays of numbers in the least width that holds them (``pack``).
PACKED = ("runs", "run_length", "run_tf", "run_size", "postings")
SEGMENT = "doc_ids array<long>, lengths array<int>, terms array<binary>, held array<int>, " + ", ".join(f"{c} binary" for c in PACKED)
FOUND = "item int, doc_id long, score long"
NO_ID = (1 << 63) - 1


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def segment(doc_ids: list, terms: list[list[bytes]]) -> dict:
    """One row of the index, of documents that have terms. Documents are numbered by their length."""
    lengths = np.array([len(t) for t in terms], np.int64)
    by_length = np.argsort(lengths, kind="stable")
    flat = pa.array([t for i in by_length for t in terms[i]], pa.binary()).dictionary_encode()
    lengths = lengths[by_length]
    words = len(flat.dictionary)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    # Occurrences of a term in a document, then runs of documents by term, length and occurrences.
    pair, tf = np.unique(doc * words + flat.indices.to_numpy(), return_counts=True)
    doc, term = np.divmod(pair, words)
    order = np.lexsort((doc, tf, lengths[doc], term))
    doc, term, tf = doc[order], term[order], tf[order]
    length = lengths[doc]
    new = np.ones(len(doc), bool)
    new[1:] = (term[1:] != term[:-1]) | (length[1:] != length[:-1]) | (tf[1:] != tf[:-1])
    firsts = np.flatnonzero(new)
    return {
        "doc_ids": [NO_ID if doc_ids[i] is None else doc_ids[i] for i in by_length],
        "lengths": lengths,
        "terms": flat.dictionary,
        "held": np.bincount(term, minlength=words),
        "runs": np.bincount(term[firsts], minlength=words),
        "run_length": length[firsts],
        "run_tf": tf[firsts],
        "run_size": np.diff([*firsts, len(doc)]),
        "postings": doc,
    }


_ARROW = pa.schema(
    [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary()))]
    + [("held", pa.list_(pa.int32()))]
    + [(c, pa.binary()) for c in PACKED]
)


def pack(numbers: np.ndarray) -> bytes:
    """A byte that tells the width, then the numbers."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def unpack(packed: pa.BinaryScalar) -> np.ndarray:
    buffer = packed.as_buffer()
    return np.frombuffer(buffer, dtype=f"u{buffer[0]}", offset=1)


def build_index(docs: DataFrame, stage: Stage, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored table of segments of all documents that have terms."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, held = [], [], 0

        def row() -> pa.RecordBatch:
            made = segment(ids, terms)
            columns = [pa.array([pack(made[f.name]) if f.name in PACKED else made[f.name]], type=f.type) for f in _ARROW]
            return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                size = sum(map(len, found)) + len(found)
                if ids and held + size > segment_bytes:
                    yield row()
                    ids, terms, held = [], [], 0
                ids.append(doc_id.as_py())
                terms.append(found)
                held += size
        if ids:
            yield row()

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(segments, SEGMENT)
    return stage.save("segments", made)


def item_blocks(items: DataFrame, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """(item_id, its distinct terms), in blocks of bounded size; one block is on the driver at a time."""
    rows = items.groupBy("item_id").agg(F.collect_list("text").alias("texts")).select("item_id", F.array_join("texts", " ").alias("text"))
    block, held = [], 0
    for row in rows.toLocalIterator():
        terms = sorted(set(terms_of(row["text"])))
        size = sum(map(len, terms))
        if block and (len(block) == block_items or held + size > block_bytes):
            yield block
            block, held = [], 0
        if terms:
            block.append((row["item_id"], terms))
            held += size
    if block:
        yield block


def weights(index: DataFrame, terms: list[bytes], docs: int) -> dict[bytes, int]:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of those of the terms (a block's) that documents hold."""
    wanted = index.sparkSession.createDataFrame([(t,) for t in terms], "term binary")
    held = index.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.held").alias("n"))
    counted = held.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("n").alias("df"))
    return {bytes(r["term"]): math.floor(1000 * math.log((2 * docs + 2) / (2 * r["df"] + 1))) for r in counted.toLocalIterator()}


class Lists:
    """The best documents of each item so far: scores and ids, the worst score that still counts."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)  # a score of 0 never counts
        self.scores = [np.empty(0, np.int64)] * items
        self.ids = [np.empty(0, np.int64)] * items

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores[item], scores])
        ids = np.concatenate([self.ids[item], ids])
        if len(scores) > self.k:
            best = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[best], ids[best]
            self.least[item] = max(1, scores.min())
        self.scores[item], self.ids[item] = scores, ids


def visit(row: dict, items: list[np.ndarray], known: dict[bytes, int], weight: np.ndarray, docs: int, words: int, lists: Lists) -> None:
    """Brings the items' lists up to date with one segment.

    ``items``: term numbers of each item; ``known``: number of a term; ``weight``: by number.
    """
    own = np.array([known.get(t, -1) for t in row["terms"]], np.int64)
    used = np.flatnonzero(own >= 0)
    per_term = row["runs"].astype(np.int64)
    last_run = np.cumsum(per_term)
    runs = ranges((last_run - per_term)[used], last_run[used])
    if not len(runs):
        return
    place = np.full(len(weight) + 1, -1)  # of a term among the used ones
    place[own[used]] = np.arange(len(used))
    edges = np.concatenate([[0], np.cumsum(per_term[used])])
    size = row["run_size"].astype(np.int64)
    start = (np.cumsum(size) - size)[runs]
    size, tf = size[runs], row["run_tf"][runs].astype(np.int64)
    term = np.repeat(own[used], per_term[used])
    lengths, which = np.unique(row["run_length"][runs], return_inverse=True)
    m = np.array([100 - SLOPE + SLOPE * int(n) * docs // words for n in lengths], np.int64)
    strata, of_length = np.unique(m, return_inverse=True)
    stratum = of_length[which]
    impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * strata[stratum]))  # once per run
    # The best run of each term in each stratum.
    new = np.ones(len(runs), bool)
    new[1:] = (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])
    cells = np.flatnonzero(new)
    top, cell_stratum = np.maximum.reduceat(impact, cells), stratum[cells]
    cell_edges = np.searchsorted(cells, edges)
    doc_ids, postings = row["doc_ids"], row["postings"]
    scores = np.zeros(len(doc_ids), np.int64)
    for item, numbers in enumerate(items):
        at = place[numbers]
        at = at[at >= 0]
        if not len(at):
            continue
        own_cells = ranges(cell_edges[at], cell_edges[at + 1])
        bound = np.zeros(len(strata), np.int64)
        np.add.at(bound, cell_stratum[own_cells], top[own_cells])
        order = np.argsort(-bound, kind="stable")
        falling = -bound[order]
        until = int(np.searchsorted(falling, -lists.least[item], side="right"))
        if not until:
            continue
        own_runs = ranges(edges[at], edges[at + 1])
        own_runs = own_runs[np.argsort(stratum[own_runs], kind="stable")]
        where = stratum[own_runs]
        low, high = np.searchsorted(where, order), np.searchsorted(where, order, side="right")
        done, step = 0, 1
        while done < until:
            # Some strata at a time, twice as many the next time.
            end = min(done + step, until)
            chosen = own_runs[ranges(low[done:end], high[done:end])]
            held = postings[ranges(start[chosen], start[chosen] + size[chosen])]
            np.add.at(scores, held, np.repeat(impact[chosen], size[chosen]))
            touched = np.unique(held)
            own_scores = scores[touched]
            scores[touched] = 0
            good = own_scores >= lists.least[item]
            lists.add(item, own_scores[good], doc_ids[touched[good]])
            done, step = end, step * 2
            until = int(np.searchsorted(falling, -lists.least[item], side="right"))


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low, ..., high - 1 of every pair, one after the other."""
    sizes = high - low
    return np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)


def best_of(spark, index: DataFrame, block: list[tuple], docs: int, words: int, k: int) -> DataFrame:
    """(item, doc_id, score): the lists of all tasks for a block of items, item by its place in the block."""
    terms = sorted({t for _, own in block for t in own})
    weight_of = weights(index, terms, docs)
    known = {t: i for i, t in enumerate(t for t in terms if t in weight_of)}
    weight = np.array([weight_of[t] for t in known], np.int64)
    shared = spark.sparkContext.broadcast(
        ([np.array([known[t] for t in own if t in known], np.int64) for _, own in block], known, weight)
    )

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known, weight = shared.value
        asked = [(i, numbers) for i, numbers in enumerate(items) if len(numbers)]
        lists = Lists(len(asked), k)
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: unpack(batch.column(name)[at]) for name in PACKED}
                row |= {name: batch.column(name)[at].values.to_numpy() for name in ("doc_ids", "lengths")}
                row["terms"] = batch.column("terms")[at].values.to_pylist()
                visit(row, [numbers for _, numbers in asked], known, weight, docs, words, lists)
        sizes = [len(s) for s in lists.scores]
        if sum(sizes):
            ids = np.concatenate(lists.ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([i for i, _ in asked], sizes), pa.int32()),
                    pa.array(ids, pa.int64(), mask=ids == NO_ID),
                    pa.array(np.concatenate(lists.scores), pa.int64()),
                ],
                names=["item", "doc_id", "score"],
            )

    return index.drop("held").mapInArrow(visited, FOUND)


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key, highest score first, numbered."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, stage: Stage, k: int = K, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text)."""
    spark = index.sparkSession
    lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    size = index.agg(F.sum(F.size("lengths")).alias("docs"), F.sum(lengths).alias("words")).first()
    item_id = items.schema["item_id"].dataType.simpleString()
    results = spark.createDataFrame([], f"item_id {item_id}, rank int, doc_id long, score long")
    for block in item_blocks(items, block_items) if size["docs"] else []:
        found = best_of(spark, index, block, size["docs"], size["words"], k)
        found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_GROUPS)))
        found = ranked(ranked(found, ["item", "part"], k).drop("part"), ["item"], k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item int, item_id {item_id}")
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        results = results.unionByName(stage.save("ranked", found))
    return results


def query(spark, sf_dir: str) -> DataFrame:
    stage = Stage(spark)
    return search(build_index(documents(spark, sf_dir), stage), table(spark, sf_dir, "benchmark"), stage)
