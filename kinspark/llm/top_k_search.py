"""Exact top-k inner-product search with a three-phase uniform threshold.

Vectors are cut into blocks of rows, and their components into ``GROUPS`` groups. A node scores one group
of one block against the queries of another block, so a score is a sum of GROUPS partial scores:

1. every node lists its k largest partial scores per query; the k largest per query and group are
   resolved to whole scores, and the k-th largest of those is a safe cutoff;
2. every node gets the cutoffs of its queries and collects all entries of at least cutoff / GROUPS: an
   entry that is below it in every group cannot reach the cutoff;
3. the collected entries are resolved to whole scores, and the k best of each query are the answer.

The nodes of a block are one task. It gets the block's rows first and then, one after the other, the queries that meet
them, so it holds one block and one block's queries. Entries are resolved where they are collected, and only those that
reach the cutoff leave the task. Vectors are never broadcast: how many there are after the queries are dealt out is
nothing that Spark estimates (it takes the table of queries as it is stored), and it would gather them in the driver.

Queries are a stated set, the vectors whose id is divisible by ``query_step``; they meet all rows block
by block. Components become floor(64 * x). Vectors that are null, hold a null, NaN or infinite component,
or have no id take no part; shorter vectors count as padded with zeros. Rows of one id are separate
candidates and separate queries. Scores are exact in 64 bits and stop at their bounds. No rows: no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.common import partitions_for, table
from kinspark.sources.stage import Stage

K = 20
QUERY_STEP = 20
SCALE = 64
GROUPS = 2
BLOCK_ROWS = 16384
#: Queries scored at a time inside a node.
QUERY_ROWS = 128
#: Entries resolved at a time.
PAIRS = 65536
#: So that blocks, dealt out by hash, seldom share a task.
TASKS_PER_BLOCK = 4
LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame) -> DataFrame:
    """id, v: the vectors that take part, with integer components."""
    df = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    df = df.filter(F.col("id").isNotNull() & F.col("x").isNotNull()).filter(finite)
    return df.select("id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they need; the first byte says how many."""
    low, high = values.min(initial=0), values.max(initial=0)
    size = next(n for n in (1, 2, 4, 8) if np.iinfo(f"i{n}").min <= low and high <= np.iinfo(f"i{n}").max)
    return bytes([size]) + np.ascontiguousarray(values, dtype=f"<i{size}").tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).astype(np.int64)


def blocks(vectors: DataFrame, stage: Stage) -> tuple[DataFrame, int, int]:
    """A stored table of blocks (block, ids, data), the number of blocks, and the longest vector's length."""
    stored = stage.save("vectors", quantised(vectors))
    rows, width = stored.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    count, width = partitions_for(rows, BLOCK_ROWS), width or 0

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data = [], []
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            part = np.zeros((len(ends), width), dtype="<i8")
            part[np.arange(width) < ends[:, None]] = flat
            ids.append(batch.column(0).to_numpy())
            data.append(part)
        if ids:
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([TaskContext.get().partitionId()], type=pa.int32()),
                    "ids": pa.array([packed(np.concatenate(ids))], type=pa.binary()),
                    "data": pa.array([packed(np.concatenate(data))], type=pa.binary()),
                }
            )

    made = stored.repartition(count).mapInArrow(block, "block int, ids binary, data binary")
    return stage.save("blocks", made), count, width


def queries_of(made: DataFrame, width: int, step: int) -> DataFrame:
    """The queries of each block: block, places, ids, data."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, ids, data in zip(*[c.to_pylist() for c in batch.columns]):
                ids = numbers(ids)
                places = np.flatnonzero(ids % step == 0)
                if len(places):
                    out.append((block, packed(places), packed(ids[places]), packed(numbers(data).reshape(-1, width)[places])))
            if out:
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=["q_block", "q_places", "q_ids", "q_data"]
                )

    return made.mapInArrow(chosen, "q_block int, q_places binary, q_ids binary, q_data binary")


def largest(values: np.ndarray) -> float:
    return max(float(values.max(initial=0)), -float(values.min(initial=0)))


class Rows:
    """A block's components of one group, turned into each kind of number once."""

    def __init__(self, values: np.ndarray):
        self.values, self.largest, self._as = values, largest(values), {}

    def turned(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = np.ascontiguousarray(self.values.astype(kind).T)
        return self._as[kind]


def scoring(a: np.ndarray, b: Rows):
    """A function (low, high) -> exact inner products of rows low to high - 1 of a with all rows of b."""
    bound = largest(a) * b.largest * a.shape[1]
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        left, right = a.astype(kind), b.turned(kind)
        return lambda low, high: left[low:high] @ right
    left, right = a.astype(object), b.turned(object)
    return lambda low, high: np.clip(left[low:high] @ right, LONG.min, LONG.max).astype(np.int64)


def row_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bound = largest(a) * largest(b) * a.shape[1]
    if bound < 2**62:
        return np.einsum("ij,ij->i", a, b)
    exact = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def falling(scores: np.ndarray) -> np.ndarray:
    """Numbers in the opposite order; the least integer has no negative."""
    return ~scores if scores.dtype == np.int64 else -scores


def groups(width: int) -> list[slice]:
    cuts = [width * g // GROUPS for g in range(GROUPS + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def everywhere(queries: DataFrame, count: int) -> DataFrame:
    """The queries, once for each block."""
    return queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def nodes(asks: DataFrame, made: DataFrame, count: int) -> DataFrame:
    """The rows of each block, followed by the queries that meet them (``asks``: block, q_block, ...)."""
    rows = asks.unionByName(made, allowMissingColumns=True)
    return rows.repartition(TASKS_PER_BLOCK * count, "block").sortWithinPartitions("block", F.col("q_block").asc_nulls_first())


def met(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[Rows], dict]]:
    """Of every row of queries: ids, components and groups of the block they meet, and the row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() if n not in "qc" else batch.column(n)[i].values for n in batch.schema.names}
            if row["q_block"] is None:
                ids, data = numbers(row["ids"]), numbers(row["data"]).reshape(-1, width)
                parts = [Rows(data[:, part]) for part in groups(width)]
            else:
                yield ids, data, parts, row


def lists(pairs: DataFrame, width: int, k: int) -> DataFrame:
    """Phase 1: the k largest partial scores per query at every node."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, parts, row in met(batches, width):
            q, places = numbers(row["q_data"]).reshape(-1, width), numbers(row["q_places"])
            own = row["q_block"] == row["block"]
            for part, (columns, rows) in enumerate(zip(groups(width), parts)):
                score = scoring(q[:, columns], rows)
                for at in range(0, len(q), QUERY_ROWS):
                    scores = score(at, at + QUERY_ROWS)
                    some = min(k + own, scores.shape[1])
                    best = np.argpartition(falling(scores), some - 1, axis=1)[:, :some]
                    values = np.take_along_axis(scores, best, axis=1).ravel().astype(np.int64)
                    query, best = np.repeat(places[at : at + QUERY_ROWS], some), best.ravel()
                    keep = np.flatnonzero(query != best) if own else np.arange(len(best))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "q_block": pa.array(np.full(len(keep), row["q_block"], dtype="i4")),
                            "q_place": pa.array(query[keep].astype("i4")),
                            "part": pa.array(np.full(len(keep), part, dtype="i4")),
                            "block": pa.array(np.full(len(keep), row["block"], dtype="i4")),
                            "place": pa.array(best[keep].astype("i4")),
                            "score": pa.array(values[keep]),
                        }
                    )

    return pairs.mapInArrow(listed, "q_block int, q_place int, part int, block int, place int, score long")


def best_of(row: dict, ids: np.ndarray, at: np.ndarray, place: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best entries (query at, place in block) of each query (equal scores: the smaller ids)."""
    order = np.lexsort((ids[place], falling(scores), at))
    at, place, scores = at[order], place[order], scores[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    keep = rank < k
    at, place = at[keep], place[keep]
    return pa.RecordBatch.from_pydict(
        {
            "q_block": pa.array(np.full(len(at), row["q_block"], dtype="i4")),
            "q_place": pa.array(numbers(row["q_places"])[at].astype("i4")),
            "block": pa.array(np.full(len(at), row["block"], dtype="i4")),
            "place": pa.array(place.astype("i4")),
            "query_id": pa.array(numbers(row["q_ids"])[at]),
            "vec_id": pa.array(ids[place]),
            "score": pa.array(scores[keep]),
        }
    )


def whole_scores(q: np.ndarray, data: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    cuts = range(0, len(at), PAIRS)
    return np.concatenate([np.zeros(0, dtype=np.int64), *(row_products(q[at[s : s + PAIRS]], data[place[s : s + PAIRS]]) for s in cuts)])


SCORED = "q_block int, q_place int, block int, place int, query_id long, vec_id long, score long"


def resolved(pairs: DataFrame, width: int, k: int) -> DataFrame:
    """Whole scores of listed entries, per list the k best of each query."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, _, row in met(batches, width):
            q, c = (row[n].to_numpy().astype(np.int64) for n in "qc")
            pair = np.unique(q << 32 | c)
            at, place = np.searchsorted(numbers(row["q_places"]), pair >> 32), pair & 0xFFFFFFFF
            scores = whole_scores(numbers(row["q_data"]).reshape(-1, width), data, at, place)
            yield best_of(row, ids, at, place, scores, k)

    return pairs.mapInArrow(scored, SCORED)


def collected(pairs: DataFrame, width: int, k: int) -> DataFrame:
    """Phases 2 and 3: per node the entries of at least cutoff / GROUPS, and whole scores of at least the cutoff."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, parts, row in met(batches, width):
            q, places = numbers(row["q_data"]).reshape(-1, width), numbers(row["q_places"])
            known = {c["q_place"]: c["cutoff"] for c in row["cutoffs"] or ()}
            cutoffs = np.array([known.get(int(p), LONG.min) for p in places], dtype=np.int64)
            # Scores are whole numbers: at least cutoff / GROUPS is at least its ceiling.
            least = np.array([-(-int(c) // GROUPS) for c in cutoffs], dtype=np.int64)
            score = [scoring(q[:, columns], rows) for columns, rows in zip(groups(width), parts)]
            exact = largest(q) * largest(data) * width < 2**53  # else a sum of parts that stopped at their bounds may differ
            for low in range(0, len(q), QUERY_ROWS):
                scores = [s(low, low + QUERY_ROWS) for s in score]
                wanted = np.zeros(scores[0].shape, dtype=bool)
                for s in scores:
                    floor = least[low : low + QUERY_ROWS, None]
                    wanted |= s >= (floor if s.dtype == np.int64 else floor.astype(s.dtype))
                at, place = np.nonzero(wanted)
                if row["q_block"] == row["block"]:
                    other = places[low + at] != place
                    at, place = at[other], place[other]
                if exact:
                    whole = sum(s[at, place].astype(np.int64) for s in scores)
                else:
                    whole = whole_scores(q, data, low + at, place)
                keep = whole >= cutoffs[low + at]
                if keep.any():
                    yield best_of(row, ids, low + at[keep], place[keep], whole[keep], k)

    return pairs.mapInArrow(entries, SCORED)


def search(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query."""
    stage = Stage(vectors.sparkSession)
    made, count, width = blocks(vectors, stage)
    if not width:  # no vector takes part, or all of them are empty
        made = made.limit(0)
    queries = stage.save("queries", queries_of(made, width, query_step))

    best = Window.partitionBy("q_block", "q_place", "part").orderBy(F.desc("score"), "block", "place")
    seen = lists(nodes(everywhere(queries, count), made, count), width, k)
    seen = seen.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    seen = seen.select("q_block", "q_place", "block", "place").distinct()
    seen = seen.groupBy("q_block", "block").agg(F.collect_list(F.struct("q_place", "place")).alias("e"))
    seen = seen.select("q_block", "block", F.col("e.q_place").alias("q"), F.col("e.place").alias("c"))
    totals = resolved(nodes(seen.join(queries.hint("merge"), "q_block"), made, count), width, k)
    by_score = Window.partitionBy("q_block", "q_place").orderBy(F.desc("score"), "block", "place")
    cutoffs = totals.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k)
    cutoffs = cutoffs.groupBy("q_block").agg(F.collect_list(F.struct("q_place", F.col("score").alias("cutoff"))).alias("cutoffs"))
    cutoffs = stage.save("cutoffs", cutoffs)

    limited = queries.join(cutoffs.hint("merge"), "q_block", "left")
    found = collected(nodes(everywhere(limited, count), made, count), width, k)
    answer = Window.partitionBy("q_block", "q_place").orderBy(F.desc("score"), "vec_id", "block", "place")
    found = found.withColumn("rank", F.row_number().over(answer)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
