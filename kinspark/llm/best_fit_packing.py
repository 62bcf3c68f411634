"""Best-fit packing of tokenised documents with large-item matching.

A document becomes its tokens and one end token (id 0); only a document above the capacity is cut, into
full pieces and a shorter first one. Packing needs the number of pieces of each length only, at most
``capacity`` numbers, so the plan is made on the driver from that histogram, whatever the input's size:

* pieces above a third of the capacity fit at most twice into a sequence: from the longest on, each is
  matched with the longest other one that fits;
* shorter pieces, from the longest on, go to the tightest gap that holds them.

The plan is a list of runs "the next n pieces of this length go to sequences s, s+1, ... at this offset".
Pieces are ranked within their length (in two steps, so a frequent length is no single task) and meet
their run by a join on the length and a range of ranks.

Null texts count as empty: one end token. Repeated rows are separate documents. No rows: no result.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.common import documents
from kinspark.sources.stage import Stage

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = "length long, low long, high long, sequence_id long, per_sequence long, offset long"


def tokenizer(vocabulary: str = VOCABULARY):
    """A function text -> ids. ``vocabulary``: a public byte-level BPE, as a tokenizer file and as ranks.

    The rank reader splits and merges as the tokenizer file does, several times as fast. A text that
    spells a special token goes to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path(f"{vocabulary}.json")
    with open(path, encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            if not exact:
                exact.append(Tokenizer.from_file(path))
            return exact[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids, if asked for): a row per piece."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), END], dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        rows.append((doc_id, k, start, length, zlib.crc32(own.tobytes()), own if keep_ids else None))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5]
                arrays = [pa.array(c, type=k) for c, k, _ in zip(columns, kinds, names)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = PIECES + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(encoded, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of RUNS: pieces of ``length`` ranked low to high - 1 go to sequence_id on, per_sequence in each, from offset.

    Work and result depend on the number of different lengths, not of pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    placed = dict.fromkeys(left, 0)
    runs, sequences = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first sequence, count) with that gap
    open_gaps: list[int] = []  # sorted keys of gaps

    def put(length: int, count: int, sequence: int, per: int, offset: int) -> None:
        runs.append((length, placed[length], placed[length] + count * per, sequence, per, offset))
        placed[length] += count * per
        left[length] -= count * per

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap not in gaps:
            open_gaps.insert(bisect_left(open_gaps, gap), gap)
            gaps[gap] = []
        gaps[gap].append((sequence, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            fits = next((m for m in large if left[m] and m <= length and m + length <= capacity and (m < length or left[m] > 1)), None)
            if fits is None:
                count = left[length]
                put(length, count, sequences, 1, 0)
                gap = capacity - length
            elif fits == length:
                count = left[length] // 2
                put(length, count, sequences, 2, 0)
                gap = capacity - 2 * length
            else:
                count = min(left[length], left[fits])
                put(length, count, sequences, 1, 0)
                put(fits, count, sequences, 1, length)
                gap = capacity - length - fits
            if gap:
                leave(gap, sequences, count)
            sequences += count
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                per = min(capacity // length, left[length])
                count = left[length] // per
                put(length, count, sequences, per, 0)
                if capacity > per * length:
                    leave(capacity - per * length, sequences, count)
                sequences += count
                continue
            gap = open_gaps[at]
            first, free = gaps[gap].pop()
            per = min(gap // length, left[length])
            count = min(free, left[length] // per)
            put(length, count, first, per, capacity - gap)
            if free > count:
                gaps[gap].append((first + count, free - count))
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.remove(gap)
            if gap > per * length:
                leave(gap - per * length, first, count)
    return runs


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces."""
    spark = cut_pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), RUNS)
    # Rank within the length: by a hash bucket first, then inside it, so a frequent length is spread.
    most = max(histogram.values(), default=0)
    buckets = max(1, -(-most // 10_000))
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    df = cut_pieces.withColumn("bucket", bucket)
    counts = df.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    df = df.withColumn("within", within).join(counts, ["length", "bucket"])
    df = df.withColumn("rank", F.col("earlier") + F.col("within")).drop("bucket", "within", "earlier")
    # Runs of a length are looked up in one array per length: at most ``capacity`` arrays.
    table = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "sequence_id", "per_sequence", "offset"))).alias("runs"))
    df = df.join(F.broadcast(table), "length")
    df = df.withColumn("run", F.expr("filter(runs, r -> r.low <= rank AND rank < r.high)[0]")).drop("runs")
    nth = F.col("rank") - F.col("run.low")
    return df.select(
        *cut_pieces.columns,
        (F.col("run.sequence_id") + F.floor(nth / F.col("run.per_sequence"))).alias("sequence_id"),
        (F.col("run.offset") + nth % F.col("run.per_sequence") * F.col("length")).alias("offset"),
    )


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it. Tokens are made once and stored."""
    stored = Stage(docs.sparkSession).save("pieces", pieces(docs, capacity, vocabulary, keep_ids))
    return pack(stored, capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
