"""Exact removal of repeated substrings by content-defined parsing.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else. As in prefix-free
parsing, a rolling hash cuts every text into phrases in a way that depends on the content alone, so that
equal strings are cut alike; whether strings repeat is then decided on phrases, in the order of their
contents, and single positions are looked at only next to the ends of repeats:

* Parse. The trigger of a string is the place of the smallest rolling hash among its first ``SPREAD``
  grams. All strings with one trigger start in one run of positions, and the runs cover every string.
* Dictionary. The bytes that all strings of a trigger share (its core) must occur at another trigger;
  most triggers end here. Copies of a text count once, and a text with a copy is repeated as a whole.
* Contexts. A trigger whose whole surroundings occur twice has only repeated strings.
* Stretches. Of the other triggers, and one trigger for every context they may meet, runs are cut into
  stretches of ``STRETCH`` starts. The strings of a stretch share all but a few bytes at either end:
  equal ends mean repeated strings, a part that no other has means none.
* Positions. In what is left, each string is the shared part and so many bytes of either end.

Contents are compared by 64-bit hashes in each of these steps, in place of the sorted suffixes of dictionary
and parse: equality at a fixed length is all that is asked for, and grouping needs no global order (nor a
group in one task: every step is a count or a minimum and maximum per hash, combined before the shuffle).

Null and empty texts have no bytes and keep none. Texts below ``length`` bytes stay whole. Repeated rows are
copies of each other, so they go whole. Ids are only passed on: nulls and equal ids do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import discard, documents, settle
from kinspark.llm.shingles import eights, first_bytes, mix
from kinspark.sources.stage import Stage

LENGTH = 400
#: Triggers lie at most so many bytes apart; a string needs SPREAD + GRAM bytes at least.
SPREAD = 192
GRAM = 16  # a power of two
STRETCH = 16
#: String starts whose triggers are looked for at a time.
SEGMENT = 1 << 19
U = np.uint64


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of strings from those of two parts that cover them."""
    x = left * U(0x9E3779B97F4A7C15) + right * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class Content:
    """Hashes of any substrings of a text.

    The hash of a block of 2^k bytes pairs those of its halves, and a string's those of the blocks at its two ends,
    which cover it. Each pairing mixes, so that differences cannot cancel out.
    """

    def __init__(self, data: bytes):
        self.n = len(data)
        self.eights = eights(np.frombuffer(data, dtype=np.uint8))
        self.blocks: dict[int, np.ndarray] = {}

    def block(self, k: int) -> np.ndarray:
        """Of the 2^k bytes (8 at least) from each place on."""
        if k not in self.blocks:
            known = max((j for j in self.blocks if j < k), default=None)
            made = mix(self.eights[: max(0, self.n - 7)]) if known is None else self.blocks[known]
            for half in (1 << j for j in range(3 if known is None else known, k)):
                made = paired(made[:-half], made[half:])
            self.blocks[k] = made
        return self.blocks[k]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from start to end - 1; places beyond the text count as its ends."""
        start, end = np.clip(start, 0, self.n), np.clip(end, 0, self.n)
        length = end - start
        found = np.zeros(len(start), dtype=U)
        size = np.frexp(length)[1] - 1  # of the largest block that fits
        short = (length > 0) & (length < 8)
        found[short] = mix(first_bytes(self.eights[start[short]], length[short]))
        for k in np.unique(size[length >= 8]).tolist():
            own = size == k
            block = self.block(k)
            found[own] = paired(block[start[own]], block[end[own] - (1 << k)])
        return mix(found + length.astype(U) * U(0xD6E8FEB86659FD93))

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """trigger, first start, last start: strings of one trigger, in runs of starts."""
        found = []
        for low in range(0, self.n - length + 1, SEGMENT):
            high = min(low + SEGMENT, self.n - length + 1)
            at = np.arange(low, high + SPREAD - 1)
            grams = mix(self.block(GRAM.bit_length() - 1)[low : high + SPREAD - 1])
            least = (grams & ~U(0xFFFFF)) | (at - low).astype(U)  # equal grams: the first
            width = 1
            while width * 2 <= SPREAD:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if rest := SPREAD - width:
                least = np.minimum(least[:-rest], least[rest:])
            trigger = (least & U(0xFFFFF)).astype(np.int64) + low
            first = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
            last = np.r_[first[1:] - 1, len(trigger) - 1]
            found.append((trigger[first], first + low, last + low))
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def table_of(schema: str, columns: list) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def repeat_key(key: bytes, n: int) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, dtype="i4")), pa.array([key], type=pa.binary())).cast(pa.binary())


def triggers(texts: DataFrame, length: int) -> DataFrame:
    """key, t, core: every trigger of every text. ``texts``: key, text."""
    schema = "key binary, t long, core long"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                content = Content(text.as_buffer().to_pybytes() if text.is_valid else b"")
                t, _, _ = content.runs(length)
                if len(t):
                    core = content.hash(t, t + length - SPREAD + 1)
                    yield table_of(schema, [repeat_key(key.as_py(), len(t)), t, core.view(np.int64)])

    return texts.mapInArrow(lambda batches: gathered(found(batches)), schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def chosen_runs(content: Content, wanted, length: int):
    t, lo, hi = content.runs(length)
    keep = np.isin(t, np.asarray(wanted, dtype=np.int64))
    return t[keep], lo[keep], hi[keep]


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """key, t, lo, hi, core, context of the triggers listed with each text (key, text, ts)."""
    schema = "key binary, t long, lo long, hi long, core long, context long"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, ts in zip(*[batch.column(i) for i in range(3)]):
                content = Content(text.as_buffer().to_pybytes())
                t, lo, hi = chosen_runs(content, ts.values.to_numpy(), length)
                # A string's trigger is at most SPREAD - 1 bytes into it.
                core, around = content.hash(t, t + length - SPREAD + 1), content.hash(t - SPREAD + 1, t + length)
                # Near the ends of a text a context is shorter; where its trigger lies tells such apart.
                around = mix(around + np.minimum(t, SPREAD).astype(U))
                yield table_of(schema, [repeat_key(key.as_py(), len(t)), t, lo, hi, core.view(np.int64), around.view(np.int64)])

    return texts.select("key", "text", "ts").mapInArrow(lambda batches: gathered(found(batches)), schema)


def stretches(texts: DataFrame, length: int) -> DataFrame:
    """Stretches of the runs of the triggers listed with each text.

    key, t, j (the stretch holds the starts t - o for o from STRETCH * j on), shared (hash), head and tail (the
    bytes before and after the shared part), low and high (the starts it has, as bytes of the head).
    """
    schema = "key binary, t long, j int, shared long, head binary, tail binary, low int, high int"
    wide = STRETCH - 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, ts in zip(*[batch.column(i) for i in range(3)]):
                data = text.as_buffer().to_pybytes()
                content = Content(data)
                t, lo, hi = chosen_runs(content, ts.values.to_numpy(), length)
                rows = [(a, j, max(a - h, STRETCH * j), min(a - b, STRETCH * j + wide)) for a, b, h in zip(t.tolist(), lo.tolist(), hi.tolist()) for j in range((a - h) // STRETCH, (a - b) // STRETCH + 1)]
                if not rows:
                    continue
                t, j, low, high = (np.array(x) for x in zip(*rows))
                begin, end = t - STRETCH * j, t - STRETCH * j + length - wide
                shared = mix(content.hash(begin, end) + j.astype(U)).view(np.int64)
                head = [data[max(0, b - wide) : b] for b in begin.tolist()]
                tail = [data[e : e + wide] for e in end.tolist()]
                yield table_of(schema, [
                    repeat_key(key.as_py(), len(t)), t, j.astype("i4"), shared, pa.array(head, type=pa.binary()),
                    pa.array(tail, type=pa.binary()), (low - STRETCH * j).astype("i4"), (high - STRETCH * j).astype("i4"),
                ])

    return texts.select("key", "text", "ts").mapInArrow(lambda batches: gathered(found(batches)), schema)


def removed(texts: DataFrame) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256 of texts with the starts and ends of what goes (key, text, spans)."""
    schema = "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
                data, kept, at, n = text.encode("utf-8", "surrogatepass"), [], 0, 0
                for low, high in merged(spans):
                    kept.append(data[at:low])
                    at, n = high, n + 1
                whole = b"".join([*kept, data[at:]])
                rows.append((key, len(data) - len(whole), n, hashlib.sha256(whole).hexdigest(), whole))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=[p.split()[0] for p in schema.split(", ")])

    return texts.select("key", "text", "spans").mapInArrow(cut, schema)


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def one_of(*columns: str):
    """Least and greatest of a hash of what tells rows apart: equal if there is one thing only."""
    return F.min(F.xxhash64(*columns)).alias("least"), F.max(F.xxhash64(*columns)).alias("greatest")


def spans_of(keyed: DataFrame, distinct_texts, length: int, stage: Stage) -> DataFrame:
    """key, text, spans: the texts with a repeat, once each, and the strings that repeat, as joined-up starts."""
    found = stage.save("triggers", triggers(keyed, length))
    # Stored, so that the joins with it can split a frequent core.
    cores = stage.save("cores", found.groupBy("core").agg(*one_of("key", "t")).filter("least < greatest").select("core"))
    some = found.join(cores, "core").groupBy("key").agg(F.collect_set("t").alias("ts"))
    texts = stage.save("texts", distinct_texts.join(some, "key"))

    settle(texts.sparkSession)

    around = stage.save("contexts", contexts(texts, length))
    per_context = around.groupBy("context").agg(*one_of("key", "t"), F.min(F.struct("key", "t")).alias("one"), F.min("core").alias("core"))
    per_context = stage.save("per_context", per_context.withColumn("alone", F.col("least") == F.col("greatest")).drop("least", "greatest"))
    whole = around.join(per_context.filter("NOT alone").select("context"), "context")
    whole = whole.select("key", F.col("lo").alias("low"), (F.col("hi") + length).alias("high"))

    # Cores with a context of its own: there, one trigger of every context is looked at closely.
    open_cores = per_context.groupBy("core").agg(F.max("alone").alias("any"), F.count(F.lit(1)).alias("n")).filter("any AND n > 1")
    open_cores = stage.save("open_cores", open_cores)
    close = per_context.join(open_cores.select("core"), "core").select("one.key", "one.t")
    close = close.groupBy("key").agg(F.collect_set("t").alias("ts"))
    parts = stage.save("stretches", stretches(texts.drop("ts").join(close, "key"), length))
    settle(texts.sparkSession)
    ends = parts.groupBy("shared", "head", "tail").agg(
        *one_of("key", "t"), F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.struct("key", "t", "j")).alias("one")
    )
    ends = stage.save("ends", ends.withColumn("alone", F.col("least") == F.col("greatest")).drop("least", "greatest"))
    equal = parts.join(ends.filter("NOT alone").select("shared", "head", "tail"), ["shared", "head", "tail"])
    start = lambda byte: F.col("t") - STRETCH * F.col("j") - F.col(byte)
    equal = equal.select("key", start("high").alias("low"), (start("low") + length).alias("high"))

    met = ends.groupBy("shared").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("any")).filter("n > 1 AND any")
    met = stage.save("met", met)
    places = ends.join(met.select("shared"), "shared").withColumn("x", F.explode(F.sequence("low", "high")))
    before = F.expr("substring(head, length(head) - x + 1, x)")
    after = F.expr(f"substring(tail, 1, {STRETCH - 1} - x)")
    places = places.select(F.xxhash64("shared", "x", before, after).alias("string"), "one", "alone", "x")
    places = stage.save("places", places)
    twice = stage.save("twice", places.groupBy("string").agg(*one_of("one")).filter("least < greatest").select("string"))
    single = places.filter("alone").join(twice, "string")
    single = single.select(F.col("one.key").alias("key"), (F.col("one.t") - STRETCH * F.col("one.j") - F.col("x")).alias("low"))
    single = single.select("key", "low", (F.col("low") + length).alias("high"))

    spans = whole.unionByName(equal).unionByName(single).groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return texts.drop("ts").join(spans, "key")


def dedup(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if asked for), a row per row."""
    stage = Stage(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    rows = df.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    keyed = df.select("key", "text").filter(F.octet_length("text") >= length)
    distinct_texts = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    cut = removed(spans_of(keyed, distinct_texts, length, stage).filter("copies = 1"))
    if not keep_text:
        cut = cut.drop("kept")
    cut = stage.save("cut", cut)
    discard(stage, ("cut",))
    settle(docs.sparkSession)
    copies = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("key")
    changes = cut.unionByName(
        copies.select(
            "key", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
            F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), *([F.lit(b"").alias("kept")] if keep_text else []),
        )
    )
    out = rows.join(changes.withColumn("changed", F.lit(True)), "key", "left")
    columns = [
        "doc_id", "n_bytes",
        F.when(F.col("changed"), F.coalesce("n_removed", "n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    ]
    return out.select(*columns, *(["kept"] if keep_text else []))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))
