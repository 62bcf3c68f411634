"""Jaccard join on word n-grams by T-occurrence search.

A document's set is its distinct ``SIZE``-word shingles (a shorter text: its whole sequence as one). Two
sets link when ``100 * common >= PERCENT * union``. Every shingle has an inverted list. A partner of a set
of n must share T = ceil(PERCENT/100 * n) of its n lists, so the T - 1 longest lists can be set aside: a
partner is in one at least of the other, short ones. Short lists are merged (a shuffle by shingle), with a
lower bound on how many of them two partners share; long lists are probed, by binary search of a set's
remaining shingles in the partner's sorted set.

1. Lengths of lists are counted over all documents in 2**BUCKET_BITS buckets of shingles (a table of fixed
   size). They only order the lists; any order gives the same links.
2. Sets that are equal are one class. Each class posts to its short lists.
3. First links: every class meets its neighbours in its lists, and its most promising pair is probed. Lists
   are cut into stretches, so a frequent shingle makes no large group. Linked classes become components.
4. Other links: in lists that hold several components, every class outside the list's largest component
   meets all classes of other components. All pairs that share enough short lists are probed, so no link
   between components is missed, while a group of copies, already one component, makes no pairs.
5. In lists above LARGE most classes are variants of one text. The lists of one largest component are a
   family, with the shingles of most of its classes as its centre. Classes close to the centre do not meet in
   these lists but by their deltas, the few shingles in which they differ from it: the shingles in which two
   classes differ are those in which their deltas do. So two classes whose deltas are small enough together link
   without a look; all such are linked with the class that is best at it. Others must share shingles of their deltas,
   which only few of the family have. Classes far from the centre meet all classes of their lists as in 4.

Shingles are compared by 64-bit hashes in lists and probes, sets by 64-bit hashes.

Null and empty texts have no set and link with nothing. A component_id is the smallest id in the component,
ids that are null aside; repeated rows are in one component. Only the id and text columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.functions.membership import keep_candidates
from kinspark.llm.common import components, discard, documents, settle
from kinspark.llm.shingles import Words, distinct, mix, slices
from kinspark.sources.stage import Stage

SIZE = 3
PERCENT = 90
BUCKET_BITS = 22
#: Bucket counts are shipped in rows of so many buckets.
CHUNK = 4096
#: Classes of a list that are paired with their neighbours in one task.
STRETCH = 500
#: Bytes of texts or sets that a task works on at a time.
SLICE = 2 << 20
ORDERS = 3
#: In lists of more classes, those close to the centre of their family meet by their deltas.
LARGE = 50
#: So many ids of wanted texts are broadcast as they are, more as a Bloom filter.
WANTED_IDS = 100_000
#: Bits of the parity sketch of a set, at least and at most. A sketch much shorter than the set is odd in half its bits
#: whatever the set, so it has more than twice the bits in which partners may differ.
SKETCH, LONG_SKETCH = 512, 1 << 13


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def sets_of(batch: pa.RecordBatch, column: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*Words(batch.column(column), lower=True).shingles(size, short=True))


def least_common(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n has in common with any partner, at least."""
    return -(-n * percent // 100)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits that stand for a set."""
    sums = np.r_[np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)))]
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def sketch_bits(n: np.ndarray, percent: int) -> np.ndarray:
    """Bits of the sketch of a set of n, a power of two."""
    size = np.clip(2.3 * 2 * (100 - percent) / (100 + percent) * n, SKETCH, LONG_SKETCH)
    return np.int64(1) << np.ceil(np.log2(size)).astype(np.int64)


def parities(hashes: np.ndarray, offsets: np.ndarray, percent: int) -> pa.Array:
    """``sketch_bits`` bits per set: whether the number of its shingles with this hash remainder is odd.

    The bits in which two sets differ are no more than the shingles in which they differ. A sketch is folded to a
    shorter one by xor of its parts.
    """
    n = np.diff(offsets)
    sizes = sketch_bits(n, percent)
    ends = np.r_[0, np.cumsum(sizes)]
    odd = np.zeros(ends[-1], dtype=np.uint8)
    for at in range(0, len(n), 512):  # a bounded table of counts at a time
        to = min(at + 512, len(n))
        part = hashes[offsets[at] : offsets[to]]
        bits = (part & np.repeat(sizes[at:to] - 1, n[at:to]).astype(np.uint64)).astype(np.int64)
        counts = np.bincount(np.repeat(ends[at:to] - ends[at], n[at:to]) + bits, minlength=ends[to] - ends[at])
        odd[ends[at] : ends[to]] = counts & 1
    return pa.ListArray.from_arrays(pa.array((ends // 64).astype("i4")), pa.array(np.packbits(odd).view("<i8")))


def written(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").tobytes()


def read(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def list_lengths(docs: DataFrame, size: int, stage: Stage) -> np.ndarray:
    """The length class (log2) of every bucket of shingles, over all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int32)
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                np.add.at(counts, bucket(sets_of(part, 0, size)[0]), 1)
        rows = np.minimum(counts, 255).astype(np.uint8).reshape(-1, CHUNK)  # a task's share of a long list
        some = np.flatnonzero(rows.any(axis=1))
        if len(some):
            data = pa.array([row.tobytes() for row in rows[some]], type=pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), data], names=["chunk", "counts"])

    def added(key, table):
        total = np.zeros(CHUNK, dtype=np.int64)
        for row in table.column("counts"):
            total += np.frombuffer(row.as_py(), dtype=np.uint8)
        level = np.where(total > 0, np.log2(np.maximum(total, 1)).astype(np.int8), 0).astype(np.int8)
        return pa.table({"chunk": pa.array([key[0].as_py()], type=pa.int32()), "levels": pa.array([level.tobytes()], type=pa.binary())})

    counts = docs.select("text").mapInArrow(counted, "chunk int, counts binary")
    levels = counts.groupBy("chunk").applyInArrow(added, "chunk int, levels binary")
    out = np.zeros((1 << BUCKET_BITS) // CHUNK * CHUNK, dtype=np.int8).reshape(-1, CHUNK)
    for r in levels.collect():  # one byte a bucket, whatever the input
        out[r["chunk"]] = np.frombuffer(r["levels"], dtype=np.int8)
    return out.ravel()


def text_hash() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def heads(docs: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, cls, n, and the short lists of the set: (length class, shingle) in order."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    kind = docs.schema["doc_id"].dataType

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for part in slices(batch, 2, SLICE):
                hashes, offsets = sets_of(part, 2, size)
                n = np.diff(offsets)
                text = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((hashes, levels[bucket(hashes)], text))
                ranked = hashes[order]
                short = np.where(n > 0, n - least_common(n, percent) + 1, 0)
                place = np.arange(len(ranked)) - np.repeat(offsets[:-1], n)
                kept = ranked[place < np.repeat(short, n)]
                ends = pa.array(np.r_[0, np.cumsum(short)].astype("i4"))
                items = pa.StructArray.from_arrays(
                    [pa.array(levels[bucket(kept)]), pa.array(kept.view(np.int64))], names=["level", "token"]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(signatures(hashes, offsets)), pa.array(n.astype("i8")),
                     pa.ListArray.from_arrays(ends, items), parities(hashes, offsets, percent)],
                    names=["doc_id", "text_hash", "cls", "n", "short", "bits"],
                )

    schema = f"doc_id {kind.simpleString()}, text_hash long, cls long, n long, short array<struct<level: tinyint, token: long>>, bits array<long>"
    return docs.select("doc_id", text_hash(), "text").mapInArrow(headed, schema)


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cls, tokens (sorted, see ``written``) of the wanted classes, each named by one id and text of its documents.

    Only texts whose hash is a wanted one's, or seems to be, are dealt out.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                hashes, offsets = sets_of(part, 0, size)
                rows = [written(hashes[a:b]) for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signatures(hashes, offsets)), pa.array(rows, type=pa.binary())], names=["cls", "tokens"]
                )

    # Repeated rows are made one while they are texts, which are much smaller than their sets.
    ids = wanted.select(F.col("one.text_hash").alias("text_hash")).distinct()
    texts = keep_candidates(docs.select("doc_id", text_hash(), "text"), ids, "text_hash", wanted.count(), WANTED_IDS)
    texts = texts.select(F.struct("doc_id", "text_hash").alias("one"), "text")  # structs are equal where their nulls are
    texts = texts.join(wanted.select("one"), "one", "left_semi").dropDuplicates(["one"])
    return texts.select("text").mapInArrow(made, "cls long, tokens binary")


def probed(docs: DataFrame, named: DataFrame, pairs: DataFrame, size: int, percent: int, stage: Stage) -> DataFrame:
    """The pairs (u, v) of classes that link, by binary search of the smaller set in the larger.

    Only the sets of these classes are made.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = read(a.as_py()), read(b.as_py())
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                at = np.searchsorted(b, a)
                common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, type=pa.bool_()))

    pairs = stage.save("pairs", pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    settle(docs.sparkSession)
    classes = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct()
    wanted = stage.save("wanted", named.select("cls", "one").join(classes, "cls"))
    sets = stage.save("sets", whole_sets(docs, wanted, size))
    df = pairs.join(sets.select(F.col("cls").alias("u"), F.col("tokens").alias("a")), "u")
    df = df.join(sets.select(F.col("cls").alias("v"), F.col("tokens").alias("b")), "v")
    links = stage.save("links", df.select("u", "v", "a", "b").mapInArrow(linked, "u long, v long"))
    settle(docs.sparkSession)
    return links


def needed(a: str, b: str, percent: int) -> str:
    """Shingles that sets of a and b must have in common to link."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def short_common(a: str, b: str, percent: int) -> str:
    """Short lists that sets of a and b must share to link."""
    return f"({needed(a, b, percent)} - ({percent} * greatest({a}, {b}) + 99) div 100 + 1)"


def sizes(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"


def differ(a: str, b: str) -> F.Column:
    """Shingles in which two sets differ, at least."""

    def folded(x: str, y: str) -> str:
        """x.bits, if they are longer than y.bits folded to as many."""
        part = f"aggregate(sequence(i, size({x}.bits) - 1, size({y}.bits)), 0L, (s, k) -> s ^ get({x}.bits, k))"
        return f"if(size({x}.bits) > size({y}.bits), transform(sequence(0, size({y}.bits) - 1), i -> {part}), {x}.bits)"

    return F.expr(f"aggregate(zip_with({folded(a, b)}, {folded(b, a)}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def possible(a: str, b: str, percent: int) -> F.Column:
    """Whether sizes and sketches leave it open that two sets link."""
    most = f"{a}.n + {b}.n - 2 * {needed(f'{a}.n', f'{b}.n', percent)}"
    return F.expr(sizes(a, b, percent)) & (differ(a, b) <= F.expr(most))


def neighbours(posts: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """(u, v, k): every class and the one before it in each of its lists, in several orders.

    A list up to STRETCH is dealt out once and sorted in each order; a longer one is cut anew for each.
    """

    def dealt(lists: DataFrame, cut: int, orders: Sequence[int]) -> DataFrame:
        stretch = F.pmod(F.xxhash64("cls", F.lit(cut)), F.ceil(F.coalesce("length", F.lit(1)) / STRETCH))
        # Dealt out before the orders are made, so that neither they nor copies of columns travel.
        lists = lists.select("cls", "n", "token", "length", stretch.alias("stretch")).repartition("token", "stretch")
        for k in orders:
            order = Window.partitionBy("token", "stretch").orderBy(F.xxhash64("cls", F.lit(k)), "cls")
            before = F.lag(F.struct("cls", "n")).over(order)
            lists = lists.withColumn(f"b{k}", before if k == cut else F.when(F.col("length").isNull(), before))
        met = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("b")) for k in orders]))
        pairs = lists.select(F.struct("cls", "n").alias("a"), met.alias("met")).select("a", "met.k", "met.b")
        pairs = pairs.filter(F.col("b").isNotNull() & F.expr(sizes("a", "b", percent)))
        return pairs.select(F.col("a.cls").alias("u"), F.col("b.cls").alias("v"), "k")

    found = [dealt(posts.join(long, "token", "left"), 0, range(ORDERS))]
    found += [dealt(posts.join(long, "token"), k, [k]) for k in range(1, ORDERS)]
    return functools.reduce(DataFrame.unionByName, found)


def families(docs: DataFrame, named: DataFrame, kin: DataFrame, size: int, stage: Stage) -> DataFrame:
    """``kin`` (family, cls, n, label) with delta: the shingles in which a class differs from its family's centre.

    The centre are the shingles that more than half of the family have. A delta above half of the set is null.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 1, SLICE)):
            sets = [read(x.as_py()) for x in part.column(1)]
            family = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
            token = np.concatenate([np.zeros(0, "<u8"), *sets]).view(np.int64)
            order = np.lexsort((token, family))
            family, token = family[order], token[order]
            first = np.flatnonzero(np.r_[True, (family[1:] != family[:-1]) | (token[1:] != token[:-1])][: len(token)])
            k = np.diff(np.r_[first, len(token)])
            yield pa.RecordBatch.from_arrays([pa.array(family[first]), pa.array(token[first]), pa.array(k)], names=["family", "token", "k"])

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 4, SLICE)):
            deltas = []
            for tokens, centre in zip(part.column(4), part.column(5)):
                a = read(tokens.as_py()).view(np.int64)
                delta = np.setxor1d(a, centre.values.to_numpy() if centre.is_valid else a[:0])
                deltas.append(delta if 2 * len(delta) <= len(a) else None)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(deltas, type=pa.list_(pa.int64()))], names=["family", "cls", "n", "label", "delta"])

    wanted = stage.save("wanted", named.select("cls", "one").join(kin.select("cls").distinct(), "cls"))
    sets = stage.save("sets", whole_sets(docs, wanted, size))
    both = kin.join(sets, "cls")
    counts = both.select("family", "tokens").mapInArrow(counted, "family long, token long, k long").groupBy("family", "token").agg(F.sum("k").alias("k"))
    counts = counts.join(kin.groupBy("family").agg(F.count(F.lit(1)).alias("all")), "family").filter("2 * k > all")
    centres = stage.save("centres", counts.groupBy("family").agg(F.collect_list("token").alias("centre")))
    rows = both.join(centres, "family", "left").select("family", "cls", "n", "label", "tokens", "centre")
    rows = rows.mapInArrow(differences, "family long, cls long, n long, label long, delta array<long>")
    rows = stage.save("kin", rows)
    settle(docs.sparkSession)
    return rows


def relatives(kin: DataFrame, percent: int, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(u, v) of links and (u, v) of pairs that may link, among the classes of a family that have deltas.

    Two sets link if ``(100 + percent) * differing <= (100 - percent) * (m + n)``. With ``cost`` of a set
    ``(100 + percent) * size(delta) - (100 - percent) * n``, they link if their costs add up to 0 or less, and else
    must have ``shared`` shingles of their deltas in common. Those are looked for among the rarest of each delta, which
    are as many as leave less than ``shared`` over.
    """
    cost = F.expr(f"{100 + percent} * size(delta) - {100 - percent} * n").alias("cost")
    near = kin.filter("delta IS NOT NULL").select("*", F.size("delta").cast("long").alias("most"), cost)
    best = near.groupBy("family").agg(F.min(F.struct("cost", "cls", "label")).alias("best"))
    near = near.join(best, "family")
    # What links with any class by cost links with the best.
    by_cost = F.expr("cost + best.cost <= 0")
    links = near.filter(by_cost & F.expr("label <> best.label")).select(F.col("best.cls").alias("u"), F.col("cls").alias("v"))
    side = F.when(by_cost, F.col("best.label")).otherwise(F.col("label")).alias("side")
    near = near.select("family", "cls", "n", "delta", "most", "cost", side, F.col("best.label").alias("top"))
    near = stage.save("near", near)
    posts = near.select("family", "cls", F.explode("delta").alias("token"))
    frequent = posts.groupBy("family", "token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    posts = posts.join(frequent, ["family", "token"], "left").groupBy("family", "cls")
    posts = posts.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("k", F.lit(1)).alias("k"), "token"))).alias("posts"))
    posts = near.drop("delta").join(posts, ["family", "cls"]).select("*", F.posexplode("posts").alias("place", "post"))
    posts = posts.filter("post.k > 1").select("family", "cls", "n", "most", "cost", "side", "top", "place", "post.token")
    posts = stage.save("deltas", posts)
    a, b = posts.filter("side <> top").alias("a"), posts.alias("b")
    fresh = F.expr("a.side <> b.side AND (b.side = b.top OR a.cls < b.cls)") & F.expr(sizes("a", "b", percent))
    shared = f"greatest(1L, (a.cost + b.cost + {2 * (100 + percent) - 1}) div {2 * (100 + percent)})"
    rare = F.expr(f"a.place <= a.most - {shared} AND b.place <= b.most - {shared}")
    pairs = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.token") == F.col("b.token"))).filter(fresh & rare)
    return links, pairs.select(F.col("a.cls").alias("u"), F.col("b.cls").alias("v")).distinct()


def classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, cls, n) of every row, and (node, label) of the classes that link with another."""
    stage = Stage(docs.sparkSession)
    levels = list_lengths(docs, size, stage)
    head = stage.save("heads", heads(docs, levels, size, percent))
    posts = head.select("doc_id", "cls", "n", F.explode("short").alias("post")).select("doc_id", "cls", "n", "post.*")
    # Lists of one class only are of no use; copies of a set are one class.
    ends = posts.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi")
    ends = stage.save("shared", ends.select("token"))  # stored, so that the join with it can split a frequent shingle
    settle(docs.sparkSession)
    posts = posts.select("cls", "token", "n").join(ends, "token").distinct()
    posts = stage.save("posts", posts)
    some = posts.select("cls").distinct()
    named = head.filter("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    named = stage.save("named", named.join(some, "cls", "left_semi"))
    settle(docs.sparkSession)
    # Few lists are longer than a stretch, so the lists need no shuffle to learn it.
    long = posts.groupBy("token").agg(F.count(F.lit(1)).alias("length")).filter(F.col("length") > STRETCH)
    long = stage.save("long", long)
    rows = stage.save("rows", head.drop("short", "bits"))
    discard(stage, ("rows", "named", "posts", "long"))
    settle(docs.sparkSession)
    near = neighbours(posts, long, percent).distinct()
    a, b = (named.select(F.col("cls").alias(c), F.struct("n", "bits").alias(s)) for c, s in (("u", "a"), ("v", "b")))
    near = near.join(a, "u").join(b, "v").filter(possible("a", "b", percent))
    # The fewer bits differ, the more promising the pair.
    share = F.struct((differ("a", "b") / (F.col("a.n") + F.col("b.n"))).alias("share"), "v")
    best = near.groupBy("u", "k").agg(F.min(share).alias("best")).select("u", F.col("best.v").alias("v")).distinct()
    links = probed(docs, named, best, size, percent, stage)
    labels = stage.save("labels", components(links, stage))
    settle(docs.sparkSession)
    # Lists with one component have nothing to add; in the others, all but the largest component ask.
    members = labelled(posts, labels)
    counts = members.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = counts.groupBy("token").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("k").alias("length")).filter("labels > 1")
    mixed = stage.save("tops", mixed.select("token", F.col("top.label").alias("top"), (F.col("length") > LARGE).alias("large")))
    members = members.join(mixed, "token").select("cls", "n", "token", "label", "top", "large")
    kin = stage.save("families", members.filter("large").select(F.col("top").alias("family"), "cls", "n", "label").distinct())
    kin = families(docs, named, kin, size, stage)
    by_delta, close = relatives(kin, percent, stage)
    far = kin.filter("delta IS NULL").select(F.col("family").alias("top"), "cls", F.lit(True).alias("far"))
    members = members.join(far, ["top", "cls"], "left")
    asks = F.expr("if(large, far IS NOT NULL, label <> top)").alias("asks")
    members = members.select("cls", "n", "token", "label", asks)
    members = stage.save("mixed", members.join(named.select("cls", "bits"), "cls"))
    settle(docs.sparkSession)
    a, b = members.filter("asks").alias("a"), members.alias("b")
    fresh = F.expr("a.label <> b.label AND (NOT b.asks OR a.cls < b.cls)")
    pairs = a.join(b, F.col("a.token") == F.col("b.token")).filter(fresh & possible("a", "b", percent))
    # A pair that may link meets in all the short lists it shares, so its meetings are counted.
    met = pairs.groupBy(F.col("a.cls").alias("u"), F.col("b.cls").alias("v"), F.col("a.n").alias("m"), F.col("b.n").alias("n")).count()
    met = met.filter(F.expr(f"count >= {short_common('m', 'n', percent)}")).select("u", "v")
    a, b = (named.select(F.col("cls").alias(c), F.struct("n", "bits").alias(s)) for c, s in (("u", "a"), ("v", "b")))
    met = met.unionByName(close.join(a, "u").join(b, "v").filter(possible("a", "b", percent)).select("u", "v"))
    links = links.unionByName(by_delta).unionByName(probed(docs, named, met, size, percent, stage))
    labels = stage.save("groups", components(links, stage))
    discard(stage, ("rows", "groups"))
    settle(docs.sparkSession)
    return rows, labels


def labelled(posts: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias("cls"), F.col("label").alias("found"))
    return posts.join(named, "cls", "left").withColumn("label", F.coalesce("found", "cls")).drop("found")


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n, label: rows of one label are connected; a set without partners has its copies."""
    rows, labels = classes(docs, size, percent)
    rows = rows.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left")
    return rows.select("doc_id", "text_hash", "n", F.coalesce("label", "cls").alias("label"))


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of ``docs``."""
    rows = grouped(docs, size, percent)
    least = rows.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    rows = rows.join(least, "label", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def deduplicate(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row of each group of linked documents, that with the smallest id (null ids last); columns unchanged.

    Of repeated rows one stays; rows without a set are linked with nothing and all stay.
    """
    rows = grouped(docs, size, percent)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")
    kept = rows.filter("n > 0").groupBy("label").agg(one).select("one.doc_id", "one.text_hash", F.lit(True).alias("single"))
    kept = kept.unionByName(rows.filter("n = 0").select("doc_id", "text_hash", F.lit(False).alias("single")).distinct())
    kept = kept.toDF("_id", "_hash", "_single")
    df = docs.withColumn("_text_hash", text_hash())
    df = df.join(kept, (F.col("_text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    place = F.row_number().over(Window.partitionBy("_text_hash", "doc_id").orderBy(F.lit(1)))
    df = df.withColumn("_place", place).filter("NOT _single OR _place = 1")
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
