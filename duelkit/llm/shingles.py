"""Near-duplicates by circulant MinHash: signatures, banding, exact Jaccard verification, and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, parts, release
from .tokens import chunks, grams, mix, sets, utf8, words

SHINGLE = 5
#: 30 bands of 4 coordinates: a pair of similarity 0.85 meets in no band once in 4e9 times, one of 0.8 once in 7e6.
BANDS, ROWS = 30, 4
#: Documents of a bucket, and of one class of sizes in it, that one task compares with others; larger ones are split.
CROWD = 500
#: Bits of a set's bitmap.
BITS = 1024
NO_ID = (1 << 63) - 1
_U32 = np.uint32


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers."""
    x = x * _U32(a)
    x ^= x >> _U32(15)
    x *= _U32(b)
    x ^= x >> _U32(13)
    return x


def signatures(values: np.ndarray, offsets: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of non-empty sets of 64-bit shingle hashes, one row a set.

    The first permutation sends a shingle to its place on a circle of 2^32; coordinate k turns the circle by k steps
    of a fixed odd width and takes the least value of the second permutation over the set."""
    place = _permute((values >> np.uint64(32)).astype(_U32), 0x85EBCA6B, 0xC2B2AE35)
    out = np.empty((len(offsets) - 1, coordinates), dtype=_U32)
    for k in range(coordinates):
        turned = place - _U32(k * 0x9E3779B1 & 0xFFFFFFFF)
        out[:, k] = np.minimum.reduceat(_permute(turned, 0x7FEB352D, 0x846CA68B), offsets[:-1])
    return out


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    return sets(*grams(*words(flat, offsets), shingle))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in parts(batches, "text"):
        flat, offsets = utf8(batch["text"])
        for a, b in chunks(offsets):
            values, at = shingle_sets(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            size = np.diff(at)
            some = np.flatnonzero(size)
            keys = np.zeros((b - a, 2), np.uint64)
            bands = np.zeros((len(some), BANDS), np.uint64)
            if len(some):
                starts = np.append(at[:-1][some], at[-1])
                for i, salt in enumerate((0x51, 0xA3)):  # 128 bits that name the whole set
                    keys[some, i] = np.add.reduceat(mix(values + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), starts[:-1])
                rows = signatures(values, starts).astype(np.uint64).reshape(len(some), BANDS, ROWS)
                bands += np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for r in range(ROWS):
                    bands = mix(bands * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, r])
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(a, b - a), batch["doc"].slice(a, b - a), pa.array(size, pa.int64()), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel().view(np.int64)))],
                names=["doc_id", "doc", "n_shingles", "key1", "key2", "bands"],
            )


def bitmaps(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set, for each of ``BITS`` classes of hashes the parity of their number, as words of 64 bits. Two sets' bitmaps
    differ in no more bits than the sets differ in members."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros((len(offsets) - 1, BITS // 64), np.uint64)
    np.bitwise_xor.at(out, (row, (values >> np.uint64(6)).astype(np.int64) % (BITS // 64)), np.uint64(1) << (values & np.uint64(63)))
    return out


MAPS = [f"map{i:02}" for i in range(BITS // 64)]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> their sorted shingle hashes and bitmaps."""
    for batch in parts(batches, "text"):
        flat, offsets = utf8(batch["text"])
        for a, b in chunks(offsets):
            values, at = shingle_sets(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            maps = bitmaps(values, at).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc"].slice(a, b - a), lists, *(pa.array(maps[:, i]) for i in range(maps.shape[1]))], names=["doc", "shingles", *MAPS])


def _confirmed(threshold: int):
    """Pairs with both sets -> the pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for x, y in zip(batch["a_set"], batch["b_set"], strict=True):
                one, two = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(one, two, assume_unique=True))
                got.append(100 * both >= threshold * (len(one) + len(two) - both))
            keep = pa.array(got, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return run


def _verified(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            left, right = utf8(batch["a_text"]), utf8(batch["b_text"])
            memo: tuple = (None, None)
            for i, b in enumerate(batch["b"].to_pylist()):
                mine = shingle_sets(left[0][left[1][i] : left[1][i + 1]], np.array([0, left[1][i + 1] - left[1][i]]))[0]
                if memo[0] != b:  # rows come sorted by b, the hub of its pairs
                    memo = (b, shingle_sets(right[0][right[1][i] : right[1][i + 1]], np.array([0, right[1][i + 1] - right[1][i]]))[0])
                both = len(np.intersect1d(mine, memo[1], assume_unique=True))
                got.append(100 * both >= threshold * (len(mine) + len(memo[1]) - both))
            keep = pa.array(got, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of ids with 100 * intersection >= threshold * union on their full shingle sets. ``texts``: (doc, text)."""
    one = texts.select(F.col("doc").alias("a"), F.col("text").alias("a_text"))
    two = texts.select(F.col("doc").alias("b"), F.col("text").alias("b_text"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "a_text", "b_text").sortWithinPartitions("b").mapInArrow(_verified(threshold), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) of every linked document: the least id that it reaches.

    Least labels travel along links, then labels follow their own labels, until none changes; each round is a few
    joins on ids, written to the shared folder. Nothing but a count comes to the driver."""
    links = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = kept(links.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "label")
    while True:
        near = links.join(label.select(F.col("doc").alias("b"), "comp"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("comp").alias("near"))
        low = label.join(near, "doc").select("doc", F.col("comp").alias("was"), F.least("comp", "near").alias("to"))
        jump = label.select(F.col("doc").alias("to"), F.col("comp").alias("far"))
        after = kept(low.join(jump, "to").select("doc", "was", F.least("to", "far").alias("comp")), "label")
        changed = after.where("comp < was").limit(1).count()
        label = after.select("doc", "comp")
        if not changed:
            return label


def _open(told: DataFrame) -> DataFrame:
    """Rows (band, doc, n, comp, ...) of the buckets that hold several components; ``told`` is a written table. What is joined is
    written first, so that a crowded bucket's side of the join can be split."""
    several = kept(told.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band"), "open")
    return told.join(several, "band")


def _held(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc, kind, df, weight) of ``docs`` (doc, n, comp): how many of a document's shingles are of a kind. Shingles that exactly the
    same documents hold are of one kind, as those of a common passage; shingles that only one component holds aren't here."""
    own = sets.join(docs.select("doc", "comp"), "doc").select("doc", "comp", F.explode("shingles").alias("shingle"))
    holders = [F.bit_xor(F.xxhash64("doc", F.lit(i))) for i in (1, 2)]
    kinds = own.groupBy("shingle").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *[h.alias(f"h{i}") for i, h in enumerate(holders)]).where("lo < hi")
    kinds = kinds.select("shingle", "df", F.struct("df", "h0", "h1").alias("kind"))
    return own.join(kinds, "shingle").groupBy("doc", "kind", "df").agg(F.count("*").alias("weight"))


def _needed(n: str, threshold: int) -> Column:
    """The least overlap that a set of ``n`` shingles has with any set it is linked with."""
    return F.ceil(F.col(n) * threshold / 100).cast("long")


def _across(docs: DataFrame, sets: DataFrame, threshold: int, rounds: int = 2) -> DataFrame:
    """Pairs (a, b) of ``docs`` (doc, n, comp) of different components that can be linked, exactly: no linked pair is missing.

    1. A link shares none of the shingles that only one component holds. Documents with too many of these can't have one and
       go; then fewer shingles are shared, so it is done again.
    2. A prefix filter: of all shingles in one order, those of one component first, then rare kinds before frequent ones, two
       linked documents share one among the first n - needed + 1 of each. Kinds stand for their shingles, so two texts meet
       once for a passage, and not once for each of its shingles.
    3. Documents that meet are compared by sizes and bitmaps: their sets differ in as many members at least as their bitmaps
       in bits. What is left are links and few others.

    Documents of a kind are dealt by classes of sizes: a link is possible within a class and with the next one only. A class
    of more than ``CROWD`` is split, and each part meets copies of the others, so no task holds a whole one."""
    for i in range(rounds):
        held = kept(_held(docs, sets), "held")
        shared = held.groupBy("doc").agg(F.sum("weight").alias("shared"))
        docs = kept(docs.select("doc", "n", "comp").join(shared, "doc").where(F.col("shared") >= _needed("n", threshold)), "active")
        if i + 1 == rounds:
            held = held.join(docs, "doc")
    before = Window.partitionBy("doc").orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("n") - F.col("shared") + F.coalesce(F.sum("weight").over(before), F.lit(0))
    first = held.withColumn("place", place).where(F.col("place") <= F.col("n") - _needed("n", threshold)).select("doc", "n", "comp", "kind")
    width = max(math.log(100 / threshold), 1e-3) + 1e-9
    one = kept(first.withColumn("class", F.floor(F.log("n") / width).cast("int")).join(sets.select("doc", *MAPS), "doc"), "prefixes")
    crowds = kept(one.groupBy("kind", "class").agg(F.ceil(F.count("*") / CROWD).cast("long").alias("parts")).where("parts > 1"), "crowds")
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    two = one.withColumn("class", near).select("kind", "class", *[F.col(c).alias(c + "2") for c in ("doc", "n", "comp", *MAPS)])
    count = F.coalesce("parts", F.lit(1))
    one = one.join(crowds, ["kind", "class"], "left").withColumn("part", F.pmod(F.xxhash64("doc"), count)).drop("parts")
    two = two.join(crowds, ["kind", "class"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), count - 1))).drop("parts")
    apart = F.lit(0)
    for m in MAPS:
        apart = apart + F.bit_count(F.col(m).bitwiseXOR(F.col(m + "2")))
    # overlap is half of n + n2 - difference at most
    allowed = (F.col("doc") < F.col("doc2")) & (F.col("comp") != F.col("comp2")) & ((200 + 2 * threshold) * (F.col("n") + F.col("n2") - apart) >= 4 * threshold * (F.col("n") + F.col("n2")))
    return one.join(two, ["kind", "class", "part"]).where(allowed).select(F.col("doc").alias("a"), F.col("doc2").alias("b")).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs that are linked, by their kept sets."""
    side = lambda c: sets.select(F.col("doc").alias(c), F.col("shingles").alias(f"{c}_set"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(_confirmed(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    A document's set is its distinct 5-word shingles (words split at ASCII blanks, A-Z lower-cased); with fewer words the
    whole sequence is its one shingle; null text and text without words have none and are linked with nothing. Documents
    with 100 * intersection >= threshold * union are linked; ``component_id`` is the least id reachable.

    1. Every text's circulant signature gives 30 band keys; equal sets collapse to their least id, so copies cost no pair.
    2. In each band bucket every document is compared with the bucket's most central one (largest sum of bucket sizes):
       pairs grow with documents, not with squares. Links are verified on full sets; components follow.
    3. Documents of buckets that still hold several components are compared across components, by an exact prefix filter over
       their shingles and by bitmaps (:func:`_across`), which leaves few pairs; they are verified on their sets, kept once.

    What is linked are texts, told apart by 64 bits of hash (two of 10^9 texts meet with a chance of 3 %), and sets, equal if
    128 bits of hash and their sizes are. So rows that share an id, repeated rows and rows without an id are all linked by their texts.
    ``component_id`` is the least id of any row of the component, and null if no row of it has one; then ``kept`` is one of its
    rows. Rows without an id are not kept beside rows that have one. ``text_key`` is the text's hash (null text: null), by
    which rows of one id can be told apart. Other columns are not read. An empty table gives none.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(text).alias("doc"))
    signed = kept(rows.mapInArrow(_signed, "doc_id long, doc long, n_shingles long, key1 long, key2 long, bands array<bigint>").withColumn("row", F.monotonically_increasing_id()), "signed")
    key = ["key1", "key2", "n_shingles"]
    rid = F.coalesce("doc_id", F.lit(NO_ID))
    first = kept(signed.where("n_shingles > 0").groupBy(*key).agg(F.min(F.struct(rid.alias("rid"), "doc", "row")).alias("r"), F.min("doc_id").alias("least_id"), F.min("row").alias("least_row")).select(*key, F.col("r.doc").alias("rep"), "r.rid", F.col("r.row").alias("rep_row"), "least_id", "least_row"), "sets")
    member = signed.select("doc_id", "doc", "row", *key).join(first.select(*key, "rep"), key, "left")
    nodes = signed.join(first.select(F.col("rep_row").alias("row")), "row", "left_semi").select("doc", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    # counts and hubs of buckets are written first: joins with a crowded bucket can then be split
    several = kept(nodes.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "several")
    live = kept(nodes.join(several, "band"), "buckets")
    weight = live.groupBy("doc").agg(F.sum("size").alias("weight"))
    hub = kept(live.join(weight, "doc").groupBy("band").agg(F.max_by("doc", F.struct("weight", -F.col("doc"))).alias("hub")), "hubs")
    near_size = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * threshold
    sizes = live.select(F.col("doc").alias("hub"), F.col("n").alias("n2")).distinct()
    star = live.join(hub, "band").where("doc <> hub").select("doc", "hub", "n").distinct().join(sizes, "hub").where(near_size).select(F.col("doc").alias("a"), F.col("hub").alias("b"))
    # by id and text, as copies of one text may be very many
    wanted = live.select("doc").distinct().join(first.select(F.col("rep").alias("doc"), "rid"), "doc")
    texts = kept(rows.select(rid.alias("rid"), "doc", "text").join(wanted, ["rid", "doc"], "left_semi").dropDuplicates(["rid", "doc"]).select("doc", "text"), "texts")
    links = kept(verify(star, texts, threshold), "links")
    comp = components(links)

    told = kept(live.join(comp, "doc", "left").select("band", "doc", "n", F.coalesce("comp", "doc").alias("comp")), "told")
    crossing = kept(_open(told).select("doc", "n", "comp").distinct(), "open")
    if crossing.limit(1).count():
        shingle_lists = kept(texts.join(crossing.select("doc"), "doc", "left_semi").mapInArrow(_sets, "doc long, shingles array<bigint>, " + ", ".join(f"{m} long" for m in MAPS)), "shingles")
        more = kept(_confirm(_across(crossing, shingle_lists, threshold), shingle_lists, threshold), "links")
        if more.limit(1).count():
            comp = components(links.unionByName(more))
    label = first.join(comp.select(F.col("doc").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    least = label.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.min("least_row").alias("least_row"))
    out = member.join(label.join(least.withColumnRenamed("least_row", "first_row"), "comp").select("rep", "component_id", "first_row", F.lit(True).alias("linked")), "rep", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id"))
    stays = F.when(F.col("linked").isNull(), True).when(F.col("component_id").isNull(), F.col("row") == F.col("first_row")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), stays.alias("kept"), F.col("doc").alias("text_key"))


def text_key(text: str) -> Column:
    return F.when(F.col(text).isNotNull(), F.xxhash64(text))
