"""Document fingerprints of closed syncmers, by DataFrame functions only.

The letters are words, ``[^\\x20\\x09-\\x0D]``, of at most 16 characters; a longer one, as text without blanks is, has each of its
characters as a letter, so that no letter depends on where a long run begins. A k-mer of K letters is chosen if the least of
its S-mers (by hash) is its first or its last. That depends on the k-mer alone, so equal passages choose equal anchors
wherever they stand."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, let

K, S = 10, 3
LETTER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,16}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"
#: Text bytes of a bucket of neighbouring ids, about, and the most cuts between ids: from 400 GB on, buckets grow with the
#: input (1 GB at 100 TB); a bucket is sorted with spilling, so that costs parallel tasks but no memory.
BUCKET_BYTES, MAX_CUTS = 4_000_000, 100_000
LAST = -(1 << 63)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (pos, hash), in order: the chosen k-mers' letter positions from 1 and hashes. A text of fewer than ``k``
    letters has one anchor of all its letters; null text and text without letters have none. Whole texts are read."""
    letters = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LETTER), F.lit(0)), lambda w: F.xxhash64(w))

    def chosen(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        wide = k - s + 1

        def closed(m: Column) -> Column:
            found = F.filter(F.sequence(F.lit(1), F.size(h) - k + 1), lambda i: let(F.array_min(F.slice(m, i, wide)), lambda low: (F.get(m, i - 1) == low) | (F.get(m, i + wide - 2) == low)))
            return F.transform(found, lambda i: anchor(i, F.slice(h, i, k)))

        return let(inner, closed)

    def anchor(pos: Column, mer: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), F.xxhash64(mer).alias("hash"))

    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return let(letters, lambda h: F.when(F.size(h) >= k, chosen(h)).when(F.size(h) > 0, F.array(anchor(F.lit(1), h))).otherwise(none))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the distinct anchor hashes; 1 if neither text has any."""
    both = F.size(F.array_intersect(a["hash"], b["hash"]))
    return F.coalesce(both / F.nullif(F.size(F.array_union(a["hash"], b["hash"])), F.lit(0)), F.lit(1.0))


def written(a: Column) -> Column:
    """A fingerprint as text: position and hash of each anchor, in hexadecimal."""
    return F.array_join(F.transform(a, lambda x: F.concat(F.hex(x["pos"]), F.lit(":"), F.lower(F.hex(x["hash"])))), " ")


def _numbers(values: list[int]) -> Column:
    """An array of constants as one text, which the optimizer reads once: a plan doesn't grow by a node for each."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _below(cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are less than ``at``: a search in steps of the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    ends = cuts[step - 1 :: step]
    coarse = F.size(F.filter(_numbers(ends), lambda c: c < F.col("at"))) * step
    return let(coarse, lambda n: n + F.size(F.filter(F.slice(_numbers(cuts), n + 1, step), lambda c: c < F.col("at"))))


def neighbours() -> Window:
    """Documents of a bucket in descending order of ids, ghosts last."""
    return Window.partitionBy("bucket", "part").orderBy("ghost", F.desc("at"), "h", "text")


def _rows(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) dealt into buckets, so that ``lead`` over :func:`neighbours` is the next document in descending
    order of ids (ties: by a hash of the text, then text; null ids last; after the last: the first). Rows with ``ghost`` are
    to be dropped then. A row with ``copies`` > 1 stands for so many equal rows.

    Ids are cut into buckets at quantiles. An id whose rows are more than a bucket has one of its own, in parts by the text's
    hash; rows equal in id and text that are more than a bucket go as one row with their number. The first document of a
    bucket also goes, as a ghost, to the end of the bucket above, and the first of all to the end of the lowest. So no window
    is global or holds a crowded id, and texts are exchanged once. What comes to the driver is a row for each bucket.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"))
    texts = kept(keyed.groupBy("at", "h").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 1).alias("bytes")), "texts")
    total = int(texts.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    room = max(bucket_bytes, -(-total // MAX_CUTS))
    crowds = kept(texts.where((F.col("bytes") > room) & (F.col("n") > 1)).select("at", "h", "n"), "crowds")  # total / room at most
    each = texts.join(F.broadcast(crowds.withColumn("crowd", F.lit(True)).drop("n")), ["at", "h"], "left").withColumn("bytes", F.when(F.col("crowd"), F.col("bytes") / F.col("n")).otherwise(F.col("bytes")))
    hot = {r["at"]: int(r["parts"]) for r in each.groupBy("at").agg(F.ceil(F.sum("bytes") / room).alias("parts"), F.count("*").alias("n")).where("parts > 1 and n > 1").collect()}
    cuts: set[int] = set()
    if total > room:
        buckets = -(-total // room)
        cuts = set(texts.agg(F.percentile_approx("at", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0])
    for at in hot:
        cuts.update({at, max(at - 1, LAST)})
    bucket = _below(sorted(cuts))
    parts = _rows(spark, [{"at": a, "parts": n} for a, n in hot.items()], "at:bigint,parts:bigint")
    wide = lambda df: df.join(F.broadcast(parts), "at", "left").withColumns({"bucket": bucket, "part": F.coalesce(F.floor(F.col("h") / float(1 << 63) * F.col("parts")).cast("long"), F.lit(0).cast("long"))}).drop("parts")
    tops = wide(texts).groupBy("bucket", "part").agg(F.max(F.struct("at", (-F.col("h")).alias("h"))).alias("top")).select("bucket", "part", "top.at", (-F.col("top.h")).alias("h")).collect()
    tops.sort(key=lambda r: (-r["bucket"], r["part"]))  # from the highest ids on
    ghosts = [{"at": r["at"], "h": r["h"], "to_bucket": up["bucket"], "to_part": up["part"]} for r, up in zip(tops, tops[-1:] + tops[:-1], strict=True)]

    in_crowd = F.broadcast(crowds.drop("n"))
    one = keyed.join(in_crowd, ["at", "h"], "left_semi").groupBy("at", "h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    rows = keyed.join(in_crowd, ["at", "h"], "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(one)
    placed = wide(rows).join(F.broadcast(_rows(spark, ghosts, "at:bigint,h:bigint,to_bucket:int,to_part:bigint")), ["at", "h"], "left")
    own = F.struct("bucket", "part", F.lit(False).alias("ghost"))
    there = F.struct(F.col("to_bucket").alias("bucket"), F.col("to_part").alias("part"), F.lit(True).alias("ghost"))
    return placed.select("doc_id", "text", "at", "h", "copies", F.inline(F.when(F.col("to_bucket").isNull(), F.array(own)).otherwise(F.array(own, there))))


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """One row per document: ``doc_id, text, n_chars, anchors`` and those of its edited text, whose last half is the next
    document's start (``next_text``, ``next_anchors``, ``edited``, ``edited_anchors``).

    Null text counts as empty. Repeated rows and rows of one id follow each other in the order of their texts; rows without
    an id come last. Other columns are not read. An empty table gives none; one document alone is next to itself.
    """
    pairs = with_next(docs.select("doc_id", "text")).withColumn("next_text", F.lead("text").over(neighbours()))
    made = pairs.withColumn("anchors", anchors(F.col("text"), k, s)).withColumn("next_anchors", F.lead("anchors").over(neighbours())).where("not ghost")
    # of equal rows in a crowd all but the last are followed by another of them
    follower = lambda n, t, a: F.struct(n.alias("times"), t.alias("next_text"), a.alias("next_anchors"))
    last = follower(F.lit(1).cast("long"), F.col("next_text"), F.col("next_anchors"))
    again = follower(F.col("copies") - 1, F.col("text"), F.col("anchors"))
    made = made.select("doc_id", "text", "anchors", F.inline(F.when(F.col("copies") > 1, F.array(last, again)).otherwise(F.array(last))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    made = made.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_anchors", anchors(F.col("edited"), k, s))
    return made.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_copy", "times")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    return fingerprints(docs).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("anchors")).alias("fingerprint"), written(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
