"""Line deduplication by pairwise alignment: overlapping documents are found by shared rare line hashes, aligned by
patience diff, and common blocks are deleted from the later document."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, let, parts, release
from .tokens import chunks, mix, sets, spans, utf8

#: Words that a common block must have if many documents share it. Chance does not repeat so many, and boilerplate lines
#: are shorter.
MIN_WORDS = 20
#: Words that a rare common block must have, and the most documents that hold a rare one.
RARE_WORDS, RARE_DOCS = 5, 10
#: Kinds of anchors, in the two low bits of their hashes.
LONG, RARE, WHOLE = 0, 1, 2
#: So many of the most frequent runs are looked up by a broadcast, so that none of them is a crowded key of a join.
FREQUENT = 1000
#: Rows that share runs with one earlier row, for each copy of that row's lines; more are dealt to several copies.
FAN = 1000


def _split(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and words of all lines, and the offsets of the rows in them (a row has one line more than line feeds).

    Lines are compared by their words: case of A-Z and blanks don't count."""
    hashes, starts, _, _ = spans(flat, offsets)
    feeds = np.flatnonzero(flat == 10)
    rows = len(offsets) - 1
    begins = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    # a row's own start comes before a line start at the same byte of an empty row before it, which no feed makes
    first = np.searchsorted(starts, begins)
    last = np.append(first[1:], len(starts))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + (np.arange(len(hashes), dtype=np.uint64) - np.repeat(first, last - first).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    at = np.arange(rows + 1) + np.searchsorted(feeds, offsets)
    return mix(sums[last] - sums[first]), last - first, at


def _runs(hashes: np.ndarray, words: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """For each line that has words: the hash of the shortest run of lines from it on with ``least`` words; else 0."""
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + least)
    whole = (end <= np.repeat(offsets[1:], np.diff(offsets))) & (words > 0)
    factor = np.uint64(0x9FB21C651E98DF25)
    out = np.zeros(len(hashes), np.uint64)
    todo = np.flatnonzero(whole)
    step = 0
    while len(todo):
        line = todo + step
        out[todo] = np.where(words[line] > 0, mix(out[todo] * factor + hashes[line]), out[todo])
        step += 1
        todo = todo[todo + step < end[todo]]
    out[whole & (out == 0)] = 1
    return out


def _rare(hashes: np.ndarray, words: np.ndarray, offsets: np.ndarray, least: int, rare: int) -> np.ndarray:
    """As ``_runs`` with ``rare`` words, without the runs that have ``least``: those are anchors anyhow."""
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.minimum(np.searchsorted(total, total[:-1] + rare), len(words))
    return np.where(total[end] - total[:-1] < least, _runs(hashes, words, offsets, rare), np.uint64(0))


def _whole(hashes: np.ndarray, words: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """The hash of all lines that have words, for each row of less than ``least`` words (but one at least); else 0."""
    solid = words > 0
    count = np.concatenate([[0], np.cumsum(solid)])
    place = (count[:-1] - np.repeat(count[offsets[:-1]], np.diff(offsets))).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(solid, mix(hashes + place * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0)), dtype=np.uint64)])
    total = np.concatenate([[0], np.cumsum(words)])[offsets]
    size = np.diff(total)
    return np.where((size > 0) & (size < least), mix(np.diff(sums[offsets])), np.uint64(0))


def _tagged(hashes: np.ndarray, kind: int) -> np.ndarray:
    """The hashes with their kind in the two low bits; 0 (no anchor) stays."""
    return np.where(hashes == 0, hashes, hashes & np.uint64(2**64 - 4) | np.uint64(kind))


def _lines(least: int, rare: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in parts(batches, "text"):
            flat, offsets = utf8(batch["text"])
            for a, b in chunks(offsets):
                hashes, words, at = _split(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                each = [_tagged(_runs(hashes, words, at, least), LONG), _tagged(_rare(hashes, words, at, least, rare), RARE), _tagged(_whole(hashes, words, at, least), WHOLE)]
                row = np.repeat(np.arange(b - a), np.diff(at))
                row, keys = np.concatenate([row, row, np.arange(b - a)]), np.concatenate(each)
                row, keys = row[keys != 0], keys[keys != 0]
                order = np.argsort(row, kind="stable")
                anchors, ends = sets(keys[order], np.searchsorted(row[order], np.arange(b - a + 1)))
                lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(x)) for e, x in ((at, hashes.view(np.int64)), (at, words.astype(np.int32)), (ends, anchors.view(np.int64)))]
                yield pa.RecordBatch.from_arrays([batch["row_key"].slice(a, b - a), *lists], names=["row_key", "lines", "words", "anchors"])

    return run


def rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence (patience sorting)."""
    piles: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        p = bisect_left(piles, v)
        back.append(tops[p - 1] if p else -1)
        if p == len(piles):
            piles.append(v)
            tops.append(i)
        else:
            piles[p], tops[p] = v, i
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_blocks(old: list[int], old_runs: list[int], new: list[int], new_runs: list[int], words: list[int], least: int, gone: set[int]) -> None:
    """Adds to ``gone`` the lines of ``new`` in blocks of at least ``least`` words that it has in common with ``old``.

    Patience diff on the runs that both have: the n-th open copy of a run in one stands for its n-th copy in the other,
    so anchors are unique; a longest rising subsequence of them is kept and each anchor grows up and down over equal
    lines. The rest is aligned again, so moved and repeated blocks go too; once a pass leaves most of its runs open (few old
    copies, many new ones), each that is left grows from its first old copy in turn. Time is n log n in lines."""
    places: dict[int, list[int]] = {}
    for i, r in enumerate(old_runs):
        if r:
            places.setdefault(r, []).append(i)
    total = [0, *accumulate(words)]
    ends = [bisect_left(total, t + least, i + 1) for i, t in enumerate(total[:-1])]  # of the run that starts at a line
    is_open = lambda i: i not in gone and gone.isdisjoint(range(i, ends[i]))

    def grow(i: int, j: int) -> None:
        lo, hi, shift = i, ends[i], j - i
        while lo > 0 and lo - 1 + shift >= 0 and lo - 1 not in gone and new[lo - 1] == old[lo - 1 + shift]:
            lo -= 1
        while hi < len(new) and hi + shift < len(old) and hi not in gone and new[hi] == old[hi + shift]:
            hi += 1
        gone.update(range(lo, hi))

    starts = [i for i, r in enumerate(new_runs) if r in places and is_open(i)]
    while starts:
        seen: dict[int, int] = {}
        here, there = [], []
        for i in starts:
            k = seen[new_runs[i]] = seen.get(new_runs[i], -1) + 1
            if k < len(places[new_runs[i]]):
                here.append(i)
                there.append(places[new_runs[i]][k])
        for p in rising(there):
            grow(here[p], there[p])
        left = [i for i in starts if is_open(i)]
        if 2 * len(left) > len(starts):
            for i in left:
                if is_open(i):
                    grow(i, places[new_runs[i]][0])
            return
        starts = left


def _cut(old: tuple[list[int], ...], new: tuple[list[int], ...], words: list[int], marks: list[int], least: int, rare: int) -> list[int]:
    """Lines of ``new`` that ``old`` has: blocks of ``least`` words, then those of ``rare`` words at rare runs in ``marks``;
    all if the rows are equal. Each row is (lines, runs, rare runs)."""
    gone: set[int] = set()
    common_blocks(old[0], old[1], new[0], new[1], words, least, gone)
    known = set(marks)
    if known:
        common_blocks(old[0], [r if r in known else 0 for r in old[2]], new[0], [r if r in known else 0 for r in new[2]], words, rare, gone)
    if any(r & 3 == WHOLE for r in known):
        lines = set(old[0])
        gone.update(i for i, x in enumerate(new[0]) if x in lines)
    return sorted(gone)


def _sides(hashes: pa.ListArray, words: pa.ListArray, least: int, rare: int) -> Iterator[tuple[list[int], ...]]:
    """For each row: its lines, runs and rare runs (both made again rather than joined)."""
    at = hashes.offsets.to_numpy().astype(np.int64)
    values, sizes = (x.values.to_numpy()[at[0] : at[-1]] for x in (hashes, words))
    at = at - at[0]
    sizes = sizes.astype(np.int64)
    found = [values, *(x.view(np.int64) for x in (_runs(values.view(np.uint64), sizes, at, least), _tagged(_rare(values.view(np.uint64), sizes, at, least, rare), RARE)))]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield tuple(x[a:b].tolist() for x in found)


def _aligned(least: int, rare: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, new = (_sides(batch[f"{side}lines"], batch[f"{side}words"], least, rare) for side in ("o_", ""))
            cut = [_cut(*both, least, rare) for both in zip(old, new, batch["words"].to_pylist(), batch["marks"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row_key"], pa.array(cut, pa.list_(pa.int32()))], names=["row_key", "cut"])

    return run


def deleted_lines(docs: DataFrame, least: int = MIN_WORDS, rare: int = RARE_WORDS, most: int = RARE_DOCS) -> DataFrame:
    """(row_key, cut): for rows that lose lines, the numbers (from 0) of those lines. ``docs``: (row_key, text).

    ``row_key`` orders the rows (earlier rows keep their lines); rows that share one must be equal. Anchors are of three
    kinds, each looked up by its hash: runs of lines of at least ``least`` words, whose rarity comes from length, as no
    chance repeats so many words; shorter runs of at least ``rare`` words that ``most`` rows at most hold; and all lines of
    a row below ``least`` words. An anchor is linked with its first holder alone, so pairs grow with lines and not with the
    square of a group. Every block of ``least`` words, and every rare one of ``rare`` words, that an earlier row has is
    covered by such runs.
    """
    key = docs.schema["row_key"].dataType.simpleString()
    made = kept(docs.mapInArrow(_lines(least, rare), f"row_key {key}, lines array<bigint>, words array<int>, anchors array<bigint>").dropDuplicates(["row_key"]), "lines")
    runs = made.select("row_key", F.explode("anchors").alias("run"))
    kind = F.col("run").bitwiseAND(F.lit(3))
    held = runs.groupBy("run").agg(F.min("row_key").alias("owner"), F.max("row_key").alias("last"), F.count("*").alias("n")).where("owner < last")
    # a row for each run that several hold: its first holder, and whether it links (short runs only if rare)
    links = kept(held.select("run", "owner", "n", ((kind != RARE) | (F.col("n") <= most)).alias("links")), "runs")
    frequent = kept(links.orderBy(F.desc("n"), "run").limit(FREQUENT), "frequent")
    told = runs.join(F.broadcast(frequent), "run", "left")
    rest = told.where("owner is null").select("row_key", "run").join(links.where("links").join(F.broadcast(frequent.select("run")), "run", "left_anti").select("run", "owner", "n"), "run")
    found = told.where("links").select("run", "row_key", "owner", "n").unionByName(rest.select("run", "row_key", "owner", "n")).where("row_key > owner")
    pairs = found.groupBy("row_key", "owner").agg(F.collect_list(F.when(kind != LONG, F.col("run"))).alias("marks"), F.max("n").alias("n"))
    # an old row's lines go to as many copies as its most frequent run asks for; a pair picks one of them
    copies = F.ceil(F.col("n") / FAN).cast("long")
    pairs = pairs.withColumn("copy", F.pmod(F.xxhash64("row_key"), copies)).drop("n")
    owners = links.where("links").groupBy("owner").agg(F.max("n").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("n")
    sides = made.select("row_key", "lines", "words")
    old = sides.select(F.col("row_key").alias("owner"), F.col("lines").alias("o_lines"), F.col("words").alias("o_words")).join(owners, "owner")
    both = pairs.join(sides, "row_key").join(old, ["owner", "copy"])
    return both.mapInArrow(_aligned(least, rare), f"row_key {key}, cut array<int>").groupBy("row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut")).where("size(cut) > 0")


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs``, with ``text`` rid of its deleted lines, ``n_lines`` and ``lines_cut`` (numbers of
    the deleted lines). "Later" means a larger id; rows of one id follow by a hash of the text, rows without an id come first
    (nulls sort first). Rows that are equal in id and text are one row here: all keep, or all lose, the same lines. Null
    text stays null; a text that loses all lines becomes empty. Columns of the two names are replaced, all others stay, whatever
    their names. An empty table gives none."""
    docs = docs.drop("n_lines", "lines_cut")
    keyed = docs.select(F.struct("*").alias("row"), F.struct(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("h")).alias("row_key"))
    own = F.col("row").getField(text)
    joined = keyed.join(deleted_lines(keyed.select("row_key", own.alias("text")), least), "row_key", "left")
    lines = F.split(own, "\n", -1)
    # the lines between two deleted ones, then those after the last: as many slices as deleted lines and one more
    start = lambda k: F.coalesce(F.get("cut", k - 1), F.lit(-1)) + 2
    gap = lambda a, k: F.coalesce(F.get("cut", k), F.size(a)) + 1 - start(k)
    left = let(lines, lambda a: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("cut")), lambda k: F.slice(a, start(k), gap(a, k)))), "\n"))
    whole = {c: F.col("row").getField(c) for c in docs.columns} | {text: F.when(F.col("cut").isNull(), own).otherwise(left)}
    return joined.select(*[v.alias(c) for c, v in whole.items()], F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce("cut", F.array().cast("array<int>")).alias("lines_cut"))
