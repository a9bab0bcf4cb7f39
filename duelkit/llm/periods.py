"""Periodic runs of words, by recursive frequency splitting and a scan over lags.

A run of period q has at least four periods, so each of its words occurs four times in it at least. Words that occur more
rarely in the current segment can't be in a run and split it; the pieces are split in the same way until none changes. In
the segments that survive, every lag q is tried: blocks of 2 q words at multiples of q are compared with those q words on,
by prefix hashes, and where they agree, words are compared. Each document is a task's own row; nothing is exchanged."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, let, parts

#: A run has at least so many periods, and so many words.
PERIODS, LEAST = 4, 6
#: A prime for prefix hashes, and their base; blocks that agree are compared word by word.
PRIME, BASE = (1 << 31) - 1, 1_220_703_125
#: Places that are compared at once in a scan over lags.
PLACES = 1 << 20


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """The stretches [low, high) of words, none of which occurs fewer than ``PERIODS`` times in its stretch, that can hold runs.

    All segments of a round are split at once; those that don't change are done."""
    done: list[tuple[int, int]] = []
    low, high = np.array([0]), np.array([len(ids)])
    while True:
        wide = high - low >= LEAST
        low, high = low[wide], high[wide]
        if not len(low):
            return sorted(done)
        size = high - low
        segment = np.repeat(np.arange(len(low)), size)
        place = np.arange(len(segment)) - np.repeat(np.cumsum(size) - size, size) + low[segment]
        _, of, times = np.unique(segment * (int(ids.max()) + 1) + ids[place], return_inverse=True, return_counts=True)
        rare = times[of] < PERIODS
        split = np.bincount(segment, weights=rare, minlength=len(low)) > 0
        done += zip(low[~split].tolist(), high[~split].tolist(), strict=True)
        stays = ~rare & split[segment]
        place, segment = place[stays], segment[stays]
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) != 1) | (np.diff(segment) != 0)
        low = place[new]
        high = place[np.append(new[1:], True)] + 1 if len(place) else low


def _powers(n: int) -> np.ndarray:
    """BASE ** i modulo PRIME, for i below n."""
    out = np.ones(max(n, 1), np.int64)
    done, factor = 1, BASE
    while done < n:
        out[done : 2 * done] = out[: min(done, n - done)] * factor % PRIME
        factor = factor * factor % PRIME
        done *= 2
    return out


def _lags(n: int) -> Iterator[tuple[int, int]]:
    """Ranges of lags with about ``PLACES`` places to compare in each."""
    low, held = 1, 0
    for q in range(1, n // PERIODS + 1):
        held += n // q
        if held >= PLACES:
            yield low, q + 1
            low, held = q + 1, 0
    if low <= n // PERIODS:
        yield low, n // PERIODS + 1


def _hits(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each lag q in turn that has some: the multiples s of q at which the words from s to s + 2 q are those q words on (by
    hash)."""
    n = len(ids)
    powers = _powers(n + 1)
    sums = np.concatenate([[0], np.cumsum((ids + 1) * powers[:n] % PRIME)])
    for first, end in _lags(n):
        q = np.arange(first, end)
        times = np.maximum(n // q - 2, 0)  # multiples s of q with s + 3 q <= n
        lag = np.repeat(q, times)
        s = (np.arange(len(lag)) - np.repeat(np.cumsum(times) - times, times)) * lag
        here = (sums[s + 2 * lag] - sums[s]) % PRIME * powers[lag] % PRIME
        same = np.flatnonzero(here == (sums[s + 3 * lag] - sums[s + lag]) % PRIME)
        cut = np.flatnonzero(np.diff(lag[same])) + 1
        for part in np.split(same, cut) if len(same) else ():
            yield int(lag[part[0]]), s[part]


def _runs_in(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one segment."""
    n = len(ids)
    known: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends of the runs of each period
    for q, hits in _hits(ids):
        for group in np.split(hits, np.flatnonzero(np.diff(hits) != q) + 1):
            s, e = int(group[0]), int(group[-1]) + 3 * q
            # a stretch inside a run whose period divides q is that run; periods come in rising order
            if any(q % p == 0 and (i := bisect_right(starts, s)) and ends[i - 1] >= e for p, (starts, ends) in known.items()):
                continue
            low, high = max(0, s - q), min(n, e + q)
            equal = np.concatenate([[False], ids[low : high - q] == ids[low + q : high], [False]])
            edge = np.flatnonzero(equal[1:] != equal[:-1])
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                start, end = low + a, low + b + q
                starts, ends = known.setdefault(q, ([], []))
                if end - start >= max(LEAST, PERIODS * q) and not (starts and start <= starts[-1]):
                    starts.append(start)
                    ends.append(end)
    return [(a, b - a, q) for q, (starts, ends) in known.items() for a, b in zip(starts, ends, strict=True)]


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs (start, length, period), by start, then period."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    return sorted(x for low, high in segments(ids) for x in ((low + a, n, q) for a, n, q in _runs_in(ids[low:high]))) if len(words) >= LEAST else []


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period."""
    if found:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]
    return b" ".join(words)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text"):
        sizes, all_runs, texts = [], [], []
        for text in batch["text"].cast(pa.large_binary()):
            words = (text.as_py() or b"").split()  # bytes: at 0x20 and 0x09-0x0D
            found = runs(words)
            sizes.append(len(words))
            all_runs.append([{"start": a, "length": n, "period": q} for a, n, q in found])
            texts.append(_collapsed(words, found))
        made = [pa.array(sizes, pa.int64()), pa.array(all_runs, pa.list_(RUN)), pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *made], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs, collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of at least four periods and six words whose smallest period is
    ``period``, and that no neighbouring word extends; ``runs`` are all of them (start from 0, length, period), by start, then
    period. ``collapsed`` is the text without the words that some run contains after its first period, joined by one blank.
    Null text has no words; rows of one id and repeated rows are rows of their own; other columns are not read. Whole texts
    are scanned, in about n log n steps for n words. An empty table gives none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_found, f"doc_id {dict(rows.dtypes)['doc_id']}, {FOUND}")


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; with h = crc32(id) and g = floor(h / 10), documents with h % 10 = 0 repeat words from word a = g % n on
    with period 1 + floor((n - a) / (3 + g % 8))."""
    h = crc_of_id("doc_id")
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(w, a + i % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), tail), " "))

    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")).alias("text"))


def run_digest(docs: DataFrame) -> DataFrame:
    """Number of runs, the one of the greatest length / period (ties: least start, then period), and digests of all runs and of
    the collapsed text. Fractions are compared exactly."""
    found = periodic_runs(with_repeats(docs))
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda m, x: F.when(better(x, m), x).otherwise(m))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    made = found.withColumn("best", best)
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
