"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions. For a query a and a row x, |angle(a, r) - angle(x, r)| and
angle(a, r) + angle(x, r) bound their angle for each reference r, so the cosine lies between the cosines of the tightest;
times both norms, and widened by what rounding can cost, that bounds the score. Only rows whose bounds overlap a query's
window of wanted scores are scored, as exact whole numbers.

1. Rows are sorted by label, nearest reference and angle to it, and packed into blocks, one table row each; a block's own
   ranges of norms and angles bound its scores with a block of queries, so that most pairs of blocks may never meet.
2. Queries (few, a stated set) are blocks as well, copied to each stripe of the rows' blocks; pairs of blocks are joined,
   filtered and scored in tasks. A pair returns the best rows of each window only.
3. A sixty-fourth of the rows goes first: its best rows raise the windows' lower ends, without which each pair of blocks
   would return rows of its own. What it finds decides nothing else.

The windows of positives are open, those of negatives come from the positives' scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, let

#: Reference directions (rows with the least hashes), rows and queries of a block, blocks of a stripe, and the share of the rows
#: that goes first (one in so many).
REFERENCES, BLOCK, QUERIES, STRIPE, PILOT = 16, 4096, 512, 16, 64
#: Rows whose whole-number vectors have this squared norm or more can't be scored in 64 bits.
LIMIT = 2.0**56
NO_ID = (1 << 63) - 1
LOWEST, HIGHEST = -(1 << 60), 1 << 60
#: What an angle of 32 bits, and the cosines made of two, may be off, at most.
SLACK = 1e-5


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, short ones filled up with 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return values.reshape(len(sizes), sizes[0]).astype(float)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _whole(scale: float):
    """Vectors as whole numbers of 32 bits, floor(scale * x); rows with a missing or infinite component, or too long, go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch["vector"]
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(scale * values)
                row = np.repeat(np.arange(len(batch)), sizes)
                square = np.bincount(row, weights=whole * whole, minlength=len(batch))
            none = ~(square < LIMIT)
            ends = np.concatenate([[0], np.cumsum(np.where(none, 0, sizes))])
            data = np.where(none[row], 0, whole).astype(np.int32)[~none[row]]
            stays = np.flatnonzero(~none)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(data)).take(pa.array(stays))
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(stays)) for c in ("row", "id", "label", "query")), lists], names=["row", "id", "label", "query", "vector"])

    return run


def _angles(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the references (a right angle for a vector of length 0)."""
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    d = min(vectors.shape[1], references.shape[1])
    cosine = vectors[:, :d] @ references[:, :d].T / np.maximum(norm, 1e-300)[:, None]
    return norm, np.arccos(np.clip(cosine, -1, 1))


def _placed(references: np.ndarray):
    """Adds each row's nearest reference and the angle to it, by which blocks are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = _angles(_matrix(batch["vector"]), references)[1]
            near = angle.argmin(axis=1) if len(angle) else np.zeros(0, np.int64)
            made = [pa.array(near.astype(np.int32)), pa.array(angle[np.arange(len(angle)), near])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "near", "angle"])

    return run


RANGES = "label_low long, label_high long, norm_low double, norm_high double, angle_low array<double>, angle_high array<double>"
PACK = "rows binary, ids binary, labels binary, vectors binary, angles binary, " + RANGES


def _packed(references: np.ndarray, size: int, windows: bool):
    """Sorted rows -> blocks. Queries' blocks also have their windows, of scores from ``low`` to ``high``."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
        vectors = _matrix(rows["vector"].combine_chunks())
        norm, angle = _angles(vectors, references)
        label = rows["label"].to_numpy()
        data = [rows["row"].to_numpy().tobytes(), rows["id"].to_numpy().tobytes(), label.tobytes(), vectors.astype("<i4").tobytes(), angle.astype("<f4").tobytes()]
        names = ["rows", "ids", "labels", "vectors", "angles"]
        ranges = [label.min(), label.max(), norm.min(), norm.max(), angle.min(axis=0).tolist(), angle.max(axis=0).tolist()]
        columns = [*(pa.array([x], pa.binary()) for x in data), *(pa.array([int(x)]) for x in ranges[:2]), *(pa.array([float(x)]) for x in ranges[2:4]), *(pa.array([x], pa.list_(pa.float64())) for x in ranges[4:])]
        names += ["label_low", "label_high", "norm_low", "norm_high", "angle_low", "angle_high"]
        if windows:
            count = rows["low"].combine_chunks().value_lengths().to_numpy()
            ends = [rows[c].combine_chunks().flatten().to_numpy() for c in ("low", "high")]
            columns += [pa.array([x.tobytes()], pa.binary()) for x in (count.astype(np.int32), *ends)] + [pa.array([int(ends[0].min())]), pa.array([int(ends[1].max())])]
            names += ["windows", "lows", "highs", "low", "high"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while len(batch):
                take = min(size - n, len(batch))
                held.append(batch.slice(0, take))
                batch, n = batch.slice(take), n + take
                if n == size:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    order = ["label", "near", "angle", "row"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _blocks(rows: DataFrame, references: np.ndarray) -> tuple[DataFrame, int]:
    """The rows' blocks, each in a stripe, and the number of stripes."""
    made = _sorted(rows).mapInArrow(_packed(references, BLOCK, False), PACK).withColumn("block", F.monotonically_increasing_id())
    made = kept(made, "blocks", {"parquet.block.size": 16_000_000})
    n = made.count()
    # as many as there are cores, if there are so many blocks: each stripe costs a copy of the queries
    stripes = max(1, -(-n // STRIPE), min(n, rows.sparkSession.sparkContext.defaultParallelism))
    return made.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int")), stripes


def _may_meet(same: bool) -> Column:
    """Whether a block of rows (``x_...``) can have a wanted row for a block of queries, by their ranges."""
    a, x = (lambda c: F.col(c)), (lambda c: F.col(f"x_{c}"))
    places = F.sequence(F.lit(0), F.size("angle_low") - 1)
    apart = F.array_max(F.transform(places, lambda i: F.greatest(F.get(x("angle_low"), i) - F.get(a("angle_high"), i), F.get(a("angle_low"), i) - F.get(x("angle_high"), i), F.lit(0.0))))
    wide = F.array_min(F.transform(places, lambda i: F.get(a("angle_high"), i) + F.get(x("angle_high"), i)))
    most, least = a("norm_high") * x("norm_high"), a("norm_low") * x("norm_low")
    times = lambda c, up: F.when((c >= 0) == F.lit(up), c * most).otherwise(c * least)
    highest = let(F.cos(apart), lambda c: times(c, True))
    lowest = let(F.cos(F.least(wide, F.lit(np.pi))), lambda c: times(c, False))
    slack = most * SLACK + 1
    labels = (a("label_low") <= x("label_high")) & (x("label_low") <= a("label_high")) if same else ~((a("label_low") == a("label_high")) & (x("label_low") == x("label_high")) & (a("label_low") == x("label_low")))
    return labels & (highest + slack >= a("low")) & (lowest - slack <= a("high"))


def _read(batch: pa.RecordBatch, i: int, prefix: str) -> tuple[np.ndarray, ...]:
    get = lambda c, kind: np.frombuffer(batch[prefix + c][i].as_buffer(), kind)
    rows, ids, labels = (get(c, np.int64) for c in ("rows", "ids", "labels"))
    n = len(rows)
    vectors = get("vectors", "<i4").reshape(n, -1).astype(float)
    angles = get("angles", "<f4").reshape(n, -1).astype(float)
    return rows, ids, labels, vectors, np.sqrt((vectors * vectors).sum(axis=1)), angles


def _bounds(a: tuple[np.ndarray, ...], x: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each query with each row, by the triangle inequality at each reference."""
    (norm_a, angle_a), (norm_x, angle_x) = a[4:], x[4:]
    low, high = np.full((len(norm_a), len(norm_x)), -1.0), np.full((len(norm_a), len(norm_x)), 1.0)
    for r in range(angle_a.shape[1]):
        cosines, sines = np.outer(np.cos(angle_a[:, r]), np.cos(angle_x[:, r])), np.outer(np.sin(angle_a[:, r]), np.sin(angle_x[:, r]))
        np.minimum(high, cosines + sines, out=high)  # cos of the difference
        cosines -= sines  # cos of the sum; beyond a half turn, of the rest of the turn, which is the same
        np.maximum(low, cosines, out=low)
    scale = np.outer(norm_a, norm_x)
    slack = scale * SLACK + 1
    return low * scale - slack, high * scale + slack


def _products(a: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Inner products as whole numbers: in doubles as long as these hold all sums exactly."""
    d = min(a.shape[1], x.shape[1])
    a, x = a[:, :d], x[:, :d]
    return (a @ x.T).astype(np.int64) if most < 2.0**53 else a.astype(np.int64) @ x.astype(np.int64).T


BEST = "query long, query_id long, window int, score long, id long, row long"


def _best(same: bool, want: int):
    """The best ``want`` rows of each window, of one pair of blocks: by score, then id (rows lie in order of ids)."""

    def pair(batch: pa.RecordBatch, i: int) -> Iterator[tuple]:
        a, x = _read(batch, i, ""), _read(batch, i, "x_")
        count, lows, highs = (np.frombuffer(batch[c][i].as_buffer(), kind) for c, kind in (("windows", np.int32), ("lows", np.int64), ("highs", np.int64)))
        first = np.concatenate([[0], np.cumsum(count)])
        low, high = _bounds(a, x)
        fits = (a[2][:, None] == x[2]) == same
        if same:
            fits &= a[0][:, None] != x[0]
        overlap = np.zeros(fits.shape, bool)
        for k in range(int(count.max(initial=0))):
            there = np.flatnonzero(count > k)
            at = first[there] + k
            overlap[there] |= (high[there] >= lows[at][:, None]) & (low[there] <= highs[at][:, None])
        fits &= overlap
        del low, high, overlap
        columns, queries = np.flatnonzero(fits.any(axis=0)), np.flatnonzero(fits.any(axis=1))
        if not len(queries):
            return
        score = _products(a[3][queries], x[3][columns], float(a[4].max() * x[4].max()))
        fits = fits[np.ix_(queries, columns)]
        for own, q in enumerate(queries.tolist()):
            can = np.flatnonzero(fits[own])
            s = score[own, can]
            for k in range(count[q]):
                at = np.flatnonzero((s >= lows[first[q] + k]) & (s <= highs[first[q] + k]))
                if len(at) > want:  # keeps ties of the last score: those of the least ids are the first
                    at = at[s[at] >= np.partition(s[at], len(at) - want)[len(at) - want]]
                at = at[np.argsort(-s[at], kind="stable")[:want]]
                if len(at):
                    yield np.full(len(at), a[0][q]), np.full(len(at), a[1][q]), np.full(len(at), k, np.int32), s[at], x[1][columns[can[at]]], x[0][columns[can[at]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                for group in _grouped(pair(batch, i), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*group, strict=True)], names=[c.split(" ")[0] for c in BEST.split(", ")])

    return run


def _grouped(found: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for x in found:
        held.append(x)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def best_rows(queries: DataFrame, blocks: tuple[DataFrame, int], references: np.ndarray, same: bool, want: int) -> DataFrame:
    """For each window of the queries (row, id, label, vector, near, angle, low array, high array) the first ``want`` rows by score,
    then id, whose score lies in it (ends included), among the other rows of the same label, or of other labels."""
    asked = _sorted(queries).mapInArrow(_packed(references, QUERIES, True), PACK + ", windows binary, lows binary, highs binary, low long, high long")
    stripe = F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1)))
    asked = asked.withColumn("stripe", stripe).repartition(blocks[1], "stripe")
    rows = blocks[0].select("stripe", *[F.col(c).alias(f"x_{c}") for c in blocks[0].columns if c not in ("stripe", "block")]).repartition(blocks[1], "stripe")
    pairs = asked.join(rows, "stripe").where(_may_meet(same)).drop("stripe")
    found = pairs.mapInArrow(_best(same, want), BEST)
    first = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id", "row")
    return kept(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= want), "best")


def _raised(queries: DataFrame, found: DataFrame, want: int) -> DataFrame:
    """The queries' windows with lower ends raised to the last of ``want`` scores that were found in them."""
    last = found.where(F.col("rank") == want).groupBy(F.col("query").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("last"))
    low = F.transform("low", lambda x, i: F.coalesce(F.try_element_at("last", i.cast("int")), x))
    return queries.join(last, "row", "left").withColumn("low", low).drop("last")


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: float = 256.0, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", query: str = "query") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component x counts as floor(``scale`` * x), a score is the inner product of such vectors. An anchor is a row with
    ``query``. Its positives are the first ``positives`` other rows of its label by score, then id; for each, the first
    ``negatives`` rows of other labels with least * positive_score <= 100 * score <= most * positive_score are returned.

    Rows with a null label or vector, or a null or non-finite component, take no part, nor do rows whose vectors are so long
    that scores don't fit 64 bits (squared norm of 2^56, a length of a million at scale 256). Vectors of different lengths
    are compared over the components that both have. Repeated rows and rows of one id are rows of their own (later ones
    follow in ties); rows without an id come last in ties, and can't be told apart in the result. Other columns are not read.
    No anchors, or no rows, give no rows.
    """
    spark = rows.sparkSession
    read = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(F.col(query), F.lit(False)).alias("query")).where("label is not null and vector is not null")
    read = read.withColumns({"row": F.monotonically_increasing_id(), "id": F.coalesce("id", F.lit(NO_ID))})
    whole = kept(read.mapInArrow(_whole(scale), "row long, id long, label long, query boolean, vector array<int>"), "whole")
    chosen = whole.where(F.exists("vector", lambda v: v != 0)).orderBy(F.xxhash64("vector", "row"), "row").limit(REFERENCES).select("vector").collect()
    directions = sorted({tuple(r["vector"]) for r in chosen}) or [(1,)]
    references = np.zeros((len(directions), max(map(len, directions))))
    for i, v in enumerate(directions):
        references[i, : len(v)] = np.array(v) / np.sqrt(sum(x * x for x in v))
    placed = kept(whole.mapInArrow(_placed(references), "row long, id long, label long, query boolean, vector array<int>, near int, angle double"), "placed")
    blocks = _blocks(placed, references)
    pilot = _blocks(placed.where(F.pmod(F.xxhash64("row"), F.lit(PILOT)) == 0), references)

    def both(asked: DataFrame, same: bool, want: int) -> DataFrame:
        return best_rows(_raised(asked, best_rows(asked, pilot, references, same, want), want), blocks, references, same, want)

    anchors = placed.where("query").drop("query")
    open_ = lambda x: F.array(F.lit(x).cast("long"))
    found = both(anchors.withColumns({"low": open_(LOWEST), "high": open_(HIGHEST)}), True, positives)
    # a window for each positive: the k-th is that of the positive of rank k + 1; a score below 0 has none
    below = lambda x: f"(({x} - pmod({x}, 100)) div 100)"
    low, high = F.expr("-" + below(f"-{least} * score")), F.expr(below(f"{most} * score"))
    windows = found.groupBy(F.col("query").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("w"))
    asked = anchors.join(windows, "row").withColumns({"low": F.col("w.low"), "high": F.col("w.high")}).drop("w")
    worse = both(asked, False, negatives)
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    best = found.select("query", (F.col("rank") - 1).alias("window"), named("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return worse.join(best, ["query", "window"]).select(
        named("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), named("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """The negatives of rows whose id is divisible by 100; those divisible by 7 have the next of ten labels."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(vectors.select("vec_id", moved.alias("label"), "embedding", (F.col("vec_id") % 100 == 0).alias("query")))
