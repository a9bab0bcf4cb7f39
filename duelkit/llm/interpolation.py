"""Language-model scores by deleted interpolation of word bigrams.

A text is a sequence of words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and then one end; words that training doesn't have
are one more symbol. The probability of a word w after v (or after the start) mixes the maximum-likelihood estimates
c(v, w) / c(v) and c(w) / N and the even share 1 / (V + 1). The weights depend on a bucket of the context's frequency c(v)
and are learned by expectation-maximisation on the counts of a held-out slice of the training documents, whose own counts
are left out of the estimates meanwhile.

1. Every task packs its documents into blocks of bounded size, one table row each, written once.
2. A block asks for its distinct words and bigrams: 64-bit hashes with the block's own counts, pre-summed, as one row for
   each slice of the key space in which it has any. Bytes of keys grow with the input, and slices stay bounded; rows are
   blocks times slices until a slice holds one key of a block, so they grow with the square up to that bound.
3. A slice sums all blocks' counts and answers each in the order of its asking; answers are joined back by block.

No table of counts is sent to every task, so the vocabulary may grow with the corpus. Keys are compared by all their 64
bits: among 10^9 distinct words two meet with a chance of 3 %, which would change the counts of these two words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, kept
from .tokens import chunks, mix, utf8, words

#: Text bytes of a block of documents (one longer text is a block of its own), and for each slice of the bigrams' key space.
BLOCK_BYTES, SLICE_BYTES = 6_000_000, 6_000_000
#: Bytes of a row group of the table of blocks, so that few blocks are read at once.
GROUP_BYTES = 16_000_000
#: Frequencies of contexts, in powers of two, with a bucket each; 0 is a context that was never seen.
BUCKETS = 28
#: Held-out estimates are grouped by steps of 1/20 of a power of ten from 1 down to 10^-20, 0 apart, so none of a corpus of up to
#: 10^20 tokens is clipped. Groups that occur are counted, a small part of BUCKETS * GRID**2.
GRID = 402
STEPS = 100
_U = np.uint64
_END = np.full(1, 0x5DEECE66D1234567, _U)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; the first byte is that width."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


BLOCKS = "use int, ids array<bigint>, ends array<bigint>, data binary"


def _blocks(block_bytes: int):
    """Rows of documents -> rows of blocks; a block has documents of one use only."""

    def block(use: int, parts: list[tuple[pa.Array, bytes, np.ndarray]]) -> pa.RecordBatch:
        ids, ends = pa.concat_arrays([p[0] for p in parts]), np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))
        data = pa.compress(b"".join(p[1] for p in parts), codec="zstd", asbytes=True)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, pa.array(ends))]
        return pa.RecordBatch.from_arrays([pa.array([use], pa.int32()), *lists, pa.array([data])], names=["use", "ids", "ends", "data"])

    def run(batches):
        waiting: dict[int, list] = {0: [], 1: [], 2: []}
        held = dict.fromkeys(waiting, 0)
        for batch in batches:
            for use, parts in waiting.items():
                mine = batch.filter(pa.array(batch["use"].to_numpy() == use))
                flat, offsets = utf8(mine["text"])
                for a, b in chunks(offsets, block_bytes // 2):
                    size = int(offsets[b] - offsets[a])
                    if parts and held[use] + size > block_bytes:
                        yield block(use, parts)
                        parts.clear()
                        held[use] = 0
                    parts.append((mine["doc_id"].slice(a, b - a), flat[offsets[a] : offsets[b]].tobytes(), offsets[a : b + 1]))
                    held[use] += size
        for use, parts in waiting.items():
            if parts:
                yield block(use, parts)

    return run


class Block:
    """The words and bigrams of a block as sorted distinct keys, and each token's places among them."""

    def __init__(self, data: bytes, ends: np.ndarray):
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        flat = np.frombuffer(pa.decompress(data, int(offsets[-1]), codec="zstd"), np.uint8)
        parts, at = [np.zeros(0, _U)], [np.zeros(1, np.int64)]
        for a, b in chunks(offsets):
            hashes, own = words(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            parts.append(hashes)
            at.append(at[-1][-1] + own[1:])
        #: Places of the documents among tokens; each has its words and then the end.
        self.at = np.concatenate(at)
        self.at += np.arange(len(self.at))
        tokens = np.empty(self.at[-1], _U)
        last = np.zeros(len(tokens), bool)
        last[self.at[1:] - 1] = True
        tokens[~last] = np.concatenate(parts)
        tokens[last] = _END
        del flat, parts, at, last
        pairs = np.concatenate([_END, tokens[:-1]])  # the start has the end's count
        pairs *= _U(0x9FB21C651E98DF25)
        pairs += tokens
        self.words, self.word_of = _distinct(tokens)
        del tokens
        self.pairs, self.pair_of = _distinct(mix(pairs))

    @classmethod
    def of(cls, blocks: pa.Table | pa.RecordBatch, i: int = 0) -> Block:
        return cls(blocks["data"][i].as_buffer(), blocks["ends"][i].values.to_numpy())

    def known(self, answers: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(w), c(v, w) and c(v) of every token, from the answers: words in order, then bigrams in order."""
        found = np.concatenate([unpacked(x.as_py()) for x in answers.sort_by("slice")[name]]).astype(np.int64)
        one, two = found[: len(self.words)][self.word_of], found[len(self.words) :][self.pair_of]
        return one, two, np.concatenate([one[-1:], one[:-1]])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, of = np.unique(keys, return_inverse=True)
    return found, of.astype(np.int32)


ASKED = "slice long, block long, use int, keys binary, counts binary"
ANSWERED = "block long, slice long, fit binary, train binary, n_fit long, n_train long, n_kinds long"


def _asking(word_slices: int, pair_slices: int):
    """A block's rows: slices 0 and on are of words, those from ``word_slices`` on of bigrams."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                block, use, name = Block.of(batch, i), batch["use"][i].as_py(), batch["block"][i].as_py()
                out: list[list] = [[], [], []]
                for first, n, keys, of in ((0, word_slices, block.words, block.word_of), (word_slices, pair_slices, block.pairs, block.pair_of)):
                    counts = np.bincount(of, minlength=len(keys))
                    at = (keys >> _U(32)) * _U(n) >> _U(32)
                    cut = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(keys)]
                    for a, b in zip(cut[:-1], cut[1:], strict=True):
                        out[0].append(first + int(at[a]))
                        out[1].append(packed(np.diff(keys[a:b], prepend=_U(0))))
                        out[2].append(b"" if use == 2 else packed(counts[a:b]))
                size = len(out[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(np.full(size, name)), pa.array(np.full(size, use, np.int32)), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                    names=["slice", "block", "use", "keys", "counts"],
                )

    return run


def _answer(word_slices: int):
    def run(group: pa.Table) -> pa.Table:
        """Sums of a slice, to each block in the order of its keys (fitted counts to held-out blocks alone); the row of
        block -1 has a slice of words' tokens and distinct words."""
        asked = [np.cumsum(unpacked(x.as_py()), dtype=_U) for x in group["keys"]]
        sizes = [len(x) for x in asked]
        keys, of = _distinct(np.concatenate(asked))
        del asked
        ends = np.concatenate([[0], np.cumsum(sizes)])
        total = {n: np.zeros(len(keys), np.int64) for n in ("fit", "train")}
        uses = group["use"].to_pylist()
        for use, a, b, counts in zip(uses, ends[:-1], ends[1:], group["counts"], strict=True):
            if use < 2:  # keys of a row are distinct
                own = unpacked(counts.as_py()).astype(np.int64)
                total["train"][of[a:b]] += own
                if use == 0:
                    total["fit"][of[a:b]] += own
        out = {n: [packed(x[of[a:b]]) if n == "train" or use == 1 else None for use, a, b in zip(uses, ends[:-1], ends[1:], strict=True)] for n, x in total.items()}
        name, none = group["slice"][0].as_py(), [None] * len(uses)
        sums = [int(total["fit"].sum()), int(total["train"].sum()), int((total["train"] > 0).sum())] if name < word_slices else [None] * 3
        columns = [pa.array([*group["block"].to_pylist(), -1]), pa.array(np.full(len(uses) + 1, name)), *(pa.array([*out[n], None], pa.binary()) for n in ("fit", "train"))]
        return pa.table([*columns, *(pa.array([*none, x], pa.int64()) for x in sums)], names=[c.split(" ")[0] for c in ANSWERED.split(", ")])

    return run


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _grid(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.clip(GRID - 1 + np.round(20 * np.log10(np.maximum(p, 1e-300))), 1, GRID - 1), 0).astype(np.int64)


def _held(fitted: int):
    """Held-out tokens of a block, counted by context bucket and estimates (without the held-out slice) on the grid."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block.of(blocks)
        one, two, context = block.known(answers, "fit")
        group = (_bucket(context) * GRID + _grid(two / np.maximum(context, 1))) * GRID + _grid(one / max(fitted, 1))
        groups, times = np.unique(group, return_counts=True)
        return pa.table([pa.array(groups), pa.array(times)], names=["grp", "times"])

    return run


def learn_weights(held: dict[int, int], kinds: int, steps: int = STEPS) -> np.ndarray:
    """Weights of bigram, unigram and even share for each bucket, by EM on held-out counts. Each
    weight gets 0.1 token on top, so a bucket without tokens is even; a context never seen gives its bigram share away."""
    group = np.array(sorted(held), np.int64)
    times = np.array([held[g] for g in group.tolist()], float)
    grid = np.concatenate([[0.0], 10 ** ((np.arange(1, GRID) - GRID + 1) / 20)])
    f = np.stack([grid[group // GRID % GRID], grid[group % GRID], np.full(len(group), 1 / (kinds + 1))])
    bucket = group // GRID**2
    weights = np.full((3, BUCKETS), 1 / 3)
    for _ in range(steps):
        parts = weights[:, bucket] * f
        share = parts / parts.sum(axis=0)
        got = np.stack([np.bincount(bucket, weights=times * s, minlength=BUCKETS) for s in share]) + 0.1
        weights = got / got.sum(axis=0)
    weights[1:, 0] += weights[0, 0] * weights[1:, 0] / weights[1:, 0].sum()
    weights[0, 0] = 0
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(tokens: int, kinds: int, weights: np.ndarray):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block.of(blocks)
        one, two, context = block.known(answers, "train")

        def summed(x: np.ndarray) -> np.ndarray:  # each document by itself: equal texts get equal sums
            return np.add.reduceat(x, block.at[:-1])

        bucket = _bucket(context)
        p = weights[0][bucket] * two
        p /= np.maximum(context, 1)
        p += weights[1][bucket] * one / max(tokens, 1)
        p += weights[2][bucket] / (kinds + 1)
        score = summed(np.log10(p, out=p))
        base = summed(np.log10((one + 1) / (tokens + (kinds + 1))))
        n = np.diff(block.at)
        known = np.add.reduceat((one > 0).astype(np.int64), block.at[:-1])
        held_out = pa.array(np.full(len(n), blocks["use"][0].as_py() == 2))
        columns = [blocks["ids"][0].values, held_out, pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(score)]
        return pa.table(columns, names=[c.split(" ")[0] for c in SCORES.split(", ")])

    return run


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, use): use 0 is fitted on, 1 gives the held-out counts that the weights are
    learned from (after that it is counted too), 2 is scored only.

    ``base_score`` is the add-one unigram score over training words, ``score`` the model's log10 probability of the text,
    ``n_known`` the tokens that training has. Null text counts as empty (its end alone). Repeated rows, rows of one id and
    rows without one are rows of their own, each counted; equal texts get equal scores. Other columns are not read and
    not returned. An empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("use").cast("int").alias("use"))
    blocks = kept(rows.mapInArrow(_blocks(block_bytes), BLOCKS).withColumn("block", F.monotonically_increasing_id()), "blocks", {"parquet.block.size": GROUP_BYTES})
    size = int(blocks.agg(F.coalesce(F.sum(F.element_at("ends", -1)), F.lit(0))).first()[0])
    pair_slices = max(4, size // slice_bytes)
    word_slices = max(2, pair_slices // 4)
    asked = blocks.mapInArrow(_asking(word_slices, pair_slices), ASKED)
    answers = kept(asked.groupBy("slice").applyInArrow(_answer(word_slices), ANSWERED), "answers")
    fitted, tokens, kinds = (int(x or 0) for x in answers.where("block = -1").agg(F.sum("n_fit"), F.sum("n_train"), F.sum("n_kinds")).first())
    mine = answers.where("block <> -1").select("block", "slice", "fit", "train")
    held = blocks.where("use = 1").groupBy("block").cogroup(mine.where("fit is not null").drop("train").groupBy("block")).applyInArrow(_held(fitted), "grp long, times long")
    weights = learn_weights(dict(map(tuple, held.groupBy("grp").agg(F.sum("times")).collect())), kinds)
    return blocks.groupBy("block").cogroup(mine.drop("fit").groupBy("block")).applyInArrow(_scored(tokens, kinds, weights), SCORES)


def scores(docs: DataFrame) -> DataFrame:
    """All documents; learned from those whose crc32 of the id modulo 7 isn't 2, of which remainder 3 is held out for EM."""
    rest = crc_of_id("doc_id") % 7
    return score(docs.select("doc_id", "text", F.when(rest == 2, 2).when(rest == 3, 1).otherwise(0).alias("use")))
