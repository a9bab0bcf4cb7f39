"""Language identification, word first: known words by per-language log frequency, other words by character n-grams,
the longest known length first."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import crc_of_id, held, kept, parts, release

WORD = re.compile(r"[^\W\d_]+")
#: The bounded sample that the model is fitted on: labelled documents of about so many bytes of text.
SAMPLE_BYTES = 64_000_000
#: Words and n-grams are known if a language has them so often in the sample; the longest n-grams.
LEAST_COUNT, LONGEST = 2, 4
#: A model above this size isn't sent to the workers (the sample bounds it at a few times its own size).
MODEL_BYTES = 512_000_000
#: Unseen words whose scores a worker remembers.
CACHE_WORDS = 300_000


@dataclass
class Model:
    """Log frequencies of words (length 0) and n-grams in ``langs``: ``floor[length]`` where a language doesn't have one, and
    ``gain`` above it for those that have it: unit ``u`` has places ``start[u]`` to ``start[u + 1]`` of ``lang`` and ``gain``."""

    langs: list[str]
    units: list[pa.Array]
    floor: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def nbytes(self) -> int:
        return sum(u.nbytes for u in self.units) + self.floor.nbytes + self.start.nbytes + self.lang.nbytes + self.gain.nbytes


def grams(word: str, n: int) -> list[str]:
    word = f"^{word}$"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    total: Counter = Counter()
    for batch in parts(batches, "text"):
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            total.update((lang, w) for w in WORD.findall(text.lower()))
    both = list(total)
    yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in both], pa.string()) for i in (0, 1)] + [pa.array(list(total.values()), pa.int64())], names=["lang", "unit", "n"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for lang, word, n in zip(*(batch[c].to_pylist() for c in ("lang", "unit", "n")), strict=True):
            for size in range(1, LONGEST + 1):
                for g in grams(word, size):
                    total[lang, size, g] += n
        keys = list(total)
        types = (pa.string(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate(types)] + [pa.array(list(total.values()), pa.int64())], names=["lang", "size", "unit", "n"])


def fit(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """The model of the rows whose text and language aren't null.

    It is fitted on rows of about ``sample_bytes`` of text (all, if there is no more), chosen evenly over the languages by a
    hash of id and text, and one row of every language at least: a bounded sample and so a bounded model, which is
    why the model may be sent to every worker (its size is checked). Every language, and every word and n-gram that one has
    ``LEAST_COUNT`` times in the sample, is kept. Counts are summed by Spark. No rows give a model of no language.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 30)).alias("h")).where("lang is not null and text is not null")
    sizes = kept(rows.groupBy("lang").agg(F.sum(F.octet_length("text") + 1).alias("bytes"), F.min("h").alias("first")), "lang-sizes")
    n = sizes.count()
    if not n:
        return Model([], [pa.array([], pa.string())] * (LONGEST + 1), np.zeros((LONGEST + 1, 0)), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    share = sample_bytes / n  # languages that have less leave the rest to the others
    spare, above = sizes.agg(F.sum(F.greatest(F.lit(0.0), share - F.col("bytes"))), F.sum((F.col("bytes") > share).cast("int"))).first()
    limit = (1 << 30) * (share + spare / max(1, above)) / F.col("bytes")
    chosen = rows.join(sizes, "lang").where((F.col("h") < limit) | (F.col("h") == F.col("first")))
    words = kept(chosen.select("lang", "text").mapInArrow(_counts, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n")), "lang-words")
    made = kept(words.mapInArrow(_grams, "lang string, size int, unit string, n long").groupBy("lang", "size", "unit").agg(F.sum("n").alias("n")), "lang-grams")
    units = words.select("lang", F.lit(0).alias("size"), "unit", "n").unionByName(made)
    totals = {(r["lang"], r["size"]): r["n"] for r in units.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    return _model(units.where(F.col("n") >= LEAST_COUNT).toArrow(), totals)


def _model(known: pa.Table, totals: dict[tuple[str, int], int]) -> Model:
    """The model of rows (lang, size, unit, n), at most a few for each word of the sample."""
    langs = sorted({name for name, _ in totals})
    known = known.append_column("place", pc.index_in(known["lang"], pa.array(langs, pa.string()))).sort_by([("size", "ascending"), ("unit", "ascending"), ("place", "ascending")])
    sizes, place, n = (known[c].to_numpy() for c in ("size", "place", "n"))
    units, starts, floors = [], [], []
    gain = np.zeros(len(known), np.float32)
    for size in range(LONGEST + 1):
        a, b = np.searchsorted(sizes, [size, size + 1]).tolist()
        own = known["unit"].slice(a, b - a).combine_chunks()
        new = np.ones(b - a, bool)
        if b - a > 1:
            new[1:] = pc.not_equal(own.slice(1), own.slice(0, b - a - 1)).to_numpy(zero_copy_only=False)
        units.append(own.filter(pa.array(new)))
        starts.append(a + np.flatnonzero(new))
        whole = np.array([totals.get((name, size), 0) for name in langs]) + 0.5 * max(1, len(units[-1]))
        floors.append(np.log(0.5 / whole))
        gain[a:b] = np.log((n[a:b] + 0.5) / 0.5)
    return Model(langs, units, np.stack(floors), np.append(np.concatenate(starts), len(known)).astype(np.int64), place.astype(np.int32), gain)


class Scorer(dict):
    """Row numbers of words; a word that the model doesn't know gets a row of its longest known n-grams' mean."""

    def __init__(self, model: Model):
        self.langs, self.floor = model.langs, np.vstack([model.floor, np.zeros(len(model.langs))])
        firsts = np.cumsum([0, *map(len, model.units)])
        super().__init__((w, i) for i, w in enumerate(model.units[0].to_pylist()))
        self.grams = [{}, *({g: i for i, g in enumerate(model.units[n].to_pylist(), int(firsts[n]))} for n in range(1, LONGEST + 1))]
        self.known, self.fixed = len(self), (len(model.start) - 1, len(model.lang))
        self.next, self.end = self.fixed
        self.start = np.concatenate([model.start, np.zeros(CACHE_WORDS, np.int64)])
        self.size = np.concatenate([np.repeat(np.arange(LONGEST + 1), np.diff(firsts)), np.zeros(CACHE_WORDS, np.int64)])
        self.lang, self.gain = model.lang, model.gain

    def __missing__(self, word: str) -> int:
        lang, gain, size = np.zeros(0, np.int64), np.zeros(0), LONGEST + 1  # nothing known: no language gains
        for n in range(LONGEST, 0, -1):
            table = self.grams[n]
            if got := [table[g] for g in grams(word, n) if g in table]:
                spans = [slice(*self.start[i : i + 2]) for i in got]
                total = np.bincount(np.concatenate([self.lang[x] for x in spans]), np.concatenate([self.gain[x] for x in spans]), len(self.langs)) / len(got)
                lang, size = np.flatnonzero(total), n
                gain = total[lang]
                break
        if self.end + len(lang) > len(self.lang):
            room = max(len(lang), len(self.lang) // 2, 1000)
            self.lang, self.gain = (np.concatenate([x, np.zeros(room, x.dtype)]) for x in (self.lang, self.gain))
        self.lang[self.end : self.end + len(lang)], self.gain[self.end : self.end + len(lang)] = lang, gain
        self.end += len(lang)
        self.start[self.next + 1], self.size[self.next] = self.end, size
        self[word] = self.next
        self.next += 1
        return self.next - 1

    def _forget(self) -> None:
        for word in [w for w, i in self.items() if i >= self.fixed[0]]:
            del self[word]
        self.next, self.end = self.fixed

    def total(self, words: list[str]) -> np.ndarray:
        """The summed log frequencies of the words."""
        out = np.zeros(len(self.langs))
        for i in range(0, len(words), CACHE_WORDS // 4):
            some = words[i : i + CACHE_WORDS // 4]
            if self.next + len(some) >= len(self.start):
                self._forget()
            rows = np.array([self[w] for w in some])
            out += np.bincount(self.size[rows], minlength=LONGEST + 2) @ self.floor
            first = self.start[rows]
            each = self.start[rows + 1] - first
            at = np.repeat(first - np.cumsum(each) + each, each) + np.arange(each.sum())
            out += np.bincount(self.lang[at], self.gain[at], len(out))
        return out


def _scorer(name: str, shared: Broadcast) -> Scorer:
    return held(("scorer", name), lambda: Scorer(shared.value))


def classify(text: str | None, scorer: Scorer) -> tuple[str, float]:
    """The likeliest language and its share of the likelihood under even priors (ties: first by name); ``und`` and 0
    without a letter."""
    if not text or not scorer.langs or not any(map(str.isalpha, text)):
        return "und", 0.0
    total = scorer.total(WORD.findall(text.lower()))
    best = int(total.argmax())
    return scorer.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1) to every row, reading the text alone; columns of these names are
    replaced, all others and repeated rows stay. Null text, text without a letter or a model of no language give ``und`` and 0.
    Whole texts are read."""
    spark = docs.sparkSession
    if model.nbytes() > MODEL_BYTES:
        raise ValueError(f"a model of {model.nbytes()} bytes; fit it on a smaller sample")
    shared, name = spark.sparkContext.broadcast(model), model.name
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, shared)
        for batch in parts(batches, text):
            got = [classify(t.as_py(), scorer) for t in batch[text]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema, *StructType.fromDDL("lang_pred string, score double").fields]))


def held_out(doc_id: str = "doc_id") -> Column:
    return crc_of_id(doc_id) % 3 == 1


def predict(docs: DataFrame) -> DataFrame:
    """One row per document, learned from the documents that aren't held out."""
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
