"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the benchmark's normalised texts; each
document is scanned once, and what is found is mapped to its original characters.

Normalised, a text is its words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased). The automaton's letters are words of
the benchmark, numbered; a document's words are looked up in that list as whole arrays, and every other word is one letter
that no window has. So the automaton takes a step a word, not a step a byte. Words are told apart by 64 bits of hash.

The automaton goes to every task, so its size is checked: a benchmark of more than ``PART_WORDS`` words is dealt to several
automata, and documents are read once for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, parts
from .tokens import chunks, spans, utf8

WINDOW = 10
#: Words of one automaton, about (at most some 100 MB of nodes in a worker), and of one piece of an item.
PART_WORDS, PIECE_WORDS = 100_000, 10_000
#: Bytes between words.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Letters: 1 is any word that the benchmark doesn't have (and the end of a document), words are numbered from 2.
OTHER, FIRST = 1, 2

PIECES = "item string, words array<bigint>"


def _pieces(window: int, piece: int):
    """Items -> their words' hashes, in pieces that share ``window`` - 1 words, so that each window lies in a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            flat, offsets = utf8(batch["text"])
            for a, b in chunks(offsets):
                hashes, _, _, at = spans(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BETWEEN)
                names, words = [], []
                for name, low, high in zip(batch["item"].slice(a, b - a).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for first in range(low, max(high - window + 1, low + (high > low)), piece):
                        names.append(name)
                        words.append(hashes[first : min(high, first + piece + window - 1)].view(np.int64))
                if names:
                    ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(words)))], names=["item", "words"])

    return run


def _code(letters: np.ndarray) -> str:
    """Letters as characters (those of UTF-16's surrogates are left out)."""
    return (letters + 0x800 * (letters >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")


class Windows:
    """All windows of some pieces: the automaton (letters -> number of the window), lengths, and items by window."""

    def __init__(self, names: list[str], words: np.ndarray, ends: np.ndarray, window: int):
        self.items = sorted(set(names), key=lambda s: s.encode())
        place = {name: i for i, name in enumerate(self.items)}
        self.words, letters = np.unique(np.append(words, 0), return_inverse=True)  # never empty
        text = _code(letters[:-1] + FIRST)
        number: dict[str, int] = {}
        found: list[set[int]] = []
        bounds = [0, *ends.tolist()]
        for name, low, high in zip(names, bounds[:-1], bounds[1:], strict=True):
            size = min(window, high - low)
            for i in range(low, high - size + 1):
                k = number.setdefault(text[i : i + size], len(found))
                if k == len(found):
                    found.append(set())
                found[k].add(place[name])
        self.automaton = ahocorasick.Automaton()
        for key, k in number.items():
            self.automaton.add_word(key, k)
        self.automaton.make_automaton()
        self.length = np.array([len(key) for key in number], np.int64)
        self.of = [np.array(sorted(x), np.int64) for x in found]

    def matches(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last letters of all occurring windows, and the windows' numbers."""
        pairs = np.fromiter(chain.from_iterable(self.automaton.iter(_code(letters)) if len(self.length) else ()), np.int64)
        return pairs[::2], pairs[1::2]


#: The last automaton that this worker has built.
_BUILT: dict[str, Windows] = {}


def _built(name: str, model) -> Windows:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows(*model.value)
    return _BUILT[name]


FOUND = "n_words long, n_hit long, spans array<struct<start:int,end:int,word:int,words:int>>, items array<string>"
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.int32()), ("words", pa.int32())])


def _runs(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of hit words, none over the end of a row."""
    cut = np.zeros(len(hit) + 1, bool)
    cut[first] = True
    before, after = np.append(False, hit[:-1]), np.append(hit[1:], False)
    return np.flatnonzero(hit & (~before | cut[:-1])), np.flatnonzero(hit & (~after | cut[1:]))


def _found(flat: np.ndarray, offsets: np.ndarray, windows: Windows, memo: dict) -> list[pa.Array]:
    """The columns of ``FOUND`` for rows of text."""
    hashes, starts, ends, first = spans(flat, offsets, BETWEEN)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    place = np.minimum(np.searchsorted(windows.words, hashes.view(np.int64)), len(windows.words) - 1)
    letters = np.full(len(hashes) + rows, OTHER, np.int64)
    letters[np.arange(len(hashes)) + row] = np.where(windows.words[place] == hashes.view(np.int64), place + FIRST, OTHER)
    last, number = windows.matches(letters)
    of = np.searchsorted(first + np.arange(rows + 1), last, "right") - 1
    last -= of
    depth = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(depth, last - windows.length[number] + 1, 1)
    np.add.at(depth, last + 1, -1)
    hit = np.cumsum(depth[:-1]) > 0
    count = np.concatenate([[0], np.cumsum(hit)])
    low, high = _runs(hit, first)
    letter = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)]) if len(low) else np.zeros(len(flat) + 1, np.int64)
    own = row[low]
    base = letter[offsets[own]]
    cells = [letter[starts[low]] - base, letter[ends[high]] - base, low - first[own], high - low + 1]
    span = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in cells], fields=list(SPAN))
    items: list[list[str]] = [[] for _ in range(rows)]
    pairs = np.unique(of * len(windows.length) + number)
    by_row, of_row = pairs // len(windows.length), pairs % len(windows.length)
    for r in np.unique(by_row).tolist():
        key = tuple(of_row[slice(*np.searchsorted(by_row, [r, r + 1]))].tolist())
        if key not in memo:
            if len(memo) >= 1000:
                memo.clear()
            memo[key] = [windows.items[i] for i in np.unique(np.concatenate([windows.of[k] for k in key])).tolist()]
        items[r] = memo[key]
    return [pa.array(np.diff(first)), pa.array(count[first[1:]] - count[first[:-1]]), pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(rows + 1)).astype(np.int32)), span), pa.array(items, pa.list_(pa.string()))]


def _scan(name: str, model, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, memo = _built(name, model), {}
        for batch in parts(batches, "text"):
            flat, offsets = utf8(batch["text"])
            for a, b in chunks(offsets):
                made = _found(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], windows, memo)
                yield pa.RecordBatch.from_arrays([batch[key].slice(a, b - a), *made], names=[key, "n_words", "n_hit", "spans", "items"])

    return run


def _united(spans: list[dict]) -> list[dict]:
    """Spans of words that overlap or follow each other as one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["word"]):
        if out and s["word"] <= out[-1]["word"] + out[-1]["words"]:
            if s["word"] + s["words"] > out[-1]["word"] + out[-1]["words"]:
                out[-1] = out[-1] | {"end": s["end"], "words": s["word"] + s["words"] - out[-1]["word"]}
        else:
            out.append(s)
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        united = [_united(list(chain.from_iterable(x))) for x in batch["spans"].to_pylist()]
        hit = pa.array([sum(s["words"] for s in x) for x in united], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["row"], batch["n_words"], hit, pa.array(united, pa.list_(SPAN)), batch["items"]], names=["row", "n_words", "n_hit", "spans", "items"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_texts: tuple[str, ...] = ("text",), item_id: str = "item_id", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, spans, items, contaminated``.

    A window is ``window`` consecutive words of one of an item's ``item_texts`` (question, answer); a text of fewer words, but not
    none, is one. A document's word is hit if an occurrence of a window covers it. ``spans`` are the runs of hit words: first
    character (from 0, code points of the original text) and the one after the last, first word (from 0), number of words.
    ``items`` are the ids of the items with occurring windows, as text, sorted by their UTF-8; items of one id are one item, and
    items without an id are one item of empty name. Null texts have no words; repeated rows are rows of their own; other
    columns are not read. Without documents there is no row, without items nothing is hit.
    """
    texts = F.inline(F.array(*[F.struct(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(c).alias("text")) for c in item_texts]))
    pieces = kept(items.select(texts).mapInArrow(_pieces(window, PIECE_WORDS), PIECES), "pieces")
    size = int(pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0])
    n = -(-size // part_words)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    if n > 1:
        rows = kept(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    found = None
    for i in range(max(n, 1)):
        own = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(max(n, 1))) == i).toArrow()
        words = own["words"].combine_chunks()
        ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        model = docs.sparkSession.sparkContext.broadcast((own["item"].to_pylist(), words.flatten().to_numpy(zero_copy_only=False), ends, window))
        key = "doc_id" if n <= 1 else "row"
        part = rows.select(key, "text").mapInArrow(_scan(uuid.uuid4().hex, model, key), f"{key} {id_type if n <= 1 else 'long'}, {FOUND}")
        found = part if found is None else found.unionByName(part)
    if n > 1:
        each = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = rows.select("row", "doc_id").join(each.mapInArrow(_merged, f"row long, {FOUND}"), "row")
    return found.select("doc_id", "n_words", "n_hit", "spans", "items", (F.col("n_hit") > 0).alias("contaminated"))


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    names = F.array_join("items", ",")
    return decontaminate(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")
