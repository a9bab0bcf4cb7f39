"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths, one sequence each."""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import held, parts

#: Words whose ids a worker remembers, those used last.
CACHE_WORDS = 800_000
SCHEMA = "row_key long, doc_id long, start long, length long, doc_tokens long, offset long, bucket int, ids_crc32 long"


#: Marks that can join an ASCII letter; in texts that have one, case isn't folded before looking words up.
_MARK = re.compile("[\u0300-\u036f]")


#: Words of Latin letters that fold and compose one by one, perhaps with ASCII marks after them.
_PLAIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[" + re.escape(string.punctuation) + "]*")
#: The letters by which byte-level models write bytes that aren't printable: 256 and on, in order.
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


class _Ids(dict):
    """The ids of a chunk without blanks and line feeds, as little-endian 32-bit integers.

    The tokenizer never lets a token cross white space, so the ids of a text are those of its chunks in order, and
    many new chunks are encoded at once, with blanks between them; a token's offset tells its chunk."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # control strings in texts are ordinary text
        self.old: dict[str, bytes] = {}

    def _new(self, chunks: set[str]) -> set[str]:
        """Those that aren't remembered; what the older half has moves to the newer."""
        new = chunks.difference(self)
        if not self.old:
            return new
        unseen = new.difference(self.old)
        known = new - unseen
        self.update(zip(known, map(self.old.__getitem__, known), strict=True))
        return unseen

    def learn(self, chunks: set[str]) -> None:
        if len(self) > CACHE_WORDS // 2:
            self.old = dict(self)
            self.clear()
        new = self._new(chunks)
        plain = list(filter(_PLAIN.fullmatch, new))
        # letters are one word for the model; the marks after them, with no letter behind, are another
        letters = [c.rstrip(string.punctuation) for c in plain]
        marks = [c[len(w) :] for c, w in zip(plain, letters, strict=True)]
        self._learn_mixed([*new.difference(plain).union(self._new(set(marks) - {""}))])
        if words := self._new(set(letters)):
            ascii_, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
            spelt = ascii_ + ("!".join(other).lower().encode().decode("latin-1").translate(_BYTES).split("!") if other else [])
            found = list(map(self.tokenizer.model.tokenize, spelt))
            data = np.array([t.id for got in found for t in got], "<u4").tobytes()
            places = accumulate((4 * len(got) for got in found), initial=0)
            self.update((w, data[i:j]) for w, (i, j) in zip(ascii_ + other, pairwise(places), strict=True))
        self.update((c, self[w] + self[m]) for c, w, m in zip(plain, letters, marks, strict=True) if m)

    def _learn_mixed(self, new: list[str]) -> None:
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids))
            size = np.fromiter(map(len, part), np.int64, len(part)) + 1
            cut = (4 * np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))).tolist()
            data = np.array(got.ids, "<u4").tobytes()
            self.update((c, data[cut[k] : cut[k + 1]]) for k, c in enumerate(part))


def _ids(path: str) -> _Ids:
    return held(("ids", path), lambda: _Ids(path))


def split(text: str | None) -> list[str]:
    """The chunks of a text (null: empty) between blanks and line feeds.

    The tokenizer folds case itself; folding A-Z first makes more chunks equal and changes no id, unless a mark follows."""
    text = text or ""
    if text.isascii():
        text = text.lower()
    elif not _MARK.search(text):
        text = text.encode().lower().decode()  # bytes fold A-Z alone
    return text.replace("\n", " ").split(" ")


def token_bytes(texts: list[str | None], ids: _Ids, end: int) -> list[bytes]:
    """For each text its ids and then ``end``, four bytes each."""
    last = np.array([end], "<u4").tobytes()
    chunks = [split(t) for t in texts]
    ids.learn(set().union(*chunks))
    return [b"".join(map(ids.__getitem__, own)) + last for own in chunks]


def pieces(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of all pieces of documents of so many tokens, in order: as many of ``most`` as fit, then the binary
    digits of the rest, falling."""
    digits = np.arange(most.bit_length() - 2, -1, -1)
    times = np.column_stack([sizes // most, sizes[:, None] % most >> digits & 1])
    kinds = np.append(most, 1 << digits)
    return np.repeat(np.arange(len(sizes)), times.sum(axis=1)), np.repeat(np.tile(kinds, len(sizes)), times.ravel())


def pack(docs: DataFrame, path: str, most: int = 2048, end: int = 1, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, each a sequence of its own of 2^bucket tokens (at most ``most``, a power of two), so no
    sequence crosses documents and none needs padding: ``row_key, doc_id, start, length, doc_tokens, offset, bucket,
    ids_crc32, ids, sequence_id``.

    The tokens of a document are its text's ids by the tokenizer file ``path`` and then ``end``; a null or empty text
    has ``end`` alone. Repeated rows, rows of one id and rows without one are packed each on its own; ``row_key`` tells them
    apart. Other input columns are not read. ``ids`` are a piece's ids, 32-bit little-endian
    (left out without ``with_ids``: a reader of checksums alone needn't fetch them), ``ids_crc32`` is their checksum. ``sequence_id`` is unique and
    rises with the bucket: in its order, sequences of equal length stand together. An empty table gives no pieces.
    """
    if most & (most - 1):
        raise ValueError("most must be a power of two")

    schema = SCHEMA + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for batch in parts(batches, "t"):
            coded = token_bytes(batch["t"].to_pylist(), ids, end)
            sizes = np.array([len(x) // 4 for x in coded], np.int64)
            doc, length = pieces(sizes, most)
            after = np.cumsum(length)
            start = after - length - (np.cumsum(sizes) - sizes)[doc]
            # pieces stand one after the other in the ids of all documents, so they are cut by their places alone
            data, places = memoryview(b"".join(coded)), np.append(0, 4 * after).astype(np.int64)
            crc = np.array([zlib.crc32(data[a:b]) for a, b in pairwise(places.tolist())], np.int64)
            at = pa.array(doc)
            columns = [batch["k"].take(at), batch["d"].take(at), *map(pa.array, (start, length, sizes[doc], np.zeros(len(doc), np.int64), np.log2(length).astype(np.int32), crc))]
            if with_ids:
                columns.append(pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(places), pa.py_buffer(data)]).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in schema.split(", ")])

    cut = docs.select(F.monotonically_increasing_id().alias("k"), F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)
    # a task counts its own pieces below 2^33, its number stands above (below 2^26) and the bucket above that: ids never meet
    return cut.withColumn("sequence_id", F.shiftleft(F.col("bucket").cast("long"), 59) + F.monotonically_increasing_id())


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, ``bucket=N``, so that a trainer reads sequences of equal length together."""
    packed.write.partitionBy("bucket").parquet(path)


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")
