"""Byte-level BPE encoding and decoding by recursive queries of DuckDB, run by every task over its own words.

The words of a batch become token-position rows. A recursive query joins neighbours with the merge table and
contracts each word's leftmost pair of lowest rank until no pair is left; an ordered aggregation writes the ids and
decodes them. Words of any length go this way."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import parts

#: Words a worker remembers, the latest of them; words sent to DuckDB at once.
CACHE_WORDS, QUERY_WORDS = 600_000, 20_000
#: Bytes of a word from which on a step contracts all its pairs of the lowest rank at once: a step costs its rows, and
#: a word has as many steps as contractions otherwise.
LONG = 64

#: One contraction in each word for each step. ``best`` holds rank, position and right neighbour's position (fewer than
#: 2^20, as words are short); a step's rows are those of words that still have a pair.
SHORT_WORDS = """
WITH RECURSIVE steps(step, word, pos, next_pos, id) AS (
    SELECT 0, word, pos, pos + 1, id FROM letters
  UNION ALL
    SELECT s.step + 1, s.word, s.pos, CASE WHEN s.pos = here THEN after ELSE s.next_pos END, CASE WHEN s.pos = here THEN made ELSE s.id END
    FROM steps s JOIN (
        SELECT word, (best >> 20) & 1048575 AS here, best & 1048575 AS gone, (best >> 40)::INTEGER AS made, after FROM (
            SELECT a.word, min(m.id * 1099511627776 + a.pos * 1048576 + b.pos) AS best, arg_min(b.next_pos, m.id * 1099511627776 + a.pos * 1048576 + b.pos) AS after
            FROM steps a JOIN steps b ON a.word = b.word AND a.next_pos = b.pos JOIN merges m ON m.pair = a.id::BIGINT * 16777216 + b.id
            GROUP BY a.word)) USING (word)
    WHERE s.pos <> gone
),
ends AS (SELECT word, max(step) AS step FROM steps GROUP BY word)
SELECT word, string_agg(id_hex, ' ' ORDER BY pos) FROM steps JOIN ends USING (word, step) JOIN vocabulary USING (id) GROUP BY word
"""
#: All pairs of a word's lowest rank in a step, of overlapping ones every other from the left: the same as one by one, if
#: the token made is in no pair of a lower rank (``safe``); else the leftmost alone. Only the live step is kept; the
#: second half of a contracted pair has id -1.
LONG_WORDS = """
WITH RECURSIVE steps(word, pos, next_pos, id) USING KEY (word, pos) AS (
    SELECT word, pos, pos + 1, id FROM letters
  UNION
    (WITH pairs AS (
        SELECT a.word, a.pos, b.pos AS gone, b.next_pos AS after, m.id, m.safe
        FROM recurring.steps a JOIN recurring.steps b ON a.word = b.word AND a.next_pos = b.pos JOIN merges m ON m.pair = a.id::BIGINT * 16777216 + b.id
        WHERE a.id >= 0),
    hits AS (SELECT pairs.* FROM pairs JOIN (SELECT word, min(id) AS id FROM pairs GROUP BY word) USING (word, id)),
    runs AS (SELECT *, row_number() OVER w AS n, coalesce(lag(gone) OVER w = pos, false) AS follows FROM hits WINDOW w AS (PARTITION BY word ORDER BY pos)),
    picked AS (SELECT * FROM (SELECT *, n - max(CASE WHEN follows THEN 0 ELSE n END) OVER (PARTITION BY word ORDER BY pos) AS place FROM runs) WHERE place % 2 = 0 AND (safe OR n = 1))
    SELECT word, pos, after, id::INTEGER FROM picked UNION ALL SELECT word, gone, NULL, -1 FROM picked)
)
SELECT word, string_agg(id_hex, ' ' ORDER BY pos) FROM steps JOIN vocabulary USING (id) GROUP BY word
"""


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    """Ids of words as text, and the bytes that these ids decode to."""

    def __init__(self, path: str):
        self.ranks = ranks(path)
        rest = [b for b in self.ranks if len(b) > 1]
        single = {bytes([b]): self.ranks[bytes([b])] for b in range(256)}
        self.single = np.array(list(single.values()), np.int32)
        splits = [(self.ranks[b[:i]], self.ranks[b[i:]], self.ranks[b]) for b in rest for i in range(1, len(b)) if b[:i] in self.ranks and b[i:] in self.ranks]
        left, right, made = (np.array([p[i] for p in splits], np.int64) for i in range(3))
        least = np.full(max(self.ranks.values()) + 1, 1 << 40, np.int64)  # the lowest rank of the pairs that a token is in
        for part in (left, right):
            np.minimum.at(least, part, made)
        self.ids: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self.codes: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        vocabulary = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "id_hex": [f"{i} {b.hex()}" for b, i in self.ranks.items()]})
        merges = pa.table({"pair": left << 24 | right, "id": made, "safe": least[made] >= made})
        for name, rows in (("vocabulary", vocabulary), ("merges", merges)):
            self.duck.register("rows", rows)
            self.duck.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.duck.unregister("rows")

    def learn(self, words: set[str]) -> tuple[dict[str, str], dict[str, bytes]]:
        """Ids and bytes of all the words. Of the words before, those used last stay known."""
        if len(self.ids[0]) > CACHE_WORDS // 2:
            self.ids, self.codes = ({}, self.ids[0]), ({}, self.codes[0])
        (ids, old_ids), (codes, old_codes) = self.ids, self.codes
        short: list[tuple[str, bytes]] = []
        long: list[tuple[str, bytes]] = []
        for word in words:
            if word in ids:
                continue
            if word in old_ids:
                ids[word], codes[word] = old_ids[word], old_codes[word]
            elif (rank := self.ranks.get(data := word.encode())) is not None:
                ids[word], codes[word] = str(rank), data  # a token of the vocabulary
            else:
                (short if len(data) < LONG else long).append((word, data))
        for found, query in ((short, SHORT_WORDS), (long, LONG_WORDS)):
            for i in range(0, len(found), QUERY_WORDS):
                self._query(found[i : i + QUERY_WORDS], query)
        return ids, codes

    def _query(self, words: list[tuple[str, bytes]], query: str) -> None:
        flat = np.frombuffer(b"".join(data for _, data in words), np.uint8)
        size = np.array([len(data) for _, data in words])
        letters = pa.table({"word": np.repeat(np.arange(len(words)), size), "pos": np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), "id": self.single[flat]})
        self.duck.register("letters", letters)
        for place, both in self.duck.execute(query).fetchall():
            word, fields = words[place][0], both.split(" ")
            self.ids[0][word], self.codes[0][word] = " ".join(fields[::2]), bytes.fromhex("".join(fields[1::2]))
        self.duck.unregister("letters")


@lru_cache(maxsize=1)
def _coder(path: str) -> Coder:
    """One for each worker, whatever the number of its tasks."""
    return Coder(path)


_PATTERN = regex.compile(public_tokenizers.PATTERN)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids`` (decimal, one blank between) and ``decoded`` (the bytes of the ids) to every row,
    without special tokens. Null or empty text has no ids. Columns of these names are replaced; other columns and
    repeated rows stay."""
    docs = docs.drop("n_tokens", "ids", "decoded")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in parts(batches, text):
            words = [_PATTERN.findall(t.as_py() or "") for t in batch[text]]
            known_ids, known_codes = coder.learn(set().union(*words))
            ids = [" ".join(map(known_ids.__getitem__, own)) for own in words]
            decoded = [b"".join(map(known_codes.__getitem__, own)) for own in words]
            n = [x.count(" ") + 1 if x else 0 for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary())], names=[*names, "n_tokens", "ids", "decoded"])

    return docs.mapInArrow(run, StructType([*docs.schema, *StructType.fromDDL("n_tokens long, ids string, decoded binary").fields]))


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: the digests of its ids and of the decoded bytes."""
    coded = round_trip(docs.select("doc_id", "text"), path or default_path())
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
