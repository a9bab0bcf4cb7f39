"""Each operator against a brute-force version on a small table, and defined results on odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import time
import weakref
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from duelkit.llm import bpe, chat, interpolation, language, lines, media, packing, sharding, shingles, syncmers
from duelkit.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F
from tokenizers import Tokenizer

ODD = [
    (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "one two", "en"), (5, "One TWO", "en"), (6, "one two", None), (None, "one two three four five six", "de"),
    (7, "x" * 3000, "en"), (8, "de la le et un " * 3000, "fr"), (8, "de la le et un " * 3000, "fr"), (9, "H̱a İ \U0001f600 <|endoftext|> <|im_end|>\\", "xx"), (10, "123 456 !!", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("source", "n_chars", "score", "n", "band", "slot", "bucket", "media", "ids", "row_key")})


@pytest.fixture(scope="module")
def texts(small):
    return dict(pd.read_parquet(f"{small}/documents.parquet")[["doc_id", "text"]].itertuples(index=False))


def rows(spark, small, name):
    return QUERIES[name](spark, small).toPandas()


def words(text, end=False):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ([None] if end else [])


def test_media(spark, small, texts, odd):
    for r in rows(spark, small, "op1_media_columns").itertuples():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    out = media.media_digest(odd).toPandas()
    assert len(out) == len(ODD) and (out[out.doc_id.isin([1, 2])].payload_bytes == 64).all() and out[out.doc_id == 8].feature.nunique() == 1
    tone = (128 + 100 * np.sin(np.arange(4096) * 2 * np.pi * 20 / media.FRAME)).astype(np.uint8)
    assert (media.spectrogram(tone).argmax(axis=1) == 20).all()


def test_media_hears_the_tail():
    """A frame reaches the last block of every payload, whatever its length."""
    for size in range(64, 1089, 64):
        a = np.full(size, 32, np.uint8)
        b = a.copy()
        b[-64:] = np.frombuffer(b"abcdefgh" * 8, np.uint8)
        one, two = media.spectrogram(a), media.spectrogram(b)
        assert one.shape == two.shape and len(one) == 1 + max(0, -(-(size - media.FRAME) // media.HOP)) and not np.allclose(one[-1], two[-1]), size


def test_landmarks_equal_loops():
    """Frames, peaks and pairs by plain loops."""
    rng = np.random.default_rng(4)
    text = np.frombuffer(" ".join(f"w{i * 7919 % 997}" for i in range(900)).encode(), np.uint8)
    for samples in (np.zeros(64, np.uint8), rng.integers(0, 256, 1000, dtype=np.uint8), text):
        x = [(int(v) - 128) / 128 for v in samples]
        x += [0.0] * (media.FRAME - len(x) if len(x) < media.FRAME else -(len(x) - media.FRAME) % media.HOP)
        window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (media.FRAME - 1)) for i in range(media.FRAME)]
        tops = []
        for start in range(0, len(x) - media.FRAME + 1, media.HOP):
            power = np.abs(np.fft.rfft([x[start + i] * window[i] for i in range(media.FRAME)])) ** 2
            row = []
            for low, high in media.BANDS:
                best = max(range(low, high), key=lambda b: (round(float(power[b]), 9), -b))
                row.append((round(math.log1p(power[best]), 4), best))
            tops.append(row)
        peaks = []
        for t in range(len(tops)):
            for band in range(len(media.BANDS)):
                here = tops[t][band][0]
                before, after = (tops[t - 1][band][0] if t else -1), (tops[t + 1][band][0] if t + 1 < len(tops) else -1)
                if here > before and here >= after and here > 0.001:
                    peaks.append((t, tops[t][band][1]))
        peaks.sort()
        codes = sorted(t << 32 | f << 16 | g << 8 | (u - t) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 1 + media.FAN] if u - t <= media.REACH)
        got = media.landmarks(samples).tolist()
        # float32 spectra differ from these in the last digits, which may move a peak in a tie of four digits
        assert len(set(got) ^ set(codes)) <= 0.02 * max(1, len(codes)), (len(got), len(codes))
    assert codes


def test_scores_equal_loops(spark, texts):
    """Counts, buckets, weights and scores by plain loops."""
    use = {i: {2: 2, 3: 1}.get(zlib.crc32(str(i).encode()) % 7, 0) for i in texts}
    fit, train, two_fit, two_train = Counter(), Counter(), Counter(), Counter()
    for i, t in texts.items():
        w = words(t, True)
        pairs = list(zip([None, *w], w))
        if use[i] < 2:
            train.update(w)
            two_train.update(pairs)
        if use[i] == 0:
            fit.update(w)
            two_fit.update(pairs)
    kinds = len(train)
    bucket = lambda c: min(int(math.log2(c)) + 1, interpolation.BUCKETS - 1) if c else 0
    grid = lambda p: min(max(interpolation.GRID - 1 + round(20 * math.log10(p)), 1), interpolation.GRID - 1) if p else 0
    value = lambda g: 10 ** ((g - interpolation.GRID + 1) / 20) if g else 0.0
    held = defaultdict(Counter)
    for i, t in texts.items():
        if use[i] == 1:
            w = words(t, True)
            for v, x in zip([None, *w], w):
                held[bucket(fit[v])][grid(two_fit[v, x] / fit[v] if fit[v] else 0), grid(fit[x] / sum(fit.values()))] += 1
    weights = {}
    for b in range(interpolation.BUCKETS):
        a = [1 / 3] * 3
        for _ in range(interpolation.STEPS):
            got = [0.1] * 3
            for (g2, g1), n in held[b].items():
                parts = [a[0] * value(g2), a[1] * value(g1), a[2] / (kinds + 1)]
                for k in range(3):
                    got[k] += n * parts[k] / sum(parts)
            a = [g / sum(got) for g in got]
        weights[b] = a
    a, b, c = weights[0]
    weights[0] = [0.0, b + a * b / (b + c), c + a * c / (b + c)]
    total = sum(train.values())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block, part in ((interpolation.BLOCK_BYTES, interpolation.SLICE_BYTES), (20_000, 3_000)):
        scored = interpolation.score(docs.join(spark.createDataFrame(list(use.items()), "doc_id long, use int"), "doc_id"), block, part).collect()
        assert len(scored) == len(texts)
        for r in scored:
            w, want = words(texts[r.doc_id], True), 0.0
            for v, x in zip([None, *w], w):
                p = weights[bucket(train[v])]
                want += math.log10((p[0] * two_train[v, x] / train[v] if train[v] else 0) + p[1] * train[x] / total + p[2] / (kinds + 1))
            assert r.score == pytest.approx(want, rel=1e-6, abs=1e-4) and r.n_known == sum(train[x] > 0 for x in w)
    numbers = np.array([0, 1, 255, 256, 70_000, 1 << 40], np.uint64)
    assert interpolation.unpacked(interpolation.packed(numbers)).tolist() == numbers.tolist() and len(interpolation.packed(numbers[:3])) == 4


def test_scoring(spark, small, texts, odd):
    count = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(words(t, True))
    total, kinds = sum(count.values()), len(count)
    for r in rows(spark, small, "op2_lm_scoring").itertuples():
        own = words(texts[r.doc_id], True)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in own), abs=1e-4) and r.score < 0
    out = interpolation.scores(odd).toPandas()
    assert len(out) == len(ODD) and (out[out.doc_id.isin([1, 2, 3])].n_tokens == 1).all() and out[out.doc_id.isin([4, 5, 6])].score.nunique() == 1


def test_weights_and_unknown_words(spark):
    """The weights of a bucket sum to 1, and a word that training lacks is the least likely."""
    docs = spark.createDataFrame([(i, "a b a c", i % 2) for i in range(40)] + [(99 + i, w, 2) for i, w in enumerate(("a", "b", "c", "zzz", ""))], "doc_id long, text string, use int")
    got = {r.doc_id: r.score for r in interpolation.score(docs).where("doc_id >= 99").collect()}
    end = {w: got[99 + i] for i, w in enumerate("abc")}
    weights = interpolation.learn_weights({interpolation.GRID**2 * 3 + interpolation.GRID * 150 + 100: 50}, 4)
    assert np.allclose(weights.sum(axis=0), 1) and all(v < 0 for v in end.values()) and got[102] < max(end.values())


def test_small_estimates_keep_their_size():
    """Estimates of 10^-14, as in corpora of 10^14 tokens, are not raised to a floor."""
    p = np.array([1.0, 0.3, 1e-9, 1e-14, 3e-19])
    grid = interpolation._grid(p)
    assert 10 ** ((grid - interpolation.GRID + 1) / 20) == pytest.approx(p, rel=0.06) and interpolation._grid(np.zeros(1))[0] == 0
    one, two = (interpolation.learn_weights({int(interpolation._grid(np.array([x]))[0]) + interpolation.GRID**2 * 4: 1000}, 10**14)[:, 4] for x in (1e-13, 1e-15))
    assert one[1] > 0.9 > 0.2 > two[1]  # the even share is 10^-14


def test_ids_of_words_with_marks_behind(monkeypatch):
    """Words with any ASCII marks after them go to the model by themselves; all ids are the tokenizer's, in both halves of the memory."""
    seen = []
    monkeypatch.setattr(packing, "CACHE_WORDS", 12)
    monkeypatch.setattr(packing._Ids, "_learn_mixed", lambda self, new, real=packing._Ids._learn_mixed: (seen.extend(new), real(self, new))[1])
    text = "eranes$$$ menteque,%%% señor*** thing'' can't ''s it's, a.b x'&t <|endoftext|> É!! e\u0301. Ña###\nwhat?' rock-n-roll @@ 12. ok.. wörld<| l'$ ._"
    tokenizer = Tokenizer.from_file(packing.default_path())
    tokenizer.encode_special_tokens = True
    ids = packing._Ids(packing.default_path())
    for part in (text, *text.split(" "), text.upper(), text):
        assert np.frombuffer(packing.token_bytes([part], ids, 1)[0], "<u4").tolist() == [*tokenizer.encode(part, add_special_tokens=False).ids, 1]
    assert ids.old and not {"eranes$$$", "menteque,%%%", "thing''", "what?'"} & set(seen)


def test_workers_hold_one_thing():
    """What a worker holds of an earlier stage goes when another begins."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "doc": [1], "row_key": [1], "text": ["a b c d e f"], "lang": ["en"]})
    for begin in (shingles._signed, language._counts, lines._lines(20, 5)):
        ids = packing._ids(packing.default_path())
        assert packing._ids(packing.default_path()) is ids
        gone = weakref.ref(ids)
        del ids
        assert list(begin(iter([batch]))) and gone() is None
    gone = weakref.ref(packing._ids(packing.default_path()))
    model = language.Model(["en"], [pa.array([], pa.string())] * 5, np.zeros((5, 1)), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    assert language._scorer(model.name, SimpleNamespace(value=model)) is not None and gone() is None


def test_packing(spark, small, texts, odd):
    tokenizer = Tokenizer.from_file(packing.default_path())
    tokenizer.encode_special_tokens = True
    for table, source in ((rows(spark, small, "op3_packing"), texts), (packing.pack(odd, packing.default_path()).dropDuplicates(["doc_id", "start"]).toPandas(), {i: t for i, t, _ in ODD if i})):
        for i, own in table.groupby("doc_id"):
            ids = tokenizer.encode(source[i] or "", add_special_tokens=False).ids + [1]
            at = 0
            for r in own.sort_values("start").itertuples():
                assert r.start == at and r.length <= 2048 and r.length & (r.length - 1) == 0 and r.offset == 0 and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
        assert table.sequence_id.is_unique and table.sort_values("sequence_id").bucket.is_monotonic_increasing
    packed = packing.pack(odd, packing.default_path()).toPandas()
    for _, own in packed.groupby("row_key"):
        own = own.sort_values("start")
        ids = np.frombuffer(b"".join(own["ids"]), "<u4")
        text = {i: t for i, t, _ in ODD}[None if pd.isna(own.doc_id.iloc[0]) else own.doc_id.iloc[0]]
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [1] and (own.length == own.ids.map(len) // 4).all()
    assert packed.row_key.nunique() == len(ODD)
    doc, length = packing.pieces(np.array([5000, 1, 2048, 0, 4095]), 2048)
    assert [length[doc == i].tolist() for i in range(5)] == [[2048, 2048, 512, 256, 128, 8], [1], [2048], [], [2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1]]


def test_language(spark, small, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.98 and out.score.between(0, 1).all()
    got = language.predict(odd).toPandas()
    assert len(got) == len(ODD) and (got[got.doc_id.isin([1, 2, 3, 10])].lang_pred == "und").all() and (got[got.doc_id == 8].score >= 0).all()
    assert language.predict(odd.where("lang is null")).where("lang_pred <> 'und'").count() == 0


def plain_language(rows):
    """A classifier from (text, lang) by plain counts: words first, then the longest known n-grams."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        for w in language.WORD.findall(text.lower()):
            counts[lang, 0][w] += 1
    for lang in {k for k, _ in counts}:
        for w, n in counts[lang, 0].items():
            for size in range(1, language.LONGEST + 1):
                for g in language.grams(w, size):
                    counts[lang, size][g] += n
    langs = sorted({k for k, _ in counts})
    known = [{u for lang in langs for u, n in counts[lang, size].items() if n >= language.LEAST_COUNT} for size in range(language.LONGEST + 1)]

    def units(w, size):
        return [g for g in language.grams(w, size) if g in known[size]]

    def value(lang, size, u):
        n = counts[lang, size][u]
        return math.log(((n if n >= language.LEAST_COUNT else 0) + 0.5) / (sum(counts[lang, size].values()) + 0.5 * max(1, len(known[size]))))

    def classify(text):
        total = dict.fromkeys(langs, 0.0)
        if not any(map(str.isalpha, text or "")):
            return "und", 0.0
        for w in language.WORD.findall(text.lower()):
            size = next((n for n in range(language.LONGEST, 0, -1) if units(w, n)), None)
            for lang in langs:
                if w in known[0]:
                    total[lang] += value(lang, 0, w)
                elif size:
                    total[lang] += sum(value(lang, size, g) for g in units(w, size)) / len(units(w, size))
        best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
        return best, 1 / sum(math.exp(max(v - total[best], -700)) for v in total.values())

    return classify


def test_language_equals_loops(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    train = docs[[zlib.crc32(str(i).encode()) % 3 != 1 for i in docs.doc_id]].dropna(subset=["lang", "text"])
    classify = plain_language(list(train[["text", "lang"]].itertuples(index=False)))
    some = docs[docs.text.str.len() <= 3000].head(60)
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op4_language_id"](spark, small).collect()}
    for r in some.itertuples():
        lang, score = classify(r.text)
        assert got[r.doc_id] == (lang, pytest.approx(score, abs=1e-3))
    name = lambda i: "".join(chr(97 + int(d)) for d in f"{i % 300:03}")
    many = spark.createDataFrame([(i, f"wort{name(i)} ding{name(i)} und{name(i)}", name(i)) for i in range(2400)], "doc_id long, text string, lang string")
    told = language.predict(many).where("held_out").join(many.select("doc_id", "lang"), "doc_id").toPandas()
    assert (told.lang_pred == told.lang).mean() > 0.9  # of 300 languages none is left out


def test_sharding(spark, small, texts, odd):
    out = rows(spark, small, "op5_sharding")
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sizes = out.groupby("shard").size()
    assert len(out) == len(texts) and sizes.max() - sizes.min() <= 1
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and getattr(r, "size") == len(texts[r.doc_id].encode()) + 1 for r in out.rename(columns={"size": "size"}).itertuples())
    assert sharding.shuffle_shards(odd, 4).groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] == 0
    same = sharding.shuffle_shards(odd, 4).select("doc_id", "shard", "slot")
    assert sorted(map(str, same.collect())) == sorted(map(str, same.collect()))
    names = ["uid", "block", "to", "rank", "slice", "at", "n", "start", "row", "_block", "a b", "x.y"]
    clash = spark.range(50).select(*[F.col("id").alias(c) for c in names])
    made = sharding.shuffle_shards(clash, 3).toPandas()
    assert list(made.columns) == [*names, "slot", "shard"] and sorted(made["x.y"]) == list(range(50)) and (made["to"] == made["_block"]).all()
    m = np.array(sharding.matrix([10, 0, 25], [12, 12, 11], 3))
    assert m.sum(axis=1).tolist() == [10, 0, 25] and m.sum(axis=0).tolist() == [12, 12, 11]
    big = [sharding.hypergeometric(np.random.default_rng(i), 10**10, 2 * 10**10, 3 * 10**6) for i in range(50)]
    assert abs(np.mean(big) - 10**6) < 1000


def test_lines(spark, odd):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"start\n{long}\nend here", 0), (2, f"other\n{long}\nnew text", 0), (3, f"{long}\nmore\n{long}", 0), (4, "start\nend here", 0), (5, None, 0), (6, "", 0), (7, f"start\n{long}\nend here", 0)], "doc_id long, text string, row_key int")
    got = {r.doc_id: (r.text, r.lines_cut) for r in lines.dedup_lines(docs).collect()}
    assert got[1] == (f"start\n{long}\nend here", []) and got[2] == ("other\nnew text", [1]) and got[3] == ("more", [0, 2])
    assert got[4][0] == "start\nend here" and got[5] == (None, []) and got[6] == ("", []) and got[7] == ("", [0, 1, 2])
    named = docs.withColumns({"cut": F.col("doc_id") * 2, "row": F.lit("r"), "lines": F.lit(1)})
    out = lines.dedup_lines(named)
    assert out.columns == [*named.columns, "n_lines", "lines_cut"] and {r["doc_id"]: (r["text"], r["lines_cut"]) for r in out.collect()} == got
    assert all((r["row_key"], r["cut"], r["row"], r["lines"]) == (0, r["doc_id"] * 2, "r", 1) for r in out.collect()) and lines.dedup_lines(named.limit(0)).count() == 0
    out = lines.dedup_lines(odd).toPandas()
    assert len(out) == len(ODD) and lines.rising([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])


def test_lines_leave_no_known_block(spark, small, texts):
    """No run of lines of enough words that an earlier document has is left, and nothing else goes."""
    out = {r.doc_id: r for r in lines.dedup_lines(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    seen: set[str] = set()
    for i in sorted(texts):
        own, cut = texts[i].split("\n"), set(out[i].lines_cut)
        assert out[i].text == "\n".join(x for k, x in enumerate(own) if k not in cut)
        for k, x in enumerate(own):
            key = " ".join(words(x))
            if len(words(x)) >= lines.MIN_WORDS:
                assert k in cut or key not in seen
        seen.update(" ".join(words(x)) for x in own)
        assert all(" ".join(words(own[k])) in seen for k in cut)


def test_many_equal_lines(spark):
    """100,000 equal lines that an earlier row has once, and the other way round, in good time."""
    line = " ".join(f"w{i}" for i in range(25))
    began = time.process_time()
    for old, new in ((1, 100_000), (100_000, 1), (100_000, 100_000), (3, 50_000)):
        gone: set[int] = set()
        lines.common_blocks([7] * old, [1] * old, [7] * new, [1] * new, [25] * new, 20, gone)
        assert len(gone) == new
    assert time.process_time() - began < 10
    docs = spark.createDataFrame([(1, line), (2, "\n".join([line] * 100_000) + "\nend"), (None, line), (None, "own")], "doc_id long, text string")
    got = {(r.doc_id, r.n_lines): r.text for r in lines.dedup_lines(docs).collect()}
    assert got[2, 100_001] == "end" and got[1, 1] == "" and sorted(t for (i, _), t in got.items() if i is None) in ([line, "own"], [line], ["own"])


def test_a_passage_of_very_many(spark):
    """One passage in thousands of rows: linked with its first holder, dealt to several copies of its lines."""
    line = " ".join(f"w{i}" for i in range(25))
    docs = spark.range(3500).select("id", F.concat(F.lit(f"{line}\nnumber "), F.col("id").cast("string")).alias("text"))
    out = lines.dedup_lines(docs, doc_id="id")
    assert out.where("size(lines_cut) = 1 and lines_cut[0] = 0").count() == 3499 and out.where("text = concat('number ', id)").count() == 3499


def test_rare_short_lines_and_copies(spark):
    """Rare lines below 20 words go, frequent ones stay; copies of short documents go, however many."""
    rare, often = "eight words that only two documents here share", "a line of many documents is left"
    table = [(1, f"first\n{rare}"), (2, f"{rare}\nsecond"), *[(i, f"{often}\nnumber {i} of them") for i in range(10, 25)], *[(i, "two Words\n\n") for i in (30, 31)], (32, "two  words")]
    got = {r.doc_id: (r.text, r.lines_cut) for r in lines.dedup_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got[1] == (f"first\n{rare}", []) and got[2] == ("second", [0])
    assert all(got[i] == (f"{often}\nnumber {i} of them", []) for i in range(10, 25))
    assert got[30] == ("two Words\n\n", []) and got[31] == ("", [0, 1, 2]) and got[32] == ("", [0])


def test_lines_leave_no_rare_line_and_no_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    keys = {i: [" ".join(words(x)) for x in t.split("\n")] for i, t in texts.items()}
    holders = Counter(k for own in keys.values() for k in set(own))
    out = {r.doc_id: set(r.lines_cut) for r in lines.dedup_lines(docs).collect()}
    seen: set[str] = set()
    whole: set[tuple[str, ...]] = set()
    found = 0
    for i in sorted(texts):
        copy = tuple(filter(None, keys[i])) in whole
        for k, x in enumerate(keys[i]):
            if x and x in seen and (copy or len(x.split(" ")) >= lines.RARE_WORDS and holders[x] <= lines.RARE_DOCS):
                found += len(x.split(" ")) < lines.MIN_WORDS
                assert k in out[i]
        assert all(keys[i][k] in seen for k in out[i])
        seen.update(keys[i])
        whole.add(tuple(filter(None, keys[i])))
    assert found


def test_bpe(spark, small, texts, odd):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_path(), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for out, source in ((rows(spark, small, "op7_byte_bpe"), texts), (bpe.digest(odd).toPandas(), {i: t for i, t, _ in ODD if i})):
        for r in out.dropna().itertuples():
            text = source[r.doc_id] or ""
            ids = library.encode_ordinary(text)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def brute(texts, threshold):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    holders = defaultdict(list)
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in holders[s]).items():
            if 100 * n >= threshold * (len(sets[i]) + len(sets[j]) - n) and find(i) != find(j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark, small, texts, odd):
    want = brute(texts, 85)
    for r in rows(spark, small, "op8_minhash_near_dedup").itertuples():
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    out = shingles.near_duplicates(odd).toPandas()
    assert len(out) == len(ODD) and (out[out.doc_id.isin([4, 5, 6])].component_id == 4).all() and out[out.doc_id.isin([1, 2, 3])].kept.all()
    assert shingles.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_in_a_crowded_group(spark):
    """Copies of one text with different edits: hubs, chains and strangers in the same buckets."""
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            w[k] = f"e{rng.integers(0, 40)}"
        texts[i] = " ".join(w)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute(texts, 85)


def test_near_duplicates_without_ids(spark):
    """Rows without an id, of one id and of other texts with one id are linked by their texts."""
    base = [f"t{i}" for i in range(200)]
    edit = lambda k: " ".join(base[:k] + ["other"] + base[k + 1 :])
    table = [(1, " ".join(base)), (None, edit(0)), (None, edit(199)), (3, "x y z"), (3, edit(100)), (3, edit(100)), (None, "a b c d e f g"), (None, "A b c d e f g"), (None, "a b c d e f g"), (None, None), (None, "")]
    got = shingles.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).toPandas()
    assert len(got) == len(table)
    linked = got[got.n_shingles > 150]
    assert (linked.component_id == 1).all() and linked[linked.doc_id.isna()].shape[0] == 2 and linked.kept.sum() == 1
    assert got[(got.doc_id == 3) & (got.n_shingles == 1)].kept.all()
    alone = got[got.n_shingles == 3]
    assert len(alone) == 3 and alone.component_id.isna().all() and alone.kept.sum() == 1 and got[got.n_shingles == 0].kept.all()


def test_chat(spark, small):
    bad = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "a\\<|b|>\n"), (1, 2, "assistant", "a\\<|b|>\n"), (2, None, None, bad), (None, 1, "user", "<"), (3, 1, "assistant", ""), (-1, 0, "user", bad), (-1, 1, "assistant", bad)]
    own = pd.read_parquet(f"{small}/conversations.parquet")
    for table in (turns[:-2], list(own.itertuples(index=False, name=None))):
        df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
        got = {r.conv_id: r for r in chat.chat_digest(df).collect()}
        groups = defaultdict(list)
        for c, n, r, t in [*table, *turns[-2:]]:
            groups[c].append((-1 if n is None else n, r or "", t or ""))
        assert set(got) == set(groups)
        for c, own_turns in groups.items():
            own_turns.sort()
            text, loss = "".join(f"{r}\n{t}\n" for _, r, t in own_turns), "".join(t for _, r, t in own_turns if r == "assistant")
            assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own_turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_a_long_conversation(spark):
    """Places of the loss over thousands of turns."""
    n = 3000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<|"), F.col("id").cast("string")).alias("text"))
    got = chat.read_chats(chat.format_chats(turns)).first()
    assert got.loss_text == "".join(f"<|{i}" for i in range(n) if i % 3) and [t.text for t in got.turns] == [f"<|{i}" for i in range(n)]


def test_chat_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    want = con.execute(ORACLE_SQL["op9_chat_formatting"]).fetchdf()
    got = rows(spark, small, "op9_chat_formatting")[list(want.columns)]
    assert len(got) and got.sort_values("conv_id").to_numpy().tolist() == want.sort_values("conv_id").to_numpy().tolist()


def test_fingerprints(spark, small, texts, odd):
    out = rows(spark, small, "op10_document_fingerprints").set_index("doc_id")
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[ids[(k + 1) % len(ids)]][:half]
        assert out.loc[i].n_chars == len(texts[i]) and out.loc[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert out.near_edited.mean() > 0.2 > 0.01 > out.near_next.median()
    got = syncmers.fingerprint_report(odd).toPandas()
    assert len(got) == len(ODD) and got[got.doc_id == 8].fingerprint.nunique() == 1 and (got[got.doc_id.isin([1, 2, 3])].fingerprint == "").all()
    text = " ".join(f"w{i * 7919 % 101}" for i in range(300))
    both = spark.createDataFrame([("a", text), ("b", "some other words first " + text)], "k string, t string").select("k", syncmers.anchors(F.col("t")).alias("a"))
    a, b = ({x["hash"]: x["pos"] for x in r.a} for r in both.orderBy("k").collect())
    assert set(a) <= set(b) and all(b[h] - p == 4 for h, p in a.items() if list(a).count(h) == 1)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values):
    """The engine's 64-bit hash of several numbers: each seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
    return signed(seed)


def test_anchors_equal_loops(spark, texts):
    """Closed syncmers by plain loops over letters, inner substrings and windows."""
    some = {**dict(list(texts.items())[:60]), -1: "short text", -2: "", -3: "a b " * 40, -4: "x" * 400, -5: "y" * 16 + " " + "漢字仮名" * 9 + " ab " + "z" * 17 + " end"}
    got = {r.i: [(x["pos"], x["hash"]) for x in r.a] for r in spark.createDataFrame(list(some.items()), "i long, t string").select("i", syncmers.anchors(F.col("t")).alias("a")).collect()}
    k, s = syncmers.K, syncmers.S
    for i, t in some.items():
        letters = [x for w in re.findall(r"[^\x20\x09-\x0D]+", t) for x in ([w] if len(w) <= 16 else w)]
        h = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in letters]
        want = [(1, chained(h))] if 0 < len(h) < k else []
        for at in range(len(h) - k + 1):
            inner = [chained(h[at + j : at + j + s]) for j in range(k - s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                want.append((at + 1, chained(h[at : at + k])))
        assert got[i] == want, i


def test_anchors_of_text_without_blanks(spark):
    """A letter put in front of text without blanks moves no other anchor."""
    rng = np.random.default_rng(3)
    han = "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 3000, 3000))
    both = spark.createDataFrame([(han, "x" + han)], "a string, b string").select(syncmers.likeness(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).alias("n"))
    assert both.first().n > 0.95


def test_many_cuts_are_planned_at_once(spark):
    began = time.time()
    cuts = list(range(0, 200_000, 2))
    got = spark.range(5).select(F.element_at(F.lit([0, 1, 77_777, 199_998, 300_000]).cast("array<bigint>"), (F.col("id") + 1).cast("int")).alias("at")).select("at", syncmers._below(cuts).alias("n"))
    assert {r["at"]: r.n for r in got.collect()} == {x: min(-(-x // 2), 100_000) for x in (0, 1, 77_777, 199_998, 300_000)} and time.time() - began < 10


def test_neighbours_in_many_buckets(spark):
    docs = spark.createDataFrame([(3 * i, f"text {i}") for i in range(100)], "doc_id long, text string")
    pairs = syncmers.with_next(docs, 60).withColumn("n", F.lead("text").over(syncmers.neighbours())).where("not ghost")
    assert pairs.select("bucket", "part").distinct().count() > 5
    assert {(r.doc_id, r.n) for r in pairs.collect()} == {(3 * i, f"text {(i - 1) % 100}") for i in range(100)}


def test_neighbours_of_crowded_ids(spark):
    """Many rows of one id, of none, and equal rows: the next document is the one of a plain sort, and windows stay small."""
    table = [(7, f"text {i}") for i in range(300)] + [(None, f"none {i % 40}") for i in range(200)] + [(3, "the same text")] * 150 + [(i, f"other {i}") for i in range(20, 60)] + [(-(1 << 62), None), (1 << 62, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    pairs = syncmers.with_next(docs, 400).withColumn("n", F.lead("text").over(syncmers.neighbours()))
    assert pairs.groupBy("bucket", "part").count().agg(F.max("count")).first()[0] < 120
    got = Counter()
    for r in pairs.where("not ghost").collect():
        got[r.doc_id, r.text, r.n] += 1
        got[r.doc_id, r.text, r.text] += r.copies - 1
    by_id = defaultdict(list)
    for i, t in table:
        by_id[i].append(t or "")
    follows = {(i, t, n) for i, t, n in +got}
    assert sum(got.values()) == len(table) and Counter((i, t) for i, t, _ in got.elements()) == Counter((i, t or "") for i, t in table)
    order = sorted(by_id, key=lambda i: -(1 << 63) if i is None else i, reverse=True)
    for i, own in by_id.items():  # one way through all rows of an id, then on to the next id
        after = order[(order.index(i) + 1) % len(order)]
        outside = Counter({k: v for k, v in got.items() if k[0] == i})
        heads, tails = Counter(own), Counter()
        for (_, _, n), v in outside.items():
            tails[n] += v
        new = tails - heads
        assert sum(new.values()) in (0, 1) and set(new) <= set(by_id[after])
    assert follows
    big = spark.range(10_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("word number "), F.col("id").cast("string")).alias("text"))
    assert syncmers.fingerprint_report(big).count() == 10_000


def test_very_long_texts(spark):
    """A text of 300,000 words, and one of a single word of 200,000 letters, whole through every operator."""
    long = " ".join(f"w{i * 7919 % 50_021}" for i in range(300_000))
    table = [(1, long, "en"), (2, long + " end", "en"), (3, "ab" * 100_000, "de"), (4, "a few words of no length", "en")]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    assert [by_id(media.media_digest(docs))[i].n_bytes for i in (1, 3)] == [len(long), 200_000]
    scored = by_id(interpolation.scores(docs))
    assert [scored[i].n_tokens for i in (1, 2, 3, 4)] == [300_001, 300_002, 2, 7] and all(r.score < 0 for r in scored.values())
    tokenizer = Tokenizer.from_file(packing.default_path())
    assert {r.doc_tokens for r in packing.pack(docs, packing.default_path()).where("doc_id = 1").collect()} == {len(tokenizer.encode(long, add_special_tokens=False).ids) + 1}
    assert by_id(language.predict(docs))[1].lang_pred in ("en", "de")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.default_path()), special_tokens={})
    coded = by_id(bpe.digest(docs))
    for i, t, _ in table:
        ids = library.encode_ordinary(t)
        assert (coded[i].n_tokens, coded[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    near = by_id(shingles.near_duplicates(docs))
    assert near[2].component_id == 1 and near[1].n_shingles == 299_996 - (299_996 - len({tuple(w) for w in zip(*[long.split()[k:] for k in range(5)])}))
    cut = by_id(lines.dedup_lines(docs))
    assert cut[1].text == long and cut[2].text == table[1][1]
    prints = by_id(syncmers.fingerprints(docs).select("doc_id", F.size("anchors").alias("n"), "n_chars"))
    assert 300_000 / 10 < prints[1].n < 300_000 and prints[3].n_chars == 200_000


def test_clashing_names(spark):
    """Columns of the names that operators make or use inside stay, or are replaced where the docstring says so."""
    made = media.encode_wav(spark.createDataFrame([(1, "text", 7, 8, 9)], "doc_id long, text string, row int, tail_crc32 int, `a b` int"), media="sound").withColumn("media", F.lit(5))
    got = media.read_wav(made, "sound").first()
    assert (got.row, got.media, got["a b"], got.payload_bytes) == (7, 5, 9, 64) and got.tail_crc32 == zlib.crc32(b"text" + bytes(60))
    back = bpe.round_trip(spark.createDataFrame([(1, "some text", 3, 4)], "x int, text string, n_tokens int, word int"), bpe.default_path()).first()
    assert (back.x, back.word, bytes(back.decoded)) == (1, 4, b"some text") and back.n_tokens == len(back.ids.split(" "))


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    for made in (media.media_digest(none), interpolation.scores(none), packing.pack(none, packing.default_path()), language.predict(none), sharding.shuffle_shards(none), lines.dedup_lines(none), bpe.digest(none), syncmers.fingerprint_report(none)):
        assert made.count() == 0


def test_chats_of_no_rows_and_clashing_names(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho <|x")], "conv_id long, turn int, role string, text string")
    named = turns.withColumns({c: F.lit(9) for c in ("formatted", "loss", "turns", "block", "n", "start", "t")})
    plain, clash = (chat.read_chats(chat.format_chats(df)).first() for df in (turns, named))
    assert plain == clash and plain.loss_text == "ho <|x" and chat.format_chats(turns.limit(0)).count() == 0
    digest = chat.chat_digest(named.limit(0)).collect()
    assert [(r.conv_id, r.n_turns) for r in digest] == [(-1, 2)]


def test_pipeline_of_no_rows_extra_columns_and_a_long_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    long = docs.limit(1).withColumns({"doc_id": F.lit(10**9).cast("long"), "text": F.concat(F.repeat(F.concat("text", F.lit("\n")), 40), F.lit("le la de et un "))})
    wide = docs.unionByName(long).withColumns({c: F.lit(1) for c in ("row_key", "cut", "band", "comp", "kept", "score", "lang_pred", "n_lines")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide.limit(0).select(*docs.columns), small).count() == 0, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        a, b = (stage(spark, df, small) for df in (wide, wide.select(*docs.columns)))
        assert a.columns == b.columns == docs.columns and a.select("doc_id", "text").exceptAll(b.select("doc_id", "text")).count() == 0, name


def test_shuffles_are_uniform(spark):
    """Over many seeds, each row is in each shard and in each slot equally often, and pairs of rows are as often together as
    chance has it."""
    n, shards, seeds = 24, 3, 60
    rows = spark.range(n).select(F.col("id").alias("doc_id")).coalesce(2)
    made = [sharding.shuffle_shards(rows, shards, seed).toPandas().assign(seed=seed) for seed in range(seeds)]
    whole = pd.concat(made)
    chi = lambda table, expected: ((table - expected) ** 2 / expected).to_numpy().sum()
    by_shard = whole.groupby(["doc_id", "shard"]).size().unstack(fill_value=0)
    by_slot = whole.groupby(["doc_id", "slot"]).size().unstack(fill_value=0)
    assert chi(by_shard, seeds / shards) < 110 and chi(by_slot, seeds * shards / n) < 260  # 46 and 161 degrees of freedom, one in 10^5
    together = sum(m.shard[m.doc_id == 0].iloc[0] == m.shard[m.doc_id == 1].iloc[0] for m in made)
    assert abs(together - seeds * 7 / 23) < 17


def test_pipeline_stages(spark, small, odd):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns and 0.5 * docs.count() < after.count() <= docs.count(), name
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).select("doc_id").distinct().count() == docs.count()
    table = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.near_stage(spark, table, small).where("doc_id is null").count() == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, small).count() >= 0


def test_pipeline_run(spark, small, texts):
    """The whole run: languages by the plain classifier, groups by brute force, ids by the tokenizer, on what stages before kept."""
    docs = pd.read_parquet(f"{small}/documents.parquet")
    train = docs[[zlib.crc32(str(i).encode()) % 3 != 1 for i in docs.doc_id]].dropna(subset=["lang", "text"])
    classify = plain_language(list(train[["text", "lang"]].itertuples(index=False)))
    table = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id: r for r in corpus_pipeline.language_stage(spark, table, small).collect()}
    for r in docs[docs.text.str.len() < 1500].itertuples():
        lang, score = classify(r.text)
        assert (r.doc_id in kept) == (lang != "und" and score >= corpus_pipeline.LEAST_SCORE) and (r.doc_id not in kept or (kept[r.doc_id].text, kept[r.doc_id].lang) == (r.text, lang))
    left = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, table.where(F.col("doc_id").isin(list(kept))), small).collect()}
    groups = brute(left, corpus_pipeline.SIMILAR)
    want = {i: t for i, t in left.items() if groups[i][1] == i}
    tokenizer = Tokenizer.from_file(packing.default_path())
    tokenizer.encode_special_tokens = True
    got = corpus_pipeline.run(spark, small).toPandas()
    assert set(got.doc_id) == set(want)
    for i, own in got.sort_values("start").groupby("doc_id"):
        assert np.frombuffer(b"".join(own["ids"]), "<u4").tolist() == tokenizer.encode(want[i], add_special_tokens=False).ids + [1]
        assert all(zlib.crc32(x) == c for x, c in zip(own["ids"], own.ids_crc32, strict=True))


def linked(rows, threshold):
    """The least id that each text reaches, by all pairs of shingle sets."""
    found = [frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if (w := words(t)) else None for _, t in rows]
    least = list(range(len(rows)))

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = top(i), top(j)
                least[max(x, y)] = min(x, y)
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


def pooled(n, seed=0):
    """Texts of shared words and some passages of a small pool; a few are near copies."""
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"p{k}w{i}" for i in range(50)) for k in range(30)]
    shared = " ".join(f"s{i}" for i in range(150))
    rows = [(i, shared + " " + " ".join(passages[k] for k in rng.choice(30, 6, replace=False)) + f" u{i}") for i in range(n)]
    return rows + [(n + i, t.replace("s77 ", f"x{i} ") if i % 2 else t + " more words at the end") for i, t in rows[: n // 10]]


@pytest.mark.parametrize("threshold", [60, 80, 85])
def test_near_duplicates_of_pooled_passages(spark, monkeypatch, threshold):
    """Texts of a common pool meet in nearly all buckets: links are those of all pairs, and few pairs are verified."""
    checked = []
    confirm = shingles._confirm
    monkeypatch.setattr(shingles, "_confirm", lambda pairs, sets, t: confirm(checked.append(pairs.count()) or pairs, sets, t))
    monkeypatch.setattr(shingles, "CROWD", 50)
    rows = pooled(220)
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold).collect()}
    assert got == linked(rows, threshold)
    assert threshold == 60 or sum(checked) < 2 * len(rows)


def test_bitmaps_bound_differences():
    rng = np.random.default_rng(1)
    one, two = (np.unique(rng.integers(0, 5000, 400)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
    a, b = (shingles.bitmaps(np.sort(x), np.array([0, len(x)]))[0] for x in (one, two))
    bits = sum(int(x).bit_count() for x in a ^ b)
    assert 0 < bits <= len(np.setxor1d(one, two)) and (shingles.bitmaps(one, np.array([0, len(one)]))[0] == a).all()
