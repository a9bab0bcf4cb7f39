"""Every registered query against its SQL, ordered recurrences against plain loops, edge rows, and invariances."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from duelkit.functions import names, values
from duelkit.operators import backtest, bets, clean, dataset, fatigue, form, graph, h2h, history, odds, ordering, profile, ratings, scan
from duelkit.plans import queries
from duelkit.plans.fixture import ORDER, matches, player_matches
from duelkit.plans.queries import ORACLE_SQL, QUERIES
from duelkit.sources import tables
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'").fetchall()
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NaT or v != v:
            return "-"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) else str(v)[:19].replace(" 00:00:00", "")

    df = df[sorted(df.columns)].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, duck, name):
    got, want = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)


def test_queries_without_sql():
    """Each of these has a test of its own below."""
    assert set(QUERIES) - set(ORACLE_SQL) == {"walk_forward_models", "feature_importance", "bootstrap_gains", "select_strategy", "frozen_strategy", "best_percentage", "ab_holdout", "elo_by_level", "sliding_votes"}


def test_elo_equals_loop(spark, small):
    m = matches(spark, small)
    rows = m.toPandas().sort_values(ORDER, kind="stable")
    played, ladders, want = {}, {}, {}
    for r in rows.itertuples():
        w, l = r.winner_id, r.loser_id
        n_w, n_l = played.get(w, 0), played.get(l, 0)
        k_w, k_l = (max(16, min(50, 250 / (n + 5) ** 0.4)) for n in (n_w, n_l))
        venue = {"I": "Indoor", "O": "Outdoor"}.get(r.indoor)
        sets = {0: 2, 1: 3, 2: 2, 3: 0, 4: 3}[r.match_num % 5]
        got = {}
        for name, ladder, moves in (("elo", "o", True), ("surface_elo", r.surface_norm, True), ("surface_env_elo", venue and (r.surface_norm, venue), True), ("clutch_elo", "c", sets == 3)):
            if not ladder:
                continue
            t = ladders.setdefault((name, ladder), {})
            a, b = t.get(w, 1500.0), t.get(l, 1500.0)
            got[name] = (a, b)
            if moves:
                p = 1 / (1 + 10 ** ((b - a) / 400))
                t[w], t[l] = a + k_w * (1 - p), b - k_l * (1 - p)
        want[r.match_num] = got
        played[w], played[l] = n_w + 1, n_l + 1
    for r in ratings.elo(m, ORDER).toPandas().itertuples():
        for name, pair in want[r.match_num].items():
            assert getattr(r, f"winner_{name}_pre") == pytest.approx(pair[0], abs=0.006)
            assert getattr(r, f"loser_{name}_pre") == pytest.approx(pair[1], abs=0.006)
        if "surface_env_elo" not in want[r.match_num]:
            assert math.isnan(r.winner_surface_env_elo_pre)
    final = ratings.final_ratings(m, ORDER).toPandas().set_index("player_id")
    for p, rating in ladders["elo", "o"].items():
        assert final.loc[p, "elo"] == pytest.approx(rating, abs=0.06) and final.loc[p, "played"] == played[p]


def test_scan_of_long_careers(spark, monkeypatch):
    """Sixty years, many contests of one day, several blocks a player, and a state carried on: as a plain loop has it."""
    monkeypatch.setattr(scan, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for player in range(3):
        day, last, sets, minutes = 0, None, 0.0, 0.0
        for i in range(900 if player else 10):
            day += int(rng.choice([0, 0, 1, 30, 120])) if i % 300 else 8000
            n, m = int(rng.integers(0, 5)), float(rng.integers(0, 200))
            fade = 1 if last is None else 0.5 ** ((day - last) / 14)
            want[player, i] = (round(sets * fade, 3), round(minutes * fade, 2))
            sets, minutes, last = sets * fade + n, minutes * fade + m, day
            rows.append((player, i, day, n, m))
    df = spark.createDataFrame(rows, "player_id long, i int, day int, sets int, minutes double")
    close = lambda got, low=0: all((r.fatigue_ema_sets, r.fatigue_ema_minutes) == pytest.approx(want[r.player_id, r.i], abs=2e-2) for r in got) and {(r.player_id, r.i) for r in got} == {k for k in want if k[1] >= low}
    assert close(fatigue.fatigue_ema(df, ["i"]).collect())
    state = fatigue.fatigue_from(df.where("i < 400"), ["i"])[1]
    assert close(fatigue.fatigue_ema(df.where("i >= 400"), ["i"], start=state).collect(), 400)
    d, c, first = rng.random((40, 2)) * 3, rng.standard_normal((40, 2)), np.repeat([0, 1, 18], [1, 17, 22])
    m, a = scan.composed(d, c, first)
    for i in range(40):
        s = np.array([5.0, -2.0])
        for k in range(first[i], i):
            s = s * 2 ** -d[k] + c[k]
        assert s == pytest.approx(m[i] * [5.0, -2.0] + a[i])


def test_exponential_equals_loop(spark, small):
    pm = form.serve_return_metrics(player_matches(spark, small))
    got = form.exponential(pm, ORDER, own="elo", other="o_elo").toPandas().sort_values(["player_id", *ORDER])
    for _, rows in got.groupby("player_id"):
        state, n, served, last = None, 0, 0, None
        for r in rows.itertuples():
            assert r.ema_n == served
            if n >= 3:
                assert r.ema_hold_pct == pytest.approx(state, abs=2e-4)
            elif n == 0:
                assert math.isnan(r.ema_hold_pct)
            if r.valid:
                gap = 0 if last is None else r.day - last
                weight = 0.5 if gap <= 0 else 1 - 0.5 ** (gap / 45)
                if not math.isnan(r.hold_pct):
                    state, n = (r.hold_pct if n == 0 else state + weight * (r.hold_pct - state)), n + 1
                served += not math.isnan(r.srv_1st_pct)
                last = r.day


def test_later_rows_change_nothing(spark, small):
    pm = form.serve_return_metrics(player_matches(spark, small))
    cut = dt.date(1995, 1, 1)
    some = lambda df: {(r.match_num, r.side): r.r10_hold_pct for r in form.rolling(df, ORDER).where(F.col("tourney_date") < F.lit(cut)).collect()}
    assert some(pm) == some(pm.where(F.col("tourney_date") < F.lit(cut)))


def one(spark, **columns):
    return spark.sql("SELECT " + ", ".join(f"CAST({'NULL' if v is None else repr(v)} AS STRING) AS {k}" for k, v in columns.items()))


@pytest.mark.parametrize(("text", "want"), [(" hard ", "Hard"), ("", "Unknown"), (None, "Unknown"), ("Greenset", "Greenset"), ("CLAY", "Clay")])
def test_surface(spark, text, want):
    assert one(spark, c=text).select(values.normalize_surface("c")).first()[0] == want


@pytest.mark.parametrize(("text", "want", "bad"), [("20230105", dt.date(2023, 1, 5), False), ("20230230", None, True), ("2023-01-05", dt.date(2023, 1, 5), True), ("", None, True), ("abc", None, True), (None, None, True)])
def test_dates(spark, text, want, bad):
    assert tuple(one(spark, c=text).select(values.parse_date("c"), values.is_bad_date("c")).first()) == (want, bad)


@pytest.mark.parametrize(("text", "want"), [("104925.0", "104925"), ("D643", "D643"), ("1E5", "100000"), ("", ""), (None, None)])
def test_ids(spark, text, want):
    assert one(spark, c=text).select(values.safe_int_text("c")).first()[0] == want


@pytest.mark.parametrize(("text", "best", "sets", "decisive"), [("6-4 7-6(5) 3-6", "3", 3, True), ("W/O", "3", None, False), ("6-1 2-1 RET", "3", 2, False), ("6-4 [10-7]", "3", 1, False), ("", None, None, False), (None, "3", None, False)])
def test_scores(spark, text, best, sets, decisive):
    assert tuple(one(spark, c=text, b=best).select(values.count_sets("c"), values.is_decisive("c", "b")).first()) == (sets, decisive)


@pytest.mark.parametrize(("text", "want"), [("I", "Indoor"), ("Outdoor", "Outdoor"), ("1.0", "Unknown"), ("", "Unknown"), (None, "Unknown"), ("True", "Indoor")])
def test_indoor(spark, text, want):
    assert one(spark, c=text).select(values.normalize_indoor("c")).first()[0] == want


@pytest.mark.parametrize(("first", "last", "key"), [("Félix Auger-Aliassime", "Auger-Aliassime F.", "f auger aliassime"), ("Juan Martin Del Potro", "Del Potro J.", None), ("Stan Wawrinka", "Wawrinka S.", "s wawrinka")])
def test_names_meet(spark, first, last, key):
    a, b = one(spark, a=first, b=last).select(names.player_key_first_last("a"), names.player_key_last_initial("b")).first()
    assert (a == b == key) if key else (a, b) == ("j martin del potro", "j del potro")


@pytest.mark.parametrize(("text", "want"), [(None, ("", "", "")), ("Łukasz Kubot", ("ukasz kubot", "u kubot", "u kubot")), ("Pelé", ("pele", "pele", "p ")), ("J.W. Smith", ("jw smith", "j smith", "j smith"))])
def test_name_edges(spark, text, want):
    assert tuple(one(spark, c=text).select(names.clean_name("c"), names.player_key_first_last("c"), names.player_key_last_initial("c")).first()) == want


@pytest.mark.parametrize(("text", "want"), [("2021-05-03", 2021), ("03/05/21", 2021), ("03/05/1999", 1999), ("03.05.2021", 2021), ("03-05-21", 2021), ("on 3/5/70 ", None), ("Mon 3/5/98", 1998), ("1.1.221", None), ("44319", 2021), ("20210503", 2021), ("1889-01-01", 2001), ("1889 01 01", None), (None, None), ("", None)])
def test_years(spark, text, want):
    assert one(spark, c=text).select(names.extract_year("c")).first()[0] == want


@pytest.mark.parametrize(("level", "draw", "want"), [("G", "128", "Grand Slam"), ("A", "48", "ATP 500"), ("A", None, "ATP 250"), ("A", "x", "ATP 250"), ("250", "1", "ATP 250"), ("g", "128", "Grand Slam"), (" a ", "64", "ATP 500"), ("Z", "1", "Other"), (None, None, "Other")])
def test_tiers(spark, level, draw, want):
    assert one(spark, a=level, b=draw).select(values.classify_tier("a", "b")).first()[0] == want


def test_seed_with_nulls(spark):
    import hashlib

    bit = one(spark, a=None, b=None, c="1", d="2").select(values.deterministic_bit("a", "b", "c", "d")).first()[0]
    assert bit == int(hashlib.md5(b"__1_2").hexdigest()[0], 16) % 2


def test_dedup_and_orientation(spark):
    o = spark.createDataFrame([("2021-05-03", "Smith A.", "Jones B.", 1.5, 2.5, 1), ("2021-06-03", "Jones B.", "Smith A.", 1.1, 9.0, 2)], "Date string, Winner string, Loser string, PSW double, PSL double, row_no long")
    m = spark.createDataFrame([("2021-07-01", "Bo Jones", "Al Smith"), ("2020-07-01", "Bo Jones", "Al Smith"), (None, "Bo Jones", None)], "tourney_date string, winner_name string, loser_name string")
    got = lambda orient: {r.tourney_date: (r.PSW, r.PSL) for r in odds.merge_odds(odds.match_keys(m), odds.odds_keys(o), ["row_no"], orient).collect()}
    assert got(False) == {"2021-07-01": (1.5, 2.5), "2020-07-01": (None, None), None: (None, None)}
    assert got(True)["2021-07-01"] == (2.5, 1.5)


def test_symmetry(spark, small):
    m = dataset.filter_modelable(matches(spark, small))
    seed = ["tourney_id", "match_num", "winner_id", "loser_id"]
    rows = dataset.symmetrize(m, seed).select("match_num", "player1_id", "player2_id", "target_player1_won").toPandas()
    back = m.select("match_num", "winner_id", "loser_id").toPandas().merge(rows, on="match_num")
    first = back["target_player1_won"] == 1
    assert (np.where(first, back.player1_id, back.player2_id) == back.winner_id).all() and 0.4 < first.mean() < 0.6


def test_certain_forecasts_have_the_sqls_loss(spark, small, tmp_path):
    """Ranks so far apart that probabilities are 0 and 1 (as at sf 0.1): the loss is infinite where one is wrong. Clipped, it isn't."""
    con = duckdb.connect()
    for name, key in (("lineitem", "l_suppkey"), ("supplier", "s_suppkey"), ("orders", None)):
        con.execute(f"CREATE VIEW {name} AS SELECT * {f'REPLACE ({key} * 500 AS {key})' if key else ''} FROM '{small}/{name}.parquet'")
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got, want = QUERIES["classification_metrics"](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL["classification_metrics"]).fetchdf()
    assert np.isinf(want.log_loss).any()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)
    rows = spark.createDataFrame([("a", 0.0, 1), ("a", 1.0, 1), ("b", 0.0, 0), ("b", 1.0, None)], "g string, prob double, target_player1_won int")
    assert {r.g: r.log_loss for r in backtest.classification_metrics(rows, ["g"]).collect()} == {"a": pytest.approx(-math.log(1e-15) / 2, abs=1e-6), "b": 0.0}


def test_walk_forward_of_every_origin(spark):
    """Rows, metrics and gains of every accepted origin (few rounds here); one with too few rows has none."""
    df = tables.kept(queries._model(spark, "/root/testdata/sf0.01", queries._rated(spark, "/root/testdata/sf0.01")), "model")
    few = [*queries.FEATURES, "player1_elo_pre", "player2_elo_pre"]
    got = {r.origin: r.asDict() for r in backtest.walk_forward(df, ["1993-01-01", "1997-01-01", "1998-01-01", "2015-01-01"], few, queries.DATA_START, rounds=2).collect()}
    gains = backtest.latest_importance(df, ["1993-01-01", "1997-01-01", "2015-01-01"], few, rounds=3).toPandas()
    assert set(gains.feature) == set(few) and gains.gain.sum() == pytest.approx(1, abs=1e-6) and (gains.never_used == (gains.gain == 0)).all()
    votes = queries._votes(df, few, "1998-01-01", rounds=4).toPandas()
    assert len(votes) >= 90 and votes.match_idx.is_unique and votes.win_majority.isin([0, 1]).all() and votes.PSW.notna().all() and votes.confidence.nunique() > 10
    m = queries._model(spark, "/root/testdata/sf0.01").select("tourney_date").toPandas().tourney_date
    assert set(got) == {"1993-01-01", "1997-01-01", "1998-01-01"} - ({"1993-01-01"} if (m < dt.date(1993, 1, 1)).sum() < 500 else set())
    for origin, r in got.items():
        cut = dt.date.fromisoformat(origin)
        assert (r["n_train"], r["n_test"]) == ((m < cut).sum(), (m >= cut).sum())
        assert r["accuracy_gain_full_elo"] == pytest.approx(r["accuracy_full"] - r["accuracy_elo"], abs=1e-6) and r["log_loss_gain_elo_rank"] == pytest.approx(r["log_loss_rank"] - r["log_loss_elo"], abs=1e-6)
        assert 0.4 < r["accuracy_elo"] < 0.8 and 0.5 < r["log_loss_full"] < 0.8
    summary = spark.createDataFrame(list(got.values()))
    assert backtest.mean_gains(summary).first()["accuracy_gain_full_rank"] == pytest.approx(np.mean([r["accuracy_gain_full_rank"] for r in got.values()]), abs=1e-6)


def test_loads_at_decimal_ties(spark, monkeypatch):
    """Gaps of whole half-lives make loads exact ties; the last digit is that of the SQL's closed form, in any block."""
    rows = [(p, p % 2 * 16 + i, d, n, 10.0 * n) for p, (a, b) in enumerate([(1, 1), (3, 2), (5, 2), (2, 4)]) for i, (d, n) in enumerate([(0, a), (42, b), (56, 0)])]
    df = spark.createDataFrame(rows, "player_id long, i int, day int, sets int, minutes double")
    sums = ", ".join(f"round(coalesce(sum({c} * exp(ln(2) / 14 * day)) OVER w * exp(-ln(2) / 14 * day), 0), {n}) AS {c}" for c, n in (("sets", 3), ("minutes", 2)))
    con = duckdb.connect()
    con.execute("CREATE TABLE t (player_id BIGINT, i INT, day INT, sets INT, minutes DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
    want = sorted(con.execute(f"SELECT player_id, i, {sums} FROM t WINDOW w AS (PARTITION BY player_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").fetchall())
    assert want[2][2] == 0.562  # 9 / 16 is half a digit more than it
    monkeypatch.setattr(scan, "BLOCK_ROWS", 1000)
    got = fatigue.fatigue_ema(df, ["i"]).select("player_id", "i", "fatigue_ema_sets", "fatigue_ema_minutes").collect()
    assert sorted(map(tuple, got)) == want
    # contests beyond the first ones, and long after the first, are those of the scan
    monkeypatch.setattr(fatigue, "EARLY", 2)
    late = fatigue.fatigue_ema(df, ["i"]).select("player_id", "i", "fatigue_ema_sets").collect()
    assert sorted(map(tuple, late)) == [(p, i, pytest.approx(x, abs=1.1e-3)) for p, i, x, _ in want]


def test_loads_at_decimal_ties_among_undated_contests(spark):
    """Contests without a day, even the first, change nothing of it."""
    rows = [(1, 0, None, 9, 9.0), (1, 1, 100, 1, 10.0), (1, 2, None, 7, 70.0), (1, 3, 142, 1, 10.0), (1, 4, 156, 0, 0.0)]
    df = spark.createDataFrame(rows, "player_id long, i int, day int, sets int, minutes double")
    got = {r.i: r.fatigue_ema_sets for r in fatigue.fatigue_ema(df, ["i"]).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.125, 4: 0.562}


def test_loads_at_decimal_ties_after_other_features(spark):
    """As the feature table makes them: after rest and load of 30 days, in an order of several columns, whatever the rows' partitions."""
    rows = [(p, "w", d, d, n, 10.0 * n) for p in range(5) for d, n in ((0, 1), (42, 1), (56, 0))]
    df = spark.createDataFrame(rows, "player_id long, side string, day int, match_num int, sets int, minutes double").repartition(7, "day")
    order = ["day", "match_num"]
    got = fatigue.fatigue_ema(fatigue.load_30_days(fatigue.rest_days(df, order), order), order)
    assert {(r.day, r.fatigue_ema_sets) for r in got.collect()} == {(0, 0.0), (42, 0.125), (56, 0.562)}
    assert not [c for c in got.columns if c.startswith("_")]


def test_loads_at_decimal_ties_late_in_careers(spark, monkeypatch):
    """Ties after a hundred contests and after twenty years, as long gaps leave few contests that count; groups of any size carry on."""
    rng = np.random.default_rng(5)
    rows = pd.concat([pd.DataFrame({"player_id": p, "day": 8000 + np.cumsum(rng.choice(gaps, n)), "sets": rng.integers(0, 6, n)}) for gaps, n, first in
        (([0] * 20 + [7] * 20 + [14] * 20 + [28] * 8 + [700] * 2, 100, 0), ([14, 28, 56, 84, 500], 50, 1000)) for p in range(first, first + 100)], ignore_index=True)
    rows = rows.assign(i=np.arange(len(rows)), minutes=10.0 * rows.sets)
    con = duckdb.connect()
    want = con.execute("SELECT player_id, i, round(coalesce(sum(sets * exp(ln(2) / 14 * s)) OVER w * exp(-ln(2) / 14 * s), 0), 3) AS sets, s FROM (SELECT *, day - min(day) OVER (PARTITION BY player_id) AS s FROM rows)"
        " WINDOW w AS (PARTITION BY player_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ORDER BY i").fetchdf()  # fmt: skip
    assert 7000 < want.s.max() < fatigue.EARLY_DAYS
    df = spark.createDataFrame(rows)
    got = fatigue.fatigue_ema(df, ["i"]).select("i", "fatigue_ema_sets").toPandas().sort_values("i")
    assert list(got.fatigue_ema_sets) == list(want.sets)
    monkeypatch.setattr(fatigue, "EARLY", 7)
    got = fatigue.fatigue_ema(df, ["i"]).select("i", "fatigue_ema_sets").toPandas().sort_values("i")
    assert list(got.fatigue_ema_sets) == pytest.approx(list(want.sets), abs=1.1e-3)


def test_loads_when_days_do_not_rise(spark):
    """Days far before the first one in the order overflow no weights."""
    df = spark.createDataFrame([(1, 0, 40_000, 2, 9.0), (1, 1, 100, 1, 10.0), (1, 2, 40_014, 0, 0.0)], "player_id long, i int, day int, sets int, minutes double")
    got = {r.i: r.fatigue_ema_sets for r in fatigue.fatigue_ema(df, ["i"]).collect()}
    assert got[0] == 0.0 and got[2] == 1.0


def test_only_what_is_asked_for(spark, small, monkeypatch):
    """Features of some metrics are those of all; both scans of stored state share one numbering, and nothing else is written."""
    pm = form.serve_return_metrics(queries._loaded(spark, small))
    named = lambda df, columns: sorted(map(str, df.select("match_num", "side", *columns).collect()))
    shown = ["ema_n", "ema_hold_pct", "ema_long_hold_pct", "delta_form_hold_pct", "quality_ema", "quality_ema_n"]
    rated = {"own": "elo", "other": "o_elo"}
    whole = form.exponential(pm, ORDER, **rated)
    assert named(form.exponential(pm, ORDER, metrics=["hold_pct"], **rated), shown) == named(whole, shown)
    assert named(form.exponential(pm, ORDER, metrics=[], **rated), shown[-2:]) == named(whole, shown[-2:])
    written = []
    keep = lambda df, name, *a: written.append((name, df.columns)) or tables.kept(df, name, *a)
    for module in (ordering, scan, history):
        monkeypatch.setattr(module, "kept", keep)
    got, store = history.player_features(pm, ORDER, keep=["rest_days", "ema_hold_pct"], after=False, metrics=["hold_pct"])
    assert store is None and [name for name, _ in written] == ["ordered", "scanned", "scanned"]
    assert not any(c.startswith(("r10_", "hard_12mo_", "_ema_ret")) for _, columns in written for c in columns)
    assert named(got, ["ema_hold_pct"]) == named(whole, ["ema_hold_pct"]) and not {"_row", "_block", "streak"} & set(got.columns)


def test_block_windows_are_counted_rows(spark):
    """Arithmetic of blocks gives what counting the rows of all blocks gives, also where the table begins and ends; it takes a row a part."""
    for n, first, offset in ((3000, 100, 0), (3000, 2999, 20), (900, 0, -90), (40, 40, 0)):
        sizes = {"test_rows": 90, "step": 300, "train_rows": 1000, "offset": offset}
        rows = backtest.block_rows(spark.range(n).withColumnRenamed("id", "seq"), n, first, **sizes).groupBy("block", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
        assert sorted(map(tuple, backtest.block_windows(spark, n, first, **sizes).collect())) == sorted(map(tuple, rows.collect()))
    many = backtest.block_windows(spark, 50_000_000, 1_000_000)  # blocks hold 1.6e11 rows together
    assert many.agg(F.sum("n")).first()[0] > 1.5e11 and 90_000 < many.count() <= 3 * 32_667


def test_models_without_enough_rows(spark, small):
    """At sf 0.001 no origin has enough rows: no rows come out; the feature table is a stage that the queries share."""
    assert QUERIES["feature_importance"](spark, small).count() == 0 and QUERIES["walk_forward_models"](spark, small).count() == 0
    stages = dict(queries._STAGES)
    df, features = queries._for_models(spark, small)
    assert stages == queries._STAGES and len(features) > 120 and not set(features) & {*queries.LEAKS, "player1_ps", "target_player1_won", "minutes"}


def test_many_files_of_few_headers(spark, tmp_path):
    """Jobs grow with headers, not with files; a header without rows and an empty file are listed."""
    names = [["match_num", "winner_id"], ["winner_id", "match_num", "minutes"], ["match_num", "loser, id"]]
    for i in range(60):
        columns = names[i % 3]
        (tmp_path / f"{1960 + i}.csv").write_text(",".join(f'"{c}"' if "," in c else c for c in columns) + "\n" + "".join(",".join(f"{c[0]}{i}{k}" for c in columns) + "\n" for k in range(i % 4)))
    (tmp_path / "2030.csv").write_text("")
    paths = sorted(map(str, tmp_path.glob("*.csv")))
    tracker, group = spark.sparkContext.statusTracker(), "headers"
    spark.sparkContext.setJobGroup(group, "headers")
    got = tables.read_matches(spark, paths).toPandas()
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 12 and len(got) == sum(i % 4 for i in range(60))
    own = got[got.source_file == "1962.csv"].iloc[0]
    assert own["loser, id"] == "l20" and own.match_num == "m20" and own.winner_id is None and list(own.source_columns) == names[2]
    files = tables.list_files(spark, [str(tmp_path)]).select(F.element_at(F.split("path", "/"), -1).alias("source_file"))
    report = {r.source_file: r for r in profile.check_files(tables.read_matches(spark, paths), ["match_num", "winner_id"], files=files).collect()}
    assert len(report) == 61 and [report[f"{1960 + i}.csv"].ok for i in range(4)] == [False, True, False, True] and not report["2030.csv"].ok and report["2030.csv"].n_rows == 0
    assert report["1962.csv"].missing == "winner_id"


def test_few_bets_are_told(spark):
    parts = spark.createDataFrame([("selection",)] * 200 + [("holdout",)] * 99, "part string")
    assert {(r.part, r.n_bets, r.few) for r in bets.part_counts(parts).collect()} == {("selection", 200, False), ("holdout", 99, True)}
    assert {(r.n_bets, r.few) for r in bets.part_counts(parts.limit(0)).collect()} == {(0, True)}


def test_stopping():
    assert backtest.stop_after([3, 2, 1, 2, 2, 2, 0], 3) == 6 and backtest.stop_after([3, 2, 1, 2, 2, 0.5, 2], 4) == 7 and backtest.stop_after([1], 10) == 1


def test_fits_run_side_by_side(spark):
    seen = []
    assert backtest.concurrently(spark, [lambda i=i: seen.append(i) or spark.range(i).count() for i in range(9)], 3) == list(range(9)) and sorted(seen) == list(range(9))


def test_bootstrap_gains(spark, small, monkeypatch):
    """The interval of a mean over three origins is that of all their resamples."""
    table = spark.createDataFrame([("a", 0.01, -0.5), ("b", 0.02, 0.5), ("c", 0.06, 0.3)], "origin string, accuracy_gain_full_elo double, log_loss_gain_full_elo double")
    monkeypatch.setattr(queries, "_summary", lambda *_: table)
    got = {r.gain: r for r in queries.bootstrap_gains(spark, small).collect()}
    assert got["accuracy_gain_full_elo"].mean_gain == pytest.approx(0.03, abs=0.002) and 0.01 <= got["accuracy_gain_full_elo"].low <= 0.012 and 0.055 < got["accuracy_gain_full_elo"].high <= 0.06
    assert got["log_loss_gain_full_elo"].low == pytest.approx(-0.5, abs=0.01)


def test_strategies(spark, small):
    """The chosen strategy is the one of the best lower bound over all cells, and its holdout that of a plain selection."""
    rows = bets.selection_holdout(queries._bets(spark, small), "1990-01-01", "1996-01-01")
    part = rows.where("part = 'selection'").drop("part")
    best = bets.select_strategy(part, 60, 400).first()
    plain_bets = part.toPandas()
    bounds = {}
    for s in ("edge_abs", "confidence"):
        for percent in bets.TOP_PERCENT:
            for cap in bets.CAPS:
                pool = plain_bets[(plain_bets.PSW > 0) & (plain_bets.PSW <= cap)].sort_values([s, "match_idx"], ascending=[False, True])
                top = pool.head(int(len(pool) * percent / 100))
                if len(top) >= 60:
                    assert bets.apply_strategy(part, s, cap, percent).count() == len(top)
                    bounds[s, cap, percent] = bets.bootstrap_roi(spark.createDataFrame(top[list(plain_bets.columns)]).selectExpr("match_idx", "tourney_date", "confidence", "edge_abs", "stake", "PSW", "bet_won"), 400).first().roi_low
        if s == "edge_abs":
            break  # one column shows it; the other is ranked in the same way
    own = bets.select_strategy(part, 60, 400, sort_columns=("edge_abs",)).first()
    assert bounds[own.sort_column, own.cap, own.percent] == pytest.approx(max(bounds.values()), abs=2.5) and own.n_bets >= 60 and best.roi_low >= own.roi_low - 2.5
    chosen = bets.apply_strategy(rows.where("part = 'holdout'").drop("part"), best.sort_column, best.cap, best.percent)
    told = bets.evaluate(chosen, 300, 300).first()
    assert told.roi_low <= told.roi_mean <= told.roi_high and 0 <= told.p_value <= 1 and told.verdict in ("edge", "no edge")
    assert told.roi == pytest.approx(chosen.agg(bets.roi_staked()).first()[0], abs=1e-4)
    for name, columns in (("select_strategy", {"roi_low", "n_bets"}), ("frozen_strategy", {"roi", "p_value", "verdict"})):
        assert columns <= set(QUERIES[name](spark, small).columns)


def test_holdout_of_halves(spark, small):
    """The share is chosen by the flat return of half A and applied once to half B."""
    df = bets.valid_bets(queries._bets(spark, small))
    got = bets.ab_holdout(df, 300, 300).first()
    half = df.toPandas().sort_values(["tourney_date", "match_idx"], ignore_index=True)
    b = half[len(half) // 2 :].sort_values(["confidence", "match_idx"], ascending=[False, True])
    top = b.head(int(len(b) * got.percent / 100))
    assert got.n_bets == len(top) and got.roi == pytest.approx(100 * ((top.PSW * top.bet_won).sum() - len(top)) / len(top), abs=1e-4)
    assert got.percent in bets.AB_PERCENT and bets.ab_holdout(df.limit(50), 10, 10).count() == 0
    best = QUERIES["best_percentage"](spark, small).first()
    assert best.percent in bets.AB_PERCENT and best.n_bets == int(len(half) // 2 * best.percent / 100)


def test_draws_do_not_depend_on_partitions(spark, small):
    df = queries._bets(spark, small)
    one, many = (bets.bootstrap_roi(df.repartition(n, "match_idx"), 300).first() for n in (1, 7))
    assert one == many


@pytest.mark.parametrize(("n", "block_values"), [(1, 20_000), (4, 2), (1000, 7), (1000, 20_000)])
def test_resamples_are_those_of_a_plain_loop(spark, n, block_values):
    """Exact n-of-n draws, for any number of blocks: all outcomes of few bets at their rates, quantiles of many."""
    rng = np.random.default_rng(n)
    odds_ = np.round(1.2 + rng.random(n) * 3, 3)
    rows = pd.DataFrame({"match_idx": range(n), "stake": rng.choice([1.0, 2.0], n), "PSW": odds_, "bet_won": (rng.random(n) < 0.6).astype(int)})
    got = np.sort(bets.resample(spark.createDataFrame(rows), [], F.lit(0), 4000, 7, block_values=block_values).toPandas().roi.to_numpy())
    assert len(got) == 4000
    pick = rng.integers(0, n, (20_000, n))
    won, put = (rows.stake * rows.PSW * rows.bet_won).to_numpy()[pick].sum(1), rows.stake.to_numpy()[pick].sum(1)
    want = np.sort(100 * (won - put) / put)
    at = np.concatenate([got, want])
    gap = np.abs(np.searchsorted(got, at + 1e-9) / len(got) - np.searchsorted(want, at + 1e-9) / len(want)).max()
    assert gap < 0.035  # Kolmogorov-Smirnov: one in 10^3


def test_prefixes_share_draws(spark):
    """Cells that are prefixes of an order are each resampled as if alone, from one pass over its segments."""
    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"by": ["x"] * 500 + ["y"] * 40, "seg": np.concatenate([np.repeat([0, 1, 3], [50, 150, 300]), np.zeros(40, int)]), "stake": 1.0, "PSW": np.round(1.2 + rng.random(540) * 3, 2), "bet_won": (rng.random(540) < 0.5).astype(int)})
    df = spark.createDataFrame(rows)
    cells = spark.createDataFrame([("x", 1), ("x", 2), ("x", 5), ("y", 1)], "by string, cell int")
    got = bets.resample(df, ["by"], F.col("seg"), 3000, 7, cells, block_values=100).toPandas()
    assert got.groupby(["by", "cell"]).size().to_dict() == {("x", 1): 3000, ("x", 2): 3000, ("x", 5): 3000, ("y", 1): 3000}
    for (by, cell), own in got.groupby(["by", "cell"]):
        pool = rows[(rows.by == by) & (rows.seg < cell)]
        pay = (pool.PSW * pool.bet_won).to_numpy()
        want = 100 * (pay[rng.integers(0, len(pay), (4000, len(pay)))].mean(1) - 1)
        assert own.roi.mean() == pytest.approx(want.mean(), abs=5 * want.std() / 50) and own.roi.std() == pytest.approx(want.std(), rel=0.08)
        assert np.percentile(own.roi, [2.5, 97.5]) == pytest.approx(np.percentile(want, [2.5, 97.5]), abs=0.3 * want.std())


def messy(spark, small):
    return clean.with_seq(clean.clean_matches(queries.raw_matches(spark, small)))


def test_ratings_in_the_total_order(spark, small):
    """Repeated dates and numbers, undated rows and missing ids: ratings, counts and averages follow ``seq``."""
    m = tables.kept(messy(spark, small), "messy")
    rows = m.toPandas().sort_values("seq")
    assert rows.seq.tolist() == list(range(len(rows))) and rows.duplicated(["tourney_date", "match_num"]).sum() > 50 and rows.tourney_date.isna().sum() > 50
    rating, played, want = {}, {}, {}
    for r in rows.itertuples():
        if not r.winner_id or not r.loser_id:
            continue
        a, b = rating.get(r.winner_id, 1500.0), rating.get(r.loser_id, 1500.0)
        n = played.get(r.winner_id, 0), played.get(r.loser_id, 0)
        want[r.seq] = (*n, a, b)
        p = 1 / (1 + 10 ** ((b - a) / 400))
        k = [max(16, min(50, 250 / (x + 5) ** 0.4)) for x in n]
        rating[r.winner_id], rating[r.loser_id] = a + k[0] * (1 - p), b - k[1] * (1 - p)
        played[r.winner_id], played[r.loser_id] = n[0] + 1, n[1] + 1
    counts = {r.seq: (r.winner_played_pre, r.loser_played_pre) for r in ratings.matches_played_pre(m, ["seq"]).where("winner_played_pre is not null").collect()}
    assert counts == {k: v[:2] for k, v in want.items()}
    whole, state = ratings.rate(m, ["seq"])
    for r in whole.where("winner_elo_pre is not null").collect():
        assert (r.winner_elo_pre, r.loser_elo_pre) == (pytest.approx(want[r.seq][2], abs=0.006), pytest.approx(want[r.seq][3], abs=0.006))
    assert whole.where("winner_elo_pre is null").count() == len(rows) - len(want)
    shown = ["seq", *[f"{s}_{x}_pre" for s in ("winner", "loser") for x in ("elo", "surface_elo", "surface_env_elo", "clutch_elo")], "elo_prob_winner"]
    sliced = ratings.rate(m, ["seq"], slice_rows=200)[0]
    assert sorted(map(str, sliced.select(shown).collect())) == sorted(map(str, whole.select(shown).collect()))
    cut = len(rows) // 2
    half = ratings.rate(m.where(F.col("seq") < cut), ["seq"])[1]
    rest, after = ratings.rate(m.where(F.col("seq") >= cut), ["seq"], start=half)
    assert sorted(map(str, rest.select(shown).collect())) == sorted(map(str, whole.where(F.col("seq") >= cut).select(shown).collect()))
    key = lambda df: sorted((r.ladder, r.player_id, round(r.rating, 6), r.played) for r in df.collect())
    assert key(after) == key(state)
    pm = form.serve_return_metrics(ordering.sides(m, ["seq", "tourney_date", "tourney_date_raw"])).withColumn("day", F.datediff("tourney_date", F.lit("1970-01-01").cast("date")))
    streaks = {(r.seq, r.side): r.streak for r in form.streak(pm, ["seq"]).collect()}
    run: dict = {}
    for r in pm.toPandas().sort_values("seq").itertuples():
        assert streaks[r.seq, r.side] == (run.get(r.player_id, 0) if r.tourney_date_raw else None)  # without a date's text no features
        if r.valid and not math.isnan(r.day):
            last = run.get(r.player_id, 0)
            run[r.player_id] = (last + 1 if last > 0 else 1) if r.won else (last - 1 if last < 0 else -1)


def test_levels_and_components(spark):
    """Contests of players who aren't connected go to tasks of their own; a level's contests are rated in one step."""
    rng = np.random.default_rng(4)
    pairs = [(int(c * 10 + a), int(c * 10 + b)) for _ in range(60) for c in range(6) for a, b in [rng.choice(10 if c else 3, 2, replace=False)]]
    df = spark.createDataFrame([(i, w, l, "Hard", "I", "6-0 6-0 6-0", 3) for i, (w, l) in enumerate(pairs)], "seq long, winner_id long, loser_id long, surface_norm string, indoor string, score string, best_of int")
    comp = {r.node: r.comp for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert comp == {p: p // 10 * 10 for pair in pairs for p in pair}
    entries = tables.kept(ratings.ladders(df), "entries")
    dealt = ratings._dealt(entries, spark.createDataFrame([], ratings.STATE.format(id="long")), 64)[0].toPandas()
    assert dealt.task.nunique() > 6 and (dealt.assign(c=dealt.winner_id // 10).groupby(["ladder", "c"]).task.nunique() == 1).all()
    whole, state = ratings.fold(entries)
    one = ratings.fold(entries, slice_rows=50, tasks=1)
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert key(whole) == key(one[0]) and key(state) == key(one[1])
    steps = []
    n = 400
    w, l = np.arange(n) % 20, 20 + np.arange(n) % 20
    unique, np.unique = np.unique, lambda *a, **k: steps.append(1) or unique(*a, **k)
    try:
        ratings._level_by_level(w, l, np.full(n, 32.0), np.full(n, 32.0), np.ones(n, bool), np.full(40, 1500.0))
    finally:
        np.unique = unique
    assert len(steps) == n // 20  # 20 pairs in turn


def test_components_in_two_writes(spark, monkeypatch):
    """Long chains of several groups: forests of tasks, then of groups, without a write for each round; larger groups go by rounds."""
    rng = np.random.default_rng(9)
    pairs = [(g, f"{g}{i:04d}", f"{g}{i + 1:04d}") for g in "xyz" for i in range(600) if i % 200 != 150] + [("x", "lone", "lone")]
    df = spark.createDataFrame([pairs[i] for i in rng.permutation(len(pairs))], "g string, a string, b string").repartition(5)
    want = {(g, n): n if n == "lone" else f"{g}{max(x for x in (0, 151, 351, 551) if x <= int(n[1:])):04d}" for g, a, b in pairs for n in (a, b)}
    written = []
    monkeypatch.setattr(graph, "kept", lambda df, name: written.append(name) or tables.kept(df, name))
    monkeypatch.setattr(graph, "STEP", 50)
    found = lambda: {(r.g, r.node): r.comp for r in graph.components(df, ["g"]).collect()}
    assert found() == want and written == ["links", "labels"]
    monkeypatch.setattr(graph, "FEW", 10)
    assert found() == want


def test_slices_are_read_alone(spark, small):
    """Each slice of the ladders has a folder of its own; only the kinds asked for are rated, as with all of them."""
    m = matches(spark, small)
    read = []
    dealt, ratings._dealt = ratings._dealt, lambda rows, *a: read.append([r.path for r in rows.select(F.input_file_name().alias("path")).distinct().collect()]) or dealt(rows, *a)
    try:
        some = ratings.rate(m, ORDER, slice_rows=500, kinds=("elo", "clutch_elo"))[0]
    finally:
        ratings._dealt = dealt
    assert len(read) == 3 and all(f"_slice={i}/" in path for i, files in enumerate(read) for path in files)
    shown = ["match_num", "winner_elo_pre", "loser_elo_pre", "winner_clutch_elo_pre", "loser_clutch_elo_pre", "elo_prob_winner"]
    assert sorted(map(str, some.select(shown).collect())) == sorted(map(str, ratings.elo(m, ORDER).select(shown).collect()))
    assert "winner_surface_elo_pre" not in some.columns


def test_ties_keep_each_row_apart(spark):
    """Contests of one date and number: a player's first contest shows none before, whichever comes first."""
    rows = [("2020-01-01", 1, "a", "b"), ("2020-01-01", 1, "c", "d"), (None, 1, "a", "c"), ("2020-01-01", 1, "a", "d")]
    df = spark.createDataFrame(rows, "tourney_date string, match_num int, winner_id string, loser_id string").withColumns({"surface_norm": F.lit("Hard"), "indoor": F.lit("I"), "score": F.lit("6-0"), "best_of": F.lit(1)})
    got = ratings.matches_played_pre(df, ORDER).collect()
    assert len(got) == 4 and sorted(r.winner_played_pre for r in got if r.winner_id == "a") == [0, 1, 2] and [r.loser_played_pre for r in got if r.loser_id == "b"] == [0]
    out = ratings.elo(df, ORDER).collect()
    assert len(out) == 4 and sum(r.winner_elo_pre == 1500.0 for r in out) >= 1


def test_pools_and_names(spark, small):
    m = matches(spark, small)
    got = {r.match_num: (r.winner_elo_pre, r.loser_elo_pre) for r in QUERIES["elo_by_level"](spark, small).collect()}
    rating, played = {}, {}
    for r in m.toPandas().sort_values(ORDER, kind="stable").itertuples():
        a, b = (rating.get((r.tourney_level, p), 1500.0) for p in (r.winner_id, r.loser_id))
        assert got[r.match_num] == (pytest.approx(a, abs=0.006), pytest.approx(b, abs=0.006))
        k = [max(16, min(50, 250 / (played.get(p, 0) + 5) ** 0.4)) for p in (r.winner_id, r.loser_id)]
        won = 1 / (1 + 10 ** ((b - a) / 400))
        rating[r.tourney_level, r.winner_id], rating[r.tourney_level, r.loser_id] = a + k[0] * (1 - won), b - k[1] * (1 - won)
        for p in (r.winner_id, r.loser_id):
            played[p] = played.get(p, 0) + 1
    named = m.withColumns({f"{s}_name": F.when(F.col("match_num") % 3 == 0, " ").otherwise(F.concat(F.lit("N"), f"{s}_id", F.lit(" "), F.col("match_num").cast("string"))) for s in ("winner", "loser")})
    final = {r.player_id: r for r in ratings.final_ratings(named, ORDER).collect()}
    last = {}
    for r in named.toPandas().sort_values(ORDER, kind="stable").itertuples():
        for p, n in ((r.winner_id, r.winner_name), (r.loser_id, r.loser_name)):
            if n.strip():
                last[p] = n
    assert all(final[p].player_name == n for p, n in last.items()) and all(hasattr(r, "elo_hard_indoor") for r in final.values())


def test_sliding_models(spark):
    """Seven training windows of every block, with known probabilities in place of a model."""
    n = 4000
    df = spark.range(n).select(F.col("id").alias("seq"), (F.col("id") % 2).alias("target_player1_won"))
    seen = []

    def fit(train, validation, test):
        seen.append(tuple(x.agg(F.min("seq"), F.max("seq")).first() for x in (train, validation, test)))
        return test.withColumn("prob", F.lit(0.5))

    out = backtest.sliding_models(df, n, 2000, fit, offsets=[0, -20], train_rows=1000, workers=1)
    v = backtest.validation_rows(n)
    assert [(tuple(a), tuple(b), tuple(c)) for a, b, c in seen] == [((t - v - rows, t - v - 1), (t - v, t - 1), (t, min(t + 89, n - 1))) for rows in (1000, 800) for t in (2000, 3500)]
    assert out.groupBy("model", "block").count().where("count = 90").count() == 4
    trees = backtest.boosted(["seq"], rounds=2)
    few = df.where("seq < 300")
    assert trees(few, few.limit(0), few).count() == 300


def test_bootstrap_and_permutation(spark):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"match_idx": range(400), "stake": 1.0, "PSW": np.round(1.2 + rng.random(400), 2), "bet_won": (rng.random(400) < 0.6).astype(int)})
    df = spark.createDataFrame(rows)
    out = bets.bootstrap_roi(df, 2000).first()
    roi = 100 * ((rows.PSW * rows.bet_won).sum() - 400) / 400
    draws = [100 * ((s.PSW * s.bet_won).sum() - 400) / 400 for s in (rows.sample(400, replace=True, random_state=i) for i in range(1000))]
    assert out.roi_mean == pytest.approx(roi, abs=1) and out.roi_low == pytest.approx(np.percentile(draws, 2.5), abs=1.5) and out.roi_high == pytest.approx(np.percentile(draws, 97.5), abs=1.5)
    p = bets.permutation_pvalue(df, 500).first()
    assert p.roi == pytest.approx(roi, abs=1e-4) and 0 <= p.p_value <= 1
    assert bets.permutation_pvalue(df.withColumn("stake", F.lit(0.0)), 10).first().p_value is None


def test_permutation_of_many_bets(spark):
    """Blocks of pays give the p-value of plain shuffles, and more than a million bets are no limit."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"stake": (rng.random(300) < 0.8).astype(float), "PSW": np.round(1.2 + rng.random(300) * 2, 2), "bet_won": (rng.random(300) < 0.5).astype(int)})
    pay, won = (rows.stake * rows.PSW).to_numpy(), rows.bet_won.to_numpy()
    plain = np.mean([rng.permutation(won) @ pay >= won @ pay - 1e-9 for _ in range(10_000)])
    df = spark.createDataFrame(rows)
    for size in (7, 20_000):
        assert bets.permutation_pvalue(df, 10_000, block_values=size).first().p_value == pytest.approx(plain, abs=0.025)
    many = spark.range(1_200_000).select(F.lit(1.0).alias("stake"), (1.5 + F.col("id") % 3).alias("PSW"), (F.col("id") % 3 == 2).cast("int").alias("bet_won"))
    assert tuple(bets.permutation_pvalue(many, 200).first()) == (pytest.approx(100 * (3.5 / 3 - 1), abs=1e-4), 0.0)
    big = [bets._drawn(np.random.default_rng(i), 10**10, 2 * 10**10, np.array([3 * 10**6]))[0] for i in range(50)]
    assert abs(np.mean(big) - 10**6) < 1000


def test_deciles_of_few_ties(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0, 1) for i in range(7)], "match_idx int, confidence double, PSW double, bet_won int")
    assert bets.roi_by_decile(df).agg(F.sum("n")).first()[0] == 7


def test_load_of_same_day_and_edges(spark):
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    rows = [(day(0), 1, 60), (day(30), 2, None), (day(30), 3, 90), (day(31), 4, 30)]
    pm = spark.createDataFrame([(1, d, n, (d - day(0)).days, 2, m) for d, n, m in rows], "player_id int, tourney_date date, match_num int, day int, sets int, minutes int")
    got = [(r.matches_last_30d, r.sets_last_30d, r.minutes_last_30d) for r in fatigue.load_30_days(pm, ORDER).orderBy("match_num").collect()]
    assert got == [(0, 0, None), (1, 2, 60.0), (2, 4, 60.0), (2, 4, 90.0)]
    assert [r.rest_days for r in fatigue.rest_days(pm, ORDER).orderBy("match_num").collect()] == [None, 30, 0, 1]


def test_missing_ids(spark, small):
    m = matches(spark, small).withColumn("loser_id", F.when(F.col("match_num") % 50 != 0, F.col("loser_id")))
    out = ratings.elo(m, ORDER)
    assert out.count() == m.count() and out.where("loser_id is null and winner_elo_pre is not null").count() == 0
    assert h2h.head_to_head(m, ORDER).count() == m.count()


def test_empty_tables(spark, small):
    m = matches(spark, small).limit(0)
    assert ratings.elo(m, ORDER).count() == 0 and ordering.chronological_order(m, *ORDER).count() == 0
    assert form.exponential(form.serve_return_metrics(player_matches(spark, small).limit(0)), ORDER).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "2020.csv").write_text("tourney_id,winner_id,extra\na,1,x\nb,,y\n")
    (tmp_path / "2021.csv").write_text("tourney_id,loser_id\nc,7\n")
    df = tables.read_matches(spark, [f"{tmp_path}/2020.csv", f"{tmp_path}/2021.csv"])
    assert df.columns[: len(tables.MATCH_COLUMNS)] == tables.MATCH_COLUMNS and "extra" in df.columns
    assert sorted((r.source_file, r.tourney_id, r.winner_id, r.loser_id) for r in df.collect())[1] == ("2020.csv", "b", None, None)
    assert tables.select_source_files([2021, 2020], challenger=True, qualifying=True) == [
        "ongoing_tourneys.csv", "2020.csv", "2021.csv", "challenger_ongoing_tourneys.csv", "2020_challenger.csv", "2021_challenger.csv", "2020_atp_quali.csv", "2021_atp_quali.csv",
    ]
    assert tables.main_tour_files(["/a/2021.csv", "/a/2020_challenger.csv", "/a/ongoing_tourneys.csv", "/a/2020.csv"]) == ["/a/2020.csv", "/a/2021.csv", "/a/ongoing_tourneys.csv"]
    assert tables.main_tour_files(["2021.csv", "ongoing_tourneys.csv"], ongoing=False) == ["2021.csv"] and len(tables.EXPECTED_COLUMNS) == 34
    checked = {r.source_file: r for r in profile.check_files(df, ["tourney_id", "loser_id"]).collect()}
    assert (checked["2020.csv"].n_columns, checked["2020.csv"].missing, checked["2020.csv"].ok) == (3, "loser_id", False) and checked["2021.csv"].ok
    rates = {r.source_file: (r.winner_id, r.loser_id, r.nowhere) for r in profile.missing_rate(df, "source_file", ["winner_id", "loser_id", "nowhere"]).collect()}
    assert rates == {"2020.csv": (50.0, None, None), "2021.csv": (None, 0.0, None)}
    (tmp_path / "o.csv").write_text("Date,Winner,Loser,PSW,PSL\n03/05/21,A B.,C D.,1.5,x\n")
    assert tuple(tables.read_odds(spark, [f"{tmp_path}/o.csv"]).select("PSW", "PSL").first()) == (1.5, None)
