"""Contests derived from the driver's tables: an order is one, its two best suppliers by revenue are winner and loser."""

from __future__ import annotations

import re

from duelkit.operators.ordering import sides
from duelkit.sources.tables import table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["tourney_date", "match_num"]

MATCHES = """
WITH side AS (
  SELECT l_orderkey AS k, l_suppkey AS pid, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS rev,
         CAST(sum(l_quantity) AS BIGINT) AS svpt,
         CAST(sum(CASE WHEN l_linestatus='F' THEN l_quantity ELSE 0 END) AS BIGINT) AS first_in,
         CAST(sum(CASE WHEN l_linestatus='F' AND l_returnflag<>'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS first_won,
         CAST(sum(CASE WHEN l_linestatus='O' AND l_returnflag='N' THEN l_quantity ELSE 0 END) AS BIGINT) AS second_won,
         CAST(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS BIGINT) AS bp_saved
  FROM lineitem GROUP BY l_orderkey, l_suppkey),
r AS (SELECT side.*, s.s_nationkey AS nk, row_number() OVER (PARTITION BY k ORDER BY rev DESC, pid) AS rk
      FROM side JOIN supplier s ON s.s_suppkey = side.pid)
SELECT o.o_orderkey AS match_num,
       concat(CAST(year(o.o_orderdate) AS STRING), '-', substr(o.o_orderpriority,1,1)) AS tourney_id,
       CAST(date_trunc('week', o.o_orderdate) AS DATE) AS tourney_date,
       CASE o.o_orderstatus WHEN 'F' THEN 'Hard' WHEN 'O' THEN 'Clay' ELSE 'Grass' END AS surface_norm,
       CASE substr(o.o_orderpriority,1,1) WHEN '1' THEN 'G' WHEN '2' THEN 'M' WHEN '3' THEN 'F' WHEN '4' THEN 'D' ELSE 'A' END AS tourney_level,
       CASE WHEN o.o_orderkey % 2 = 0 THEN 32 ELSE 64 END AS draw_size,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'O' ELSE '' END AS indoor,
       CASE o.o_orderkey % 5 WHEN 0 THEN '6-4 6-3' WHEN 1 THEN '7-6(5) 3-6 6-2' WHEN 2 THEN '6-1 2-1 RET' WHEN 3 THEN 'W/O' ELSE '6-4 6-7(3) 7-5' END AS score,
       3 AS best_of,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE w.svpt + l.svpt END AS minutes,
       w.pid AS winner_id, l.pid AS loser_id,
       CASE w.nk % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE 'U' END AS winner_hand,
       CASE l.nk % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE 'U' END AS loser_hand,
       CASE WHEN w.pid % 13 = 0 THEN NULL ELSE w.pid + 1 END AS winner_rank,
       CASE WHEN l.pid % 13 = 0 THEN NULL ELSE l.pid + 1 END AS loser_rank,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE w.svpt END AS w_svpt, w.first_in AS w_1stIn, w.first_won AS w_1stWon, w.second_won AS w_2ndWon,
       w.n AS w_SvGms, w.bp_saved AS w_bpSaved, w.n AS w_bpFaced,
       l.svpt AS l_svpt, l.first_in AS l_1stIn, l.first_won AS l_1stWon, l.second_won AS l_2ndWon,
       l.n AS l_SvGms, l.bp_saved AS l_bpSaved, l.n AS l_bpFaced,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE (110 + (o.o_orderkey * 37) % 290) / CAST(100 AS DOUBLE) END AS PSW,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE (110 + (o.o_orderkey * 53) % 290) / CAST(100 AS DOUBLE) END AS PSL
FROM orders o JOIN r w ON w.k = o.o_orderkey AND w.rk = 1 JOIN r l ON l.k = o.o_orderkey AND l.rk = 2
"""

_SIDES, _RANKED, _SHOWN = re.match(r"\nWITH side AS \((.*) FROM lineitem (.*\)),\nr AS .*\n(SELECT o\..*)\nFROM orders o ", MATCHES, re.DOTALL).groups()
_OF_SIDE = ["pid", "nk", "n", "svpt", "first_in", "first_won", "second_won", "bp_saved"]
#: The same contests as Spark gets them: lines are dealt by order once, for their sums, their ranks and both sides of a row.
DEALT = (
    f"WITH side AS ({_SIDES} FROM (SELECT /*+ REPARTITION(l_orderkey) */ * FROM lineitem) {_RANKED}, r AS {MATCHES[MATCHES.index('r AS (') + 5 : MATCHES.index('SELECT o.o_orderkey')].rstrip()},\n"
    f"pair AS (SELECT k, {', '.join(f'max(CASE WHEN rk = {rk} THEN {c} END) AS {s}_{c}' for rk, s in ((1, 'w'), (2, 'l')) for c in _OF_SIDE)} FROM r WHERE rk <= 2 GROUP BY k HAVING max(rk) = 2)\n"
    + re.sub(r"\b([wl])\.", r"\1_", _SHOWN) + "\nFROM orders o JOIN pair ON pair.k = o.o_orderkey"
)

STATS = ["svpt", "1stIn", "1stWon", "2ndWon", "SvGms", "bpSaved", "bpFaced"]
#: One side's view of a contest, for SQL: ``pm`` over ``m``.
PM = "pm AS (" + " UNION ALL ".join(
    f"SELECT match_num, tourney_date, surface_norm, score, minutes, '{a}' AS side, {w}_id AS player_id, {l}_id AS opponent_id, {int(a == 'w')} AS won, "
    f"{w}_rank AS elo, {l}_rank AS o_elo, " + ", ".join(f'{a}_{c} AS "{c}"' for c in STATS) + ", " + ", ".join(f'{b}_{c} AS "o_{c}"' for c in STATS) + " FROM m"
    for a, b, w, l in (("w", "l", "winner", "loser"), ("l", "w", "loser", "winner"))
) + ")"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("lineitem", "supplier", "orders"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(DEALT)


def player_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows a contest, with ``day`` (a day's number) and ranks as ratings."""
    m = matches(spark, sf_dir)
    rank = lambda a, b: F.when(F.col("side") == "w", F.col(f"{a}_rank")).otherwise(F.col(f"{b}_rank"))
    pm = sides(m, [*ORDER, "surface_norm", "score", "minutes", "winner_rank", "loser_rank"])
    day = F.datediff("tourney_date", F.lit("1970-01-01").cast("date"))
    return pm.withColumns({"day": day, "elo": rank("winner", "loser"), "o_elo": rank("loser", "winner")}).drop("winner_rank", "loser_rank")
