"""Reading contest and odds files, writing stage tables, and tables kept in the shared folder."""

from __future__ import annotations

import csv
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a player's serve.
SERVE = ["ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "SvGms", "bpSaved", "bpFaced"]
SERVE_COLUMNS = [f"{s}_{c}" for s in "wl" for c in SERVE]
#: The canonical columns of a contest, in order.
MATCH_COLUMNS = [
    "tourney_id", "tourney_name", "surface", "surface_norm", "draw_size", "tourney_level", "indoor", "tourney_date", "match_num",
    "winner_id", "winner_seed", "winner_entry", "winner_name", "winner_hand", "winner_ht", "winner_ioc", "winner_age", "winner_rank", "winner_rank_points",
    "loser_id", "loser_seed", "loser_entry", "loser_name", "loser_hand", "loser_ht", "loser_ioc", "loser_age", "loser_rank", "loser_rank_points",
    "score", "best_of", "round", "minutes",
    "w_ace", "w_df", "w_svpt", "w_1stIn", "w_1stWon", "w_2ndWon", "w_SvGms", "w_bpSaved", "w_bpFaced",
    "l_ace", "l_df", "l_svpt", "l_1stIn", "l_1stWon", "l_2ndWon", "l_SvGms", "l_bpSaved", "l_bpFaced", "source_file",
]
#: The columns that a usable file must have.
EXPECTED_COLUMNS = [
    "tourney_id", "tourney_name", "surface", "tourney_level", "tourney_date", "match_num",
    "winner_id", "winner_name", "winner_rank", "loser_id", "loser_name", "loser_rank",
    "score", "best_of", "round", "minutes",
    "w_ace", "w_df", "w_svpt", "w_1stIn", "w_1stWon", "w_2ndWon", "w_SvGms", "w_bpSaved", "w_bpFaced",
    "l_ace", "l_df", "l_svpt", "l_1stIn", "l_1stWon", "l_2ndWon", "l_SvGms", "l_bpSaved", "l_bpFaced",
]
#: Names of the files of events that still run.
ONGOING, CHALLENGER_ONGOING = "ongoing_tourneys.csv", "challenger_ongoing_tourneys.csv"
#: Odds columns by book and side.
ODDS = [f"{book}{side}" for book in ("B365", "PS", "EX", "Max", "Avg") for side in "WL"]
DOUBLES = {*SERVE_COLUMNS, "minutes", *[f"{s}_{c}" for s in ("winner", "loser") for c in ("ht", "age", "rank_points")]}
INTS = {"draw_size", "match_num", "best_of", *[f"{s}_{c}" for s in ("winner", "loser") for c in ("seed", "rank")]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_source_files(years: list[int], challenger: bool = False, qualifying: bool = False, ongoing: bool = True) -> list[str]:
    """Names of the files of a run: one for each year and tier, and those of events that still run."""
    found = [ONGOING] * ongoing + [f"{y}.csv" for y in sorted(set(years))]
    if challenger:
        found += [CHALLENGER_ONGOING] * ongoing + [f"{y}_challenger.csv" for y in sorted(set(years))]
    return found + [f"{y}_atp_quali.csv" for y in sorted(set(years))] * qualifying


def main_tour_files(paths: list[str], ongoing: bool = True) -> list[str]:
    """Of the paths those whose names are years (``2023.csv``) and, unless declined, that of running events; sorted."""
    name = lambda p: p.rstrip("/").rsplit("/", 1)[-1]
    return sorted(p for p in paths if name(p).rsplit(".", 1)[0].isdigit() or (ongoing and name(p) == ONGOING))


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path`` of every file under the paths, as a relation: the listing that a read begins with, so nothing is read, and files
    without a byte (which readers skip) are there."""
    found = spark.read.option("recursiveFileLookup", True).text(paths).inputFiles()
    return spark.createDataFrame([(path,) for path in sorted(found)], "path string")


def headers(spark: SparkSession, paths: list[str], fmt: str = "csv") -> dict[tuple[str, ...], list[str]]:
    """The files under the paths by their columns. For CSV that is each file's first line, found in one pass over all files;
    other formats say their columns themselves. What comes to the driver is a row a file."""
    if fmt != "csv":
        own: dict[tuple[str, ...], list[str]] = {}
        for path in paths:
            own.setdefault(tuple(spark.read.format(fmt).load(path).columns), []).append(path)
        return own
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    lines = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "n").alias("line"))
    found: dict[str, list[str]] = {}
    for r in lines.collect():
        found.setdefault(r["line"].removeprefix("\ufeff"), []).append(r["path"])
    return {tuple(next(csv.reader([line]), [])): sorted(files) for line, files in sorted(found.items())}


def _read(spark: SparkSession, paths: list[str], fmt: str) -> DataFrame:
    """All files by column name, text columns for CSV: one read for each header, with ``source_file`` and ``source_columns``."""
    parts = []
    for columns, files in headers(spark, paths, fmt).items():
        fields = ", ".join(f"`{c}` string" for c in columns)
        part = spark.read.csv(files, header=True, schema=fields) if fmt == "csv" else spark.read.format(fmt).load(files)
        parts.append(part.withColumns({"source_file": F.col("_metadata.file_name"), "source_columns": F.lit(list(columns)).cast("array<string>")}))
    if not parts:
        return spark.createDataFrame([], "source_file string, source_columns array<string>")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_matches(spark: SparkSession, paths: list[str], fmt: str = "csv") -> DataFrame:
    """All files by column name as text columns, with ``source_file``, ``row_no`` (rising within a file) and
    ``source_columns`` (the file's own columns).

    Files may lack columns (null then) and have others (kept after the canonical ones). Blank text becomes null. Headers
    are found in one pass, and files of one header are read together, so jobs grow with headers and not with files."""
    df = _read(spark, paths, fmt)
    missing = {c: F.lit(None).cast("string") for c in MATCH_COLUMNS if c not in df.columns}
    df = df.withColumns(missing) if missing else df
    rest = [c for c in df.columns if c not in MATCH_COLUMNS and c != "source_columns"]
    blank = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in [*MATCH_COLUMNS, *rest]]
    return df.select(*blank, "source_columns").withColumn("row_no", F.monotonically_increasing_id())


def read_odds(spark: SparkSession, paths: list[str], fmt: str = "csv") -> DataFrame:
    """All odds files by column name: Date, Winner, Loser and those odds columns that any file has, as doubles. Files of one
    header are read together."""
    df = _read(spark, paths, fmt)
    odds = [F.col(c).try_cast("double").alias(c) for c in ODDS if c in df.columns]
    return df.select("Date", "Winner", "Loser", *odds, "source_file").withColumn("row_no", F.monotonically_increasing_id())


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by_year: bool = True, years_only: bool = False) -> None:
    """One table for a stage, by year of ``tourney_date`` where it has one. With ``years_only`` only the years that ``df`` has
    are replaced and the others stay, so one year can be written again, and a rerun changes nothing."""
    if by_year and "tourney_date" in df.columns:
        mode = "dynamic" if years_only else "static"
        df.withColumn("year", F.year("tourney_date")).write.partitionBy("year").mode("overwrite").option("partitionOverwriteMode", mode).option("header", True).format(fmt).save(path)
    else:
        df.write.mode("overwrite").format(fmt).option("header", True).save(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a
    temporary folder of its own; on a cluster that would be a disk which other machines can't see, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: computed once, and safe when executors are lost.

    The results of the operators are lazy and read such tables, so the folder's owner clears it, not the operator."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
