"""Files in and out: aliased CSV scans, provenance, atomic publication and unique appends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own under spark.checkpoint.dir (a local master may have none) and read back."""
    sc = df.sparkSession.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{folder or tempfile.mkdtemp(prefix='boutwright-')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def aliased(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns under their canonical names; matching ignores case, spaces and underscores, the first alias wins."""
    plain = lambda c: "".join(ch for ch in c.lower() if ch.isalnum())
    known = {plain(k): v for k, v in aliases.items()}
    out, seen = [], set()
    for c in df.columns:
        name = known.get(plain(c), c)
        if name not in seen:
            out.append(F.col(f"`{c}`").alias(name))
            seen.add(name)
    return df.select(*out)


def with_provenance(df: DataFrame, kind: str, file: str | None = None, proven: tuple[str, ...] = ("odds_api",)) -> DataFrame:
    """Source kind and file, observation time, hours to the start and whether the price surely stood before it.

    Only sources that prove their day offset (``proven``) can be verified.
    """
    name = F.lit(file) if file else F.col("_metadata.file_name")
    ok = F.lit(kind in proven) & F.coalesce(F.col("offset_days") > 0, F.lit(False))
    return df.withColumns({"source_kind": F.lit(kind), "source_file": name, "observed_at": F.try_to_timestamp(F.col("query_date").cast("string")), "hours_to_start": F.col("offset_days") * 24.0, "verified_prefight": ok})


#: Historical odds sources from the weakest to the strongest; of equal rows the strongest stands.
ODDS_SOURCES = ("legacy", "bfo", "bfo_recovered", "odds_api")


def historical_odds(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources with provenance, one row for each date, pair (as written) and offset: the strongest source, then its last row."""
    from ..functions.names import normalise
    from ..operators.dedupe import keep_best
    from ..operators.lines import valid_moneyline

    out = None
    for i, kind in enumerate(k for k in ODDS_SOURCES if k in sources):
        part = with_provenance(sources[kind], kind, kind).withColumn("__p", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    keyed = valid_moneyline(out).withColumns({"__a": normalise(F.col("a_name")), "__b": normalise(F.col("b_name"))})
    return keep_best(keyed, ["event_date", "__a", "__b", "offset_days"], [F.desc("__p"), F.desc("row_id")]).drop("__p", "__a", "__b")


#: Other names of a bout file's columns (any case, spaces or underscores).
BOUT_ALIASES = {"date": "event_date", "r_fighter": "fighter_a", "red fighter": "fighter_a", "b_fighter": "fighter_b", "blue fighter": "fighter_b", "winner": "winner", "weight class": "weight_class", "r_height": "a_height", "b_height": "b_height", "r_reach": "a_reach", "b_reach": "b_reach", "r_avg_sig_str_pct": "a_str_acc", "b_avg_sig_str_pct": "b_str_acc", "title bout": "title_bout", "r_odds": "a_odds", "b_odds": "b_odds", "no of rounds": "num_rounds"}


def bouts_of(raw: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """A bout file's text columns under canonical names, parsed: dates, heights, reaches, percentages, flags, the winner's name (from Red or Blue too) and the target (1 where side a won, null where no side did)."""
    from ..functions import scalars as S

    df = aliased(raw, {**BOUT_ALIASES, **(aliases or {})})
    has = set(df.columns)
    parsers = {"event_date": lambda c: F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("M/d/yyyy")), F.try_to_timestamp(c, F.lit("MMMM d, yyyy"))).cast("date"), "title_bout": S.nullable_binary, "num_rounds": lambda c: c.try_cast("double")}
    for s in "ab":
        parsers |= {f"{s}_height": S.height_cm, f"{s}_reach": S.reach_cm, f"{s}_str_acc": S.percent, f"{s}_odds": lambda c: c.try_cast("double")}
    out = df.withColumns({c: f(F.trim(F.col(c))) for c, f in parsers.items() if c in has})
    w = F.lower(F.trim("winner"))
    winner = F.when(w == "red", F.col("fighter_a")).when(w == "blue", F.col("fighter_b")).otherwise(F.col("winner"))
    out = out.withColumn("winner", winner)
    return out.withColumn("target", F.when(F.col("winner") == F.col("fighter_a"), 1).when(F.col("winner") == F.col("fighter_b"), 0)).where("event_date is not null and fighter_a is not null and fighter_b is not null")


def save_snapshot(df: DataFrame, root: str, key: str, time: str, batch: int) -> bool:
    """Quotes by day and the opening line of every key that no earlier batch holds, committed together as ``batch``.

    The opening is the first row by ``time``, then row_id. A batch that stands already is left alone
    (False), so a pass that died half-way or is repeated leaves each row once.
    """
    spark = df.sparkSession
    first = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(time, "row_id")).alias("x")).select(key, "x.*")
    known = commits.read_committed(spark, f"{root}", "openings", first.schema, before=batch)
    frames = {"snapshots": df.withColumn("day", F.to_date(time)), "openings": first.join(known.select(key), key, "left_anti")}
    return commits.commit_frames(frames, root, batch)


def saved_snapshots(spark: SparkSession, root: str, schema) -> DataFrame:
    """Committed quotes, with the day they belong to."""
    return commits.read_committed(spark, root, "snapshots", f"{_ddl(schema)}, day date")


def saved_openings(spark: SparkSession, root: str, schema) -> DataFrame:
    return commits.read_committed(spark, root, "openings", schema)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free checksum of a table."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    return r["n"], r["h"]


def read_verified(spark: SparkSession, paths: dict[str, str], manifest: dict[str, tuple[int, str]]) -> dict[str, DataFrame]:
    """Tables whose rows and checksums agree with the manifest, all of them or none."""
    out = {n: spark.read.parquet(p) for n, p in paths.items()}
    wrong = [n for n, df in out.items() if digest(df) != tuple(manifest[n])]
    if wrong:
        raise ValueError(f"not what the manifest says: {', '.join(wrong)}")
    return out


def publish(spark: SparkSession, frames: dict[str, DataFrame], root: str, refuse_empty: bool = True, version: int | None = None) -> int:
    """Write all frames and commit them as the next version (or as ``version``): readers see all of them or none.

    A version that stands already is not written again; of two writers of one next version the
    second one takes the version after it.
    """
    while True:
        last = commits.latest(spark, root)
        number = version if version is not None else last["batch"] + 1 if last else 0
        if commits.commit_frames(frames, root, number, {"names": sorted(frames)}, refuse_empty=refuse_empty) or version is not None:
            return number


def read_published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A frame of the latest version, or of the one asked for."""
    known = [e for e in commits.entries(spark, root) if version is None or e["batch"] == version]
    if not known:
        raise ValueError(f"nothing is published under {root}")
    return commits.read_frame(spark, root, known[-1], name)
