"""Career supplements, reviewed histories and pulled round statistics, as participant rows or training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import scalars as S
from ..operators.dedupe import collapse_bouts, keep_best
from ..operators.history import result_of


def long_rows(raw: DataFrame, ambiguous: DataFrame | None = None) -> DataFrame:
    """Two rows a supplement bout (a side without a name has none), with identity keys of both sides.

    Raw rows have row_id, event_date, a_name, b_name, a_ref, b_ref, winner, method, finish_round,
    organisation, weight_class. ``ambiguous`` lists the canonical names that several people share.
    """

    def side(s: str, o: str) -> Column:
        me, you = F.col(f"{s}_name"), F.col(f"{o}_name")
        return F.struct(me.alias("name"), F.col(f"{s}_ref").alias("ref"), you.alias("opponent"), F.col(f"{o}_ref").alias("opponent_ref"), result_of(F.col("winner"), me, you).alias("result"))

    keep = ["row_id", "event_date", "method", F.col("finish_round").cast("string").try_cast("double").alias("finish_round"), "organisation", "weight_class"]
    rows = raw.select(*keep, F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("row_id", "event_date", "method", "finish_round", "organisation", "weight_class", "x.*")
    rows = rows.where(F.length(F.coalesce("name", F.lit(""))) > 0)
    for who, ref, out in (("name", "ref", "entity"), ("opponent", "opponent_ref", "opponent_key")):
        shared = F.lit(False)
        if ambiguous is not None:
            rows = rows.withColumn("__c", I.canonical_key(F.col(who))).join(ambiguous.select(F.col("name_key").alias("__c"), F.lit(True).alias("__s")), "__c", "left")
            shared = F.coalesce("__s", F.lit(False))
        rows = rows.withColumn(out, I.identity_key(F.col(who), F.col(ref), shared)).drop("__c", "__s")
    return rows.drop("ref", "opponent_ref")


def without_quarantined(rows: DataFrame, quarantined: DataFrame, names: str = "name_key") -> DataFrame:
    """Rows whose canonical name, or that of the opponent, is not on the quarantine list."""
    q = quarantined.select(F.col(names).alias("__q")).distinct()
    for who in ("name", "opponent"):
        rows = rows.join(q, I.canonical_key(F.col(who)) == F.col("__q"), "left_anti")
    return rows


def without_reviewed(rows: DataFrame, reviewed: DataFrame, key: str = "entity") -> DataFrame:
    """Legacy rows of identities that have a reviewed history are left to that history."""
    return rows.join(reviewed.select(key).distinct(), key, "left_anti")


def professional(raw: DataFrame, ambiguous: DataFrame | None = None, quarantined: DataFrame | None = None, reviewed: DataFrame | None = None) -> DataFrame:
    """Mirrored rows once, tracked bouts out, two rows a bout, quarantine and reviewed identities out, one row a bout and participant, undated rows out."""
    pair = [F.least("a_name", "b_name").alias("__lo"), F.greatest("a_name", "b_name").alias("__hi")]
    once = keep_best(raw.select("*", *pair), ["event_date", "__lo", "__hi"], [F.desc(F.length(F.coalesce("organisation", F.lit("")))), F.asc("row_id")]).drop("__lo", "__hi")
    return _loaded(once.where(~I.is_tracked(F.col("organisation"))), ambiguous, quarantined, reviewed).where("event_date is not null")


def amateur(raw: DataFrame, ambiguous: DataFrame | None = None, quarantined: DataFrame | None = None, reviewed: DataFrame | None = None) -> DataFrame:
    """As professional(), with tracked organisations and undated rows kept."""
    pair = [F.least("a_name", "b_name").alias("__lo"), F.greatest("a_name", "b_name").alias("__hi")]
    once = keep_best(raw.select("*", *pair), ["event_date", "__lo", "__hi"], [F.desc(F.length(F.coalesce("organisation", F.lit("")))), F.asc("row_id")]).drop("__lo", "__hi")
    return _loaded(once, ambiguous, quarantined, reviewed)


def _loaded(raw: DataFrame, ambiguous, quarantined, reviewed) -> DataFrame:
    rows = long_rows(raw, ambiguous)
    rows = without_quarantined(rows, quarantined) if quarantined is not None else rows
    rows = without_reviewed(rows, reviewed) if reviewed is not None else rows
    keyed = rows.withColumns({"day": F.col("event_date"), "opp_key": F.array_join(F.array_sort(F.split(F.coalesce("opponent_key", F.lit("")), " ")), " "), "flat_key": F.regexp_replace(F.coalesce("opponent_key", F.lit("")), " ", ""), "tier": F.lit(None).cast("int")})
    # a participant without an identity cannot be told from another: such rows are never collapsed
    return collapse_bouts(keyed.where("entity is not null")).unionByName(keyed.where("entity is null")).drop("day", "opp_key", "flat_key", "tier")


def reviewed_history(rows: DataFrame, kind: str, group: str, digest: Column | None = None, pinned: str | None = None) -> DataFrame:
    """Rows of one kind whose whole group is valid (dated, a known result, the subject's birth date confirmed).

    With ``pinned`` the content's digest must agree, or nothing is returned but an error.
    """
    if pinned is not None:
        seen = rows.agg(digest.alias("d")).first()["d"]
        if seen != pinned:
            raise ValueError(f"reviewed history changed: {seen}")
    own = rows.where(F.col("history_type") == kind)
    valid = F.col("event_date").isNotNull() & F.col("subject_result").isin("win", "loss", "draw") & (F.col("dob_match") == "match")
    ok = own.groupBy(group).agg(F.every(F.coalesce(valid, F.lit(False))).alias("ok")).where("ok").select(group)
    return own.join(ok, group, "left_semi")


#: Raw columns of counts that read "x of y", and the names they get.
PULLED = {"SIG.STR.": "sig_str", "TOTAL STR.": "total_str", "TD": "td", "HEAD": "head", "BODY": "body", "LEG": "leg", "DISTANCE": "distance", "CLINCH": "clinch", "GROUND": "ground"}


def round_totals(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over rounds; a sum is null where every round is unknown, control time where any round's is."""
    cols = {"kd": F.col("KD").try_cast("double"), "sub_att": F.col("`SUB.ATT`").try_cast("double"), "rev": F.col("`REV.`").try_cast("double"), "ctrl_seconds": S.clock_seconds(F.col("CTRL")).cast("double")}
    for raw, name in PULLED.items():
        cols |= {f"{name}_landed": S.landed(F.col(f"`{raw}`")), f"{name}_attempted": S.attempted(F.col(f"`{raw}`"))}
    out = stats.select(*keys, *[v.alias(k) for k, v in cols.items()]).groupBy(*keys)
    ctrl = F.when(~F.bool_or(F.col("ctrl_seconds").isNull()), F.sum("ctrl_seconds")).alias("ctrl_seconds")
    return out.agg(*[ctrl if c == "ctrl_seconds" else F.sum(c).alias(c) for c in cols])


def training_rows(results: DataFrame, totals: DataFrame) -> DataFrame:
    """A row a bout with both sides' totals, minutes and a target (1 where side a won); results without a winner are no target and left out.

    Results have fight_id, event_date, a_name, b_name, outcome, method, round, time.
    """
    r = results.withColumn("r", S.official_result(F.col("outcome"), F.col("method"))).where("r.is_target")
    out = r.select("fight_id", "event_date", "a_name", "b_name", "method", (F.col("r.winner_side") == "a").cast("int").alias("target"), (S.total_seconds(F.col("round").try_cast("int"), F.col("time")) / 60).alias("minutes"))
    stats = [c for c in totals.columns if c not in ("fight_id", "name")]
    for s in "ab":
        side = totals.select("fight_id", F.col("name").alias(f"{s}_name"), *[F.col(c).alias(f"{s}_{c}") for c in stats])
        out = out.join(side, ["fight_id", f"{s}_name"], "left")
    return out
