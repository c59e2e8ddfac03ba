"""Refreshing accepted tables: what must stay, what may be added, and which rows of two sources belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def appended(accepted: DataFrame, delta: DataFrame) -> DataFrame:
    """Accepted rows as they are, inherited duplicates included, and the delta's rows under the accepted header; columns the delta lacks are null, others it has are left out."""
    cols = [F.col(c).cast(t).alias(c) if c in delta.columns else F.lit(None).cast(t).alias(c) for c, t in accepted.dtypes]
    return accepted.unionByName(delta.select(*cols))


def lost_occurrences(accepted: DataFrame, candidate: DataFrame) -> DataFrame:
    """Accepted rows that the candidate holds fewer times, with how many are lost."""
    cols = accepted.columns
    n = lambda df, s: df.select(*cols, F.lit(s).alias("__s"))
    both = n(accepted, 1).unionByName(n(candidate.select(*cols), -1)).groupBy(*cols).agg(F.sum("__s").alias("n_lost"))
    return both.where("n_lost > 0")


def duplicate_report(accepted: DataFrame, candidate: DataFrame, key: Column) -> DataFrame:
    """One row: invalid and duplicate identities that are new, that are inherited unchanged, and inherited ones that changed or went.

    Rows are compared as multisets over the accepted columns, so an untouched anomaly of the
    baseline passes and any change of it does not.
    """
    cols = accepted.columns
    mark = lambda df, s: df.select(*cols).withColumn("__k", key).withColumn("__s", F.lit(s))
    per = mark(accepted, "a").unionByName(mark(candidate, "c")).groupBy("__k", *cols).agg(F.count(F.when(F.col("__s") == "a", 1)).alias("__a"), F.count(F.when(F.col("__s") == "c", 1)).alias("__c"))
    more, less, kept = F.greatest(F.col("__c") - F.col("__a"), F.lit(0)), F.greatest(F.col("__a") - F.col("__c"), F.lit(0)), F.least("__a", "__c")
    keys = per.groupBy("__k").agg(F.sum("__a").alias("__a"), F.sum("__c").alias("__c"), F.sum(more).alias("more"), F.sum(less).alias("less"), F.sum(kept).alias("kept"))
    bad, au, cu = F.col("__k").isNull(), F.greatest(F.col("__a") - 1, F.lit(0)), F.greatest(F.col("__c") - 1, F.lit(0))
    broken = (au > 0) & ((cu < au) | (F.col("less") > 0))
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0)).cast("long")
    out = keys.agg(
        total(bad, F.col("more")).alias("new_invalid"), total(bad, F.col("less")).alias("lost_invalid"), total(bad, F.col("kept")).alias("inherited_invalid"),
        total(~bad, F.greatest(cu - au, F.lit(0))).alias("new_duplicates"), total(~bad & broken, F.greatest(au - cu, F.col("less"), F.lit(1))).alias("changed_duplicates"), total(~bad & (au > 0) & ~broken, F.lit(1)).alias("inherited_duplicates"),
    )
    return out.withColumn("passed", (F.col("new_invalid") + F.col("lost_invalid") + F.col("new_duplicates") + F.col("changed_duplicates")) == 0)


def accepted_changes(accepted: DataFrame, candidate: DataFrame, key: str, fields: list[str], fill_ok: bool = False) -> DataFrame:
    """key, field, change: accepted rows that were removed, fields that changed, and rows that are new.

    With ``fill_ok`` an unknown accepted value may become known.
    """
    n = candidate.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields])
    both = accepted.select(key, *fields, F.lit(True).alias("__old")).join(n.withColumn("__new", F.lit(True)), F.col(key) == F.col("__k"), "full")
    id_ = F.coalesce(key, "__k").alias(key)

    def changed(f: str) -> Column:
        differs = ~F.col(f).eqNullSafe(F.col(f"__{f}"))
        return differs & F.col(f).isNotNull() if fill_ok else differs

    fields_ = F.filter(F.array(*[F.when(changed(f), f) for f in fields]), lambda f: f.isNotNull())
    rows = F.when(F.col("__new").isNull(), F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit("removed").alias("change"))))
    rows = rows.when(F.col("__old").isNull(), F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit("new").alias("change"))))
    rows = rows.otherwise(F.transform(fields_, lambda f: F.struct(f.alias("field"), F.lit("changed").alias("change"))))
    return both.select(id_, F.explode(rows).alias("x")).select(key, "x.*")


def shared_identities(accepted: DataFrame, new: DataFrame, day: str, a: str, b: str) -> DataFrame:
    """Identities (day and unordered pair) of new rows that are accepted already; must be empty."""
    pick = lambda df: df.select(F.col(day).alias("day"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    return pick(accepted).intersect(pick(new))


def cash_debits(fills: DataFrame, activity: DataFrame, orders: DataFrame, slack: str = "0.005") -> DataFrame:
    """status and, where it is confirmed, shares, gross and debit of each order, from fills that match exactly one activity each.

    Fills (order_id, token, tx, shares, price) meet activity (tx, asset, type, side, size, price,
    cash, at) of the same transaction and token; sums are exact decimals and must agree with the
    order's rounded figures within half a cent. The first reason in the listed order stands.
    """
    d = lambda c: F.col(c).cast("decimal(20,6)")
    act = activity.where("type = 'TRADE' and side = 'BUY'").select(F.lower("tx").alias("tx"), F.col("asset").alias("token"), d("size").alias("size"), d("price").alias("aprice"), d("cash").alias("cash"), "stamp")
    act = act.groupBy("tx", "token").agg(F.count(F.lit(1)).alias("n_activity"), *[F.first(c).alias(c) for c in ("size", "aprice", "cash", "stamp")])
    own = fills.select("order_id", "token", F.lower("tx").alias("tx"), d("shares").alias("shares"), d("price").alias("price"))
    shared = own.groupBy("order_id", "tx").agg(F.count(F.lit(1)).alias("n_tx"))
    x = own.join(shared, ["order_id", "tx"]).join(act, ["tx", "token"], "left").withColumn("gross", (F.col("shares") * F.col("price")).cast("decimal(28,12)"))
    reasons = {
        "shared_transaction": F.col("tx").isNull() | (F.length("tx") == 0) | (F.col("n_tx") > 1),
        "invalid_fill": ~F.coalesce((F.col("shares") > 0) & (F.col("price") > 0) & (F.col("price") < 1), F.lit(False)),
        "missing_or_duplicate_activity": F.coalesce(F.col("n_activity"), F.lit(0)) != 1,
        "activity_mismatch": ~F.coalesce((F.col("size") == F.col("shares")) & (F.col("aprice") == F.col("price")), F.lit(False)),
        "debit_below_gross": ~F.coalesce(F.col("cash") >= F.col("gross"), F.lit(False)),
        "no_timestamp": F.col("stamp").isNull() | (F.col("stamp") < 0),
    }
    rank = F.lit(None).cast("int")
    for i, cond in reversed(list(enumerate(reasons.values()))):
        rank = F.when(cond, i).otherwise(rank)
    per = x.withColumn("bad", rank).groupBy("order_id").agg(F.min("bad").alias("bad"), F.sum("shares").alias("shares"), F.sum("gross").alias("gross"), F.sum("cash").alias("debit"), F.count(F.lit(1)).alias("n_fills"))
    out = orders.select("order_id", d("filled").alias("filled"), d("amount").alias("amount")).join(per, "order_id", "left")
    far = lambda a, b: ~F.coalesce(F.abs(F.col(a) - F.col(b)) <= F.lit(slack).cast("decimal(20,6)"), F.lit(False))
    status = F.when(F.col("n_fills").isNull(), "no_fills").when(F.col("bad").isNotNull(), F.element_at(F.array(*[F.lit(r) for r in reasons]), F.col("bad") + 1))
    status = status.when(far("shares", "filled"), "quantity_mismatch").when(far("gross", "amount"), "gross_mismatch").otherwise("confirmed")
    ok = lambda c: F.when(F.col("status") == "confirmed", F.col(c)).cast("double").alias(c)
    return out.withColumn("status", status).select("order_id", "status", ok("shares"), ok("gross"), ok("debit"))


def matched_quotes(quotes: DataFrame, saved: DataFrame) -> DataFrame:
    """Each current quote with its saved prediction of the same day and names in either order: exactly one, with equal ids after turning.

    Quotes have quote_id, day, a_name, b_name, a_ref, b_ref; saved rows day, a_name, b_name, a_ref, b_ref, prob_a.
    """
    s = saved.select(F.col("day"), F.least("a_name", "b_name").alias("lo"), F.greatest("a_name", "b_name").alias("hi"), F.struct("a_name", F.col("a_ref").alias("sa"), F.col("b_ref").alias("sb"), "prob_a").alias("s"))
    one = s.groupBy("day", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("s"))
    q = quotes.withColumn("lo", F.least("a_name", "b_name")).withColumn("hi", F.greatest("a_name", "b_name"))
    out = q.join(one, ["day", "lo", "hi"], "left").withColumn("turned", F.col("a_name") != F.col("s.a_name"))
    sa, sb = F.when(F.col("turned"), F.col("s.sb")).otherwise(F.col("s.sa")), F.when(F.col("turned"), F.col("s.sa")).otherwise(F.col("s.sb"))
    clash = F.coalesce((F.col("a_ref") != sa) | (F.col("a_ref").isNotNull() & sa.isNull()), F.lit(False)) | F.coalesce((F.col("b_ref") != sb) | (F.col("b_ref").isNotNull() & sb.isNull()), F.lit(False))
    status = F.when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "ambiguous").when(clash, "id_conflict").otherwise("matched")
    p = F.when(F.col("turned"), 1 - F.col("s.prob_a")).otherwise(F.col("s.prob_a"))
    return out.withColumn("status", status).select("quote_id", "status", *[F.when(F.col("status") == "matched", x).alias(n) for n, x in (("turned", F.col("turned")), ("prob_a", p))])


def card_changes(old: DataFrame, new: DataFrame, complete: bool = True) -> DataFrame:
    """Changes between two scans of a card: reversal, reschedule, replacement, addition, removal.

    Rows have key, event, day, a_id, b_id; the pair is unordered. Equal keys are compared first; then
    a pair that stands once among the rest of either side is a reschedule; then a removed and an
    added bout of one event that share exactly one participant, and are each other's only such
    partner, are a replacement. An incomplete scan removes nothing.
    """
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}{c}") for c in ("key", "event", "day", "a_id", "b_id")], F.concat_ws("|", F.least("a_id", "b_id"), F.greatest("a_id", "b_id")).alias(f"{s}pair"))
    both = side(old, "o_").join(side(new, "n_"), F.col("o_key") == F.col("n_key"), "full")
    # only what differs is looked at again: it is written once, as every kind of change reads it
    differs = "o_key is null or n_key is null or (o_a_id = n_b_id and o_b_id = n_a_id) or not (o_day <=> n_day)"
    both = written(both.where(differs), "card-differences")
    same = both.where("o_key is not null and n_key is not null")
    turned = same.where("o_a_id = n_b_id and o_b_id = n_a_id").select(F.col("o_key").alias("old_key"), F.col("n_key").alias("new_key"), F.lit("reversed").alias("change"))
    moved = same.where("not (o_day <=> n_day)").select(F.col("o_key").alias("old_key"), F.col("n_key").alias("new_key"), F.lit("rescheduled").alias("change"))
    gone, come = both.where("n_key is null").select("o_key", "o_event", "o_a_id", "o_b_id", "o_pair"), both.where("o_key is null").select("n_key", "n_event", "n_a_id", "n_b_id", "n_pair")
    lone = lambda df, p, k: df.groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.first(k).alias(k)).where("n = 1").drop("n")
    pairs = lone(gone, "o_pair", "o_key").join(lone(come, "n_pair", "n_key"), F.col("o_pair") == F.col("n_pair"))
    again = pairs.select(F.col("o_key").alias("old_key"), F.col("n_key").alias("new_key"), F.lit("rescheduled").alias("change"))
    gone, come = gone.join(again, F.col("o_key") == F.col("old_key"), "left_anti"), come.join(again, F.col("n_key") == F.col("new_key"), "left_anti")
    who = lambda df, s: df.select(f"{s}key", f"{s}event", F.explode(F.array_distinct(F.array(f"{s}a_id", f"{s}b_id"))).alias("who")).where("who is not null")
    met = who(gone, "o_").join(who(come, "n_").withColumnRenamed("n_event", "o_event"), ["o_event", "who"]).groupBy("o_key", "n_key").count().where("count = 1")
    only = lambda k: F.count(F.lit(1)).over(Window.partitionBy(k))
    met = met.withColumn("ox", only("o_key")).withColumn("nx", only("n_key")).where("ox = 1 and nx = 1")
    swapped = met.select(F.col("o_key").alias("old_key"), F.col("n_key").alias("new_key"), F.lit("replaced").alias("change"))
    none = F.lit(None).cast(dict(old.dtypes)["key"])
    added = come.join(swapped, F.col("n_key") == F.col("new_key"), "left_anti").select(none.alias("old_key"), F.col("n_key").alias("new_key"), F.lit("added").alias("change"))
    out = turned.unionByName(moved).unionByName(again).unionByName(swapped).unionByName(added)
    if complete:
        out = out.unionByName(gone.join(swapped, F.col("o_key") == F.col("old_key"), "left_anti").select(F.col("o_key").alias("old_key"), none.alias("new_key"), F.lit("removed").alias("change")))
    return out


def short_notice(old: DataFrame, new: DataFrame, days: int = 14) -> DataFrame:
    """event, stayed, left, replacement: a participant who stays on an event's card within ``days`` of it while the former partner leaves it.

    Rows have event, days_to_event, a_id, b_id.
    """
    long = lambda df, *c: df.select("event", *c, F.explode(F.array(F.struct(F.col("a_id").alias("me"), F.col("b_id").alias("you")), F.struct(F.col("b_id").alias("me"), F.col("a_id").alias("you")))).alias("x")).select("event", *c, "x.*")
    was, now = long(old), long(new, "days_to_event").where(F.col("days_to_event").between(0, days))
    met = was.withColumnRenamed("you", "left").join(now.withColumnRenamed("you", "replacement"), ["event", "me"]).where(F.col("left") != F.col("replacement"))
    gone = met.join(long(new).select("event", F.col("me").alias("left")).distinct(), ["event", "left"], "left_anti")
    fresh = gone.join(was.select("event", F.col("me").alias("replacement")).distinct(), ["event", "replacement"], "left_anti")
    return fresh.select("event", F.col("me").alias("stayed"), "left", "replacement", "days_to_event").distinct()


def earliest_evidence(history: DataFrame, keys: list[str], captured: str, outcome: str) -> DataFrame:
    """The first captured row of each key, and ``conflict`` where its rows tell different outcomes."""
    w = Window.partitionBy(*keys)
    first = w.orderBy(F.asc_nulls_last(captured), "row_id")
    out = history.withColumn("conflict", F.size(F.collect_set(outcome).over(w)) > 1).withColumn("__n", F.row_number().over(first))
    return out.where("__n = 1").drop("__n")


def richest(archive: DataFrame, key: str, saved: str, level: str, fields: list[str]) -> DataFrame:
    """Of each key's versions the newest, then the highest level, then the one with most known fields, then the last row."""
    known = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    best = F.struct(saved, level, known.alias("known"), "row_id")
    return archive.groupBy(key).agg(F.max_by(F.struct(*[c for c in archive.columns if c != key]), best).alias("x")).select(key, "x.*")


def token_sides(markets: DataFrame) -> DataFrame:
    """token, side, name, opponent, market_id: both tokens of each market; a token with different entries is left out altogether."""
    side = lambda s, t, me, you: F.struct(F.col(t).alias("token"), F.lit(s).alias("side"), F.col(me).alias("name"), F.col(you).alias("opponent"), "market_id")
    rows = markets.select(F.explode(F.array(side("a", "token_a", "a_name", "b_name"), side("b", "token_b", "b_name", "a_name"))).alias("x")).select("x.*")
    rows = rows.where("token is not null and token <> ''").distinct()
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("__n = 1").drop("__n")


def winner_markets(payloads: DataFrame, column: str) -> DataFrame:
    """Winner markets of JSON payloads: two outcomes that are no Yes/No/Over/Under, both prices in [0, 1]; lists may stand as text in the JSON."""
    text = lambda f: F.get_json_object(column, f"$.{f}")
    items = lambda f: F.from_json(text(f), "array<string>")
    name = lambda i: F.trim(F.get(items("outcomes"), i))
    price = lambda i: F.get(items("outcomePrices"), i).try_cast("double")
    out = payloads.select("*", text("id").alias("market_id"), name(0).alias("a_name"), name(1).alias("b_name"), F.get(items("clobTokenIds"), 0).alias("token_a"), F.get(items("clobTokenIds"), 1).alias("token_b"), price(0).alias("price_a"), price(1).alias("price_b"), F.size(items("outcomes")).alias("__n"))
    prop = ("Yes", "No", "Over", "Under")
    ok = (F.col("__n") == 2) & ~F.col("a_name").isin(*prop) & ~F.col("b_name").isin(*prop) & (F.length("a_name") > 0) & (F.length("b_name") > 0) & F.col("price_a").between(0, 1) & F.col("price_b").between(0, 1)
    return out.where(ok).drop("__n", column)
