"""Event lists, cards, bout pages, profiles and rankings from saved pages, with built-in text functions.

The markup is that of the statistics site (class names are fixed values). A page that does not
confirm what it must gives null, or a row with its ``fault``; nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.identity import stable_id
from ..functions.names import _let, normalise


def cut(html: Column, tag: str, mark: str = "") -> Column:
    """Inner markup of every ``tag`` whose start tag holds ``mark``, in page order; tags of the same name must not nest."""
    return F.regexp_extract_all(html, F.lit(_cut(tag, mark)), F.lit(1))


def _cut(tag: str, mark: str = "") -> str:
    return rf"(?is)<{tag}\b[^>]*{mark + '[^>]*' if mark else ''}>(.*?)</{tag}\s*>"


def plain(html: Column) -> Column:
    """Text of a piece of markup: tags out, the common references decoded, white space squeezed."""

    def decoded(t: Column) -> Column:
        out = t
        for ref, ch in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            out = F.replace(out, F.lit(ref), F.lit(ch))
        return F.when(F.contains(t, F.lit("&")), out).otherwise(t)

    # most pieces are a word or two, without markup
    text = _let(html, lambda x: F.when(F.contains(x, F.lit("<")), F.regexp_replace(x, r"(?s)<[^>]*>", " ")).otherwise(x))
    return F.trim(F.regexp_replace(_let(text, decoded), r"\s+", " "))


def links(html: Column, part: str) -> Column:
    """(url, text) of every link whose address holds ``part``."""
    pattern = rf'(?is)<a\b[^>]*href="([^"]*{part}[^"]*)"[^>]*>(.*?)</a\s*>'
    urls, texts = (F.regexp_extract_all(html, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(urls.alias("u"), texts.alias("t")), lambda x: F.struct(x["u"].alias("url"), plain(x["t"]).alias("text")))


def one_person(shared_ids: bool) -> Column:
    """Whether both sides are one: by their ids, or with ``shared_ids`` by their ids and names."""
    same = F.col("a_ref") == F.col("b_ref")
    return same & (F.col("a_name") == F.col("b_name")) if shared_ids else same


def page_date(s: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(s, F.lit("MMMM dd, yyyy")), F.try_to_timestamp(s, F.lit("MMM dd, yyyy"))).cast("date")


def events(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, url, title, event_date of every dated event row with a title; an address stands once a page."""
    rows = pages.select(key, F.posexplode(cut(F.col(html), "tr", "b-statistics__table-row")).alias("at", "row"))
    link = F.get(links(F.col("row"), "event-details/"), 0)
    date = page_date(plain(F.get(cut(F.col("row"), "span", "b-statistics__date"), 0)))
    out = rows.select(key, "at", link["url"].alias("url"), link["text"].alias("title"), date.alias("event_date"))
    out = out.where("url is not null and title <> '' and event_date is not null")
    return out.groupBy(key, "url").agg(F.min_by("title", "at").alias("title"), F.min_by("event_date", "at").alias("event_date"))


#: What the first cell of a finished bout's row says.
DONE = ("win", "loss", "w", "l", "w l", "l w", "draw", "d", "d d", "draw draw", "nc", "nc nc", "no contest", "no contest no contest")
#: Words that end in "weight" and name a class.
CLASSES = ("straw", "fly", "bantam", "feather", "light", "welter", "middle", "light heavy", "heavy", "super heavy", "catch", "open")


def _card_rows(pages: DataFrame, key: str, html: str, *keep: Column) -> DataFrame:
    """Every row of a card that has cells: position, whether it is finished, who is linked, and what else it says; a card without any has one row without a position."""
    # found first: beside the explosion they would be worked out for every row, and an inner one would find the rows three times
    found = pages.select(key, *keep, F.filter(cut(F.col(html), "tr", "b-fight-details__table-row"), lambda r: F.contains(r, F.lit("<td"))).alias("__rows"))
    rows = found.select(*[c for c in found.columns if c != "__rows"], F.posexplode_outer("__rows").alias("position", "row"))
    cells = F.transform(cut(F.col("row"), "td"), plain)
    text = F.lower(plain(F.col("row")))
    title = F.col("row").rlike(r"(?i)<img[^>]*belt") | text.rlike("title bout|championship|interim")
    named = F.regexp_extract(F.array_join(cells, "\n"), rf"(?im)\b((?:women's )?(?:{'|'.join(sorted(CLASSES, key=len, reverse=True))}) ?weight)\b", 1)
    out = rows.select(*[c for c in rows.columns if c != "row"], links(F.col("row"), "fighter-details/").alias("who"), F.coalesce(F.lower(F.get(cells, 0)).isin(*DONE), F.lit(False)).alias("done"), title.alias("title_bout"), F.when(named != "", named).alias("weight_class"))
    side = {f"{s}_{n}": x for i, s in enumerate("ab") for n, x in (("ref", stable_id(F.get("who", i)["url"])), ("name", F.get("who", i)["text"]))}
    return out.withColumns(side).withColumn("num_rounds", F.when(F.col("title_bout") | (F.col("position") == 0), 5).otherwise(3))


CARD = ["position", "a_ref", "a_name", "b_ref", "b_name", "title_bout", "num_rounds"]


def card(pages: DataFrame, key: str, html: str, shared_ids: bool = False) -> DataFrame:
    """key, position, ids and names of both sides, title bout, rounds of every bout of a card that has no result yet and names two sides; what cannot be read is left out (``reviewed_card`` says what)."""
    rows = _card_rows(pages, key, html).where("position is not null")
    # an array of one row keeps the filter from working all columns out again
    read = rows.select(key, F.inline(F.array(F.struct(*CARD, "done", F.size("who").alias("sides")))))
    ok = read.where(~F.col("done") & (F.col("sides") == 2) & ~one_person(shared_ids)).where("a_ref is not null and b_ref is not null and a_name <> '' and b_name <> ''")
    return ok.select(key, *CARD)


def reviewed_card(pages: DataFrame, key: str, html: str, title: str, date: str, shared_ids: bool = False) -> DataFrame:
    """key, fault and the columns of ``card`` with weight_class and main_event: each bout to come of a card that is accepted, or one row with the fault of a card that is not.

    A card must show the ``title`` and, once, the ``date`` of its event. Faults, the first that holds:
    title, date, incomplete_pair (a row to come without two named sides), repeated_pair (two sides
    that are one, or a pair that stands twice), no_class, empty (no bouts at all). No part of a
    refused card is taken. ``key`` names one page; its rows are read once and meet in one shuffle.
    """
    h = F.col(html)
    shown = plain(F.get(cut(F.get(cut(h, "h2", "b-content__title"), 0), "span"), 0))
    facts = F.filter(F.transform(cut(h, "li", "b-list__box-list-item"), plain), lambda t: t.startswith("Date:"))
    day = F.get(F.transform(facts, lambda t: page_date(F.trim(F.substring(t, 6, 100)))), 0)
    day_ok = F.coalesce(F.size(facts) == 1, F.lit(False)) & F.coalesce(day == F.col(date), F.lit(False))
    rows = _card_rows(pages, key, html, F.coalesce(shown == F.col(title), F.lit(False)).alias("title_ok"), day_ok.alias("date_ok"))
    to_come = F.col("position").isNotNull() & ~F.col("done")
    named = (F.size("who") == 2) & F.col("a_ref").isNotNull() & F.col("b_ref").isNotNull() & (F.coalesce("a_name", F.lit("")) != "") & (F.coalesce("b_name", F.lit("")) != "")
    pair = F.when(to_come, F.array_sort(F.array("a_ref", "b_ref")).cast("string"))
    held = lambda c: F.coalesce(F.max(F.when(to_come, c)), F.lit(False))
    bout = F.struct(*CARD, "weight_class", (F.col("position") == 0).alias("main_event"))
    seen = rows.groupBy(key).agg(
        F.every("title_ok").alias("title_ok"), F.every("date_ok").alias("date_ok"), held(~named).alias("incomplete"), (held(one_person(shared_ids)) | (F.count(pair) > F.size(F.collect_set(pair)))).alias("repeated"),
        held(F.col("weight_class").isNull()).alias("no_class"), (F.count("position") > 0).alias("any"), F.collect_list(F.when(to_come, bout)).alias("bouts"),
    )
    fault = F.when(~F.col("title_ok"), "title").when(~F.col("date_ok"), "date").when(F.col("incomplete"), "incomplete_pair").when(F.col("repeated"), "repeated_pair").when(F.col("no_class"), "no_class").when(~F.col("any"), "empty")
    judged = seen.select(key, fault.alias("fault"), "bouts")
    return judged.select(key, "fault", F.inline_outer(F.when(F.col("fault").isNull(), F.col("bouts")))).where("fault is not null or position is not null")


#: Labels of a profile and the fields they fill.
PROFILE = {"Height": "height", "Weight": "weight", "Reach": "reach", "STANCE": "stance", "DOB": "dob", "SLpM": "slpm", "Str. Acc.": "str_acc", "SApM": "sapm", "Str. Def": "str_def", "TD Avg.": "td_avg", "TD Acc.": "td_acc", "TD Def.": "td_def", "Sub. Avg.": "sub_avg"}


def profile(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, name, record and the profile's fields as text; unpublished ones are empty. A page without a name has no row."""
    h = F.col(html)
    items = F.transform(cut(h, "li", "b-list__box-list-item"), plain)
    pairs = F.transform(F.filter(items, lambda t: F.contains(t, F.lit(":"))), lambda t: F.struct(F.trim(F.substring_index(t, ":", 1)).alias("k"), F.replace(F.trim(F.regexp_replace(t, r"^[^:]*:", "")), F.lit("%"), F.lit("")).alias("v")))
    field = lambda label: F.coalesce(F.get(F.reverse(F.filter(F.col("__p"), lambda p: p["k"] == label)), 0)["v"], F.lit(""))  # the last one counts
    name = plain(F.get(cut(F.get(cut(h, "h2", "b-content__title"), 0), "span"), 0))
    record = F.trim(F.replace(plain(F.get(cut(h, "span", "b-content__title-record"), 0)), F.lit("Record:"), F.lit("")))
    out = pages.select(key, name.alias("name"), F.coalesce(record, F.lit("")).alias("record"), pairs.alias("__p")).where("name is not null and name <> ''")
    return out.select(key, "name", "record", *[field(k).alias(v) for k, v in PROFILE.items()])


#: Columns of the totals table and of the breakdown by target and position.
COUNTS, PAIRS, BREAKDOWN = {1: "kd", 7: "sub_att", 8: "rev"}, {2: "sig_str", 4: "total_str", 5: "td"}, {3: "head", 4: "body", 5: "leg", 6: "distance", 7: "clinch", 8: "ground"}


def bout(pages: DataFrame, key: str, html: str, shared_ids: bool = False) -> DataFrame:
    """key, sides, result, method, round, time and statistics of a bout's page, and ``fault``: why it cannot be accepted, if so."""
    h = F.col(html)
    # three steps, each of which uses what the one before found more than once: in one, the page would be searched again for every use
    found = pages.select(
        key, cut(h, "h3", "b-fight-details__person-name").alias("persons"), cut(h, "i", "b-fight-details__person-status").alias("status"), cut(h, "p", "b-fight-details__text").alias("facts"),
        F.transform(cut(h, "tbody"), lambda b: cut(F.regexp_extract(b, _cut("tr"), 1), "td")).alias("bodies"),
    )
    who = lambda i: F.get(links(F.get("persons", i), "fighter-details/"), 0)
    outcome = F.array_join(F.transform(F.slice("status", 1, 2), lambda s: F.upper(plain(s))), "/")
    found = found.select(key, who(0).alias("a"), who(1).alias("b"), outcome.alias("outcome"), F.transform("facts", plain).alias("facts"), "bodies")
    fact = lambda label: F.get(F.transform(F.filter("facts", lambda t: F.lower(t).startswith(label + ":")), lambda t: F.trim(F.regexp_replace(t, r"^[^:]*:", ""))), 0)
    cells = lambda rule: F.transform(F.get(F.filter("bodies", rule), 0), lambda c: F.transform(cut(c, "p"), plain))
    out = found.select(
        key, F.col("a.text").alias("a_name"), F.col("b.text").alias("b_name"), stable_id(F.col("a.url")).alias("a_ref"), stable_id(F.col("b.url")).alias("b_ref"),
        "outcome", fact("method").alias("method"), fact("round").alias("round"), fact("time").alias("time"),
        cells(lambda c: F.size(c) >= 10).alias("__t"), cells(lambda c: F.size(c) == 9).alias("__b"),
    )
    value = lambda t, col, i: F.get(F.get(F.col(t), col), i)
    # pairs are read in one array: a column each would make one method too long for Java to compile
    pairs = [(t, c, i) for i in (0, 1) for t, table in (("__t", PAIRS), ("__b", BREAKDOWN)) for c in table]
    read = F.transform(F.array(*[value(*x) for x in pairs]), lambda v: F.struct(S.landed(v).alias("landed"), S.attempted(v).alias("attempted")))
    out = out.withColumns({"result": S.official_result(F.col("outcome"), F.col("method")), "__pairs": read})
    cols: dict[str, Column] = {}
    for i, s in enumerate("ab"):
        cols |= {f"{s}_{n}": value("__t", c, i).try_cast("double") for c, n in COUNTS.items()} | {f"{s}_ctrl_seconds": S.clock_seconds(value("__t", 9, i))}
        for t, table in (("__t", PAIRS), ("__b", BREAKDOWN)):
            cols |= {f"{s}_{n}_{x}": F.get("__pairs", pairs.index((t, c, i)))[x] for x in ("landed", "attempted") for c, n in table.items()}
    out = out.withColumns(cols)
    pairs_ok = F.forall("__pairs", lambda x: F.coalesce(x["landed"] <= x["attempted"], F.lit(False)))
    fault = (
        F.when(F.col("a_ref").isNull() | F.col("b_ref").isNull() | one_person(shared_ids), "participants").when(F.col("result.quarantined"), "result").when(F.col("__t").isNull(), "no_totals").when(F.col("__b").isNull(), "no_breakdown")
        .when(~pairs_ok, "statistics").when(F.coalesce(F.length("method"), F.lit(0)) == 0, "method").when(~F.coalesce(F.col("round").rlike("^[1-5]$") & F.col("time").rlike(r"^[0-5]:[0-5]\d$"), F.lit(False)), "chronology")
    )
    winner = F.when(F.col("result.winner_side") == "a", F.col("a_name")).when(F.col("result.winner_side") == "b", F.col("b_name"))
    return out.withColumn("fault", fault).withColumn("winner", winner).withColumn("result_class", F.col("result.kind")).drop("__t", "__b", "__pairs", "result")


def rankings(pages: DataFrame, key: str, html: str, most: int = 15) -> DataFrame:
    """key, division, name, rank: the first ``most`` names of each division of a rankings page, names normalised."""
    parts = F.split(F.col(html), r'(?i)<div\b[^>]*\bview-grouping"[^>]*>')
    groups = F.filter(parts, lambda _, i: i > 0)
    rows = pages.select(key, F.explode_outer(groups).alias("g"))
    division = normalise(plain(F.get(cut(F.col("g"), "h4"), 0)))
    names = F.filter(F.transform(links_in_titles(F.col("g")), normalise), lambda n: F.length(n) > 0)
    # read first: beside the explosion the division would be worked out for every name, and an inner one would read the names three times
    read = rows.select(key, division.alias("division"), F.slice(names, 1, most).alias("__names")).where("division <> ''")
    out = read.select(key, "division", F.posexplode_outer("__names").alias("at", "name")).where("name is not null")
    return out.groupBy(key, "division", "name").agg((F.max("at") + 1).alias("rank"))


def links_in_titles(html: Column) -> Column:
    """Text of the links in title cells."""
    cells = cut(html, "td", "views-field-title")
    return F.filter(F.transform(cells, lambda c: plain(F.get(cut(c, "a"), 0))), lambda t: t.isNotNull())
