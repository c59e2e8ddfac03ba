"""Nested payloads and pages to rows: odds JSON, selection trees, HTML figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ODDS = "array<struct<id:string,commence_time:string,home_team:string,away_team:string,bookmakers:array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double>>>>>>>>"


def odds_rows(df: DataFrame, payload: str) -> DataFrame:
    """Event x bookmaker rows of head-to-head markets; the side whose name sorts first is a."""
    ev = df.select(F.explode(F.from_json(payload, ODDS)).alias("e")).select("e.*")
    bk = ev.select("id", "commence_time", F.explode("bookmakers").alias("bk")).select("id", "commence_time", F.col("bk.key").alias("bookmaker"), F.explode("bk.markets").alias("m")).where("m.key = 'h2h'")
    sides = F.array_sort(F.transform("m.outcomes", lambda o: F.struct(F.lower(o["name"]).alias("k"), o["name"].alias("name"), o["price"].alias("price"))))
    out = bk.withColumn("s", sides).where(F.size("s") == 2)
    a, b = F.col("s")[0], F.col("s")[1]
    return out.select("id", "commence_time", "bookmaker", a["name"].alias("a_name"), b["name"].alias("b_name"), a["price"].alias("a_odds"), b["price"].alias("b_odds"), (1 / a["price"] / (1 / a["price"] + 1 / b["price"])).alias("a_fair"))


MARKET = "struct<id:string,home_od:string,away_od:string,over_od:string,under_od:string,draw_od:string,handicap:string,ss:string,add_time:string>"
BOOKS = f"map<string,struct<matching_dir:string,odds_update:map<string,string>,odds:map<string,map<string,{MARKET}>>>>"
PRICES = {"home_odds": "home_od", "away_odds": "away_od", "over_odds": "over_od", "under_odds": "under_od", "draw_odds": "draw_od"}


def seconds(s) -> F.Column:
    """A time given as epoch seconds in text; null where it is none."""
    return F.timestamp_seconds(s.try_cast("bigint"))


def summary_rows(df: DataFrame, payload: str, key: str) -> DataFrame:
    """Bookmaker, phase and market maps of ``results`` to rows with all prices; a market without any price has no row."""
    books = df.select(key, F.explode(F.from_json(F.get_json_object(payload, "$.results"), BOOKS)).alias("bookmaker", "x"))
    last = F.array_max(F.transform(F.map_values("x.odds_update"), seconds))
    phases = books.select(key, "bookmaker", F.col("x.matching_dir").try_cast("int").alias("matching_dir"), last.alias("updated_at"), F.explode("x.odds").alias("market_phase", "y"))
    rows = phases.select(key, "bookmaker", "matching_dir", "updated_at", "market_phase", F.explode("y").alias("market_key", "o"))
    prices = {n: F.col(f"o.{c}").try_cast("double") for n, c in PRICES.items()}
    out = rows.select(key, "bookmaker", "matching_dir", "market_phase", "market_key", F.col("o.id").alias("line_id"), *[v.alias(n) for n, v in prices.items()], F.col("o.handicap").alias("handicap"), F.col("o.ss").alias("score_state"), seconds(F.col("o.add_time")).alias("added_at"), "updated_at")
    return out.where(F.coalesce(*PRICES).isNotNull())


EVENT = "array<struct<id:string,our_event_id:string,sport_id:string,league:struct<name:string>,home:struct<name:string>,away:struct<name:string>,time:string,time_status:string,odds_updated_at:string,updated_at:string>>"


def event_rows(df: DataFrame, payload: str, source: str) -> DataFrame:
    """Events of ``results`` as flat rows with their fight key (empty where a name or the time is missing)."""
    from ..functions.identity import fight_key

    e = df.drop(payload).columns
    rows = df.select(*e, F.explode(F.from_json(F.get_json_object(payload, "$.results"), EVENT)).alias("e"))
    out = rows.select(*e, F.lit(source).alias("source"), F.col("e.id").alias("event_id"), F.col("e.our_event_id").alias("our_event_id"), F.col("e.league.name").alias("league"), F.col("e.home.name").alias("a_name"), F.col("e.away.name").alias("b_name"), seconds(F.col("e.time")).alias("starts_at"), F.col("e.time_status").alias("time_status"), seconds(F.col("e.odds_updated_at")).alias("odds_updated_at"))
    return out.withColumn("fight_key", fight_key(F.col("a_name"), F.col("b_name"), F.col("starts_at").cast("date")))


def raw_files(spark, folder: str) -> DataFrame:
    """Every JSON file of a folder: its path, time, payload and metadata; a file may be an envelope {payload, metadata} or the payload itself."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified_at"), "value")
    inner = F.get_json_object("value", "$.payload")
    return files.select("file", "modified_at", F.coalesce(inner, "value").alias("payload"), F.when(inner.isNotNull(), F.get_json_object("value", "$.metadata")).alias("metadata"))


def _number(x) -> float | None:
    try:
        return None if x is None or x == "" else float(x)
    except (TypeError, ValueError):
        return None


def _priced(x) -> bool:
    """Whether a node is a selection: its odds are no container, and it has a header, a handicap, or an id, a name and a price."""
    if not isinstance(x, dict) or isinstance(x.get("odds"), (list, dict)):
        return False
    return "header" in x or "handicap" in x or "id" in x and "name" in x and _number(x.get("odds")) is not None


@F.udtf(returnType="fi string, event_id string, market_group string, market_name string, selection_id string, selection_name string, header string, handicap string, decimal_odds double")
class Selections:
    """Selections of a prematch payload, with their group and market path.

    ``results`` is the payload's tree or a list that starts with it. Its groups are main and schedule
    (one block each) and others (one block or a list of them); the markets of a block stand under
    ``sp``. A market is a selection, a list, or a tree of markets; where ``odds`` is a list, its
    selections belong to the market that has it.
    """

    def eval(self, payload: str):
        import json

        root = json.loads(payload) if payload else {}
        root = root.get("results") if isinstance(root, dict) else None
        root = root[0] if isinstance(root, list) and root else root
        if not isinstance(root, dict):
            return
        others = root.get("others")
        blocks = [(g, root.get(g)) for g in ("main", "schedule")] + [("others", x) for x in (others if isinstance(others, list) else [others])]
        for group, block in blocks:
            markets = block.get("sp") if isinstance(block, dict) else None
            todo = [(str(k), v) for k, v in reversed(markets.items())] if isinstance(markets, dict) else []
            while todo:
                path, x = todo.pop()
                if isinstance(x, dict) and isinstance(x.get("odds"), list):
                    x = x["odds"]
                if _priced(x):
                    text = {k: "" if x.get(k) is None else str(x[k]) for k in ("id", "name", "header", "handicap")}
                    yield str(root.get("FI", "")), str(root.get("event_id", "")), group, path, *text.values(), _number(x.get("odds"))
                elif isinstance(x, dict):
                    todo += [(f"{path}.{k}", y) for k, y in reversed(x.items())]
                elif isinstance(x, list):
                    todo += [(path, y) for y in reversed(x)]


def page_figures(df: DataFrame, html: str) -> DataFrame:
    """Title, language, links and paragraphs of pages, by patterns that stay in the JVM."""
    h = F.col(html)
    return df.select(
        "*",
        F.regexp_extract(h, r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(h, r'<html[^>]*\blang="([^"]*)"', 1).alias("page_lang"),
        F.size(F.regexp_extract_all(h, F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).alias("n_links"),
        F.size(F.regexp_extract_all(h, F.lit(r"<p[ >]"), 0)).alias("n_paragraphs"),
    )


@F.udtf(returnType="path string, name string, value string")
class SelectionTree:
    """Walks an irregular JSON tree and gives each leaf with its path."""

    def eval(self, payload: str):
        import json

        todo = [("", "", json.loads(payload))] if payload else []
        while todo:
            path, name, x = todo.pop()
            if isinstance(x, dict):
                todo += [(f"{path}/{k}", k, v) for k, v in sorted(x.items(), reverse=True)]
            elif isinstance(x, list):
                todo += [(f"{path}[{i}]", name, v) for i, v in reversed(list(enumerate(x)))]
            else:
                yield path, name, None if x is None else str(x)
