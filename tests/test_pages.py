"""Saved pages: one id on both sides of a bout, whole cards judged in one pass."""

import duckdb
import pytest
from pyspark.sql import functions as F

from boutwright.plans import q_pages
from boutwright.sources import pages as P
from tests.compare import same
from tests.conftest import DATA

#: An order whose key is its customer's plus 500,000: its page links one profile for two people.
ROWS = "SELECT CAST(k AS BIGINT) o_orderkey, CAST(c AS BIGINT) o_custkey, TIMESTAMP '1996-03-05' o_orderdate FROM (VALUES (552154, 52154), (553795, 53795), (7, 3), (500022, 22), (500010, 10)) t(k, c)"


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    d = tmp_path_factory.mktemp("orders")
    con = duckdb.connect()
    con.execute(f"COPY ({ROWS}) TO '{d}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{d}/orders.parquet')")
    return str(d), con


@pytest.mark.parametrize("name", ["reviewed_cards", "card_pages", "bout_pages"])
def test_one_profile_under_two_names(spark, shared, name):
    d, con = shared
    assert same(spark, con, q_pages.QUERIES[name], q_pages.SQL[name], d) == ""


ROW = '<tr class="b-fight-details__table-row"><td></td><td>{0}{1}</td><td>Flyweight</td></tr>'
WHO = '<a href="http://s.example/fighter-details/{0}">{1}</a>'
HEAD = '<h2 class="b-content__title"><span>T</span></h2><li class="b-list__box-list-item">Date: May 01, 2020</li>'


def test_one_profile_is_one_person_unless_asked(spark):
    a, b = "0" * 16, "1" * 16
    page = lambda x, y: HEAD + "<table>" + ROW.format(WHO.format(*x), WHO.format(*y)) + "</table>"
    rows = [(1, page((a, "Ann"), (b, "Bo"))), (2, page((a, "Ann"), (a, "Bo"))), (3, page((a, "Ann"), (a, "Ann"))), (4, HEAD), (5, page((a, "Ann"), (b, "")))]
    df = spark.createDataFrame(rows, "page int, html string").selectExpr("*", "'T' title", "DATE'2020-05-01' day")
    faults = lambda **k: {r["page"]: r["fault"] for r in P.reviewed_card(df, "page", "html", "title", "day", **k).collect()}
    assert faults() == {1: None, 2: "repeated_pair", 3: "repeated_pair", 4: "empty", 5: "incomplete_pair"}
    assert faults(shared_ids=True) == {1: None, 2: None, 3: "repeated_pair", 4: "empty", 5: "incomplete_pair"}
    kept = lambda **k: {r["page"] for r in P.card(df, "page", "html", **k).collect()}
    assert kept() == {1} and kept(shared_ids=True) == {1, 2}


def test_cards_are_read_once_without_joins(spark, shared):
    plan = q_pages.QUERIES["reviewed_cards"](spark, shared[0])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_a_bout_page_is_searched_once_for_each_kind_and_pages_are_dealt(spark):
    df = q_pages.QUERIES["bout_pages"](spark, f"{DATA}/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for mark in ("person-name", "person-status", "details__text", "<tbody", "<tr"):
        assert plan.count(rf"{mark}[^>]*>(.*?)" if "<" not in mark else rf"{mark}\b[^>]*>(.*?)") == 1, mark
    for name in ("bout_pages", "card_pages", "reviewed_cards", "profile_pages"):
        assert "RoundRobinPartitioning(8)" in q_pages.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_plain_text_is_squeezed_and_decoded(spark):
    rows = ["a", " a  b\n", "<b>a</b>&amp;lt;", "&lt;b&gt;", "a&nbsp;&quot;x&#39;", "", None, "<i></i>", "1 < 2 & 3"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").repartition(1).sortWithinPartitions("i").select(P.plain(F.col("x"))).collect()]
    assert got == ["a", "a b", "a &lt;", "<b>", "a \"x'", "", None, "", "1 < 2 & 3"]


def test_rankings_keep_positions_of_named_rows(spark):
    cell = lambda n: f'<td class="views-field-title"><a>{n}</a></td>'
    html = '<div class="view-grouping"><h4>Fly</h4>' + cell("A") + cell("...") + cell("B") + cell("A") + '</div><div class="view-grouping"><h4></h4>' + cell("C") + '</div><div class="view-grouping"><h4>Open</h4></div>'
    df = spark.createDataFrame([(1, html), (2, "no list")], "page int, html string")
    assert {tuple(r) for r in P.rankings(df, "page", "html").collect()} == {(1, "fly", "a", 3), (1, "fly", "b", 2)}
