"""The semantic layer on small tables: grains, phantom rows, fences, statements, round trips."""

import pytest

from grainwise import errors
from grainwise.engine import Engine
from grainwise.plans import text
from grainwise.sources import ddl

SHOP = """CREATE OR REPLACE SEMANTIC VIEW shop AS
TABLES (o AS t_orders PRIMARY KEY (id), c AS t_customers PRIMARY KEY (id), i AS t_items, s AS t_shipments PRIMARY KEY (id))
RELATIONSHIPS (o_c AS o (customer_id) REFERENCES c, i_o AS i (order_id) REFERENCES o, s_o AS s (order_id) REFERENCES o)
FACTS (o.doubled AS o.amount * 2, PRIVATE o.secret AS o.amount, s.heavy AS s.weight > 1)
DIMENSIONS (c.region AS c.region, o.status AS o.status, i.sku AS i.sku, s.carrier AS s.carrier)
METRICS (c.balance AS SUM(c.balance), o.order_count AS COUNT(*), o.total AS SUM(doubled), i.item_qty AS SUM(i.qty), i.item_rows AS COUNT(*), s.shipped AS COUNT(*), PRIVATE o.hidden AS SUM(o.amount), mean_qty AS item_qty / order_count)"""


@pytest.fixture(scope="module")
def engine(spark):
    spark.createDataFrame([(7, "Nord", 11), (8, "Nord", 25), (9, "Sued", 64), (5, "Nord", 3)], "id int, region string, balance int").createOrReplaceTempView("t_customers")
    spark.createDataFrame([(71, 7, "new", 19), (72, 8, "done", 44), (73, 8, "new", 6), (74, 5, "new", 31), (75, 5, "done", 8)], "id int, customer_id int, status string, amount int").createOrReplaceTempView("t_orders")
    spark.createDataFrame([(71, "pin", 12), (72, "nut", 5), (72, "cog", 9), (73, "nut", 1), (75, "pin", 7)], "order_id int, sku string, qty int").createOrReplaceTempView("t_items")
    spark.createDataFrame([(1, 74, "boat", 2), (2, 72, "cart", 1)], "id int, order_id int, carrier string, weight int").createOrReplaceTempView("t_shipments")
    e = Engine(spark)
    e.sql(SHOP)
    return e


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, 0 if x is None else x) for x in r])


def test_each_metric_at_its_grain(engine):
    assert rows(engine.query("shop", [], ["balance"])) == [(103,)]
    assert rows(engine.query("shop", ["region"], ["balance"])) == [("Nord", 39), ("Sued", 64)]
    assert sorted(rows(engine.query("shop", ["region"], ["balance", "order_count"])), key=str) == [("Nord", 39, 5), ("Sued", 64, None)]
    assert rows(engine.query("shop", [], ["order_count", "item_qty"])) == [(5, 34)]
    assert rows(engine.query("shop", ["status"], ["order_count", "item_qty"])) == [("done", 2, 21), ("new", 3, 13)]
    assert rows(engine.query("shop", ["status"], ["mean_qty"])) == [("done", 10.5), ("new", pytest.approx(13 / 3))]


def test_phantom_rows_do_not_count(engine):
    assert rows(engine.query("shop", ["status"], ["shipped"])) == [("done", 1), ("new", 1)]
    assert rows(engine.query("shop", ["carrier"])) == [("boat",), ("cart",)]
    assert rows(engine.query("shop", facts=["heavy"])) == [(False,), (True,)]


def test_filter_runs_before_aggregation(engine):
    assert rows(engine.query("shop", ["region"], ["total"], where="status = 'new' AND doubled > 30")) == [("Nord", 100)]
    assert rows(engine.query("shop", ["region"], ["order_count"], where="  ")) == rows(engine.query("shop", ["region"], ["order_count"]))


@pytest.mark.parametrize(
    ("request_", "error"),
    [
        ({}, errors.EmptyRequest),
        ({"dimensions": ["regoin"]}, errors.UnknownDimension),
        ({"dimensions": ["region", "C.REGION"]}, errors.DuplicateMember),
        ({"metrics": ["hidden"]}, errors.PrivateMember),
        ({"facts": ["secret"]}, errors.PrivateMember),
        ({"facts": ["doubled"], "metrics": ["total"]}, errors.FactsMetricsExclusion),
        ({"dimensions": ["sku"], "metrics": ["order_count"]}, errors.FanTrap),
        ({"metrics": ["order_count"], "where": "sku = 'nut'"}, errors.WhereFanTrap),
        ({"metrics": ["order_count"], "where": "total > 1"}, errors.WhereReferencesMetric),
        ({"dimensions": ["sku"], "facts": ["heavy"]}, errors.FactPathViolation),
        ({"metrics": ["item_rows"]}, errors.CountStarRequiresKey),
    ],
)
def test_refusals(engine, request_, error):
    with pytest.raises(error):
        engine.query("shop", **request_)


def test_statements_and_round_trips(engine):
    assert engine.sql("SELECT * FROM semantic_view('shop', dimensions := ['region'], metrics := ['balance']) WHERE region = 'Sued'").collect()[0].balance == 64
    view = engine.catalog.find("SHOP")
    assert ddl.parse_body("shop", ddl.render(view).split(" AS\n", 1)[1]) == view
    engine.create_from_yaml("shop_yaml", engine.read_yaml("shop"), replace_it=True)
    again = engine.catalog.find("shop_yaml")
    assert (again.tables, again.metrics, again.dimensions) == (view.tables, view.metrics, view.dimensions)
    assert engine.sql("ALTER SEMANTIC VIEW shop_yaml RENAME TO shop_two").collect()[0].new_name == "shop_two"
    assert engine.sql("ALTER SEMANTIC VIEW shop_two SET COMMENT = 'it''s'").collect()[0].status == "comment set"
    assert engine.sql("DROP SEMANTIC VIEW IF EXISTS shop_two").count() == 1
    assert engine.sql("DROP SEMANTIC VIEW IF EXISTS shop_two").count() == 0
    assert {r.name for r in engine.sql("SHOW SEMANTIC DIMENSIONS IN shop FOR METRIC order_count").collect()} == {"region", "status"}
    assert "hidden" not in {r.column_name for r in engine.sql("SHOW COLUMNS IN SEMANTIC VIEW shop").collect()}
    assert engine.sql("DESCRIBE SEMANTIC VIEW shop").filter("property = 'PRIMARY_KEY'").count() == 3


def test_definitions_are_checked(engine):
    for body, error in [
        ("TABLES (a AS t PRIMARY KEY (x)) METRICS (a.m AS a.x)", errors.DefinitionError),
        ("TABLES (a AS t PRIMARY KEY (x), b AS u) RELATIONSHIPS (r AS a (y) REFERENCES b) METRICS (a.m AS SUM(a.x))", errors.DefinitionError),
        ("TABLES (a AS t PRIMARY KEY (x)) METRICS (a.m AS SUM(a.x), p AS q + 1, q AS p + 1)", errors.CycleError),
        ("TABLES (a AS t) METRICS (a.m AS SUM(a.x)) DIMENSIONS (a.d AS a.x)", errors.ParseError),
        ("TABLES (a AS t) METRICZ (a.m AS SUM(a.x))", errors.ParseError),
        ("TABLES (a AS t) DIMENSIONS (PRIVATE a.d AS a.x)", errors.ParseError),
    ]:
        with pytest.raises(error):
            engine.sql(f"CREATE SEMANTIC VIEW bad AS {body}")


def test_transactions(engine):
    with pytest.raises(RuntimeError), engine.catalog.transaction():
        engine.catalog.drop("shop")
        raise RuntimeError
    assert engine.catalog.find("shop").name == "shop"


def test_text_is_read_lexically():
    assert text.references("a.x + 'b.y' || \"C d\" -- e\n + f(g)") == ["a.x", '"C d"', "g"]
    assert text.split("a, f(b, 'c,d'), \"e,f\"") == ["a", "f(b, 'c,d')", '"e,f"']


def test_moments_are_those_of_the_sample(spark):
    import duckdb

    from grainwise.functions import aggregates

    values = [1.0, 2.0, 2.0, 3.5, -4.0, 11.0, 6.0]
    asked = ["kurtosis(x)", "kurtosis_pop(x)", "skewness(x)", "sem(x)", "product(x)", "quantile_cont(x, 0.3)", "fsum(x)", "skewness(x) FILTER (WHERE x > 0)", "kurtosis(x) FILTER (WHERE x > 5)", "round(kurtosis(x) + avg(x), 3)"]
    spark.createDataFrame([(v,) for v in [*values, None]], "x double").createOrReplaceTempView("t_moments")
    got = spark.sql("SELECT " + ", ".join(aggregates.to_spark(a) for a in asked) + " FROM t_moments").first()
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t AS SELECT unnest([{', '.join(map(str, values))}, NULL]) AS x")
    want = con.execute("SELECT " + ", ".join(asked) + " FROM t").fetchone()
    for a, x, y in zip(asked, got, want, strict=True):
        assert (x is None and y is None) or x == pytest.approx(float(y), rel=1e-9), a
    for name in aggregates.UNSUPPORTED:
        with pytest.raises(ValueError, match=name):
            aggregates.to_spark(f"1 + {name}(x)")


def view(engine, name, body):
    engine.sql(f"CREATE OR REPLACE SEMANTIC VIEW {name} AS {body}")


def table(engine, name, schema, data):
    engine.spark.createDataFrame(data, schema).createOrReplaceTempView(name)


@pytest.fixture(scope="module")
def stock(engine):
    """Accounts by day: snapshots by one and by two dimensions."""
    data = [("E", 1, "x", 10, 1), ("E", 1, "y", 20, 2), ("E", 2, "x", 15, 3), ("E", 2, "y", 40, 4), ("W", 1, "x", 7, 5), ("W", None, "x", 9, 6)]
    table(engine, "t_stock", "region string, d int, acct string, amount int, id int", data)
    table(engine, "t_regions", "region string, country string", [("E", "aa"), ("W", "bb"), ("N", "bb")])
    view(engine, "stock", """TABLES (s AS t_stock PRIMARY KEY (id), r AS t_regions PRIMARY KEY (region)) RELATIONSHIPS (s_r AS s (region) REFERENCES r)
      DIMENSIONS (s.region AS s.region, s.day AS s.d, s.acct AS s.acct, r.country AS r.country)
      METRICS (s.last_both NON ADDITIVE BY (day, acct) AS SUM(s.amount), s.last_day NON ADDITIVE BY (day NULLS FIRST) AS AVG(s.amount), s.first_day NON ADDITIVE BY (day DESC NULLS FIRST) AS COUNT(s.amount),
        s.mixed NON ADDITIVE BY (day DESC, acct ASC) AS MAX(s.amount), s.plain AS SUM(s.amount), s.other AS SUM(DISTINCT s.amount), r.regions AS COUNT(*), doubled AS last_both * 2)""")
    return engine


def test_snapshots(stock):
    key = lambda r: str(r)
    # a queried dimension that the metric is not additive by orders, and does not partition
    assert sorted(rows(stock.query("stock", ["region", "day"], ["last_both"])), key=key) == sorted([("E", 1, None), ("E", 2, 40), ("W", 1, 7), ("W", None, None)], key=key)
    assert sorted(rows(stock.query("stock", ["region"], ["last_both", "last_day", "plain"])), key=key) == [("E", 40, 27.5, 85), ("W", 7, 9.0, 16)]
    assert rows(stock.query("stock", [], ["last_both"])) == [(40,)] and rows(stock.query("stock", [], ["last_day"])) == [(9.0,)]
    assert rows(stock.query("stock", ["region"], ["first_day"])) == [("E", 2), ("W", 1)]
    assert rows(stock.query("stock", [], ["mixed"])) == [(9,)] and rows(stock.query("stock", ["region"], ["mixed"])) == [("E", 20), ("W", 9)]
    assert rows(stock.query("stock", ["region", "day", "acct"], ["last_both"]))[0] == ("E", 1, "x", 10)
    # a snapshot as one of several grains, and alone at a grain that the base repeats
    assert rows(stock.query("stock", ["country"], ["last_both", "regions"])) == [("aa", 40, 1), ("bb", 7, 2)]
    for request, error in [({"metrics": ["last_both", "other"]}, errors.SemiAdditiveUnsupported), ({"metrics": ["doubled"]}, errors.SemiAdditiveDependency)]:
        with pytest.raises(error):
            stock.query("stock", **request)


def test_members_named_like_words(engine):
    table(engine, "t_words", "id int, d date, n int, s string", [(1, None, 5, "it's -- x"), (2, None, 7, "\\")])
    engine.spark.sql("SELECT id, make_date(2024, id, 3) AS d, n, s FROM t_words").createOrReplaceTempView("t_words2")
    view(engine, "words", r"""TABLES (w AS t_words2 PRIMARY KEY (id)) FACTS (w.first AS w.n + 1)
      DIMENSIONS (w.day AS w.d, w.month AS extract(month from w.d), w.date AS CAST(w.d AS DATE), w."a.b" AS w.s, w.year AS year(w.d))
      METRICS (w.n AS SUM(w.n), w.firsts AS SUM(first), big AS CAST(n AS BIGINT) + 1, w.quotes AS count_if(w.s = E'\\'), w.commas AS count_if(w.s = e'it\'s -- x'))""")
    assert rows(engine.query("words", ["month"], ["n"], where="day > DATE '2024-01-15' AND year = 2024 AND month = 2")) == [(2, 7)]
    assert rows(engine.query("words", ["date"], ["big"], where="date < date '2024-02-01' AND first > 5")) == [(engine.spark.sql("SELECT DATE '2024-01-03'").first()[0], 6)]
    assert rows(engine.query("words", [], ["quotes", "commas", "firsts"])) == [(1, 1, 14)]
    assert rows(engine.query("words", ['"a.b"'], ["n"], where="\"a.b\" = 'it''s -- x'")) == [("it's -- x", 5)]
    assert engine.query("words", ['w."a.b"']).columns == ["a.b"]
    again = engine.catalog.find("words")
    engine.sql(engine.get_ddl("words"))
    assert engine.catalog.find("words") == again
    assert text.references("INTERVAL 2 day + day AT TIME ZONE 'x' || ARRAY[first]::map + max(v ORDER BY last NULLS LAST)") == ["day", "first", "v", "last"]


def test_statements_pass_as_they_are(engine):
    assert engine.sql("SELECT 'don\\'t -- x' AS s").first().s == "don't -- x"
    plan = engine.sql("SELECT /*+ BROADCAST(y) */ x.id FROM t_orders x JOIN t_customers y ON x.customer_id = y.id")._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in engine.sql("SELECT /*+ BROADCAST(y) */ x.id FROM t_orders x JOIN t_customers y ON x.customer_id = y.id")._jdf.queryExecution().optimizedPlan().toString() or "ResolvedHint" in plan
    before = {t.name for t in engine.spark.catalog.listTables()}
    both = engine.sql("SELECT a.region, b.order_count FROM semantic_view('shop', dimensions := ['region'], metrics := ['balance']) a JOIN semantic_view('shop', dimensions := ['region'], metrics := ['order_count']) b ON a.region = b.region")
    assert {t.name for t in engine.spark.catalog.listTables()} == before and rows(both) == [("Nord", 5)]
    made = engine.sql("SELECT length(GET_DDL('SEMANTIC_VIEW', 'shop')) AS n, READ_YAML_FROM_SEMANTIC_VIEW('shop') AS y").first()
    assert made.n == len(engine.get_ddl("shop")) and made.y == engine.read_yaml("shop")
    assert engine.sql("SELECT count(*) AS n FROM explain_semantic_view('shop', metrics := ['balance'])").first().n > 5


def test_search_path(spark):
    e = Engine(spark)
    spark.createDataFrame([(1,), (2,)], "x int").createOrReplaceTempView("t_one")
    for schema, metric in (("alpha", "SUM(t.x)"), ("beta", "COUNT(*)")):
        e.sql(f"CREATE SEMANTIC VIEW {schema}.v AS TABLES (t AS t_one PRIMARY KEY (x)) METRICS (t.m AS {metric})")
    ask = lambda more="": e.sql(f"SELECT m FROM semantic_view('v', metrics := ['m']{more})").first().m
    with pytest.raises(errors.UnknownView, match="search path"):
        ask()
    e.sql("SET search_path = 'beta,alpha'")
    assert ask() == 2 and ask(", search_path := 'alpha'") == 3 and ask(", search_path := ['alpha', 'beta']") == 3
    e.catalog.search_path = []
    with pytest.raises(errors.AmbiguousView):
        ask()
    with pytest.raises(errors.UnknownView, match="another database"):
        e.query("elsewhere.alpha.v", metrics=["m"])
    assert e.query("spark_catalog.alpha.v", metrics=["m"]).first().m == 3


def test_more_refusals(engine):
    table(engine, "t_facts", "id int, a int, b int", [(1, 1, 2)])
    table(engine, "t_dims", "id int, name string", [(1, "x"), (2, "y")])
    view(engine, "roles", """TABLES (f AS t_facts PRIMARY KEY (id), d AS t_dims PRIMARY KEY (id)) RELATIONSHIPS (ra AS f (a) REFERENCES d, rb AS f (b) REFERENCES d)
      FACTS (d.size AS length(d.name)) DIMENSIONS (d.name AS d.name, f.kind AS f.a) METRICS (f.by_a USING (ra) AS COUNT(*), f.by_b USING (rb) AS COUNT(*), f.n AS COUNT(*), f.reach AS SUM(size))""")
    assert rows(engine.query("roles", ["name"], ["by_a"])) == [("x", 1)] and rows(engine.query("roles", ["name"], ["by_b"])) == [("y", 1)]
    for request in ({"dimensions": ["name"], "metrics": ["n"]}, {"dimensions": ["name"], "metrics": ["by_a", "by_b"]}, {"dimensions": ["kind"], "facts": ["size"]}, {"metrics": ["n"], "where": "name = 'x'"}):
        with pytest.raises(errors.AmbiguousPath):
            engine.query("roles", **request)
    view(engine, "wide", """TABLES (o AS t_orders PRIMARY KEY (id), c AS t_customers PRIMARY KEY (id), i AS t_items) RELATIONSHIPS (o_c AS o (customer_id) REFERENCES c, i_o AS i (order_id) REFERENCES o)
      FACTS (i.qty AS i.qty) DIMENSIONS (c.region AS c.region, loose AS 1, o.status AS o.status, o.deep AS qty + 1)
      METRICS (o.total AS SUM(o.amount), i.items AS SUM(qty), c.balance AS SUM(c.balance), running AS SUM(total) OVER (PARTITION BY EXCLUDING status ORDER BY status), over_all AS SUM(balance) OVER (PARTITION BY region))""")
    cases = [
        ({"dimensions": ["loose"], "metrics": ["balance"]}, errors.RootGrainFanTrap),
        ({"metrics": ["balance"], "where": "loose = 1"}, errors.RootGrainFanTrap),
        ({"dimensions": ["loose"], "metrics": ["total", "balance"]}, errors.RootGrainFanTrap),
        ({"dimensions": ["loose"], "metrics": ["total", "items"]}, errors.MetricFanTrap),
        ({"dimensions": ["region"], "metrics": ["running"]}, errors.WindowRequiredDimension),
        ({"dimensions": ["region", "status"], "metrics": ["running", "total"]}, errors.WindowAggregateMixing),
        ({"dimensions": ["region"], "metrics": ["running", "over_all"]}, errors.WindowRequiredDimension),
        ({"dimensions": ["deep"], "metrics": ["total"]}, errors.FactFanTrap),
        ({"metrics": ["total"], "where": "deep = 1"}, errors.WhereFanTrap),
    ]
    for request, error in cases:
        with pytest.raises(error):
            engine.query("wide", **request)
    assert rows(engine.query("wide", ["region"], ["over_all"])) == [("Nord", 39), ("Sued", 64)]  # a window over a grain that the base repeats
    view(engine, "pair", """TABLES (o AS t_orders PRIMARY KEY (id), s AS t_shipments PRIMARY KEY (id) UNIQUE (order_id)) RELATIONSHIPS (s_o AS s (order_id) REFERENCES o)
      DIMENSIONS (s.carrier AS s.carrier) METRICS (o.n AS COUNT(*), s.weight AS SUM(s.weight))""")
    assert sorted(rows(engine.query("pair", ["carrier"], ["n", "weight"])), key=str) == [("boat", 1, 2), ("cart", 1, 1), (None, 3, None)]  # one to one: nothing fans
    for body, error in [
        ("TABLES (a AS t) METRICS (a.m AS entropy(a.x))", errors.DefinitionError),
        ("TABLES (a AS t) METRICS (a.m AS SUM(a.x) LABELS = (filtered))", errors.ParseError),
        ("TABLES (a AS t) METRICS (a.m AS SUM(a.x), w AS 1 + SUM(m) OVER (ORDER BY d)) DIMENSIONS (a.d AS a.x)", errors.ParseError),
        ("TABLES (a AS t) DIMENSIONS (a.d AS a.x) METRICS (a.m AS SUM(a.x), w AS 1 + SUM(m) OVER (ORDER BY d))", errors.ParseError),
        ("TABLES (a AS t) METRICS (a.m0 AS SUM(a.x), " + ", ".join(f"m{i + 1} AS m{i} + 1" for i in range(400)) + ")", errors.DefinitionError),
    ]:
        with pytest.raises(error):
            engine.sql(f"CREATE SEMANTIC VIEW bad AS {body}")


def test_aggregates_in_calls(engine):
    table(engine, "t_vals", "g int, v double, k int", [(1, 3.0, 2), (1, None, 1), (1, 8.0, 3), (2, 5.0, 1)])
    table(engine, "t_groups", "g int", [(1,), (2,), (3,)])
    view(engine, "vals", """TABLES (t AS t_groups PRIMARY KEY (g), x AS t_vals PRIMARY KEY (k, g)) RELATIONSHIPS (x_t AS x (g) REFERENCES t)
      DIMENSIONS (t.g AS t.g) METRICS (x.ordered AS LIST(x.v ORDER BY x.k DESC), x.mid AS percentile_cont(0.5) WITHIN GROUP (ORDER BY x.v), x.joined AS string_agg(CAST(x.k AS VARCHAR(9)), '-' ORDER BY x.k DESC), x.spread AS mad(x.v), x.earliest AS first(x.v ORDER BY x.k))""")
    got = {r.g: r for r in engine.query("vals", ["g"], ["ordered", "mid", "joined", "spread", "earliest"]).collect()}
    assert got[1].ordered == [8.0, 3.0, None] and got[2].ordered == [5.0]
    assert (got[1].mid, got[2].mid, got[3].mid) == (5.5, 5.0, None)
    assert (got[1].joined, got[3].joined) == ("3-2-1", None)
    assert (got[1].spread, got[2].spread, got[3].spread) == (2.5, 0.0, None)
    assert (got[1].earliest, got[2].earliest) == (None, 5.0)


def test_yaml_and_files(engine, tmp_path):
    text_ = engine.read_yaml("shop")
    assert engine.sql(f"CREATE SEMANTIC VIEW shop_inline FROM YAML $${text_}$$").count() == 1
    (tmp_path / "shop.yaml").write_text(text_)
    assert engine.sql(f"CREATE SEMANTIC VIEW shop_file COMMENT = 'c' FROM YAML FILE '{tmp_path}/shop.yaml'").count() == 1
    assert engine.catalog.find("shop_file").comment == "c" and rows(engine.query("shop_inline", [], ["balance"])) == [(103,)]
    with pytest.raises(errors.ParseError, match="bytes"):
        engine.create_from_yaml("large", "x: " + "y" * (1 << 20))
    with pytest.raises(errors.SemanticError):
        engine.create_from_yaml("dotted", "tables: [{alias: o, table: t, primary_key: [id]}]\ndimensions: [{name: region, table: a.b, expr: o.x}]")
    for name in ("shop_inline", "shop_file"):
        engine.sql(f"DROP SEMANTIC VIEW {name}")


def test_the_catalog_file(spark, tmp_path):
    path = tmp_path / "views.json"
    e = Engine(spark, str(path))
    e.sql("CREATE SEMANTIC VIEW v COMMENT = 'it''s' AS TABLES (t AS nowhere PRIMARY KEY (x)) DIMENSIONS (t.d AS t.x COMMENT = 'c' WITH SYNONYMS = ('a', 'b''c') LABELS = (FILTER)) METRICS (t.m AS SUM(t.x))")
    before = path.read_text()
    with pytest.raises(RuntimeError), e.catalog.transaction():
        e.sql("DROP SEMANTIC VIEW v")
        assert path.read_text() == before
        raise RuntimeError
    assert path.read_text() == before and Engine(spark, str(path)).catalog.find("v") == e.catalog.find("v")
    with e.catalog.transaction():
        e.sql("ALTER SEMANTIC VIEW v RENAME TO w")
        e.sql("ALTER SEMANTIC VIEW w UNSET COMMENT")
    again = Engine(spark, str(path)).catalog
    assert again.find("w").comment is None and again.find("w").dimensions[0].synonyms == ("a", "b'c") and len(list(tmp_path.iterdir())) == 1
    import json

    stored = json.loads(path.read_text())
    stored["views"][0]["ddl"] = stored["views"][0]["ddl"].replace("SUM(t.x)", "t.x")
    path.write_text(json.dumps(stored))
    with pytest.raises(errors.DefinitionError):  # a stored definition that contradicts itself
        Engine(spark, str(path)).query("w", metrics=["m"])
    path.write_text(json.dumps(stored | {"version": 99}))
    with pytest.raises(errors.DefinitionError, match="later version"):
        Engine(spark, str(path))


def test_filters_of_listings(engine):
    names = lambda statement: [r.name for r in engine.sql(statement).collect()]
    assert names("SHOW SEMANTIC METRICS LIKE '%QTY' IN shop") == ["item_qty", "mean_qty"]
    assert names("SHOW SEMANTIC DIMENSIONS IN shop STARTS WITH 's' LIMIT 1") == ["sku"]
    assert names("SHOW SEMANTIC VIEWS LIKE 'sh_p' IN SCHEMA main") == ["shop"] and names("SHOW SEMANTIC VIEWS IN SCHEMA other") == []
    assert names("SHOW TERSE SEMANTIC VIEWS IN DATABASE spark_catalog STARTS WITH 'shop' LIMIT 1") == ["shop"]
    with pytest.raises(errors.ParseError):
        engine.sql("SHOW SEMANTIC VIEWS LIMIT 1 LIKE 'x'")


def test_streams(spark, tmp_path):
    from grainwise.streaming import stream_query

    for i in range(3):
        spark.createDataFrame([(i, "a", i), (i + 10, "b", 2)], "id int, g string, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.readStream.schema("id int, g string, v int").parquet(f"{tmp_path}/in").createOrReplaceTempView("t_stream")
    e = Engine(spark)
    e.sql("CREATE SEMANTIC VIEW st AS TABLES (s AS t_stream PRIMARY KEY (id)) DIMENSIONS (s.g AS s.g) METRICS (s.total AS SUM(s.v), s.n AS COUNT(*), s.latest NON ADDITIVE BY (g) AS SUM(s.v))")
    df = stream_query(e, "st", ["g"], ["total", "n"], where="v > 0")
    assert df.isStreaming
    run = df.writeStream.outputMode("complete").format("memory").queryName("t_stream_out").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert rows(spark.table("t_stream_out")) == [("a", 3, 2), ("b", 6, 3)]
    with pytest.raises(errors.SemanticError):
        stream_query(e, "st", [], ["latest"])


def test_random_requests_against_another_engine(spark):
    """Random tables and requests, filters among them, against each grain aggregated apart by DuckDB."""
    import random

    import duckdb

    rng = random.Random(17)
    e, con = Engine(spark), duckdb.connect()
    data = {
        "d_cust": ("id INTEGER, seg VARCHAR, bal INTEGER", [(i, rng.choice("pqr") if rng.random() > 0.1 else None, rng.randrange(100)) for i in range(30)]),
        "d_ord": ("id INTEGER, cust INTEGER, pri VARCHAR, price INTEGER", [(i, rng.randrange(36) if rng.random() > 0.1 else None, rng.choice("xyz"), rng.randrange(50)) for i in range(120)]),
        "d_line": ("id INTEGER, ord INTEGER, flag VARCHAR, qty INTEGER", [(i, rng.randrange(125), rng.choice("AB"), rng.randrange(9) if rng.random() > 0.2 else None) for i in range(400)]),
    }
    for name, (schema, content) in data.items():
        spark.createDataFrame(content, schema.replace("VARCHAR", "STRING").replace("INTEGER", "INT")).createOrReplaceTempView(name)
        con.execute(f"CREATE TABLE {name} ({schema})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(content[0]))})", content)
    e.sql("""CREATE SEMANTIC VIEW rnd AS TABLES (l AS d_line PRIMARY KEY (id), o AS d_ord PRIMARY KEY (id), c AS d_cust PRIMARY KEY (id)) RELATIONSHIPS (lo AS l (ord) REFERENCES o, oc AS o (cust) REFERENCES c)
      DIMENSIONS (l.flag AS l.flag, o.pri AS o.pri, c.seg AS c.seg) METRICS (l.qty AS SUM(l.qty), l.lines AS COUNT(*), o.price AS SUM(o.price), o.orders AS COUNT(*), c.bal AS SUM(c.bal), c.most AS MAX(c.bal), each AS price / nullif(orders, 0))""")
    level, source = {"l": 0, "o": 1, "c": 2}, {"l": "d_line l LEFT JOIN d_ord o ON l.ord = o.id LEFT JOIN d_cust c ON o.cust = c.id", "o": "d_ord o LEFT JOIN d_cust c ON o.cust = c.id", "c": "d_cust c"}
    dims = {"flag": "l", "pri": "o", "seg": "c"}
    metrics = {"qty": ("l", "SUM(l.qty)"), "lines": ("l", "COUNT(*)"), "price": ("o", "SUM(o.price)"), "orders": ("o", "COUNT(*)"), "bal": ("c", "SUM(c.bal)"), "most": ("c", "MAX(c.bal)"), "each": ("o", "SUM(o.price) / nullif(COUNT(*), 0)")}
    wheres = {"": "c", "seg = 'p'": "c", "pri <> 'x' OR seg IS NULL": "o", "flag IN ('A')": "l", "seg IN ('q', 'r') AND pri > 'x'": "o"}
    refused = 0
    for _ in range(40):
        ds, ms, w = rng.sample(sorted(dims), rng.randrange(3)), rng.sample(sorted(metrics), rng.randint(1, 3)), rng.choice(sorted(wheres))
        finest = max([level[metrics[m][0]] for m in ms])
        needs = min([level[dims[d]] for d in ds] + ([level[wheres[w]]] if w else []), default=2)
        if needs < finest:
            with pytest.raises((errors.FanTrap, errors.WhereFanTrap)):
                e.query("rnd", ds, ms, where=w or None)
            refused += 1
            continue
        full = {"flag": "l.flag", "pri": "o.pri", "seg": "c.seg"}
        where = w
        for d, x in full.items():
            where = where.replace(d, x)
        want: dict = {}
        for grain in {metrics[m][0] for m in ms}:
            own = [m for m in ms if metrics[m][0] == grain]
            sql = f"SELECT {', '.join([full[d] for d in ds] + [metrics[m][1] for m in own])} FROM {source[grain]}" + (f" WHERE {where}" if where else "") + (f" GROUP BY {', '.join(map(str, range(1, len(ds) + 1)))}" if ds else "")
            for r in con.execute(sql).fetchall():
                want.setdefault(r[: len(ds)], {}).update(zip(own, r[len(ds) :], strict=True))
        got = {tuple(r)[: len(ds)]: dict(zip(ms, tuple(r)[len(ds) :], strict=True)) for r in e.query("rnd", ds, ms, where=w or None).collect()}
        assert set(got) == set(want), (ds, ms, w)
        for k, x in want.items():
            for m in ms:
                assert (got[k][m] is None) == (x.get(m) is None) and (x.get(m) is None or got[k][m] == pytest.approx(x[m])), (ds, ms, w, k)
    assert refused > 3


def test_registered_queries_answer(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
