"""Registered queries: requests against views over the driver's tables, and SQL that answers them another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "q_base_group"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SALES = """CREATE OR REPLACE SEMANTIC VIEW sales AS
TABLES (
  l AS lineitem PRIMARY KEY (l_orderkey, l_linenumber),
  o AS orders PRIMARY KEY (o_orderkey),
  c AS customer PRIMARY KEY (c_custkey),
  s AS supplier PRIMARY KEY (s_suppkey),
  p AS part PRIMARY KEY (p_partkey),
  cn AS nation PRIMARY KEY (n_nationkey),
  sn AS nation PRIMARY KEY (n_nationkey),
  cr AS region PRIMARY KEY (r_regionkey)
)
RELATIONSHIPS (
  l_o AS l (l_orderkey) REFERENCES o,
  o_c AS o (o_custkey) REFERENCES c,
  l_s AS l (l_suppkey) REFERENCES s,
  l_p AS l (l_partkey) REFERENCES p,
  c_n AS c (c_nationkey) REFERENCES cn,
  s_n AS s (s_nationkey) REFERENCES sn,
  n_r AS cn (n_regionkey) REFERENCES cr
)
FACTS (
  l.net AS l.l_extendedprice * (1 - l.l_discount),
  l.gross AS net * (1 + l.l_tax),
  o.price_thousands AS o.o_totalprice / 1000,
  PRIVATE l.hidden AS l.l_tax
)
DIMENSIONS (
  l.returnflag AS l.l_returnflag, l.linestatus AS l.l_linestatus,
  l.shipyear AS year(l.l_shipdate), l.linenumber AS l.l_linenumber,
  o.priority AS o.o_orderpriority LABELS = (FILTER), o.status AS o.o_orderstatus,
  o.orderyear AS year(o.o_orderdate),
  o.ordermonth AS CAST(date_trunc('month', o.o_orderdate) AS date),
  c.segment AS c.c_mktsegment, p.brand AS p.p_brand, s.supplier_name AS s.s_name,
  cn.customer_nation AS cn.n_name, sn.supplier_nation AS sn.n_name, cr.region AS cr.r_name
)
METRICS (
  l.revenue AS SUM(net) COMMENT = 'after discount',
  l.gross_revenue AS SUM(gross),
  l.quantity AS SUM(l.l_quantity),
  l.line_count AS COUNT(*),
  l.avg_discount AS AVG(l.l_discount),
  l.parts AS COUNT(DISTINCT l.l_partkey),
  l.returned AS SUM(l.l_quantity) FILTER (WHERE l.l_returnflag = 'R'),
  l.order_value AS SUM(o.price_thousands),
  o.order_count AS COUNT(*),
  o.order_total AS SUM(o.o_totalprice),
  c.customer_count AS COUNT(*),
  c.balance AS SUM(c.c_acctbal),
  PRIVATE l.cost AS SUM(l.l_extendedprice * l.l_discount),
  revenue_per_unit AS revenue / nullif(quantity, 0),
  discount_share AS cost / nullif(revenue + cost, 0),
  revenue_per_order AS revenue / nullif(order_count, 0),
  running_revenue AS SUM(revenue) OVER (PARTITION BY EXCLUDING orderyear ORDER BY orderyear ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  last_revenue AS LAG(revenue, 1) OVER (PARTITION BY EXCLUDING orderyear ORDER BY orderyear ASC NULLS LAST),
  segment_rank AS RANK(revenue) OVER (PARTITION BY segment ORDER BY orderyear DESC),
  quarter_revenue AS AVG(revenue) OVER (ORDER BY ordermonth RANGE BETWEEN INTERVAL '2' MONTH PRECEDING AND CURRENT ROW)
)
MATERIALIZATIONS (
  by_segment AS (TABLE segment_totals, DIMENSIONS (segment), METRICS (revenue, line_count))
)
COMMENT = 'order lines'"""

ORDERS = """CREATE OR REPLACE SEMANTIC VIEW order_view AS
TABLES (o AS orders PRIMARY KEY (o_orderkey), l AS lineitem PRIMARY KEY (l_orderkey, l_linenumber), c AS customer PRIMARY KEY (c_custkey))
RELATIONSHIPS (l_o AS l (l_orderkey) REFERENCES o, o_c AS o (o_custkey) REFERENCES c)
FACTS (l.qty AS l.l_quantity, o.price AS o.o_totalprice)
DIMENSIONS (o.priority AS o.o_orderpriority, o.orderkey AS o.o_orderkey, l.flag AS l.l_returnflag, c.segment AS c.c_mktsegment)
METRICS (o.order_count AS COUNT(*), o.total AS SUM(o.o_totalprice), l.line_count AS COUNT(*), l.units AS SUM(l.l_quantity), l.filled AS SUM(COALESCE(l.l_quantity, 99)), c.balance AS SUM(c.c_acctbal))"""

EVENTS = """CREATE OR REPLACE SEMANTIC VIEW event_view AS
TABLES (e AS events PRIMARY KEY (event_id), c AS customer PRIMARY KEY (c_custkey))
RELATIONSHIPS (e_c AS e (user_id) REFERENCES c)
DIMENSIONS (e.user_id AS e.user_id, e.event_type AS e.event_type, e.ts AS e.ts, e.day AS CAST(e.ts AS DATE), c.segment AS c.c_mktsegment)
METRICS (
  e.latest_value NON ADDITIVE BY (ts ASC NULLS LAST) AS SUM(e.value),
  e.earliest_value NON ADDITIVE BY (ts DESC NULLS FIRST) AS SUM(e.value),
  e.latest_day_value NON ADDITIVE BY (day) AS SUM(e.value),
  e.event_count AS COUNT(e.event_id)
)"""

STOCK = """CREATE OR REPLACE SEMANTIC VIEW stock AS
TABLES (e AS events PRIMARY KEY (event_id), c AS customer PRIMARY KEY (c_custkey))
RELATIONSHIPS (e_c AS e (user_id) REFERENCES c)
FACTS (e.doubled AS e.value * 2)
DIMENSIONS (e.event_type AS e.event_type, e.day AS CAST(e.ts AS DATE), e.hour AS hour(e.ts), c.segment AS c.c_mktsegment, e.size AS CASE WHEN doubled > 100 THEN 'large' ELSE 'small' END)
METRICS (
  e.last_hour NON ADDITIVE BY (day, hour) AS SUM(e.value),
  e.last_day NON ADDITIVE BY (day) AS SUM(e.value),
  e.first_day NON ADDITIVE BY (day DESC) AS COUNT(e.value),
  e.total AS SUM(e.value),
  c.customers AS COUNT(*),
  n AS CAST(total AS BIGINT)
)"""

#: The customer table as base: what lies above it would be repeated by its rows.
NATIONS = """CREATE OR REPLACE SEMANTIC VIEW nations AS
TABLES (c AS customer PRIMARY KEY (c_custkey) COMMENT = 'buyers', n AS nation PRIMARY KEY (n_nationkey), r AS region PRIMARY KEY (r_regionkey) WITH SYNONYMS = ('area'))
RELATIONSHIPS (c_n AS c (c_nationkey) REFERENCES n, n_r AS n (n_regionkey) REFERENCES r)
DIMENSIONS (n.nation AS n.n_name COMMENT = 'where the buyer''s from' WITH SYNONYMS = ('country', 'land'), r.region AS r.r_name LABELS = (FILTER), c.c_name AS upper(c.c_mktsegment))
METRICS (
  n.nation_count AS COUNT(*), c.customers AS COUNT(*), n.keys AS SUM(n.n_nationkey),
  c.richest AS MAX(c.c_acctbal), c.spread AS stddev_pop(c.c_acctbal), c.middle AS percentile_disc(0.5) WITHIN GROUP (ORDER BY c.c_acctbal), c.pieces AS COUNT(DISTINCT c.c_mktsegment),
  running_nations AS SUM(nation_count) OVER (ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  nation_rank AS RANK(nation_count) OVER (ORDER BY region DESC),
  mean_of_two AS AVG(nation_count) OVER (ORDER BY region ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
)
COMMENT = 'people by place'"""

#: One to one: an order has one summary at most.
SUMMARIES = """CREATE OR REPLACE SEMANTIC VIEW summaries AS
TABLES (o AS orders PRIMARY KEY (o_orderkey), t AS order_totals PRIMARY KEY (total_id) UNIQUE (orderkey))
RELATIONSHIPS (t_o AS t (orderkey) REFERENCES o)
DIMENSIONS (t.large AS t.units > 100)
METRICS (o.orders AS COUNT(*), t.units AS SUM(t.units))"""

ROLES = """CREATE OR REPLACE SEMANTIC VIEW trade AS
TABLES (t AS trade_rows PRIMARY KEY (l_orderkey, l_linenumber), n AS nation PRIMARY KEY (n_nationkey))
RELATIONSHIPS (buyer AS t (cust_nation) REFERENCES n, seller AS t (supp_nation) REFERENCES n)
DIMENSIONS (n.nation AS n.n_name)
METRICS (t.bought USING (buyer) AS SUM(t.l_quantity), t.sold USING (seller) AS SUM(t.l_quantity))"""


_ready: list = []


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Views over the Parquet tables of a folder; kept for the session and folder that asked last."""
    here = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if not _ready or _ready[0] != here or not spark.catalog.tableExists("lineitem"):
        for name in TABLES:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        e = Engine(spark)
        for statement in (SALES, ORDERS, EVENTS, STOCK, NATIONS, ROLES):
            e.sql(statement)
        _ready[:] = [here, e]
    return _ready[1]


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to four places: sums depend on their order in the last bits."""
    return df.select(*(F.round(c, 4).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def _ask(view: str, **request) -> Query:
    return lambda spark, sf_dir: _rounded(engine(spark, sf_dir).query(view, **request))


def _segment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of totals kept beside the sources; the request is answered from it."""
    e = engine(spark, sf_dir)
    totals = e.query("sales", ["brand", "segment"], ["revenue", "line_count"]).groupBy("segment").agg(F.sum("revenue").alias("revenue"), F.sum("line_count").alias("line_count"))
    totals.createOrReplaceTempView("segment_totals")
    return _rounded(e.query("sales", ["segment"], ["revenue", "line_count"]))


def _trade(*metrics: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        spark.sql("SELECT l.*, c_nationkey AS cust_nation, s_nationkey AS supp_nation FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey").createOrReplaceTempView("trade_rows")
        return _rounded(e.query("trade", ["nation"], metrics))

    return run


def _yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view written as YAML, read again under another name, gives the same rows."""
    e = engine(spark, sf_dir)
    e.create_from_yaml("sales_again", e.read_yaml("sales"))
    return _rounded(e.query("sales_again", ["returnflag"], ["revenue"]))


def _ddl_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view's DDL, run again, gives the same rows."""
    e = engine(spark, sf_dir)
    e.sql(e.get_ddl("sales"))
    return _rounded(e.query("sales", ["linestatus"], ["quantity"]))


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_NET = "l_extendedprice * (1 - l_discount)"
_LOC = "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey"

_add("q_base_group", _ask("sales", dimensions=["segment"], metrics=["revenue", "line_count", "avg_discount"]), f"SELECT c_mktsegment AS segment, round(sum({_NET}), 4) AS revenue, count(*) AS line_count, round(avg(l_discount), 4) AS avg_discount FROM {_LOC} GROUP BY 1")
_add("q_dims_only", _ask("sales", dimensions=["returnflag", "linestatus"]), "SELECT DISTINCT l_returnflag AS returnflag, l_linestatus AS linestatus FROM lineitem")
_add("q_metrics_only", _ask("sales", metrics=["quantity", "line_count", "parts"]), "SELECT round(sum(l_quantity), 4) AS quantity, count(*) AS line_count, count(DISTINCT l_partkey) AS parts FROM lineitem")
_add("q_pruned", _ask("sales", dimensions=["brand"], metrics=["quantity"]), "SELECT p_brand AS brand, round(sum(l_quantity), 4) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
_add("q_facts_rows", _ask("sales", dimensions=["linenumber"], facts=["net", "gross"]), f"SELECT l_linenumber AS linenumber, round({_NET}, 4) AS net, round({_NET} * (1 + l_tax), 4) AS gross FROM lineitem")
_add("q_fact_chain", _ask("sales", dimensions=["returnflag"], metrics=["gross_revenue"]), f"SELECT l_returnflag AS returnflag, round(sum({_NET} * (1 + l_tax)), 4) AS gross_revenue FROM lineitem GROUP BY 1")
_add("q_derived", _ask("sales", dimensions=["returnflag"], metrics=["revenue_per_unit", "discount_share"]), f"SELECT l_returnflag AS returnflag, round(sum({_NET}) / sum(l_quantity), 4) AS revenue_per_unit, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 4) AS discount_share FROM lineitem GROUP BY 1")
_add("q_cross_table_fact", _ask("sales", dimensions=["returnflag"], metrics=["order_value"]), "SELECT l_returnflag AS returnflag, round(sum(o_totalprice / 1000), 4) AS order_value FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
_add("q_filter_aggregate", _ask("sales", dimensions=["segment"], metrics=["returned"]), f"SELECT c_mktsegment AS segment, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4) AS returned FROM {_LOC} GROUP BY 1")
_add("q_where", _ask("sales", dimensions=["returnflag"], metrics=["line_count"], where="net > 20000 AND linestatus = 'O'"), f"SELECT l_returnflag AS returnflag, count(*) AS line_count FROM lineitem WHERE {_NET} > 20000 AND l_linestatus = 'O' GROUP BY 1")
_add("q_where_cross", _ask("sales", dimensions=["orderyear"], metrics=["quantity"], where="region = 'ASIA' OR priority = '1-URGENT'"), f"SELECT year(o_orderdate) AS orderyear, round(sum(l_quantity), 4) AS quantity FROM {_LOC} LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR o_orderpriority = '1-URGENT' GROUP BY 1")
_add("q_parent_grain", _ask("sales", dimensions=["segment"], metrics=["balance", "customer_count"]), "SELECT c_mktsegment AS segment, round(sum(c_acctbal), 4) AS balance, count(*) AS customer_count FROM customer GROUP BY 1")
_add("q_multi_grain", _ask("sales", dimensions=["segment"], metrics=["balance", "order_count", "revenue"]), f"SELECT segment, balance, order_count, revenue FROM (SELECT c_mktsegment AS segment, round(sum(c_acctbal), 4) AS balance FROM customer GROUP BY 1) FULL JOIN (SELECT c_mktsegment AS segment, count(*) AS order_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1) USING (segment) FULL JOIN (SELECT c_mktsegment AS segment, round(sum({_NET}), 4) AS revenue FROM {_LOC} GROUP BY 1) USING (segment)")
_add("q_multi_grain_total", _ask("sales", metrics=["balance", "order_total", "line_count"]), "SELECT (SELECT round(sum(c_acctbal), 4) FROM customer) AS balance, (SELECT round(sum(o_totalprice), 4) FROM orders) AS order_total, (SELECT count(*) FROM lineitem) AS line_count")
_add("q_multi_grain_derived", _ask("sales", dimensions=["orderyear"], metrics=["revenue_per_order"]), f"SELECT orderyear, round(r / n, 4) AS revenue_per_order FROM (SELECT year(o_orderdate) AS orderyear, count(*) AS n FROM orders GROUP BY 1) FULL JOIN (SELECT year(o_orderdate) AS orderyear, sum({_NET}) AS r FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) USING (orderyear)")
_add("q_multi_grain_where", _ask("sales", dimensions=["priority"], metrics=["order_count", "quantity"], where="segment = 'BUILDING'"), "SELECT priority, order_count, quantity FROM (SELECT o_orderpriority AS priority, count(*) AS order_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1) FULL JOIN (SELECT o_orderpriority AS priority, round(sum(l_quantity), 4) AS quantity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1) USING (priority)")
_CHILD = "orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"
_add("q_child_count", _ask("order_view", dimensions=["priority"], metrics=["line_count", "filled"]), f"SELECT o_orderpriority AS priority, count(l_orderkey) AS line_count, round(sum(CASE WHEN l_orderkey IS NOT NULL THEN coalesce(l_quantity, 99) END), 4) AS filled FROM {_CHILD} GROUP BY 1")
_add("q_childless_zero", _ask("order_view", dimensions=["orderkey"], metrics=["line_count"]), f"SELECT o_orderkey AS orderkey, count(l_orderkey) AS line_count FROM {_CHILD} GROUP BY 1")
_add("q_childless_facts", _ask("order_view", facts=["qty"]), "SELECT l_quantity AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
_add("q_child_distinct", _ask("order_view", dimensions=["flag"]), "SELECT DISTINCT l_returnflag AS flag FROM lineitem")
_add("q_child_parent", _ask("order_view", dimensions=["segment"], metrics=["order_count", "units"]), "SELECT segment, order_count, units FROM (SELECT c_mktsegment AS segment, count(*) AS order_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1) FULL JOIN (SELECT c_mktsegment AS segment, round(sum(l_quantity), 4) AS units FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1) USING (segment)")
_add("q_two_aliases", _ask("sales", dimensions=["customer_nation", "supplier_nation"], metrics=["quantity"]), f"SELECT a.n_name AS customer_nation, b.n_name AS supplier_nation, round(sum(l_quantity), 4) AS quantity FROM {_LOC} LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation a ON c_nationkey = a.n_nationkey LEFT JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2")
_add("q_role_buyer", _trade("bought"), "SELECT n_name AS nation, round(sum(l_quantity), 4) AS bought FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_add("q_role_seller", _trade("sold"), "SELECT n_name AS nation, round(sum(l_quantity), 4) AS sold FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
_add("q_semi_latest", _ask("event_view", dimensions=["user_id"], metrics=["latest_value"]), "SELECT user_id, round(sum(value), 4) AS latest_value FROM events e WHERE ts = (SELECT max(ts) FROM events x WHERE x.user_id = e.user_id) GROUP BY 1")
_add("q_semi_earliest", _ask("event_view", dimensions=["user_id"], metrics=["earliest_value"]), "SELECT user_id, round(sum(value), 4) AS earliest_value FROM events e WHERE ts = (SELECT min(ts) FROM events x WHERE x.user_id = e.user_id) GROUP BY 1")
_add("q_semi_ties", _ask("event_view", dimensions=["event_type"], metrics=["latest_day_value", "event_count"]), "SELECT event_type, round(sum(value) FILTER (WHERE CAST(ts AS DATE) = d), 4) AS latest_day_value, count(*) AS event_count FROM (SELECT *, (SELECT max(CAST(x.ts AS DATE)) FROM events x WHERE x.event_type = e.event_type) AS d FROM events e) GROUP BY 1")
_add("q_semi_where", _ask("event_view", dimensions=["user_id"], metrics=["latest_value"], where="event_type = 'click'"), "SELECT user_id, round(sum(value), 4) AS latest_value FROM events e WHERE event_type = 'click' AND ts = (SELECT max(ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'click') GROUP BY 1")
_add("q_semi_total", _ask("event_view", metrics=["latest_value"]), "SELECT round(sum(value), 4) AS latest_value FROM events WHERE ts = (SELECT max(ts) FROM events)")
_add("q_semi_queried", _ask("event_view", dimensions=["ts"], metrics=["latest_value"]), "SELECT ts, round(sum(value), 4) AS latest_value FROM events GROUP BY 1")
_YEARLY = f"SELECT c_mktsegment AS segment, year(o_orderdate) AS orderyear, sum({_NET}) AS r FROM {_LOC} GROUP BY 1, 2"
_add("q_win_running", _ask("sales", dimensions=["segment", "orderyear"], metrics=["running_revenue"]), f"WITH y AS ({_YEARLY}) SELECT a.segment, a.orderyear, round(sum(b.r), 4) AS running_revenue FROM y a JOIN y b ON a.segment = b.segment AND b.orderyear <= a.orderyear GROUP BY 1, 2")
_add("q_win_excluding", _ask("sales", dimensions=["orderyear"], metrics=["running_revenue"]), f"WITH y AS (SELECT orderyear, sum(r) AS r FROM ({_YEARLY}) GROUP BY 1) SELECT a.orderyear, round(sum(b.r), 4) AS running_revenue FROM y a JOIN y b ON b.orderyear <= a.orderyear GROUP BY 1")
_add("q_win_lag", _ask("sales", dimensions=["segment", "orderyear"], metrics=["last_revenue"]), f"WITH y AS ({_YEARLY}) SELECT a.segment, a.orderyear, round(b.r, 4) AS last_revenue FROM y a LEFT JOIN y b ON a.segment = b.segment AND b.orderyear = (SELECT max(orderyear) FROM y z WHERE z.segment = a.segment AND z.orderyear < a.orderyear)")
_add("q_win_rank", _ask("sales", dimensions=["segment", "orderyear"], metrics=["segment_rank"]), f"WITH y AS ({_YEARLY}) SELECT a.segment, a.orderyear, CAST(1 + (SELECT count(*) FROM y b WHERE b.segment = a.segment AND b.orderyear > a.orderyear) AS INTEGER) AS segment_rank FROM y a")
_add("q_win_range", _ask("sales", dimensions=["ordermonth"], metrics=["quarter_revenue"]), f"WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ordermonth, sum({_NET}) AS r FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT a.ordermonth, round(avg(b.r), 4) AS quarter_revenue FROM m a JOIN m b ON b.ordermonth BETWEEN a.ordermonth - INTERVAL 2 MONTH AND a.ordermonth GROUP BY 1")
_add("q_mat_hit", _segment_totals, f"SELECT c_mktsegment AS segment, round(sum({_NET}), 4) AS revenue, count(*) AS line_count FROM {_LOC} GROUP BY 1")
_add("q_mat_miss", _ask("sales", dimensions=["segment"], metrics=["line_count"], where="returnflag = 'A'"), f"SELECT c_mktsegment AS segment, count(*) AS line_count FROM {_LOC} WHERE l_returnflag = 'A' GROUP BY 1")
_add("q_wildcard", _ask("sales", dimensions=["cr.*"], metrics=["o.*"]), "SELECT r_name AS region, count(*) AS order_count, round(sum(o_totalprice), 4) AS order_total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_add("q_sql_form", lambda spark, sf_dir: _rounded(engine(spark, sf_dir).sql("SELECT segment, quantity FROM semantic_view('sales', dimensions := ['segment', 'priority'], metrics := ['quantity'], where_clause := 'returnflag = ''N''') WHERE priority = '2-HIGH'")), f"SELECT c_mktsegment AS segment, round(sum(l_quantity), 4) AS quantity FROM {_LOC} WHERE l_returnflag = 'N' AND o_orderpriority = '2-HIGH' GROUP BY 1")
_add("q_sql_top", lambda spark, sf_dir: _rounded(engine(spark, sf_dir).sql("SELECT * FROM semantic_view('sales', dimensions := ['brand'], metrics := ['quantity']) ORDER BY quantity DESC, brand LIMIT 5")), "SELECT p_brand AS brand, round(sum(l_quantity), 4) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
_add("q_yaml_round_trip", _yaml, f"SELECT l_returnflag AS returnflag, round(sum({_NET}), 4) AS revenue FROM lineitem GROUP BY 1")
_add("q_ddl_round_trip", _ddl_again, "SELECT l_linestatus AS linestatus, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1")
_add("q_semi_two_dims", _ask("stock", dimensions=["event_type", "day"], metrics=["last_hour"]), "SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value) FILTER (WHERE date_trunc('hour', ts) = (SELECT date_trunc('hour', max(x.ts)) FROM events x WHERE x.event_type = e.event_type)), 4) AS last_hour FROM events e GROUP BY 1, 2")
_add("q_semi_two_sets", _ask("stock", dimensions=["segment"], metrics=["last_day", "first_day", "total"]), "SELECT segment, round(sum(value) FILTER (WHERE d = hi), 4) AS last_day, count(value) FILTER (WHERE d = lo) AS first_day, round(sum(value), 4) AS total FROM (SELECT *, max(d) OVER (PARTITION BY segment) AS hi, min(d) OVER (PARTITION BY segment) AS lo FROM (SELECT c_mktsegment AS segment, CAST(ts AS DATE) AS d, value FROM events LEFT JOIN customer ON user_id = c_custkey)) GROUP BY 1")
_add("q_semi_in_a_grain", _ask("stock", dimensions=["segment"], metrics=["last_day", "customers"]), "SELECT coalesce(a.segment, b.segment) AS segment, last_day, customers FROM (SELECT segment, round(sum(value) FILTER (WHERE d = hi), 4) AS last_day FROM (SELECT *, max(d) OVER (PARTITION BY segment) AS hi FROM (SELECT c_mktsegment AS segment, CAST(ts AS DATE) AS d, value FROM events LEFT JOIN customer ON user_id = c_custkey)) GROUP BY 1) a FULL JOIN (SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1) b ON a.segment = b.segment")
_add("q_dim_over_fact", _ask("stock", dimensions=["size"], metrics=["total"]), "SELECT CASE WHEN value * 2 > 100 THEN 'large' ELSE 'small' END AS size, round(sum(value), 4) AS total FROM events GROUP BY 1")
_add("q_where_day", _ask("stock", dimensions=["event_type"], metrics=["total"], where="day >= DATE '2024-01-10' AND hour BETWEEN 6 AND 17 AND extract(month from day) < 12"), "SELECT event_type, round(sum(value), 4) AS total FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10' AND hour(ts) BETWEEN 6 AND 17 AND month(ts) < 12 GROUP BY 1")
_add("q_derived_cast", _ask("stock", dimensions=["event_type"], metrics=["n"]), "SELECT event_type, CAST(trunc(sum(value)) AS BIGINT) AS n FROM events GROUP BY 1")
_add("q_alias_like_column", _ask("nations", dimensions=["c_name"], metrics=["customers"]), "SELECT upper(c_mktsegment) AS c_name, count(*) AS customers FROM customer GROUP BY 1")
_add("q_moments", _ask("nations", dimensions=["region"], metrics=["richest", "spread", "middle", "pieces"]), "SELECT r_name AS region, round(max(c_acctbal), 4) AS richest, round(stddev_pop(c_acctbal), 4) AS spread, round(quantile_disc(c_acctbal, 0.5), 4) AS middle, count(DISTINCT c_mktsegment) AS pieces FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_PLACES = "SELECT r_name AS region, count(*) AS n FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1"
_add("q_win_other_grain", _ask("nations", dimensions=["region"], metrics=["running_nations"]), f"WITH p AS ({_PLACES}) SELECT a.region, CAST(sum(b.n) AS BIGINT) AS running_nations FROM p a JOIN p b ON b.region <= a.region GROUP BY 1")
_add("q_win_shared_inner", _ask("nations", dimensions=["region"], metrics=["running_nations", "nation_rank", "mean_of_two"]), f"WITH p AS ({_PLACES}), q AS (SELECT a.region, a.n, (SELECT z.n FROM p z WHERE z.region < a.region ORDER BY z.region DESC LIMIT 1) AS before FROM p a) SELECT q.region, (SELECT CAST(sum(b.n) AS BIGINT) FROM p b WHERE b.region <= q.region) AS running_nations, (SELECT CAST(count(*) + 1 AS INTEGER) FROM p b WHERE b.region > q.region) AS nation_rank, round(CASE WHEN before IS NULL THEN n ELSE (n + before) / 2 END, 4) AS mean_of_two FROM q")


def _one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unique reference: neither side repeats the other."""
    e = engine(spark, sf_dir)
    spark.sql("SELECT l_orderkey AS orderkey, l_orderkey * 10 AS total_id, sum(l_quantity) AS units FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey").createOrReplaceTempView("order_totals")
    e.sql(SUMMARIES)
    return _rounded(e.query("summaries", ["large"], ["orders", "units"]))


_add("q_one_to_one", _one_to_one, "SELECT units > 100 AS large, count(*) AS orders, round(sum(units), 4) AS units FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS units FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
_add("q_union", lambda spark, sf_dir: engine(spark, sf_dir).sql("SELECT region AS name, customers FROM semantic_view('nations', dimensions := ['region'], metrics := ['customers']) UNION ALL SELECT nation, customers FROM semantic_view('nations', dimensions := ['nation'], metrics := ['customers'])"), "SELECT r_name AS name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")


def _changed(*statements: str, ask: str) -> Query:
    """Statements about the views in a catalog of their own, then a question."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.catalog.views.update({at: v for at, v in engine(spark, sf_dir).catalog.views.items() if v.name in ("sales", "order_view", "event_view", "stock", "nations", "trade")})
        for s in statements:
            e.sql(s)
        return e.sql(ask).drop("created_on")

    return run


def _values(columns: str, *rows: tuple) -> str:
    """A table of strings (and of booleans) as SQL."""
    cell = lambda x: "CAST(NULL AS VARCHAR)" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def _yaml_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view from YAML inside a statement."""
    e = engine(spark, sf_dir)
    return _changed("CREATE SEMANTIC VIEW y FROM YAML $$" + e.read_yaml("nations") + "$$", ask="SELECT * FROM semantic_view('y', dimensions := ['nation'], metrics := ['customers'])")(spark, sf_dir)


_VIEW = "database_name, schema_name, semantic_view_name"
_IN = ("spark_catalog", "main", "nations")
_LIST = f"{_VIEW}, table_name, name, data_type, synonyms, comment"
_NATION = "where the buyer's from"
_add("q_yaml_inline", _yaml_inline, "SELECT n_name AS nation, count(*) AS customers FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
_add("q_show_views", _changed(ask="SHOW SEMANTIC VIEWS LIKE '%n%' IN SCHEMA main"), _values("name, kind, database_name, schema_name, comment", ("event_view", "SEMANTIC_VIEW", "spark_catalog", "main", None), ("nations", "SEMANTIC_VIEW", "spark_catalog", "main", "people by place")))
_add("q_show_terse", _changed(ask="SHOW TERSE SEMANTIC VIEWS LIKE 'ORDER%'"), _values("name, kind, database_name, schema_name", ("order_view", "SEMANTIC_VIEW", "spark_catalog", "main")))
_add("q_show_dimensions", _changed(ask="SHOW SEMANTIC DIMENSIONS IN nations"), _values(_LIST, (*_IN, "c", "c_name", "STRING", "", None), (*_IN, "n", "nation", "STRING", "country, land", _NATION), (*_IN, "r", "region", "STRING", "", None)))
_add("q_show_metrics", _changed(ask="SHOW SEMANTIC METRICS IN nations STARTS WITH 'n' LIMIT 2"), _values(_LIST, (*_IN, "n", "nation_count", "BIGINT", "", None), (*_IN, "", "nation_rank", "INT", "", None)))
_add("q_show_facts", _changed(ask="SHOW SEMANTIC FACTS IN order_view"), _values(_LIST, ("spark_catalog", "main", "order_view", "o", "price", "DOUBLE", "", None), ("spark_catalog", "main", "order_view", "l", "qty", "DOUBLE", "", None)))
_add("q_show_dimensions_for", _changed(ask="SHOW SEMANTIC DIMENSIONS IN nations FOR METRIC running_nations"), _values("table_name, name, data_type, required, synonyms, comment", ("n", "nation", "STRING", False, "country, land", _NATION), ("r", "region", "STRING", True, "", None)))
_add("q_show_materializations", _changed(ask="SHOW SEMANTIC MATERIALIZATIONS"), _values(f'{_VIEW}, name, "table", dimensions, metrics', ("spark_catalog", "main", "sales", "by_segment", "segment_totals", "segment", "revenue, line_count")))
_COLUMNS = (
    ("flag", "STRING", "DIMENSION", "l.l_returnflag"), ("orderkey", "BIGINT", "DIMENSION", "o.o_orderkey"), ("priority", "STRING", "DIMENSION", "o.o_orderpriority"), ("segment", "STRING", "DIMENSION", "c.c_mktsegment"),
    ("price", "DOUBLE", "FACT", "o.o_totalprice"), ("qty", "DOUBLE", "FACT", "l.l_quantity"), ("balance", "DOUBLE", "METRIC", "SUM(c.c_acctbal)"), ("filled", "DOUBLE", "METRIC", "SUM(COALESCE(l.l_quantity, 99))"),
    ("line_count", "BIGINT", "METRIC", "COUNT(*)"), ("order_count", "BIGINT", "METRIC", "COUNT(*)"), ("total", "DOUBLE", "METRIC", "SUM(o.o_totalprice)"), ("units", "DOUBLE", "METRIC", "SUM(l.l_quantity)"),
)
_add("q_show_columns", _changed(ask="SHOW COLUMNS IN SEMANTIC VIEW order_view"), _values(f"{_VIEW}, column_name, data_type, kind, expression, comment", *(("spark_catalog", "main", "order_view", *r, None) for r in _COLUMNS)))
_SMALL = "CREATE SEMANTIC VIEW small COMMENT = 'as is' AS TABLES (n AS nation PRIMARY KEY (n_nationkey), r AS region PRIMARY KEY (r_regionkey)) RELATIONSHIPS (n_r AS n (n_regionkey) REFERENCES r) FACTS (PRIVATE n.doubled AS n.n_nationkey * 2) DIMENSIONS (r.region AS r.r_name LABELS = (FILTER) COMMENT = 'c') METRICS (n.m AS SUM(doubled), twice AS m * 2)"
_DESCRIBED = (
    ("SEMANTIC_VIEW", "small", None, "COMMENT", "as is"),
    *(("TABLE", a, None, p, x) for a, t, k in (("n", "nation", "n_nationkey"), ("r", "region", "r_regionkey")) for p, x in (("BASE_TABLE_DATABASE_NAME", "spark_catalog"), ("BASE_TABLE_SCHEMA_NAME", "main"), ("BASE_TABLE_NAME", t), ("PRIMARY_KEY", f'["{k}"]'))),
    *(("RELATIONSHIP", "n_r", "n", p, x) for p, x in (("TABLE", "n"), ("REF_TABLE", "r"), ("FOREIGN_KEY", '["n_regionkey"]'), ("REF_KEY", '["r_regionkey"]'))),
    *(("FACT", "doubled", "n", p, x) for p, x in (("TABLE", "n"), ("EXPRESSION", "n.n_nationkey * 2"), ("DATA_TYPE", "INT"), ("ACCESS_MODIFIER", "PRIVATE"))),
    *(("DIMENSION", "region", "r", p, x) for p, x in (("TABLE", "r"), ("EXPRESSION", "r.r_name"), ("DATA_TYPE", "STRING"), ("COMMENT", "c"), ("LABELS", '["FILTER"]'))),
    *(("METRIC", "m", "n", p, x) for p, x in (("TABLE", "n"), ("EXPRESSION", "SUM(doubled)"), ("DATA_TYPE", "BIGINT"), ("ACCESS_MODIFIER", "PUBLIC"))),
    *(("DERIVED_METRIC", "twice", "small", p, x) for p, x in (("EXPRESSION", "m * 2"), ("DATA_TYPE", "BIGINT"), ("ACCESS_MODIFIER", "PUBLIC"))),
)
_add("q_describe", _changed(_SMALL, ask="DESCRIBE SEMANTIC VIEW small"), _values("object_kind, object_name, parent_entity, property, property_value", *_DESCRIBED))
_TEXT = "CREATE OR REPLACE SEMANTIC VIEW {} AS\nTABLES (\n    n AS nation PRIMARY KEY (n_nationkey),\n    r AS region PRIMARY KEY (r_regionkey)\n)\nRELATIONSHIPS (\n    n_r AS n (n_regionkey) REFERENCES r\n)\nFACTS (\n    PRIVATE n.doubled AS n.n_nationkey * 2\n)\nDIMENSIONS (\n    r.region AS r.r_name COMMENT = 'c' LABELS = (FILTER)\n)\nMETRICS (\n    n.m AS SUM(doubled),\n    twice AS m * 2\n)\nCOMMENT = 'as is'"
_add("q_get_ddl", _changed(_SMALL, ask="SELECT GET_DDL('SEMANTIC_VIEW', 'small')"), _values("ddl", (_TEXT.format("small"),)))
_add("q_get_ddl_qualified", _changed(_SMALL, ask="SELECT upper(GET_DDL('SEMANTIC_VIEW', 'small', true)) AS d, 1 + 1 = 2 AS there"), _values("d, there", (_TEXT.format("main.small").upper(), True)))
_YAML = "tables:\n- alias: n\n  table: nation\n  primary_key:\n  - n_nationkey\n- alias: r\n  table: region\n  primary_key:\n  - r_regionkey\nrelationships:\n- name: n_r\n  from: n\n  columns:\n  - n_regionkey\n  to: r\nfacts:\n- name: doubled\n  table: n\n  expr: n.n_nationkey * 2\n  access: private\ndimensions:\n- name: region\n  table: r\n  expr: r.r_name\n  comment: c\n  labels:\n  - filter\nmetrics:\n- name: m\n  table: n\n  expr: SUM(doubled)\n- name: twice\n  expr: m * 2\ncomment: as is\n"
_add("q_read_yaml", _changed(_SMALL, ask="SELECT READ_YAML_FROM_SEMANTIC_VIEW('small')"), _values("yaml", (_YAML,)))
_add("q_drop", _changed("DROP SEMANTIC VIEW sales", "DROP SEMANTIC VIEW IF EXISTS sales", ask="SHOW TERSE SEMANTIC VIEWS STARTS WITH 's'"), _values("name, kind, database_name, schema_name", ("stock", "SEMANTIC_VIEW", "spark_catalog", "main")))
_add("q_rename", _changed("ALTER SEMANTIC VIEW nations RENAME TO places", "ALTER SEMANTIC VIEW places SET COMMENT = 'it''s new'", "ALTER SEMANTIC VIEW stock SET COMMENT = 'x'", "ALTER SEMANTIC VIEW stock UNSET COMMENT", ask="SHOW SEMANTIC VIEWS LIKE '%s' LIMIT 5"), _values("name, kind, database_name, schema_name, comment", ("places", "SEMANTIC_VIEW", "spark_catalog", "main", "it's new"), ("sales", "SEMANTIC_VIEW", "spark_catalog", "main", "order lines")))


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an explanation that don't depend on Spark's numbering: request and grains."""
    lines = engine(spark, sf_dir).explain("nations", ["region"], ["customers", "nation_count"], where="region <> 'ASIA'")
    return lines.filter("explain_output rlike '^(view|dimensions|metrics|facts|materialization|grain|  [a-z_]+ =)'")


_EXPLAINED = (
    "view: nations", "dimensions: region", "metrics: customers, nation_count", "facts: ", "materialization: none",
    "grain c: n, r; where (r.r_name) <> 'ASIA'", "  region = r.r_name", "  m_customers = COUNT(*)", "grain n: r; where (r.r_name) <> 'ASIA'", "  region = r.r_name", "  m_nation_count = COUNT(*)",
)
_add("q_explain", _explained, _values("explain_output", *((x,) for x in _EXPLAINED)))
