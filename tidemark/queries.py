"""Registered queries over the sample tables, each with equivalent SQL for comparison.

Most are a text in the dialect; the tables that it names are registered as external Parquet, so
predicates and columns reach the scan. Tables made here: `gaps` is events with NULLs in place of
some values, `keyed` is nation with some NULL keys.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import views
from .session import Engine
from .types import Column, DataType, Schema

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
GAPS_SQL = "(SELECT event_id, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS v, CASE WHEN user_id % 3 <> 0 THEN event_type END AS kind FROM events)"
NUMBERED = "(SELECT *, n_nationkey AS k, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey END AS rk FROM nation)"


class _Lazy(Engine):
    """Registers a table when a statement names it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.sf_dir = sf_dir

    def _find(self, name: str):
        found = super()._find(name)
        if found is None and name in TABLES:
            return self._external(name)
        if found is None and name == "gaps":
            events = self.spark.read.parquet(f"{self.sf_dir}/events.parquet")
            v = F.when(F.col("event_type") != "error", F.col("value")).alias("v")
            kind = F.when(F.col("user_id") % 3 != 0, F.col("event_type")).alias("kind")
            return self._add("gaps", events.select("event_id", "user_id", "event_type", v, kind))
        if found is None and name == "keyed":
            nation = self.spark.read.parquet(f"{self.sf_dir}/nation.parquet")
            return self._add("keyed", nation.select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_regionkey")).alias("rk")))
        return found

    def _external(self, name: str):
        from .sources.external import ExternalTable

        table = ExternalTable(self.spark, name, f"{self.sf_dir}/{name}.parquet")
        self.external[name] = table
        return table

    def _add(self, name: str, df: DataFrame):
        from .sources.external import FrameTable

        self.external[name] = FrameTable(name, df)
        return self.external[name]


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _Lazy(spark, sf_dir).frame(text)


#: name -> (dialect text, SQL; None where the dialect text is the SQL)
DIALECT: dict[str, tuple[str, str | None]] = {
    "scan_star": ("SELECT * FROM nation", None),
    "scan_timestamps": ("SELECT event_id, ts, value FROM events", "SELECT event_id, epoch_us(ts) // 1000 AS ts, value FROM events"),
    "project_reorder": ("SELECT n_name, n_nationkey FROM nation", None),
    "filter_eq": ("SELECT p_partkey, p_size FROM part WHERE p_size = 11", None),
    "filter_ne": ("SELECT p_partkey, p_size FROM part WHERE p_size != 11", None),
    "filter_lt": ("SELECT p_partkey, p_size FROM part WHERE p_size < 11", None),
    "filter_le": ("SELECT p_partkey, p_size FROM part WHERE p_size <= 11", None),
    "filter_gt": ("SELECT p_partkey, p_size FROM part WHERE p_size > 11", None),
    "filter_ge": ("SELECT p_partkey, p_size FROM part WHERE p_size >= 11", None),
    "filter_varchar": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", None),
    "filter_varchar_range": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'H'", None),
    "filter_float_int_literal": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45", None),
    "filter_and": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_discount < 0.05", None),
    "filter_or": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49 OR l_linenumber = 7", None),
    "filter_precedence": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49 OR l_linenumber = 1 AND l_returnflag = 'R'", None),
    "filter_parens": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 49 OR l_linenumber = 1) AND l_returnflag = 'R'", None),
    "filter_not_two_valued": ("SELECT event_id, v FROM gaps WHERE NOT v > 5", f"SELECT event_id, v FROM {GAPS_SQL} WHERE v IS NULL OR NOT (v > 5)"),
    "filter_not_demorgan": ("SELECT event_id FROM gaps WHERE NOT (v > 5 OR user_id < 10)", f"SELECT event_id FROM {GAPS_SQL} WHERE NOT coalesce(v > 5 OR user_id < 10, false)"),
    "is_null": ("SELECT event_id FROM gaps WHERE v IS NULL", f"SELECT event_id FROM {GAPS_SQL} WHERE v IS NULL"),
    "is_not_null": ("SELECT event_id, v FROM gaps WHERE v IS NOT NULL", f"SELECT event_id, v FROM {GAPS_SQL} WHERE v IS NOT NULL"),
    "filter_oversize_literal": ("SELECT p_partkey FROM part WHERE p_size < 3000000000", None),
    "sort_asc_nulls_last": ("SELECT event_id, v FROM gaps ORDER BY v, event_id", f"SELECT event_id, v FROM {GAPS_SQL} ORDER BY v ASC NULLS LAST, event_id"),
    "sort_desc_nulls_first": ("SELECT event_id, v FROM gaps ORDER BY v DESC, event_id LIMIT 300", f"SELECT event_id, v FROM {GAPS_SQL} ORDER BY v DESC NULLS FIRST, event_id LIMIT 300"),
    "sort_multi": ("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderpriority, o_orderstatus DESC, o_orderkey LIMIT 100", None),
    "sort_unprojected": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", None),
    "limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100", None),
    "limit_zero": ("SELECT o_orderkey FROM orders LIMIT 0", None),
    "offset_past_end": ("SELECT n_name FROM nation LIMIT 10 OFFSET 1000", None),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5", None),
    "agg_global": (
        "SELECT COUNT(*), COUNT(p_size), SUM(p_size), AVG(p_size), MIN(p_retailprice), MAX(p_retailprice) FROM part WHERE p_size >= 10",
        "SELECT count(*) AS count_star, count(p_size) AS count_p_size, CAST(sum(p_size) AS BIGINT) AS sum_p_size, avg(p_size) AS avg_p_size, min(p_retailprice) AS min_p_retailprice, max(p_retailprice) AS max_p_retailprice FROM part WHERE p_size >= 10",
    ),
    "agg_empty": ("SELECT COUNT(*), SUM(p_size), AVG(p_size), MIN(p_name) FROM part WHERE p_size < 0", "SELECT count(*) AS count_star, CAST(sum(p_size) AS BIGINT) AS sum_p_size, avg(p_size) AS avg_p_size, min(p_name) AS min_p_name FROM part WHERE p_size < 0"),
    "agg_varchar_minmax": ("SELECT MIN(p_name), MAX(p_name), MIN(p_brand), MAX(p_type) FROM part", "SELECT min(p_name) AS min_p_name, max(p_name) AS max_p_name, min(p_brand) AS min_p_brand, max(p_type) AS max_p_type FROM part"),
    "agg_skips_nulls": ("SELECT COUNT(*), COUNT(v), MIN(v), MAX(v) FROM gaps", f"SELECT count(*) AS count_star, count(v) AS count_v, min(v) AS min_v, max(v) AS max_v FROM {GAPS_SQL}"),
    "agg_sum_exact": ("SELECT SUM(l_orderkey), AVG(l_linenumber) FROM lineitem", "SELECT CAST(sum(l_orderkey) AS BIGINT) AS sum_l_orderkey, avg(l_linenumber) AS avg_l_linenumber FROM lineitem"),
    "group_one": ("SELECT o_orderstatus, COUNT(*), SUM(o_custkey) FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS count_star, CAST(sum(o_custkey) AS BIGINT) AS sum_o_custkey FROM orders GROUP BY 1"),
    "group_multi": ("SELECT l_returnflag, l_linestatus, COUNT(*), MAX(l_quantity) FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS count_star, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY 1, 2"),
    "group_null_key": ("SELECT kind, COUNT(*), MAX(event_id) FROM gaps GROUP BY kind", f"SELECT kind, count(*) AS count_star, max(event_id) AS max_event_id FROM {GAPS_SQL} GROUP BY 1"),
    "group_no_keys_selected": ("SELECT COUNT(*) FROM orders GROUP BY o_orderpriority", "SELECT count(*) AS count_star FROM orders GROUP BY o_orderpriority"),
    "group_interleaved": ("SELECT MIN(l_orderkey), l_linestatus, COUNT(*), l_returnflag FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT min(l_orderkey) AS min_l_orderkey, l_linestatus, count(*) AS count_star, l_returnflag FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_order_by_agg": ("SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus ORDER BY count_star DESC, o_orderstatus LIMIT 2", "SELECT o_orderstatus, count(*) AS count_star FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2"),
    "group_filter_limit": ("SELECT p_brand, COUNT(*) FROM part WHERE p_size > 20 GROUP BY p_brand ORDER BY p_brand LIMIT 7 OFFSET 2", "SELECT p_brand, count(*) AS count_star FROM part WHERE p_size > 20 GROUP BY 1 ORDER BY 1 LIMIT 7 OFFSET 2"),
    "join_inner": ("SELECT c_name, o_orderkey FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey", "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"),
    "join_reversed_on": ("SELECT n_name, r_name FROM nation INNER JOIN region ON region.r_regionkey = nation.n_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "join_where": ("SELECT c_name, o_totalprice FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey WHERE orders.o_totalprice > 200000 AND c_mktsegment = 'BUILDING'", "SELECT c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000 AND c_mktsegment = 'BUILDING'"),
    "join_order_unprojected": ("SELECT c_name FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 40", "SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 40"),
    "join_collision_labels": ("SELECT labels.doc_id, documents.doc_id, lang, quality FROM labels JOIN documents ON labels.doc_id = documents.doc_id", "SELECT l.doc_id AS labels_doc_id, d.doc_id AS documents_doc_id, lang, quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id"),
    "join_null_keys": ("SELECT n_name, r_name FROM keyed JOIN region ON keyed.rk = region.r_regionkey", f"SELECT n_name, r_name FROM {NUMBERED} JOIN region ON rk = r_regionkey"),
    "join_agg_global": ("SELECT COUNT(*), MIN(orders.o_totalprice), MAX(c_acctbal) FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey", "SELECT count(*) AS count_star, min(o_totalprice) AS min_orders_o_totalprice, max(c_acctbal) AS max_c_acctbal FROM customer JOIN orders ON c_custkey = o_custkey"),
    "join_agg_group": ("SELECT c_mktsegment, COUNT(*), MIN(orders.o_totalprice) FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS count_star, min(o_totalprice) AS min_orders_o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "join_agg_group_order": ("SELECT customer.c_mktsegment, COUNT(*) FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey GROUP BY customer.c_mktsegment ORDER BY count_star DESC, c_mktsegment LIMIT 3", "SELECT c_mktsegment, count(*) AS count_star FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "bench_w1": ("SELECT * FROM lineitem", "SELECT * REPLACE (epoch_us(l_shipdate) // 1000 AS l_shipdate) FROM lineitem"),
    "bench_w2": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 701", None),
    "bench_w4": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey >= 500 AND l_orderkey <= 1250", None),
    "bench_w6": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25", None),
    "bench_w8": ("SELECT COUNT(*), SUM(l_partkey), AVG(l_partkey), MIN(l_partkey), MAX(l_partkey) FROM lineitem", "SELECT count(*) AS count_star, CAST(sum(l_partkey) AS BIGINT) AS sum_l_partkey, avg(l_partkey) AS avg_l_partkey, min(l_partkey) AS min_l_partkey, max(l_partkey) AS max_l_partkey FROM lineitem"),
    "bench_w9": ("SELECT l_linenumber, COUNT(*), AVG(l_suppkey) FROM lineitem GROUP BY l_linenumber ORDER BY l_linenumber", "SELECT l_linenumber, count(*) AS count_star, avg(l_suppkey) AS avg_l_suppkey FROM lineitem GROUP BY 1"),
    "bench_w10": ("SELECT c_custkey, n_name FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
}


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share; elsewhere only if Spark is local. Deleted at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    path = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"

    def clear() -> None:
        if spark.sparkContext._jsc is not None:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def at_exit() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            clear()

    atexit.register(at_exit)
    return path


#: Engines over a copy of orders, by session and folder of the tables.
_INDEXED: dict[tuple[str, str], Engine] = {}


def _orders(spark: SparkSession, sf_dir: str) -> Engine:
    """Orders copied in order of key to a managed table, indexed by key; made once."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXED:
        engine = Engine(spark, _folder(spark))
        columns = (Column("o_orderkey", DataType.BIGINT), Column("o_custkey", DataType.BIGINT), Column("o_orderstatus", DataType.VARCHAR, max_length=8), Column("o_totalprice", DataType.FLOAT), Column("o_orderpriority", DataType.VARCHAR, max_length=32))
        engine.create_table("orders", Schema(columns)).append(spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderkey"))
        engine.create_index("by_key", "orders", "o_orderkey")
        _INDEXED[at] = engine
    return _INDEXED[at]


#: Over orders as an indexed managed table: name -> (dialect text, SQL; None where the dialect text is the SQL)
INDEXED: dict[str, tuple[str, str | None]] = {
    "index_eq": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 500", None),
    "index_range": ("SELECT o_orderkey FROM orders WHERE o_orderkey >= 14000", None),
    "index_two_sided": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 5000 AND o_orderkey <= 5500", None),
    "limit_in_scan_order": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 LIMIT 40 OFFSET 10", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 40 OFFSET 10"),
    "bench_w3": ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 700", None),
    "bench_w5": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 500 AND o_orderkey <= 1250", None),
    "bench_w7": ("SELECT o_orderkey, o_orderpriority FROM orders LIMIT 25", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 25"),
}


def _indexed(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _orders(spark, sf_dir)
        if " LIMIT " not in text:
            return engine.frame(text)
        found = engine.execute(text)  # stops at the first rows
        return spark.createDataFrame([tuple(r) for r in found.rows], T.StructType([T.StructField(c.name, c.type.spark) for c in found.columns]))

    return run


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Customers copied to a managed table of a new engine, in the shared folder if there is one."""
    engine = Engine(spark, _folder(spark))
    columns = (Column("c_custkey", DataType.BIGINT), Column("c_name", DataType.VARCHAR, max_length=64), Column("c_nationkey", DataType.INTEGER), Column("c_acctbal", DataType.FLOAT), Column("c_mktsegment", DataType.VARCHAR, max_length=32))
    engine.create_table("customer", Schema(columns)).append(spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return engine


def _managed(spark: SparkSession, sf_dir: str, statements: list[str], result: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    for s in statements:
        engine.execute(s)
    return engine.frame(result)


def _copy(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine with the copied customers, indexed by key and by segment."""
    engine = _engine(spark, sf_dir)
    engine.create_index("by_key", "customer", "c_custkey")
    engine.create_index("by_segment", "customer", "c_mktsegment")
    return engine


def _point_get(spark, sf_dir):
    t = _copy(spark, sf_dir).get_table("customer")
    rid = t.search("by_key", 77)[0]
    return spark.createDataFrame([t.get(rid)], t.schema.struct())


def _table_count(spark, sf_dir):
    return spark.createDataFrame([(_copy(spark, sf_dir).get_table("customer").count(),)], "n long")


def _range_search(spark, sf_dir):
    t = _copy(spark, sf_dir).get_table("customer")
    return t.range_frame("by_key", 100, 900, False, True).select("c_custkey", "c_name")


def _profiles(spark, sf_dir):
    engine, rows = _copy(spark, sf_dir), []
    for name, sql in (("scan", "SELECT c_name FROM customer WHERE c_nationkey = 3"), ("index", "SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")):
        p = engine.execute_profiled(sql).profile
        n = p.metrics.tuples_examined if p.access_path == "TableScan" else p.metrics.rids_selected
        rows.append((name, p.access_path, p.index_name, n))
    return spark.createDataFrame(rows, "query string, access_path string, index_name string, n long")


def _table_api(spark, sf_dir):
    from .operators.changes import delete_row, update_row

    t = _copy(spark, sf_dir).get_table("customer")
    t.insert_many([(-5, "five", 1, 0.5, "X"), (-6, "six", 1, 0.5, "X")])
    update_row(t, t.search("by_key", -5)[0], (-5, "cinq", 2, 1.5, "Y"))
    delete_row(t, t.search("by_key", -6)[0])
    return t.frame()[0].drop("__rid")


def _float_sums(spark, sf_dir):
    """Sums and averages of FLOAT, to six digits after the point: the order of addition is free."""
    return _Lazy(spark, sf_dir).frame("SELECT l_linestatus, SUM(l_quantity), AVG(l_discount), SUM(l_extendedprice) FROM lineitem GROUP BY l_linestatus").selectExpr("l_linestatus", "sum_l_quantity", "round(avg_l_discount, 6) as avg_l_discount", "round(sum_l_extendedprice, 2) as sum_l_extendedprice")


def _made_and_dropped(spark, sf_dir):
    """Tables that CREATE and DROP texts leave, and what the condition of a profile says."""
    engine, rows = _engine(spark, sf_dir), []
    for text in ("CREATE TABLE notes (id INTEGER, body VARCHAR(20))", "INSERT INTO notes VALUES (1, 'first')", "CREATE TABLE spare (id BIGINT)", "DROP TABLE spare"):
        rows.append((text.split(" ")[0], engine.execute(text).affected_rows, len(engine.list_tables())))
    engine.create_index("by_id", "notes", "id")
    p = engine.execute_profiled("SELECT body FROM notes WHERE id <= 1").profile
    rows.append((f"{p.condition.column_name} {p.condition.operator} {p.condition.literal}", p.metrics.rids_selected, len(engine.list_tables())))
    return spark.createDataFrame(rows, "what string, n long, tables long")


SINGLE: dict[str, tuple] = {
    "agg_float": (_float_sums, "SELECT l_linestatus, sum(l_quantity) AS sum_l_quantity, round(avg(l_discount), 6) AS avg_l_discount, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem GROUP BY 1"),
    "ddl_and_condition": (_made_and_dropped, "SELECT * FROM (VALUES ('CREATE', 0::BIGINT, 2::BIGINT), ('INSERT', 1, 2), ('CREATE', 0, 3), ('DROP', 0, 2), ('id <= 1', 1, 2)) AS t(what, n, tables)"),
    "table_point_get": (_point_get, "SELECT * FROM customer WHERE c_custkey = 77"),
    "table_count": (_table_count, "SELECT count(*) AS n FROM customer"),
    "index_scan_range": (_range_search, "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 AND c_custkey <= 900"),
    "profile_access_paths": (_profiles, "SELECT 'scan' AS query, 'TableScan' AS access_path, CAST(NULL AS VARCHAR) AS index_name, count(*) AS n FROM customer UNION ALL SELECT 'index', 'IndexScan', 'by_segment', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "table_rows_by_ordinal": (_table_api, "SELECT * FROM customer UNION ALL SELECT -5, 'cinq', 2, 1.5, 'Y'"),
}

ALL = "SELECT * FROM customer"
CHANGES = {
    "dml_insert": (["INSERT INTO customer VALUES (-1, 'O''Neil', 3, 1.5, 'NEW')", "INSERT INTO customer VALUES (-2, '', 4, -2.0, 'NEW')"], "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL VALUES (-1, 'O''Neil', 3, 1.5, 'NEW'), (-2, '', 4, -2.0, 'NEW')"),
    "dml_update": (["UPDATE customer SET c_mktsegment = 'LOW', c_nationkey = 0 WHERE c_acctbal < 0"], "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_nationkey END AS c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'LOW' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "dml_delete": (["DELETE FROM customer WHERE NOT c_mktsegment = 'BUILDING' AND c_nationkey > 3"], "SELECT * FROM customer WHERE NOT (c_mktsegment <> 'BUILDING' AND c_nationkey > 3)"),
    "dml_update_snapshot": (["UPDATE customer SET c_nationkey = 7 WHERE c_nationkey = 6", "UPDATE customer SET c_nationkey = 8 WHERE c_nationkey = 7"], "SELECT * REPLACE (CAST(CASE WHEN c_nationkey IN (6, 7) THEN 8 ELSE c_nationkey END AS INTEGER) AS c_nationkey) FROM customer"),
}


def _tracker(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The sample tables in the part of a task tracker: nations are workspaces, customers projects, orders tasks."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    orders = read("orders")
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("TODO")
    tasks = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("project_id"),
        F.col("o_orderpriority").alias("title"),
        status.alias("status"),
        F.when(F.col("o_totalprice") > 200000, "HIGH").otherwise("LOW").alias("priority"),
        (F.col("o_orderkey") % 3).alias("assignee_user_id"),
        F.col("o_custkey").alias("updated_at"),
    )
    due = orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("task_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("due_date"))
    nation = read("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    members = nation.where("id % 2 = 0").select(F.col("id").alias("workspace_id"), F.lit(1).cast("long").alias("user_id"), F.lit("MEMBER").alias("role"))
    projects = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("workspace_id"), F.col("c_name").alias("name"))
    users = spark.createDataFrame([(0, "zero"), (1, "one"), (2, "two")], "id long, name string")
    events = read("events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    activity = events.select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("task_id"), (F.col("user_id") % 25).alias("workspace_id"), F.col("event_type"), ms.alias("created_at"))
    notes = events.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 7).alias("recipient_user_id"),
        "event_type",
        F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 25).alias("workspace_id"),
        F.lit(None).cast("long").alias("project_id"),
        F.when(F.col("user_id") % 4 != 0, -F.col("user_id")).alias("task_id"),
        ms.alias("created_at"),
        (F.col("event_id") % 2 == 0).alias("is_read"),
        F.when(F.col("event_id") % 3 == 0, ms).alias("dismissed_at"),
    )
    return {"task_activity": activity, "notifications": notes, "tasks": tasks, "task_due_dates": due, "workspaces": nation, "workspace_members": members, "projects": projects, "users": users}


TRACKER_SQL = """WITH tasks AS (SELECT o_orderkey AS id, o_custkey AS project_id, o_orderpriority AS title, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'TODO' END AS status,
 CASE WHEN o_totalprice > 200000 THEN 'HIGH' ELSE 'LOW' END AS priority, o_orderkey % 3 AS assignee_user_id, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS due_date,
 o_custkey AS updated_at, c_name AS project_name, n_name AS workspace_name, c_nationkey AS workspace_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0) """
TODAY = "1996-06-30"


def _view_dashboard(spark, sf_dir):
    return views.dashboard(_tracker(spark, sf_dir), 1, TODAY)


def _view_tasks(spark, sf_dir):
    found = views.accessible_tasks(_tracker(spark, sf_dir), 1, query="urg", status="TODO", due_after="1994-01-01")
    return views.page(found, "title", 100, 5, 100).select("id", "title", "due_date", "workspace_name")


def _view_page(spark, sf_dir):
    df, _ = views.assigned_tasks(_tracker(spark, sf_dir), 1, limit=60, offset=20)
    return df.select("id", "updated_at", "project_name", "workspace_name", "assignee_name")


def _view_due_desc(spark, sf_dir):
    return views.page(views.accessible_tasks(_tracker(spark, sf_dir), 1, workspace=2), "due_desc", 100, 0, 100).select("id", "due_date")


def _view_progress(spark, sf_dir):
    return views.project_progress(_tracker(spark, sf_dir))


def _view_project_tasks(spark, sf_dir):
    t = _tracker(spark, sf_dir)
    return views.tasks_of_project(t, 37, sort="due_asc", limit=200).select("id", "status", "due_date")


def _view_accessible(spark, sf_dir):
    return views.accessible_tasks(_tracker(spark, sf_dir), 1, priority="HIGH").select("id", "project_name", "assignee_name")


def _view_workspaces(spark, sf_dir):
    return views.workspaces_of(_tracker(spark, sf_dir), 1)


def _view_activity(spark, sf_dir):
    return views.activity(_tracker(spark, sf_dir), 7).select("id", "event_type", "created_at")


def _view_notifications(spark, sf_dir):
    return views.notifications(_tracker(spark, sf_dir), 1, unread=True).select("id", "workspace_id", "task_id", "created_at")


def _view_all_read(spark, sf_dir):
    return views.all_read(_tracker(spark, sf_dir), 1).groupBy("is_read").agg(F.count(F.lit(1)).alias("n"))


def _view_next_id(spark, sf_dir):
    t = _tracker(spark, sf_dir)
    return spark.createDataFrame([(views.next_id((t["tasks"], "id"), (t["task_activity"], "task_id")),)], "next_id long")


def _view_changes(spark, sf_dir):
    t = _tracker(spark, sf_dir)
    before = t["tasks"].select("id", "title", "status", "priority", "assignee_user_id")
    done = F.when(F.col("id") % 10 == 0, "DONE").when(F.col("id") % 10 == 1, "TODO").otherwise(F.col("status"))
    return views.task_changes(before, before.withColumns({"status": done, "assignee_user_id": F.when(F.col("id") % 5 != 0, F.col("assignee_user_id"))}))


def _view_member_leaves(spark, sf_dir):
    left = views.without_member(_tracker(spark, sf_dir), 4, 1)
    return left["tasks"].groupBy("assignee_user_id").agg(F.count(F.lit(1)).alias("n"))


def _view_member_audit(spark, sf_dir):
    told = views.without_member(_tracker(spark, sf_dir), 4, 1, actor=2, now=5)["task_activity"]
    return told.where("event_type = 'ASSIGNEE_CHANGED'").select("id", "task_id", "workspace_id", "created_at")


def _counts(**tables: DataFrame) -> DataFrame:
    """One row: the rows of each table."""
    rows = [df.agg(F.count(F.lit(1)).alias(n)) for n, df in tables.items()]
    return reduce(DataFrame.crossJoin, rows)  # one row each


def _view_task_deleted(spark, sf_dir):
    t = views.without_task(_tracker(spark, sf_dir), 7, now=5)
    return _counts(tasks=t["tasks"], dated=t["task_due_dates"], activity=t["task_activity"].where("task_id = 7"), told=t["task_activity"].where("event_type = 'TASK_DELETED' and created_at = 5"))


def _view_workspace_deleted(spark, sf_dir):
    t = views.without_workspace(_tracker(spark, sf_dir), 4)
    return _counts(workspaces=t["workspaces"], members=t["workspace_members"], activity=t["task_activity"], notifications=t["notifications"])


VIEWS = {
    "view_project_tasks": (_view_project_tasks, TRACKER_SQL.replace(" WHERE n_nationkey % 2 = 0", "") + "SELECT id, status, due_date FROM tasks WHERE project_id = 37"),
    "view_accessible_tasks": (_view_accessible, TRACKER_SQL + "SELECT id, project_name, CASE assignee_user_id WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'two' END AS assignee_name FROM tasks WHERE priority = 'HIGH'"),
    "view_workspaces": (_view_workspaces, "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0"),
    "view_activity": (_view_activity, "SELECT event_id AS id, event_type, epoch_us(ts) // 1000 AS created_at FROM events WHERE user_id % 50 = 7"),
    "view_notifications": (
        _view_notifications,
        """SELECT event_id AS id, CASE WHEN user_id % 4 <> 0 THEN user_id % 25 END AS workspace_id, CAST(NULL AS BIGINT) AS task_id, epoch_us(ts) // 1000 AS created_at FROM events
 WHERE user_id % 7 = 1 AND event_id % 2 <> 0 AND event_id % 3 <> 0 AND (user_id % 4 = 0 OR user_id % 25 % 2 = 0)""",
    ),
    "view_all_read": (_view_all_read, "SELECT (event_id % 2 = 0) OR (user_id % 7 = 1 AND event_id % 3 <> 0) AS is_read, count(*) AS n FROM events GROUP BY 1"),
    "view_next_id": (_view_next_id, "SELECT greatest((SELECT max(o_orderkey) FROM orders), (SELECT max(user_id % 50) FROM events)) + 1 AS next_id"),
    "view_task_changes": (
        _view_changes,
        """WITH t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'TODO' END AS status FROM orders),
 n AS (SELECT id, status, CASE id % 10 WHEN 0 THEN 'DONE' WHEN 1 THEN 'TODO' ELSE status END AS later FROM t)
 SELECT id AS task_id, CASE WHEN later = 'DONE' THEN 'TASK_COMPLETED' WHEN status = 'DONE' THEN 'TASK_REOPENED' ELSE 'STATUS_CHANGED' END AS event_type, 'status' AS field, status AS old, later AS new FROM n WHERE status <> later
 UNION ALL SELECT id, 'ASSIGNEE_CHANGED', 'assignee_user_id', CAST(id % 3 AS VARCHAR), NULL FROM t WHERE id % 5 = 0""",
    ),
    "view_member_leaves": (_view_member_leaves, "SELECT CASE WHEN o_orderkey % 3 = 1 AND c_nationkey = 4 THEN NULL ELSE o_orderkey % 3 END AS assignee_user_id, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "view_task_deleted": (_view_task_deleted, "SELECT (SELECT count(*) FROM orders WHERE o_orderkey <> 7) AS tasks, (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey <> 7) AS dated, (SELECT count(*) FROM events WHERE user_id % 50 = 7) + 1 AS activity, 1::BIGINT AS told"),
    "view_member_audit": (
        _view_member_audit,
        "SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey AS task_id, 4::BIGINT AS workspace_id, 5::BIGINT AS created_at FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 4 AND o_orderkey % 3 = 1",
    ),
    "view_workspace_deleted": (
        _view_workspace_deleted,
        "SELECT (SELECT count(*) FROM nation WHERE n_nationkey <> 4) AS workspaces, (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey <> 4) AS members, (SELECT count(*) FROM events WHERE user_id % 25 <> 4) AS activity, (SELECT count(*) FROM events WHERE user_id % 4 = 0 OR user_id % 25 <> 4) AS notifications",
    ),
    "view_dashboard": (
        _view_dashboard,
        TRACKER_SQL + f"""SELECT (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0) AS workspace_count, (SELECT count(*) FROM customer WHERE c_nationkey % 2 = 0) AS project_count, count(*) AS task_count,
 count(*) FILTER (assignee_user_id = 1) AS assigned_to_me, count(*) FILTER (status <> 'DONE' AND due_date < '{TODAY}') AS overdue_count, count(*) FILTER (status <> 'DONE' AND due_date >= '{TODAY}') AS upcoming_count,
 count(*) FILTER (status = 'DONE') AS completed_count, count(*) FILTER (status = 'DONE') AS status_done, count(*) FILTER (status = 'IN_PROGRESS') AS status_in_progress, count(*) FILTER (status = 'TODO') AS status_todo,
 count(*) FILTER (priority = 'HIGH') AS priority_high, count(*) FILTER (priority = 'LOW') AS priority_low, count(*) FILTER (priority = 'MEDIUM') AS priority_medium FROM tasks""",
    ),
    "view_tasks_filter_sort": (_view_tasks, TRACKER_SQL + "SELECT id, title, due_date, workspace_name FROM tasks WHERE contains(lower(title), 'urg') AND status = 'TODO' AND due_date >= '1994-01-01' ORDER BY lower(title), id LIMIT 100 OFFSET 5"),
    "view_semi_join_page": (_view_page, TRACKER_SQL + "SELECT id, updated_at, project_name, workspace_name, 'one' AS assignee_name FROM tasks WHERE assignee_user_id = 1 ORDER BY updated_at DESC, id DESC LIMIT 60 OFFSET 20"),
    "view_due_desc_nulls_last": (_view_due_desc, TRACKER_SQL + "SELECT id, due_date FROM tasks WHERE workspace_id = 2 ORDER BY due_date DESC NULLS LAST, id DESC LIMIT 100"),
    "view_project_progress": (
        _view_progress,
        """SELECT o_custkey AS project_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'F') AS done_tasks, count(*) FILTER (o_orderstatus = 'P') AS in_progress_tasks,
 count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS todo_tasks, CAST(floor(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) + 0.5) AS BIGINT) AS percent FROM orders GROUP BY 1""",
    ),
}


def _changed(statements: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _managed(spark, sf_dir, statements, ALL)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _sql(text) for n, (text, _) in DIALECT.items()} | {n: _indexed(text) for n, (text, _) in INDEXED.items()} | {n: _changed(s) for n, (s, _) in CHANGES.items()} | {n: f for n, (f, _) in (VIEWS | SINGLE).items()}
ORACLE_SQL: dict[str, str] = {n: sql or text for n, (text, sql) in (DIALECT | INDEXED).items()} | {n: sql for n, (_, sql) in CHANGES.items()} | {n: sql for n, (_, sql) in (VIEWS | SINGLE).items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Lazy(spark, sf_dir).frame("SELECT c_mktsegment, COUNT(*), SUM(o_orderkey), AVG(orders.o_totalprice) FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment")
