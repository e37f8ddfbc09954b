"""Queries over the array stores and tables, one for each operator or family, with the same in SQL over the tables.

A query is a text of SQL over views. For Spark the views are scans of stores (or the tables themselves); for DuckDB they are
common table expressions over the tables. Texts that both read alike are given once.
"""



from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom import functions as G
from gridloom import session
from gridloom.operators.joins import range_join
from gridloom.plans.fixtures import scan, store, table
from gridloom.streaming.batches import iter_batches

#: What each store holds, in SQL over the tables.
VIEWS = {
    "li": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, epoch_us(l_shipdate) AS l_shipdate_us FROM lineitem",
    "grid": "SELECT suppkey, linenumber, coalesce(qty, 0) AS qty, coalesce(price, 0) AS price FROM (SELECT DISTINCT l_suppkey AS suppkey FROM lineitem) CROSS JOIN (SELECT DISTINCT l_linenumber AS linenumber FROM lineitem) LEFT JOIN (SELECT l_suppkey AS suppkey, l_linenumber AS linenumber, sum(l_quantity) AS qty, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2) USING (suppkey, linenumber)",
    "cube": "SELECT month, suppkey, linenumber, coalesce(n, 0) AS n FROM (SELECT DISTINCT CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS month FROM lineitem) CROSS JOIN (SELECT DISTINCT l_suppkey AS suppkey FROM lineitem) CROSS JOIN (SELECT DISTINCT l_linenumber AS linenumber FROM lineitem) LEFT JOIN (SELECT CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS month, l_suppkey AS suppkey, l_linenumber AS linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) USING (month, suppkey, linenumber)",
    "emb": "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, unnest(embedding) AS value FROM embeddings",
    "ev": "SELECT hour, etype, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM (SELECT DISTINCT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events) CROSS JOIN (SELECT DISTINCT ascii(event_type) AS etype FROM events) LEFT JOIN (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, ascii(event_type) AS etype, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2) USING (hour, etype)",
    "pt": "SELECT p_partkey, p_size % 2 = 0 AS c_bool, CAST(p_size AS TINYINT) AS c_i8, CAST(p_partkey % 1000 AS SMALLINT) AS c_i16, p_size AS c_i32, -p_partkey AS c_i64, CAST(p_size AS SMALLINT) AS c_u8, CAST(p_partkey % 60000 AS INTEGER) AS c_u16, p_partkey * 100000 AS c_u32, CAST(p_partkey * 1000000000000 AS DECIMAL(20, 0)) AS c_u64, CAST(CAST(p_size AS FLOAT) / 4 AS FLOAT) AS c_f32, p_retailprice AS c_f64, p_name AS c_str FROM part",
    "b": "SELECT CAST(range AS BIGINT) AS var1, CAST(range AS BIGINT) AS var2, CAST(range AS BIGINT) AS var3, CAST(range AS BIGINT) AS var4, CAST(range AS BIGINT) AS var5, CAST(range AS BIGINT) AS var6, CAST(range AS BIGINT) AS var7, CAST(range AS BIGINT) AS var8 FROM range(262144)",
    "geo": "SELECT CAST(8 * a.range + o.range AS DOUBLE) AS data, CAST(35 + a.range AS DOUBLE) AS lat, CAST(-120 + o.range AS DOUBLE) AS lon FROM range(8) a, range(8) o",
}
_STORES = {"li": "flat_lineitem", "grid": "grid", "cube": "cube", "emb": "emb", "ev": "events", "pt": "types_part", "b": "bench", "geo": "lat_lon"}
_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
Build = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Build] = {}
_ORACLE: dict[str, str] = {}


def _words(text: str) -> set[str]:
    return set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())


def _oracle(name: str, text: str) -> None:
    used = [v for v in VIEWS if v in _words(text)]
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = text.strip()
    if not used:
        _ORACLE[name] = body
    elif body.upper().startswith("WITH "):
        _ORACLE[name] = f"WITH {views}, {body[5:]}"
    else:
        _ORACLE[name] = f"WITH {views} {body}"


def _sql(name: str, text: str, duck: str | None = None, views: dict[str, dict] | None = None) -> None:
    """A query in SQL. views: options for the scans of some views, such as columns."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = _words(text)
        for v, s in _STORES.items():
            if v in words:
                scan(spark, sf_dir, s, **(views or {}).get(v, {})).createOrReplaceTempView(v)
        for t in _TABLES:
            if t in words:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return session.sql(spark, text)

    _QUERIES[name] = build
    _oracle(name, duck or text)


def _code(name: str, duck: str | None):
    def keep(build: Build) -> Build:
        _QUERIES[name] = lambda spark, sf_dir: session.prune(build(spark, sf_dir))
        if duck:
            _oracle(name, duck)
        return build

    return keep


# Scans: sources, types, array-to-relation operators (R01-R48)

_sql("scan_flat_zip", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate_us FROM li")
_sql("scan_strings", "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM li")
_sql("scan_all_types", "SELECT p_partkey, c_bool, c_i8, c_i16, c_i32, c_i64, c_u8, c_u16, c_u32, CAST(c_u64 AS DOUBLE) AS c_u64, c_f32, c_f64, c_str FROM pt")
_sql("grid2d_broadcast", "SELECT suppkey, linenumber, round(qty, 2) AS qty, round(price, 2) AS price FROM grid")
_sql("grid3d_broadcast", "SELECT month, suppkey, linenumber, n FROM cube")
_sql("coords_cross", "SELECT suppkey, linenumber FROM grid", views={"grid": {"columns": ["suppkey", "linenumber"]}})
_sql("single_coord", "SELECT suppkey FROM grid", "SELECT DISTINCT suppkey FROM grid", views={"grid": {"columns": ["suppkey"]}})
_sql("partial_coord", "SELECT linenumber, round(qty, 2) AS qty FROM grid", views={"grid": {"columns": ["qty", "linenumber"]}})
_sql("fill_missing_chunks", "SELECT hour, etype, n, round(total, 2) AS total FROM ev")
_sql("embeddings_long", "SELECT vec_id, dim, value FROM emb")
_sql("range_all_float32", "SELECT dim, count(*) AS n, min(value) AS low, max(value) AS high FROM emb GROUP BY dim")


@_code("mixed_rank_coord", "SELECT suppkey, linenumber, round(qty, 2) AS qty, round(price, 2) AS price FROM grid")
def _(spark, sf_dir):
    return scan(spark, sf_dir, "grid_mixed").select("suppkey", "linenumber", F.round("qty", 2).alias("qty"), F.round("price", 2).alias("price"))


@_code("ddl_declared_schema", "SELECT linenumber, suppkey, round(qty, 2) AS qty FROM grid")
def _(spark, sf_dir):
    path = store(spark, sf_dir, "grid")
    session.sql(spark, f"CREATE EXTERNAL TABLE declared_grid(linenumber int, suppkey bigint, qty double) STORED AS ZARR_STORE LOCATION '{path}'")
    return session.sql(spark, "SELECT linenumber, suppkey, round(qty, 2) AS qty FROM declared_grid")


@_code("register_zarr_view", "SELECT count(*) AS n, CAST(sum(linenumber) AS BIGINT) AS s FROM grid")
def _(spark, sf_dir):
    session.register_zarr(spark, "registered_grid", store(spark, sf_dir, "grid"))
    return spark.sql("SELECT count(*) AS n, sum(linenumber) AS s FROM registered_grid")


@_code("partitioned_scan", "SELECT suppkey, count(*) AS n, round(sum(qty), 2) AS qty FROM grid GROUP BY suppkey")
def _(spark, sf_dir):
    df = scan(spark, sf_dir, "grid", partitions=20)
    return df.groupBy("suppkey").agg(F.count("*").alias("n"), F.round(F.sum("qty"), 2).alias("qty"))


@_code("chunk_stream", "SELECT CAST(count(*) AS BIGINT) AS n, sum(data) AS s FROM geo WHERE lat < 38.1 AND lon > -116.9")
def _(spark, sf_dir):
    """The plain generator with a custom chunk predicate, in one task for each of two partitions."""
    path = store(spark, sf_dir, "lat_lon")

    def run(batches):
        import pyarrow.compute as pc

        for b in batches:
            for part in b.column("id").to_pylist():
                yield from iter_batches(path, ["data", "lat", "lon"], 2, part, lambda r: pc.and_(pc.less(r["lat"], 38.1), pc.greater(r["lon"], -116.9)).to_numpy(zero_copy_only=False))

    rows = spark.range(0, 2, 1, 2).mapInArrow(run, "data double, lat double, lon double")
    return rows.where("lat < 38.1 and lon > -116.9").agg(F.count("*").alias("n"), F.sum("data").alias("s"))


# Filters (R40-R48, T49-I51)

_sql("filter_coord", "SELECT suppkey, linenumber, round(qty, 2) AS qty FROM grid WHERE suppkey <= 20 AND linenumber > 2")
_sql("filter_data", "SELECT l_orderkey, l_linenumber, l_quantity FROM li WHERE l_quantity >= 45 AND l_discount < 0.02")
_sql("filter_or", "SELECT suppkey, linenumber FROM grid WHERE suppkey < 5 OR linenumber = 7")
_sql("filter_col_vs_col", "SELECT l_orderkey, l_linenumber FROM li WHERE l_discount > l_tax AND l_orderkey > l_partkey")
_sql("filter_only_cols", "SELECT suppkey FROM grid WHERE suppkey < 9")
_sql("filter_float_golden", "SELECT lat, lon, data FROM geo WHERE lat < 38.1 AND lon > -116.9")
_sql("filter_strings", "SELECT l_orderkey, l_linenumber, l_returnflag FROM li WHERE l_returnflag = 'R' AND l_linestatus LIKE 'F%'")
_sql("filter_in_between", "SELECT suppkey, linenumber, round(qty, 2) AS qty FROM grid WHERE suppkey IN (1, 3, 5, 99) AND linenumber BETWEEN 2 AND 4")
_sql("filter_not_null_distinct", "SELECT suppkey, linenumber FROM grid WHERE NOT (suppkey > 3) AND qty IS NOT NULL AND linenumber IS DISTINCT FROM 2")
_sql("filter_regex_case", "SELECT p_partkey, CASE WHEN c_i32 > 25 THEN 'large' WHEN c_i32 > 10 THEN 'middle' ELSE 'small' END AS class FROM pt WHERE regexp_like(c_str, '[aeiou]{2}') OR c_str ILIKE '%RED%'", "SELECT p_partkey, CASE WHEN c_i32 > 25 THEN 'large' WHEN c_i32 > 10 THEN 'middle' ELSE 'small' END AS class FROM pt WHERE regexp_matches(c_str, '[aeiou]{2}') OR c_str ILIKE '%RED%'")
_sql("filter_exists", "SELECT s_suppkey, s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM grid g WHERE g.suppkey = s.s_suppkey AND g.qty > 500)")
_sql("filter_in_subquery", "SELECT p_partkey, c_str FROM pt WHERE p_partkey IN (SELECT l_partkey FROM li WHERE l_quantity = 50)")
_sql("filter_uint64", "SELECT p_partkey FROM pt WHERE c_u64 > 500000000000000 AND c_u8 < 10")
_sql("count_star", "SELECT count(*) AS n FROM grid")

# Projections and expressions (T60-I64)

_sql("project_alias_arithmetic", "SELECT suppkey AS s, linenumber AS l, round(qty * 2 + 1, 2) AS q2, round(price - qty, 2) AS rest, suppkey % 7 AS m FROM grid")
_sql("qualified_star", "SELECT g.*, 1 AS one FROM (SELECT suppkey, linenumber FROM grid) g")
_sql("cte_self_join", "WITH t1 AS (SELECT lat, lon, data FROM geo), t2 AS (SELECT lat, lon, data * 2 AS data2 FROM geo) SELECT t1.lat, t1.lon, t1.data, t2.data2 FROM t1 JOIN t2 ON t1.lat = t2.lat AND t1.lon = t2.lon")
_sql("casts_coalesce", "SELECT p_partkey, CAST(c_i32 AS STRING) AS s, CAST(CAST(c_i32 AS STRING) AS BIGINT) AS back, try_cast(c_str AS INT) AS none, coalesce(nullif(c_i32, 1), -1) AS c, -c_i32 AS neg, c_i32 & 6 AS a, c_i32 | 6 AS o, concat(c_str, '!') AS cat FROM pt")

# Joins (T70-I77)

_sql("range_join_sql_small", "SELECT a.lat AS a, b.lat AS b, count(*) AS n FROM geo a JOIN geo b ON a.lat < b.lat + 1 AND a.lat >= b.lat - 1 GROUP BY a.lat, b.lat")
_BENCH = ", ".join(f"t1.var{i} AS a{i}, t2.var{i} AS b{i}" for i in range(1, 9))


#: Whole numbers in (x - 1, x + 1] are x and x + 1: two equi-joins, where the range would be a nested loop.
@_code("range_join", " UNION ALL ".join(f"SELECT {_BENCH} FROM b t1 JOIN b t2 ON t2.var1 = t1.var1 + {d} WHERE t1.var1 % 12 = 0" for d in (0, 1)))
def _(spark, sf_dir):
    df = scan(spark, sf_dir, "bench")
    pairs = range_join(df.where("var1 % 12 = 0"), df, "var1", "var1", 1, 1).where("__l.var1 < __r.var1 + 1 AND __l.var1 >= __r.var1 - 1")
    return pairs.select(*[F.col(f"{s}.var{i}").alias(f"{n}{i}") for i in range(1, 9) for s, n in (("__l", "a"), ("__r", "b"))])


_sql("union_all", "SELECT * FROM b UNION ALL SELECT * FROM b")
_sql("join_inner", "SELECT s.s_name, g.linenumber, round(g.qty, 2) AS qty FROM grid g JOIN supplier s ON g.suppkey = s.s_suppkey WHERE g.linenumber = 1")
_sql("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000")
_sql("join_right", "SELECT o.o_orderkey, c.c_name FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000")
_sql("join_full", "SELECT a.suppkey AS a, b.s_suppkey AS b FROM (SELECT suppkey FROM grid GROUP BY suppkey HAVING max(linenumber) > 0 AND sum(qty) > 15000) a FULL OUTER JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) b ON a.suppkey = b.s_suppkey")
_sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
_sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("join_natural_using", "SELECT * FROM (SELECT DISTINCT suppkey FROM grid) NATURAL JOIN (SELECT s_suppkey AS suppkey, s_nationkey FROM supplier)")
_sql("join_using", "SELECT lat, lon, a.data AS x, b.data AS y FROM geo a JOIN geo b USING (lat, lon)")
_sql("join_hints", "SELECT /*+ MERGE(o) */ c.c_mktsegment, count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment")
_sql("join_lateral", "SELECT s.s_suppkey, t.linenumber, round(t.qty, 2) AS qty FROM supplier s, LATERAL (SELECT linenumber, qty FROM grid WHERE suppkey = s.s_suppkey AND linenumber < 3) t")
_sql("subquery_correlated", "SELECT s_suppkey, (SELECT round(max(qty), 2) FROM grid WHERE suppkey = s_suppkey) AS best FROM supplier")

# Aggregations (I80-I88)

_sql("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS a, min(l_shipdate_us) AS low, max(l_shipdate_us) AS high FROM li")
_sql("agg_grouped", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM li GROUP BY l_returnflag, l_linestatus")
_sql("agg_median_bool_bit", "SELECT l_linenumber, median(l_quantity) AS med, bool_and(l_quantity > 0) AS every_one, bool_or(l_quantity > 49) AS any_one, bit_and(l_orderkey) AS ba, bit_or(l_orderkey) AS bo, bit_xor(l_orderkey) AS bx FROM li GROUP BY l_linenumber")
_sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM li GROUP BY l_returnflag")
_sql("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM li")
_sql("distinct_on", "SELECT suppkey, linenumber, qty FROM (SELECT suppkey, linenumber, round(qty, 2) AS qty, row_number() OVER (PARTITION BY suppkey ORDER BY qty DESC, linenumber) AS rn FROM grid) t WHERE rn = 1", "SELECT DISTINCT ON (suppkey) suppkey, linenumber, round(qty, 2) AS qty FROM grid ORDER BY suppkey, qty DESC, linenumber")
_sql("agg_stats", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(corr(l_quantity, l_extendedprice), 6) AS r FROM li GROUP BY l_returnflag")
_sql("agg_regr", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS at0, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay FROM li")
_sql("agg_array_string", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), '|') AS names, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS text, min_by(n_name, n_nationkey) AS first_one, max_by(n_name, n_nationkey) AS last_one FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') AS names, string_agg(n_name, ',' ORDER BY n_name) AS text, first(n_name ORDER BY n_nationkey) AS first_one, last(n_name ORDER BY n_nationkey) AS last_one FROM nation GROUP BY n_regionkey")
_sql("agg_filter_having", "SELECT l_suppkey, count(*) FILTER (WHERE l_quantity > 25) AS large, count(*) AS n FROM li GROUP BY l_suppkey HAVING count(*) > 3")
_sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g FROM li GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM li GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("agg_grouping_sets", "SELECT l_returnflag, l_linenumber, count(*) AS n FROM li GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())")
_sql("agg_percentile_exact", "SELECT l_returnflag, round(percentile(l_quantity, 0.9), 4) AS p90, round(percentile(l_extendedprice, 0.25), 4) AS p25 FROM li GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25 FROM li GROUP BY l_returnflag")


@_code("agg_percentile_weighted", "WITH t AS (SELECT etype, n FROM ev, range(n)) SELECT CAST(count(*) AS BIGINT) AS n, round(quantile_cont(etype, 0.5), 4) AS p50 FROM t")
def _(spark, sf_dir):
    return scan(spark, sf_dir, "events").where("n > 0").agg(F.sum("n").alias("n"), F.round(G.approx_percentile_weighted(F.col("etype"), F.col("n"), 0.5), 4).alias("p50"))


@_code("approx_distinct", "SELECT true AS near, count(DISTINCT l_orderkey) AS orders, quantile_disc(l_quantity, 0.5) AS p50 FROM li")
def _(spark, sf_dir):
    """The estimates are within five percent of the exact count and of the exact percentile's rank.

    The distinct count stands alone: beside it, Spark would keep the state of all other aggregates once for each order.
    """
    d = scan(spark, sf_dir, "flat_lineitem", columns=["l_orderkey", "l_quantity"])
    exact = F.expr("percentile_disc(array(0.45D, 0.5D, 0.55D)) WITHIN GROUP (ORDER BY l_quantity)")
    t = d.agg(F.approx_count_distinct("l_orderkey", 0.02).alias("estimate"), F.percentile_approx("l_quantity", 0.5, 10_000).alias("middle"), exact.alias("p"))
    t = t.crossJoin(d.agg(F.count_distinct("l_orderkey").alias("orders")))
    close = F.coalesce(F.col("middle").between(F.col("p")[0], F.col("p")[2]), F.lit(True))
    return t.select((close & (F.abs(F.col("estimate") - F.col("orders")) <= 0.05 * F.col("orders"))).alias("near"), "orders", F.col("p")[1].alias("p50"))


# Windows, order, limits, set operations (I90-I98)

_sql("window_rank", "SELECT suppkey, linenumber, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, ntile(3) OVER w AS nt FROM grid WINDOW w AS (PARTITION BY suppkey ORDER BY linenumber)", "SELECT suppkey, linenumber, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER w AS INT) AS rk, CAST(dense_rank() OVER w AS INT) AS dr, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, CAST(ntile(3) OVER w AS INT) AS nt FROM grid WINDOW w AS (PARTITION BY suppkey ORDER BY linenumber)")
_sql("window_lag_lead", "SELECT suppkey, linenumber, lag(linenumber) OVER w AS p, lead(linenumber, 2, -1) OVER w AS nx, first_value(linenumber) OVER w AS f, last_value(linenumber) OVER w AS l, nth_value(linenumber, 2) OVER w AS n2 FROM grid WINDOW w AS (PARTITION BY suppkey ORDER BY linenumber)")
_sql("window_rows", "SELECT suppkey, linenumber, round(sum(qty) OVER (PARTITION BY suppkey ORDER BY linenumber ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s, round(avg(qty) OVER (PARTITION BY linenumber ORDER BY suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS a FROM grid")
_sql("window_range", "SELECT lat, lon, sum(data) OVER (PARTITION BY lon ORDER BY lat RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM geo")
_sql("window_groups", "SELECT linenumber, suppkey, count(*) OVER (ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT linenumber, suppkey, dense_rank() OVER (ORDER BY linenumber) AS g FROM grid) t", "SELECT linenumber, suppkey, count(*) OVER (ORDER BY linenumber GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM grid")
_sql("window_qualify", "SELECT suppkey, linenumber FROM (SELECT suppkey, linenumber, row_number() OVER (PARTITION BY suppkey ORDER BY linenumber DESC) AS rn FROM grid) t WHERE rn <= 2", "SELECT suppkey, linenumber FROM grid QUALIFY row_number() OVER (PARTITION BY suppkey ORDER BY linenumber DESC) <= 2")
_sql("order_nulls", "SELECT x, CAST(row_number() OVER (ORDER BY x ASC NULLS LAST) AS INT) AS at FROM (SELECT nullif(n_nationkey, 3) AS x FROM nation) t")
_sql("limit_topk", "SELECT suppkey, linenumber, round(price, 2) AS price FROM grid ORDER BY price DESC, suppkey, linenumber LIMIT 10")
_sql("limit_offset", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM li ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 20 OFFSET 100")
_sql("set_union", "SELECT l_returnflag AS x FROM li UNION SELECT l_linestatus FROM li")
_sql("set_intersect", "SELECT suppkey FROM grid WHERE qty > 2300 INTERSECT SELECT suppkey FROM grid WHERE qty < 2000")
_sql("set_intersect_all", "SELECT suppkey FROM grid WHERE linenumber < 4 INTERSECT ALL SELECT suppkey FROM grid WHERE linenumber > 2")
_sql("set_except", "SELECT suppkey FROM grid EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000")
_sql("set_except_all", "SELECT suppkey FROM grid EXCEPT ALL SELECT s_suppkey FROM supplier")

# Scalar functions (I100-I108)

_sql(
    "fn_math",
    "SELECT lat, lon, abs(lon) AS f1, CAST(ceil(data / 3) AS BIGINT) AS f2, CAST(floor(data / 3) AS BIGINT) AS f3, round(data / 3, 2) AS f4, round(sqrt(data), 9) AS f5, round(cbrt(data), 9) AS f6, round(power(lat, 2), 6) AS f7, round(exp(data / 50), 9) AS f8, round(ln(lat), 9) AS f9, round(log2(lat), 9) AS f10, round(log10(lat), 9) AS f11, round(sin(lat), 9) AS f12, round(cos(lat), 9) AS f13, round(tan(lat), 9) AS f14, round(asin(data / 64), 9) AS f15, round(acos(data / 64), 9) AS f16, round(atan(lat), 9) AS f17, round(atan2(lat, lon), 9) AS f18, round(sinh(data / 20), 6) AS f19, round(cosh(data / 20), 6) AS f20, round(tanh(data / 20), 9) AS f21, round(degrees(lat), 6) AS f22, round(radians(lat), 9) AS f23, CAST(sign(lon) AS DOUBLE) AS f24, isnan(data) AS f25, round(pi(), 9) AS f26 FROM geo",
)


@_code("fn_gcd_lcm_trunc", "SELECT l_orderkey, l_partkey, gcd(l_orderkey, l_partkey) AS g, CAST(lcm(l_orderkey, l_partkey) AS BIGINT) AS l, trunc(l_extendedprice - 30000) AS t, CAST(factorial(l_linenumber) AS BIGINT) AS f FROM li")
def _(spark, sf_dir):
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    return scan(spark, sf_dir, "flat_lineitem").select(a, b, G.gcd(a, b).alias("g"), G.lcm(a, b).alias("l"), G.trunc(F.col("l_extendedprice") - 30000).alias("t"), F.factorial("l_linenumber").alias("f"))


_sql(
    "fn_string",
    "SELECT p_partkey, lower(c_str) AS f1, upper(c_str) AS f2, trim(concat(' ', c_str, ' ')) AS f3, lpad(c_str, 30, '*') AS f4, rpad(c_str, 30, '-') AS f5, length(c_str) AS f6, bit_length(c_str) AS f7, substr(c_str, 2, 4) AS f8, CAST(instr(c_str, 'e') AS INT) AS f9, replace(c_str, 'a', 'A') AS f10, split_part(c_str, ' ', 1) AS f11, repeat('ab', 3) AS f12, reverse(c_str) AS f13, translate(c_str, 'abc', 'xyz') AS f14, startswith(c_str, 'a') AS f15, endswith(c_str, 'e') AS f16, contains(c_str, 'in') AS f17, concat_ws('/', c_str, 'x') AS f18, chr(65) AS f19, ascii(c_str) AS f20, levenshtein(c_str, 'part') AS f21, lower(hex(p_partkey)) AS f22, left(c_str, 3) AS f23, right(c_str, 3) AS f24, ltrim(concat('  ', c_str)) AS f25, rtrim(concat(c_str, '  ')) AS f26 FROM pt",
    "SELECT p_partkey, lower(c_str) AS f1, upper(c_str) AS f2, trim(concat(' ', c_str, ' ')) AS f3, lpad(c_str, 30, '*') AS f4, rpad(c_str, 30, '-') AS f5, CAST(length(c_str) AS INT) AS f6, CAST(bit_length(c_str) AS INT) AS f7, substr(c_str, 2, 4) AS f8, CAST(instr(c_str, 'e') AS INT) AS f9, replace(c_str, 'a', 'A') AS f10, split_part(c_str, ' ', 1) AS f11, repeat('ab', 3) AS f12, reverse(c_str) AS f13, translate(c_str, 'abc', 'xyz') AS f14, starts_with(c_str, 'a') AS f15, ends_with(c_str, 'e') AS f16, contains(c_str, 'in') AS f17, concat_ws('/', c_str, 'x') AS f18, chr(65) AS f19, ascii(c_str) AS f20, CAST(levenshtein(c_str, 'part') AS INT) AS f21, lower(to_hex(p_partkey)) AS f22, left(c_str, 3) AS f23, right(c_str, 3) AS f24, ltrim(concat('  ', c_str)) AS f25, rtrim(concat(c_str, '  ')) AS f26 FROM pt",
)
_sql("fn_string_overlay_initcap", "SELECT n_name, initcap(lower(n_name)) AS i, overlay(n_name PLACING 'xx' FROM 2 FOR 1) AS o FROM nation", "SELECT n_name, upper(n_name[1]) || lower(n_name[2:]) AS i, n_name[1] || 'xx' || n_name[3:] AS o FROM nation WHERE n_name NOT LIKE '% %' UNION ALL SELECT n_name, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' '), n_name[1] || 'xx' || n_name[3:] FROM nation WHERE n_name LIKE '% %'")
_sql("fn_regex", "SELECT p_partkey, regexp_like(c_str, '^[a-m]') AS m, regexp_replace(c_str, '[aeiou]', '_') AS r, regexp_extract(c_str, '([a-z]+)', 1) AS e, regexp_count(c_str, '[aeiou]') AS n FROM pt", "SELECT p_partkey, regexp_matches(c_str, '^[a-m]') AS m, regexp_replace(c_str, '[aeiou]', '_', 'g') AS r, regexp_extract(c_str, '([a-z]+)', 1) AS e, CAST(len(regexp_extract_all(c_str, '[aeiou]')) AS INT) AS n FROM pt")
_sql(
    "fn_date",
    "SELECT l_orderkey, l_linenumber, date_format(t, 'yyyy-MM-dd') AS d, CAST(extract(year FROM t) AS INT) AS y, CAST(extract(month FROM t) AS INT) AS m, CAST(extract(day FROM t) AS INT) AS dd, date_format(date_trunc('month', t), 'yyyy-MM-dd') AS mo, date_format(t + INTERVAL 10 DAYS, 'yyyy-MM-dd') AS plus, CAST(make_date(2020, l_linenumber, 1) AS STRING) AS made, CAST(unix_seconds(t) AS BIGINT) AS s FROM (SELECT l_orderkey, l_linenumber, timestamp_micros(l_shipdate_us) AS t FROM li) x",
    "SELECT l_orderkey, l_linenumber, strftime(t, '%Y-%m-%d') AS d, CAST(extract(year FROM t) AS INT) AS y, CAST(extract(month FROM t) AS INT) AS m, CAST(extract(day FROM t) AS INT) AS dd, strftime(date_trunc('month', t), '%Y-%m-%d') AS mo, strftime(t + INTERVAL 10 DAYS, '%Y-%m-%d') AS plus, CAST(make_date(2020, l_linenumber, 1) AS VARCHAR) AS made, CAST(epoch(t) AS BIGINT) AS s FROM (SELECT l_orderkey, l_linenumber, make_timestamp(l_shipdate_us) AS t FROM li) x",
)


@_code("fn_date_bin", "SELECT event_id, CAST(epoch(time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS bin FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(G.date_bin(900, F.col("ts").cast("timestamp"))).alias("bin"))


_sql(
    "fn_array",
    "SELECT n_nationkey, array_join(array_append(a, 9), ',') AS f1, array_join(concat(a, array(7)), ',') AS f2, array_contains(a, 2) AS f3, array_join(array_sort(array_distinct(a)), ',') AS f4, array_join(array_sort(array_except(a, array(1))), ',') AS f5, array_join(array_sort(array_intersect(a, array(1, 2))), ',') AS f6, size(a) AS f7, CAST(array_position(a, 2) AS INT) AS f8, array_join(array_remove(a, 2), ',') AS f9, array_join(slice(a, 2, 2), ',') AS f10, array_join(a, '-') AS f11, array_join(flatten(array(a, a)), ',') AS f12, array_join(sequence(1, 3), ',') AS f13, aggregate(a, 0, (s, x) -> s + x) AS f14, array_join(transform(a, x -> x * 2), ',') AS f15, array_max(a) AS f16 FROM (SELECT n_nationkey, array(1, 2, 2, n_regionkey) AS a FROM nation) t",
    "SELECT n_nationkey, array_to_string(list_append(a, 9), ',') AS f1, array_to_string(list_concat(a, [7]), ',') AS f2, list_contains(a, 2) AS f3, array_to_string(list_sort(list_distinct(a)), ',') AS f4, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x <> 1))), ',') AS f5, array_to_string(list_sort(list_intersect(a, [1, 2])), ',') AS f6, CAST(len(a) AS INT) AS f7, CAST(list_position(a, 2) AS INT) AS f8, array_to_string(list_filter(a, lambda x: x <> 2), ',') AS f9, array_to_string(list_slice(a, 2, 3), ',') AS f10, array_to_string(a, '-') AS f11, array_to_string(flatten([a, a]), ',') AS f12, array_to_string([1, 2, 3], ',') AS f13, CAST(list_sum(a) AS INT) AS f14, array_to_string(list_transform(a, lambda x: x * 2), ',') AS f15, list_max(a) AS f16 FROM (SELECT n_nationkey, [1, 2, 2, n_regionkey] AS a FROM nation) t",
)
_sql("fn_unnest", "SELECT n_nationkey, x FROM nation LATERAL VIEW explode(sequence(0, n_regionkey)) AS x", "SELECT n_nationkey, CAST(unnest(range(0, n_regionkey + 1)) AS INT) AS x FROM nation")
_sql("fn_map_struct", "SELECT n_nationkey, array_join(map_keys(m), '|') AS k, array_join(map_values(m), '|') AS v, element_at(m, 'name') AS e, s.a AS a, s.b AS b FROM (SELECT n_nationkey, map('name', n_name, 'key', CAST(n_nationkey AS STRING)) AS m, named_struct('a', n_name, 'b', n_regionkey) AS s FROM nation) t", "SELECT n_nationkey, array_to_string(map_keys(m), '|') AS k, array_to_string(map_values(m), '|') AS v, m['name'] AS e, s.a AS a, s.b AS b FROM (SELECT n_nationkey, MAP {'name': n_name, 'key': CAST(n_nationkey AS VARCHAR)} AS m, {'a': n_name, 'b': n_regionkey} AS s FROM nation) t")
_sql("fn_hash", "SELECT n_name, md5(n_name) AS m, sha2(n_name, 256) AS s, base64(n_name) AS b, lower(hex(n_name)) AS h FROM nation", "SELECT n_name, md5(n_name) AS m, sha256(n_name) AS s, to_base64(encode(n_name)) AS b, lower(to_hex(encode(n_name))) AS h FROM nation")
_sql("fn_conditional", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), 99) AS c, ifnull(nullif(n_name, 'CHINA'), '?') AS i, nvl2(nullif(n_regionkey, 1), 'x', 'y') AS n2, greatest(n_nationkey, n_regionkey, 5) AS g, least(n_nationkey, n_regionkey) AS l, if(n_regionkey > 2, 'hi', 'lo') AS f FROM nation", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), 99) AS c, ifnull(nullif(n_name, 'CHINA'), '?') AS i, CASE WHEN nullif(n_regionkey, 1) IS NOT NULL THEN 'x' ELSE 'y' END AS n2, greatest(n_nationkey, n_regionkey, 5) AS g, least(n_nationkey, n_regionkey) AS l, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS f FROM nation")
_sql("fn_json", "SELECT event_id, get_json_object(props, '$.page') AS page FROM events", "SELECT event_id, props->>'$.page' AS page FROM events")

# User functions (I111)


def _scaled(q: pd.Series, n: pd.Series) -> pd.Series:
    return q * 1.5 + n


def _mean(q: pd.Series) -> float:
    return float(q.mean())


@_code("udf_scalar", "SELECT suppkey, linenumber, round(qty * 1.5 + linenumber, 2) AS x FROM grid")
def _(spark, sf_dir):
    scale = F.pandas_udf(_scaled, "double")
    return scan(spark, sf_dir, "grid").select("suppkey", "linenumber", F.round(scale("qty", "linenumber"), 2).alias("x"))


@_code("udaf_pandas", "SELECT linenumber, round(sum(qty) / count(*), 4) AS m FROM grid GROUP BY linenumber")
def _(spark, sf_dir):
    mean = F.pandas_udf(_mean, "double")
    return scan(spark, sf_dir, "grid").groupBy("linenumber").agg(F.round(mean("qty"), 4).alias("m"))


@_code("udwf_pandas", "SELECT suppkey, linenumber, round(avg(qty) OVER (PARTITION BY linenumber), 4) AS m, round(avg(qty) OVER (PARTITION BY linenumber ORDER BY suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent FROM grid")
def _(spark, sf_dir):
    mean, by = F.pandas_udf(_mean, "double"), Window.partitionBy("linenumber")
    return scan(spark, sf_dir, "grid").select("suppkey", "linenumber", F.round(mean("qty").over(by), 4).alias("m"), F.round(mean("qty").over(by.orderBy("suppkey").rowsBetween(-2, 0)), 4).alias("recent"))


class _Count:
    def eval(self, n: int):
        for k in range(1, n + 1):
            yield (k,)


@_code("udtf_python", "SELECT n_nationkey, CAST(unnest(range(1, n_regionkey + 1)) AS INT) AS k FROM nation")
def _(spark, sf_dir):
    spark.udtf.register("gridloom_count", F.udtf(_Count, returnType="k int"))
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, c.k FROM nation, LATERAL gridloom_count(n_regionkey) c")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk-skipping scan of a two-axis store with broadcast coordinates, aggregated."""
    df = scan(spark, sf_dir, "grid").where("suppkey <= 8 AND linenumber > 1")
    return df.groupBy("suppkey").agg(F.count("*").alias("cells"), F.round(F.sum("qty"), 2).alias("qty"))


@_code("flagship", "SELECT suppkey, count(*) AS cells, round(sum(qty), 2) AS qty FROM grid WHERE suppkey <= 8 AND linenumber > 1 GROUP BY suppkey")
def _(spark, sf_dir):
    return flagship(spark, sf_dir)


def queries() -> dict[str, Build]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
