"""The relational and streaming checklist on the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelore.operators import relational as R
from pagelore.session import table
from pagelore.streaming import events as E


def T(spark, d, *names):
    return [table(spark, d, n) for n in names]


def r_join_aggregate(spark, d):
    li, o, c, n = T(spark, d, "lineitem", "orders", "customer", "nation")
    li = li.select("l_orderkey", "l_extendedprice", "l_discount").where("l_shipdate >= timestamp'1995-01-01'")
    x = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.groupBy("c_nationkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.count("*").alias("n"))
    return x.join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("r", 2).alias("revenue"), F.col("n").alias("lines"))


def r_summary(spark, d):
    """Totals by flag and status: one scan, partial aggregates, a handful of groups."""
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate").where("l_shipdate <= timestamp'1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(net), 2).alias("net"), F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("gross"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


def r_left_join(spark, d):
    c, o = T(spark, d, "customer", "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders")).groupBy("orders").agg(F.count("*").alias("customers"))


def r_semi_anti(spark, d):
    c, o = T(spark, d, "customer", "orders")
    big = o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(big, "c_custkey", "left_semi").select("c_custkey", F.lit("has").alias("side")).union(c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", F.lit("none")))


def r_full_outer(spark, d):
    c, s = T(spark, d, "customer", "supplier")
    a, b = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers")), s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full_outer").select("k", "customers", "suppliers")


def r_theta_join(spark, d):
    """How many suppliers of the same nation have a greater balance. The pairs of the join on less-than need not be made: balances
    are counted once each, and running sums over a nation's distinct balances say how many lie above."""
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    n = s.groupBy("s_nationkey", "s_acctbal").agg(F.count("*").alias("n"))
    above = n.select("s_nationkey", "s_acctbal", F.sum("n").over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal")).rowsBetween(W.unboundedPreceding, -1)).alias("richer"))
    return s.join(above, ["s_nationkey", "s_acctbal"]).where("richer > 0").select("s_suppkey", "richer")


def r_as_of(spark, d):
    """Each purchase with the last view of its user."""
    e = table(spark, d, "events")
    p, v = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("view_id"))
    return R.as_of(p, v, ["user_id"], "ts", "at", ["view_id"]).select("event_id", "view_id")


def r_interval_join(spark, d):
    """Errors within ten minutes after a click of the same user."""
    e = table(spark, d, "events")
    err = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("at"))
    click = e.where("event_type = 'click'").select("event_id", "user_id", "ts", (F.col("ts") + F.expr("interval 10 minutes")).alias("until"))
    return R.within(err, click, "at", "ts", "until", "600", ["user_id"]).select("error_id", "event_id")


def r_skewed_join(spark, d):
    e = table(spark, d, "events", "event_id", "event_type", "value")
    means = e.groupBy("event_type").agg(F.avg("value").alias("mean"))
    return R.salted(e, means, "event_type").groupBy("event_type").agg(F.count_if(F.col("value") > F.col("mean")).alias("above"))


def r_distinct_counts(spark, d):
    return table(spark, d, "lineitem", "l_returnflag", "l_partkey", "l_suppkey").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


def r_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def r_rollup(spark, d):
    n, r, s = T(spark, d, "nation", "region", "supplier")
    x = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.rollup("r_name", "n_name").agg(F.count("*").alias("suppliers"))


def r_pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))


def r_unpivot(spark, d):
    return r_pivot(spark, d).unpivot("o_orderpriority", ["F", "O", "P"], "status", "n")


def r_top_per_group(spark, d):
    """The three dearest orders of a customer; only three rows of a group leave a task."""
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").withColumn("place", F.row_number().over(w)).where("place <= 3")


def r_analytic(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice").select(
        "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"),
        F.rank().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))).alias("rank"), F.ntile(4).over(w).alias("quarter"),
    )


def r_set_operations(spark, d):
    c, s = T(spark, d, "customer", "supplier")
    a, b = c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select("k", F.lit("both").alias("side")).union(a.exceptAll(b).groupBy("k").count().select("k", F.concat(F.lit("more-"), F.col("count"))))


def r_in_subquery(spark, d):
    li, p = T(spark, d, "lineitem", "part")
    small = p.where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return li.join(small, "l_partkey", "left_semi").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


def r_correlated(spark, d):
    """Lines of less than a fifth of their part's mean quantity: the mean as a grouped join, not a subquery for each row."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    mean = li.groupBy("l_partkey").agg(F.avg("l_quantity").alias("m"))
    return li.join(mean, "l_partkey").where("l_quantity < 0.2 * m").select("l_orderkey", "l_linenumber")


def r_strings_and_dates(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.dayofweek("o_orderdate").alias("day"), F.substring_index("o_orderpriority", "-", 1).alias("level"), F.datediff(F.lit("1998-12-31").cast("date"), "o_orderdate").alias("age"))


def r_percentiles(spark, d):
    return table(spark, d, "lineitem", "l_returnflag", "l_extendedprice").groupBy("l_returnflag").agg(F.round(F.expr("percentile(l_extendedprice, 0.5)"), 4).alias("median"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("spread"))


def s_tumbling(spark, d):
    return E.drained(spark, E.tumbling(E.stream(spark, f"{d}/events.parquet"), "6 hours", "30 days"), "complete")


def s_sliding(spark, d):
    return E.drained(spark, E.sliding(E.stream(spark, f"{d}/events.parquet"), "1 day", "12 hours", "30 days"), "complete")


def s_visits(spark, d):
    return E.drained(spark, E.visits(E.stream(spark, f"{d}/events.parquet"), "30 minutes", "30 days"), "complete")


def s_once(spark, d):
    return E.drained(spark, E.once(E.stream(spark, f"{d}/events.parquet"), "30 days")).select("event_id", "event_type")


def s_running_failures(spark, d):
    rows = E.drained(spark, E.running_failures(E.stream(spark, f"{d}/events.parquet")), "update")
    return rows.groupBy("user_id").agg(F.max("most").alias("most"))


QUERIES = [r_join_aggregate, r_summary, r_left_join, r_semi_anti, r_full_outer, r_theta_join, r_as_of, r_interval_join, r_skewed_join, r_distinct_counts, r_cube, r_rollup, r_pivot, r_unpivot, r_top_per_group, r_analytic, r_set_operations, r_in_subquery, r_correlated, r_strings_and_dates, r_percentiles, s_tumbling, s_sliding, s_visits, s_once, s_running_failures]


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {
        "r_join_aggregate": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name",
        "r_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS gross, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
        "r_left_join": "SELECT orders, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) x GROUP BY 1",
        "r_semi_anti": "SELECT c_custkey, 'has' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT c_custkey, 'none' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
        "r_full_outer": "SELECT coalesce(a.k, b.k) AS k, customers, suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k",
        "r_theta_join": "SELECT a.s_suppkey, count(*) AS richer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal GROUP BY 1",
        "r_as_of": "SELECT p.event_id, (SELECT max_by(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts) AS view_id FROM events p WHERE p.event_type = 'purchase'",
        "r_interval_join": "SELECT x.event_id AS error_id, c.event_id FROM events x JOIN events c ON x.user_id = c.user_id AND x.ts >= c.ts AND x.ts <= c.ts + INTERVAL 10 MINUTE WHERE x.event_type = 'error' AND c.event_type = 'click'",
        "r_skewed_join": "SELECT event_type, count(*) FILTER (value > m) AS above FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) x GROUP BY 1",
        "r_distinct_counts": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
        "r_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
        "r_rollup": "SELECT r_name, n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
        "r_pivot": "SELECT o_orderpriority, " + ", ".join(f"nullif(count(*) FILTER (o_orderstatus = '{s}'), 0) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1",
        "r_unpivot": "SELECT p AS o_orderpriority, s AS status, n FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) a CROSS JOIN (VALUES ('F'), ('O'), ('P')) v(s) LEFT JOIN (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) c ON c.o_orderpriority = p AND c.o_orderstatus = s",
        "r_top_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) x WHERE place <= 3",
        "r_analytic": "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING), 2) AS last_three, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rank, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
        "r_set_operations": "WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT k, 'both' AS side FROM (SELECT k FROM a INTERSECT SELECT k FROM b) x UNION ALL SELECT k, 'more-' || count(*) FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) y GROUP BY k",
        "r_in_subquery": "SELECT l_suppkey, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1",
        "r_correlated": "SELECT l_orderkey, l_linenumber FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_partkey) AS m FROM lineitem) x WHERE l_quantity < 0.2::DOUBLE * m",
        "r_strings_and_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(dayofweek(o_orderdate) + 1 AS INT) AS day, string_split(o_orderpriority, '-')[1] AS level, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS INT) AS age FROM orders",
        "r_percentiles": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS spread FROM lineitem GROUP BY 1",
        "s_tumbling": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
        "s_sliding": "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - o * INTERVAL 12 HOUR AS start FROM events, (VALUES (0), (1)) v(o)) x GROUP BY 1",
        "s_visits": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events) x) y GROUP BY user_id, s",
        "s_once": "SELECT event_id, event_type FROM events",
        "s_running_failures": "SELECT user_id, max(CASE WHEN event_type = 'error' THEN n ELSE 0 END) AS most FROM (SELECT user_id, event_type, g, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g, event_type = 'error' AS bad FROM events) x GROUP BY user_id, bad, g, event_type) y GROUP BY user_id",
    }
