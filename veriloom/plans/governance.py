"""Queries of policies, topologies and campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy
from .domain import table
from .registry import query


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'forbidden_word' WHEN 'error' THEN 'metacharacter' WHEN 'purchase' THEN 'binary_not_allowed' ELSE 'interactive' END AS violation FROM events""")
def command_policy(spark, d):
    kind = F.col("event_type")
    argv = (
        F.when(kind == "click", F.array(F.lit("vtysh"), F.lit("-c"), F.concat(F.lit("show user "), "user_id"))).when(kind == "view", F.array(F.lit("vtysh"), F.lit("-c"), F.lit("show ip"), F.lit("-c"), F.lit("Show NO-where")))
        .when(kind == "error", F.array(F.lit("ping"), F.lit("a;b"))).when(kind == "purchase", F.array(F.lit("rm"), F.lit("x"))).otherwise(F.array(F.lit("vtysh")))
    )
    return table(spark, d, "events").select("event_id", policy.read_command_violation(argv, ("vtysh", "ping")).alias("violation"))


@query("""SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'set_remote_as' WHEN 1 THEN 'interface_down' WHEN 2 THEN 'withdraw_prefix' END AS shape, count(*) AS n FROM events GROUP BY ALL""")
def mutation_shapes(spark, d):
    u = F.col("user_id")
    enter, router = F.lit("configure terminal"), F.concat(F.lit("router bgp "), u + 65000)
    commands = (
        F.when(u % 4 == 0, F.array(enter, router, F.concat(F.lit("neighbor 10.0.0.1 remote-as "), u))).when(u % 4 == 1, F.array(enter, F.concat(F.lit("interface eth"), u % 10), F.lit("shutdown")))
        .when(u % 4 == 2, F.array(enter, router, F.lit("address-family ipv4 unicast"), F.lit("no network 10.1.0.0/24"))).otherwise(F.array(enter, router))
    )
    return table(spark, d, "events").groupBy("user_id", policy.mutation_shape(commands).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'timeout' WHEN o_orderkey % 5 = 0 THEN 'target_not_found' WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'nonzero_exit' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def exec_status(spark, d):
    k = F.col("o_orderkey")
    status = policy.exec_status(k % 7 == 0, k % 5 == 0, F.when(F.col("o_orderstatus") == "F", 0).otherwise(1))
    return table(spark, d, "orders").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, (p_size::BIGINT * 1000003 * 2 * 2 + p_size::BIGINT * 1000003 * 8 + 2 * 448 * 4096) * 5 // 4 AS bytes FROM part")
def memory_estimate(spark, d):
    size = F.col("p_size").cast("bigint") * 1000003
    return table(spark, d, "part").select("p_partkey", policy.memory_bytes(size, F.lit(2).cast("bigint"), F.lit(2).cast("bigint"), F.lit(448).cast("bigint"), 4096).alias("bytes"))


@query("""SELECT 'link_of_unknown_node' AS rule, n_nationkey::VARCHAR AS subject FROM nation WHERE n_regionkey = 4 UNION ALL SELECT 'loopback_repeated', '10.9.0.0' UNION ALL SELECT 'session_numbers_disagree', n_nationkey::VARCHAR FROM nation WHERE n_nationkey % 6 = 0 OR n_regionkey = 4
  UNION ALL SELECT 'session_of_unknown_node', n_nationkey::VARCHAR FROM nation WHERE n_regionkey = 4 UNION ALL SELECT 'link_not_point_to_point', n_nationkey::VARCHAR FROM nation WHERE n_nationkey % 8 = 0""")
def topology_faults(spark, d):
    """Nations as links from a hub to their regions; region 4 is left out of the nodes, and numbers and addresses are broken for some."""
    k = F.col("n_nationkey")
    regions = table(spark, d, "region").filter("r_regionkey < 4")
    nodes = regions.select(F.concat(F.lit("region"), "r_regionkey").alias("name"), (F.col("r_regionkey") + 100).alias("asn"), F.concat(F.lit("10.9.0."), F.greatest(F.lit(0), F.col("r_regionkey") - 1)).alias("loopback"))
    nodes = nodes.unionByName(spark.range(1).select(F.lit("hub").alias("name"), F.lit(99).alias("asn"), F.lit("10.9.1.1").alias("loopback")))
    nation = table(spark, d, "nation").withColumn("node", F.concat(F.lit("region"), "n_regionkey"))
    ip = lambda n: F.concat(F.lit("10.0."), k, F.lit("."), n, F.lit("/30"))
    links = nation.select(k.alias("link"), F.lit("a").alias("side"), F.lit("hub").alias("node"), ip(F.lit(1)).alias("ip")).unionByName(nation.select(k.alias("link"), F.lit("b").alias("side"), "node", ip(F.when(k % 8 == 0, 6).otherwise(2)).alias("ip")))
    peer = F.concat(F.lit("10.0."), k, F.lit("."), F.when(k % 8 == 0, 6).otherwise(2))
    ours = nation.select(k.alias("session"), F.lit("a").alias("side"), F.lit("hub").alias("node"), peer.alias("peer_ip"), (F.col("n_regionkey") + 100).alias("remote_as"))
    theirs = nation.select(k.alias("session"), F.lit("b").alias("side"), "node", F.concat(F.lit("10.0."), k, F.lit(".1")).alias("peer_ip"), F.when(k % 6 == 0, 98).otherwise(99).alias("remote_as"))
    return policy.topology_findings(nodes, links, ours.unionByName(theirs))


@query("""SELECT r_name AS topology_id, 'case-' || k AS case_id, 'f' || k % 2 AS fault_family, (k + 1)::BIGINT AS planned_runs FROM region, range(0, 3) t(k) UNION ALL SELECT r_name, 'own-' || r_name, 'own', 4 FROM region WHERE r_regionkey < 2""")
def candidate_matrix(spark, d):
    regions = table(spark, d, "region").select(F.col("r_name").alias("topology_id"), "r_regionkey")
    cases = spark.range(3).select(F.concat(F.lit("case-"), "id").alias("case_id"), F.concat(F.lit("f"), F.col("id") % 2).alias("fault_family"), (F.col("id") + 1).alias("planned_runs"), F.lit(None).cast("string").alias("topology"))
    own = regions.filter("r_regionkey < 2").select(F.concat(F.lit("own-"), "topology_id").alias("case_id"), F.lit("own").alias("fault_family"), F.lit(4).cast("bigint").alias("planned_runs"), F.col("topology_id").alias("topology"))
    return policy.candidates(regions, cases.unionByName(own))


@query("""WITH r AS (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt, o_orderstatus = 'F' AS accepted FROM orders), p AS (SELECT c_custkey AS g FROM customer WHERE c_custkey % 3 <> 0)
  SELECT (SELECT count(*) FROM p) AS planned_groups, count(DISTINCT CASE WHEN accepted AND g IN (SELECT g FROM p) THEN g END) AS verified_groups, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE NOT accepted) AS rejected,
  count(*) FILTER (WHERE attempt > 1) AS retries, count(*) FILTER (WHERE g NOT IN (SELECT g FROM p)) AS unplanned, count(DISTINCT CASE WHEN accepted AND g IN (SELECT g FROM p) THEN g END) >= 10 AND count(*) FILTER (WHERE accepted) >= 20 AS coverage_met FROM r""")
def campaign_result(spark, d):
    from pyspark.sql import Window

    attempt = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), attempt.alias("attempt"), (F.col("o_orderstatus") == "F").alias("accepted"))
    plan = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("group_id"))
    return policy.campaign_result(plan, runs, 10, 20)


@query("""WITH s AS (SELECT conv_id, turn, length(text) % 7 <> 0 AS ok FROM conversations), b AS (SELECT *, max(NOT ok) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM s)
  SELECT conv_id, turn AS stage, CASE WHEN coalesce(f, false) THEN 'skipped' WHEN ok THEN 'passed' ELSE 'failed' END AS outcome FROM b""")
def preflight_stages(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("stage"), (F.length("text") % 7 != 0).alias("passed"))
    return policy.preflight(rows, "conv_id").select("conv_id", "stage", "outcome")


@query("""WITH o AS (SELECT count(DISTINCT o_orderkey) AS keys, min(o_orderkey) AS first FROM orders), l AS (SELECT count(DISTINCT l_orderkey) AS keys, min(l_orderkey) - 1 AS first FROM lineitem)
  SELECT 'lines.keys=orders.keys' AS rule, l.keys = o.keys AS passed FROM o, l UNION ALL SELECT 'lines.first=orders.first', l.first = o.first FROM o, l UNION ALL SELECT 'lines.missing=orders.keys', false""")
def binding_checks(spark, d):
    """What the lines say of their orders against the orders."""
    orders = table(spark, d, "orders").agg(F.countDistinct("o_orderkey").alias("keys"), F.min("o_orderkey").alias("first"))
    lines = table(spark, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("keys"), (F.min("l_orderkey") - 1).alias("first"))
    return policy.binding_findings({"orders": orders, "lines": lines}, [("lines", "keys", "orders", "keys"), ("lines", "first", "orders", "first"), ("lines", "missing", "orders", "keys")])

