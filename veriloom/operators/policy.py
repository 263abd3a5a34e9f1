"""Policies as columns and check rows: commands, topologies, catalog cases, candidates, campaigns, preflight, bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that a read-only command must not have.
FORBIDDEN_WORDS = ("configure", "copy", "write", "delete", "reload", "clear", "shutdown", "no", "enable", "import", "terminal")
# Parameters of mutating commands.
ADDRESS, NUMBER, INTERFACE = r"(?:\d{1,3}\.){3}\d{1,3}", r"\d{1,10}", r"eth\d{1,3}"
PREFIX = ADDRESS + r"/\d{1,2}"
LAST_ASN = (1 << 32) - 1


def shell_commands(argv: Column) -> Column:
    """The values after each ``-c``; a value that looks like ``-c`` is a value."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))

    def step(s: Column, token: Column) -> Column:
        out = F.when(s["open"], F.concat(s["out"], F.array(token))).otherwise(s["out"])
        return F.struct(out.alias("out"), (~s["open"] & (token == "-c")).alias("open"))

    return F.aggregate(F.slice(argv, 2, F.greatest(F.lit(0), F.size(argv) - 1)), start, step)


def read_command_violation(argv: Column, binaries: tuple[str, ...], shell: str = "vtysh") -> Column:
    """Why a read-only policy refuses a command, or null."""
    parsed = shell_commands(argv)
    words = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9_]+"), lambda w: w != "")
    first = F.try_element_at(argv, F.lit(1))
    return (
        F.when(F.coalesce(F.size(argv), F.lit(0)) <= 0, "empty").when(F.exists(argv, lambda t: t.rlike(r"[|;&$><`]")), "metacharacter").when(~first.isin(*binaries), "binary_not_allowed")
        .when((first == shell) & parsed["open"], "dangling_flag").when((first == shell) & (F.size(parsed["out"]) == 0), "interactive")
        .when((first == shell) & F.exists(parsed["out"], lambda c: F.coalesce(F.try_element_at(words(c), F.lit(1)) != "show", F.lit(True))), "not_a_show_command")
        .when((first == shell) & F.exists(parsed["out"], lambda c: F.arrays_overlap(words(c), F.array(*map(F.lit, FORBIDDEN_WORDS)))), "forbidden_word")
    )


def shapes() -> dict[str, tuple[str, ...]]:
    """Complete command sequences that may change a lab, as patterns by position."""
    enter, router = "configure terminal", rf"router bgp {NUMBER}"
    return {
        "set_remote_as": (enter, router, rf"neighbor {ADDRESS} remote-as {NUMBER}"), "remove_neighbor": (enter, router, rf"no neighbor {ADDRESS}"),
        "interface_down": (enter, rf"interface {INTERFACE}", "shutdown"), "interface_up": (enter, rf"interface {INTERFACE}", "no shutdown"),
        "withdraw_prefix": (enter, router, "address-family ipv4 unicast", rf"no network {PREFIX}"), "announce_prefix": (enter, router, "address-family ipv4 unicast", rf"network {PREFIX}"),
    }


def mutation_shape(commands: Column) -> Column:
    """Name of the shape that a whole command sequence has, or null; a part of one is none."""
    name = F.lit(None).cast("string")
    for shape, patterns in shapes().items():
        fits = F.size(commands) == len(patterns)
        for k, p in enumerate(patterns, 1):
            fits = fits & F.coalesce(F.try_element_at(commands, F.lit(k)).rlike(f"^(?:{p})$"), F.lit(False))
        name = F.when(fits, shape).otherwise(name)
    return name


def exec_status(timed_out: Column, not_found: Column, exit_code: Column) -> Column:
    return F.when(timed_out, "timeout").when(not_found, "target_not_found").when(exit_code == 0, "ok").otherwise("nonzero_exit")


def determinism(available: Column, algorithms: Column, device: Column) -> Column:
    return F.when(~available, "unsupported").when(~algorithms, "nondeterministic").when(device == "cpu", "deterministic_supported").otherwise("best_effort")


def memory_bytes(parameters: Column, width: Column, batch: Column, tokens: Column, per_token: int) -> Column:
    """Weights and gradients at their width, two 4-byte moments, activations, and a quarter on top; whole numbers."""
    whole = parameters * width * 2 + parameters * 8 + batch * tokens * per_token
    return F.call_function("div", whole * 5, F.lit(4))


def address(text: Column) -> Column:
    """An IPv4 address as a number."""
    parts = F.split(F.substring_index(text, "/", 1), r"\.")
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n * 256 + p.cast("bigint"))


def topology_findings(nodes: DataFrame, links: DataFrame, sessions: DataFrame) -> DataFrame:
    """``rule, subject`` of ``nodes(name, asn, loopback)``, ``links(link, side, node, ip)`` and ``sessions(session, side, node, peer_ip, remote_as)``."""
    def rows(df: DataFrame, rule: str, subject: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))

    repeated = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    names = nodes.select(F.col("name").alias("__name"), "asn")
    a, b = (links.filter(F.col("side") == s).select("link", F.col("node").alias(f"node_{s}"), address(F.col("ip")).alias(f"ip_{s}"), F.col("ip").endswith("/30").alias(f"p30_{s}")) for s in "ab")
    pair = a.join(b, "link", "full_outer")
    bad = F.coalesce((F.col("node_a") == F.col("node_b")) | ~F.col("p30_a") | ~F.col("p30_b") | (F.abs(F.col("ip_a") - F.col("ip_b")) != 1) | (F.least("ip_a", "ip_b") % 4 != 1), F.lit(True))
    ends = sessions.join(names, F.col("node") == F.col("__name"), "left")
    sa, sb = (ends.filter(F.col("side") == s).select("session", F.col("asn").alias(f"asn_{s}"), F.col("remote_as").alias(f"as_{s}")) for s in "ab")
    agree = sa.join(sb, "session", "full_outer").filter(~F.coalesce((F.col("as_a") == F.col("asn_b")) & (F.col("as_b") == F.col("asn_a")), F.lit(False)))
    known = links.select(F.substring_index("ip", "/", 1).alias("__ip")).distinct()
    return (
        rows(repeated(nodes, "name"), "node_name_repeated", "name").unionByName(rows(repeated(nodes, "loopback"), "loopback_repeated", "loopback"))
        .unionByName(rows(links.join(names, F.col("node") == F.col("__name"), "left_anti"), "link_of_unknown_node", "link")).unionByName(rows(ends.filter("__name is null"), "session_of_unknown_node", "session"))
        .unionByName(rows(pair.filter(bad), "link_not_point_to_point", "link")).unionByName(rows(agree, "session_numbers_disagree", "session"))
        .unionByName(rows(sessions.join(known, F.col("peer_ip") == F.col("__ip"), "left_anti"), "peer_address_on_no_link", "session"))
    )


def session_endpoints(cases: DataFrame, sessions: DataFrame, links: DataFrame) -> DataFrame:
    """``cases(case_id, target, session)`` with what they resolve to, ``local_asn, peer_asn, peer_ip, interface, rule``.

    ``sessions(session, side, node, asn, ip)`` and ``links(link, side, node, iface, ip)`` have one row for each end.  ``rule`` names why a
    case doesn't resolve: an unknown session, a target that is no end of it, or no link of the target that faces the peer.
    """
    known = sessions.select("session").distinct().withColumn("__known", F.lit(True))
    mine = sessions.select("session", F.col("node").alias("target"), F.col("side").alias("__side"), F.col("asn").alias("local_asn"))
    other = sessions.select("session", F.when(F.col("side") == "a", "b").otherwise("a").alias("__side"), F.col("asn").alias("peer_asn"), F.col("ip").alias("peer_ip"))
    bare = lambda c: F.substring_index(c, "/", 1)
    here = links.select("link", "side", F.col("node").alias("target"), F.col("iface").alias("interface"))
    facing = links.select("link", F.when(F.col("side") == "a", "b").otherwise("a").alias("side"), bare(F.col("ip")).alias("peer_ip"))
    faces = here.join(facing, ["link", "side"]).groupBy("target", "peer_ip").agg(F.min("interface").alias("interface"))
    rows = cases.join(known, "session", "left").join(mine, ["session", "target"], "left").join(other, ["session", "__side"], "left").withColumn("peer_ip", bare(F.col("peer_ip")))
    rows = rows.join(faces, ["target", "peer_ip"], "left")
    rule = F.when(F.col("__known").isNull(), "session_unknown").when(F.col("local_asn").isNull(), "target_is_no_end").when(F.col("interface").isNull(), "no_link_faces_the_peer")
    return rows.select("case_id", "target", "session", "local_asn", "peer_asn", "peer_ip", "interface", rule.alias("rule"))


def finite_decimal(text: Column) -> Column:
    """Whether a recorded number is a finite decimal text."""
    return F.coalesce(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$"), F.lit(False))


def incident_violation(status: Column, label: Column, verdicts: Column, recovery: Column, rejection: Column) -> Column:
    """Why an incident record can't be assembled, or null: ``verdicts`` is an array, ``label`` the ground truth's name."""
    accepted = status == "accepted"
    return (
        F.when(~F.coalesce(status.isin("accepted", "rejected"), F.lit(False)), "status_unknown")
        .when(accepted & (F.coalesce(label, F.lit("")) == ""), "label_missing").when(accepted & label.rlike(r"\s"), "label_has_white_space")
        .when(accepted & (F.coalesce(F.size(verdicts), F.lit(0)) <= 0), "verdict_missing").when(accepted & ~F.coalesce(recovery, F.lit(False)), "recovery_missing")
        .when(accepted & rejection.isNotNull(), "rejection_present").when(~accepted & label.isNotNull(), "truth_present").when(~accepted & rejection.isNull(), "rejection_missing")
    )


def case_violation(template: Column, target: Column, expected: Column, wrong_asn: Column, local_asn: Column, peer_asn: Column, interface: Column, prefix: Column, loopback: Column) -> Column:
    """Why a catalog case is not valid on its topology, or null; rules depend on the template."""
    number = wrong_asn.try_cast("bigint")
    return (
        F.when(F.coalesce(target, F.lit("")) == "", "target_missing").when(local_asn.isNull(), "target_unknown").when(~expected.eqNullSafe(target), "expected_target_differs").when(peer_asn.isNull(), "session_unknown")
        .when((template == "remote_as") & wrong_asn.isNull(), "number_missing").when((template == "remote_as") & number.isNull(), "number_malformed")
        .when((template == "remote_as") & ((number < 1) | (number > LAST_ASN)), "number_out_of_range").when((template == "remote_as") & (number == local_asn), "number_is_local").when((template == "remote_as") & (number == peer_asn), "number_is_peer")
        .when((template == "interface") & ~F.coalesce(interface.rlike(f"^{INTERFACE}$"), F.lit(False)), "interface_not_allowed")
        .when((template == "prefix") & ~F.coalesce(F.coalesce(prefix, loopback).rlike(f"^{PREFIX}$"), F.lit(False)), "prefix_malformed").when((template == "prefix") & (F.coalesce(prefix, loopback) != loopback), "prefix_not_announced")
        .when(~template.isin("remote_as", "neighbor", "interface", "prefix"), "template_unknown")
    )


def candidates(topologies: DataFrame, cases: DataFrame) -> DataFrame:
    """Topologies by cases: cases without a topology go with each, others with their own.

    Both are catalogs of a few rows, and the result is the catalog of all candidates: the product is what is asked for, and is
    written as an equi-join on what a topology admits.
    """
    admits = topologies.select("topology_id", F.explode(F.array(F.lit("any"), F.col("topology_id"))).alias("scope"))
    return admits.join(cases.withColumn("scope", F.coalesce("topology", F.lit("any"))), "scope").select("topology_id", "case_id", "fault_family", "planned_runs")


def campaign_result(plan: DataFrame, runs: DataFrame, least_groups: int, least_accepted: int) -> DataFrame:
    """One row for ``plan(group_id)`` and ``runs(group_id, attempt, accepted)``; runs of unplanned groups are counted apart."""
    rows = plan.select("group_id", F.lit(True).alias("planned")).join(runs, "group_id", "full_outer")
    ran = F.col("attempt").isNotNull()
    out = rows.agg(
        F.countDistinct(F.when(F.col("planned"), F.col("group_id"))).alias("planned_groups"), F.countDistinct(F.when(F.col("accepted") & F.col("planned"), F.col("group_id"))).alias("verified_groups"),
        F.count_if(ran & F.col("accepted")).alias("accepted"), F.count_if(ran & ~F.col("accepted")).alias("rejected"), F.count_if(ran & (F.col("attempt") > 1)).alias("retries"), F.count_if(F.col("planned").isNull()).alias("unplanned"),
    )
    return out.withColumn("coverage_met", (F.col("verified_groups") >= least_groups) & (F.col("accepted") >= least_accepted))


def preflight(stages: DataFrame, plan: str = "plan_id") -> DataFrame:
    """``outcome`` of each of a plan's ordered stages: after the first failure the rest is skipped."""
    before = F.max(~F.col("passed")).over(Window.partitionBy(plan).orderBy("stage").rowsBetween(Window.unboundedPreceding, -1))
    return stages.withColumn("outcome", F.when(F.coalesce(before, F.lit(False)), "skipped").when(F.col("passed"), "passed").otherwise("failed"))


def binding_findings(artifacts: dict[str, DataFrame], bindings: list[tuple[str, str, str, str]]) -> DataFrame:
    """``rule, passed`` for one-row artifacts: each binding names an artifact and field, and the artifact and field that must equal it."""
    long = None
    for name, row in artifacts.items():
        fields = [c for c in row.columns]
        one = row.select(*(F.col(c).cast("string").alias(c) for c in fields)).unpivot([], fields, "field", "value").select(F.concat(F.lit(f"{name}."), "field").alias("key"), "value")
        long = one if long is None else long.unionByName(one)
    spark = long.sparkSession
    wanted = spark.createDataFrame([(f"{a}.{x}", f"{b}.{y}") for a, x, b, y in bindings], "left_key string, right_key string")
    left, right = long.toDF("left_key", "left_value"), long.toDF("right_key", "right_value")
    rows = wanted.join(left, "left_key", "left").join(right, "right_key", "left")
    return rows.select(F.concat_ws("=", "left_key", "right_key").alias("rule"), (F.col("left_value").isNotNull() & F.col("left_value").eqNullSafe(F.col("right_value"))).alias("passed"))
