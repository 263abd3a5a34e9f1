"""Evidence: parsing device JSON, claims with quantified predicates, and observable features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import content_id, ordered_map, record, sha256_text, truncated_bytes

#: Peer states from worst to best; others rank between.
STATES = ("idle", "active", "connect", "opensent", "openconfirm", "other", "established")
CONFIG_BYTES = 65_536
INTERFACES = 64

PREDICATES = ("equals", "not_equals", "in_set", "not_in_set", "greater_than", "less_than", "any")


def verify_claims(checks: DataFrame, observations: DataFrame) -> DataFrame:
    """``check_id, verdict, detail, observed, ignored`` of ``checks(check_id, metric, predicate, expected array, trusted_only)``.

    ``observations(metric, value, trusted)`` of any target count; predicates hold for all of them.  Untrusted ones never verify a
    trusted claim.  Checks are few and observations many: observations are summed up by metric and value before they meet checks,
    so what a check sees is distinct values.
    """
    values = observations.groupBy("metric", "trusted", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = checks.join(values, "metric", "left")
    use = F.col("value").isNotNull() & (F.col("trusted") | ~F.col("trusted_only"))
    first, number = F.try_element_at("expected", F.lit(1)), F.col("value").try_cast("double")
    limit = first.try_cast("double")
    holds = (
        F.when(F.col("predicate") == "equals", F.col("value") == first).when(F.col("predicate") == "not_equals", F.col("value") != first)
        .when(F.col("predicate") == "in_set", F.array_contains("expected", F.col("value"))).when(F.col("predicate") == "not_in_set", ~F.array_contains("expected", F.col("value")))
        .when(F.col("predicate") == "greater_than", number > limit).when(F.col("predicate") == "less_than", number < limit)
    )
    numeric = F.col("predicate").isin("greater_than", "less_than")
    rows = rows.withColumns({"use": use, "holds": holds, "broken": use & numeric & (number.isNull() | limit.isNull())})
    out = rows.groupBy("check_id", "predicate", F.size("expected").alias("wanted")).agg(
        F.coalesce(F.sum(F.when(F.col("use"), F.col("n"))), F.lit(0)).alias("observed"), F.coalesce(F.sum(F.when(~F.col("use") & F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("ignored"),
        F.bool_and(F.when(F.col("use"), F.col("holds"))).alias("all"), F.bool_or(F.when(F.col("use"), F.col("holds"))).alias("some"), F.bool_or("broken").alias("broken"),
    )
    verdict = (
        F.when(F.col("observed") == 0, "insufficient").when(F.col("predicate") == "any", "pass").when(F.col("wanted") == 0, "unknown").when(F.coalesce("broken", F.lit(False)), "unknown")
        .when(F.col("all"), "pass").otherwise("fail")
    )
    out = out.withColumn("verdict", verdict)
    detail = (
        F.when((F.col("verdict") == "insufficient") & (F.col("ignored") > 0), "only_untrusted_observed").when(F.col("verdict") == "insufficient", "nothing_observed").when((F.col("verdict") == "unknown") & (F.col("wanted") == 0), "nothing_expected")
        .when(F.col("verdict") == "unknown", "not_a_number").when((F.col("verdict") == "fail") & (F.col("predicate") == "equals") & F.col("some"), "contradictory")
    )
    return out.select("check_id", "verdict", detail.alias("detail"), "observed", "ignored")


def checks_for(spark, target: str, peer: str, interface: str, prefix: str, remote_as: str) -> DataFrame:
    """The standard checks of one target."""
    bgp, link, route = f"bgp.peer.{peer}", f"iface.{interface}", f"route.{prefix}"
    rows = [
        ("iface_operational", f"{link}.oper", "equals", ["up"]), ("iface_admin_up", f"{link}.admin", "equals", ["up"]), ("iface_admin_down", f"{link}.admin", "equals", ["down"]),
        ("iface_oper_down", f"{link}.oper", "equals", ["down"]), ("reachability_ok", f"ping.{peer}.all_success", "equals", ["true"]), ("reachability_fails", f"ping.{peer}.all_success", "equals", ["false"]),
        ("bgp_peer_present", f"{bgp}.present", "equals", ["true"]), ("bgp_peer_absent", f"{bgp}.present", "equals", ["false"]), ("bgp_established", f"{bgp}.state", "equals", ["established"]),
        ("bgp_not_established", f"{bgp}.state", "not_equals", ["established"]), ("remote_as_equals", f"{bgp}.remote_as", "equals", [remote_as]), ("remote_as_differs", f"{bgp}.remote_as", "not_equals", [remote_as]),
        ("config_unchanged", "config.sha256", "any", []), ("route_present", f"{route}.present", "equals", ["true"]), ("route_absent", f"{route}.present", "equals", ["false"]),
    ]
    return spark.createDataFrame([(f"{target}:{n}", m, p, e, True) for n, m, p, e in rows], "check_id string, metric string, predicate string, expected array<string>, trusted_only boolean")


def metric_parts(metric: Column) -> Column:
    """``kind, entity, attribute`` of a metric key such as ``bgp.peer.<address>.state``."""
    pattern = r"^(bgp\.peer|iface|ping|route)\.(.+)\.([a-z_]+)$"
    return F.struct(*(F.regexp_extract(metric, pattern, k).alias(n) for k, n in enumerate(("kind", "entity", "attribute"), 1)))


def peer_state(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*STATES), low).otherwise("other")


def worst_state(states: Column) -> Column:
    """Aggregate: the worst of peer states; ``no_peer`` for none."""
    rank = F.create_map(*(F.lit(x) for i, s in enumerate(STATES) for x in (s, i)))
    return F.coalesce(F.min_by(peer_state(states), F.when(states.isNotNull(), F.element_at(rank, peer_state(states)))), F.lit("no_peer"))


def observable_features(evidence: DataFrame) -> DataFrame:
    """Features of each run from ``evidence(run_id, phase, metric, value)``: state of the onset (of the baseline where there is no
    onset), and changes between the two.  One shuffle to bring a run's entity together, one to sum entities up."""
    parts = evidence.withColumn("m", metric_parts(F.col("metric"))).filter("m.kind <> ''")
    at = lambda phase, name: F.max(F.when((F.col("side") == phase) & (F.col("m.attribute") == name), F.col("value")))
    side = F.when(F.col("phase") == "onset", "onset").when(F.col("phase").isin("baseline", "precondition"), "base")
    sides = parts.withColumn("side", side).filter("side is not null")
    names = ("state", "present", "remote_as", "admin", "oper", "all_success", "protocols")
    rows = sides.groupBy("run_id", F.col("m.kind").alias("kind"), F.col("m.entity").alias("entity")).agg(
        *(at(p, n).alias(f"{p[0]}_{n}") for p in ("base", "onset") for n in names), F.bool_or(F.col("side") == "onset").alias("o_seen"), F.bool_or(F.col("side") == "base").alias("b_seen")
    )
    runs = sides.groupBy("run_id").agg(F.bool_or(F.col("side") == "onset").alias("has_onset"))
    rows = rows.join(runs, "run_id")
    now = lambda n: F.when(F.col("has_onset"), F.col(f"o_{n}")).otherwise(F.col(f"b_{n}"))
    bgp_route = lambda s: F.coalesce((F.col(f"{s}_present") == "true") & F.contains(F.col(f"{s}_protocols"), F.lit("bgp")), F.lit(False))
    peer, link, ping, route = (F.col("kind") == k for k in ("bgp.peer", "iface", "ping", "route"))
    onset = F.col("has_onset")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.groupBy("run_id").agg(
        worst_state(F.when(peer & (F.coalesce(now("present"), F.lit("true")) != "false"), now("state"))).alias("worst_peer_state"),
        any_(link & (now("admin") == "down")).alias("any_admin_down"), any_(link & (now("oper") == "down")).alias("any_oper_down"),
        F.coalesce(F.bool_and(F.when(ping, F.coalesce(now("all_success"), F.lit("true")) == "true")), F.lit(True)).alias("all_reachable"),
        any_(onset & peer & (F.col("o_present") == "false")).alias("peer_removed"), any_(onset & peer & (F.col("b_remote_as") != F.col("o_remote_as"))).alias("remote_as_changed"),
        any_(onset & route & bgp_route("b") & ~bgp_route("o")).alias("route_withdrawn"),
    )


def bgp_metrics(text: Column) -> Column:
    """Metric map of a BGP summary; the state falls back to another key, and a missing address family gives no peers."""
    peers = F.from_json(text, "struct<ipv4Unicast: struct<peers: map<string, struct<state: string, peerState: string, remoteAs: bigint>>>>")["ipv4Unicast"]["peers"]
    entries = F.map_entries(F.coalesce(peers, F.from_json(F.lit("{}"), "map<string, struct<state: string, peerState: string, remoteAs: bigint>>")))
    key = lambda e, n: F.concat(F.lit("bgp.peer."), e["key"], F.lit(f".{n}"))
    values = lambda e: F.array(
        F.struct(key(e, "present").alias("key"), F.lit("true").alias("value")), F.struct(key(e, "remote_as").alias("key"), e["value"]["remoteAs"].cast("string").alias("value")),
        F.struct(key(e, "state").alias("key"), F.lower(F.coalesce(e["value"]["state"], e["value"]["peerState"])).alias("value")),
    )
    return F.map_from_entries(F.array_sort(F.filter(F.flatten(F.transform(entries, values)), lambda x: x["value"].isNotNull())))


def interface_metrics(text: Column) -> Column:
    """Metric map of interfaces, the first ``INTERFACES`` by name; what is down by the administrator is down in operation."""
    kind = "map<string, struct<administrativeStatus: string, adminStatus: string, operationalStatus: string, operStatus: string>>"
    entries = F.slice(F.array_sort(F.map_entries(F.coalesce(F.from_json(text, kind), F.from_json(F.lit("{}"), kind)))), 1, INTERFACES)
    admin = lambda e: F.lower(F.coalesce(e["value"]["administrativeStatus"], e["value"]["adminStatus"]))
    oper = lambda e: F.when(admin(e) == "down", "down").otherwise(F.lower(F.coalesce(e["value"]["operationalStatus"], e["value"]["operStatus"])))
    key = lambda e, n: F.concat(F.lit("iface."), e["key"], F.lit(f".{n}"))
    values = lambda e: F.array(F.struct(key(e, "admin").alias("key"), admin(e).alias("value")), F.struct(key(e, "oper").alias("key"), oper(e).alias("value")))
    return F.map_from_entries(F.filter(F.flatten(F.transform(entries, values)), lambda x: x["value"].isNotNull()))


def route_metrics(text: Column, prefixes: list[str]) -> Column:
    """Presence and protocols of the requested prefixes only."""
    kind = "map<string, array<struct<protocol: string>>>"
    routes = F.coalesce(F.from_json(text, kind), F.from_json(F.lit("{}"), kind))
    parts = []
    for p in sorted(prefixes):
        found = F.try_element_at(routes, F.lit(p))
        names = F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<struct<protocol: string>>")), lambda r: r["protocol"]))), ",")
        parts += [F.lit(f"route.{p}.present"), (F.coalesce(F.size(found), F.lit(0)) > 0).cast("string"), F.lit(f"route.{p}.protocols"), names]
    return F.create_map(*parts)


def ping_success(probes: Column) -> Column:
    """All probes of a non-empty array must succeed."""
    return (F.size(probes) > 0) & F.forall(probes, lambda p: p["ok"])


def config_digest(text: Column) -> Column:
    """Digest of a running configuration's first 64 KiB; empty is null."""
    return F.when(F.length(F.trim(text)) > 0, sha256_text(truncated_bytes(text, CONFIG_BYTES)))


def feature_text(rows: DataFrame) -> Column:
    """Observations as lines of ``name=value`` in order of name."""
    return F.array_join(F.array(*(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(rows.columns) if c != "run_id")), "\n")


def evidence_record(normalized: Column, **fields: Column) -> Column:
    """An evidence record with its id: a digest of all fields and of the observations (a map), in order of name."""
    entries = ordered_map(normalized)
    return F.struct(content_id("ev", record(normalized=entries, **fields)).alias("evidence_id"), entries.alias("normalized"), *(v.alias(k) for k, v in sorted(fields.items())))


def usable_output(status: Column, stdout: Column) -> Column:
    """Output of a command that ended well, else null; a collector refuses everything else."""
    return F.when(status == "ok", stdout)
