import json
import random

import pytest
from pyspark.sql import functions as F

from veriloom.operators import eventlog as L
from veriloom.operators import evidence as V
from veriloom.operators import select as S
from veriloom.sources import jsonl, store

LEGAL = {"start": ("a",), "a": ("b",), "b": ("a", "c")}


@pytest.fixture(scope="module")
def log(spark):
    rows = [("x", 0, "a"), ("x", 1, "b"), ("x", 2, "c"), ("y", 0, "b"), ("y", 1, "a"), ("y", 3, "b")]
    return spark.createDataFrame(rows, "stream string, seq bigint, phase string")


def test_log_checks(log):
    bad = {(r["stream"], r["seq"]) for r in L.illegal_transitions(log, "stream", "seq", "phase", LEGAL).collect()}
    assert bad == {("y", 0)}
    assert {tuple(r) for r in L.sequence_gaps(log, "stream", "seq").collect()} == {("y", 3, 1, "gap")}
    assert {r["stream"]: r["is_prefix"] for r in L.phase_prefixes(log, "stream", "seq", "phase", ["a", "b", "c"]).collect()} == {"x": True, "y": False}


def test_chain_tamper(log):
    chain = L.build_chain(log, "stream", "seq", "phase").cache()
    assert L.broken_links(chain, "stream").count() == 0
    for column in ("payload", "hash", "previous"):
        bad = chain.withColumn(column, F.when((F.col("stream") == "x") & (F.col("seq") == 1), "evil").otherwise(F.col(column)))
        assert L.broken_links(bad, "stream").count() >= 1
    assert L.broken_links(chain.filter("not (stream = 'x' and seq = 1)"), "stream").count() == 1


def test_streaks_against_loop(spark):
    r = random.Random(1)
    rows = [(s, i, r.random() < 0.7) for s in range(20) for i in range(r.randrange(1, 30))]
    df = spark.createDataFrame(rows, "s int, i int, ok boolean").repartition(4)
    got = {x["s"]: x["confirmed_at"] for x in L.first_confirmation(df, "s", ["i"], F.col("ok"), 3).collect()}
    for s in range(20):
        streak, at = 0, None
        for n, (_, _, ok) in enumerate((x for x in rows if x[0] == s), 1):
            streak = streak + 1 if ok else 0
            at = n if streak == 3 and at is None else at
        assert got[s] == at


def test_store_round_trip_and_tamper(spark, log, tmp_path):
    artifacts = store.ArtifactStore(spark, str(tmp_path / "store"))
    artifacts.write("one", {"log": log, "other": log.limit(2)})
    assert artifacts.verify("one").filter("not passed").count() == 0
    assert artifacts.read("one")["log"].exceptAll(log).count() == 0
    with pytest.raises(store.ArtifactError):
        artifacts.write("one", {"log": log})
    log.withColumn("phase", F.when(F.col("seq") == 3, "z").otherwise(F.col("phase"))).write.mode("overwrite").parquet(str(tmp_path / "store/one/log"))
    assert {(r["rule"], r["detail"]) for r in artifacts.verify("one").filter("not passed").collect()} == {("digest", "log")}
    with pytest.raises(store.ArtifactError):
        artifacts.read("one")
    assert artifacts.verify("two").filter("not passed").count() == 1


def test_digest_ignores_order_but_not_repeats(spark, log):
    a = store.table_digest(log).first()
    assert a == store.table_digest(log.orderBy(F.desc("seq")).repartition(3)).first()
    assert a["digest"] != store.table_digest(log.unionByName(log.limit(1))).first()["digest"]
    assert store.table_digest(log.limit(0)).first()["rows"] == 0


def test_index(spark):
    index = spark.createDataFrame([("a", "1"), ("b", "2")], "run_id string, sha256 string")
    assert store.append_to_index(index, spark.createDataFrame([("c", "3")], index.schema)).count() == 3
    with pytest.raises(store.ArtifactError):
        store.append_to_index(index, spark.createDataFrame([("a", "3")], index.schema))
    with pytest.raises(store.ArtifactError):
        store.exactly_one(index, "run_id", "z")
    files = spark.createDataFrame([("p", b"x"), ("q", b"y")], "path string, content binary")
    listed = files.select("path", F.sha2("content", 256).alias("sha256")).filter("path = 'p'").unionByName(spark.createDataFrame([("r", "0")], "path string, sha256 string"))
    assert {tuple(r) for r in store.file_findings(listed, files).collect()} == {("q", "not_listed"), ("r", "missing")}


def test_lines(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n\n{"a":2}')
    found = {(r["path"].rsplit("/", 1)[1], r["rule"]) for r in jsonl.framing_findings(spark, str(tmp_path / "*.jsonl")).collect()}
    assert found == {("bad.jsonl", "no_final_line_feed"), ("bad.jsonl", "blank_line")}
    assert jsonl.read_strict(spark, str(tmp_path / "good.jsonl"), "a int").count() == 2
    lines = spark.createDataFrame([("s", 0, '{"a":1}'), ("s", 1, '{"a":'), ("t", 0, '{"a":'), ("t", 1, '{"a":2}')], "stream string, n int, line string")
    rows, findings = jsonl.read_torn_log(lines, "stream", "n", "line", "a int")
    assert rows.count() == 2 and {tuple(r)[:2] for r in findings.collect()} == {("t", 0)}


def test_tensor_headers(spark):
    header = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "__metadata__": {}}).encode()
    files = spark.createDataFrame([("m", len(header).to_bytes(8, "little") + header + b"\0" * 24)], "path string, content binary")
    assert tuple(jsonl.tensor_headers(files).first()) == ("m", "w", "F32", [2, 3], 6)


def test_device_json(spark):
    bgp = '{"ipv4Unicast":{"peers":{"10.0.0.1":{"state":"Established","remoteAs":65001},"10.0.0.2":{"peerState":"Idle","remoteAs":65002}}}}'
    df = spark.createDataFrame([(bgp, '{"eth0":{"administrativeStatus":"Down","operationalStatus":"up"},"eth1":{"adminStatus":"up","operStatus":"UP"}}', '{"10.1.0.0/24":[{"protocol":"bgp"},{"protocol":"static"},{"protocol":"bgp"}]}')], "b string, i string, r string")
    r = df.select(V.bgp_metrics(F.col("b")).alias("b"), V.interface_metrics(F.col("i")).alias("i"), V.route_metrics(F.col("r"), ["10.1.0.0/24", "10.2.0.0/24"]).alias("r"), V.bgp_metrics(F.lit("{}")).alias("e")).first()
    assert r["b"]["bgp.peer.10.0.0.2.state"] == "idle" and r["b"]["bgp.peer.10.0.0.1.remote_as"] == "65001" and r["e"] == {}
    assert r["i"] == {"iface.eth0.admin": "down", "iface.eth0.oper": "down", "iface.eth1.admin": "up", "iface.eth1.oper": "up"}
    assert r["r"] == {"route.10.1.0.0/24.present": "true", "route.10.1.0.0/24.protocols": "bgp,static", "route.10.2.0.0/24.present": "false", "route.10.2.0.0/24.protocols": ""}


def test_claims(spark):
    checks = V.checks_for(spark, "r1", "10.0.0.1", "eth0", "10.1.0.0/24", "65001")
    assert checks.count() == 15
    seen = spark.createDataFrame([("bgp.peer.10.0.0.1.state", "established", True), ("bgp.peer.10.0.0.1.state", "idle", True), ("iface.eth0.oper", "up", False), ("iface.eth0.admin", "up", True)], "metric string, value string, trusted boolean")
    rows = V.verify_claims(checks, seen).collect()
    got, details = ({r["check_id"].split(":")[1]: r[c] for r in rows} for c in ("verdict", "detail"))
    assert (got["bgp_established"], got["bgp_not_established"], got["iface_operational"], got["iface_admin_up"], got["iface_admin_down"]) == ("fail", "fail", "insufficient", "pass", "fail")
    assert (details["bgp_established"], details["bgp_not_established"], details["iface_operational"], details["route_present"]) == ("contradictory", None, "only_untrusted_observed", "nothing_observed")


def test_features(spark):
    rows = [("r", "baseline", "bgp.peer.p.state", "established"), ("r", "onset", "bgp.peer.p.state", "idle"), ("r", "baseline", "bgp.peer.p.remote_as", "1"), ("r", "onset", "bgp.peer.p.remote_as", "2"),
            ("r", "baseline", "route.x.present", "true"), ("r", "baseline", "route.x.protocols", "bgp"), ("q", "precondition", "iface.e.admin", "down"), ("q", "precondition", "ping.h.all_success", "false")]
    got = {r["run_id"]: r.asDict() for r in V.observable_features(spark.createDataFrame(rows, "run_id string, phase string, metric string, value string")).collect()}
    assert got["r"] == {"run_id": "r", "worst_peer_state": "idle", "any_admin_down": False, "any_oper_down": False, "all_reachable": True, "peer_removed": False, "remote_as_changed": True, "route_withdrawn": True}
    assert got["q"]["worst_peer_state"] == "no_peer" and got["q"]["any_admin_down"] and not got["q"]["all_reachable"] and not got["q"]["route_withdrawn"]


def test_round_robin_and_planner_against_loops(spark):
    r = random.Random(8)
    rows = [(f"e{i:03}", r.choice("fg"), f"g{r.randrange(9)}") for i in range(80)]
    df = spark.createDataFrame(rows, "example_id string, fault_family string, group_id string")
    got = {(x["fault_family"], x["example_id"]) for x in S.group_round_robin(df, 10).collect()}
    for fam in "fg":
        groups, picked, k = {}, [], 0
        for e, f, g in sorted(rows):
            if f == fam:
                groups.setdefault(g, []).append(e)
        while len(picked) < 10:
            picked += [groups[g][k] for g in sorted(groups) if k < len(groups[g])]
            k += 1
        assert {e for f, e in got if f == fam} == set(picked[:10])
    for seed in range(4):
        r = random.Random(seed)
        runs = {"test": 3, "validation": 3, "train": 2}
        pool = [(f"g{i:02}", r.choice("abc"), f"t{r.randrange(6)}", f"c{r.randrange(9)}", r.choice(["train"] * 4 + ["test", "validation"])) for i in range(30)]
        chosen = {g: 1 if p == "test" else 2 for g, *_, p in pool if p in ("test", "validation")}
        load = dict.fromkeys("abc", 0)
        for g, f, _, _, p in pool:
            load[f] += runs[p] if g in chosen else 0
        most = max(load.values())
        for g, f, _, _, p in pool:
            if g not in chosen and load[f] < most:
                chosen[g] = 3
                load[f] += runs[p]
        for rule, col in ((4, 2), (5, 3)):
            covered = {x[col] for x in pool if x[0] in chosen}
            for value in sorted({x[col] for x in pool} - covered):
                chosen[next(x[0] for x in pool if x[0] not in chosen and x[col] == value)] = rule
        plan = S.identity_first(spark.createDataFrame(pool, "group_id string, fault_family string, topology_hash string, case_id string, partition string"), runs)
        assert {x["group_id"]: x["rule"] for x in plan.collect()} == chosen
