import json

import pytest
from pyspark.sql import functions as F

from veriloom.functions import collectors
from veriloom.operators import evidence


@pytest.fixture(scope="module")
def rows(spark):
    collectors.register(spark)

    def run(call, outputs):
        spark.createDataFrame([(k, *x) for k, x in enumerate(outputs)], "k int, status string, stdout string").createOrReplaceTempView("outputs")
        return sorted((tuple(r) for r in spark.sql(f"SELECT o.k, m.* FROM outputs o, LATERAL {call} m").collect()), key=repr)

    return run


def test_four_collectors(rows):
    bgp = {"ipv4Unicast": {"peers": {"10.0.0.1": {"state": "Established", "remoteAs": 65001}, "10.0.0.2": {"peerState": "Idle"}}}}
    assert rows("collect_bgp(o.status, o.stdout)", [("ok", json.dumps(bgp)), ("ok", "{}")]) == [
        (0, "bgp.peer.10.0.0.1.present", "true", None), (0, "bgp.peer.10.0.0.1.remote_as", "65001", None), (0, "bgp.peer.10.0.0.1.state", "established", None), (0, "bgp.peer.10.0.0.2.present", "true", None),
        (0, "bgp.peer.10.0.0.2.state", "idle", None),
    ]
    faces = {"e1": {"administrativeStatus": "Down", "operationalStatus": "up"}, "e0": {"adminStatus": "up", "operStatus": "UP"}}
    assert rows("collect_interfaces(o.status, o.stdout)", [("ok", json.dumps(faces))]) == [(0, "iface.e0.admin", "up", None), (0, "iface.e0.oper", "up", None), (0, "iface.e1.admin", "down", None), (0, "iface.e1.oper", "down", None)]
    routes = {"10.1.0.0/24": [{"protocol": "static"}, {"protocol": "bgp"}], "10.9.0.0/24": [{"protocol": "x"}]}
    assert rows("collect_routes(o.status, o.stdout, '10.1.0.0/24,10.2.0.0/24')", [("ok", json.dumps(routes))]) == [
        (0, "route.10.1.0.0/24.present", "true", None), (0, "route.10.1.0.0/24.protocols", "bgp,static", None), (0, "route.10.2.0.0/24.present", "false", None), (0, "route.10.2.0.0/24.protocols", "", None),
    ]
    pings = {"a": [{"ok": True}] * 3, "b": [{"ok": True}, {"ok": False}], "c": []}
    assert [r[2] for r in rows("collect_pings(o.status, o.stdout, 2)", [("ok", json.dumps(pings))]) if r[1].endswith("success")] == ["true", "false", "false"]


@pytest.mark.parametrize("stdout, error", [("", "not JSON"), (None, "not JSON"), ("[1]", "summary is no object"), ('{"ipv4Unicast":[1]}', "family is no object"), ('{"ipv4Unicast":{"peers":{"a":1}}}', "peer is no object"), ("{", "not JSON")])
def test_bad_output_is_a_row_of_its_own(rows, stdout, error):
    assert rows("collect_bgp(o.status, o.stdout)", [("ok", stdout), ("timeout", "{}"), (None, None)]) == sorted([(0, None, None, error), (1, None, None, "status timeout"), (2, None, None, "status None")], key=repr)


@pytest.mark.parametrize("call", ["collect_bgp(o.status)", "collect_bgp(o.k, o.stdout)", "collect_routes(o.status, o.stdout, o.stdout)", "collect_pings(o.status, o.stdout, 'x')", "collect_routes(o.status, o.stdout)"])
def test_wrong_arguments_fail_before_the_query_runs(spark, rows, call):
    rows("collect_bgp(o.status, o.stdout)", [("ok", "{}")])
    with pytest.raises(Exception, match="takes"):
        spark.sql(f"SELECT * FROM outputs o, LATERAL {call} m")


def test_collectors_agree_with_the_column_functions(spark, rows):
    texts = ['{"ipv4Unicast":{"peers":{"1.1.1.%d":{"state":"%s","remoteAs":%d}}}}' % (k, "Active" if k % 2 else "IDLE", k) for k in range(20)]
    got = {(k, m, v) for k, m, v, _ in rows("collect_bgp(o.status, o.stdout)", [("ok", t) for t in texts])}
    want = spark.table("outputs").select("k", F.explode(evidence.bgp_metrics(F.col("stdout"))).alias("m", "v"))
    assert got == {tuple(r) for r in want.collect()}
