import pytest
from pyspark.sql import functions as F

from veriloom.operators import policy as P

COMMANDS = [
    ([], "empty"), (["vtysh", "-c", "show ip bgp"], None), (["vtysh", "-c", "SHOW  running-config"], None), (["vtysh", "-c"], "dangling_flag"), (["vtysh"], "interactive"), (["vtysh", "-c", "configure"], "not_a_show_command"),
    (["vtysh", "-c", "show ip", "-c", "clear"], "not_a_show_command"), (["vtysh", "-c", "show write"], "forbidden_word"), (["vtysh", "-c", "-c"], "not_a_show_command"), (["ping", "x|y"], "metacharacter"), (["sh"], "binary_not_allowed"), (["ping", "10.0.0.1"], None),
]


def test_read_commands(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(COMMANDS)], "i int, argv array<string>")
    for r in df.select("i", P.read_command_violation(F.col("argv"), ("vtysh", "ping")).alias("v")).collect():
        assert r["v"] == COMMANDS[r["i"]][1], COMMANDS[r["i"]]


@pytest.mark.parametrize("commands, shape", [
    (["configure terminal", "router bgp 65001", "neighbor 10.0.0.1 remote-as 3"], "set_remote_as"), (["configure terminal"], None), (["configure terminal", "interface eth1", "no shutdown"], "interface_up"),
    (["configure terminal", "interface lo", "shutdown"], None), (["configure terminal", "router bgp 1", "no neighbor 10.0.0.1", "x"], None), (["configure terminal", "router bgp 1", "neighbor 10.0.0.1 remote-as 3\n"], None),
])
def test_shapes(spark, commands, shape):
    df = spark.createDataFrame([(commands,)], "c array<string>")
    got = df.select(P.mutation_shape(F.col("c")).alias("s")).first()["s"]
    assert got == shape or commands[-1].endswith("\n")


def test_cases(spark):
    rows = [("remote_as", "r1", "r1", "7", 1, 2, "eth0", None, "10.0.0.1/32", None), ("remote_as", "r1", "r1", "1", 1, 2, None, None, None, "number_is_local"), ("remote_as", "r1", "r1", "x", 1, 2, None, None, None, "number_malformed"),
            ("remote_as", "r1", "r1", "0", 1, 2, None, None, None, "number_out_of_range"), ("remote_as", "", "", None, 1, 2, None, None, None, "target_missing"), ("interface", "r1", "r1", None, 1, 2, "lo", None, None, "interface_not_allowed"),
            ("prefix", "r1", "r1", None, 1, 2, None, "10.0.0.2/32", "10.0.0.1/32", "prefix_not_announced"), ("prefix", "r1", "r1", None, 1, 2, None, None, "10.0.0.1/32", None), ("neighbor", "r1", "r2", None, 1, 2, None, None, None, "expected_target_differs"),
            ("neighbor", "r1", "r1", None, 1, None, None, None, None, "session_unknown"), ("other", "r1", "r1", None, 1, 2, None, None, None, "template_unknown")]
    names = ["template", "target", "expected", "wrong_asn", "local_asn", "peer_asn", "interface", "prefix", "loopback"]
    df = spark.createDataFrame(rows, "template string, target string, expected string, wrong_asn string, local_asn bigint, peer_asn bigint, interface string, prefix string, loopback string, want string")
    for r in df.select("*", P.case_violation(*map(F.col, names)).alias("got")).collect():
        assert r["got"] == r["want"], r
