"""Paths from actors to techniques are dealt by how many they are, not by the bytes of what they come from."""

from fathom.operators import graph as G

NODE = "id string, type string, external_id string, phases array<struct<kill_chain_name:string,phase_name:string>>, revoked boolean, deprecated boolean"


def test_tasks_that_group_paths_go_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(G, "TOGETHER", 2, raising=False)
    phase = [("c", "t1")]
    nodes = [("g", "intrusion-set", None, None, False, False), ("s", "malware", None, None, False, False)]
    nodes += [(f"p{i}", "attack-pattern", f"T{1000 + i // 2}", phase if i < 20 else [("c", "t2")], False, False) for i in range(24)]
    edges = [("g", "uses", "s"), ("g", "uses", "p0"), ("g", "uses", "p22"), *(("s", "uses", f"p{i}") for i in range(24))]
    got = G.gold_techniques(spark.createDataFrame([("g", "t1"), ("g", None)], "actor string, tactic string"), spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "src string, rel string, dst string"))
    want = {("g", "t1", f"T{1000 + i}", i == 0, True) for i in range(10)} | {("g", None, f"T{1000 + i}", i in (0, 11), True) for i in range(12)}
    assert {tuple(r) for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == 13  # 22 by software and 3 at once, 2 a task
