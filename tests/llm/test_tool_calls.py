import json

from pyspark.sql import functions as F

from tidewheel.llm import tool_calls as tc


def frames(spark, calls, results):
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after string")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    return c.withColumn("args", F.lit("clash")).withColumn("level", F.lit(1)), r.withColumn("status", F.lit("clash"))


def linked(spark, calls, results):
    rows = tc.link(*frames(spark, calls, results), tc.rules_table(spark)).collect()
    return {(r.conv_id, r.call_id): r for r in rows}, rows


def test_links_orders_and_validates(spark):
    calls = [
        (1, "a", 1, "search", '{ "query": "x", "limit": 5 }', None),
        (1, "b", 0, "search", '{"limit": 99, "query": 7, "z": {"b": 1, "a": [1, {"d": 1, "c": 2}]}}', "a"),
        (1, "c", 2, "calculate", '{"a": 1.5}', "b"),
        (1, "d", 3, "nothing", "{}", "zz"),
        (1, "e", 4, "search", "{broken", "f"),
        (1, "f", 5, "translate", '{"text": "t", "to": "xx"}', "e"),
        (1, "g", 6, "translate", None, "f"),
        (2, "a", 1, "search", '{"query": null}', None),
        (2, "a", 1, "search", '{"query": null}', None),
        (None, None, None, None, None, None),
    ]
    results = [(1, "a", 2, "one"), (1, "a", 1, "zero"), (1, "c", 1, "early"), (3, "q", 7, None)]
    got, rows = linked(spark, calls, results)
    assert [got[1, x].level for x in "abcdefg"] == [0, 1, 2, 0, None, None, None]
    assert [got[1, x].parent for x in "abcdefg"] == ["root", "parent", "parent", "no_parent", "cycle", "cycle", "cycle"]
    assert [got[1, x].position for x in "adbcefg"] == list(range(7))
    assert got[1, "b"].errors == ["range:limit", "type:query", "unknown:z"]
    assert got[1, "c"].errors == ["missing:b", "type:a"] and got[1, "d"].errors == ["tool"]
    assert got[1, "e"].errors == ["json"] and got[1, "g"].errors == ["json"] and got[1, "f"].errors == ["value:to"]
    assert got[2, "a"].errors == ["missing:query"] and got[2, "a"].n_calls == 2
    assert (got[1, "a"].n_results, got[1, "a"].status, got[1, "c"].status, got[3, "q"].status) == (2, "early_result", "early_result", "orphan_result")
    assert got[1, "a"].valid and not got[1, "b"].valid and not got[3, "q"].valid
    assert got[1, "b"].canonical == '{"arguments":{"limit":99,"query":7,"z":{"a":[1,{"c":2,"d":1}],"b":1}},"id":"b","name":"search"}'
    for r in rows:
        if r.canonical:
            assert r.canonical == json.dumps(json.loads(r.canonical), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_long_chains_and_empty(spark):
    calls = [(7, f"c{i}", 500 - i, "search", '{"query": "q"}', f"c{i - 1}" if i else None) for i in range(500)]
    got, _ = linked(spark, calls, [])
    assert all(got[7, f"c{i}"].level == i == got[7, f"c{i}"].position for i in range(500))
    assert linked(spark, [], [])[1] == []


def test_null_ids_stay(spark):
    calls = [(None, None, None, None, None, None), (None, "a", 1, "search", '{"query": "x"}', None), (1, None, 3, "search", '{"query": "y"}', None)]
    got, rows = linked(spark, calls, [(None, "q", 7, "lost"), (1, "b", 4, "r")])
    assert len(rows) == 5 and all(got[k].status == "no_result" and got[k].level == 0 for k in [(None, None), (None, "a"), (1, None)])
    assert got[None, "q"].status == got[1, "b"].status == "orphan_result"
    assert [got[None, x].position for x in (None, "a", "q")] == [0, 1, 2]


def test_integers_however_they_are_written(spark):
    bodies = {"5": True, "5.0": True, "5e0": True, "12345678901234567890": True, "123456789012345678901234567890": True, "5.5": False, "1e400": False, '"5"': False, "true": False, "12345678901234567890.5": False}
    calls = [(1, b, i, "calculate", f'{{"a": 1, "b": {b}}}', None) for i, b in enumerate(bodies)]
    got, _ = linked(spark, calls, [])
    for b, fine in bodies.items():
        assert (got[1, b].errors == []) == fine, (b, got[1, b].errors)


def test_nulls_and_repeated_keys_in_arguments(spark):
    got, _ = linked(spark, [(1, "a", 0, "search", '{"query": "x", "limit": null}', None), (1, "b", 1, "search", '{"query": "x", "query": "y"}', None)], [])
    assert got[1, "a"].errors == [] and got[1, "a"].canonical == '{"arguments":{"limit":null,"query":"x"},"id":"a","name":"search"}'
    assert got[1, "b"].errors == ["json"]


def test_many_calls_name_one(spark, monkeypatch):
    from tidewheel.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    calls = [(5, "root", 0, "search", '{"query": "q"}', None)] + [(5, f"k{i:03d}", i + 1, "search", '{"query": "q"}', "root") for i in range(200)] + [(6, "x", 1, "search", '{"query": "q"}', "root")]
    got, rows = linked(spark, calls, [(5, "k007", 300, "r")])
    assert len(rows) == 202 and {got[5, f"k{i:03d}"].level for i in range(200)} == {1}
    assert [got[5, f"k{i:03d}"].position for i in range(200)] == list(range(1, 201)) and got[6, "x"].parent == "no_parent"


def longest_ways(calls):
    """call -> (level, parent) of calls {call: parents}, by repeated relaxation."""
    known = {c: {p for p in ps or () if p in calls} for c, ps in calls.items()}
    level = {}
    for _ in calls:
        for c, ps in known.items():
            if c not in level and all(p in level for p in ps):
                level[c] = 1 + max((level[p] for p in ps), default=-1)
    return {c: (level.get(c), "cycle" if c not in level else "parent" if known[c] else "no_parent" if calls[c] else "root") for c in calls}


def test_several_parents(spark):
    import random

    diamond = {"a": None, "b": ["a"], "c": ["b"], "d": ["a"], "e": ["c", "d", "d"], "f": ["e", "zz"], "g": ["zz"], "h": ["h"], "i": ["h", "a"], "j": ["k"], "k": ["j"], "l": ["j"], "m": [], "n": ["f", "g"]}
    r = random.Random(1)
    mixed = {f"c{i}": [f"c{j}" for j in r.sample(range(i), min(i, r.choice([0, 1, 1, 1, 2, 3])))] for i in range(60)}
    looped = mixed | {"c10": ["c50"], "x": ["c3"]}
    chain = {f"k{i}": [f"k{i - 1}"] if i else None for i in range(300)} | {"end": ["k299", "k5"]}
    graphs = {1: diamond, 2: mixed, 3: looped, 4: chain, 5: {}}
    rows = [(v, c, ps) for v, g in graphs.items() for c, ps in g.items()]
    got = tc.graph_levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>").repartition(3)).collect()
    assert {(r.conv_id, r.call_id): (r.level, r.parent) for r in got} == {(v, c): x for v, g in graphs.items() for c, x in longest_ways(g).items()}
    calls = spark.createDataFrame([(1, c, i, "search", '{"query": "q"}', ps) for i, (c, ps) in enumerate(diamond.items())], "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    linked_rows = tc.link(calls, spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), tc.rules_table(spark)).collect()
    place = {r.call_id: r.position for r in linked_rows}
    assert all(place[p] < place[c] for c, ps in diamond.items() if c in "bcdefn" for p in ps if p in diamond)
    assert tc.graph_levels(calls.limit(0)).count() == 0
