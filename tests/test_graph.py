import random

from lodestone.operators import graph, pairing


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def brute(edges):
    """Shortest paths from every node, by breadth."""
    on = {}
    for a, b in edges:
        on.setdefault(a, set()).add(b)
    found = {}
    for a in on:
        layer, depth = on[a], 1
        while layer:
            new = {b for b in layer if (a, b) not in found}
            found |= {(a, b): depth for b in new}
            layer, depth = {c for b in new for c in on.get(b, ())}, depth + 1
    return found


def test_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)]
    got = {(r.src, r.dst): r.depth for r in graph.closure(frame(spark, edges)).collect()}
    assert got == {(i, j): j - i for i in range(200) for j in range(i + 1, 201)}
    depth = {r.node: r.depth for r in graph.layers(frame(spark, edges)).collect()}
    assert depth == {i: 200 - i for i in range(201)}


def test_cycles_and_repeats(spark):
    r = random.Random(4)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(45)] + [(50, 50), (60, 61), (61, 60), (60, 61), (None, 3), (3, None)]
    clean = [e for e in edges if None not in e]
    want = brute(clean)
    assert {(x.src, x.dst): x.depth for x in graph.closure(frame(spark, edges)).collect()} == want
    mutual = {a: min(b for b in range(100) if (a, b) in want and (b, a) in want) for a in {e for p in clean for e in p} if (a, a) in want}
    got = {x.node: (x.cycle, x.length) for x in graph.cycles(frame(spark, edges)).collect()}
    assert got == {a: (c, want[a, a]) for a, c in mutual.items()} and got[50] == (50, 1) and got[60] == (60, 2)
    depth = {x.node: x.depth for x in graph.layers(frame(spark, edges)).collect()}
    assert depth.keys() == {n for e in clean for n in e}
    assert all(depth[a] > depth[b] for a, b in clean if a not in mutual or mutual.get(a) != mutual.get(b))


def test_empty(spark):
    assert graph.closure(frame(spark, [])).count() == 0 and graph.layers(frame(spark, [])).count() == 0


def test_parents_by_pointers(spark):
    chain = [(i, i + 1) for i in range(100_000)]
    got = {r["node"]: (r["root"], r["depth"]) for r in graph.subsumed(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert len(got) == 100_000 and got[0] == (100_000, 100_000) and got[99_999] == (100_000, 1)
    odd = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (None, 7), (8, None), (9, 9), (10, 12), (10, 11)]
    got = {r["node"]: (r["root"], r["depth"]) for r in graph.subsumed(spark.createDataFrame(odd, "src long, dst long")).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (None, None), 5: (6, 1), 9: (None, None), 10: (11, 1)}
    assert graph.subsumed(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_runs_between_branches(spark, monkeypatch):
    monkeypatch.setattr(pairing, "BLOCK", 3)
    line = lambda a, b: [(i, i + 1) for i in range(a, b)]
    cases = [
        line(0, 17) + line(100, 104) + [(17, 200), (17, 201), *line(200, 206), *line(201 + 50, 262), (201, 251), (206, 300), (262, 300), *line(300, 309)],  # two ways, of unlike length, meet again
        line(0, 11) + [(11, 4), (11, 50), *line(50, 58), (58, 0)],  # ways back into a run, and from its end to its start
        line(0, 9) + [(9, 0), (20, 21), (21, 22), (22, 20), (22, 30), *line(30, 41)],  # a ring without a branch; one with
    ]
    for edges in cases:
        assert {(x.src, x.dst): x.depth for x in graph.closure(frame(spark, edges)).collect()} == brute(edges)


def test_a_long_chain_writes_out_pairs_only_as_they_are_read(spark, monkeypatch):
    rows = []
    stage = graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: rows.append((made := stage(df, name)).count()) or made)
    assert graph.closure(frame(spark, [(i, i + 1) for i in range(1500)])).count() == 1500 * 1501 // 2
    assert max(rows) <= 1501
