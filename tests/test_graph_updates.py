"""Chains by doubling, and canonical entities after new edges, against plain walks."""

import random

import pytest

from tallyloom.operators.graph import canonicalise, chain_paths, latest_links, update_canonical


def walk(link, start):
    seen, at = [start], start
    while at in link:
        at = link[at]
        if at in seen:
            return seen, at, True
        seen.append(at)
    return seen, at, False


def latest(edges):
    best = {}
    for s, d, t in edges:
        if s not in best or (-t, d) < (-best[s][1], best[s][0]):
            best[s] = (d, t)
    return {s: d for s, (d, _) in best.items()}


def plain(edges):
    link = latest(edges)
    out = {}
    for s in link:
        seen, end, loop = walk(link, s)
        out[s] = (end, len(seen) if loop else len(seen) - 1, loop)
    return out


def got(df):
    return {r.id: (r.canonical_id, r.hops, r.loop) for r in df.collect()}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string, ts long")


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_by_doubling(spark, seed):
    r = random.Random(seed)
    edges = [(f"c{i}", f"c{i + 1}", 1) for i in range(37)] + [(f"e{r.randrange(40)}", f"e{r.randrange(40)}", r.randrange(5)) for _ in range(50)] + [("x", "x", 1)]
    link = latest(edges)
    ids = [f"c{i}" for i in range(0, 38, 5)] + [f"e{i}" for i in range(40)] + ["x", "alone"]
    want = sorted((i, h, at) for i in ids for h, at in enumerate(walk(link, i)[0]))
    assert sorted((p.id, p.hop, p["at"]) for p in chain_paths(frame(spark, edges), spark.createDataFrame([(i,) for i in ids], "id string")).collect()) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_update_equals_the_full_walk(spark, seed):
    r = random.Random(seed)
    name = lambda: f"e{r.randrange(60)}"
    edges = [(name(), name(), r.randrange(5)) for _ in range(45)] + [("again", "e1", 1)]
    links = frame(spark, edges)
    table, kept = canonicalise(links), latest_links(links)
    for turn in range(2):
        # Later targets, older ones that change nothing, links of ends, new loops and broken ones.
        delta = [(name(), name(), r.choice([0, 9 - turn, 20])) for _ in range(6)]
        # The same target at a later time stands against another one that is older than that.
        delta.append(("again", "e1", 30) if turn == 0 else ("again", "e2", 15))
        edges += delta
        table, kept, changed = update_canonical(table, kept, frame(spark, delta))
        assert got(table) == plain(edges)
        assert {x.src: x.dst for x in kept.collect()} == latest(edges)


def test_only_touched_chains_are_walked(spark):
    edges = [(f"a{i}", f"a{i + 1}", 1) for i in range(20)] + [(f"b{i}", f"b{i + 1}", 1) for i in range(20)] + [("l1", "l2", 1), ("l2", "l1", 1)]
    links = frame(spark, edges)
    table = canonicalise(links)
    delta = [("a20", "b5", 2), ("b3", "b4", 7)]
    after, kept, changed = update_canonical(table, links, frame(spark, delta))
    assert got(after) == plain(edges + delta)
    # The walk from the a's stops at b5, whose result stands.
    assert {r.id for r in changed.collect()} == {f"a{i}" for i in range(21)}
    same, _, nothing = update_canonical(after, kept, links.limit(0))
    assert nothing.count() == 0 and got(same) == got(after)


def test_loops_take_rounds_by_their_own_length(spark, monkeypatch):
    """64 loops of four with tails of six: the rounds follow them and not the number of entities."""
    from tallyloom.operators import graph

    edges = [(f"{n}-{i}", f"{n}-{0 if i == 3 else i + 1 if i < 3 else i - 1}") for n in range(64) for i in range(10)]
    rounds, double = [], graph._double
    monkeypatch.setattr(graph, "_double", lambda *a: rounds.append(1) or double(*a))
    got = canonicalise(spark.createDataFrame(edges, "src string, dst string")).where("id LIKE '7-%'")
    assert {r.id: (r.canonical_id, r.hops, r.loop) for r in got.collect()} == {f"7-{i}": (f"7-{i if i < 4 else 3}", 4 + max(0, i - 3), True) for i in range(10)}
    assert len(rounds) <= 8
