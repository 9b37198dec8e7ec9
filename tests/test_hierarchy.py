import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest

from leafline.operators import hierarchy

NODE = "node_id string, level int, parent_ids array<string>, child_ids array<string>, built_at timestamp, id string, up string"
T0 = datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra", "extra") for r in rows], NODE)


def brute(rows):
    last = {}
    for r in rows:
        if r[0] is not None and (r[0] not in last or (r[4] or datetime.min) >= (last[r[0]][4] or datetime.min)):
            last[r[0]] = r
    edges = set()
    for n, _, up, down, _ in last.values():
        edges |= {(p, n) for p in up or [] if p in last} | {(n, c) for c in down or [] if c in last}
    kids, parents = defaultdict(set), defaultdict(set)
    for a, b in edges:
        kids[a].add(b)
        parents[b].add(a)
    depth = {n: 0 for n in last if not parents[n]}
    queue = deque(depth)
    while queue:
        a = queue.popleft()
        for b in kids[a]:
            if b not in depth:
                depth[b] = depth[a] + 1
                queue.append(b)
    cyclic = set()
    for n in last:
        seen, todo = set(), list(kids[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += kids[x]
        if n in seen:
            cyclic.add(n)
    return last, parents, depth, cyclic


def random_graph(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 60)
    ids = [f"n{i}" for i in range(n)]
    rows = []
    for i, name in enumerate(ids):
        up = []
        if i and rng.random() < 0.9:
            up = [ids[max(0, i - rng.choice([1, 1, 1, 2, 5]))]]
        if rng.random() < 0.08:
            up.append(rng.choice(ids))
        if rng.random() < 0.05:
            up.append(None)
        down = [rng.choice([*ids, "ghost"])] if rng.random() < 0.04 else rng.choice([None, []])
        rows.append((name, rng.choice([None, 0, 1, 2, 3]), up or None, down, T0))
        if rng.random() < 0.1:
            rows.append((name, 9, [rng.choice(ids)], None, T0 - timedelta(days=1)))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("seed", [3])
def test_equals_brute_force(spark, seed):
    rows = [r for k in range(20) for r in [tuple([f"{k}-{x}" if isinstance(x, str) else [f"{k}-{y}" if y else y for y in x] if isinstance(x, list) else x for x in row]) for row in random_graph(seed * 10 + k)]]
    last, parents, depth, cyclic = brute(rows)
    labels = hierarchy.label(frame(spark, rows))
    got = {(r["issue"], r["node_id"]) for r in hierarchy.issues(None, labels).collect()}
    want = {("cycle", n) for n in cyclic} | {("level", n) for n, d in depth.items() if last[n][1] is not None and last[n][1] != d}
    assert got == want
    found = {r["node_id"]: r for r in hierarchy.paths(labels).collect()}
    assert set(found) == set(last)
    for n, r in found.items():
        assert r["depth"] == depth.get(n) and r["in_cycle"] == (n in cyclic)
        if n in depth:
            path = r["path"]
            assert path[-1] == n and path[0] == r["root_id"] and len(path) == depth[n] + 1
            assert all(a in parents[b] for a, b in zip(path, path[1:]))
        else:
            assert r["path"] is None and r["root_id"] is None
    tree = {r["id"]: r for r in labels.tree.collect()}
    for r in tree.values():  # heavy paths: a chain has the largest child next, and the places count up from its head
        kids = [k for k in tree.values() if k["parent"] == r["id"]]
        assert r["size"] == 1 + sum(k["size"] for k in kids)
        if kids:
            heavy = min(kids, key=lambda k: (-k["size"], k["id"]))
            assert [(k["chain"] == r["chain"], k["chain"] == k["id"]) for k in kids] == [(k is heavy, k is not heavy) for k in kids] and heavy["pos"] == r["pos"] + 1


@pytest.mark.parametrize("rows", [
    [r for k in range(8) for r in [tuple([f"{k}-{x}" if isinstance(x, str) else [f"{k}-{y}" if y else y for y in x] if isinstance(x, list) else x for x in row]) for row in random_graph(70 + k)]],
    [("top", 0, None, ["a", "b"], T0), ("a", 1, None, ["low"], T0), ("b", 1, None, ["low"], T0), ("low", 2, None, None, T0), ("x", 0, ["y"], None, T0), ("y", 0, ["x"], None, T0), ("z", 0, ["y"], None, T0)],
    [(f"{i:02d}", i, [f"{i - 1:02d}"] if i else None, None, T0) for i in range(40)], [],
])
def test_all_descendants_over_every_link(spark, rows):
    last, parents, _, cyclic = brute(rows)
    kids, want = defaultdict(set), {}
    for child, ups in parents.items():
        for up in ups:
            kids[up].add(child)
    for n in last:
        todo = deque((k, 1) for k in kids[n])
        while todo:
            d, steps = todo.popleft()
            if (n, d) not in want:
                want[n, d] = steps
                todo += [(k, steps + 1) for k in kids[d]]
    labels = hierarchy.label(frame(spark, rows))
    got = hierarchy.all_descendants(labels).collect()
    assert len(got) == len(want) and {(r["node_id"], r["descendant_id"]): r["links"] for r in got} == want
    assert {n for n, d in want if n == d} == cyclic
    if rows and len(rows) < 10:
        counts = {r["node_id"]: r["n_descendants"] for r in hierarchy.paths(labels).collect()}
        assert counts == {n: sum(a == n for a, _ in want) for n in last} and counts["a"] == counts["b"] == 1 and counts["x"] == 3


def test_edges_of_the_definition(spark):
    rows = [
        ("self", 0, ["self"], None, T0), ("a", 5, ["b"], None, T0), ("b", None, ["a"], None, T0), ("hang", 3, ["a"], None, T0),
        ("root", 1, ["ghost", None], ["kid", "kid", None], T0), ("kid", 1, None, None, T0), (None, 1, None, None, T0), ("late", 0, None, None, None), ("late", 7, None, None, T0),
    ]
    got = {(r["issue"], r["node_id"]) for r in hierarchy.issues(frame(spark, rows)).collect()}
    assert got == {("cycle", "self"), ("cycle", "a"), ("cycle", "b"), ("level", "root"), ("level", "late")}


def test_long_chain_and_empty(spark):
    rows = [(f"{i:04d}", i, [f"{i - 1:04d}"] if i else None, None, T0) for i in range(300)]
    labels = hierarchy.label(frame(spark, rows))
    assert hierarchy.issues(None, labels).collect() == []
    last = [r for r in hierarchy.paths(labels).collect() if r["node_id"] == "0299"][0]
    assert last["depth"] == 299 and last["path"] == [r[0] for r in rows]
    nothing = hierarchy.label(frame(spark, []))
    assert hierarchy.issues(None, nothing).collect() == [] and hierarchy.paths(nothing).collect() == [] and hierarchy.all_descendants(nothing).collect() == []


def test_long_chains_are_opened_by_segments(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "SEGMENT", 7)
    rows = [(f"{i:02d}", i, [f"{i - 1:02d}"] if i else None, None, T0) for i in range(40)] + [("side", 1, ["20"], None, T0), ("low", 1, ["side", "03"], None, T0)]
    got = {(r["node_id"], r["descendant_id"]): r["links"] for r in hierarchy.all_descendants(hierarchy.label(frame(spark, rows))).collect()}
    want = {(f"{i:02d}", f"{j:02d}"): j - i for i in range(40) for j in range(i + 1, 40)} | {(f"{i:02d}", "side"): 21 - i for i in range(21)}
    want |= {(f"{i:02d}", "low"): 4 - i if i < 4 else 22 - i for i in range(21)} | {("side", "low"): 1}
    assert got == want
