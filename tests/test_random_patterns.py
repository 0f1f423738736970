"""Random patterns over a small graph, against a search that tries everything."""

import random

import pytest

from quiverlane.graph import PropertyGraph
from quiverlane.session import connect


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A connection, and its nodes (labels, x) and edges (source, target, type) as plain values."""
    rnd = random.Random(11)
    a = [(i, rnd.randrange(3), rnd.choice([None, *range(4)])) for i in range(6)]
    b = [(i, rnd.randrange(3)) for i in range(4)]
    links = [(rnd.randrange(6), rnd.randrange(6)) for _ in range(7)] + [(2, 2)]
    backs = [(i, rnd.randrange(4), rnd.randrange(6)) for i in range(6)]
    folder = str(tmp_path_factory.mktemp("world"))
    spark.createDataFrame(links, "s long, t long").write.parquet(folder + "/links")
    ta = spark.createDataFrame(a, "id long, x int, b long")
    graph = PropertyGraph().with_nodes(("A", "T"), ta, "id", ["x"]).with_nodes("B", spark.createDataFrame(b, "id int, x int"), "id", ["x"])
    graph = graph.with_edges("OWN", ta, ("A", "id"), ("B", "b"), "id", ["x"])
    graph = graph.with_edges("LINK", spark.read.parquet(folder + "/links"), ("A", "s"), ("A", "t"))
    graph = graph.with_edges("BACK", spark.createDataFrame(backs, "id long, s long, t long"), ("B", "s"), ("A", "t"), "id")
    connection = connect(spark, graphs={"default": graph})
    connection.execute_oc_query("MATCH (a:A) WHERE a.x = 1 CREATE (a)-[:NEW]->(:C {x: 2}), (:C:T {x: 0})-[:NEW]->(a)")
    nodes = {("A", i): (("A", "T"), x) for i, x, _ in a} | {("B", i): (("B",), x) for i, x in b}
    edges = [(("A", i), ("B", r), "OWN") for i, _, r in a if r is not None]
    edges += [(("A", s), ("A", t), "LINK") for s, t in links] + [(("B", s), ("A", t), "BACK") for _, s, t in backs]
    for i, x, _ in a:
        if x == 1:
            nodes |= {("C", i): (("C",), 2), ("D", i): (("C", "T"), 0)}
            edges += [(("A", i), ("C", i), "NEW"), (("D", i), ("A", i), "NEW")]
    return connection, nodes, edges


def random_chain(rnd, seen):
    """A chain as text and as (nodes, edges): variables are declared where they first stand."""
    nodes, edges, text = [], [], ""
    for k in range(rnd.choice([1, 2, 2, 3])):
        name = rnd.choice(["a", "b", "c", "d", None])
        labels = rnd.choice(["", "", ":A", ":B", ":C", ":T", ":A|B", ":C:T", ":B|C"]) if name not in seen or name is None else ""
        x = rnd.choice([None, None, None, 0, 1, 2]) if name not in seen or name is None else None
        if name:
            seen.add(name)
        nodes.append((name, labels, x))
        if k:
            edge = rnd.choice([("->", "-[{}]->"), ("<-", "<-[{}]-"), ("--", "-[{}]-")])
            kind = rnd.choice(["", "", ":OWN", ":LINK", ":BACK", ":NEW", ":OWN|LINK", ":LINK|NEW"])
            edges.append((edge[0], kind))
            text += edge[1].format(kind)
        text += f"({name or ''}{labels}{'' if x is None else f' {{x: {x}}}'})"
    return text, nodes, edges


def holds(labels, wanted):
    if not wanted:
        return True
    return any(p in labels for p in wanted[1:].split("|")) if "|" in wanted else all(p in labels for p in wanted[1:].split(":"))


def search(world, chains, bound):
    """All bindings of the chains' variables, as (variables, edges used)."""
    _, nodes, edges = world
    found = [(dict(bound), ())]
    for _, pattern, links in chains:
        next_found = []
        for variables, used in found:
            partial = [(variables, used, None)]
            for k, (name, labels, x) in enumerate(pattern):
                step = []
                for v, u, at in partial:
                    if k == 0:
                        ends = [(n, None) for n in nodes]
                    else:
                        way, kind = links[k - 1]
                        ends = []
                        for i, (s, t, label) in enumerate(edges):
                            if i in u or not holds((label,), kind):
                                continue
                            if way != "<-" and s == at:
                                ends.append((t, i))
                            if way != "->" and t == at and (s != t or way == "<-"):
                                ends.append((s, i))
                    for n, i in ends:
                        if name in v and v[name] != n or not holds(nodes[n][0], labels) or x is not None and nodes[n][1] != x:
                            continue
                        step.append(({**v, **({name: n} if name else {})}, u if i is None else (*u, i), n))
                partial = step
            next_found += [(v, u) for v, u, _ in partial]
        found = next_found
    return [v for v, _ in found]


def columns(names):
    return ", ".join(["count(*) AS n", *[f"sum({n}.x) AS s{n}, count({n}) AS c{n}" for n in names]])


def totals(world, rows, names):
    out = [len(rows)]
    for n in names:
        xs = [world[1][r[n]][1] for r in rows if r.get(n) is not None]
        out += [sum(xs) if xs else None, len(xs)]
    return out


@pytest.mark.parametrize("seed", range(45))
def test_match(world, seed):
    rnd = random.Random(seed)
    seen = set()
    chains = [random_chain(rnd, seen) for _ in range(rnd.choice([1, 1, 2]))]
    # half of the time, nobody asks for some of the nodes
    names = sorted(n for n in seen if rnd.random() < 0.6)
    text = "MATCH " + ", ".join(c[0] for c in chains) + " RETURN " + columns(names)
    assert world[0].execute_oc_query(text)[1] == totals(world, search(world, chains, {}), names), text


@pytest.mark.parametrize("seed", range(25))
def test_match_after_match(world, seed):
    rnd = random.Random(1000 + seed)
    seen = set()
    first, second = random_chain(rnd, seen), random_chain(rnd, seen)
    optional = rnd.random() < 0.6
    names = sorted(seen)
    text = f"MATCH {first[0]} {'OPTIONAL ' * optional}MATCH {second[0]} RETURN " + columns(names)
    rows = []
    for v in search(world, [first], {}):
        more = search(world, [second], v)
        rows += more or ([v] if optional else [])
    assert world[0].execute_oc_query(text)[1] == totals(world, rows, names), text
