import hashlib
import itertools
import random

from wanderlens.operators.community import communities
from wanderlens.operators.social import undirected_pairs
from wanderlens.sources.derived import DerivedInputs


def test_cliques_on_a_ring(spark):
    size, count = 7, 6
    groups = [[g * 10 + i for i in range(size)] for g in range(count)]
    edges = [(a, b, 3) for group in groups for a, b in itertools.combinations(group, 2)]
    edges += [tuple(sorted((groups[g][0], groups[(g + 1) % count][1]))) + (1,) for g in range(count)]
    edges += [(999, 999, 5)]
    pairs = spark.createDataFrame(edges, "a long, b long, freq long")
    found = {r["user_id"]: r["community"] for r in communities(pairs).collect()}
    assert found == {u: group[0] for group in groups for u in group}


def test_no_calls(spark):
    assert communities(spark.createDataFrame([], "a long, b long, freq long")).count() == 0


def test_a_long_chain_of_cliques_is_not_cut_short(spark):
    """Cliques of equal ties merge over several levels, and the rows' order does not matter."""
    size, count = 3, 40
    edges = [(g * 10 + a, g * 10 + b, 1) for g in range(count) for a, b in itertools.combinations(range(size), 2)]
    edges += [(g * 10, (g + 1) * 10 + 1, 1) for g in range(count - 1)]
    pairs = spark.createDataFrame(edges, "a long, b long, freq long")
    found = {r["user_id"]: r["community"] for r in communities(pairs).collect()}
    again = {r["user_id"]: r["community"] for r in communities(pairs.repartition(5)).collect()}
    assert found == again
    assert modularity(edges, found) > 0.65
    assert len(set(found.values())) < size * count / 2


def modularity(edges, label):
    total, inside, degree = 2 * sum(w for *_, w in edges), 0, {}
    for a, b, w in edges:
        inside += 2 * w * (label[a] == label[b])
        degree[label[a]] = degree.get(label[a], 0) + w
        degree[label[b]] = degree.get(label[b], 0) + w
    return inside / total - sum((k / total) ** 2 for k in degree.values())


def plain_louvain(edges, min_gain=1e-4):
    """The rule of ``communities`` in plain Python, one node after the other."""
    arrows = {}
    for a, b, w in edges:
        if a != b:
            arrows.setdefault(a, {})[b] = arrows.setdefault(b, {})[a] = w
    total = sum(w for to in arrows.values() for w in to.values())
    member = {u: u for u in arrows}
    if not total:
        return member

    def quality(label):
        degree, inside = {}, {}
        for u, to in arrows.items():
            for v, w in to.items():
                degree[label[u]] = degree.get(label[u], 0) + w
                inside[label[u]] = inside.get(label[u], 0) + w * (label[u] == label[v])
        return sum(inside[c] * total - degree[c] ** 2 for c in degree)

    step = int(min_gain * total * total)
    while True:
        k = {u: sum(to.values()) for u, to in arrows.items()}
        label = {u: u for u in arrows}
        before = value = quality(label)
        best, turn, idle = label, 0, 0
        while idle < 2:
            group = {}
            for u, c in label.items():
                group[c] = group.get(c, 0) + k[u]
            wishes = {}
            for u, to in arrows.items():
                weight = {label[u]: 0}
                for v, w in to.items():
                    if v != u:
                        weight[label[v]] = weight.get(label[v], 0) + w
                score = {c: w * total - k[u] * (group[c] - k[u] * (c == label[u])) for c, w in weight.items()}
                c = min(score, key=lambda c: (-score[c], c != label[u], c))  # noqa: B023
                if c != label[u]:
                    draw = hashlib.md5(f"{turn}:{u}".encode()).hexdigest()
                    wishes[u] = (c, score[label[u]] - score[c], draw)
            if not wishes:
                break
            moves = {u for u, w in wishes.items() if all((*w[1:], u) < (*wishes[v][1:], v) for v in arrows[u] if v != u and v in wishes)}
            label = {u: wishes[u][0] if u in moves else c for u, c in label.items()}
            moved, turn = quality(label), turn + 1
            idle = 0 if moved > value + step else idle + 1
            if moved > value:
                best, value = label, moved
        split = {}
        for u in sorted(arrows):
            todo = [] if u in split else [u]
            while todo:
                v = todo.pop()
                if v not in split:
                    split[v] = u
                    todo += [x for x in arrows[v] if best[x] == best[v]]
        if quality(split) <= before + step:
            break
        member = {u: split[c] for u, c in member.items()}
        merged = {}
        for u, to in arrows.items():
            for v, w in to.items():
                row = merged.setdefault(split[u], {})
                row[split[v]] = row.get(split[v], 0) + w
        arrows = merged
    names = {}
    for u, c in member.items():
        names[c] = min(names.get(c, u), u)
    return {u: names[c] for u, c in member.items()}


def test_random_graphs_equal_the_plain_rule(spark):
    rng = random.Random(8)
    edges = []
    for part in range(4):  # four graphs of different density, side by side
        nodes = [part * 100 + i for i in range(25)]
        pairs = {tuple(sorted(rng.sample(nodes, 2))) for _ in range(30 + 25 * part)}
        edges += [(a, b, rng.randint(1, 3)) for a, b in sorted(pairs)]
    edges.append((5, 5, 9))
    pairs = spark.createDataFrame(edges, "a long, b long, freq long")
    found = {r["user_id"]: r["community"] for r in communities(pairs).collect()}
    assert found == plain_louvain(edges)


def test_groups_of_the_whole_call_graph_equal_the_plain_rule(spark):
    inputs = DerivedInputs(spark, "/root/testdata/sf0.01")
    pairs = undirected_pairs(inputs.cdr)
    edges = [tuple(r) for r in pairs.select("a", "b", "freq").collect()]
    found = {r["user_id"]: r["community"] for r in communities(pairs).collect()}
    assert found == plain_louvain(edges)
    assert modularity([e for e in edges if e[0] != e[1]], found) > 0.3
    for group in set(found.values()):  # every group is connected
        own = {u for u, c in found.items() if c == group}
        seen, todo = set(), [group]
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                todo += [b for a, b, _ in edges if a == u and b in own] + [a for a, b, _ in edges if b == u and a in own]
        assert seen == own
