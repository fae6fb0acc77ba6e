"""Local moving on modularity against a sequential brute force."""

import random

from quern.operators import graph


def brute_modularity(links, label, gamma=1.0, count=False):
    w = {}
    for a, b, x in links:
        if a != b:
            w[frozenset((a, b))] = w.get(frozenset((a, b)), 0) + x
    m = len(w) if count else sum(w.values())
    k = {}
    for e, x in w.items():
        for v in e:
            k[v] = k.get(v, 0) + x
    inside = sum(x for e, x in w.items() if len({label[v] for v in e}) == 1)
    totals = {}
    for v in k:
        totals[label[v]] = totals.get(label[v], 0) + k[v]
    return inside / m - gamma * sum((t / (2 * m)) ** 2 for t in totals.values())


def sequential(links, gamma=1.0, count=False):
    """One node after the other moves to the neighbouring community of highest modularity, until none moves."""
    nodes = sorted({v for a, b, _ in links for v in (a, b) if a != b})
    near = {v: {b if a == v else a for a, b, _ in links if v in (a, b) and a != b} for v in nodes}
    label = {v: v for v in nodes}
    moving = True
    while moving:
        moving = False
        for v in nodes:
            here = brute_modularity(links, label, gamma, count)
            options = sorted({label[u] for u in near[v]} - {label[v]})
            scores = [(brute_modularity(links, {**label, v: c}, gamma, count), c) for c in options]
            if scores and max(scores)[0] > here + 1e-9:
                label[v] = max(scores, key=lambda x: x[0])[1]
                moving = True
    return label


def planted(rng, groups, size, inside, across):
    nodes = [(g, i) for g in range(groups) for i in range(size)]
    links = []
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if rng.random() < (inside if a[0] == b[0] else across):
                links.append((f"{a[0]}_{a[1]}", f"{b[0]}_{b[1]}", float(rng.randrange(1, 4))))
    return links


def test_as_good_as_sequential_and_never_falling(spark, gamma=0.8, total="count"):
    links = planted(random.Random(3), 3, 5, 0.8, 0.08)
    links += [links[0], (links[1][1], links[1][0], 2.0), ("0_1", "0_1", 9.0)]
    df = spark.createDataFrame(links, "a string, b string, weight double").withColumn("node", graph.F.lit("x"))
    found, history = graph.louvain(df, gamma, total=total)
    label = {r["node"]: r["community"] for r in found.collect()}
    assert all(a <= b + 1e-12 for a, b in zip(history, history[1:]))
    q = brute_modularity(links, label, gamma, total == "count")
    assert abs(history[-1] - q) < 1e-9 and abs(graph.modularity(df, found, gamma, total) - q) < 1e-9
    assert q >= brute_modularity(links, sequential(links, gamma, total == "count"), gamma, total == "count") - 1e-9
    # a local optimum: no single move is better
    near = {}
    for a, b, _ in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert all(brute_modularity(links, {**label, v: label[u]}, gamma, total == "count") <= q + 1e-9 for v in near for u in near[v])
    assert all(c == min(v for v in label if label[v] == c) for c in label.values())


def test_hub_and_no_links(spark):
    star = spark.createDataFrame([("hub", f"leaf{i}", 1.0) for i in range(12)], "a string, b string, weight double")
    found, history = graph.louvain(star)
    assert found.count() == 13 and abs(graph.modularity(star, found) - brute_modularity([('hub', f'leaf{i}', 1.0) for i in range(12)], {r['node']: r['community'] for r in found.collect()})) < 1e-9 and history == sorted(history)
    empty, none = graph.louvain(star.limit(0))
    assert empty.count() == 0 and none == [] and graph.modularity(star.limit(0), empty) == 0.0
