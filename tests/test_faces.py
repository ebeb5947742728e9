"""Clusters of faces and links of media to people, against a plain loop."""

from collections import Counter

import numpy as np

from keepsake.operators import faces

SCHEMA = "id long, media_id string, person_id string, encoding array<double>, cluster int, a int"


def sample(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(7):
        centre = rng.normal(size=128)
        for _ in range(rng.integers(1, 12)):
            said = rng.choice([f"p{p}", None, "p0"], p=[0.4, 0.5, 0.1])
            rows.append((f"m{rng.integers(20)}", said, (centre + rng.normal(size=128) * rng.choice([0.1, 0.25, 0.45])).tolist()))
    rows += [("m1", None, rng.normal(size=128).tolist()) for _ in range(8)]
    rows += [("m2", None, rows[0][2])] * 30 + [(None, "p1", rows[3][2]), ("m3", "alone", None), ("m4", None, [0.0] * 128), ("m5", None, [1.0, 2.0])]
    return [(i, *r, 0, 0) for i, r in enumerate(rows)]


def plain(rows, like, core):
    units = {i: np.array(e) / np.linalg.norm(e) for i, _, _, e, *_ in rows if e is not None and np.any(e)}
    score = {(i, j): float(u @ v) for i, u in units.items() for j, v in units.items() if len(u) == len(v)}
    near = {i: [j for j in units if score.get((i, j), -2) >= like or i == j] for i in units}
    cores = {i for i, own in near.items() if len(own) >= core}
    cluster = {}
    for i in sorted(cores):
        if i not in cluster:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in cluster:
                    cluster[j] = i
                    todo += [k for k in near[j] if k in cores]
    for i in units.keys() - cores:
        own = [(-round(score[i, j], 6), j) for j in near[i] if j in cores]
        cluster[i] = cluster[min(own)[1]] if own else None
    votes = {}
    for i, _, said, *_ in rows:
        if said and cluster.get(i) is not None:
            votes.setdefault(cluster[i], Counter())[said] += 1
    links = {}
    for i, media, said, *_ in rows:
        named = [(said, 1.0)] if said else [(min(v, key=lambda p: (-v[p], p)), max(v.values()) / sum(v.values())) for v in [votes.get(cluster.get(i))] if v]
        for p, sure in named:
            if media:
                links[media, p] = max(links.get((media, p), 0), sure)
    return {i: cluster[i] for i in units}, links


def test_clusters_and_links_are_those_of_a_plain_loop(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    for like, core in ((0.9, 3), (0.8, 2), (0.97, 5)):
        cluster, links = plain(rows, like, core)
        assert {r.id: r.cluster for r in faces.clusters(df, like=like, core=core).collect()} == cluster
        got = {(r.media, r.person): r.confidence for r in faces.by_faces(df, like=like, core=core).collect()}
        assert got.keys() == links.keys() and all(abs(got[k] - links[k]) < 1e-12 for k in links)
    assert len({c for c in plain(rows, 0.9, 3)[0].values() if c is not None}) >= 3


def test_without_faces(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert faces.clusters(df).collect() == [] and faces.by_faces(df).collect() == []
