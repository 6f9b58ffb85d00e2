"""Vector operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaq.llm import lsh_search, vector_dedup
from silvaq.llm.components import components


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16))
    for c in range(12):  # clusters, one of them large, and copies
        k = slice(c * 20, c * 20 + 20) if c else slice(400, 520)
        x[k] = x[c] + rng.normal(size=x[k].shape) * 0.12
    x[600:640] = x[600]
    rows = [(i, v.astype(np.float32).tolist(), None if i % 50 == 7 else i % 3 if i < 400 else 1) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [float("nan")] + [1.0] * 15, 1), (1060, [None] + [1.0] * 15, 1), (1080, [], 1), (None, [1.0] * 16, 1), (1100, [1.0, 2.0], 1), (1120, [2.0, 4.0], 1), rows[40]]
    return rows + odd, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")


def good(rows, size):
    return [(i, np.array(v, float), y) for i, v, y in rows if i is not None and v and len(v) == size and all(c is not None and np.isfinite(c) for c in v) and any(v)]


def brute(rows, every, top):
    """{query: [(score, vec_id)]}, the largest first, ties to the smaller id; of repeated ids the best score counts."""
    out = {}
    for size in (16, 2):
        usable = good(rows, size)
        asked = {}
        for i, v, _ in usable:
            if i % every == 0:
                asked[i] = min(asked.get(i, v.tolist()), v.tolist())
        for i, q in asked.items():
            best = {}
            for j, v, _ in usable:
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float(v @ np.array(q)))
            out[i] = sorted((-x, j) for j, x in best.items())[:top]
    return out


def test_search_recall(vectors):
    rows, df = vectors
    got, report = {}, []
    for r in lsh_search.search(df.withColumn("v", F.lit("clash")).withColumn("rank", F.lit(0)), every=20, top=10, report=report).collect():
        got.setdefault(r.query_id, []).append(r)
    want, found = brute(rows, 20, 10), 0
    assert set(got) == set(want) and {r["dims"] for r in report} == {2, 16}
    for i, best in want.items():
        mine = sorted(got[i], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted(((r.score, r.vec_id) for r in mine), key=lambda x: (-x[0], x[1]))
        assert max(abs(r.score + x) for r, (x, j) in zip(mine, best, strict=True) if r.vec_id == j) < 1e-9 if any(r.vec_id == j for r, (_, j) in zip(mine, best, strict=True)) else True
        found += len({j for _, j in best} & {r.vec_id for r in mine})
    assert found / sum(map(len, want.values())) >= 0.9
    assert lsh_search.search(df.where("false")).count() == 0 and lsh_search.search(df.where("vec_id = 40")).count() == 0


def test_search_in_many_files(spark, monkeypatch):
    """Files of few rows, a large group of copies, ties to the smaller id, long vectors."""
    monkeypatch.setattr(lsh_search, "ROWS", 64)
    monkeypatch.setattr(lsh_search, "QUERIES", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 40)) * rng.uniform(0.5, 1.5, (600, 1))
    x[200:400] = x[200]
    rows = [(int(i), v.astype(np.float32).tolist(), 0) for i, v in zip(rng.permutation(600), x, strict=True)] + [(5000 + 20 * i, rng.normal(size=3000).astype(np.float32).tolist(), 0) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    report = []
    got = {}
    for r in lsh_search.search(df, top=20, report=report).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    usable = {i: np.array(v, float) for i, v, _ in rows}
    found = total = 0
    for i, q in usable.items():
        if i % 20:
            continue
        best = sorted((-round(float(v @ q), 9), j) for j, v in usable.items() if j != i and len(v) == len(q))[:20]
        assert sorted(got[i]) == list(range(1, len(best) + 1))
        mine = [(-round(s, 9), j) for _, (j, s) in sorted(got[i].items())]
        assert mine == sorted(mine)
        found, total = found + len(set(best) & set(mine)), total + len(best)
    assert found / total >= 0.9 and all(r["recall"] >= lsh_search.WANTED for r in report)


def test_dedup(vectors, monkeypatch):
    rows, df = vectors
    links, group = {}, {}
    for size in (16, 2):
        usable = [(i, v / np.linalg.norm(v), y) for i, v, y in good(rows, size) if y is not None]
        for a, (i, v, y) in enumerate(usable):
            near = [j for b, (j, w, z) in enumerate(usable) if b != a and y == z and v @ w >= 0.93]
            links[i] = len(near)
            group.setdefault(i, set()).update(near)
    name = {}
    for i in group:
        todo, seen = [i], {i}
        while todo:
            for j in group[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        name[i] = min(seen)
    report = {}
    clash = df.withColumns({c: F.lit("clash") for c in ("v", "rep", "m", "dims", "shard", "file", "links", "root")})
    got = vector_dedup.dedup(clash, report=report).collect()
    assert len(got) == len(rows) and report["true_links"] == report["found_links"] > 100
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), name.get(r.vec_id, r.vec_id), name.get(r.vec_id, r.vec_id) == r.vec_id)
    monkeypatch.setattr(vector_dedup, "SHARD", 100)
    report = {}
    assert sorted(map(str, vector_dedup.dedup(df).collect())) == sorted(map(str, got))
    assert vector_dedup.dedup(df.where("false"), report=report).count() == 0


def test_shards_meet_once_and_audits_see_links(monkeypatch):
    """Few links in many vectors: the audit sees true ones, no vector's likeness to itself; dense groups; roots by both ways of keeping links."""
    from silvaq.llm.hnsw import Graph

    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x, y = unit(rng.normal(size=(1500, 32))), unit(rng.normal(size=(1200, 32)))
    y[:15] = unit(x[100:115] + rng.normal(size=(15, 32)) * 0.02)
    y[300:700], x[700:900] = (unit(x[5] + rng.normal(size=(n, 32)) * 0.02) for n in (400, 200))
    graph = Graph.from_arrays(Graph(x).arrays())
    for q, same in ((None, True), (y, False)):
        met, audit = vector_dedup.link_shard(graph, x, q, 0.93)
        exact = (x if same else y) @ x.T >= 0.93
        if same:
            np.fill_diagonal(exact, False)
        assert (met == exact).all() and audit["found"] == audit["links"] >= 64
        up = list(range(len(x) if same else len(x) + len(y)))

        def find(a, up=up):
            while up[a] != a:
                a = up[a]
            return a

        for i, j in np.argwhere(exact).tolist():
            a, b = find(i if same else len(x) + i), find(j)
            up[max(a, b)] = min(a, b)
        want = [find(a) for a in range(len(up))]
        assert vector_dedup.roots_of(met, same).tolist() == want
        monkeypatch.setattr(vector_dedup, "SPARSE", 0)
        assert vector_dedup.roots_of(met, same).tolist() == want
        monkeypatch.undo()
    sparse = vector_dedup.link_shard(graph, x, y[:15], 0.93)[1]
    assert sparse["links"] == sparse["found"] == 15
    chain = np.zeros((3000, 3000), bool)
    k = rng.permutation(3000)
    chain[k[1:], k[:-1]] = True
    assert set(vector_dedup.roots_of(chain, True).tolist()) == {0}


def test_arrays_come_back(tmp_path):
    from silvaq.llm.arrays import load_arrays, save_arrays

    given = {"a": np.arange(7, dtype=np.int16), "b": np.zeros((0, 3)), "c": np.random.default_rng(0).normal(size=(5, 4)), "d": np.array([True, False])}
    save_arrays(f"file://{tmp_path}/x", "one", given)
    back = load_arrays(f"file://{tmp_path}/x", "one")
    assert list(back) == list(given) and all(back[k].dtype == v.dtype and back[k].shape == v.shape and (back[k] == v).all() for k, v in given.items())


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    find = lambda a: a if up.setdefault(a, a) == a else find(up[a])
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {a: find(a) for a in up}
