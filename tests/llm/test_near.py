"""N-gram join, embedding groups, nearest neighbours, components."""

import numpy as np
import pytest
from helpers import FOLDER, cosine, documents, jaccard_groups, neighbours, reach, read, usable, vector_groups

from logweir.llm import hnsw, lsh_forest, rp_forest
from logweir.llm.catalog import QUERIES
from logweir.llm.components import components, roots, stars


@pytest.mark.parametrize("shape", ["chain", "random", "star", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    pairs = {
        "chain": [(i, i + 1) for i in rng.permutation(200).tolist()],
        "random": rng.integers(0, 300, (150, 2)).tolist(),
        "star": [(500, i) for i in range(100)] + [(7, 7)],
        "none": [],
    }[shape]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {r.node: r.root for r in components(links, few=-1).collect()}
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    root = reach(501, pairs)
    low = {}
    for n in nodes:
        low.setdefault(root[n], n)
    assert got == {n: low[root[n]] for n in nodes}


def test_local_stars():
    a, b = np.array([5, 9, 2, 30]), np.array([9, 2, 40, 31])
    assert dict(zip(*(x.tolist() for x in stars(a, b)), strict=True)) == {5: 2, 9: 2, 40: 2, 31: 30}
    assert roots(3, np.array([0]), np.array([0])).tolist() == [0, 1, 2]


def _texts():
    """Copies, near copies and their opposites around the similarity, short and odd texts, a shared passage."""
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(0, 5000)
    rows, key = [], iter(range(10_000))
    for size in (3, 6, 30, 120, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            rows += [(next(key), " ".join(base)), (next(key), "\n".join(base))]
            for change in (1, 2, 4, 8, 16):
                other = list(base)
                for i in rng.choice(size, min(change, size), replace=False):
                    other[i] = word()
                rows.append((next(key), "  ".join(other)))
    passage = " ".join(word() for _ in range(60))
    rows += [(next(key), " ".join([passage, *(word() for _ in range(50))])) for _ in range(30)]
    # a large group of near copies
    base = [word() for _ in range(150)]
    for i in range(120):
        rows.append((next(key), " ".join([*base, f"tail{i}", word()])))
    rows += [(next(key), t) for t in (None, "", " \n", "one", "one", "one two three four", "one two three four", "é é é é é é é é")]
    rows += [(None, "null key text here now"), (None, "null key text here now"), (None, "another null key of its own"), (3, rows[3][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("blocks", [{}, {"bucket_block": 16, "family_block": 2_000}])
def test_ngram_join_by_brute_force(spark, blocks):
    rows = _texts()
    df = documents(spark, rows).withColumnRenamed("lang", "class_id").withColumnRenamed("source", "n_links").repartition(5)
    got = lsh_forest.join(df, forest=lsh_forest.Forest(**blocks))
    assert got.columns == ["doc_id", "text_hash", "class_id", "group_id", "n_links"]
    have = sorted((str(r.doc_id), str(r.class_id), str(r.group_id), r.n_links) for r in got.collect())
    want = sorted((str(k), str(c), str(g), n) for (k, _), (c, g, n) in zip(rows, jaccard_groups(rows), strict=True))
    assert have == want


def test_ngram_join_of_nothing(spark):
    assert lsh_forest.join(documents(spark, [])).count() == 0
    assert lsh_forest.keep(documents(spark, [])).count() == 0
    assert [tuple(r) for r in lsh_forest.join(documents(spark, [(1, None)])).select("doc_id", "class_id", "group_id", "n_links").collect()] == [(1, 1, 1, 0)]


def test_one_of_each_group_stays(spark):
    rows = _texts()
    df = documents(spark, rows).repartition(5)
    kept = [(r.doc_id, r.text) for r in lsh_forest.keep(df).collect()]
    sets = {}
    for (k, t), (_, g, _) in zip(rows, jaccard_groups(rows), strict=True):
        blank = not (t or "").split()
        sets.setdefault(("blank", k, t) if blank else (g, t if g is None else None), []).append((k, t))
    assert len(kept) == len(sets)
    for members in sets.values():
        first = min((k for k, _ in members if k is not None), default=None)
        assert sum((first, t) in kept for t in {t for _, t in members}) == 1
    assert lsh_forest.keep(df).columns == df.columns


def test_shortening_until_recall(spark):
    """A target that the longest prefixes can't meet gives shorter ones; links near the threshold are all found then."""
    forest = lsh_forest.Forest(trees=4, depth=8, recall=0.999)
    rows = _texts()
    got = lsh_forest.join(documents(spark, rows), forest=forest)
    assert sorted(r.n_links for r in got.collect()) == sorted(n for _, _, n in jaccard_groups(rows))


def test_op9_over_its_table(spark):
    docs = read("documents")
    rows = list(zip(docs["doc_id"].tolist(), docs["text"], strict=True))
    want = {k: (*g, k == g[1]) for (k, _), g in zip(rows, jaccard_groups(rows), strict=True)}
    got = {r.doc_id: (r.class_id, r.group_id, r.n_links, r.kept) for r in QUERIES["op9_ngram_join"].job(spark, FOLDER).collect()}
    assert got == want


VECTORS = "vec_id long, embedding array<double>, label int"


def _vectors(n=400, dim=16):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        if i % 4 and rows and rows[-1][1] is not None:
            v = np.array(rows[-1][1]) + rng.standard_normal(dim) * rng.choice([0.05, 0.1, 0.2])
        else:
            v = rng.standard_normal(dim)
        rows.append((i, v.tolist(), int(rng.integers(0, 3))))
    same = rows[8][1]
    rows += [(n + i, same, rows[8][2]) for i in range(60)]
    rows += [(n + 100 + i, (np.array(same) + rng.standard_normal(dim) * 0.02).tolist(), rows[8][2]) for i in range(60)]
    odd = [None, [0.0] * dim, [float("nan")] * dim, [1.0, None] * (dim // 2), [float("inf")] * dim, [], [1e300] * dim, [1e-300] * dim, [-0.0, 1.0], [0.0, 1.0], (np.array(same) * 3).tolist()]
    rows += [(n + 300 + i, v, rows[8][2]) for i, v in enumerate(odd)]
    rows += [(n + 350, same, None), (None, same, rows[8][2]), (None, [5.0, 1.0, 2.0], 1), (0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2])]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "query_rows": 25}])
def test_embedding_groups_by_brute_force(spark, sizes):
    rows = _vectors()
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as n_links", "2 as node", "3 as component_id").repartition(4)
    got = hnsw.groups(df, plan=hnsw.Plan(**sizes)).collect()
    have = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got)
    want = sorted((str(k), n, str(g), k == g) for (k, _, _), (n, g) in zip(rows, vector_groups(rows), strict=True))
    assert have == want


def test_embedding_groups_of_nothing(spark):
    assert hnsw.groups(spark.createDataFrame([], VECTORS)).count() == 0
    assert [tuple(r) for r in hnsw.groups(spark.createDataFrame([(1, None, 1)], VECTORS)).collect()] == [(1, 0, 1, True)]


def test_graph_walks_find_what_is_near():
    rng = np.random.default_rng(2)
    points = np.repeat(rng.standard_normal((100, 24)), 20, axis=0) + rng.standard_normal((2000, 24)) * 0.15
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)[rng.permutation(2000)]
    plan = hnsw.Plan()
    graph = hnsw.build(points, plan)
    assert len(graph.counts) > 1 and (graph.layers[0] >= 0).sum(axis=1).min() > 0
    width = hnsw.audited(graph, points, plan, 0.93)
    found = {(int(a), int(b)) for q, t in hnsw.near_nodes(graph, points, 0.93, width) for a, b in zip(q, t, strict=True)}
    true = {(int(a), int(b)) for a, b in np.argwhere(points @ points.T >= 0.93)}
    assert len(found & true) >= 0.999 * len(true)


def test_isolated_links_across_shards_of_production_size():
    """A shard of clusters and a few nodes apart; 1 % of another shard's queries lie at 0.932 to 0.95 from one of those."""
    rng = np.random.default_rng(0)
    n, dim = hnsw.Plan().shard_rows, 64
    unit = lambda m: (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    points = np.repeat(rng.normal(size=(n // 64, dim)), 64, axis=0) + rng.normal(size=(n, dim)) * 0.45
    points[:400] = rng.normal(size=(400, dim))
    points = unit(points)
    apart = rng.choice(400, 20, replace=False)
    queries = unit(points[rng.choice(np.arange(400, n), hnsw.Plan().query_rows)] + rng.normal(size=(hnsw.Plan().query_rows, dim)) / np.sqrt(dim))
    at, near = rng.choice(len(queries), 20, replace=False), rng.uniform(0.932, 0.95, 20)[:, None]
    side = rng.normal(size=(20, dim))
    side -= (side * points[apart]).sum(axis=1, keepdims=True) * points[apart]
    queries[at] = near * points[apart] + np.sqrt(1 - near * near) * side / np.linalg.norm(side, axis=1, keepdims=True)
    points = points[rng.permutation(n)]
    graph = hnsw.build(points, hnsw.Plan())
    width = hnsw.audited(graph, queries, hnsw.Plan(), 0.93 - 1e-5)
    found = {(int(a), int(b)) for q, t in hnsw.near_nodes(graph, queries, 0.93 - 1e-5, width) for a, b in zip(q, t, strict=True)}
    true = {(int(a), int(b)) for a, b in np.argwhere(queries @ points.T >= 0.93)}
    assert len(true) == 20 and true <= found


def test_op1_over_its_table(spark):
    emb = read("embeddings")
    rows = [(int(k), v.tolist(), int(x)) for k, v, x in zip(emb["vec_id"], emb["embedding"], emb["label"], strict=True)]
    want = {r[0]: (n, g, r[0] == g) for r, (n, g) in zip(rows, vector_groups(rows), strict=True)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op1_embedding_dedup"].job(spark, FOLDER).collect()} == want


def test_nearest_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist(), 1) for i in range(300)]
    rows += [(1000 + i, rows[50][1], 1) for i in range(40)]  # ties
    rows += [(2000, None, 1), (2050, [0.0] * 8, 1), (2100, [1.0, None] * 4, 1), (2150, [float("nan")] * 8, 1), (None, rows[3][1], 1)]
    rows += [(3000 + i, rng.standard_normal(3).tolist(), 1) for i in range(120)] + [(2200, [1.0, 2.0], 1)]  # other lengths
    # keys on several rows, with other vectors and the same ones
    rows += [(7, rows[7][1], 1), (50, rng.standard_normal(8).tolist(), 1), (100, rng.standard_normal(3).tolist(), 1), (9, rows[100][1], 1), (50, rows[50][1], 1)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as rank", "2 as score", "3 as tree").repartition(3)
    plan = rp_forest.Plan(leaf_rows=20, block_rows=16, block_queries=3, recall=1.0, few_rows=150)
    found = rp_forest.search(df, 50, plan=plan).collect()
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in found}
    want = neighbours([(k, v) for k, v, _ in rows], 50, 5)
    assert len(found) == len(got) and set(got) == set(want)
    assert {k for k, _ in got} == {*range(0, 300, 50), 1000, 3000, 3050, 3100}
    hits = sum(got[k][0] == want[k][0] for k in want)
    assert hits >= 0.95 * len(want)
    vectors = {}
    for k, v, _ in rows:
        if usable(v):
            vectors.setdefault(k, []).append(v)
    for (own, _), (other, score) in got.items():
        assert score == pytest.approx(max(cosine(x, y) for x in vectors[own] for y in vectors[other] if len(x) == len(y)), abs=1e-12)
    # equal vectors tie: the smaller ids first
    assert [got[50, r][0] for r in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]
    # a length that few vectors have is compared in full
    assert all(got[k] == (want[k][0], pytest.approx(want[k][1], abs=1e-12)) for k in want if k[0] >= 3000)


@pytest.mark.parametrize("n,kind", [(20_000, "noise"), (50_000, "noise"), (20_000, "groups")])
def test_nearest_recall(spark, n, kind):
    """Held against brute force: noise, where neighbours are hardly nearer than others, and groups."""
    rng = np.random.default_rng(n)
    m = rng.standard_normal((n, 32)) if kind == "noise" else rng.standard_normal((400, 32))[rng.integers(0, 400, n)] + 0.2 * rng.standard_normal((n, 32))
    rows = [(i, v) for i, v in enumerate(m.tolist())]
    got = rp_forest.search(spark.createDataFrame([(k, v, 1) for k, v in rows], VECTORS).repartition(8), 100).collect()
    want = neighbours(rows, 100, 5)
    assert {(r.query_id, r.rank) for r in got} == set(want)
    true = {(q, v) for (q, _), (v, _) in want.items()}
    assert len(true & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(true)


def test_nearest_of_few(spark):
    assert rp_forest.search(spark.createDataFrame([], VECTORS)).count() == 0
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.0, 1.0], 1)]
    got = [(r.query_id, r.rank, r.vec_id) for r in rp_forest.search(spark.createDataFrame(few, VECTORS)).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert rp_forest.search(spark.createDataFrame([(0, [1.0], 1)], VECTORS)).count() == 0


def test_op8_recall_over_a_larger_table(spark):
    folder = "/root/testdata/sf0.1"
    emb = read("embeddings", folder)
    want = neighbours([(int(k), v.tolist()) for k, v in zip(emb["vec_id"], emb["embedding"], strict=True)], 50, 5)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in QUERIES["op8_nearest"].job(spark, folder).collect()}
    assert set(got) == set(want)
    true, found = {}, {}
    for (q, _), (v, _) in want.items():
        true.setdefault(q, set()).add(v)
    for (q, _), (v, _) in got.items():
        found.setdefault(q, set()).add(v)
    assert sum(len(true[q] & found[q]) for q in true) >= 0.9 * len(want)
