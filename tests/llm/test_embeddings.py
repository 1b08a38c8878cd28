import numpy as np
import pytest

from reviewloom.llm.components import components
from reviewloom.llm.embedding_join import BLOCK, BLOCK_BYTES, _blocks, block_pairs, block_size, near_vectors


def brute(vectors, cosine):
    n = len(vectors)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = vectors[i], vectors[j]
            if i != j and a is not None and b is not None and len(a) == len(b):
                if np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= cosine:
                    links[i].append(j)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            least = min([label[i], *(label[j] for j in links[i])])
            changed |= least < label[i]
            label[i] = least
    return [(len(links[i]), label[i]) for i in range(n)]


@pytest.mark.parametrize("dims,block", [(3, 8), (5, 32)])
def test_equals_brute_force(spark, dims, block):
    draw = np.random.default_rng(dims)
    base = draw.normal(size=(120, dims))
    vectors = [*base, *(base[:60] + 0.1 * draw.normal(size=(60, dims))), *(base[:5] * 3.0), *([base[0]] * 20), *draw.normal(size=(9, 2))]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [0.0] * dims, 1), (902, [float("nan")] * dims, 1), (903, [None] * dims, 1), (904, [float("inf")] * dims, 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n int")
    found = {r.vec_id: r for r in near_vectors(df, cosine=0.95, directions=3, block=block).collect()}
    assert len(found) == len(rows) + len(odd)
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in (900, 901, 902, 903, 904))
    assert [(found[i].n_links, found[i].component_id) for i in range(len(rows))] == brute([np.array(v) for v in vectors], 0.95)
    assert near_vectors(df.filter("false")).count() == 0 and near_vectors(df.filter("vec_id = 900")).count() == 1


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(1, 41)} == {0} and {found[100 + i] for i in range(1, 30)} == {100} and found[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def smallest_reachable(links):
    """Union-find: the smallest id of its component for each id that is not it."""
    head = {i: i for link in links for i in link}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {i: find(i) for i in head if find(i) != i}


def test_components_of_chains_and_random_graphs(spark):
    rng = np.random.default_rng(0)
    graphs = [[(1, 3), (3, 4), (4, 5), (5, 2)]]  # one link to each of two heads after the first round
    for n in (6, 6, 7, 8):
        order = rng.permutation(n).tolist()
        graphs.append(list(zip(order, order[1:])))
    for n, m in ((6, 7), (20, 24)):
        graphs.append([tuple(map(int, rng.choice(n, 2, replace=False))) for _ in range(m)])
    for links in graphs:
        found = components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(found) == len({r.id for r in found})
        assert {r.id: r.component for r in found} == smallest_reachable(links), links


def test_blocks_grow_with_the_table_up_to_a_number_of_bytes():
    assert block_size(10_000, 256, BLOCK, 8) == BLOCK
    assert block_size(400_000, 256, BLOCK, 8) == 25_000
    assert block_size(100_000_000, 256, BLOCK, 8) == BLOCK_BYTES // 256
    assert block_size(10_000, 1 << 24, BLOCK, 8) == 1


def test_boxes_of_blocks_hold_their_vectors_and_far_blocks_do_not_meet(spark):
    draw = np.random.default_rng(9)
    points = [[1.0, float(x), 0.0] for x in draw.uniform(-0.1, 0.1, 40)] + [[0.0, float(x), 1.0] for x in draw.uniform(-0.1, 0.1, 40)]
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(points)], "id long, n long, vector array<float>")
    axes, radius = np.eye(3), 0.3
    blocks = _blocks(df, 3, axes, radius, 10)
    assert blocks.rdd.getNumPartitions() == 8 and blocks.count() <= 8
    ids = []
    for row in blocks.collect():
        x = np.frombuffer(row.data, dtype=np.float32).reshape(-1, 3).astype(float)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert np.allclose(unit.min(axis=0), [row.l0, row.l1, row.l2]) and np.allclose(unit.max(axis=0), [row.h0, row.h1, row.h2])
        ids += np.frombuffer(row.ids, dtype=np.int64).tolist()
    assert sorted(ids) == list(range(80))
    pairs = block_pairs(blocks, 3, radius)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan  # no vector is shuffled for the pairs it is in
    side = {r.block: np.frombuffer(r.ids, dtype=np.int64)[0] < 40 for r in blocks.collect()}
    met = [(r.i_block, r.j_block) for r in pairs.select("i_block", "j_block").collect()]
    assert {(b, b) for b in side} <= set(met) and len(met) == len(set(met)) < len(side) * (len(side) + 1) // 2


def test_signs_of_zero_and_kinds_of_numbers(spark):
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [-0.0, 1.0]), (4, [1.0, 0.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        found = sorted(tuple(r) for r in near_vectors(df).collect())
        assert found == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]
    whole = spark.createDataFrame([(1, [3, 4]), (2, [6, 8])], "vec_id long, embedding array<int>")
    assert sorted(tuple(r) for r in near_vectors(whole).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
