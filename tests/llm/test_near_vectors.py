import numpy as np

from cuelake.llm import near_vectors as v

SCHEMA = "vec_id long, embedding array<float>, label int, kept boolean, node string"


def brute(rows, least=0.93):
    first = list(range(len(rows)))

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    n = [0] * len(rows)
    use = [v.usable(e) if label is not None else None for _, e, label in rows]
    for i in range(len(rows)):
        for j in range(i):
            if use[i] is None or use[j] is None or rows[i][2] != rows[j][2] or len(use[i]) != len(use[j]):
                continue
            if use[i] @ use[j] / (np.linalg.norm(use[i]) * np.linalg.norm(use[j])) >= least:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                first[max(a, b)] = min(a, b)
    least_id: dict = {}
    for k, (d, *_) in enumerate(rows):
        least_id.setdefault(find(k), []).append(d)
    out = []
    for k, (d, *_) in enumerate(rows):
        ids = [x for x in least_id[find(k)] if x is not None]
        c = min(ids) if ids else None
        out.append((d, n[k], c, d == c))
    return out


def made(rng, count, dim=24):
    rows, k = [], 0
    while len(rows) < count:
        base = rng.normal(size=dim) * np.linspace(3, 0.2, dim)
        for _ in range(rng.integers(1, 9)):
            x = (base + rng.normal(size=dim) * rng.choice([0.0, 0.2, 0.45])).astype(np.float32)
            rows.append((k, x.tolist(), int(rng.integers(0, 2)) if rng.random() < 0.3 else 0))
            k += 1
    return rows


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, True, "x") for r in rows], SCHEMA)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in v.group_vectors(frame, **options).collect()), key=str)


def test_links_equal_brute_force(spark):
    rows = made(np.random.default_rng(1), 400)
    want = sorted(brute(rows), key=str)
    assert sum(w[1] > 0 for w in want) > 100
    assert run(spark, rows) == want
    assert run(spark, rows, tile=32) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [1.0, nan], 0), (5, [inf, 1.0], 0), (6, [1.0, 2.0], None), (7, [1.0, 2.0], 0),
        (7, [1.0, 2.0], 0), (8, [2.0, 4.0], 0), (None, [1.0, 2.0], 0), (None, [5.0, -1.0], 0), (9, [], 0), (10, [1.0, 2.0, 3.0], 0),
        (11, [1e30, 2e30], 0), (12, [1e-30, 2e-30], 0), (13, [-0.0, 1.0], 1), (14, [0.0, 1.0], 1),
    ]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, []) == []


def test_bounded_comparison():
    rng = np.random.default_rng(2)
    for step in (1, 4, 16, 64):
        a, b = rng.normal(size=(50, 20)), rng.normal(size=(40, 20))
        b[:20] = a[:20] + rng.normal(size=(20, 20)) * 0.2
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        assert set(zip(*v.linked_pairs(a, b, 0.9, step))) == set(zip(*np.nonzero(a @ b.T >= 0.9)))
