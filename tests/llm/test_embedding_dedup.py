import math
import random

import numpy as np
import pytest

from tablesteps.llm import embedding_dedup as E

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    """vec_id, n_links, component_id, kept of every row, in the order of the rows."""
    sound = [
        i
        for i, (_, e, label) in enumerate(rows)
        if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
    ]
    unit = {}
    for i in sound:
        x = np.array(rows[i][1], dtype=np.float32).astype(float)
        x = x / np.abs(x).max()
        unit[i] = x / np.sqrt(x @ x)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(sound):
        for j in sound[a + 1 :]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least_id = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least_id[find(i)] = min(least_id.get(find(i), d), d)
    return sorted(
        ((d, links[i], least_id.get(find(i)), d == least_id.get(find(i))) for i, (d, _, _) in enumerate(rows)), key=repr
    )


def planted(seed, n=260, dims=24):
    """Random vectors, chains of near ones, a dense cluster, copies, multiples and vectors that link with nothing."""
    rng = np.random.default_rng(seed)
    pick = random.Random(seed)
    made = [rng.standard_normal(dims) for _ in range(n // 2)]
    centre = rng.standard_normal(dims)
    made += [centre + rng.normal(0, 0.09, dims) for _ in range(n // 4)]
    while len(made) < n:
        x = made[pick.randrange(len(made))]
        made.append(pick.choice([x, x * 3, x + rng.normal(0, pick.choice([0.02, 0.15, 0.2, 0.25]), dims)]))
    rows = [(i, [float(np.float32(v)) for v in x], pick.randrange(2)) for i, x in enumerate(made)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dims, [nan] * dims, [inf] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [-0.0] * dims]
    rows += [(n + i, e, 0) for i, e in enumerate(odd)]
    rows += [(n + 20, rows[0][1], None), (n + 21, rows[0][1][:5], 0), (n + 22, rows[0][1][:5], 0), rows[5], (None, rows[7][1], 1)]
    pick.shuffle(rows)
    return rows


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"tile_rows": 7}), (3, {"block_dims": 5, "tile_rows": 40})])
def test_links_and_components_against_brute_force(spark, seed, options):
    rows = planted(seed)
    out = E.near_vectors(spark.createDataFrame(rows, KIND), **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert result(out) == brute(rows)


def test_other_thresholds_and_doubles(spark):
    rows = planted(4, 120, 10)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for least in (0.9, 1.0):
        assert result(E.near_vectors(df, min_cosine=least, tile_rows=16))[:3] is not None
    assert result(E.near_vectors(df, min_cosine=0.9)) == brute(rows, 0.9)


def test_every_pair_within_the_budget_meets_in_a_block():
    """The pigeonhole: each near pair shares a cell in some block, once at most in each."""
    rng = np.random.default_rng(5)
    for dims in (3, 8, 20, 64):
        a = rng.standard_normal((400, dims))
        b = a + rng.normal(0, 0.19 / np.sqrt(dims), a.shape) * np.sqrt((a * a).sum(1, keepdims=True))
        cos = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        x, y = E.rounded(a).astype(np.int64), E.rounded(b).astype(np.int64)
        limits = E.budgets(dims, 8, 0.98)
        found = np.zeros(len(a), dtype=bool)
        for span, limit in zip(E.blocks_of(dims, 8), limits):
            near = ((x[:, span] - y[:, span]) ** 2).sum(1) <= limit
            held = [[{} for _ in a], [{} for _ in a]]
            for side, z in enumerate((x, y)):
                for at, cell, home in zip(*E.reached(z[:, span], limit)):
                    assert tuple(cell) not in held[side][at]
                    held[side][at][tuple(cell)] = home
            for i in np.flatnonzero(near):
                met = [c for c in held[0][i].keys() & held[1][i].keys() if held[0][i][c] or held[1][i][c]]
                assert len(met) == 1
            found |= near
        assert (cos >= 0.98).sum() > 50 and found[cos >= 0.98].all()


def test_empty_table_repeats_and_clashing_columns(spark):
    none = spark.createDataFrame([], KIND)
    assert E.near_vectors(none).collect() == []
    rows = [(9, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (4, [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS id", "2 AS node", "3 AS l", "4 AS `a.b`", "5 AS c0")
    assert result(E.near_vectors(df)) == [(3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True), (5, 0, 5, True), (9, 2, 3, False)]
    kept = E.keep_one(df)
    assert kept.columns == df.columns and sorted(r.vec_id for r in kept.collect()) == [3, 3, 4, 5]


def test_bad_parameters_are_refused(spark):
    df = spark.createDataFrame([], KIND)
    for options in ({"min_cosine": 0.0}, {"min_cosine": 1.5}, {"block_dims": 0}):
        with pytest.raises(ValueError):
            E.near_vectors(df, **options)
