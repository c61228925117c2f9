import numpy as np
import pyarrow as pa
import pytest

from starling.operators import cells, kmeans

from tests.conftest import frame_of


def blobs(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dims)) + rng.integers(-2, 3, size=(n, dims))


def tallied(x, starts):
    batches = list(cells._packs(x))
    tally = cells.Tally(np.vstack(starts), np.cumsum([len(s) for s in starts]))
    compared, rows = [0], tally._rows
    tally._rows = lambda node, centre: compared.__setitem__(0, compared[0] + cells.FAN * node.size) or rows(node, centre)
    for batch in batches:
        tally.add(batch)
    return tally.table, compared[0]


def brute(x, start):
    near = ((x[:, None] - start[None]) ** 2).sum(-1)
    sums = np.array([x[near.argmin(1) == c].sum(0) for c in range(len(start))])
    return sums, np.bincount(near.argmin(1), minlength=len(start)), near.min(1).sum()


@pytest.mark.parametrize("n, dims", [(1, 1), (17, 2), (4096, 3), (9001, 2), (12_000, 4)])
def test_packs_give_the_sums_of_all_rows(n, dims):
    x = blobs(n, dims)
    rng = np.random.default_rng(1)
    starts = [rng.normal(size=(k, dims)) for k in (1, 2, 3, 9, 40)]
    table, _ = tallied(x, starts)
    for start, part in zip(starts, np.split(table, np.cumsum([len(s) for s in starts])[:-1], axis=1)):
        sums, counts, cost = brute(x, start)
        assert part[dims].tolist() == counts.tolist()
        assert np.abs(part[:dims].T - sums).max() < 1e-8 and part[-1].sum() == pytest.approx(cost)


def test_packs_hold_every_row_once():
    x = blobs(9001, 2)
    batch = pa.Table.from_batches(list(cells._packs(x))).to_pylist()
    rows = [np.frombuffer(b["values"]).reshape(2, -1).T[: b["rows"]] for b in batch]
    assert sorted(map(tuple, np.vstack(rows))) == sorted(map(tuple, x))


def test_ties_and_copies_go_to_the_lowest_centre():
    x = np.repeat([[0.0, 0.0], [3.0, 0.0], [-3.0, 0.0]], [5000, 40, 7], axis=0)
    table, _ = tallied(x, [np.array([[-1.0, 0.0], [1.0, 0.0]]), np.array([[0.0, 2.0], [2.0, 0.0], [-2.0, 0.0], [0.0, 2.0]])])
    assert table[2].tolist() == [5007, 40, 5000, 40, 7, 0]


def test_rows_compared_grow_slower_than_rows():
    rng = np.random.default_rng(2)
    starts = [rng.normal(size=(k, 3)) * 2 for k in (4, 8)]
    few, many = (tallied(blobs(n, 3), starts)[1] / n for n in (8192, 131_072))
    assert many < 0.6 * few


def test_fits_over_packs_equal_fits_over_rows(spark, monkeypatch):
    x = np.vstack([blobs(3000, 3), np.repeat([[9.0, 9.0, 9.0]], 6000, axis=0)])
    ff = frame_of(spark, x).persist()
    plain = kmeans.fit_each_k(ff, [2, 3, 6], n_init=3)
    passes, seen = kmeans._shared_pass, []
    monkeypatch.setattr(kmeans, "_shared_pass", lambda *a: seen.append(a[-1]) or passes(*a))
    for name, value in (("PACKED_ROWS", 1000), ("PACKED_CENTERS", 10)):
        monkeypatch.setattr(kmeans, name, value)
    fits = kmeans.fit_each_k(ff, [2, 3, 6], n_init=3)
    assert cells.Tally in seen
    for k, (cost, points, rounds) in plain.items():
        assert fits[k][0] == pytest.approx(cost) and fits[k][2] == rounds
        assert np.array(fits[k][1]) == pytest.approx(np.array(points))
