"""The configuration program: feasible, priced by a bound that no solution passes, and rounded near it."""

import numpy as np
import pytest

from loamline.llm import packing


def histogram(seed, capacity=256):
    rng = np.random.default_rng(seed)
    m = int(rng.choice([1, 5, 40, 80, 150]))
    lengths = np.sort(rng.choice(np.arange(1, capacity + 1), m, replace=False))
    return dict(zip(lengths.tolist(), rng.integers(1, 400, m).tolist()))


@pytest.mark.parametrize("part", range(4))
def test_program_is_solved_and_rounded_near_its_bound(part):
    for seed in range(part, 200, 4):
        need = histogram(seed)
        solution = packing.solve(need, 256)
        covered = dict.fromkeys(need, 0.0)
        for config, x in solution.copies:
            assert x > 0 and sum(l * n for l, n in config.items()) <= 256
            for l, n in config.items():
                covered[l] += n * x
        assert all(covered[l] >= n - 1e-4 for l, n in need.items())
        assert solution.bound * (1 - 1e-9) <= solution.value <= solution.bound * 1.01
        assert solution.bound >= sum(l * n for l, n in need.items()) / 256 - 1e-6
        rows = packing.plan(need, 256)
        sequences = max(first + end - start for _, start, end, first, _ in rows)
        assert solution.bound - 1e-6 <= sequences <= solution.bound * 1.01 + len(need)
        placed = dict.fromkeys(need, 0)
        for l, start, end, _, _ in sorted(rows):
            assert start == placed[l] < end
            placed[l] = end
        assert placed == need


def test_bound_is_that_of_weak_duality():
    # three of 100 fill 300 of 256: two a sequence, and no weights prove more than one for two pieces
    solution = packing.solve({100: 7}, 256)
    assert solution.value == pytest.approx(3.5) and solution.bound == pytest.approx(3.5)
    # halves and a bit more never share
    assert packing.solve({129: 10, 128: 4}, 256).bound == pytest.approx(12)
    assert packing.solve({}, 256).copies == [] and packing.plan({}, 256) == []


def test_knapsack_against_all_multisets():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(1, 13), 4, replace=False))
        weight = rng.random(4)
        best, _ = packing.knapsack(weight, lengths, 24)

        def most(room):
            return max([0.0, *(w + most(room - l) for l, w in zip(lengths.tolist(), weight.tolist()) if l <= room)])

        assert best[24] == pytest.approx(most(24))


def test_configurations_of_a_plan():
    rows, sequences = packing.rounded([], {5: 7, 3: 4, 2: 9}, 10)
    found = packing.configurations(rows)
    assert sum(n for _, n in found) == sequences
    assert {l: sum(c.get(l, 0) * n for c, n in found) for l in (5, 3, 2)} == {5: 7, 3: 4, 2: 9}
