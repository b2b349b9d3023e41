import random

import numpy as np
import pytest

from riskloom.operators import containers as C


def made(rng):
    kind = rng.choice(["none", "few", "many", "runs", "all", "half"])
    if kind == "none":
        return set()
    if kind == "few":
        return set(rng.sample(range(C.RANGE), rng.randint(1, 40)))
    if kind == "many":
        return set(rng.sample(range(C.RANGE), 20_000))
    if kind == "all":
        return set(range(C.RANGE))
    if kind == "half":
        return set(range(0, C.RANGE, 2))
    out = set()
    for _ in range(rng.randint(1, 6)):
        a = rng.randrange(C.RANGE)
        out |= set(range(a, min(C.RANGE, a + rng.randint(1, 9000))))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_operations_equal_sets(seed):
    rng = random.Random(seed)
    a, b = made(rng), made(rng)
    x, y = (C.from_bytes(C.to_bytes(C.of_values(np.array(sorted(s), np.int64)))) for s in (a, b))
    for op, want in ((C.and_not, a - b), (C.both, a & b), (C.either, a | b)):
        got = C.values(op(x, y)).tolist()
        assert got == sorted(want)


def test_forms_follow_density():
    kinds = [C.of_values(np.array(v))[0] for v in ([5, 9, 5], list(range(3000)), list(range(0, C.RANGE, 2)))]
    assert kinds == [C.ARRAY, C.RUNS, C.BITS]
    assert [len(C.to_bytes(C.of_values(np.array(v)))) for v in ([5, 9, 5], list(range(3000)), list(range(0, C.RANGE, 2)), [])] == [5, 5, 8193, 1]
