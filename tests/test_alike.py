import random

import pytest

from siftlake.functions.alike import alike_pairs
from siftlake.functions.spans import similarity


@pytest.mark.parametrize("least", [80.0, 92.0])
def test_pairs_are_those_of_similarity(least):
    rnd = random.Random(1)
    base = [" ".join("".join(rnd.choice("bdkmaeio") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(1, 18))) for _ in range(60)] + ["", "a", "é"]

    def typo(s):
        k = rnd.randrange(len(s) + 1)
        return s[:k] + rnd.choice(["", "a", "é", "9 "]) + s[k + rnd.randint(0, 2) :]

    one, two = base + [typo(rnd.choice(base)) for _ in range(300)], [typo(typo(rnd.choice(base))) for _ in range(200)]
    assert sorted(alike_pairs(one, two, least)) == [(i, k) for i, x in enumerate(one) for k, y in enumerate(two) if similarity(x, y) >= least]
    assert sorted(tuple(sorted(p)) for p in alike_pairs(one, None, least)) == [(i, k) for i, x in enumerate(one) for k in range(i + 1, len(one)) if similarity(x, one[k]) >= least]
    assert not list(alike_pairs([], None, least)) and not list(alike_pairs(["a"], [], least))
