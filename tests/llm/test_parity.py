import numpy as np

from tablescout.llm.near_dedup import parity


def test_marks_never_exceed_the_difference():
    r = np.random.default_rng(5)
    for size, own in ((1, 1), (40, 5), (3000, 400)):
        common = r.integers(0, 2**63, size, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, r.integers(0, 2**63, own, dtype=np.uint64)])) for _ in range(2))
        m = parity([a, b])
        bits = int(np.unpackbits((m[0] ^ m[1]).view(np.uint8)).sum())
        true = len(np.setxor1d(a, b))
        assert bits <= true and (size > 100 or bits >= 0.8 * true)
    assert parity([]).shape[0] == 0
