"""What suffix sorting and merging cost, counted, and that the results stay those of the plain way."""

import numpy as np
import pandas as pd

from kmerloom.llm import suffix_dedup


class Counting:
    """Numpy that counts the values it orders."""

    def __init__(self):
        self.seen = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def argsort(self, values, **options):
        self.seen += len(values)
        return np.argsort(values, **options)


def neighbourhoods(rng, n: int) -> list[bytes]:
    """Strings around shared passages of 45 bytes, every third around one of 120."""

    def some(size):
        return bytes(rng.integers(97, 123, size, dtype=np.uint8))

    out = []
    for _ in range(n):
        middle = [some(45), some(45), some(120)]
        out += [some(int(rng.integers(30, 60))) + middle[i % 3] + some(int(rng.integers(30, 60))) for i in range(9)]
    return out


def brute(strings: list[bytes], order, length: int) -> list[list[int]]:
    seen, out = set(), [[] for _ in strings]
    for i in np.argsort(order):
        for j in range(len(strings[i]) - length + 1):
            window = strings[i][j : j + length]
            if window in seen:
                out[i].append(j)
            seen.add(window)
    return out


def test_only_windows_are_merged(monkeypatch):
    rng = np.random.default_rng(4)
    strings = neighbourhoods(rng, 40)
    order = rng.permutation(len(strings))
    counting = Counting()
    monkeypatch.setattr(suffix_dedup, "np", counting)
    got = suffix_dedup.repeats(strings, order)
    assert [x.tolist() for x in got] == brute(strings, order, suffix_dedup.LENGTH)
    # 15 times the bytes; 30 times when every suffix was sorted in every round and merged as long as its string went on
    assert counting.seen < 20 * sum(map(len, strings))


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(5)
    made = [np.zeros(0), np.full(300, 7), rng.integers(1, 3, 500), np.tile(rng.integers(1, 250, 90), 4), rng.integers(1, 258, 500)]
    for body in made:
        for kind in (np.uint8, np.uint16):
            text = np.append(body, 0).astype(np.uint16 if body.max(initial=0) > 255 else kind)
            listed = text.tolist()
            assert suffix_dedup.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: listed[i:]), len(text)


def test_all_bytes_and_odd_lengths():
    rng = np.random.default_rng(6)
    for top in (2, 253, 256):
        alphabet = np.unique(np.append(rng.integers(0, top, 3), [0, top - 1])).astype(np.uint8)
        strings = [bytes(rng.choice(alphabet, int(n))) for n in rng.integers(1, 60, 40)]
        strings += [b"\x00" * 30, b"\xff" * 30, strings[0], b"\xfd" * 9]
        order = rng.permutation(len(strings))
        for length in (1, 5, 12, 100):
            for shards in (1, 3, 99):
                got = suffix_dedup.repeats(strings, order, length=length, shards=shards)
                assert [x.tolist() for x in got] == brute(strings, order, length)


def test_spans_of_a_batch(monkeypatch):
    """Spans end with their string, and windows of one document in several strings keep their order."""

    class Frame:
        def repartition(self, *_):
            return self

        sortWithinPartitions = select = repartition

        def mapInPandas(self, run, _):
            return run

    monkeypatch.setattr(suffix_dedup, "F", type("F", (), {"col": staticmethod(str)}))
    released = []
    monkeypatch.setattr(suffix_dedup, "release", lambda: released.append(1))
    run = suffix_dedup._by_suffixes(Frame(), 1)
    a, b = bytes(range(65, 65 + 120)), bytes(range(100, 220))
    rows = [(1, 5, 0, 0, a), (1, 5, 0, 300, a + b), (1, 4, 0, 7, a), (2, 1, 0, 50, b + b), (2, 9, 0, 0, b[:99]), (2, 0, 0, 0, b)]
    got = pd.concat(list(run(iter([pd.DataFrame(rows, columns=["anchor", "k", "h", "start", "data"])]))))
    assert sorted(got.itertuples(index=False, name=None)) == [(1, 0, 50, 290), (5, 0, 0, 120), (5, 0, 300, 540)]
    none = pd.DataFrame([(1, 5, 0, 0, a), (1, 6, 0, 0, bytes(range(120)))], columns=["anchor", "k", "h", "start", "data"])
    assert not sum(map(len, run(iter([none]))))
    assert len(released) == 2  # a worker that waits for its next task holds no memory of the last
