"""Alignment against enumeration, and matrices by their definition."""

import numpy as np
import pytest

from kmerloom.operators import alignment, motifs


def ways(m, n):
    """All alignments of m and n columns, as strings of pairs (b), columns of the first (f) and of the second (s) alone."""
    if not m and not n:
        yield ""
    if m and n:
        yield from ("b" + w for w in ways(m - 1, n - 1))
    if m:
        yield from ("f" + w for w in ways(m - 1, n))
    if n:
        yield from ("s" + w for w in ways(m, n - 1))


def cost(way, scores, gap_open, extend):
    m, n = scores.shape
    i = j = 0
    total, last = 0.0, "b"
    for c in way:
        if c == "b":
            total += scores[i, j]
            i, j = i + 1, j + 1
        elif c == "f":
            total -= extend if last == "f" or j in (0, n) else gap_open
            i += 1
        else:
            total -= extend if last == "s" or i in (0, m) else gap_open
            j += 1
        last = c
    return total


def brute(scores, gap_open=alignment.GAP_OPEN, extend=alignment.GAP_EXTEND):
    return max(cost(w, scores, gap_open, extend) for w in ways(*scores.shape))


def way_of(left, right):
    return "".join("s" if a < 0 else "f" if b < 0 else "b" for a, b in zip(left, right, strict=True))


@pytest.mark.parametrize("gap_open,extend", [(100.0, 1.25), (3.0, 1.0), (2.0, 0.25)])
def test_pairs_against_all_alignments(gap_open, extend):
    rng = np.random.default_rng(0)
    for _ in range(25):
        scores = rng.choice([5.0, -4.0, 1.5], (int(rng.integers(0, 5)), int(rng.integers(0, 5))))
        best, left, right = alignment.pair(scores, gap_open, extend)
        assert best == pytest.approx(brute(scores, gap_open, extend))
        assert cost(way_of(left, right), scores, gap_open, extend) == pytest.approx(best)
        assert left[left >= 0].tolist() == list(range(scores.shape[0])) and right[right >= 0].tolist() == list(range(scores.shape[1]))


def test_scores_of_all_pairs():
    rng = np.random.default_rng(1)
    seqs = ["".join(rng.choice(list("ACGT"), rng.integers(1, 12))) for _ in range(25)] + ["N", "ACNGT"]
    got = alignment.pair_scores(seqs)
    for i, a in enumerate(seqs):
        for j, b in enumerate(seqs):
            p, q = alignment.Profile.of(a, 1.0), alignment.Profile.of(b, 1.0)
            assert got[i, j] == pytest.approx(alignment.pair(p.shares @ alignment._SCORES @ q.shares.T)[0])


def test_three_sequences_against_all_alignments():
    rng = np.random.default_rng(2)
    for _ in range(12):
        seqs = sorted({"".join(rng.choice(list("ACGT"), rng.integers(2, 5))) for _ in range(3)})
        if len(seqs) < 3:
            continue
        score = {}
        for i in range(3):
            for j in range(3):
                equal = np.array([[alignment.MATCH if x == y else alignment.MISMATCH for y in seqs[j]] for x in seqs[i]])
                score[i, j] = brute(equal)
        distance = {(i, j): 1 - score[i, j] / min(score[i, i], score[j, j]) for i in range(3) for j in range(i + 1, 3)}
        i, j = min(distance, key=lambda x: (round(distance[x], 9), x))
        k = 3 - i - j
        aligned = alignment.align(seqs)
        # the nearest two alone, less the columns where both have a dash, are an optimal pair
        columns = [(a, b) for a, b in zip(aligned[i], aligned[j], strict=True) if (a, b) != ("-", "-")]
        equal = np.array([[alignment.MATCH if x == y else alignment.MISMATCH for y in seqs[j]] for x in seqs[i]])
        assert cost("".join("s" if a == "-" else "f" if b == "-" else "b" for a, b in columns), equal, 100.0, 1.25) == pytest.approx(score[i, j])
        # and the third is optimal against their columns
        both = np.array([[sum((alignment.MATCH if x == y else alignment.MISMATCH) for x in c if x != "-") / 2 for y in seqs[k]] for c in columns])
        third = [(("s" if (a, b) == ("-", "-") else "f" if c == "-" else "b")) for a, b, c in zip(aligned[i], aligned[j], aligned[k], strict=True)]
        assert cost("".join(third), both, 100.0, 1.25) == pytest.approx(brute(both))
        assert [x.replace("-", "") for x in aligned] == seqs


def test_guide_tree_by_average_distance():
    d = np.array([[0, 1, 4, 9], [1, 0, 6, 9], [4, 6, 0, 2], [9, 9, 2, 0.0]])
    assert alignment.guide_tree(d) == [(0, 1), (2, 3), (4, 5)]
    assert alignment.guide_tree(np.zeros((1, 1))) == []


def test_weights_are_summed_before_they_are_counted(spark):
    rows = [("A" + "C" * 3, 90.0)] * 10 + [("C" + "C" * 3, 0.02)] * 5000
    assert motifs.build_matrix([s for s, _ in rows], [w for _, w in rows])[0] == pytest.approx((0.9, 0.1, 0.0, 0.0))
    got = motifs.from_alignment(spark.createDataFrame(rows, "aligned string, weight double")).orderBy("pos").first()
    assert (got["A"], got["C"]) == pytest.approx((0.9, 0.1))
    light = motifs.build_matrix(["A", "C"], [1.0, 1e-9])
    assert light[0] == pytest.approx((1000 / 1001, 1 / 1001, 0.0, 0.0))  # one at least
    dashes = motifs.build_matrix(["AC", "-C"], [1.0, 1.0])
    assert dashes[0] == pytest.approx((1250 / 2000, 250 / 2000, 250 / 2000, 250 / 2000))


def test_groups_in_one_bin_and_in_many(spark):
    rng = np.random.default_rng(3)
    other = lambda n: "".join(rng.choice(list("ACGT"), n))
    rows = [("a", other(rng.integers(0, 4)) + "TTCAGG" + other(rng.integers(0, 4)), float(rng.integers(1, 9))) for _ in range(60)]
    rows += [("b", "ACGT", 2.0), ("b", "ACGT", 3.0), ("c", "ACGTT", 1.0), ("c", "CGTTA", -2.0), ("d", None, 1.0), ("d", "", 1.0)]
    members = spark.createDataFrame(rows, "motif string, seq string, weight double")
    for size in (1000, 8):
        got = alignment.group_profiles(members, size).toPandas()
        assert set(got["motif"]) == {"a", "b", "c"}
        for name, own in got.groupby("motif"):
            mine = [(s, abs(w)) for m, s, w in rows if m == name]
            assert sorted(own["pos"]) == list(range(len(own)))
            assert np.allclose(own[["A", "C", "G", "T", "gap"]].sum(1), sum(w for _, w in mine))
            for x in "ACGT":  # no letter is lost
                assert own[x].sum() == pytest.approx(sum(w * s.count(x) for s, w in mine))
        a = got[got["motif"] == "a"].sort_values("pos")
        columns = motifs._matrix(a[["A", "C", "G", "T", "gap"]].to_numpy(), motifs.MotifOptions())
        assert "TTCAGG" in motifs.consensus(columns) and sum(max(c) > 0.9 for c in columns) >= 6
        if size == 1000:
            seqs = [s for m, s, _ in rows if m == "a"]
            assert np.allclose(columns, motifs.build_matrix(alignment.align(seqs), [w for m, _, w in rows if m == "a"]))
    assert alignment.group_profiles(members.limit(0)).count() == 0


def test_seed_groups(spark):
    rows = [("ACG", "TACGT", 1.0), ("ACG", "ACGACG", 2.0), ("ACG", "GGACG", 4.0), ("TTT", "TTTA", 1.0), ("TTT", "ATTT", 2.0), ("NA", "CC", 9.0), ("GGG", "GGG", 1.5)]
    got = motifs.seed_profiles(spark.createDataFrame(rows, "motif string, seq string, weight double"))
    by = {}
    for r in got.collect():
        by.setdefault(r["motif"], []).append((r["pos"], *(r[x] for x in (*motifs.LETTERS, "gap"))))
    assert set(by) == {"ACG", "TTT", "GGG"}
    want = [[0, 0, 4, 0, 3], [0, 0, 4, 1, 2], [7, 0, 0, 0, 0], [0, 7, 0, 0, 0], [0, 0, 7, 0, 0], [2, 0, 0, 1, 4], [0, 2, 0, 0, 5], [0, 0, 2, 0, 5]]
    assert [list(r[1:]) for r in sorted(by["ACG"])] == want
    assert len(by["GGG"]) == 3 and len(by["TTT"]) == 5  # two alone: -TTTA with ATTT-


def test_windows_of_long_and_short_tables():
    rng = np.random.default_rng(4)
    for m in (1, 3, 9, 30):
        table = np.log2(rng.dirichlet(np.ones(5), m)).tolist()
        seqs = ["".join(rng.choice(list("ACGTN"), rng.integers(0, 25), p=[0.24] * 4 + [0.04])) for _ in range(40)]
        best, place = motifs.best_windows(seqs, table)
        for s, b, p in zip(seqs, best, place, strict=True):
            padded = "-" * m + s + "-" * m
            scores = [sum(dict(zip("ACGT-", table[j], strict=True)).get(padded[k + j], -np.inf) for j in range(m)) for k in range(len(s) + m)]
            assert b == max(scores) or b == pytest.approx(max(scores), abs=1e-8)
            assert scores[p] == pytest.approx(b, abs=1e-8) or scores[p] == b
