"""Alignment kernels against brute force."""

import itertools
import random

import numpy as np
import pytest

from tabdrift.config import DiffConfig
from tabdrift.operators import align, moves
from tabdrift.operators.align import Lines
from tabdrift.operators.keyed import match_cluster

CFG = DiffConfig()


def lines(x):
    return Lines(x, [5] * len(x)).classified(CFG)


def test_assign():
    rng = random.Random(1)
    for _ in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 6)
        c = np.array([[rng.randint(0, 9) for _ in range(m)] for _ in range(n)])
        pairs = [(i, j) for i, j in enumerate(align.assign(c)) if j >= 0]
        assert len(pairs) == min(n, m) == len({j for _, j in pairs})
        small = c if n <= m else c.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert sum(c[i, j] for i, j in pairs) == best
    assert align.assign(np.zeros((3, 0))) == [-1] * 3


def test_increasing():
    for p in itertools.permutations(range(6)):
        best = max(n for n in range(7) for c in itertools.combinations(p, n) if list(c) == sorted(c))
        kept = [p[i] for i in align.increasing(list(p))]
        assert len(kept) == best and kept == sorted(kept)


def longest(a, b):
    out = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            out[i][j] = out[i + 1][j + 1] + 1 if a[i] == b[j] else max(out[i + 1][j], out[i][j + 1])
    return out


def test_subsequences():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (np.array([rng.randint(0, 5) for _ in range(rng.randint(0, 15))], np.int64) for _ in range(2))
        want = longest(a.tolist(), b.tolist())
        assert (align.common_lengths(a, b) == np.array(want)).all()
        p = align.edit_script(a, b)
        assert len(p) == want[0][0] and all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))


def test_alignment_is_whole():
    """Every line of both sides is matched, or told as inserted or deleted, exactly once; moves join equal blocks."""
    rng = random.Random(3)
    for _ in range(200):
        kinds = rng.choice([20, 1000])
        x = [rng.randint(0, kinds) for _ in range(rng.randint(0, 400))]
        y = list(x)
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(y))
            if rng.random() < 0.4:
                y[k:k] = [rng.randint(2000, 3000) for _ in range(rng.randint(1, 5))]
            elif rng.random() < 0.5:
                del y[k : k + rng.randint(1, 5)]
            else:
                block = y[k : k + 6]
                del y[k : k + 6]
                t = rng.randint(0, len(y))
                y[t:t] = block
        found = align.align(lines(x), lines(y), CFG)
        assert sorted([i for i, _ in found.matched] + found.deleted) == list(range(len(x)))
        assert sorted([j for _, j in found.matched] + found.inserted) == list(range(len(y)))


def test_gap_strategies():
    s = lambda a, b, **k: align.strategy(lines(a), lines(b), CFG, k.get("deep", True), k.get("moves", False))
    assert [s([], []), s([1], []), s([], [1]), s([1], [1], moves=True)] == ["empty", "delete", "insert", "consume_moves"]
    assert s([1], [1]) == "move_candidate" and s([1], [2]) == "small_edit"
    long, other = list(range(300)), list(range(1000, 1300))
    assert s(long, long) == "recurse" and s(long, other, deep=False) == "small_edit" and s(long, long, deep=False) == "move_candidate"
    assert s(list(range(2000)), list(range(5000, 7000)), deep=False) == "hash"


def test_runs_and_gaps():
    a, b = lines([1, 1, 1, 2, 2]), lines([1, 1, 2, 2, 2, 2])
    found = align.align(a, b, CFG)
    assert found.matched == [(0, 0), (1, 1), (3, 2), (4, 3)] and found.deleted == [2] and found.inserted == [4, 5]
    x = list(range(20))
    assert align.single_gap(lines(x), lines(x[:7] + [99] + x[7:]), CFG).inserted == [7]
    assert align.single_gap(lines(x), lines(x[:7] + [3] + x[7:]), CFG) is None  # not unique to the new side
    assert align.block_gap(lines(x), lines(x[:5] + x[9:]), CFG).deleted == [5, 6, 7, 8]
    assert align.block_gap(lines(x), lines(x[:5] + x[9:12] + [77] + x[13:]), CFG) is None
    assert align.context_anchors(lines([7, 1, 2, 3, 4, 7]), lines([9, 9, 1, 2, 3, 4]), 4) == [(1, 2)]


def grid(rng, n, m):
    return np.array([[rng.randint(1, 10**9) for _ in range(m)] for _ in range(n)], np.int64)


def plan(a, b, cfg=CFG):
    book: dict = {}
    return moves.plan_sheet(moves.sheet_of(a, book, cfg), moves.sheet_of(b, book, cfg), cfg)


def replay(a, b, p):
    """The new matrix from the old one, the plan, and the cells that the plan says are edited."""
    if p.mode == "masked":
        return None
    out = np.zeros_like(b)
    for ra, rb, n in p.rows:
        for ca, cb, m in p.cols:
            out[rb : rb + n, cb : cb + m] = a[ra : ra + n, ca : ca + m]
    return out


def test_plans():
    rng = random.Random(4)
    a = grid(rng, 20, 8)
    moved = np.concatenate([a[:3], a[8:15], a[3:8], a[15:]])
    assert plan(a, moved).before == [("BlockMovedRows", 3, None, 5, None, 10, None)]
    edited = moved.copy()
    edited[11, 2] = 77
    p = plan(a, edited)
    assert p.before == [("BlockMovedRows", 3, None, 5, None, 10, None)] and p.moved == [(3, 10, 5)]
    assert plan(a, a[:, [0, 1, 5, 6, 2, 3, 4, 7]]).before == [("BlockMovedColumns", None, 5, None, 2, None, 2)]
    rect = a.copy()
    rect[10:13, 5:7], rect[2:5, 1:3] = a[2:5, 1:3], 0
    assert plan(a, rect).before == [("BlockMovedRect", 2, 1, 3, 2, 10, 5)]
    two = np.concatenate([a[8:11], a[:8], a[11:14], a[17:], a[14:17]])
    assert [o[0] for o in plan(a, two).after] == ["BlockMovedRows"] * 2
    fixed = DiffConfig(max_move_iterations=0)
    assert not plan(a, moved, fixed).before and {o[0] for o in plan(a, moved, fixed).after} == {"RowAdded", "RowRemoved"}


def test_replay():
    """What a plan doesn't tell as edited is the same on both sides."""
    rng = random.Random(5)
    for _ in range(60):
        a = grid(rng, rng.randint(1, 30), rng.randint(1, 8))
        b = a.copy()
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(b) + 1)
            if rng.random() < 0.5:
                b = np.concatenate([b[:k], grid(rng, 2, b.shape[1]), b[k:]])
            elif len(b) > 3:
                b = np.delete(b, slice(k, k + 2), axis=0)
        p = plan(a, b)
        seen = replay(a, b, p)
        if seen is None:
            continue
        covered = {r + k for _, r, n in p.rows for k in range(n)} | {o[1] for o in p.after if o[0] == "RowAdded"} | {o[5] + k for o in p.after if o[0] == "BlockMovedRows" for k in range(o[3])}
        assert covered >= set(range(len(b)))


def test_clusters():
    rng = random.Random(6)
    for _ in range(100):
        rows = lambda n: [tuple(rng.choice("ab") for _ in range(3)) for _ in range(n)]
        a, b = rows(rng.randint(0, 4)), rows(rng.randint(0, 4))
        cost = lambda i, j: sum(x != y for x, y in zip(a[i], b[j]))
        pairs = match_cluster(a, b)
        assert all(cost(i, j) < 2 for i, j in pairs)
        spent = sum(cost(i, j) for i, j in pairs) + 2 * (max(len(a), len(b)) - len(pairs))
        size = max(len(a), len(b))
        best = min(sum(min(cost(i, j), 2) if i < len(a) and j < len(b) else 2 for i, j in enumerate(p)) for p in itertools.permutations(range(size))) if size else 0
        assert spent == best
    many = [(str(k), "x", "y") for k in range(40)]
    assert match_cluster(many, many[::-1]) == [(k, 39 - k) for k in range(40)]


def test_config():
    assert DiffConfig.of(rare_frequency_threshold=7).rare_threshold == 7
    for bad in ({"dense_row_replace_ratio": 2}, {"max_align_rows": 0}, {"on_limit_exceeded": "x"}, {"nothing": 1}):
        with pytest.raises(ValueError):
            DiffConfig.of(**bad)
    for preset in (DiffConfig.fastest, DiffConfig.balanced, DiffConfig.most_precise):
        preset().validate()
