"""Alignment kernels: which lines (rows or columns) of two versions of a sheet belong together, and which blocks moved.

Plain numpy over one small record per line, never over a sheet's cells; only the rectangle search looks at cells, and
sheets that it sees are bounded by DiffConfig.max_move_detection_rows and _cols. Signatures are any integers that are
equal where lines are equal; positions are 0, 1, 2, ... within a side."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np

from ..config import DiffConfig

UNIQUE, RARE, COMMON, LOW = range(4)


@dataclass
class Lines:
    """Lines of one side in order: signature, cells that aren't empty, class of frequency."""

    sig: np.ndarray
    filled: np.ndarray
    kind: np.ndarray = field(default=None)

    def __post_init__(self):
        self.sig, self.filled = np.asarray(self.sig, np.int64), np.asarray(self.filled, np.int64)

    def __len__(self) -> int:
        return len(self.sig)

    def classified(self, cfg: DiffConfig, low: np.ndarray | None = None) -> Lines:
        """With the class of each line: once, at most rare_threshold times, more often; too empty to tell apart."""
        _, inverse, count = np.unique(self.sig, return_inverse=True, return_counts=True)
        n = count[inverse] if len(self) else np.zeros(0, np.int64)
        kind = np.where(n == 1, UNIQUE, np.where(n <= cfg.rare_threshold, RARE, COMMON))
        bare = self.filled < cfg.low_info_threshold
        if low is not None:
            bare |= np.asarray(low, bool)
        self.kind = np.where(bare, LOW, kind)
        return self

    def part(self, at) -> Lines:
        return Lines(self.sig[at], self.filled[at], None if self.kind is None else self.kind[at])

    @property
    def low(self) -> np.ndarray:
        return self.kind == LOW


@dataclass
class Alignment:
    matched: list[tuple[int, int]] = field(default_factory=list)
    inserted: list[int] = field(default_factory=list)
    deleted: list[int] = field(default_factory=list)
    moves: list[tuple[int, int, int]] = field(default_factory=list)  # source, target, count

    def add(self, other: Alignment) -> None:
        self.matched += other.matched
        self.inserted += other.inserted
        self.deleted += other.deleted
        self.moves += other.moves

    def ordered(self) -> Alignment:
        for part in (self.matched, self.inserted, self.deleted, self.moves):
            part.sort()
        return self


# ---- chains, edit scripts, assignment


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[pile], last[pile] = v, i
        before[i] = last[pile - 1] if pile else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def chain(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Anchors, in the order of the new side, that keep their order on the old one."""
    by_new = sorted(anchors, key=lambda p: p[1])
    return [by_new[i] for i in increasing([a for a, _ in by_new])]


def common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L[i, j]: length of the longest common subsequence of a[i:] and b[j:]; a row at a time, each by one running maximum."""
    out = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        below = out[i + 1]
        best = np.maximum(below[:-1], np.where(b == a[i], below[1:] + 1, 0))
        out[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    return out


def edit_script(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Matched pairs of a shortest edit script, by furthest reaching paths: O((n + m) d) for d edits."""
    n, m = len(a), len(b)
    reach = {1: 0}
    rounds: list[dict[int, int]] = []
    for d in range(n + m + 1):
        rounds.append(dict(reach))
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach[k - 1] < reach[k + 1])
            x = reach[k + 1] if down else reach[k - 1] + 1
            limit = min(n - x, m - (x - k))
            if limit > 0:
                equal = a[x : x + limit] == b[x - k : x - k + limit]
                x += limit if equal.all() else int(equal.argmin())
            reach[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        break
    pairs: list[tuple[int, int]] = []
    x, y = n, m
    for d in range(len(rounds) - 1, -1, -1):
        seen, k = rounds[d], x - y
        down = k == -d or (k != d and seen.get(k - 1, -1) < seen.get(k + 1, -1))
        start = seen[k + 1] if down else seen[k - 1] + 1
        stop = start if d else 0
        while x > stop and y > stop - k:
            x, y = x - 1, y - 1
            pairs.append((x, y))
        if d:
            x, y = (start, start - k - 1) if down else (start - 1, start - k)
    return pairs[::-1]


def assign(cost) -> list[int]:
    """Row to column of least total cost, -1 for rows left over; shortest augmenting paths over a reduced matrix.

    Rectangular matrices are taken as they are. Among columns at equal distance the lowest is taken first."""
    cost = np.asarray(cost, np.float64)
    if not cost.size:
        return [-1] * len(cost)
    if cost.shape[0] > cost.shape[1]:
        out = [-1] * cost.shape[0]
        for column, row in enumerate(assign(cost.T)):
            out[row] = column
        return out
    rows, columns = cost.shape
    reduced = cost - cost.min(axis=1, keepdims=True)
    price = np.zeros(columns)
    holder = np.full(columns, -1)
    for row in range(rows):
        distance = reduced[row] - price
        origin = np.full(columns, row)
        settled = np.zeros(columns, bool)
        while True:
            column = int(np.where(settled, np.inf, distance).argmin())
            settled[column] = True
            owner = int(holder[column])
            if owner < 0:
                break
            # through the column's owner: its own reduced cost stands for the way back
            through = distance[column] + (reduced[owner] - price) - (reduced[owner, column] - price[column])
            shorter = ~settled & (through < distance - 1e-12)
            distance[shorter] = through[shorter]
            origin[shorter] = owner
        price[settled] += distance[settled] - distance[column]
        previous = {int(r): int(c) for c, r in enumerate(holder) if r >= 0}
        while True:
            giver = int(origin[column])
            holder[column] = giver
            if giver == row:
                break
            column = previous[giver]
    out = [-1] * rows
    for column, r in enumerate(holder.tolist()):
        if r >= 0:
            out[r] = column
    return out


# ---- anchors


def _once(lines: Lines, usable: np.ndarray) -> dict[int, int]:
    sig = lines.sig[usable]
    values, first, count = np.unique(sig, return_index=True, return_counts=True)
    at = np.flatnonzero(usable)[first]
    return dict(zip(values[count == 1].tolist(), at[count == 1].tolist()))


def _meet(old: dict[int, int], new: dict[int, int]) -> list[tuple[int, int]]:
    return sorted(((old[s], j) for s, j in new.items() if s in old), key=lambda p: p[1])


def anchors(a: Lines, b: Lines) -> list[tuple[int, int]]:
    """Lines whose signature is unique in the whole of either side (a part keeps the classes of the whole)."""
    pick = lambda x: {s: i for i, s in enumerate(x.sig.tolist()) if x.kind[i] == UNIQUE}
    return _meet(pick(a), pick(b))


def local_anchors(a: Lines, b: Lines) -> list[tuple[int, int]]:
    """Lines whose signature either part has once, bare lines left out."""
    return _meet(_once(a, ~a.low), _once(b, ~b.low))


def context_anchors(a: Lines, b: Lines, k: int) -> list[tuple[int, int]]:
    """First lines of windows of k lines that either part has once, windows with bare lines left out."""
    if k < 1 or min(len(a), len(b)) < k:
        return []
    windows = lambda x: np.lib.stride_tricks.sliding_window_view(x, k)
    both = np.concatenate([windows(a.sig), windows(b.sig)])
    _, number = np.unique(both, axis=0, return_inverse=True)
    number = number.reshape(-1)
    cut = len(a) - k + 1
    usable = lambda x: ~windows(x.low).any(axis=1)
    once = lambda part, x: _once(Lines(part, part), usable(x))
    return _meet(once(number[:cut], a), once(number[cut:], b))


# ---- blocks that moved


def shifted_runs(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs of at least two pairs, consecutive on both sides, whose offset isn't zero."""
    if not pairs:
        return []
    p = np.array(sorted(pairs), np.int64)
    start = np.flatnonzero(np.concatenate([[True], (np.diff(p, axis=0) != 1).any(axis=1)]))
    size = np.diff(np.append(start, len(p)))
    return [(int(p[s, 0]), int(p[s, 1]), int(n)) for s, n in zip(start, size) if n > 1 and p[s, 0] != p[s, 1]]


def block_likeness(a: Lines, b: Lines, src: int, dst: int, n: int) -> float:
    if n == 0 or src + n > len(a) or dst + n > len(b):
        return 0.0
    x, y = a.part(slice(src, src + n)), b.part(slice(dst, dst + n))
    return (int(((x.sig == y.sig) & ~x.low & ~y.low).sum()) + 1) / (n + 1)


def block_move(a: Lines, b: Lines, cfg: DiffConfig) -> tuple[int, int, int] | None:
    """The longest block that both sides have, of min_block_size_for_move lines at least."""
    if max(len(a), len(b)) > cfg.move_extraction_max_slice_len:
        return None
    places = defaultdict(list)
    for i in np.flatnonzero(~a.low).tolist():
        places[int(a.sig[i])].append(i)
    best, most = None, 0
    for j in np.flatnonzero(~b.low).tolist():
        for i in places.get(int(b.sig[j]), ())[: cfg.move_extraction_max_candidates_per_sig]:
            room = min(len(a) - i, len(b) - j)
            if room <= most:
                continue
            same = a.sig[i : i + room] == b.sig[j : j + room]
            n = room if same.all() else int(same.argmin())
            if n > most and n >= cfg.min_block_size_for_move:
                best, most = (i, j, n), n
    return best


def global_moves(a: Lines, b: Lines, kept: list[tuple[int, int]], cfg: DiffConfig) -> list[tuple[int, int, int]]:
    """Blocks outside the anchor chain: equal lines that are unique or rare, runs of one offset, scored and assigned.

    Pairs beyond the limit are the last ones in the order of (old, new)."""
    limit = cfg.move_extraction_max_candidates_per_sig

    def free(x: Lines, side: int) -> dict[int, list[int]]:
        taken = np.zeros(len(x), bool)
        taken[[p[side] for p in kept]] = True
        out = defaultdict(list)
        for i in np.flatnonzero(~taken & (x.kind <= RARE)).tolist():
            if len(out[int(x.sig[i])]) < limit:
                out[int(x.sig[i])].append(i)
        return out

    new = free(b, 1)
    pairs = sorted((i, j) for s, rows in free(a, 0).items() for i in rows for j in new.get(s, ()))[: cfg.move_extraction_max_slice_len]
    if not pairs:
        return []
    p = np.array(pairs, np.int64)
    offset, step = p[:, 1] - p[:, 0], np.diff(p[:, 0])
    breaks = (np.diff(offset) != 0) | (step <= 0) | (step > max(cfg.small_gap_threshold, 1))
    first = np.flatnonzero(np.concatenate([[True], breaks]))
    last = np.append(first[1:], len(p)) - 1
    need = cfg.fuzzy_similarity_threshold if cfg.enable_fuzzy_moves else 1.0
    scored: dict[tuple[int, int, int], float] = {}
    for s, e in zip(first, last):
        block = (int(p[s, 0]), int(p[s, 1]), int(p[e, 0] - p[s, 0] + 1))
        if max(cfg.min_block_size_for_move, 1) <= block[2] <= max(cfg.move_extraction_max_slice_len, 1):
            like = block_likeness(a, b, *block)
            if like >= need:
                scored[block] = like
    if not scored:
        return []
    ranked = sorted(scored, key=lambda m: (-scored[m], m[0], m[1], -m[2]))
    sources = list(dict.fromkeys((m[0], m[2]) for m in ranked))
    targets = list(dict.fromkeys((m[1], m[2]) for m in ranked))
    size = max(len(sources), len(targets))
    cost = np.full((size, size), 1000.0)
    at = {}
    for m in ranked:
        i, j = sources.index((m[0], m[2])), targets.index((m[1], m[2]))
        cost[i, j] = round((1 - scored[m]) * 1000)
        at[i, j] = m
    chosen = [at[i, j] for i, j in enumerate(assign(cost)) if (i, j) in at]
    out: list[tuple[int, int, int]] = []
    apart = lambda x, y, n, k: x + n <= y or y + k <= x
    for m in sorted(chosen, key=lambda m: (-scored[m], -m[2], m[0], m[1])):
        if all(apart(m[0], o[0], m[2], o[2]) and apart(m[1], o[1], m[2], o[2]) for o in out):
            out.append(m)
    return sorted(out)


# ---- gaps between anchors


def _pair_up(a: Lines, b: Lines, pairs: list[tuple[int, int]]) -> Alignment:
    """Matched pairs and what they leave over; equally long parts without any match are paired by position."""
    if not pairs and len(a) == len(b):
        return Alignment([(i, i) for i in range(len(a))])
    left, right = {i for i, _ in pairs}, {j for _, j in pairs}
    return Alignment(pairs, [j for j in range(len(b)) if j not in right], [i for i in range(len(a)) if i not in left])


def by_subsequence(a: Lines, b: Lines, cfg: DiffConfig) -> Alignment:
    """Small gaps: a longest common subsequence, deletions first where both ways are equally long."""
    if len(a) * len(b) > cfg.lcs_dp_work_limit:
        return _pair_up(a, b, edit_script(a.sig, b.sig))
    best = common_lengths(a.sig, b.sig)
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a.sig[i] == b.sig[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return _pair_up(a, b, pairs)


def by_occurrence(a: Lines, b: Lines) -> Alignment:
    """Large gaps: the k-th occurrence of a signature with its k-th one on the other side, those that keep their order."""
    waiting = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        waiting[int(b.sig[j])].append(j)
    pairs = [(i, waiting[s].pop()) for i, s in enumerate(a.sig.tolist()) if waiting.get(s)]
    if not pairs:
        return _pair_up(a, b, [])
    keep = [pairs[k] for k in increasing([j for _, j in pairs])]
    return _pair_up(a, b, keep)


def _default(a: Lines, b: Lines, cfg: DiffConfig) -> Alignment:
    return by_occurrence(a, b) if max(len(a), len(b)) > cfg.max_lcs_gap_size else by_subsequence(a, b, cfg)


def strategy(a: Lines, b: Lines, cfg: DiffConfig, may_recurse: bool, has_moves: bool) -> str:
    """How a gap is filled."""
    n, m = len(a), len(b)
    if not n or not m:
        return "empty" if not n and not m else "delete" if n else "insert"
    if has_moves:
        return "consume_moves"
    shared = bool(np.isin(b.sig, a.sig).any())
    if max(n, m) <= min(cfg.small_gap_threshold, cfg.max_lcs_gap_size):
        return "move_candidate" if shared else "small_edit"
    if max(n, m) > cfg.recursive_align_threshold and may_recurse:
        return "recurse"
    if shared:
        return "move_candidate"
    return "hash" if max(n, m) > cfg.max_lcs_gap_size else "small_edit"


def fill(a: Lines, b: Lines, cfg: DiffConfig, depth: int, moves: list[tuple[int, int, int]]) -> Alignment:
    """A gap's alignment in positions of the gap; moves are those that lie wholly inside it."""
    how = strategy(a, b, cfg, depth < cfg.max_recursion_depth, bool(moves))
    if how in ("empty", "insert", "delete"):
        return Alignment([], list(range(len(b))), list(range(len(a))))
    if how == "consume_moves":
        return _around_moves(a, b, cfg, depth, moves)
    if how == "recurse":
        found = _again(a, b, cfg, depth)
        return assemble(a, b, found, cfg, depth + 1, moves) if found else _default(a, b, cfg)
    if how == "hash":
        out = by_occurrence(a, b)
        out.moves = shifted_runs(out.matched)
        return out
    out = _default(a, b, cfg)
    if how == "move_candidate":
        out.moves = shifted_runs(out.matched)
        if not out.moves and any(i != j for i, j in out.matched):
            block = block_move(a, b, cfg)
            out.moves = [block] if block else []
    return out


def _again(a: Lines, b: Lines, cfg: DiffConfig, depth: int) -> list[tuple[int, int]]:
    if depth == 0:
        return chain(anchors(a, b))
    found = local_anchors(a, b)
    if not found:
        return chain(context_anchors(a, b, cfg.context_anchor_k1) or context_anchors(a, b, cfg.context_anchor_k2))
    if len(found) < cfg.context_anchor_k1:
        found = list(dict.fromkeys([*found, *context_anchors(a, b, cfg.context_anchor_k1)]))
    return chain(found)


def _around_moves(a: Lines, b: Lines, cfg: DiffConfig, depth: int, moves: list[tuple[int, int, int]]) -> Alignment:
    out = Alignment(moves=list(moves), matched=[(s + k, t + k) for s, t, n in moves for k in range(n)])
    rest_a = np.setdiff1d(np.arange(len(a)), [i for i, _ in out.matched])
    rest_b = np.setdiff1d(np.arange(len(b)), [j for _, j in out.matched])
    rest = fill(a.part(rest_a), b.part(rest_b), cfg, depth, [])
    to_a, to_b = rest_a.tolist(), rest_b.tolist()
    out.add(
        Alignment(
            [(to_a[i], to_b[j]) for i, j in rest.matched], [to_b[j] for j in rest.inserted], [to_a[i] for i in rest.deleted],
            [(to_a[s], to_b[t], n) for s, t, n in rest.moves],
        )
    )
    return out


def assemble(a: Lines, b: Lines, kept: list[tuple[int, int]], cfg: DiffConfig, depth: int, moves: list[tuple[int, int, int]]) -> Alignment:
    """Anchors in order, and the gaps between them filled one by one."""
    out = Alignment(matched=list(kept))
    i = j = 0
    for end_a, end_b in [*kept, (len(a), len(b))]:
        if end_a > i or end_b > j:
            inside = [(s - i, t - j, n) for s, t, n in moves if i <= s and s + n <= end_a and j <= t and t + n <= end_b]
            gap = fill(a.part(slice(i, end_a)), b.part(slice(j, end_b)), cfg, depth, inside)
            out.add(
                Alignment(
                    [(x + i, y + j) for x, y in gap.matched], [y + j for y in gap.inserted], [x + i for x in gap.deleted],
                    [(s + i, t + j, n) for s, t, n in gap.moves],
                )
            )
        i, j = end_a + 1, end_b + 1
    return out.ordered()


# ---- whole sides


def _runs(x: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], x.sig[1:] != x.sig[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x.sig[start], start, np.diff(np.append(start, len(x)))


def by_runs(a: Lines, b: Lines) -> Alignment | None:
    """Sides that are the same sequence of runs, each side's run being as long as it likes; one may end earlier."""
    (sig_a, at_a, n_a), (sig_b, at_b, n_b) = _runs(a), _runs(b)
    shared = min(len(sig_a), len(sig_b))
    if not shared or (sig_a[:shared] != sig_b[:shared]).any():
        return None
    n_both = np.zeros(max(len(n_a), len(n_b)), np.int64)
    n_both[:shared] = np.minimum(n_a[:shared], n_b[:shared])
    span = lambda at, skip, n: [int(x) for s, k, m in zip(at, skip, n) for x in range(s + k, s + m)]
    matched = [(int(x) + k, int(y) + k) for x, y, n in zip(at_a, at_b, n_both) for k in range(n)]
    return Alignment(matched, span(at_b, n_both, n_b), span(at_a, n_both, n_a))


def align(a: Lines, b: Lines, cfg: DiffConfig) -> Alignment:
    """The whole of two sides: equal lists, runs, else anchors, moves and gaps."""
    if len(a) == len(b) and (a.sig == b.sig).all():
        return Alignment([(i, i) for i in range(len(a))])
    runs_a, runs_b = len(_runs(a)[0]), len(_runs(b)[0])
    if (runs_a == runs_b == 1) or 0 < runs_a * 2 <= len(a) or 0 < runs_b * 2 <= len(b):
        found = by_runs(a, b)
        if found:
            return found.ordered()
    kept = chain(anchors(a, b))
    moves = global_moves(a, b, kept, cfg) if cfg.max_move_iterations > 0 else []
    return assemble(a, b, kept, cfg, 0, moves)


def single_gap(a: Lines, b: Lines, cfg: DiffConfig) -> Alignment | None:
    """Exactly one line more on one side, with a signature that the other side lacks; all else equal in order."""
    if abs(len(a) - len(b)) != 1:
        return None
    return block_gap(a, b, cfg)


def block_gap(a: Lines, b: Lines, cfg: DiffConfig) -> Alignment | None:
    """A contiguous block more on one side, each of its lines lacking on the other; all else equal in order."""
    gap = len(b) - len(a)
    if not gap or abs(gap) > cfg.max_block_gap or repetitive(a, b, cfg):
        return None
    short, long = (a, b) if gap > 0 else (b, a)
    same = short.sig == long.sig[: len(short)]
    prefix = len(short) if same.all() else int(same.argmin())
    if (short.sig[prefix:] != long.sig[prefix + abs(gap) :]).any() or np.isin(long.sig[prefix : prefix + abs(gap)], short.sig).any():
        return None
    block = list(range(prefix, prefix + abs(gap)))
    if any(c > 1 for c in Counter(long.sig[block].tolist()).values()):
        return None
    rest = [k for k in range(len(long)) if not prefix <= k < prefix + abs(gap)]
    return Alignment(list(zip(range(len(a)), rest)), block, []) if gap > 0 else Alignment(list(zip(rest, range(len(b)))), [], block)


def repetitive(a: Lines, b: Lines, cfg: DiffConfig) -> bool:
    most = lambda x: int(np.unique(x.sig, return_counts=True)[1].max()) if len(x) else 0
    return max(most(a), most(b)) > cfg.max_hash_repeat


def _differing(a: Lines, b: Lines) -> tuple[int, int] | None:
    """First differing line and the end of the last one, of sides of equal length."""
    at = np.flatnonzero(a.sig != b.sig)
    return (int(at[0]), int(at[-1]) + 1) if len(at) else None


def _dominated(x: Lines) -> bool:
    return int(x.low.sum()) * 2 > len(x)


def exact_move(a: Lines, b: Lines, cfg: DiffConfig, bare: bool | None = None) -> tuple[int, int, int] | None:
    """One block of lines, unique on both sides, that stands elsewhere while all other lines keep their order."""
    if len(a) != len(b) or (bare if bare is not None else _dominated(a) or _dominated(b)) or repetitive(a, b, cfg):
        return None
    span = _differing(a, b)
    if not span:
        return None
    first, end = span
    once = {s for s, n in Counter(a.sig.tolist()).items() if n == 1} & {s for s, n in Counter(b.sig.tolist()).items() if n == 1}

    def tried(src: int, dst: int):
        room = end - max(src, dst)
        same = a.sig[src : src + room] == b.sig[dst : dst + room]
        n = room if same.all() else int(same.argmin())
        if not n or abs(src - dst) < n:
            return None
        rest = lambda x, at: np.delete(x.sig, slice(at, at + n))
        if (rest(a, src) != rest(b, dst)).any() or not once.issuperset(a.sig[src : src + n].tolist()):
            return None
        return src, dst, n

    for x, y, up in ((a, b, True), (b, a, False)):
        at = np.flatnonzero(x.sig[first:end] == y.sig[first])
        if len(at):
            other = first + int(at[0])
            found = tried(other, first) if up else tried(first, other)
            if found:
                return found
    return None


def fuzzy_move(a: Lines, b: Lines, cfg: DiffConfig) -> tuple[int, int, int] | None:
    """One block that stands elsewhere with some of its lines edited; None where more than one way is possible."""
    if len(a) != len(b) or _dominated(a) or _dominated(b) or repetitive(a, b, cfg):
        return None
    span = _differing(a, b)
    if not span or span[1] - span[0] < 2:
        return None
    x, y = a.sig[span[0] : span[1]], b.sig[span[0] : span[1]]
    size, found = len(x), []
    for n in range(1, min(size - 1, cfg.max_fuzzy_block_rows) + 1):
        for src, dst, fits in ((size - n, 0, (x[: size - n] == y[n:]).all()), (0, size - n, (x[n:] == y[: size - n]).all())):
            if fits and src != dst:
                p, q = x[src : src + n], y[dst : dst + n]
                both = len(np.intersect1d(p, q)) / len(np.union1d(p, q))
                if max(both, (int((p == q).sum()) + 1) / (n + 1)) >= cfg.fuzzy_similarity_threshold:
                    found.append((src + span[0], dst + span[0], n))
    return found[0] if len(found) == 1 else None


def best_offset(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions of both sides when the shorter slides to where most signatures of the longer agree; first best wins."""
    if not len(a) or not len(b):
        return None
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    score = [int((short == long[k : k + len(short)]).sum()) for k in range(len(long) - len(short) + 1)]
    k = int(np.argmax(score)) if max(score) else 0
    own, other = np.arange(len(short)), np.arange(k, k + len(short))
    return (own, other) if len(a) <= len(b) else (other, own)
