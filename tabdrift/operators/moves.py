"""Moved blocks of a sheet, and the plan by which its cells are compared.

A plan says which ranges of old rows and columns are compared with which new ones, which cells are left out, and which
operations on whole rows, columns and blocks there are. It holds ranges, never cells, so it stays small."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..config import DiffConfig
from . import align
from .align import Lines


@dataclass
class Sheet:
    """One side: its shape, its rows and columns as lines, and the cells of small sheets as a matrix of numbers that are
    equal where cells are equal: 0 for no cell, negative ones for cells that tell nothing (blank, or an empty text)."""

    nrows: int
    ncols: int
    rows: Lines
    cols: Lines
    loose: np.ndarray  # column signatures that ignore the order of cells
    cells: np.ndarray | None = None


def sheet_of(cells: np.ndarray, book: dict, cfg: DiffConfig) -> Sheet:
    """A sheet from its matrix. book numbers signatures and is shared by the sides that are compared."""
    number = lambda x: book.setdefault(x.tobytes(), len(book))
    some = lambda line: line[line != 0]
    filled = (cells != 0).sum(axis=1)
    bare = (filled == 0) | ((filled == 1) & (cells.min(axis=1, initial=0) < 0))
    rows = Lines([number(some(r)) for r in cells], filled).classified(cfg, bare)
    cols = Lines([number(some(c)) for c in cells.T], (cells != 0).sum(axis=0)).classified(cfg)
    loose = np.array([number(np.sort(some(c))) for c in cells.T], np.int64)
    return Sheet(*cells.shape, rows, cols, loose, cells)


@dataclass
class Plan:
    """mode; row and column ranges (old, new, count); left-out rectangles (row, col, rows, cols); operations (kind, row,
    col, rows, cols, target row, target col) in order, before and after the edits; rows of moved blocks with edits."""

    mode: str
    rows: list[tuple[int, int, int]] = field(default_factory=list)
    cols: list[tuple[int, int, int]] = field(default_factory=list)
    skip_old: list[tuple[int, int, int, int]] = field(default_factory=list)
    skip_new: list[tuple[int, int, int, int]] = field(default_factory=list)
    before: list[tuple] = field(default_factory=list)
    after: list[tuple] = field(default_factory=list)
    moved: list[tuple[int, int, int]] = field(default_factory=list)


def ranges(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Pairs as runs that are consecutive on both sides."""
    if not pairs:
        return []
    p = np.array(sorted(pairs), np.int64)
    start = np.flatnonzero(np.concatenate([[True], (np.diff(p, axis=0) != 1).any(axis=1)]))
    size = np.diff(np.append(start, len(p)))
    return [(int(p[s, 0]), int(p[s, 1]), int(n)) for s, n in zip(start, size)]


def op(kind: str, row=None, col=None, rows=None, cols=None, to_row=None, to_col=None) -> tuple:
    return kind, row, col, rows, cols, to_row, to_col


def tails(old: Sheet, new: Sheet, rows: bool = True, cols: bool = True) -> list[tuple]:
    """Rows and columns beyond the shape that both sides share."""
    out = []
    for on, kind, n, m, at in ((rows, "Row", old.nrows, new.nrows, "row"), (cols, "Column", old.ncols, new.ncols, "col")):
        if on:
            out += [op(f"{kind}Added" if m > n else f"{kind}Removed", **{at: k}) for k in range(min(n, m), max(n, m))]
    return out


def positional(old: Sheet, new: Sheet, mode: str = "positional") -> Plan:
    return Plan(mode, [(0, 0, min(old.nrows, new.nrows))], [(0, 0, min(old.ncols, new.ncols))], after=tails(old, new))


# ---- rectangles


def _spans(at) -> list[tuple[int, int]]:
    """Sorted distinct positions as (first, count)."""
    at = np.unique(at)
    if not len(at):
        return []
    start = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
    return [(int(at[s]), int(n)) for s, n in zip(start, np.diff(np.append(start, len(at))))]


def _box(rows: tuple[int, int], cols: tuple[int, int]) -> tuple[slice, slice]:
    return slice(rows[0], sum(rows)), slice(cols[0], sum(cols))


def rect_move(a: np.ndarray, b: np.ndarray, cfg: DiffConfig) -> tuple[int, int, int, int, int, int] | None:
    """(row, col, rows, cols, target row, target col) of a rectangle that stands elsewhere, everything else being equal."""
    if a.shape != b.shape or not a.size:
        return None
    book: dict = {}
    old, new = sheet_of(a, book, cfg), sheet_of(b, book, cfg)
    sparse = lambda s: int((s.cols.filled == 0).sum()) * 2 > s.ncols
    dominated = lambda s: int(s.rows.low.sum()) * 2 > s.nrows
    if any(sparse(s) or dominated(s) for s in (old, new)) or align.repetitive(old.rows, new.rows, cfg) or align.repetitive(old.cols, new.cols, cfg):
        return None
    if not np.isin(old.rows.sig, new.rows.sig).any() and not np.isin(old.cols.sig, new.cols.sig).any():
        return None
    pick = []
    for x, y in ((old.rows.sig, new.rows.sig), (old.cols.sig, new.cols.sig)):
        found = _spans(np.flatnonzero(x != y))
        if not found or len(found) > 2 or found[0][1] != found[-1][1]:
            return None
        once = lambda s: np.unique(s, return_counts=True)
        for s in (x, y):
            values, count = once(s)
            held = np.concatenate([s[f : f + n] for f, n in found])
            other = y if s is x else x
            if (count[np.searchsorted(values, held)] > 1).any() or (np.array([(other == h).sum() for h in held]) > 1).any():
                return None
        pick.append((found[0], found[-1]))
    rows, cols = pick
    if rows[0] == rows[1] and cols[0] == cols[1]:
        return None
    differs = a != b
    expected = 2 * rows[0][1] * cols[0][1]
    if int(differs[_box(rows[0], cols[0])].sum() + differs[_box(rows[1], cols[1])].sum()) != expected or int(differs.sum()) != expected:
        return None
    overlap = lambda p, q: p[0] < sum(q) and q[0] < sum(p)
    found = []
    for s, t in ((0, 1), (1, 0)):
        apart = not (overlap(rows[s], rows[t]) and overlap(cols[s], cols[t]))
        if apart and (a[_box(rows[s], cols[s])] == b[_box(rows[t], cols[t])]).all():
            found.append((rows[s][0], cols[s][0], rows[s][1], cols[s][1], rows[t][0], cols[t][0]))
    return found[0] if len(found) == 1 else None


class Masked:
    """Two small sheets with what was taken out of each so far: rows, columns, and rectangles of cells."""

    def __init__(self, old: Sheet, new: Sheet, cfg: DiffConfig):
        self.sides, self.cfg = (old, new), cfg
        self.row_on = [np.ones(s.nrows, bool) for s in self.sides]
        self.col_on = [np.ones(s.ncols, bool) for s in self.sides]
        self.rects: list[list[tuple[int, int, int, int]]] = [[], []]

    @property
    def touched(self) -> bool:
        return any(not x.all() for x in (*self.row_on, *self.col_on)) or any(self.rects)

    @property
    def left(self) -> bool:
        return all(x.any() for x in (*self.row_on, *self.col_on))

    def seen(self) -> list[np.ndarray]:
        """The cells of both sides without rectangles that were taken out."""
        out = []
        for side, rects in zip(self.sides, self.rects):
            cells = side.cells
            if rects:
                cells = cells.copy()
                for r, c, n, m in rects:
                    cells[r : r + n, c : c + m] = 0
            out.append(cells)
        return out

    def shown(self) -> tuple[list[np.ndarray], list[np.ndarray], list[Sheet]]:
        """Rows and columns that are left, and the sheets that they make."""
        rows, cols = [np.flatnonzero(x) for x in self.row_on], [np.flatnonzero(x) for x in self.col_on]
        if not self.touched:
            return rows, cols, list(self.sides)
        book: dict = {}
        return rows, cols, [sheet_of(m[np.ix_(r, c)], book, self.cfg) for m, r, c in zip(self.seen(), rows, cols)]

    def row_move(self, find) -> tuple[int, int, int] | None:
        rows, _, (a, b) = self.shown()
        found = find(a.rows, b.rows, self.cfg) if (a.nrows, a.ncols) == (b.nrows, b.ncols) else None
        return found and (int(rows[0][found[0]]), int(rows[1][found[1]]), found[2])

    def col_move(self) -> tuple[int, int, int] | None:
        _, cols, (a, b) = self.shown()
        if (a.nrows, a.ncols) != (b.nrows, b.ncols) or any(int((s.cols.filled == 0).sum()) * 2 > s.ncols for s in (a, b)):
            return None
        found = align.exact_move(Lines(a.loose, a.cols.filled), Lines(b.loose, b.cols.filled), self.cfg, bare=False)
        return found and (int(cols[0][found[0]]), int(cols[1][found[1]]), found[2])

    def rect(self) -> tuple[int, int, int, int, int, int] | None:
        """A rectangle of what is left: by itself first, else between two groups of rows that differ alike."""
        old, new = self.sides
        first = not self.touched and (old.nrows, old.ncols) == (new.nrows, new.ncols)
        if first and (found := rect_move(old.cells, new.cells, self.cfg)):
            return found
        rows = align.best_offset(old.rows.sig[self.row_on[0]], new.rows.sig[self.row_on[1]])
        cols = align.best_offset(old.cols.sig[self.col_on[0]], new.cols.sig[self.col_on[1]])
        if rows is None or cols is None:
            return None
        rows = [np.flatnonzero(on)[at] for on, at in zip(self.row_on, rows)]
        cols = [np.flatnonzero(on)[at] for on, at in zip(self.col_on, cols)]
        a, b = (m[np.ix_(r, c)] for m, r, c in zip(self.seen(), rows, cols))
        place = lambda m: (int(rows[0][m[0]]), int(cols[0][m[1]]), m[2], m[3], int(rows[1][m[4]]), int(cols[1][m[5]]))
        if not first and (found := rect_move(a, b, self.cfg)):
            return place(found)
        differs = a != b
        at = np.flatnonzero(differs.any(axis=1))
        if not len(at):
            return None
        cut = np.concatenate([[True], (np.diff(at) != 1) | (differs[at[1:]] != differs[at[:-1]]).any(axis=1)])
        start = np.flatnonzero(cut)
        groups = [(int(at[s]), int(n)) for s, n in zip(start, np.diff(np.append(start, len(at))))]
        if not self.touched and len(groups) <= 2 and len(_spans(np.flatnonzero(differs.any(axis=0)))) <= 2:
            return None
        for k, p in enumerate(groups):
            for q in groups[k + 1 :]:
                if p[1] != q[1]:
                    continue
                for c in _spans(np.flatnonzero(differs[p[0]])):
                    for d in _spans(np.flatnonzero(differs[q[0]])):
                        if c[1] != d[1]:
                            continue
                        keep = np.unique([*range(p[0], sum(p)), *range(q[0], sum(q))]), np.unique([*range(c[0], sum(c)), *range(d[0], sum(d))])
                        small = rect_move(a[np.ix_(*keep)], b[np.ix_(*keep)], self.cfg)
                        if small:
                            r, s = keep
                            return place((int(r[small[0]]), int(s[small[1]]), small[2], small[3], int(r[small[4]]), int(s[small[5]])))
                        for r, x, t, y in ((p, c, q, d), (p, d, q, c), (q, c, p, d), (q, d, p, c)):
                            if (a[_box(r, x)] == b[_box(t, y)]).all():
                                return place((r[0], x[0], r[1], x[1], t[0], y[0]))
        return None

    def settled(self) -> bool:
        """Whether what is left is equal line by line, where only rows, or only columns, were taken out."""
        rows_out, cols_out = [not x.all() for x in self.row_on], [not x.all() for x in self.col_on]
        if any(self.rects):
            return False
        if all(rows_out) and not any(cols_out):
            x, y = (s.rows.sig[on] for s, on in zip(self.sides, self.row_on))
        elif all(cols_out) and not any(rows_out):
            x, y = (s.cols.sig[on] for s, on in zip(self.sides, self.col_on))
        else:
            return False
        return len(x) == len(y) and bool((x == y).all())

    def search(self) -> tuple[list[tuple], list[tuple[int, int, int]]]:
        """Moves in the order they are found, and the row blocks among them that have edits inside."""
        ops, edited = [], []
        for _ in range(self.cfg.max_move_iterations):
            if not self.left:
                break
            if found := self.row_move(align.exact_move):
                ops.append(op("BlockMovedRows", row=found[0], rows=found[2], to_row=found[1]))
                self._without(self.row_on, found)
            elif found := self.col_move():
                ops.append(op("BlockMovedColumns", col=found[0], cols=found[2], to_col=found[1]))
                self._without(self.col_on, found)
            elif found := self.rect():
                r, c, n, m, t, d = found
                ops.append(op("BlockMovedRect", r, c, n, m, t, d))
                for rects in self.rects:
                    rects += [(r, c, n, m), (t, d, n, m)]
            elif self.cfg.enable_fuzzy_moves and (found := self.row_move(align.fuzzy_move)):
                ops.append(op("BlockMovedRows", row=found[0], rows=found[2], to_row=found[1]))
                edited.append(found)
                self._without(self.row_on, found)
            else:
                break
            if self.settled() or (self.sides[0].nrows, self.sides[0].ncols) != (self.sides[1].nrows, self.sides[1].ncols):
                break
        return ops, edited

    @staticmethod
    def _without(on: list[np.ndarray], found: tuple[int, int, int]) -> None:
        for side, start in zip(on, found):
            side[start : start + found[2]] = False

    def plan(self, ops: list[tuple], edited: list[tuple[int, int, int]]) -> Plan:
        """How the rest is compared: at equal places, those between a block's old and new place left out, or aligned."""
        old, new = self.sides
        out = Plan("masked", before=ops, moved=edited, skip_old=self.rects[0], skip_new=self.rects[1])
        if (old.nrows, old.ncols) == (new.nrows, new.ncols):

            def stable(on: list[np.ndarray]) -> list[tuple[int, int]]:
                gone = np.flatnonzero(~(on[0] & on[1]))
                return [(k, k) for k in range(len(on[0])) if not (len(gone) and gone[0] <= k <= gone[-1])]

            out.rows, out.cols = ranges(stable(self.row_on)), ranges(stable(self.col_on))
            return out
        rows = align.best_offset(old.rows.sig[self.row_on[0]], new.rows.sig[self.row_on[1]])
        cols = align.best_offset(old.cols.sig[self.col_on[0]], new.cols.sig[self.col_on[1]])
        if rows is None or cols is None:
            both = lambda on: [(k, k) for k in range(min(map(len, on))) if on[0][k] and on[1][k]]
            out.rows, out.cols = ranges(both(self.row_on)), ranges(both(self.col_on))
            on = {"RowAdded": self.row_on[1], "RowRemoved": self.row_on[0], "ColumnAdded": self.col_on[1], "ColumnRemoved": self.col_on[0]}
            out.after = [o for o in tails(old, new) if on[o[0]][o[1] if o[1] is not None else o[2]]]
            return out
        for on, at, name, kind in ((self.row_on, rows, "rows", "Row"), (self.col_on, cols, "cols", "Column")):
            known = [np.flatnonzero(x)[k] for x, k in zip(on, at)]
            setattr(out, name, ranges(list(zip(known[0].tolist(), known[1].tolist()))))
            field_ = "row" if kind == "Row" else "col"
            out.after += [op(f"{kind}Added", **{field_: int(k)}) for k in np.setdiff1d(np.flatnonzero(on[1]), known[1])]
            out.after += [op(f"{kind}Removed", **{field_: int(k)}) for k in np.setdiff1d(np.flatnonzero(on[0]), known[0])]
        return out


# ---- the cascade


def _aligned_rows(old: Sheet, new: Sheet, found: align.Alignment) -> Plan:
    out = Plan("rows", ranges(found.matched), [(0, 0, min(old.ncols, new.ncols))])
    out.after = [op("RowAdded", row=j) for j in found.inserted] + [op("RowRemoved", row=i) for i in found.deleted]
    out.after += [op("BlockMovedRows", row=s, rows=n, to_row=t) for s, t, n in found.moves] + tails(old, new, rows=False)
    return out


def _aligned_cols(old: Sheet, new: Sheet, found: align.Alignment) -> Plan:
    out = Plan("columns", [(0, 0, min(old.nrows, new.nrows))], ranges(found.matched))
    out.after = [op("ColumnAdded", col=j) for j in found.inserted] + [op("ColumnRemoved", col=i) for i in found.deleted]
    out.after += [op("BlockMovedColumns", col=s, cols=n, to_col=t) for s, t, n in found.moves]
    return out


def _columns(old: Sheet, new: Sheet, cfg: DiffConfig) -> align.Alignment | None:
    """Columns aligned like rows; None where nothing is added, removed or moved, or where columns were edited besides."""
    a, b = old.cols, new.cols
    if align.repetitive(a, b, cfg) or (len(a) == len(b) and (a.sig == b.sig).all()):
        return None
    found = align.align(a, b, cfg)
    structural = bool(found.inserted or found.deleted)
    if structural and any(a.sig[i] != b.sig[j] for i, j in found.matched):
        return None
    return found if structural or found.moves else None


def _single_column(old: Sheet, new: Sheet, cfg: DiffConfig) -> align.Alignment | None:
    return align.single_gap(old.cols, new.cols, cfg) if old.nrows == new.nrows else None


def _same_lines(a: Lines, b: Lines) -> bool:
    return len(a) == len(b) and bool((np.sort(a.sig) == np.sort(b.sig)).all())


def _without_moves(old: Sheet, new: Sheet, found: align.Alignment) -> align.Alignment:
    """Moves told as rows removed and rows added; where sides hold the same rows, also pairs of different rows."""
    gone = {s + k for s, _, n in found.moves for k in range(n)}
    come = {t + k for _, t, n in found.moves for k in range(n)}
    if _same_lines(old.rows, new.rows):
        apart = [(i, j) for i, j in found.matched if old.rows.sig[i] != new.rows.sig[j]]
        gone |= {i for i, _ in apart}
        come |= {j for _, j in apart}
    matched = [(i, j) for i, j in found.matched if i not in gone and j not in come]
    return align.Alignment(matched, sorted({*found.inserted, *come}), sorted({*found.deleted, *gone}))


def _with_moves(old: Sheet, new: Sheet, found: align.Alignment) -> align.Alignment:
    """Removed and added rows with a signature that both have once become moves, where they stand in runs."""
    gone, come = (Lines(s.rows.sig[at], s.rows.filled[at]) for s, at in ((old, found.deleted), (new, found.inserted)))
    once = lambda x: align._once(x, np.ones(len(x), bool))
    pairs = [(found.deleted[i], found.inserted[j]) for i, j in align._meet(once(gone), once(come))]
    moves = align.shifted_runs(pairs)
    src = {s + k for s, _, n in moves for k in range(n)}
    dst = {t + k for _, t, n in moves for k in range(n)}
    rest = align.Alignment(found.matched, [j for j in found.inserted if j not in dst], [i for i in found.deleted if i not in src])
    rest.moves = sorted([*found.moves, *moves])
    return rest


def plan_sheet(old: Sheet, new: Sheet, cfg: DiffConfig) -> Plan:
    """The plan of a sheet: moves first, then rows, columns, and cells at their places, whichever explains it."""
    small = max(old.nrows, new.nrows) <= cfg.max_move_detection_rows and max(old.ncols, new.ncols) <= cfg.max_move_detection_cols
    if small and cfg.max_move_iterations > 0 and old.cells is not None and new.cells is not None:
        masked = Masked(old, new, cfg)
        ops, edited = masked.search()
        if masked.touched:
            return masked.plan(ops, edited)
    found = align.align(old.rows, new.rows, cfg)
    moving = cfg.max_move_iterations > 0
    if found.inserted and found.deleted or not moving:
        found = _with_moves(old, new, found) if moving else _without_moves(old, new, found)
    structural = bool(found.inserted or found.deleted)
    if structural and not found.matched:
        return positional(old, new)
    if structural and moving and any(old.rows.sig[i] != new.rows.sig[j] for i, j in found.matched):
        return positional(old, new)
    if not structural and not found.moves:
        cols = _columns(old, new, cfg) or _single_column(old, new, cfg)
        if cols:
            return _aligned_cols(old, new, cols)
    same_place = old.nrows == new.nrows and all(i == j for i, j in found.matched)
    if moving and not found.moves and not (same_place and not structural) and _same_lines(old.rows, new.rows):
        return positional(old, new)
    return _aligned_rows(old, new, found)
