"""Exact nearest and farthest of one bounded piece of candidates, for batches of probes.

Both CDR3 distances are the least, over a few alignments, of a sum over the candidate's positions. Candidates are cut in two, each
distinct part is scored once per probe, and a candidate costs one addition. Candidates that share the left part form a group; groups
whose bounds show neither a nearest nor the farthest candidate are skipped.
"""

from __future__ import annotations

from typing import Callable

import numpy as np

from receptorium.constants import CDR3_GAP, CDR3_TRIM_C, CDR3_TRIM_N, TCRDIST_CDR3_WEIGHT, TCRDIST_GAP
from receptorium.functions import kernels

PROBES_AT_ONCE, CELLS_AT_ONCE, SEEDS, MIN_SHARED = 32, 1 << 19, 4, 8
SMALL = 16_000  # distances are whole numbers: below this they are held in two bytes


def _blosum_alignments(ql: int, cl: int):
    """(constant, cost, maps): each map names the probe position every candidate position is compared with, -1 for none."""
    cost, maps = kernels.substitution_cost(), []
    for o in range(abs(ql - cl) + 1):
        at = np.full(cl, -1)
        if ql <= cl:
            at[o:o + ql] = np.arange(ql)
        else:
            at[:] = o + np.arange(cl)
        maps.append(at)
    return CDR3_GAP * abs(ql - cl), cost if ql <= cl else cost.T, maps


def _tcrdist_alignments(ql: int, cl: int, trim_n: int = CDR3_TRIM_N, trim_c: int = CDR3_TRIM_C, fixed: bool = False, weight: int = TCRDIST_CDR3_WEIGHT):
    cost, maps, short = weight * kernels.tcrdist_cost(), [], min(ql, cl)
    for gap in kernels.gap_positions(short, fixed) if ql != cl else [None]:
        at = np.full(cl, -1)
        if gap is None:
            at[trim_n:max(trim_n, cl - trim_c)] = np.arange(cl)[trim_n:max(trim_n, cl - trim_c)]
        else:
            left = max(trim_n, min(gap, short))
            at[trim_n:left] = np.arange(trim_n, min(left, cl)) if cl > trim_n else -1
            if short - gap > trim_c:
                places = np.arange(cl - (short - gap), cl - trim_c)
                at[places] = places + ql - cl
        maps.append(at)
    return weight * TCRDIST_GAP * abs(ql - cl), cost, maps


def _loop_alignments(ql: int, cl: int):
    return _tcrdist_alignments(ql, cl, 0, 0, True, 1)


ALIGNMENTS = {"blosum": _blosum_alignments, "tcrdist": _tcrdist_alignments, "loop": _loop_alignments}


def pair_distances(queries: list[str], candidates: list[str], engine: str) -> np.ndarray:
    """Distance of every query to the candidate beside it."""
    trim = kernels._trim if engine == "blosum" else str
    queries, candidates = [trim(x) for x in queries], [trim(x) for x in candidates]
    out = np.zeros(len(queries), np.float32)
    for ql, rows in kernels.by_length(queries).items():
        for cl, some in kernels.by_length([candidates[i] for i in rows]).items():
            at_rows = rows[some]
            q, c = (kernels.encode([part[i] for i in at_rows], n) for part, n in ((queries, ql), (candidates, cl)))
            constant, cost, maps = ALIGNMENTS[engine](ql, cl)
            best = np.full(len(at_rows), np.inf, np.float32)
            for at in maps:
                used = np.flatnonzero(at >= 0)
                np.minimum(best, cost[q[:, at[used]], c[:, used]].sum(axis=1), out=best)
            out[at_rows] = best + constant
    return out


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the place of every row among them."""
    if codes.shape[1] == 0:
        return codes[:1], np.zeros(len(codes), np.int64)
    flat = np.ascontiguousarray(codes + 1).view(f"S{codes.shape[1]}").ravel()
    _, first, place = np.unique(flat, return_index=True, return_inverse=True)
    return codes[first], place.ravel()


def _table(parts: np.ndarray, offset: int, probes: np.ndarray, cost: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cost of every distinct part (rows), which begins at ``offset``, for every probe (columns)."""
    out = np.zeros((len(parts), len(probes)), cost.dtype)
    for i in range(parts.shape[1]):
        if at[offset + i] >= 0:
            out += np.ascontiguousarray(cost[probes[:, at[offset + i]]].T).take(parts[:, i], axis=0)
    return out


def _far(kind: np.dtype):
    return np.int16(32_767) if kind == np.int16 else np.float32(np.inf)


class _Length:
    """Candidates of one length, by their two parts and a kind whose cost is added whole."""

    def __init__(self, columns: np.ndarray, codes: np.ndarray, kinds: np.ndarray, compared: range):
        self.columns, self.length = columns, codes.shape[1]
        middle = (compared.start + compared.stop) // 2
        for cut in range(middle, compared.start, -1):
            self.left, place = _distinct(codes[:, compared.start:cut])
            if (fits := len(self.left) * MIN_SHARED <= len(codes)) or cut == compared.start + 1:
                pairs, group = np.unique(kinds.astype(np.int64) * len(self.left) + place, return_inverse=True)
                if not fits or len(pairs) * MIN_SHARED <= len(codes) or cut == compared.start + 1:
                    break
        else:
            cut = compared.start
            self.left, place = _distinct(codes[:, cut:cut])
            pairs, group = np.unique(kinds.astype(np.int64), return_inverse=True)
        self.start, self.cut = compared.start, cut
        self.group_kind, self.group_left = pairs // len(self.left), pairs % len(self.left)
        self.right, right = _distinct(codes[:, cut:compared.stop])
        order = np.argsort(group.ravel(), kind="stable")
        self.columns, self.group_of, self.right_of = columns[order], group.ravel()[order], right[order]
        self.bounded = len(pairs) * MIN_SHARED <= len(codes)
        self.begin = np.searchsorted(self.group_of, np.arange(len(pairs) + 1))

    def members(self, groups: np.ndarray) -> np.ndarray:
        sizes = self.begin[groups + 1] - self.begin[groups]
        return np.repeat(self.begin[groups] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def tables(self, probes: np.ndarray, shift: np.ndarray | None, alignments, kind) -> list:
        constant, cost, maps = alignments(probes.shape[1], self.length)
        cost = cost.astype(kind)
        base = kind(constant) if shift is None else shift.astype(kind)[self.group_kind] + kind(constant)
        return [(_table(self.left, self.start, probes, cost, at).take(self.group_left, axis=0) + base,
                 _table(self.right, self.cut, probes, cost, at)) for at in maps]

    def distances(self, tables: list, members: np.ndarray) -> np.ndarray:
        group, right, best = self.group_of[members], self.right_of[members], None
        for by_group, by_right in tables:
            d = by_group.take(group, axis=0)
            d += by_right.take(right, axis=0)
            best = d if best is None else np.minimum(best, d, out=best)
        return best


class Piece:
    """Candidates in index order. ``kinds`` (a small number per candidate) select a row of the costs that ``nearest`` adds."""

    def __init__(self, names: list[str], engine: str, kinds: np.ndarray | None = None):
        self.alignments, self.trim = ALIGNMENTS[engine], kernels._trim if engine == "blosum" else str
        names = [self.trim(x) for x in names]
        self.size = len(names)
        self.scratch = np.zeros(self.size, np.int64)
        kinds = np.zeros(self.size, np.int64) if kinds is None else np.asarray(kinds)
        self.lengths = []
        for n, columns in kernels.by_length(names).items():
            compared = range(0, n) if engine == "blosum" else range(min(CDR3_TRIM_N, n), max(min(CDR3_TRIM_N, n), n - CDR3_TRIM_C))
            self.lengths.append(_Length(columns, kernels.encode([names[i] for i in columns], n), kinds[columns], compared))

    def batches(self, queries: list[str]):
        """(probe rows, their codes): alike probes together, so that they skip the same groups."""
        queries = [self.trim(x) for x in queries]
        for n, rows in kernels.by_length(queries).items():
            rows = np.array(sorted(rows.tolist(), key=lambda i: queries[i]), np.int64)
            for start in range(0, len(rows), PROBES_AT_ONCE):
                batch = rows[start:start + PROBES_AT_ONCE]
                yield batch, kernels.encode([queries[i] for i in batch], n)

    def _kind(self, length: int, shift: np.ndarray | None = None):
        most = 50 * max([length, *(p.length for p in self.lengths)]) + (0 if shift is None else int(np.abs(shift).max(initial=0)))
        return np.int16 if most < SMALL else np.float32

    def nearest(self, queries: list[str], k: int, same: np.ndarray | None = None, shift: Callable[[np.ndarray], np.ndarray] | None = None):
        """(rows, columns, distances) of the k nearest candidates of every query, earlier columns first among equals, and the
        largest distance of each. ``same``: a candidate to leave out per query, or -1; ``shift(rows)``: kinds x rows, costs added."""
        found, top = [], np.zeros(len(queries))
        for batch, codes in self.batches(queries):
            added = None if shift is None else shift(batch)
            kind = self._kind(codes.shape[1], added)
            best = _Best(len(batch), k, None if same is None else same[batch], self.scratch, kind)
            for part in sorted(self.lengths, key=lambda p: abs(p.length - codes.shape[1])):
                self._scan(part, part.tables(codes, added, self.alignments, kind), best)
            found.append((batch[best.rows], best.columns, best.d))
            top[batch] = best.top
        rows, columns, d = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        return rows, columns, d, top

    def _scan(self, part: _Length, tables: list, best: "_Best") -> None:
        left = np.arange(len(part.group_kind))
        if part.bounded:
            low = np.minimum.reduce([g + r.min(axis=0) for g, r in tables])
            high = np.minimum.reduce([g + r.max(axis=0) for g, r in tables])
            seeds = np.unique(np.concatenate([
                np.argpartition(low, min(SEEDS, len(low)) - 1, axis=0)[:SEEDS].ravel(), high.argmax(axis=0)]))
            self._evaluate(part, tables, part.members(seeds), best)
            needed = ((low <= best.limit) | (high > best.top)).any(axis=1)
            needed[seeds] = False
            left = np.flatnonzero(needed)
        self._evaluate(part, tables, part.members(left), best)

    def _evaluate(self, part: _Length, tables: list, members: np.ndarray, best: "_Best") -> None:
        step = max(1, CELLS_AT_ONCE // len(best.top))
        for start in range(0, len(members), step):
            some = members[start:start + step]
            best.take(part.distances(tables, some), part.columns[some])

    def distances(self, queries: list[str]) -> np.ndarray:
        """Candidates (rows) against queries (columns)."""
        out = np.zeros((self.size, len(queries)), np.float32)
        for batch, codes in self.batches(queries):
            for part in self.lengths:
                tables = part.tables(codes, None, self.alignments, self._kind(codes.shape[1]))
                out[np.ix_(part.columns, batch)] = part.distances(tables, np.arange(len(part.columns)))
        return out


def nearest_pairs(names: list, queries: list, k: int, kinds: np.ndarray, shift: Callable[[np.ndarray], np.ndarray]):
    """As ``Piece.nearest``, for two tcrdist parts: the distances of the distinct names of either part are added for every candidate."""
    sides = []
    for part in names:
        place = {x: i for i, x in enumerate(dict.fromkeys(part))}
        sides.append((Piece(list(place), "tcrdist"), np.array([place[x] for x in part], np.int64)))
    order = np.array(sorted(range(len(queries[0])), key=lambda i: (queries[0][i], queries[1][i])), np.int64)
    found, top, scratch = [], np.zeros(len(order)), np.zeros(0, np.int64)
    for start in range(0, len(order), PROBES_AT_ONCE):
        batch = order[start:start + PROBES_AT_ONCE]
        best = _Best(len(batch), k, None, scratch, np.float32)
        tables = [piece.distances([asked[i] for i in batch]) for (piece, _), asked in zip(sides, queries)]
        added, step = np.ascontiguousarray(shift(batch), np.float32), max(1, CELLS_AT_ONCE // len(batch))
        for begin in range(0, len(kinds), step):
            some = slice(begin, begin + step)
            d = added.take(kinds[some], axis=0)
            for table, (_, place) in zip(tables, sides):
                d += table.take(place[some], axis=0)
            best.take(d, np.arange(begin, min(begin + step, len(kinds))))
        found.append((batch[best.rows], best.columns, best.d))
        top[batch] = best.top
    rows, columns, d = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    return rows, columns, d, top


class _Best:
    """The k nearest so far of a batch of probes, and the largest distance."""

    def __init__(self, n: int, k: int, same: np.ndarray | None, scratch: np.ndarray, kind):
        self.k, self.same, self.scratch, self.far = k, same, scratch, _far(np.dtype(kind))
        self.limit, self.top = np.full(n, self.far), np.zeros(n, kind)
        self.rows, self.columns, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def take(self, d: np.ndarray, columns: np.ndarray) -> None:
        """``d``: candidates x probes."""
        if not len(columns):
            return
        left_out = np.zeros((2, 0), np.int64)
        if self.same is not None:
            self.scratch[columns] = np.arange(len(columns))
            probes = np.flatnonzero(self.same >= 0)
            place = self.scratch[self.same[probes]]
            hit = (place < len(columns)) & (columns[np.minimum(place, len(columns) - 1)] == self.same[probes])
            left_out = np.array([place[hit], probes[hit]])
            d[left_out[0], left_out[1]] = -self.far
        self.top = np.maximum(self.top, d.max(axis=0))
        d[left_out[0], left_out[1]] = self.far
        limit = self.limit
        if len(columns) > 4 * self.k and (limit == self.far).any():
            limit = np.minimum(limit, np.partition(d, self.k - 1, axis=0)[self.k - 1])
        place, probe = np.divmod(np.flatnonzero((d <= limit).ravel()), d.shape[1])
        kept = d[place, probe] < self.far
        place, probe = place[kept], probe[kept]
        if not len(place):
            return
        rows, found, value = np.concatenate([self.rows, probe]), np.concatenate([self.columns, columns[place]]), np.concatenate([self.d, d[place, probe]])
        order = np.lexsort((found, value, rows))
        rows, found, value = rows[order], found[order], value[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < self.k
        self.rows, self.columns, self.d = rows[keep], found[keep], value[keep]
        full = rank == self.k - 1
        self.limit = self.limit.copy()
        self.limit[rows[full]] = value[full]
