"""Numpy helpers used inside tasks: distance blocks and pairwise alignment of a batch.

Spark decides which rows meet; these functions only score one bounded batch.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from receptorium.constants import (
    BLOSUM62, BLOSUM_LETTERS, BLOSUM_UNKNOWN, CDR3_GAP, CDR3_TRIM_C, CDR3_TRIM_N,
    TCRDIST_CDR3_WEIGHT, TCRDIST_GAP, TCRDIST_MAX_COST,
)

GAP_CODE = len(BLOSUM_LETTERS) + 1  # "-" and "."; every other letter shares the "unknown" code
N_CODES = len(BLOSUM_LETTERS) + 2


@lru_cache(maxsize=1)
def blosum() -> np.ndarray:
    """Substitution scores by code; the unknown letter scores -4 against everything, itself included."""
    n = len(BLOSUM_LETTERS)
    m = np.full((N_CODES, N_CODES), BLOSUM_UNKNOWN, dtype=np.int16)
    for i, line in enumerate(BLOSUM62.strip().splitlines()):
        for j, v in enumerate(line.split()):
            m[i, j] = m[j, i] = int(v)
    assert m[n - 1, n - 1] == 1
    return m


@lru_cache(maxsize=1)
def substitution_cost() -> np.ndarray:
    """cost[a, b] = self score of a minus score of a against b (not symmetric)."""
    m = blosum().astype(np.float32)
    return m.diagonal()[:, None] - m


@lru_cache(maxsize=1)
def tcrdist_cost() -> np.ndarray:
    """0 for equal letters, else min(4, 4 - blosum); a gap letter against a residue costs 4."""
    m = np.minimum(TCRDIST_MAX_COST, TCRDIST_MAX_COST - blosum()).astype(np.float32)
    np.fill_diagonal(m, 0)
    m[GAP_CODE, :] = m[:, GAP_CODE] = TCRDIST_GAP
    m[GAP_CODE, GAP_CODE] = 0
    return m


@lru_cache(maxsize=1)
def _code_table() -> np.ndarray:
    table = np.full(256, len(BLOSUM_LETTERS), dtype=np.uint8)
    for i, ch in enumerate(BLOSUM_LETTERS):
        table[ord(ch)] = i
    table[ord("-")] = table[ord(".")] = GAP_CODE
    return table


def encode(strings, length: int) -> np.ndarray:
    """Codes of equally long strings, one row each."""
    flat = "".join(strings).encode("latin-1", "replace")
    return _code_table()[np.frombuffer(flat, dtype=np.uint8)].reshape(len(strings), length)


def by_length(strings) -> dict[int, np.ndarray]:
    lengths = np.fromiter((len(s) for s in strings), dtype=np.int64, count=len(strings))
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def _one_hot(codes: np.ndarray) -> np.ndarray:
    n, length = codes.shape
    out = np.zeros((n, length * N_CODES), dtype=np.float32)
    cols = codes + np.arange(length) * N_CODES
    out[np.arange(n)[:, None], cols] = 1
    return out


def _segment(cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over positions of cost[a_i, b_i] for all rows of a against all rows of b."""
    if a.shape[1] == 0:
        return np.zeros((len(a), len(b)), dtype=np.float32)
    return cost[a].reshape(len(a), -1) @ _one_hot(b).T


def _trim(s: str) -> str:
    return s[CDR3_TRIM_N:len(s) - CDR3_TRIM_C] or s


def blosum_block(queries: list[str], candidates: list[str]) -> np.ndarray:
    """Matrix-based CDR3 distance of every query (rows) to every candidate (columns)."""
    queries, candidates = [_trim(s) for s in queries], [_trim(s) for s in candidates]
    cost = substitution_cost()
    out = np.zeros((len(queries), len(candidates)), dtype=np.float32)
    query_groups = [(n, rows, encode([queries[i] for i in rows], n)) for n, rows in by_length(queries).items()]
    for cl, crows in by_length(candidates).items():
        c = encode([candidates[i] for i in crows], cl)
        hot, own = _one_hot(c), cost[c].reshape(len(c), -1)
        for ql, qrows, q in query_groups:
            if ql <= cl:
                paid = cost[q].reshape(len(q), -1)
                options = (paid @ hot[:, o * N_CODES:(o + ql) * N_CODES].T for o in range(cl - ql + 1))
            else:
                options = (_one_hot(q[:, o:o + cl]) @ own.T for o in range(ql - cl + 1))
            best = None
            for d in options:
                best = d if best is None else np.minimum(best, d)
            out[np.ix_(qrows, crows)] = best + CDR3_GAP * abs(ql - cl)
    return out


def loop_block(queries: list[str], candidates: list[str]) -> np.ndarray:
    """Germline loop distance: untrimmed, one fixed gap position when lengths differ."""
    return _tcrdist(queries, candidates, 0, 0, fixed=True)


def cdr3_block(queries: list[str], candidates: list[str]) -> np.ndarray:
    """CDR3 part of tcrdist, weighted."""
    return TCRDIST_CDR3_WEIGHT * _tcrdist(queries, candidates, CDR3_TRIM_N, CDR3_TRIM_C, fixed=False)


def gap_positions(short: int, fixed: bool) -> range:
    if fixed:
        at = min(6, 3 + (short - 5) // 2)
        return range(at, at + 1)
    low, high = 5, short - 5
    while low > high:
        low, high = low - 1, high + 1
    return range(low, high + 1)


def _tcrdist(queries, candidates, trim_n: int, trim_c: int, fixed: bool) -> np.ndarray:
    cost = tcrdist_cost()
    out = np.zeros((len(queries), len(candidates)), dtype=np.float32)
    candidate_groups = [(n, rows, encode([candidates[i] for i in rows], n))
                        for n, rows in by_length(candidates).items()]
    for ql, qrows in by_length(queries).items():
        q = encode([queries[i] for i in qrows], ql)
        for cl, crows, c in candidate_groups:
            if ql == cl:
                stop = max(trim_n, ql - trim_c)
                block = _segment(cost, q[:, trim_n:stop], c[:, trim_n:stop])
            else:
                block = None
                short = min(ql, cl)
                for at in gap_positions(short, fixed):
                    left = max(trim_n, min(at, short))
                    d = _segment(cost, q[:, trim_n:left], c[:, trim_n:left])
                    right = short - at  # residues compared from the right end
                    if right > trim_c:
                        d = d + _segment(cost, q[:, ql - right:ql - trim_c], c[:, cl - right:cl - trim_c])
                    block = d if block is None else np.minimum(block, d)
                block = block + TCRDIST_GAP * abs(ql - cl)
            out[np.ix_(qrows, crows)] = block
    return out


def smallest(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k smallest values of every row; earlier columns win ties.

    NaN marks a pair that must not be reported.
    """
    d = np.where(np.isnan(distance), np.inf, distance)
    cut = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
    rows, cols = np.nonzero((d <= cut[:, None]) & np.isfinite(d))
    order = np.lexsort((cols, d[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)  # rank inside the row
    keep = place < k
    return rows[keep], cols[keep]


# --- pairwise alignment -------------------------------------------------------------------------

NEG = np.float32(-1e9)


def _pad(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    width = max(1, int(lengths.max(initial=1)))
    out = np.zeros((len(strings), width), dtype=np.uint8)
    for row, s in zip(out, strings):
        row[:len(s)] = np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)
    return out, lengths


def _pair_scores(target: np.ndarray, query: np.ndarray, scores: np.ndarray | None, match: float, mismatch: float):
    """Function of a target position giving the score of that letter against the whole query."""
    if scores is None:
        return lambda i: np.where(target[:, i, None] == query, np.float32(match), np.float32(mismatch))
    table = _code_table()
    t, q, m = table[target], table[query], scores.astype(np.float32)
    return lambda i: m[t[:, i, None], q]


class _Sweep:
    """Affine-gap dynamic programme over a batch of pairs, one target letter at a time.

    Within a row the horizontal gap is a running maximum, so every step is a batch operation. Only every ``stride``-th row is
    held; ``rows`` computes the rows between two of them again for a traceback, so that memory grows with the length, not its square.
    """

    def __init__(self, targets, queries, scores, match, mismatch, opening, extend, local):
        self.t, self.tl = _pad(targets)
        self.q, self.ql = _pad(queries)
        self.letter = _pair_scores(self.t, self.q, scores, match, mismatch)
        self.opening, self.extend, self.local = opening, extend, local
        self.cols = np.arange(self.q.shape[1] + 1, dtype=np.float32)
        self.zero = np.zeros((len(self.q), len(self.cols)), dtype=np.float32)

    def _first(self):
        shape = (len(self.q), len(self.cols))
        if self.local:
            h = np.zeros(shape, dtype=np.float32)
        else:
            edge = np.where(self.cols == 0, np.float32(0), self.opening + self.extend * (self.cols - 1))
            h = np.broadcast_to(edge, shape).astype(np.float32)
        return h, np.full(shape, NEG, dtype=np.float32), np.full(shape, NEG, dtype=np.float32)

    def _step(self, h, f, i):
        opening, extend, cols = self.opening, self.extend, self.cols
        f = np.maximum(h + opening, f + extend)
        diagonal = np.full(h.shape, NEG, dtype=np.float32)
        diagonal[:, 1:] = h[:, :-1] + self.letter(i)
        base = np.maximum(diagonal, f)
        if self.local:
            base = np.maximum(base, self.zero)
        run = np.maximum.accumulate(base - extend * cols, axis=1)
        e = np.full(h.shape, NEG, dtype=np.float32)
        e[:, 1:] = run[:, :-1] + opening + extend * (cols[1:] - 1)
        return np.maximum(base, e), e, f

    def run(self, stride: int = 0) -> np.ndarray:
        """Best score per pair; the end positions stay in ``ends``, every ``stride``-th row in ``held``. Where that is none but the first,
        all rows are kept for ``rows``."""
        self.kept = [] if stride >= self.t.shape[1] else None
        h, e, f = self._first()
        pairs = np.arange(len(h))
        valid = np.arange(h.shape[1])[None, :] <= self.ql[:, None]
        self.held, self.ends = ([(h, f)] if stride else []), (np.zeros(len(h), np.int64), np.zeros(len(h), np.int64))
        best = np.full(len(h), np.float32(0) if self.local else NEG, dtype=np.float32)
        if not self.local:
            best = np.where(self.tl == 0, h[pairs, self.ql], best)
            self.ends = (self.tl.copy(), self.ql.copy())
        for i in range(self.t.shape[1]):
            h, e, f = self._step(h, f, i)
            if self.local:
                shown = np.where(valid, h, NEG)
                at = shown.argmax(axis=1)
                better = (i < self.tl) & (shown[pairs, at] > best)
                best = np.where(better, shown[pairs, at], best)
                self.ends[0][better], self.ends[1][better] = i + 1, at[better]
            else:
                best = np.where(self.tl == i + 1, h[pairs, self.ql], best)
            if self.kept is not None:
                self.kept.append((h, e, f))
            if stride and (i + 1) % stride == 0:
                self.held.append((h, f))
        return best

    def rows(self, block: int, stride: int) -> list:
        """Layers (h, e, f) of rows block * stride to (block + 1) * stride; e of the first one is never asked for."""
        h, f = self.held[block]
        out = [(h, None, f)]
        if self.kept is not None:
            return out + self.kept
        for i in range(block * stride, min((block + 1) * stride, self.t.shape[1])):
            h, e, f = self._step(h, f, i)
            out.append((h, e, f))
        return out


LANES, FEW_LANES = 16_384, 1_024


def local_scores(targets: list[str], queries: list[str], match=2, mismatch=-1, opening=-6, extend=-1) -> np.ndarray:
    """Best local score of every query (rows) against every target (columns). Many queries are taken cell by cell."""
    out = np.zeros((len(queries), len(targets)), dtype=np.int32)
    order = np.argsort([len(q) for q in queries], kind="stable") if len(queries) >= FEW_LANES else np.zeros(0, np.int64)
    for start in range(0, len(order), LANES):
        batch = order[start:start + LANES]
        out[batch] = _scores_by_cell(targets, [queries[i] for i in batch], match, mismatch, opening, extend)
    return out if len(order) else _scores_by_row(targets, queries, match, mismatch, opening, extend)


def _scores_by_cell(targets, queries, match, mismatch, opening, extend) -> np.ndarray:
    """Each cell of the matrix is one step over all queries, whose few arrays stay in the nearest cache. Scores are held in one byte until
    one comes near its limit. Shorter queries are filled up with a letter that matches nothing."""
    out = np.zeros((len(queries), len(targets)), dtype=np.int32)
    longest = max(map(len, queries))
    if not longest:
        return out
    q = np.full((longest, len(queries)), -1, dtype=np.int16)
    for n, text in enumerate(queries):
        q[:len(text), n] = np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)
    codes = [list(t.encode("latin-1", "replace")) for t in targets]
    wide, profiles = np.int8 if match - opening < 20 and -extend < 20 else np.int16, {}
    for n, target in enumerate(codes):
        while True:
            if wide not in profiles:
                profiles[wide] = {ch: list(np.where(q == ch, wide(match - opening), wide(mismatch - opening))) for ch in {x for t in codes for x in t}}
            peak = _peaks(target, profiles[wide], longest, len(queries), wide, opening, extend, match)
            if peak is not None:
                break
            wide = np.int16 if wide == np.int8 and min(longest, len(target)) * match < 32_000 else np.int32
        out[:, n] = peak
    return out


def _peaks(target, profile, longest, lanes, wide, opening, extend, match):
    """Best scores against one target, or None where a score comes near the limit of ``wide``."""
    limit = np.iinfo(wide).max - match + opening - 1
    low, down, zero = (np.full(lanes, x, wide) for x in (opening, extend, 0))  # numpy is slow at maxima with one number
    # scores plus the cost of opening a gap there, and vertical gaps, by position
    before, now, f = ([low.copy() for _ in range(longest + 1)] for _ in range(3))
    peak, e = np.zeros(lanes, wide), np.empty(lanes, wide)
    add, maximum = np.add, np.maximum
    for ch in target:
        e[:] = low
        for up, score, diagonal, above, left, new in zip(f, profile[ch], before, before[1:], now, now[1:]):
            add(up, down, up)
            maximum(up, above, up)
            add(e, down, e)
            maximum(e, left, e)
            add(diagonal, score, new)
            maximum(new, up, new)
            maximum(new, e, new)
            maximum(new, zero, new)
            maximum(peak, new, peak)
            add(new, low, new)
        before, now = now, before
        if peak.max(initial=0) > limit:
            return None
    return peak


def _scores_by_row(targets: list[str], queries: list[str], match, mismatch, opening, extend) -> np.ndarray:
    """Positions run down and queries across, so each step works on all queries at once."""
    out = np.zeros((len(queries), len(targets)), dtype=np.int32)
    codes = [np.frombuffer(t.encode("latin-1", "replace"), dtype=np.uint8) for t in targets]
    for length, rows in by_length(queries).items():
        if length == 0:
            continue
        wide = np.int32 if length * match > 15_000 else np.int16
        low = wide(-16_000)
        ramp = (np.arange(length, dtype=wide) * wide(-extend))[:, None]
        for start in range(0, len(rows), 256):
            batch = rows[start:start + 256]
            q, _ = _pad([queries[i] for i in batch])
            q = np.ascontiguousarray(q.T)
            profile = {int(ch): np.where(q == ch, wide(match), wide(mismatch)).astype(wide)
                       for ch in np.unique(np.concatenate(codes))} if codes else {}
            for n, target in enumerate(codes):
                h = np.zeros(q.shape, dtype=wide)
                f = np.full(q.shape, low, dtype=wide)
                peak = np.zeros(q.shape, dtype=wide)
                base, run, other, zero = np.empty_like(h), np.empty_like(h), np.empty_like(h), np.zeros_like(h)
                for ch in target.tolist():
                    np.add(f, wide(extend), out=f)
                    np.add(h, wide(opening), out=run)
                    np.maximum(f, run, out=f)
                    score = profile[ch]
                    np.add(h[:-1], score[1:], out=base[1:])
                    base[0] = score[0]
                    np.maximum(base, f, out=base)
                    np.maximum(base, zero, out=base)
                    np.add(base, ramp, out=run)
                    # a gap from a cell is worth something only over ``reach`` letters, so the running maximum doubles up to there
                    reach, step = min(length, (int(base.max()) + opening) / -extend if extend else length), 1
                    while step <= reach:
                        other[:step] = run[:step]
                        np.maximum(run[step:], run[:-step], out=other[step:])
                        run, other, step = other, run, 2 * step
                    np.subtract(run, ramp, out=run)
                    h[0] = base[0]
                    np.add(run[:-1], wide(opening), out=run[:-1])
                    np.maximum(base[1:], run[:-1], out=h[1:])
                    np.maximum(peak, h, out=peak)
                out[batch, n] = peak.max(axis=0)
    return out


def global_scores(targets, queries, scores=None, match=2.0, mismatch=-1.0, opening=-5.0, extend=-0.5) -> np.ndarray:
    return _Sweep(targets, queries, scores, match, mismatch, opening, extend, False).run()


CELLS_AT_ONCE = 4_000_000


def aligned_pairs(targets, queries, local, scores=None, match=2.0, mismatch=-1.0, opening=-6.0, extend=-1.0):
    """Per pair the matched positions as two arrays (target, query), by a batch traceback.

    Fixed rule among equal alignments: the end with the smallest target, then query position;
    stepping back, a match first, then a gap in the query, then a gap in the target.
    """
    best, out, start = [], [], 0
    while start < len(targets):
        # as many pairs as keep the rows held at once (two square roots of the target's length) within bounds
        many, width, length = 0, 1, 1
        for t, q in zip(targets[start:], queries[start:]):
            width, length = max(width, len(q) + 1), max(length, len(t) + 1)
            if many and (many + 1) * width * 2 * length ** 0.5 > CELLS_AT_ONCE:
                break
            many += 1
        part = slice(start, start + many)
        score, pairs = _traced(targets[part], queries[part], local, scores, match, mismatch, opening, extend)
        best.append(score)
        out += pairs
        start += many
    return (np.concatenate(best) if best else np.zeros(0, np.float32)), out


def _traced(targets, queries, local, scores, match, mismatch, opening, extend):
    sweep = _Sweep(targets, queries, scores, match, mismatch, opening, extend, local)
    t, q, length = sweep.t, sweep.q, sweep.t.shape[1]
    stride = max(1, int(np.ceil(length ** 0.5)))
    if len(t) * (q.shape[1] + 1) * (length + 1) <= CELLS_AT_ONCE:
        stride = max(1, length)  # one block
    best = sweep.run(stride)
    opening, extend = np.float32(opening), np.float32(extend)
    done = (best <= 0) if local else np.zeros(len(t), bool)
    i, j = (np.asarray(x, np.int64).copy() for x in sweep.ends)
    state, found = np.zeros(len(t), np.int8), []
    table = _code_table()
    tc, qc = (t, q) if scores is None else (table[t], table[q])
    for block in range((length - 1) // stride if length else 0, -1, -1):
        low = block * stride
        layers = sweep.rows(block, stride)
        h, f = np.stack([x[0] for x in layers]), np.stack([x[2] for x in layers])
        e = np.stack([x[2] if x[1] is None else x[1] for x in layers])  # of the first row it is never asked
        _walk_back(i, j, state, done, found, h, e, f, low, local, tc, qc, scores, match, mismatch, opening)
    pair, ts, qs = (np.concatenate([x[n] for x in found][::-1]) if found else np.zeros(0, np.int64) for n in range(3))
    order = np.argsort(pair, kind="stable")
    edges = np.searchsorted(pair[order], np.arange(1, len(t)))
    return best, list(zip(np.split(ts[order], edges), np.split(qs[order], edges)))


def _walk_back(i, j, state, done, found, h, e, f, low, local, t, q, scores, match, mismatch, opening) -> None:
    """Follow the tracebacks of all pairs down to row ``low``, one step of each at a time. States: 0 a match, 1 a gap in the query, 2 a gap
    in the target. ``found`` takes (pairs, target positions, query positions) of every step."""
    going = np.flatnonzero(~done & (i > low if low else (i > 0) | (j > 0)))
    if not low:
        done[:] = True
    while len(going):
        n = going[state[going] == 0]
        if len(n):
            x, y = i[n], j[n]
            value = h[x - low, n, y]
            if local:
                ended = value == 0
                done[n[ended]] = True
                going = going[~done[going]] if low else going[~np.isin(going, n[ended])]
                n, x, y, value = n[~ended], x[~ended], y[~ended], value[~ended]
            inside = (x > 0) & (y > 0)
            a, b = t[n, np.maximum(x - 1, 0)], q[n, np.maximum(y - 1, 0)]
            paid = np.where(a == b, np.float32(match), np.float32(mismatch)) if scores is None else np.asarray(scores)[a, b].astype(np.float32)
            matched = inside & (value == h[np.maximum(x - 1 - low, 0), n, np.maximum(y - 1, 0)] + paid)
            i[n[matched]] -= 1
            j[n[matched]] -= 1
            if matched.any():
                found.append((n[matched], i[n[matched]], j[n[matched]]))
            down = ~matched & (x > 0) & ((value == f[x - low, n, y]) | (y == 0))
            state[n[down]] = 1
            state[n[~matched & ~down]] = 2
        n = going[state[going] == 1]
        if len(n):
            x, y = i[n], j[n]
            value = f[x - low, n, y]
            opened = value == h[np.maximum(x - 1 - low, 0), n, y] + opening
            if not local:
                opened = np.where((x == 1) & (y > 0), True, np.where(y == 0, False, opened))
            state[n[opened]] = 0
            i[n] -= 1
        other = going[state[going] == 2]
        if len(other):
            x, y = i[other], j[other]
            opened = e[x - low, other, y] == h[x - low, other, y - 1] + opening
            if not local:
                opened &= x > 0
            state[other[opened]] = 0
            j[other] -= 1
        going = going[i[going] > low] if low else going[(i[going] > 0) | (j[going] > 0)]


def gapped(target: str, query: str, ts: np.ndarray, qs: np.ndarray) -> tuple[str, str]:
    """The two gapped rows of a global alignment."""
    a, b, i, j = [], [], 0, 0
    for x, y in [*zip(ts.tolist(), qs.tolist()), (len(target), len(query))]:
        a += [target[i:x], "-" * (y - j)]
        b += ["-" * (x - i), query[j:y]]
        if x < len(target) or y < len(query):
            a.append(target[x:x + 1])
            b.append(query[y:y + 1])
        i, j = x + 1, y + 1
    return "".join(a), "".join(b)
