"""Global alignment and centre-star merging as SQL: a recursive walk over the antidiagonals of all pairs at once.

A working row is one cell of the current antidiagonal, with the cell of the one before at the same target position. The traceback
is carried forward: each state keeps the edits (M pair, D target letter alone, I query letter alone) that the rule "a pair first,
then a gap in the query, then one in the target" would read backwards.
"""

from __future__ import annotations

from receptorium.constants import BLOSUM62, BLOSUM_LETTERS, BLOSUM_UNKNOWN


def _matrix() -> str:
    rows = [[int(v) for v in line.split()] for line in BLOSUM62.strip().splitlines()]
    cells = [f"'{a}{b}': {rows[max(i, j)][min(i, j)]}" for i, a in enumerate(BLOSUM_LETTERS) for j, b in enumerate(BLOSUM_LETTERS)]
    return "MAP {" + ", ".join(cells) + "}"


NT_SCORE, NT_GAPS = "case when substr(t, i, 1) = substr(q, j, 1) then 2.0 else -1.0 end", (-5.0, -0.5)
AA_SCORE, AA_GAPS = f"coalesce({_matrix()}[substr(t, i, 1) || substr(q, j, 1)], {BLOSUM_UNKNOWN})", (-10.0, -0.5)
_LOW = "-1e9"


def walk(pairs: str, score: str, gaps: tuple[float, float], path: bool) -> str:
    """Recursive query: pair (p), target (t), query (q), i, j, h, ph, n, m of all cells; ``pairs`` gives p, t, q."""
    opening, extend = gaps
    p = (lambda text: text) if path else (lambda text: "''")
    edge = f"({opening} + ({extend}) * (i - 1))"
    side = f"({opening} + ({extend}) * (j - 1))"
    return f"""
select p, t, q, length(t) as n, length(q) as m, 0 as i, 0 as j, 0.0::double as h, {_LOW}::double as e, {_LOW}::double as f, '' as ph, '' as pe, '' as pf, null::double as h0, '' as p0 from {pairs}
union all
select p, t, q, n, m, i, j, h, e, f, case when i = 0 then {p("repeat('I', j)")} when j = 0 then {p("repeat('D', i)")} when h = diagonal then {p("up0p || 'M'")} when h = f then pf else pe end as ph, pe, pf, h0, p0
from (
  select *, case when i = 0 then {side} when j = 0 then {edge} else greatest(diagonal, e, f) end as h
  from (
    select *, case when i = 0 or j = 0 then {_LOW} else greatest(lh + ({opening}), le + ({extend})) end as e, case when i = 0 then {_LOW} when j = 0 then {edge} else greatest(uh + ({opening}), uf + ({extend})) end as f,
      case when i = 0 or j = 0 then {_LOW} else up0 + {score} end as diagonal,
      case when i = 0 or j = 0 then '' when lh + ({opening}) >= le + ({extend}) then {p("lp || 'I'")} else {p("lpe || 'I'")} end as pe,
      case when i = 0 then '' when j = 0 then {p("repeat('D', i)")} when uh + ({opening}) >= uf + ({extend}) then {p("up || 'D'")} else {p("upf || 'D'")} end as pf
    from (
      select p, t, q, n, m, i + s as i, case when s = 1 then 0 else j + 1 end as j, case when s = 0 then h end as lh, case when s = 0 then e end as le, ph as lp, pe as lpe,
        case when s = 0 then uh end as uh, case when s = 0 then uf end as uf, up, upf, case when s = 0 then uh0 end as up0, up0p, case when s = 0 then h end as h0, ph as p0
      from (
        select *, lag(h) over x as uh, lag(f) over x as uf, lag(ph) over x as up, lag(pf) over x as upf, lag(h0) over x as uh0, lag(p0) over x as up0p,
          unnest(case when j = 0 and i < n then [0, 1] else [0] end) as s
        from walk window x as (partition by p order by i)) cell
      where s = 1 or j < m) step) gap) best"""


def star(score: str, gaps: tuple[float, float]) -> dict[str, str]:
    """CTEs from ``members`` (set_id, name, ord, seq and the safe form that is scored) to ``aligned`` (set_id, name, ord, seq, aligned)."""
    return {
        "big": "select set_id from members group by 1 having count(*) >= 2",
        "forms": "select set_id, safe, count(*) as many from members semi join big using (set_id) group by all",
        "duo": "select row_number() over () as p, a.set_id, a.safe as t, b.safe as q, a.many as nt, b.many as nq from forms a join forms b on a.set_id = b.set_id and a.safe <= b.safe",
        "scores": f"select p, h from (with recursive walk as ({walk('duo', score, gaps, False)}) select * from walk) w where i = n and j = m",
        "sums": "select set_id, safe, sum(x) as total from (select set_id, t as safe, h * (nq - case when t = q then 1 else 0 end) as x from duo join scores using (p) "
                "union all select set_id, q, h * nt from duo join scores using (p) where t <> q) y group by all",
        "centers": "select set_id, arg_max(seq, (total, -ord)) as center, arg_max(safe, (total, -ord)) as safe_center from members join sums using (set_id, safe) group by 1",
        "asked": "select row_number() over () as p, * from (select distinct set_id, seq, safe as q, center, safe_center as t from members join centers using (set_id)) y",
        "paths": f"select p, ph from (with recursive walk as ({walk('asked', score, gaps, True)}) select * from walk) w where i = n and j = m",
        "ops": "select p, o, op, count(*) filter (op <> 'I') over x as x, count(*) filter (op <> 'D') over x as y from (select p, unnest(string_split(ph, '')) as op, "
               "unnest(range(length(ph))) as o from paths where ph <> '') z window x as (partition by p order by o rows unbounded preceding)",
        "hits": "select p, x, y from ops where op = 'M'",
        # a letter without a partner stands before the next pair, after the target letters that stand alone
        "placed": "select a.p, a.seq, a.center, b.y, (select min(x) from hits h where h.p = a.p and h.y >= b.y) as x, exists (select 1 from hits h where h.p = a.p and h.y = b.y) as hit "
                  "from asked a, unnest(range(1, length(a.seq) + 1)) b(y)",
        "slots": "select p, case when x is null then length(any_value(center)) else x - 1 end as slot, string_agg(substr(seq, y, 1), '' order by y) filter (not hit) as ins, "
                 "max(substr(seq, y, 1)) filter (hit) as col from placed group by p, x",
        "widths": "select set_id, slot, max(length(ins)) as w from slots join asked using (p) where ins is not null group by all",
        "cells": "select a.set_id, a.seq, a.p, b.slot, rpad(coalesce(s.ins, ''), coalesce(w.w, 0)::int, '-') || case when b.slot < length(a.center) then coalesce(s.col, '-') else '' end as cell "
                 "from asked a cross join lateral unnest(range(0, length(a.center) + 1)) b(slot) left join slots s on s.p = a.p and s.slot = b.slot left join widths w on w.set_id = a.set_id and w.slot = b.slot",
        "aligned": "select m.set_id, m.name, m.ord, m.seq, r.aligned from members m join (select set_id, seq, string_agg(cell, '' order by slot) as aligned from cells group by set_id, seq, p) r using (set_id, seq)",
    }
