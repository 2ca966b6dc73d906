"""Methods A and D as recursive SQL, month by month, for a fixed threshold of 1: an implementation apart from the kernels'."""

from tideline.plans.base import SQL_WALK

LISTS = SQL_WALK + ", lists as (select series_id, list(value order by t) as ys, count(*) as n from walk group by 1)"
BREAKOUT = "list_sort(list_transform(range(start, t + 1), lambda s: struct_pack(low := -round(abs(y1 - ys[s + 1]), 9), s := s)))[1]"

LIVE_A = f"""with recursive {LISTS},
m(series_id, t, state, start, ext) as (
  select series_id, 0::bigint, 0, 0::bigint, 0::bigint from lists
  union all
  select series_id, t + 1,
    case when state = 0 then case when -b.low >= 1 - 1e-9::double then case when y1 > ys[b.s + 1] then 1 else -1 end else 0 end when ahead >= 0 then state when -ahead >= 1 - 1e-12::double then -state when t + 1 - ext >= 6 then 0 else state end,
    case when state = 0 then case when -b.low >= 1 - 1e-9::double then b.s else start end when ahead >= 0 then start when -ahead >= 1 - 1e-12::double then ext when t + 1 - ext >= 6 then ext else start end,
    case when state = 0 then case when -b.low >= 1 - 1e-9::double then t + 1 else ext end when ahead >= 0 then t + 1 when -ahead >= 1 - 1e-12::double then t + 1 else ext end
  from (select *, {BREAKOUT} as b from (select m.*, ys, ys[t + 2] as y1, state * (ys[t + 2] - ys[ext + 1]) as ahead from m join lists using (series_id) where t + 1 < n)))
select series_id, 'fixed1' as setting_id, 'A_rt' as method, t::int as t, state::int as label from m"""

LIVE_D = f"""with recursive {LISTS},
m(series_id, t, state, start, ext, rc, imp) as (
  select series_id, 0::bigint, 0, 0::bigint, 0::bigint, 0::bigint, 0::double from lists
  union all
  select series_id, t + 1,
    case what when 'out' then case when y1 > ys[b.s + 1] then 1 else -1 end when 'flip' then -state when 'leg' then -state when 'side' then 0 else state end,
    case what when 'out' then b.s when 'flip' then ext when 'leg' then ext when 'side' then ext else start end,
    case what when 'out' then t + 1 when 'new' then t + 1 when 'flip' then t + 1 when 'leg' then rc1 else ext end,
    case what when 'out' then t + 1 when 'new' then t + 1 when 'flip' then t + 1
      when 'leg' then list_sort(list_transform(range(rc1, t + 2), lambda k: struct_pack(low := -state * ys[k + 1], k := k)))[1].k when 'none' then rc when 'wait' then rc1 else rc1 end,
    case what when 'out' then ys[b.s + 1] when 'new' then case when state * (ys[ext + 1] - ys[rc + 1]) >= 0.5::double - 1e-12::double then ys[rc + 1] else imp end when 'flip' then ys[ext + 1] when 'leg' then ys[ext + 1] else imp end
  from (
    select *, case when state = 0 then case when -b.low >= 1 - 1e-9::double then 'out' else 'none' end when ahead >= 0 then 'new'
      when -ahead >= greatest(1, 0.618::double * state * (ys[ext + 1] - imp)) - 1e-12::double then 'flip'
      when t + 1 - ext >= 12 then case when state * (ys[ext + 1] - ys[rc1 + 1]) >= 1 - 1e-12::double then 'leg' else 'side' end else 'wait' end as what
    from (
      select *, {BREAKOUT} as b, case when state * (y1 - ys[rc + 1]) < 0 then t + 1 else rc end as rc1
      from (select m.*, ys, ys[t + 2] as y1, state * (ys[t + 2] - ys[ext + 1]) as ahead from m join lists using (series_id) where t + 1 < n))))
select series_id, 'fixed1' as setting_id, 'D_rt' as method, t::int as t, state::int as label from m"""


# ---- both machines under any settings, their ex-post segments, and what is read off them

#: Rounds of labelling and merging that are written out; each merges all equal neighbours, so a few settle a short series.
ROUNDS = 8
CAUSAL = "case when t between 1 and 24 then case when count(dy) over sofar >= 6 then stddev_samp(dy) over sofar end else {rolled} end"


def source(base: str, causal: bool = False) -> str:
    """src (series_id, t, value, sig) of the rows (series_id, t, value) that `base` selects."""
    rolled = "case when count(dy) over last36 >= 24 then stddev_samp(dy) over last36 else stddev_samp(dy) filter (where t between 1 and 24) over (partition by series_id) end"
    sig = CAUSAL.format(rolled=rolled) if causal else rolled
    return f"""
src0 as ({base}),
src1 as (select *, value - lag(value) over (partition by series_id order by t) as dy from src0),
src as (select series_id, t, value, {sig} as sig from src1
  window last36 as (partition by series_id order by t rows between 35 preceding and current row), sofar as (partition by series_id order by t))"""


def config(*rows: dict) -> str:
    values = ", ".join(f"('{r['setting_id']}', {r.get('thr', 1.0)}::double, {str(r.get('scaled', False)).lower()}, {r.get('z', 2.0)}::double, {r.get('min_len', 0)}, {r.get('cap', 12)})" for r in rows)
    return f"cfg as (select * from (values {values}) as v(setting_id, thr, scaled, z, min_len, cap))"


def req(a: str, b: str, sigma: str) -> str:
    return f"(case when scaled then greatest(thr, z * {sigma} * sqrt(least(greatest({b} - {a}, 1), cap)::double)) else thr end)"


def machine(legs: bool, m: str = "m") -> str:
    """ml (series_id, setting_id, lists) and m (series_id, setting_id, t, state, start, ext, rc, imp), month by month, from src and cfg."""
    at = lambda i: f"ys[{i} + 1]"
    need = lambda a, b: req(a, b, f"sg[least({b}, n - 1) + 1]")
    rho = "0.618::double" if legs else "0::double"
    leg = f"state * ({at('ext')} - {at('rc1')}) >= {need('ext', 'rc1')} - 1e-12::double and rc1 - ext >= min_len" if legs else "false"
    best = f"list_sort(list_transform(range(start, t + 2 - greatest(min_len, 1)), lambda s: struct_pack(low := -round(abs(y1 - ys[s + 1]) / {need('s', '(t + 1)')}, 9), s := s)))[1]"
    deepest = "list_sort(list_transform(range(rc1, t + 2), lambda k: struct_pack(low := -state * ys[k + 1], k := k)))[1].k"
    return f"""
{m}l as (select s.*, cfg.* from (select series_id, list(value order by t) as ys, list(sig order by t) as sg, count(*) as n from src group by 1) s cross join cfg),
{m}(series_id, setting_id, t, state, start, ext, rc, imp) as (
  select series_id, setting_id, 0::bigint, 0, 0::bigint, 0::bigint, 0::bigint, 0::double from {m}l
  union all
  select series_id, setting_id, t + 1,
    case what when 'out' then case when y1 > {at('b.s')} then 1 else -1 end when 'flip' then -state when 'leg' then -state when 'side' then 0 else state end,
    case what when 'out' then b.s when 'flip' then ext when 'leg' then ext when 'side' then ext else start end,
    case what when 'out' then t + 1 when 'new' then t + 1 when 'flip' then t + 1 when 'leg' then rc1 else ext end,
    case what when 'out' then t + 1 when 'new' then t + 1 when 'flip' then t + 1 when 'leg' then {deepest} when 'none' then rc else rc1 end,
    case what when 'out' then {at('b.s')} when 'new' then case when {str(legs).lower()} and state * ({at('ext')} - {at('rc')}) >= {need('ext', 'rc')} / 2 - 1e-12::double then {at('rc')} else imp end
      when 'flip' then {at('ext')} when 'leg' then {at('ext')} else imp end
  from (
    select *, case when state = 0 then case when -b.low >= 1 - 1e-9::double then 'out' else 'none' end when ahead >= 0 then 'new'
      when -ahead >= greatest({need('ext', '(t + 1)')}, {rho} * state * ({at('ext')} - imp)) - 1e-12::double and t + 1 - ext >= min_len then 'flip'
      when t + 1 - ext >= {12 if legs else 6} then case when {leg} then 'leg' else 'side' end else 'wait' end as what
    from (
      select *, {best} as b, case when state * (y1 - {at('rc')}) < 0 then t + 1 else rc end as rc1
      from (select {m}.*, ys, sg, n, thr, scaled, z, min_len, cap, ys[t + 2] as y1, state * (ys[t + 2] - {at('ext')}) as ahead from {m} join {m}l using (series_id, setting_id) where t + 1 < n))))"""


def _rounds(out: str, key: str, label: str, ends: str) -> str:
    """Labelling and merging of equal neighbours, again and again, from the segments {out}_0."""
    text = ""
    for k in range(ROUNDS):
        text += f""",
{out}_l{k} as (select s.* exclude (label, imp), {label} as label, abs(b.value - a.value) as size, coalesce(s.imp, abs(b.value - a.value)) as imp from {out}_{k} s {ends}),
{out}_i{k} as (select *, sum(new) over (partition by {key} order by start) as run from (select *, case when label is not distinct from lag(label) over (partition by {key} order by start) then 0 else 1 end as new from {out}_l{k})),
{out}_{k + 1} as (select {key}, min(start) as start, max("end") as "end", arg_min(confirm, start) as confirm, case when count(*) = 1 then any_value(imp) else arg_max(size, start) end as imp, any_value(label) as label from {out}_i{k} group by {key}, run)"""
    return text


def _ends(of: str = "s") -> tuple[str, str]:
    """(the rule's label of a segment, the joins that it needs)"""
    label = f"case when s.\"end\" - s.start < min_len then 0 when b.value - a.value >= {req('s.start', 's.\"end\"', 'b.sig')} - 1e-12::double then 1 when b.value - a.value <= -{req('s.start', 's.\"end\"', 'b.sig')} + 1e-12::double then -1 else 0 end"
    return label, 'join src a on a.series_id = s.series_id and a.t = s.start join src b on b.series_id = s.series_id and b.t = s."end" join cfg using (setting_id)'


def settled(m: str = "m", out: str = "seg", vintage: bool = False) -> str:
    """seg (key, seg_no, start, end, label, confirm, open, imp): the ex-post segments of a machine's months m. With `vintage`, for each month of vint (vintage) from the months up to it; it is part of the key."""
    key = "series_id, setting_id" + (", vintage" if vintage else "")
    rows = f"(select {m}.*, vintage from {m} join vint on t <= vintage)" if vintage else m
    label, ends = _ends()
    text = f"""
{out}_spell as (select {key}, start, min(t) as first, max(t) as last, arg_max(state, t) as label, min(case when state <> 0 then t end) as conf from {rows} group by {key}, start),
{out}_raw as (select *, lead(start) over w as nxt, lead(first) over w as closed_at, max(last) over (partition by {key}) as top from {out}_spell window w as (partition by {key} order by start)),
{out}_first as (select {key}, start, coalesce(nxt, top) as "end", label, case when nxt is null then case when label <> 0 then conf else top end when label = 0 then closed_at else conf end as confirm, nxt is null as is_open from {out}_raw),
{out}_bad as (select distinct {key} from (select s.*, {label} as should from {out}_first s {ends}) where not is_open and should <> label),
{out}_0 as (select {key}, start, "end", confirm, null::double as imp, 0 as label from {out}_first semi join {out}_bad using ({key}) where not is_open)"""
    text += _rounds(out, key, label, ends)
    return text + f""",
{out}_open as (select * from {out}_first semi join {out}_bad using ({key}) where is_open),
{out}_end as (select {key}, arg_max(label, start) as tail, max(start) as tail_start from {out}_{ROUNDS} group by {key}),
{out}_all as (
  select {key}, start, "end", label, confirm, case when is_open then true end as open, null::double as imp from {out}_first anti join {out}_bad using ({key})
  union all
  select {key}, c.start, case when e.tail = o.label and c.start = e.tail_start then o."end" else c."end" end, c.label, case when e.tail = o.label and c.start = e.tail_start then o.confirm else c.confirm end,
    case when e.tail = o.label and c.start = e.tail_start then true end, c.imp from {out}_{ROUNDS} c join {out}_open o using ({key}) join {out}_end e using ({key})
  union all
  select {key}, o.start, o."end", o.label, o.confirm, true, null from {out}_open o join {out}_end e using ({key}) where e.tail <> o.label),
{out} as (select {key}, (row_number() over (partition by {key} order by start) - 1)::int as seg_no, start::int as start, "end"::int as "end", label::int as label, confirm::int as confirm, open, imp from {out}_all)"""


def expanded(seg: str = "seg", out: str = "lab", vintage: bool = False) -> str:
    """lab (key, t, label) of segments: months after the start; month 0 has the first segment's."""
    key = "series_id, setting_id" + (", vintage" if vintage else "")
    return f"""
{out} as (select {key}, label, unnest(range(start + 1, "end" + 1))::int as t from {seg} where "end" > start union all select {key}, label, 0 from {seg} where seg_no = 0)"""


def walk_source() -> str:
    return SQL_WALK + "," + source("select series_id, t, value from walk")


def ex_post(legs: bool, *settings: dict) -> str:
    """All CTEs for the walk: src, cfg, m, seg, lab."""
    return f"recursive {walk_source()}, {config(*settings)}, {machine(legs)}, {settled()}, {expanded()}"


def segments_sql(legs: bool, *settings: dict) -> str:
    name = "D" if legs else "A"
    return f"with {ex_post(legs, *settings)} select series_id, setting_id, '{name}' as method, seg_no, start, \"end\", label, confirm, open, imp from seg"


def labels_sql(legs: bool, *settings: dict) -> str:
    name = "D" if legs else "A"
    return f"with {ex_post(legs, *settings)} select series_id, setting_id, '{name}' as method, t, label from lab union all select series_id, setting_id, '{name}_rt', t::int, state::int from m"


#: The machine after the last month, and the levels at which next month would change it.
FIN = """
fin as (select series_id, setting_id, state::int as state, ext::int as ext, start::int as seg_start, imp as imp_top from (select *, max(t) over (partition by series_id, setting_id) as top from m) where t = top)"""


def triggers_sql(*settings: dict) -> str:
    return f"""with {ex_post(True, *settings)}, {FIN},
x as (select src.*, fin.* exclude (series_id), cfg.* exclude (setting_id), count(*) over w as n, last_value(sig) over (partition by series_id, setting_id order by t rows between unbounded preceding and unbounded following) as sig_n
  from fin join src using (series_id) join cfg using (setting_id) window w as (partition by series_id, setting_id)),
y as (select *, {req('t', 'n', 'sig_n')} as need, greatest({req('ext', 'n', 'sig_n')}, 0.618::double * state * (value - imp_top)) as back, state = 0 and t >= seg_start and t <= n - greatest(min_len, 1) as starts from x)
select series_id, setting_id, state, seg_start, min(value) filter (where t >= seg_start) as low, max(value) filter (where t >= seg_start) as high,
  round(min(value + need) filter (where starts), 6) as up_trigger, round(max(value - need) filter (where starts), 6) as down_trigger, round(max(value - state * back) filter (where t = ext and state <> 0), 6) as flip_level from y group by 1, 2, 3, 4"""


def flagship_sql(*settings: dict) -> str:
    return f"""with {ex_post(True, *settings)}, ends as (select *, max(seg_no) over (partition by series_id) as top from seg),
g as (select s.*, a.month as start_date, b.month as end_date, a.value as y0, b.value as y1, v.sig from ends s join walk a on a.series_id = s.series_id and a.t = s.start join walk b on b.series_id = s.series_id and b.t = s."end" join src v on v.series_id = s.series_id and v.t = s."end" where seg_no = top)
select series_id, label, start_date, end_date, ("end" - start)::int as months, y0, y1, round_even((y1 - y0) * 100, 0)::bigint as chg_bp, round(abs(y1 - y0) / nullif(sig * sqrt(greatest("end" - start, 1)::double), 0), 6) as score, 100::bigint as req_bp from g"""


#: First and last evaluated month of each series (e0, e1), for method D under one setting.
def bounds_sql(start: str, name: str = "bnd") -> str:
    return f"""
{name} as (
  select w.series_id, coalesce(min(t) filter (where month >= date '{start}'), max(t) + 1)::int as e0, least(any_value(last_start) - 1, max(t))::int as e1
  from walk w join (select series_id, case when count(*) > 1 then max(start) + 1 else max("end") + 1 end as last_start from seg group by 1) using (series_id) group by 1)"""


# ---- the optimal piecewise-linear fit


def _sse(i: str, j: str) -> str:
    """Squared error of the line through months i to j - 1, from lists of running sums that begin with 0."""
    d = lambda c: f"({c}[{j} + 1] - {c}[{i} + 1])"
    m = f"({j} - {i})::double"
    vx, cxy = f"({d('sxx')} - {d('sx')} * {d('sx')} / {m})", f"({d('sxy')} - {d('sx')} * {d('sy')} / {m})"
    return f"greatest({d('syy')} - {d('sy')} * {d('sy')} / {m} - case when {vx} > 0 then {cxy} * {cxy} / {vx} else 0 end, 0)"


def _slope(i: str, j: str) -> str:
    d = lambda c: f"({c}[{j} + 1] - {c}[{i} + 1])"
    m = f"({j} - {i})::double"
    vx, cxy = f"({d('sxx')} - {d('sx')} * {d('sx')} / {m})", f"({d('sxy')} - {d('sx')} * {d('sy')} / {m})"
    return f"case when {vx} > 0 then {cxy} / {vx} else 0 end"


def pieces(least: int = 6) -> str:
    """back (series_id, setting_id, i, j): pieces of the walk under each setting of cfg, by a dynamic program that looks at every start, month by month, and the way back; held has the running sums."""
    running = ", ".join(f"sum({e}) over w as {c}" for c, e in (("sx", "t::double"), ("sxx", "t::double * t"), ("sy", "value"), ("sxy", "t * value"), ("syy", "value * value")))
    lists = ", ".join(f"list_prepend(0::double, list({c} order by t)) as {c}" for c in ("sx", "sxx", "sy", "sxy", "syy"))
    return f"""
cums as (select series_id, t, {running} from walk window w as (partition by series_id order by t)),
costs as (select series_id, setting_id, base * thr * thr as cost from (select series_id, 2.6::double * var_pop(dy) / 2 * ln(count(*) + 1) as base from (select series_id, value - lag(value) over (partition by series_id order by t) as dy from walk) where dy is not null group by 1) cross join cfg),
held as (select series_id, count(*) as n, {lists} from cums group by 1),
dp(series_id, setting_id, j, f, prev) as (
  select series_id, setting_id, {least - 1}::bigint, [-cost] || list_transform(range({least - 1}), lambda x: null::double), list_transform(range({least}), lambda x: null::bigint) from costs
  union all
  select series_id, setting_id, j, list_append(f, best.v), list_append(prev, best.i) from (
    select dp.series_id, dp.setting_id, dp.j + 1 as j, f, prev,
      list_sort(list_transform(list_filter(range(0, dp.j + 2 - {least}), lambda i: f[i + 1] is not null), lambda i: struct_pack(v := f[i + 1] + {_sse('i', '(dp.j + 1)')} + cost, i := i)))[1] as best
    from dp join held using (series_id) join costs using (series_id, setting_id) where dp.j < n)),
done as (select series_id, setting_id, prev, n from dp join held using (series_id) where j = n),
back(series_id, setting_id, i, j) as (
  select series_id, setting_id, prev[n + 1], n from done
  union all
  select back.series_id, back.setting_id, done.prev[back.i + 1], back.i from back join done using (series_id, setting_id) where back.i > 0)"""


def pieces_sql(*settings: dict) -> str:
    return f"""with recursive {walk_source()}, {config(*settings)}, {pieces()}
select series_id, setting_id, (row_number() over (partition by series_id, setting_id order by i) - 1)::int as piece_no, i::int as start, (j - 1)::int as "end", round({_slope('i', 'j')}, 6) as slope from back join held using (series_id)"""


def piecewise(reach: int = 6) -> str:
    """pw (series_id, setting_id, seg_no, start, end, label, confirm, open, imp): segments between the pieces' ends, moved in turn to the highest or lowest month near, labelled and merged."""
    label, ends = _ends()
    return f"""{pieces()},
joints as (select series_id, setting_id, list(j - 1 order by i) as e, list(slope order by i) as sl, count(*) as m from (select back.*, {_slope('i', 'j')} as slope from back join held using (series_id)) group by 1, 2),
turned as (select joints.*, ys, n from joints join (select series_id, list(value order by t) as ys, count(*) as n from src group by 1) using (series_id)),
snap(series_id, setting_id, k, pos) as (
  select series_id, setting_id, 0::bigint, 0::bigint from turned
  union all
  select series_id, setting_id, k, case when lo < hi and kind <> 0 then list_sort(list_transform(range(lo, hi + 1), lambda x: struct_pack(low := -kind * ys[x + 1], x := x)))[1].x else b end
  from (
    select *, greatest(pos + 1, b - {reach}) as lo, least(nxt - 1, b + {reach}) as hi from (
      select snap.series_id, snap.setting_id, snap.k + 1 as k, pos, ys, e[snap.k + 1] as b, case when snap.k + 1 < m - 1 then e[snap.k + 2] else n - 1 end as nxt,
        case when sl[snap.k + 1] > 0 and sl[snap.k + 2] <= 0 then 1 when sl[snap.k + 1] < 0 and sl[snap.k + 2] >= 0 then -1 else 0 end as kind
      from snap join turned using (series_id, setting_id) where snap.k + 1 < m))),
edges as (select series_id, setting_id, k, pos from snap union all select series_id, setting_id, m, n - 1 from turned),
pw_0 as (select * from (select series_id, setting_id, pos as start, lead(pos) over (partition by series_id, setting_id order by k) as "end", null::bigint as confirm, null::double as imp, 0 as label from edges) where "end" is not null){_rounds('pw', 'series_id, setting_id', label, ends)},
pw as (select series_id, setting_id, (row_number() over (partition by series_id, setting_id order by start) - 1)::int as seg_no, start::int as start, "end"::int as "end", label::int as label, confirm::int as confirm, null::boolean as open, imp from pw_{ROUNDS})"""


def piecewise_sql(*settings: dict, labels: bool = False) -> str:
    base = f"with recursive {walk_source()}, {config(*settings)}, {piecewise()}"
    if labels:
        return f"{base}, {expanded('pw')} select series_id, setting_id, 'B' as method, t, label from lab"
    return f"{base} select series_id, setting_id, 'B' as method, seg_no, start, \"end\", label, confirm, open, imp from pw"


# ---- the forward filter of a Markov model whose parameters are those of labelled months

FILTER_SQL = """
steps as (select series_id, t, label + 2 as s, lag(label + 2) over w as p, value - lag(value) over w as z from c1 window w as (partition by series_id order by t)),
moments as (select series_id, s, avg(z) as mu, var_samp(z) + 1e-4::double as va from steps where z is not null group by 1, 2),
params as (select series_id, list(mu order by s) as mu, list(va order by s) as va from moments group by 1),
counts as (select series_id, a, b, (select count(*) from steps where steps.series_id = g.series_id and z is not null and t >= 2 and p = a and s = b) + 1 as n from (select distinct series_id from c1) g cross join (select unnest([1, 2, 3]) as a) cross join (select unnest([1, 2, 3]) as b)),
shares as (select *, n / sum(n) over (partition by series_id, a) as share from counts),
moves as (select series_id, list(share order by a) as into_all, b from shares group by 1, 3),
trans as (select series_id, list(into_all order by b) as goes from moves group by 1),
firsts as (select series_id, list(n / 15.0::double order by s) as first from (select g.series_id, s, (select count(*) from steps where steps.series_id = g.series_id and t between 1 and 12 and steps.s = u.s) + 1 as n from (select distinct series_id from c1) g cross join (select unnest([1, 2, 3]) as s) u) group by 1),
obs as (select series_id, list(z order by t) as zs, count(*) as n from steps where z is not null group by 1),
allp as (select * from params join trans using (series_id) join firsts using (series_id) join obs using (series_id)),
fw(series_id, k, now) as (
  select series_id, 0::bigint, list_transform(raw, lambda v: v / list_sum(raw)) from (
    select series_id, list_transform([1, 2, 3], lambda s: first[s] * exp(-0.5::double * power(zs[1] - mu[s], 2) / va[s]) / sqrt(va[s])) as raw from allp)
  union all
  select series_id, k, list_transform(raw, lambda v: v / list_sum(raw)) from (
    select fw.series_id, fw.k + 1 as k, list_transform([1, 2, 3], lambda s: list_sum(list_transform([1, 2, 3], lambda i: now[i] * goes[s][i])) * exp(-0.5::double * power(zs[fw.k + 2] - mu[s], 2) / va[s]) / sqrt(va[s])) as raw
    from fw join allp using (series_id) where fw.k + 1 < n))"""
