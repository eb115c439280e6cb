"""SQL twins of the registered queries, written from the formulas."""

from __future__ import annotations

from mixspark import queries as q
from mixspark.operators.mixture import OVERSAMPLING, TURN
from mixspark.operators.sample import mixture_target
from mixspark.plans.search import SEARCH_RATIO

S = q.SEED
TWO52 = "4503599627370496.0"


def u(*parts) -> str:
    """U[0,1) of the parts; strings starting with a column name are SQL, numbers are literals."""
    text = ", ".join(p if isinstance(p, str) else f"'{p}'" for p in parts)
    return f"(cast('0x' || substr(md5(concat_ws('|', {text})), 1, 13) as bigint) / {TWO52})"


def normal(*parts) -> str:
    return (f"(sqrt(-2.0 * ln(1.0 - {u(*parts, quote('r'))})) "
            f"* cos(2.0 * pi() * {u(*parts, quote('a'))}))")


def quote(s) -> str:
    return f"'{s}'"


def hit(draw: str, p: str) -> str:
    return f"greatest(1, cast(ceil(ln(1.0 - {draw}) / ln(1.0 - {p})) as bigint))"


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def index(table: str, col: str) -> str:
    return (f"(select v, cast(row_number() over (order by v) - 1 as integer) as i from "
            f"(select distinct {col} as v from {table}))")


# ---- views -----------------------------------------------------------------------------------

EVENTS = f"""ev as (
  select cast(event_id as varchar) as key, t.i as c0, cast(hour(ts) as integer) as c1, value as x0
  from events join {index('events', 'event_type')} t on event_type = t.v),
pr as (select max(c0) + 1 as w0, max(c1) + 1 as w1, min(x0) as lo0, max(x0) as hi0,
  count(*) as n from ev),
enc as (select key, c0, c1, x0, (x0 - lo0) / ((hi0 - lo0) + 1e-13) as n0, c0 as s0, w0 + c1 as s1,
  w0 + w1 as D, n from ev, pr)"""

ORDERS = f"""orr as (
  select cast(o_orderkey as varchar) as key, s.i as c0, p.i as c1, o_totalprice as x0,
    cast(year(o_orderdate) as double) as x1, o_orderkey
  from orders join {index('orders', 'o_orderstatus')} s on o_orderstatus = s.v
  join {index('orders', 'o_orderpriority')} p on o_orderpriority = p.v),
pr as (select max(c0) + 1 as w0, max(c1) + 1 as w1, min(x0) as lo0, max(x0) as hi0,
  min(x1) as lo1, max(x1) as hi1, count(*) as n from orr),
enc as (select key, c0, c1, x0, x1, (x0 - lo0) / ((hi0 - lo0) + 1e-13) as n0,
  (x1 - lo1) / ((hi1 - lo1) + 1e-13) as n1, c0 as s0, w0 + c1 as s1, w0 + w1 as D from orr, pr)"""

DOCS = """dl as (select documents.doc_id, lang, source, n_chars, toxic
  from documents join labels using (doc_id)),
li as (select v, cast(row_number() over (order by v) - 1 as integer) as i
  from (select distinct lang as v from dl)),
si as (select v, cast(row_number() over (order by v) - 1 as integer) as i
  from (select distinct source as v from dl)),
dv as (select cast(doc_id as varchar) as key, li.i as c0, si.i as c1,
    cast(n_chars as double) as x0, ln(1 + n_chars) as x1, cast(toxic = 1 as integer) as label
  from dl join li on lang = li.v join si on source = si.v),
pr as (select max(c0) + 1 as w0, max(c1) + 1 as w1, min(x0) as lo0, max(x0) as hi0,
  min(x1) as lo1, max(x1) as hi1, count(*) as n from dv),
enc as (select key, c0, c1, x0, x1, label, (x0 - lo0) / ((hi0 - lo0) + 1e-13) as n0,
  (x1 - lo1) / ((hi1 - lo1) + 1e-13) as n1, c0 as s0, w0 + c1 as s1, w0 + w1 as D from dv, pr)"""

SLOTS = "slots as (select cast(unnest(generate_series(0, (select max(D) from enc) - 1)) as integer) as slot)"


def weights(d: int, seed=S) -> str:
    return f"""w as (select cast(i as integer) as idx, {u('i', quote('w'), seed)} - 0.5 as w
  from (select unnest(generate_series(0, {d} + (select max(D) from enc) - 1)) as i))"""


def cat_score(d: int, seed=S) -> str:
    """CTEs ending in `cat(key, score_cat)`: the log of each slot's sigmoid, summed."""
    base = " + ".join(f"n{j} * (select w from w where idx = {j})" for j in range(d))
    return f"""{SLOTS}, {weights(d, seed)},
base as (select key, s0, s1, {base} as b from enc),
cat as (select key, sum(-ln(1.0 + exp(-(case when slot = s0 or slot = s1 then 1.0 else -1.0 end)
    * (b + w.w)))) as score_cat
  from base cross join slots join w on w.idx = slot + {d} group by key)"""


def pdf1(x: str) -> str:
    m = q.EVENT_MIXTURE
    return " + ".join(
        f"exp(-0.5 * ({x} - {mu[0]}) * ({x} - {mu[0]}) / {v[0][0]}) / sqrt(2.0 * pi() * {v[0][0]})"
        for mu, v in zip(m.mu, m.sigma))


def pdf2_parts(x: str, y: str) -> list[str]:
    out = []
    for mu, v in zip(q.PAIR_MIXTURE.mu, q.PAIR_MIXTURE.sigma):
        a, b, c = v[0][0], v[0][1], v[1][1]
        det = a * c - b * b
        dx, dy = f"({x} - {mu[0]})", f"({y} - {mu[1]})"
        quad = f"(({c!r} * {dx} * {dx} - {2 * b!r} * {dx} * {dy} + {a!r} * {dy} * {dy}) / {det!r})"
        out.append(f"exp(-0.5 * {quad}) / (2.0 * pi() * sqrt({det!r}))".replace("np.float64", ""))
    return out


def pdf2(x: str, y: str) -> str:
    return " + ".join(pdf2_parts(x, y))


EVENT_SCORES = f"""with {EVENTS}, {cat_score(1)},
sc as (select enc.key, c0, c1, x0, score_cat, ln({pdf1('n0')}) as score_num,
  score_cat + ln({pdf1('n0')}) as score from enc join cat using (key))"""


def doc_scores(seed=S, name="sc", prefix="") -> str:
    return f"""{cat_score(2, seed)},
{name} as (select enc.key, label, score_cat + ln({pdf2('n0', 'n1')}) as score
  from enc join cat using (key))"""


def auroc_sql(source: str, by: str = "", extra: str = "") -> str:
    g = f"{by}, " if by else ""
    over = f"partition by {by} order by score" if by else "order by score"
    return f"""ties as (select {g}score, sum(p) as p, sum(1 - p) as q from {source} group by {g}score),
cum as (select {g}p, q, sum(q) over ({over}) - q as below from ties)
select {g}case when sum(p) > 0 and sum(q) > 0 then
    {r6('sum(p * (below + q / 2.0)) / (sum(p)::double * sum(q))')} end as auroc,
  cast(sum(p) as bigint) as n_pos, cast(sum(q) as bigint) as n_neg
from cum {'group by ' + by if by else ''}"""


# ---- profile and encoding --------------------------------------------------------------------

ORACLE: dict[str, str] = {}

ORACLE["profile_minmax"] = f"""with li as (
  select f.i as c0, s.i as c1, l_linenumber - 1 as c2, l_quantity as x0, l_extendedprice as x1,
    l_discount as x2, l_tax as x3
  from lineitem join {index('lineitem', 'l_returnflag')} f on l_returnflag = f.v
  join {index('lineitem', 'l_linestatus')} s on l_linestatus = s.v)
""" + " union all ".join(
    f"select '{kind}' as kind, cast({pos} as integer) as pos, cast(min({c}) as double) as lo, "
    f"cast(max({c}) as double) as hi, count(*) as n from li"
    for kind, pos, c in [("cat", 0, "c0"), ("cat", 1, "c1"), ("cat", 2, "c2"), ("num", 0, "x0"),
                         ("num", 1, "x1"), ("num", 2, "x2"), ("num", 3, "x3")])

ORACLE["category_index"] = """
select o_orderkey, cast(dense_rank() over (order by o_orderstatus) - 1 as integer) as o_orderstatus_idx,
  cast(dense_rank() over (order by o_orderpriority) - 1 as integer) as o_orderpriority_idx
from orders"""

ORACLE["category_index_large"] = """
select c_custkey, cast(dense_rank() over (order by c_name) - 1 as integer) as c_name_idx
from customer"""

ORACLE["scale_minmax"] = f"""with {ORDERS}
select key, cast(0 as integer) as pos, {r6('n0')} as x from enc
union all select key, cast(1 as integer), {r6('n1')} from enc"""

ORACLE["unscaled_view"] = f"""with {ORDERS}
select key, cast(0 as integer) as pos, x0 as x from enc
union all select key, cast(1 as integer), x1 from enc"""

ORACLE["loose_widths"] = f"""with {ORDERS},
m as (select 0 as pos, w0 - 1 as m from pr union all select 1, w1 - 1 from pr)
select cast(pos as integer) as pos, cast(m + 1 as integer) as width,
  cast(case when m > 1 then m + 1 else 1 end as integer) as stored,
  cast(case when m > 1 then m + 2 else 2 end as integer) as loose_width from m"""

ORACLE["discrete_combinations"] = f"""with {ORDERS}
select cast(w0 * w1 as double) as combinations, cast(w0 + w1 as integer) as slots,
  4.0::double as indicator_combinations, (select count(*) from labels) as n_labels from pr"""

ORACLE["onehot_slots"] = f"""with {EVENTS}, {SLOTS}
select key, slot, case when slot = s0 or slot = s1 then 1.0::double else 0.0::double end as bit
from enc cross join slots"""

ORACLE["indicator_passthrough"] = """
select cast(doc_id as varchar) as key, cast(0 as integer) as slot, cast(quality as double) as bit
from labels
union all select cast(doc_id as varchar), cast(1 as integer), cast(toxic as double) from labels"""

ORACLE["bias_slot"] = f"""with {EVENTS}
select key, cast(D + 1 as integer) as size, 1.0::double as bias, 3.0::double as ones from enc"""

ORACLE["set_category"] = f"""with {ORDERS}
select key, cast((c0 + 1) % 3 as integer) as c0, c1 from enc"""

ORACLE["row_text"] = f"""with {ORDERS}, t as (
  select *, '(' || printf('%.6f', n0) || ', ' || printf('%.6f', n1) || ')' as nt,
    cast(floor({u('key', quote('text'), S)} * D) as integer) as slot from enc)
select key, case when c0 = 0 then 'ANOMALY - ' else '' end || 'C:' || nt || '##D:(' ||
    printf('%.6f', c0::double) || ', ' || printf('%.6f', c1::double) || ')' as row_text,
  'C:' || nt || '##M:(' || (select string_agg(printf('%.6f', (i = slot)::integer::double), ', '
      order by i) from (select unnest(generate_series(0, t.D - 1)) as i)) || ')##L:' ||
    case when slot = s0 or slot = s1 then '1.0' else '0.0' end as masked_text
from t"""

ORACLE["masked_all"] = f"""with {EVENTS}, {SLOTS}
select key, slot, cast(slot = s0 or slot = s1 as integer) as bit,
  case when slot = s0 or slot = s1 then 1 else -1 end as z from enc cross join slots"""

MASKED = f"""mk as (select *, cast(floor({u('key', quote('mask'), S)} * D) as integer) as slot
  from enc)"""

ORACLE["masked_random"] = f"""with {EVENTS}, {MASKED}
select key, slot, cast(slot = s0 or slot = s1 as integer) as bit,
  case when slot = s0 or slot = s1 then 1 else -1 end as z from mk"""

# ---- sampling --------------------------------------------------------------------------------

ORACLE["normal_rows"] = f"""with {DOCS} select key, label from enc where label = 0"""

ORACLE["minibatch_sample"] = f"""with {EVENTS}
select key from enc where {u('key', quote('batch'), S, 0)} < least(1.0, 100.0 / n)"""

ORACLE["mixture_sample"] = f"""with {EVENTS}
select key from enc where {u('key', quote('sample'), S)}
  < least(1.0, 4 * (ln(0.5) / ln(1.0 - {q.RATIO})) * 10 / n)"""


def draws(steps: int, minibatch: int) -> str:
    """CTE `dr(key, it)`: independent draws per step, given the first one."""
    f = f"least(1.0, {minibatch}.0 / n)"
    first = hit(u("key", quote("mb"), S, quote("first")), f)
    return f"""fs as (select *, {first} as first, {f} as f from enc),
dr as (select fs.*, cast(it as integer) as it from fs, generate_series(1, {steps}) g(it)
  where it = first or (it > first and {u('key', quote('mb'), S, 0, 'it')} < f))"""


ORACLE["training_draws"] = f"""with {EVENTS}, {draws(20, 100)} select key, it from dr"""

# ---- slot model ------------------------------------------------------------------------------

NAMES = """nm as (select 0 as idx, 'num' as kind, 'num0' as name
  union all select 1 + i, 'slot', 'cat0=' || i from (select unnest(generate_series(0, (select max(w0) from pr) - 1)) as i)
  union all select 1 + (select max(w0) from pr) + i, 'slot', 'cat1=' || i
    from (select unnest(generate_series(0, (select max(w1) from pr) - 1)) as i))"""

ORACLE["init_weights"] = f"""with {EVENTS}, {weights(1)}, {NAMES}
select w.idx, kind, name, w.w from w join nm on w.idx = nm.idx"""

ORACLE["lr_schedule"] = f"""
select cast(i as integer) as i, {r6('1.0 / (1.0 + 0.1 * (i - 1))')} as lr
from (select unnest(generate_series(1, (select cast(ceil(count(*) / 100.0) as bigint) from events))) as i)"""


def gradient(masked: str, d: int = 1) -> str:
    """CTE `gr(idx, grad, n)` from a source with n0, slot and z."""
    return f"""pl as (select slot, n0, -z / (1.0 + exp(z * (n0 * (select w from w where idx = 0) + w.w))) as g
  from {masked} join w on w.idx = slot + 1),
gr as (select cast(slot + 1 as integer) as idx, sum(g) / (select count(*) from pl) as grad,
    (select count(*) from pl) as n from pl group by slot
  union all select 0, sum(g * n0) / count(*), count(*) from pl)"""


ALL_SLOTS = f"""{SLOTS}, al as (select n0, slot,
  case when slot = s0 or slot = s1 then 1.0 else -1.0 end as z from enc cross join slots)"""

ORACLE["gradient_step"] = f"""with {EVENTS}, {MASKED}, ms as (select n0, slot,
  case when slot = s0 or slot = s1 then 1.0 else -1.0 end as z from mk), {weights(1)}, {gradient('ms')}
select idx, {r6('grad')} as grad, n from gr"""

ORACLE["gradient_full"] = f"""with {EVENTS}, {ALL_SLOTS}, {weights(1)}, {gradient('al')}
select idx, {r6('grad')} as grad, n from gr"""

ORACLE["weight_update"] = f"""with {EVENTS}, {ALL_SLOTS}, {weights(1)}, {gradient('al')}, {NAMES}
select w.idx, name, {r6('w.w')} as w,
  {r6('w.w - 1.0 * (grad + 2.0 * 1.0 / sqrt((select count(*) from w)) * w.w)')} as w_new
from w join gr on w.idx = gr.idx join nm on w.idx = nm.idx"""


def sgd(steps: int) -> str:
    """CTEs g1..gn (gradients) and w1..wn (weights after each step)."""
    parts = [draws(steps, 200), f"""sm as (select it, n0,
    cast(floor({u('key', quote('slot'), S, 0, 'it')} * D) as integer) as slot, s0, s1 from dr),
mz as (select it, n0, slot, case when slot = s0 or slot = s1 then 1.0 else -1.0 end as z from sm)""",
             weights(1).replace("w as", "w0 as", 1).replace("as w\n", "as w\n", 1)]
    for t in range(1, steps + 1):
        lr = 1.0 / (1.0 + 0.1 * (t - 1))
        parts.append(f"""p{t} as (select slot, n0, -z / (1.0 + exp(z * (n0 *
    (select w from w{t - 1} where idx = 0) + v.w))) as g
  from mz join w{t - 1} v on v.idx = slot + 1 where it = {t}),
g{t} as (select v.idx, coalesce(case when v.idx = 0 then (select sum(g * n0) from p{t})
    else (select sum(g) from p{t} where slot + 1 = v.idx) end, 0.0) / (select count(*) from p{t}) as grad
  from w{t - 1} v),
w{t} as (select v.idx, v.w - {lr!r} * (grad + 2.0 / sqrt((select count(*) from w0)) * v.w) as w
  from w{t - 1} v join g{t} on v.idx = g{t}.idx)""")
    return ",\n".join(parts)


ORACLE["sgd_history"] = f"""with {EVENTS}, {sgd(3)}
""" + " union all ".join(
    f"select cast({t} as integer) as iter, {r6(repr(1.0 / (1.0 + 0.1 * (t - 1))))} as lr, "
    f"{r6(f'(select sum(abs(grad)) from g{t})')} as grad_l1, (select count(*) from p{t}) as n, "
    f"false as converged" for t in (1, 2, 3))

ORACLE["sgd_weights"] = f"""with {EVENTS}, {sgd(3)}, {NAMES}
select w3.idx, name, {r6('w3.w')} as w from w3 join nm on w3.idx = nm.idx"""

# ---- mixture ---------------------------------------------------------------------------------

DISTANCES = " union all ".join(
    f"select key, n0, n1, {i} as comp, (n0 - {c[0]}) * (n0 - {c[0]}) + (n1 - {c[1]}) * (n1 - {c[1]}) as dist, "
    f"{c[0]} as m0, {c[1]} as m1 from enc" for i, c in enumerate(q.CENTRES))
NEAREST = f"""ds as ({DISTANCES}),
nr as (select * from ds qualify row_number() over (partition by key order by dist, comp) = 1)"""

ORACLE["kmeans_assign"] = f"""with {ORDERS}, {NEAREST}
select key, cast(comp as integer) as comp, {r6('dist')} as dist from nr"""

DEVIATION = """dv as (select comp, count(*) as n, sqrt(avg((n0 - m0) * (n0 - m0))) as d0,
  sqrt(avg((n1 - m1) * (n1 - m1))) as d1, sqrt(sum((n0 - m0) * (n0 - m0))) / count(*) as e0,
  sqrt(sum((n1 - m1) * (n1 - m1))) / count(*) as e1, any_value(m0) as m0, any_value(m1) as m1 from nr group by comp)"""

ORACLE["cluster_deviation"] = f"""with {ORDERS}, {NEAREST}, {DEVIATION}
select cast(comp as integer) as comp, n, cast(0 as integer) as dim, {r6('d0')} as dev, round(e0, 9) as summed from dv
union all select cast(comp as integer), n, cast(1 as integer), {r6('d1')}, round(e1, 9) from dv"""

ORACLE["initial_mixture"] = f"""with {ORDERS}, {NEAREST}, {DEVIATION},
iv as (select cast(row_number() over (order by comp) - 1 as integer) as comp, m0, m1, d0, d1, e0, e1,
  {r6('1.0 / (select count(*) from dv)')} as weight from dv)
select comp, weight, cast(0 as integer) as dim, m0::double as mu, {r6('d0')} as variance,
  round(e0, 9) as variance_summed from iv
union all select comp, weight, cast(1 as integer), m1::double, {r6('d1')}, round(e1, 9) from iv"""


def kmeans(k: int, turns: int, updates: int) -> str:
    """CTEs ending in `c{updates}(comp, m0, m1)`: start by oversampling, then mean updates."""
    draw = u("key", quote("start"), S, 0)
    parts = [f"""us as materialized (select key, n0, n1, {draw} as u from enc),
cand0 as materialized (select 0 as i, n0 as m0, n1 as m1 from us order by u, n0, n1 limit 1)"""]

    def near(name, centres, i):
        return f"""{name} as materialized (select key, any_value(us.n0) as n0, any_value(us.n1) as n1, any_value(u) as u,
    min(struct_pack(d2 := (us.n0 - m0) * (us.n0 - m0) + (us.n1 - m1) * (us.n1 - m1), i := {i})) as best
  from us cross join {centres} group by key)"""
    for t in range(1, turns + 1):
        parts.append(f"""{near(f'nr{t}', f'cand{t - 1}', 'i')},
hit{t} as (select n0, n1, (u + {t} * {TURN!r}) % 1.0 as turn from nr{t}
  where (u + {t} * {TURN!r}) % 1.0 < {2 * k} * best.d2 / (select sum(best.d2) from nr{t})),
cand{t} as materialized (select * from cand{t - 1} union all
  select (select count(*) from cand{t - 1}) + row_number() over (order by turn, n0, n1) - 1, n0, n1 from hit{t})""")
    parts.append(f"""{near('heavy', f'cand{turns}', 'i')},
wt as materialized (select c.i, m0, m1, (select count(*) from heavy where best.i = c.i) as w from cand{turns} c),
pick1 as materialized (select 0 as comp, m0, m1 from wt order by w desc, i limit 1)""")
    for c in range(2, k + 1):
        parts.append(f"""gain{c} as (select any_value(wt.m0) as m0, any_value(wt.m1) as m1, wt.i, any_value(w) *
    min((wt.m0 - p.m0) * (wt.m0 - p.m0) + (wt.m1 - p.m1) * (wt.m1 - p.m1)) as gain
  from wt cross join pick{c - 1} p group by wt.i),
pick{c} as materialized (select * from pick{c - 1} union all
  (select {c - 1}, m0, m1 from gain{c} where gain > 0 order by gain desc, i limit 1))""")
    parts.append(f"c0 as (select * from pick{k})")
    for t in range(1, updates + 1):
        parts.append(f"""{near(f'at{t}', f'c{t - 1}', 'comp')},
c{t} as materialized (select comp, coalesce((select avg(n0) from at{t} where best.i = comp), m0) as m0,
  coalesce((select avg(n1) from at{t} where best.i = comp), m1) as m1 from c{t - 1})""")
    return ",\n".join(parts)


ORACLE["kmeans_small"] = f"""with {ORDERS}, {kmeans(3, OVERSAMPLING, 3)}
select cast(comp as integer) as comp, cast(0 as integer) as dim, {r6('m0')} as x from c3
union all select cast(comp as integer), cast(1 as integer), {r6('m1')} from c3"""

EM = ", ".join(f"2.220446049250313e-16 + {w} * ({p}) as p{i}" for i, (w, p) in
               enumerate(zip(q.PAIR_MIXTURE.weights, pdf2_parts("n0", "n1"))))
ORACLE["em_step"] = f"""with {ORDERS}, ep as (select n0, n1, {EM} from enc),
er as (""" + " union all ".join(
    f"select {i} as comp, n0, n1, p{i} / (p0 + p1 + p2) as r, ln(p0 + p1 + p2) as l from ep"
    for i in range(3)) + f""")
select cast(comp as integer) as comp, {r6('sum(r) / count(*)')} as weight,
  {r6('sum(r * n0) / sum(r)')} as mu0, {r6('sum(r * n1) / sum(r)')} as mu1,
  {r6('sum(r * n0 * n0) / sum(r) - (sum(r * n0) / sum(r)) * (sum(r * n0) / sum(r))')} as s00,
  {r6('sum(r * n0 * n1) / sum(r) - (sum(r * n0) / sum(r)) * (sum(r * n1) / sum(r))')} as s01,
  {r6('sum(r * n1 * n1) / sum(r) - (sum(r * n1) / sum(r)) * (sum(r * n1) / sum(r))')} as s11,
  round(sum(l), 4) as loglik
from er group by comp"""



def em_iterations(n: int) -> str:
    """CTEs `m0..mn`: mixtures of two numerics, and `e1..en`: the rows' responsibilities."""
    m = q.PAIR_MIXTURE
    parts = ["m0 as (" + " union all ".join(
        f"select {i} as comp, {float(w)} as weight, {float(mu[0])} as mu0, {float(mu[1])} as mu1, {float(v[0][0])} as s00, "
        f"{float(v[0][1])} as s01, {float(v[1][1])} as s11" for i, (w, mu, v) in enumerate(zip(m.weights, m.mu, m.sigma))) + ")"]
    for t in range(1, n + 1):
        parts.append(f"""p{t} as (select key, n0, n1, comp, 2.220446049250313e-16 + weight * exp(-0.5 * (
    s11 * (n0 - mu0) * (n0 - mu0) - 2 * s01 * (n0 - mu0) * (n1 - mu1) + s00 * (n1 - mu1) * (n1 - mu1))
    / (s00 * s11 - s01 * s01)) / (2.0 * pi() * sqrt(s00 * s11 - s01 * s01)) as p from enc cross join m{t - 1}),
e{t} as (select *, p / sum(p) over (partition by key) as r, sum(p) over (partition by key) as t from p{t}),
m{t} as (select comp, sum(r) / count(*) as weight, sum(r * n0) / sum(r) as mu0, sum(r * n1) / sum(r) as mu1,
  sum(r * n0 * n0) / sum(r) - pow(sum(r * n0) / sum(r), 2) as s00,
  sum(r * n0 * n1) / sum(r) - sum(r * n0) / sum(r) * (sum(r * n1) / sum(r)) as s01,
  sum(r * n1 * n1) / sum(r) - pow(sum(r * n1) / sum(r), 2) as s11, sum(ln(t)) as loglik from e{t} group by comp)""")
    return ",\n".join(parts)


ORACLE["mixture_em"] = f"""with {ORDERS}, {em_iterations(3)}
select cast(comp as integer) as comp, {', '.join(f'{r6(c)} as {c}' for c in ('weight', 'mu0', 'mu1', 's00', 's01', 's11'))},
  cast(3 as integer) as iterations, round(loglik, 3) as loglik from m3"""

MOMENTS = f"""select {r6('1.0')} as weight, {r6('avg(n0)')} as mean0, {r6('avg(n1)')} as mean1,
  {r6('avg(n0 * n0)')} as m00, {r6('avg(n0 * n1)')} as m01, {r6('avg(n1 * n1)')} as m11"""

ORACLE["mixture_moments"] = f"with {ORDERS} {MOMENTS} from enc"

ORACLE["mixture_retry"] = f"with {ORDERS} {MOMENTS}, cast(1 as integer) as failures from enc"

# ---- scoring ---------------------------------------------------------------------------------

ORACLE["score_categorical"] = f"""{EVENT_SCORES} select key, {r6('score_cat')} as score_cat from sc"""

ORACLE["score_gaussian"] = f"""with {ORDERS}
select key, {r6(f"ln({pdf2('n0', 'n1')})")} as score_num,
  {r6('ln(' + ' + '.join(f'{w} * ({p})' for w, p in zip(q.PAIR_MIXTURE.weights, pdf2_parts('n0', 'n1'))) + ')')}
    as score_weighted
from enc"""

ORACLE["score_joint"] = f"""{EVENT_SCORES}
select key, {r6('score_cat')} as score_cat, {r6('score_num')} as score_num, {r6('score')} as score
from sc"""

_LI = [f"(x{j} - lo{j}) / ((hi{j} - lo{j}) + 1e-13) as n{j}" for j in range(4)]


def _iso(var: float, mu: float) -> str:
    quad = " + ".join(f"(n{j} - {mu}) * (n{j} - {mu})" for j in range(4))
    return f"exp(-0.5 * ({quad}) / {var}) / (4.0 * pi() * pi() * {var} * {var})"


ORACLE["score_lineitem"] = f"""with li as (
  select row_number() over () as key, f.i as c0, s.i as c1, l_linenumber - 1 as c2,
    l_quantity as x0, l_extendedprice as x1, l_discount as x2, l_tax as x3
  from lineitem join {index('lineitem', 'l_returnflag')} f on l_returnflag = f.v
  join {index('lineitem', 'l_linestatus')} s on l_linestatus = s.v),
pr as (select max(c0) + 1 as w0, max(c1) + 1 as w1, max(c2) + 1 as w2, {', '.join(
    f'min(x{j}) as lo{j}, max(x{j}) as hi{j}' for j in range(4))} from li),
enc as (select key, c0, c0 as s0, w0 + c1 as s1, w0 + w1 + c2 as s2, w0 + w1 + w2 as D,
  {', '.join(_LI)} from li, pr),
{SLOTS}, {weights(4)},
base as (select key, c0, s0, s1, s2, {' + '.join(
    f'n{j} * (select w from w where idx = {j})' for j in range(4))} as b,
  ln({_iso(0.05, 0.3)} + {_iso(0.08, 0.7)}) as score_num from enc),
cat as (select key, any_value(c0) as c0, any_value(score_num) as score_num,
    sum(-ln(1.0 + exp(-(case when slot in (s0, s1, s2) then 1.0 else -1.0 end) * (b + w.w)))) as score_cat
  from base cross join slots join w on w.idx = slot + 4 group by key)
select c0 as flag_idx, {r6('min(score_cat + score_num)')} as min_score,
  {r6('max(score_cat + score_num)')} as max_score from cat group by c0"""

KTH = f"""th as (select count(*) as n, greatest(1, cast(floor(count(*) * {q.RATIO}) as bigint)) as k from sc),
kt as (select score as t from (select score, row_number() over (order by score, key) as rn from sc)
  where rn = (select k from th))"""

ORACLE["threshold_exact"] = f"""{EVENT_SCORES}, {KTH}
select n, k, {r6('t')} as threshold, (select count(*) from sc where score <= t) as flagged
from th, kt"""

ORACLE["threshold_rank"] = f"""{EVENT_SCORES}
select count(*) as n, greatest(1, cast(floor(count(*) * {q.RATIO}) as bigint)) as k, true as within from sc"""

ORACLE["score_minmax"] = f"""{EVENT_SCORES}
select {r6('min(score)')} as min_score, {r6('max(score)')} as max_score from sc"""

ORACLE["flag_fixed"] = f"""{EVENT_SCORES} select key, score < -20.0 as is_anomaly from sc"""

ORACLE["anomalies"] = f"""{EVENT_SCORES}, {KTH}
select key, c0 as event_type_idx, c1 as hour, x0 as value, {r6('score')} as score
from sc, kt where score <= t"""

# ---- evaluation ------------------------------------------------------------------------------

ORACLE["auroc"] = f"""with {DOCS}, {doc_scores()}, sp as (select score, 1 - label as p from sc),
{auroc_sql('sp')}"""

ORACLE["auroc_ties"] = f"""with {DOCS}, {doc_scores()},
sp as (select round(score, 0) as score, 1 - label as p from sc), {auroc_sql('sp')}"""

ORACLE["auroc_events"] = f"""{EVENT_SCORES},
sp as (select c1 as hour, score_num as score, cast(c0 <> 1 as integer) as p from sc),
{auroc_sql('sp', 'hour')}"""

FOLD = f"cast(floor({u('key', quote('fold'), S)} * {q.FOLDS}) as integer)"

ORACLE["fold_assign"] = f"""with {DOCS} select key, {FOLD} as fold from enc"""

SIZES = f"""fo as (select key, {FOLD} as fold from enc),
sz as (select fold, (select count(*) from fo) - count(*) as n_train, count(*) as n_test
  from fo group by fold)"""

ORACLE["fold_sizes"] = f"""with {DOCS}, {SIZES} select fold, n_train, n_test from sz"""


def _combo_scores() -> str:
    """CTE `al(combo, fold, score, p)` over the fixed weight sets."""
    base = "n0 * {w0} + n1 * {w1}"
    parts = []
    for i, seed in enumerate(q.WEIGHT_SEEDS):
        parts.append(f"""select {i} as combo, idx, {u('idx', quote('w'), seed)} - 0.5 as w
  from (select unnest(generate_series(0, 1 + (select max(D) from enc))) as idx)""")
    return f"""{SLOTS}, wa as ({' union all '.join(parts)}),
ba as (select combo, key, s0, s1, label, n0 * max(case when idx = 0 then w end)
    + n1 * max(case when idx = 1 then w end) as b, ln({pdf2('n0', 'n1')}) as score_num
  from enc cross join wa group by combo, key, s0, s1, label, n0, n1),
ca as (select ba.combo, key, any_value(label) as label, any_value(score_num)
    + sum(-ln(1.0 + exp(-(case when slot = s0 or slot = s1 then 1.0 else -1.0 end) * (b + wa.w)))) as score
  from ba cross join slots join wa on wa.combo = ba.combo and wa.idx = slot + 2
  group by ba.combo, key),
al as (select combo, {FOLD} as fold, score, 1 - label as p from ca)"""


CV = f"""{_combo_scores()},
ties as (select combo, fold, score, sum(p) as p, sum(1 - p) as q from al group by combo, fold, score),
cum as (select combo, fold, p, q, sum(q) over (partition by combo, fold order by score) - q as below from ties),
res as (select combo, fold, case when sum(p) > 0 and sum(q) > 0 then
    sum(p * (below + q / 2.0)) / (sum(p)::double * sum(q)) end as auroc,
  cast(sum(p) as bigint) as n_pos, cast(sum(q) as bigint) as n_neg from cum group by combo, fold),
mn as (select combo, avg(auroc) as auroc, count(auroc) as folds from res group by combo)"""

ORACLE["cv_scores"] = f"""with {DOCS}, {CV}
select cast(combo as integer) as combo, fold, {r6('auroc')} as auroc, n_pos, n_neg from res"""

ORACLE["cv_means"] = f"""with {DOCS}, {CV}
select cast(combo as integer) as combo, {r6('auroc')} as auroc, folds from mn"""

ORACLE["best_params"] = f"""with {DOCS}, {CV},
best as (select combo, auroc from mn order by auroc desc, combo limit 1),
worst as (select combo, auroc from mn order by auroc, combo limit 1)
select cast(case when 1.0 - worst.auroc > best.auroc then worst.combo else best.combo end as integer) as combo,
  {r6('case when 1.0 - worst.auroc > best.auroc then worst.auroc else best.auroc end')} as auroc,
  1.0 - worst.auroc > best.auroc as inverted from best, worst"""

GRID = f"""gd as (select cast(row_number() over (order by k, reg, lr_speed) - 1 as integer) as combo, k, reg,
    1.0::double as lr_start, lr_speed, 1.0::double as lam
  from (select unnest([2, 4]) as k), (select unnest([0.1, 1.0])::double as reg),
    (select unnest([0.01, 0.1, 1.0])::double as lr_speed))"""

ORACLE["param_grid"] = f"""with {DOCS}, {SIZES}, {GRID} select gd.*, sz.* from gd cross join sz"""

ORACLE["run_timing"] = f"""with {DOCS}, {SIZES}, {GRID}
select count(*) as fits, {r6('sum(n_test / 1000.0)')} as total_thousands,
  {r6('avg(n_test / 1000.0)')} as mean_thousands from gd cross join sz"""

# ---- sources and sinks -----------------------------------------------------------------------

CUSTOMER = f"""cu as (
  select cast(c_custkey as varchar) as key, t.i as c0, c_nationkey as c1, c_acctbal as x0
  from customer join {index('customer', 'c_mktsegment')} t on c_mktsegment = t.v),
cl as (select *, cast({u('key', quote('label'), S)} < 0.1 as integer) as label from cu)"""

ORACLE["libsvm_roundtrip"] = f"""with {CUSTOMER}
select c0, c1, label, count(*) as n, {r6('sum(x0)')} as total from cl group by c0, c1, label"""


def split(train: float, dev: float) -> str:
    d = u("key", quote("split"), S)
    return (f"case when {d} < {train} then 'train' when {d} < {train} + {dev} then 'dev' "
            f"else 'test' end")


ORACLE["split_view"] = f"""with {CUSTOMER}, sp as (select *, {split(0.6, 0.2)} as split from cl)
select split, label, count(*) as n, {r6('sum(x0)')} as total from sp group by split, label"""

ORACLE["scored_export"] = f"""with {CUSTOMER},
pr as (select max(c0) + 1 as w0, max(c1) + 1 as w1, min(x0) as lo0, max(x0) as hi0 from cl),
enc as (select key, label, c0, c1, x0, (x0 - lo0) / ((hi0 - lo0) + 1e-13) as n0, c0 as s0,
  w0 + c1 as s1, w0 + w1 as D from cl, pr),
{cat_score(1)}, sc as (select enc.*, score_cat + ln({pdf1('n0')}) as score from enc join cat using (key))
""" + " union all ".join(
    f"select key, label::double as label, cast({i} as integer) as pos, {r6(c)} as x from sc"
    for i, c in enumerate(("c0::double", "c1::double", "x0", "score")))

# ---- evaluation sets -------------------------------------------------------------------------

ORACLE["group_rows"] = f"""with sp as (
  select t.i as grp, count(*) as n, avg(p_size) as m0, avg(p_retailprice) as m1,
    stddev_pop(p_size) as d0, stddev_pop(p_retailprice) as d1
  from part join {index('part', 'p_brand')} t on p_brand = t.v group by t.i),
gr as (select sp.*, id, {normal('grp', 'id', quote('group'), S)} as v
  from sp, lateral (select unnest(generate_series(1, n)) as id))
select grp || ':' || id as key, grp, round(v * d0 + m0, 4) as x0, round(v * d1 + m1, 4) as x1 from gr"""

KEYS = "k as (select cast(o_orderkey as varchar) as key from orders)"
BASE = f"""{KEYS}, b as (select key, {', '.join(
    f"cast({u('key', quote('base'), i, S)} < {(2 / (2 + i + 1.0))!r} as integer) as b{i}" for i in range(4))} from k)"""

ORACLE["decaying_binary"] = f"with {BASE} " + " union all ".join(
    f"select key, cast({i} as integer) as pos, b{i} as bit from b" for i in range(4))


def rule_rows(match: str) -> str:
    flags, x0, x1 = [], [], []
    for i, r in enumerate(q.RULES):
        cols = r.cols if match == "listed" else range(len(r.cols))
        flags.append("(" + " and ".join(f"b{c} = 1" for c in cols) + f") as m{i}")
        for j, out in ((0, x0), (1, x1)):
            out.append(f"case when m{i} then {u('key', quote('rule'), i, j, S)} * {r.sigmas[j]} "
                       f"+ {r.means[j]} else 0.0 end")
    none = "not (m0 or m1 or m2)"
    for j, out in ((0, x0), (1, x1)):
        out.append(f"case when {none} then {u('key', quote('rule'), -1, j, S)} * "
                   f"{q.DEFAULT_RULE.sigmas[j]} + {q.DEFAULT_RULE.means[j]} else 0.0 end")
    return f"""{BASE}, fl as (select key, {', '.join(flags)} from b),
rm as (select key, m0, m1, m2, {' + '.join(x0)} as x0, {' + '.join(x1)} as x1 from fl)"""


ORACLE["rule_match"] = f"""with {rule_rows('listed')}
select key, case when not (m0 or m1 or m2) then '-1' else concat_ws(',', case when m0 then '0' end,
  case when m1 then '1' end, case when m2 then '2' end) end as rules, {r6('x0')} as x0,
  {r6('x1')} as x1 from rm"""


def coverage(match: str) -> str:
    parts = [f"select {i} as rule from rm where m{i}" for i in range(3)]
    parts.append("select -1 from rm where not (m0 or m1 or m2)")
    return f"""with {rule_rows(match)}, hits as ({' union all '.join(parts)})
select cast(rule as integer) as rule, count(*) as n,
  {r6('count(*) / (select count(*) from rm)::double')} as share from hits group by rule"""


ORACLE["rule_coverage"] = coverage("listed")
ORACLE["rule_coverage_prefix"] = coverage("prefix")

ORACLE["location_scale"] = f"""with {ORDERS}
select key, {r6(f"{u('key', quote('ls'), S, 0)} * 10.0 + x0")} as x0,
  {r6(f"{u('key', quote('ls'), S, 1)} * 2.0 - 1.0")} as x1 from enc"""

INDEPENDENT = f"""{KEYS}, ib as (select key, {', '.join(
    f"cast({u('key', quote('bit'), i, S)} < 0.5 as integer) as b{i}" for i in range(5))} from k)"""

ORACLE["independent_binary"] = f"with {INDEPENDENT} " + " union all ".join(
    f"select key, cast({i} as integer) as pos, b{i} as bit from ib" for i in range(5))


def share(rule, cols) -> str:
    ones = [c for c, on in zip(cols, rule) if on]
    return f"(({' + '.join(ones)}) / {float(len(ones))})"


IB = [f"b{i}" for i in range(5)]
DEPENDENT = f"""{INDEPENDENT}, db as (select *, {', '.join(
    f"cast({u('key', quote('dep'), i, S)} < {share(r, IB)} as integer) as d{i}"
    for i, r in enumerate(q.BIT_RULES))} from ib)"""
DB = [f"d{i}" for i in range(3)] + IB

ORACLE["dependent_binary"] = f"with {DEPENDENT} " + " union all ".join(
    f"select key, cast({i} as integer) as pos, {c} as bit from db" for i, c in enumerate(DB))

ORACLE["dependent_numeric"] = f"with {DEPENDENT} select key, " + ", ".join(
    r6(f"{u('key', quote('num'), S, j)} * (1.0 / ({share(r, DB)} + 1.0)) + {share(r, DB)}")
    + f" as x{j}" for j, r in enumerate(q.NUM_RULES)) + " from db"

ORACLE["draft_rules"] = f"""with t as (
  select c_custkey as rule, pos, {hit(u('c_custkey', quote('draft'), 'pos', S), repr(1.0 / 6))} as t
  from customer, generate_series(0, 5) g(pos)),
o as (select *, row_number() over (partition by rule order by t, pos) as rn from t),
l as (select rule, t as last from o where rn = 2)
select rule, cast(pos as integer) as pos, cast(t <= last as integer) as bit from t join l using (rule)"""

ORACLE["category_flip"] = f"""with {ORDERS}
select key, cast((c0 + 1 + cast(floor({u('key', quote('flip'), S)} * 2) as integer)) % 3 as integer) as c0,
  c1, 1 as label from enc"""

ORACLE["inject_rows"] = f"""with {EVENTS}
select key, {u('key', quote('inject'), S)} < 0.01 as hit from enc"""


def picks(m: int) -> str:
    ts = ", ".join(f"{hit(u('key', quote('pick'), i, S), f'({m} / 3.0)')} as t{i}" for i in range(3))
    return ts


def chosen(i: int) -> str:
    """How many positions rank before position i."""
    return " + ".join(
        f"cast(t{j} < t{i} or (t{j} = t{i} and {j} < {i}) as integer)" for j in range(3) if j != i)


NOISE = f"""pk as (select *, {picks(2)}, {u('key', quote('inject'), S)} < 0.25 as hit from enc),
ch as (select *, {', '.join(f'hit and ({chosen(i)}) < 2 as h{i}' for i in range(3))} from pk)"""

ORACLE["noise_inject"] = f"""with {EVENTS}, {NOISE}
select key, cast(case when h0 then (c0 + 1) % 2 else c0 end as integer) as c0,
  cast(case when h1 then (c1 + 1) % 2 else c1 end as integer) as c1,
  {r6(f"case when h2 then x0 + {normal('key', quote('noise'), 0, S)} else x0 end")} as x0,
  cast(hit as integer) as label from ch"""

ORACLE["noise_uniform"] = f"""with {EVENTS}, pp as (
  select key, pos, row_number() over (partition by key order by {u('key', quote('pick'), 'pos', S)}, pos) as rn
  from enc, generate_series(0, 2) g(pos))
select key, cast(pos as integer) as pos from pp where rn <= 2"""

ORACLE["split_rows"] = f"""with {EVENTS} select key, {split(0.7, 0.2)} as split from enc"""

ORACLE["split_position"] = """with n as (select count(*) as n from orders),
o as (select cast(o_orderkey as varchar) as key, row_number() over (order by o_orderkey) - 1 as p from orders)
select key, case when p < n // 2 then 'train' when p < n // 2 + n // 4 then 'dev' else 'test' end as split
from o, n where p < n // 2 + n // 4 + n // 8"""

ORACLE["set_summary"] = f"""with {EVENTS}, sp as (select key, {split(0.7, 0.2)} as split from enc)
select split, count(*) as n, cast(sum(cast(split <> 'train' and {u('key', quote('inject'), S)} < 0.1 as integer))
  as bigint) as anomalies from sp group by split"""


def candidate(v: int) -> str:
    return f"(1.0 + {v} * n0 + case when c1 = {v} then 2.0 else 0.0 end)"


ORACLE["conditional_resample"] = f"""with {ORDERS}, cf as (select key, c1, {candidate(0)} as f0,
  {candidate(0)} + {candidate(1)} as f1, {candidate(0)} + {candidate(1)} + {candidate(2)} as f2,
  {u('key', quote('resample'), 0, S)} as u from enc)
select key, cast(case when u * f2 < f0 then 0 when u * f2 < f1 then 1 else 2 end as integer) as c0, c1 from cf"""

# ---- whole jobs at small settings ------------------------------------------------------------

COMBOS = "cb as (select * from (values " + ", ".join(
    f"({i}, {r})" for i, r in enumerate(q.SMALL_SEARCH["reg"])) + ") t(combo, reg))"


def descent(pre: str, rows: str, start: str, steps: int = 2) -> str:
    """CTEs {pre}w0..: weights (combo, g, idx, w) after each step over all rows (g, key, n0, n1, s0, s1, D)."""
    parts = [f"""{pre}w0 as materialized (select combo, g, cast(i as integer) as idx, {start} - 0.5 as w
  from cb, (select distinct g, D from {rows}), lateral (select unnest(generate_series(0, 1 + D)) as i))"""]
    for t in range(1, steps + 1):
        parts.append(f"""{pre}d{t} as materialized (select *, case when slot = s0 or slot = s1 then 1.0 else -1.0 end as z from (
  select *, cast(floor({u('key', quote('slot'), S, 'g', t)} * D) as integer) as slot from {rows})),
{pre}p{t} as materialized (select v.combo, r.g, n0, n1, slot, -z / (1.0 + exp(z * (n0 * a.w + n1 * b.w + v.w))) as pull
  from {pre}d{t} r join {pre}w{t - 1} v on v.g = r.g and v.idx = slot + 2
  join {pre}w{t - 1} a on a.g = r.g and a.combo = v.combo and a.idx = 0
  join {pre}w{t - 1} b on b.g = r.g and b.combo = v.combo and b.idx = 1),
{pre}g{t} as (select combo, g, slot + 2 as idx, sum(pull) as s from {pre}p{t} group by all
  union all select combo, g, 0, sum(pull * n0) from {pre}p{t} group by all
  union all select combo, g, 1, sum(pull * n1) from {pre}p{t} group by all),
{pre}w{t} as materialized (select v.combo, v.g, v.idx, v.w - {1.0 / (1.0 + 0.1 * (t - 1))!r} * (coalesce(s, 0.0) / n
    + 2.0 * reg / sqrt(size) * v.w) as w
  from {pre}w{t - 1} v join cb using (combo)
  join (select g, count(*) as n, any_value(D) + 2 as size from {rows} group by g) c on c.g = v.g
  left join {pre}g{t} s on s.combo = v.combo and s.g = v.g and s.idx = v.idx)""")
    return ",\n".join(parts)


def one_gaussian(name: str, rows: str) -> str:
    """CTE name(g, m0, m1, s00, s01, s11): the fit of one component to the sample of each set."""
    rate = f"least(1.0, {mixture_target(1, SEARCH_RATIO)!r} / count(*) over (partition by g))"
    return f"""{name} as materialized (select g, avg(n0) as m0, avg(n1) as m1, avg(n0 * n0) - pow(avg(n0), 2) + 1e-9 as s00,
    avg(n0 * n1) - avg(n0) * avg(n1) as s01, avg(n1 * n1) - pow(avg(n1), 2) + 1e-9 as s11
  from (select *, {rate} as rate from {rows}) where {u('key', quote('mix'), S, 'g')} < rate group by g)"""


def grid_scores(name: str, rows: str, weights_: str, mixture: str) -> str:
    """CTE name(combo, g, key, label, score) of rows under every combination of their set."""
    return f"""{name} as materialized (select c.combo, c.g, key, label, cat - ln(2.0 * pi()) - 0.5 * ln(s00 * s11 - s01 * s01)
    - 0.5 * (s11 * (n0 - m0) * (n0 - m0) - 2.0 * s01 * (n0 - m0) * (n1 - m1) + s00 * (n1 - m1) * (n1 - m1))
      / (s00 * s11 - s01 * s01) as score
  from (select v.combo, r.g, key, any_value(label) as label, any_value(n0) as n0, any_value(n1) as n1,
      sum(-ln(1.0 + exp(-(case when v.idx - 2 = s0 or v.idx - 2 = s1 then 1.0 else -1.0 end)
        * (n0 * a.w + n1 * b.w + v.w)))) as cat
    from {rows} r join {weights_} v on v.g = r.g and v.idx >= 2
    join {weights_} a on a.g = r.g and a.combo = v.combo and a.idx = 0
    join {weights_} b on b.g = r.g and b.combo = v.combo and b.idx = 1 group by v.combo, r.g, key) c
  join {mixture} m on m.g = c.g)"""


SCALED = "(x0 - lo0) / ((hi0 - lo0) + 1e-13) as n0, (x1 - lo1) / ((hi1 - lo1) + 1e-13) as n1"

ORACLE["cv_small"] = f"""with {DOCS}, {COMBOS},
fo as materialized (select key, c0, c1, x0, x1, label, cast(floor({u('key', quote('fold'), S)} * 2) as integer) as fold from dv),
lim as (select g, min(x0) as lo0, max(x0) as hi0, min(x1) as lo1, max(x1) as hi1
  from fo, (select unnest([0, 1]) as g) where fold <> g group by g),
al as materialized (select key, g, fold, label, {SCALED}, c0 as s0, w0 + c1 as s1, w0 + w1 as D
  from fo, lim, (select w0, w1 from pr)),
tr as materialized (select * from al where fold <> g and label = 0),
te as materialized (select * from al where fold = g),
{descent('', 'tr', u('i', quote('w'), f"'{S}|' || g"))}, {one_gaussian('mix', 'tr')}, {grid_scores('gs', 'te', 'w2', 'mix')},
res as (select combo, g as fold, score, 1 - label as p from gs),
{auroc_sql('res', 'combo, fold')}"""

TUNED = f"""with {DOCS}, {COMBOS}, sp as materialized (select *, {split(0.6, 0.2)} as split from dv),
lim as (select max(c0) as m0, max(c1) as m1, min(x0) as lo0, max(x0) as hi0, min(x1) as lo1, max(x1) as hi1
  from sp where split = 'train'),
al as materialized (select key, 0 as g, split, label, {SCALED}, case when c0 <= m0 then c0 end as s0,
  case when c1 <= m1 then m0 + 1 + c1 end as s1, m0 + m1 + 2 as D from sp, lim),
tr as materialized (select * from al where split = 'train' and label = 0),
te as materialized (select * from al where split = 'dev'),
{descent('', 'tr', u('i', quote('w'), quote(f'{S}|0')))}, {one_gaussian('mix', 'tr')}, {grid_scores('gs', 'te', 'w2', 'mix')},
ties as (select combo, score, sum(1 - label) as p, sum(label) as q from gs group by combo, score),
cum as (select combo, p, q, sum(q) over (partition by combo order by score) - q as below from ties),
au as (select combo, sum(p * (below + q / 2.0)) / (sum(p)::double * sum(q)) as auroc from cum group by combo),
hi as (select combo, auroc from au order by auroc desc, combo limit 1),
lo as (select combo, auroc from au order by auroc, combo limit 1),
best as (select case when 1.0 - lo.auroc > hi.auroc then lo.combo else hi.combo end as combo,
  case when 1.0 - lo.auroc > hi.auroc then lo.auroc else hi.auroc end as auroc from hi, lo)"""

ORACLE["tune_small"] = f"""{TUNED},
every as materialized (select * from al where split = 'train'),
rest as materialized (select * from al where split = 'test'),
{descent('r', 'every', u('i', quote('w'), S))}, {one_gaussian('rmix', 'every')}, {grid_scores('rs', 'rest', 'rw2', 'rmix')}
select key, label, {r6('score')} as score, combo, {r6('auroc')} as dev_auroc from rs join best using (combo)"""

ORACLE["search_report"] = f"""{TUNED}
select split, count(*) as n, (select count(*) from cb) as fits, true as timed, true as adds_up,
  (select combo from best) as combo from sp group by split"""

ORACLE["detect_small"] = f"""with {EVENTS}, {sgd(3)}, {SLOTS},
st as (select avg(n0) as mu, avg(n0 * n0) - pow(avg(n0), 2) + 1e-9 as var from enc
  where {u('key', quote('mix'), S, 0)} < least(1.0, {mixture_target(1, q.RATIO)!r} / n)),
cat as (select key, any_value(n0) as n0, sum(-ln(1.0 + exp(-(case when slot = s0 or slot = s1 then 1.0 else -1.0 end)
    * (n0 * (select w from w3 where idx = 0) + w3.w)))) as score_cat
  from enc cross join slots join w3 on w3.idx = slot + 1 group by key),
sc as (select key, score_cat - 0.5 * (ln(2.0 * pi() * var) + (n0 - mu) * (n0 - mu) / var) as score from cat, st), {KTH}
select key, {r6('score')} as score from sc, kt where score <= t"""
