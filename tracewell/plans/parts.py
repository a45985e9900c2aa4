"""WITH lists of the DuckDB twins, from the tables up."""

from __future__ import annotations

from tracewell.operators.spatial import gaussian_kernel

PX = """px AS (
  SELECT stack_id, frame, (p // 8)::INT AS y, (p % 8)::INT AS x,
         least(65535, greatest(0, floor((z + 1) * 32767.5)))::INT AS i
  FROM (SELECT label AS stack_id, (dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS frame,
               unnest(embedding)::DOUBLE AS z, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""
TR = """tr AS (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample,
         epoch_us(ts) / 1e6 AS t, value AS vm FROM events)"""
REC = """rec AS (SELECT series_id, (series_id % 10)::INT AS stack_id, count(*) // 2 AS n_frames FROM tr GROUP BY series_id)"""
EX = """ex AS (
  SELECT strftime(o_orderdate, '%Y_%m_%d') AS exp_date, lpad(o_custkey::VARCHAR, 6, '0') AS abf_serial,
         lpad(o_orderkey::VARCHAR, 8, '0') AS img_serial, o_orderdate AS recorded,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '10X' WHEN '2' THEN '40X' WHEN '3' THEN '60X' WHEN '4' THEN '40X' WHEN '5' THEN '60X' END AS objective,
         CASE WHEN n_regionkey <> 0 THEN n_nationkey END AS slice, CASE WHEN n_regionkey <> 0 THEN n_name END AS "at",
         o_orderkey % 23 AS total_dim_regions, o_orderkey % 17 AS total_bright_regions,
         round(o_totalprice / 1000, 3) AS x_span_um, o_totalprice AS bright_area_um2
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
PAIRS = """pr AS (
  SELECT '2025_01_01' AS exp_date, lpad(c_custkey::VARCHAR, greatest(4, length(c_custkey::VARCHAR))::INT, '0') AS abf_serial,
         lpad(c_custkey::VARCHAR, greatest(4, length(c_custkey::VARCHAR))::INT, '0') AS img_serial, c_mktsegment AS objective,
         CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS slice
  FROM customer WHERE c_acctbal > 0 AND c_custkey <> 0)"""
PEAKS = TR + """, runs AS (
  SELECT series_id, run, min(sample) AS f, max(sample) AS l, any_value(vm) AS h
  FROM (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY sample) AS run
        FROM (SELECT *, CASE WHEN lag(vm) OVER (PARTITION BY series_id ORDER BY sample) IS NOT DISTINCT FROM vm THEN 0 ELSE 1 END AS nw FROM tr))
  GROUP BY series_id, run),
mx AS (
  SELECT series_id, (f + l) // 2 AS pos, h
  FROM (SELECT *, lag(h) OVER w AS hl, lead(h) OVER w AS hr FROM runs WINDOW w AS (PARTITION BY series_id ORDER BY f))
  WHERE h > hl AND h > hr AND h >= 0),
kept AS (
  SELECT series_id, p.pos AS pos, p.h AS h FROM (
    SELECT series_id, unnest(list_reduce(list([{'h': h, 'pos': pos}] ORDER BY h DESC, pos DESC),
      lambda acc, e: CASE WHEN len(list_filter(acc, lambda q: abs(q.pos - e[1].pos) < 8)) > 0 THEN acc ELSE list_concat(acc, e) END)) AS p
    FROM mx GROUP BY series_id)),
bounds AS (
  SELECT k.series_id, k.pos, k.h, max(CASE WHEN t.vm > k.h AND t.sample < k.pos THEN t.sample END) AS lb,
         min(CASE WHEN t.vm > k.h AND t.sample > k.pos THEN t.sample END) AS rb
  FROM kept k JOIN tr t USING (series_id) GROUP BY ALL),
prom AS (
  SELECT b.series_id, b.pos, b.h,
         b.h - greatest(min(CASE WHEN t.sample <= b.pos AND (b.lb IS NULL OR t.sample > b.lb) THEN t.vm END),
                        min(CASE WHEN t.sample >= b.pos AND (b.rb IS NULL OR t.sample < b.rb) THEN t.vm END)) AS prominence
  FROM bounds b JOIN tr t USING (series_id) GROUP BY b.series_id, b.pos, b.h),
pk AS (SELECT * FROM prom WHERE round(prominence, 6) >= 10)"""
SPIKES = PEAKS + ", " + REC + """, sf AS (SELECT *, pos // 2 AS frame FROM pk),
gp AS (
  SELECT s.*, row_number() OVER w - 1 AS spike_id,
         coalesce(s.frame - lag(s.frame) OVER w - 1, s.frame - 1) AS left_gap,
         coalesce(lead(s.frame) OVER w - s.frame - 1, r.n_frames - s.frame - 1) AS right_gap
  FROM sf s JOIN rec r USING (series_id) WINDOW w AS (PARTITION BY s.series_id ORDER BY s.pos)),
sp AS (SELECT *, least(left_gap, right_gap) AS min_gap, least(left_gap, right_gap) >= 3 AS picked,
              CASE WHEN least(left_gap, right_gap) >= 3 THEN least(least(left_gap, right_gap), 4) END AS intv FROM gp),
sg AS (
  SELECT series_id, spike_id, spike_frame, intv, rel, spike_frame + rel AS frame
  FROM (SELECT series_id, spike_id, frame AS spike_frame, intv, unnest(range(-intv, intv + 1)) AS rel FROM sp WHERE picked))"""
SCORED = SPIKES + ", " + PX + """, seg AS (
  SELECT sg.series_id, sg.spike_id, rec.stack_id, sg.rel, px.y, px.x, px.i
  FROM sg JOIN rec USING (series_id) JOIN px ON px.stack_id = rec.stack_id AND px.frame = sg.frame),
zz AS (
  SELECT *, (i - m) / CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE s END AS z
  FROM (SELECT *, avg(CASE WHEN rel < 0 THEN i END) OVER w AS m, stddev_pop(CASE WHEN rel < 0 THEN i END) OVER w AS s
        FROM seg WINDOW w AS (PARTITION BY series_id, spike_id, y, x)))"""


def blur(border: str, sigma: float = 1.0) -> str:
    kernel = gaussian_kernel(sigma)
    half = len(kernel) // 2

    def axis(source: str, value: str, along: str, across: str, name: str) -> str:
        taps, weights = [], []
        for k, w in enumerate(kernel):
            d = k - half
            near = value if d == 0 else f"lag({value}, {-d}) OVER w" if d < 0 else f"lead({value}, {d}) OVER w"
            if border == "clamp":
                taps.append(f"coalesce({near}, {'first' if d < 0 else 'last'}_value({value}) OVER f) * {w!r}::DOUBLE")
            else:
                taps.append(f"coalesce(({near}) * {w!r}::DOUBLE, 0)")
                weights.append(f"CASE WHEN ({near}) IS NOT NULL THEN {w!r}::DOUBLE ELSE 0 END")
        total = "(" + " + ".join(taps) + ")" + ("" if border == "clamp" else " / (" + " + ".join(weights) + ")")
        line = f"PARTITION BY stack_id, frame, {across} ORDER BY {along}"
        return f"{name} AS (SELECT *, {total} AS {name}_v FROM {source} WINDOW w AS ({line}), f AS ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"

    start = "b0 AS (SELECT *, i::DOUBLE AS v FROM px)"
    return ", ".join([PX, start, axis("b0", "v", "x", "y", "bh"), axis("bh", "bh_v", "y", "x", "bv")])


def morph(source: str, flag: str, k: int, shrink: bool, name: str) -> str:
    def axis(column: str, along: str, across: str) -> str:
        w = f"(PARTITION BY stack_id, frame, {across} ORDER BY {along} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
        if shrink:
            return f"CASE WHEN count(*) OVER {w} < {2 * k + 1} THEN 0 ELSE min({column}) OVER {w} END"
        return f"max({column}) OVER {w}"

    return f"{name}_x AS (SELECT *, {axis(flag, 'x', 'y')} AS {name}_a FROM {source}), {name} AS (SELECT * EXCLUDE ({name}_a), {axis(name + '_a', 'y', 'x')} AS {name}_v FROM {name}_x)"


def otsu(source: str, value: str, name: str, bins: int = 256) -> str:
    """name(stack_id, name)."""
    return f"""{name}_h AS (
  SELECT stack_id, lo, hi, CASE WHEN hi = lo THEN 0 ELSE least({bins - 1}, floor(({value} - lo) * {bins} / (hi - lo))) END::BIGINT AS bin, count(*)::DOUBLE AS n
  FROM {source} JOIN (SELECT stack_id, min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi FROM {source} GROUP BY stack_id) USING (stack_id) GROUP BY ALL),
{name}_c AS (
  SELECT *, sum(n) OVER u AS n0, sum(bin * n) OVER u AS s0, sum(n) OVER a AS nt, sum(bin * n) OVER a AS st
  FROM {name}_h WINDOW u AS (PARTITION BY stack_id ORDER BY bin), a AS (PARTITION BY stack_id)),
{name} AS (
  SELECT stack_id, CASE WHEN hi = lo THEN lo ELSE lo + (bin + 0.5) * (hi - lo) / {bins} END::DOUBLE AS {name}
  FROM (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY
          CASE WHEN nt - n0 > 0 THEN n0 * (nt - n0) * (s0 / n0 - (st - s0) / (nt - n0)) * (s0 / n0 - (st - s0) / (nt - n0)) ELSE -1 END DESC, bin) AS k FROM {name}_c)
  WHERE k = 1)"""


def otsu_double(source: str, value: str) -> str:
    """th(stack_id, dim, bright)."""
    return ", ".join([
        otsu(source, value, "t1"),
        f"above AS (SELECT p.* FROM {source} p JOIN t1 USING (stack_id) WHERE p.{value} > t1.t1)",
        otsu("above", value, "t2"),
        "th AS (SELECT stack_id, t1 AS dim, coalesce(t2, t1) AS bright FROM t1 LEFT JOIN t2 USING (stack_id))",
    ])


def labels(source: str, flag: str, connectivity: int, name: str) -> str:
    """name: source's rows with label."""
    step = "abs(a.y - b.y) + abs(a.x - b.x) = 1" if connectivity == 4 else "greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1"
    return f"""{name}_m AS (SELECT stack_id, frame, y, x, y * 1000 + x AS p FROM {source} WHERE {flag}),
{name}_n AS (SELECT a.stack_id, a.frame, a.p, b.p AS q FROM {name}_m a JOIN {name}_m b USING (stack_id, frame) WHERE {step}),
{name}_r(stack_id, frame, root, p) AS (
  SELECT stack_id, frame, p, p FROM {name}_m
  UNION SELECT r.stack_id, r.frame, r.root, n.q FROM {name}_r r JOIN {name}_n n USING (stack_id, frame, p)),
{name}_l AS (SELECT stack_id, frame, p, dense_rank() OVER (PARTITION BY stack_id, frame ORDER BY min(root)) AS label FROM {name}_r GROUP BY stack_id, frame, p),
{name} AS (SELECT s.*, coalesce(l.label, 0) AS label FROM {source} s LEFT JOIN {name}_l l ON l.stack_id = s.stack_id AND l.frame = s.frame AND l.p = s.y * 1000 + s.x)"""
