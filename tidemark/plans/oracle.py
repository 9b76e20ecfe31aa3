"""SQL that computes what the catalogue's queries return, for DuckDB over the same tables."""

from __future__ import annotations

CTES = {
    "ev": """SELECT user_id AS session_id, event_id, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us,
        epoch_us(ts) // 14400000000 AS tick, epoch_us(ts) // 60000000 AS m FROM events""",
    "shots": "SELECT session_id, event_id, tick FROM ev WHERE kind = 'click'",
    "hits": "SELECT session_id, event_id, tick, CAST(floor(value) AS BIGINT) AS damage, k % 8 AS hit_group FROM ev WHERE kind = 'view'",
    "kills": "SELECT session_id, event_id, tick, k % 2 = 0 AS headshot, 'w' || (k % 5) AS weapon FROM ev WHERE kind = 'purchase'",
    "nk": "SELECT session_id, tick AS kill_tick, row_number() OVER w AS engagement_id, lag(tick) OVER w AS prev_kill_tick FROM kills WINDOW w AS (PARTITION BY session_id ORDER BY tick, event_id)",
    "near": "SELECT s.event_id, min(n.engagement_id) AS engagement_id FROM shots s JOIN nk n ON n.session_id = s.session_id AND n.kill_tick >= s.tick GROUP BY 1",
    "att": """SELECT s.session_id, s.event_id, s.tick, e.engagement_id, n.kill_tick, n.prev_kill_tick FROM shots s LEFT JOIN near e USING (event_id)
        LEFT JOIN nk n ON n.session_id = s.session_id AND n.engagement_id = e.engagement_id""",
    "hm": "SELECT session_id, tick AS hit_tick, CAST(sum(damage) AS BIGINT) AS damage, arg_min(hit_group, event_id) AS hit_group FROM hits GROUP BY 1, 2",
    "ft": "SELECT a.event_id, min(h.hit_tick) AS hit_tick FROM att a JOIN hm h ON h.session_id = a.session_id AND h.hit_tick BETWEEN a.tick AND a.tick + 8 GROUP BY 1",
    "fh": "SELECT a.*, f.hit_tick, h.damage FROM att a LEFT JOIN ft f USING (event_id) LEFT JOIN hm h ON h.session_id = a.session_id AND h.hit_tick = f.hit_tick",
    "hh": "SELECT session_id, list(DISTINCT tick) AS ht FROM hits GROUP BY 1",
    "sh": "SELECT session_id, engagement_id, list(tick ORDER BY tick) AS st FROM att WHERE engagement_id IS NOT NULL GROUP BY 1, 2",
    "fl": """SELECT session_id, engagement_id, st, list_transform(list_reduce(list_transform(st, lambda f: {'f': f, 'h': coalesce(ht, [])}),
        lambda a, x: list_append(a, list_min(list_filter(x.h, lambda h: h BETWEEN x.f AND x.f + 8 AND NOT list_contains(a, h)))), []::BIGINT[]),
        lambda t: CASE WHEN t IS NULL THEN 'M' ELSE 'Y' END) AS flags FROM sh LEFT JOIN hh USING (session_id)""",
    "km": "SELECT session_id, tick AS kill_tick, arg_max(headshot, event_id) AS headshot, arg_max(weapon, event_id) AS weapon FROM kills GROUP BY 1, 2",
    "sz": "SELECT session_id, engagement_id, any_value(kill_tick) AS kill_tick, any_value(prev_kill_tick) AS prev, min(tick) AS fs, count(*) AS n FROM att WHERE engagement_id IS NOT NULL GROUP BY 1, 2",
    "dm": "SELECT session_id, engagement_id, CAST(coalesce(sum(damage), 0) AS BIGINT) AS damage_dealt FROM fh WHERE engagement_id IS NOT NULL GROUP BY 1, 2",
    "em": """SELECT session_id, engagement_id, kill_tick, round_even(kill_tick / 64.0::DOUBLE, 3) AS kill_time_s, round_even(coalesce(prev, fs) / 64.0::DOUBLE, 3) AS engagement_start_s,
        round_even((fs - coalesce(prev, fs)) / 64.0::DOUBLE * 1000, 1) AS ttff_ms, round_even((kill_tick - fs) / 64.0::DOUBLE * 1000, 1) AS ttk_ms,
        round_even((kill_tick - coalesce(prev, fs)) / 64.0::DOUBLE * 1000, 1) AS total_duration_ms, n AS shots_fired, CAST(len(list_filter(flags, lambda f: f = 'Y')) AS BIGINT) AS shots_hit,
        CAST(n - len(list_filter(flags, lambda f: f = 'Y')) AS BIGINT) AS shots_missed, round_even(len(list_filter(flags, lambda f: f = 'Y')) / n::DOUBLE, 3) AS hit_rate,
        CAST(coalesce(headshot, false) AS BIGINT) AS headshot, damage_dealt, coalesce(weapon, 'unknown') AS weapon, array_to_string(flags, ',') AS hit_sequence,
        round_even((fs - prev) / 64.0::DOUBLE * 1000, 1) AS inter_engagement_gap_ms, st, flags
        FROM sz JOIN dm USING (session_id, engagement_id) JOIN fl USING (session_id, engagement_id) LEFT JOIN km USING (session_id, kill_tick)""",
    "stk": """SELECT session_id, CAST(max(c) AS BIGINT) AS best_one_tap_streak FROM (SELECT session_id, g, sum(one) AS c FROM (
        SELECT session_id, CAST(shots_fired = 1 AS INT) AS one, sum(CAST(shots_fired <> 1 AS INT)) OVER (PARTITION BY session_id ORDER BY engagement_id) AS g FROM em) GROUP BY 1, 2) GROUP BY 1""",
    "sig": """SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY us, event_id) - 1 AS BIGINT) AS idx, CASE WHEN k % 11 <> 0 THEN 8 + k % 5 END AS label,
        [0, 1, 2, 7, 10, 11, 12, NULL][k % 8 + 1] AS raw FROM ev""",
    "it": """SELECT l_suppkey AS session_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS idx,
        l_quantity AS value FROM lineitem""",
    # local maxima of the events' values
    "sruns": """SELECT session_id, run, min(idx) AS i0, max(idx) AS i1, any_value(value) AS v FROM (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM (
        SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY session_id ORDER BY idx) THEN 0 ELSE 1 END AS b FROM sig)) GROUP BY 1, 2""",
    "smax": """SELECT session_id, (i0 + i1) // 2 AS idx, v AS height FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM sruns WINDOW w AS (PARTITION BY session_id ORDER BY run)) WHERE v > p AND v > q""",
    "det": "SELECT DISTINCT session_id, m AS t FROM ev WHERE kind = 'signup'",
    "gt": "SELECT DISTINCT session_id, m AS t FROM ev WHERE kind = 'purchase'",
    "sides": """SELECT session_id, coalesce(d, []::BIGINT[]) AS d, coalesce(g, []::BIGINT[]) AS g FROM (SELECT session_id, list(t ORDER BY t) AS d FROM det GROUP BY 1)
        FULL JOIN (SELECT session_id, list(t ORDER BY t) AS g FROM gt GROUP BY 1) USING (session_id)""",
    "dn": "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t) AS i FROM det",
    "gn": "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t) AS j FROM gt",
    "greedy": """SELECT session_id, unnest(o) AS p FROM (SELECT session_id, list_reduce(list_transform(d, lambda x: {'x': x, 'g': g}), lambda a, x:
        CASE WHEN list_min(list_transform(list_filter(x.g, lambda y: abs(x.x - y) <= 1440 AND NOT list_contains(list_transform(a, lambda q: q.g), y)), lambda y: {'r': abs(x.x - y), 'y': y})) IS NULL THEN a
        ELSE list_append(a, {'d': x.x, 'g': list_min(list_transform(list_filter(x.g, lambda y: abs(x.x - y) <= 1440 AND NOT list_contains(list_transform(a, lambda q: q.g), y)), lambda y: {'r': abs(x.x - y), 'y': y})).y}) END,
        []::STRUCT(d BIGINT, g BIGINT)[]) AS o FROM sides)""",
    "pr": """SELECT session_id, unnest(o) AS p FROM (SELECT session_id, list_reduce(list({'s': abs(dn.t - gn.t), 'i': i, 'j': j, 'd': dn.t, 'g': gn.t} ORDER BY abs(dn.t - gn.t), i, j),
        lambda a, x: CASE WHEN len(list_filter(a, lambda q: q.d = x.d OR q.g = x.g)) > 0 THEN a ELSE list_append(a, {'d': x.d, 'g': x.g}) END, []::STRUCT(d BIGINT, g BIGINT)[]) AS o
        FROM dn JOIN gn USING (session_id) WHERE abs(dn.t - gn.t) <= 1440 GROUP BY 1)""",
    "cp": "SELECT session_id, p.d AS d, p.g AS g FROM pr",
    "lab": """SELECT session_id, 'detection' AS side, t, CASE WHEN cp.d IS NULL THEN 'fp' ELSE 'tp' END AS label FROM det LEFT JOIN cp ON cp.session_id = det.session_id AND cp.d = det.t
        UNION ALL SELECT session_id, 'truth', t, CASE WHEN cp.g IS NULL THEN 'fn' ELSE 'matched' END FROM gt LEFT JOIN cp ON cp.session_id = gt.session_id AND cp.g = gt.t""".replace("SELECT session_id, 'detection'", "SELECT det.session_id, 'detection'").replace("SELECT session_id, 'truth'", "SELECT gt.session_id, 'truth'"),
    "al": """SELECT det.session_id, det.t AS time, p.g AS audio_time, det.t - p.g AS delta, CASE WHEN p.g IS NULL THEN 'bot_count_only' ELSE 'matched' END AS match_status FROM det
        LEFT JOIN greedy ON greedy.session_id = det.session_id AND greedy.p.d = det.t UNION ALL
        SELECT gt.session_id, NULL, gt.t, NULL, 'audio_only' FROM gt WHERE NOT EXISTS (SELECT 1 FROM greedy q WHERE q.session_id = gt.session_id AND q.p.g = gt.t)""",
    # energy peaks with a threshold percentile, distance 3 and merging
    "lvl80": "SELECT session_id, quantile_cont(value, 0.8) AS level FROM sig GROUP BY 1",
    "ev_e": "SELECT event_id, 8 + k % 5 AS truth, CASE WHEN k % 11 <> 0 THEN 8 + event_id % 5 END AS pred, CASE WHEN k % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM ev",
    "lb2": "SELECT session_id, idx, CASE WHEN k % 11 <> 0 THEN 8 + (k // 40) * 2 END AS l FROM sig",
    "auto": """SELECT session_id, unnest(o) AS c FROM (SELECT session_id, list_reduce(list({'t': idx::DOUBLE, 'l': l} ORDER BY idx), lambda a, x: CASE
        WHEN x.l IS NULL THEN {'c': a.c, 'cand': CASE WHEN a.nones + 1 >= 8 THEN NULL ELSE a.cand END, 'run': CASE WHEN a.nones + 1 >= 8 THEN 0 ELSE a.run END, 'nones': a.nones + 1, 'o': a.o}
        WHEN a.c IS NULL THEN {'c': x.l, 'cand': a.cand, 'run': a.run, 'nones': 0, 'o': a.o}
        WHEN x.l = a.c THEN {'c': a.c, 'cand': NULL, 'run': 0, 'nones': 0, 'o': a.o}
        WHEN CASE WHEN x.l IS NOT DISTINCT FROM a.cand THEN a.run + 1 ELSE 1 END >= 2 THEN {'c': x.l, 'cand': NULL, 'run': 0, 'nones': 0, 'o': list_append(a.o, {'t': x.t, 'f': a.c, 'g': x.l})}
        ELSE {'c': a.c, 'cand': x.l, 'run': CASE WHEN x.l IS NOT DISTINCT FROM a.cand THEN a.run + 1 ELSE 1 END, 'nones': 0, 'o': a.o} END,
        {'c': NULL::BIGINT, 'cand': NULL::BIGINT, 'run': 0::BIGINT, 'nones': 0::BIGINT, 'o': []::STRUCT(t DOUBLE, f BIGINT, g BIGINT)[]}).o AS o FROM lb2 GROUP BY 1)""",
    "tr": """SELECT session_id, round_even(c.t - 0.5, 4) AS time_s, c.f + s * i AS from_count, c.f + s * (i + 1) AS to_count, s AS delta, CASE WHEN s < 0 THEN 'kill' ELSE 'respawn' END AS direction,
        CAST(abs(c.f - c.g) > 1 AS BIGINT) AS multi_step FROM (SELECT session_id, c, CAST(CASE WHEN c.f > c.g THEN -1 ELSE 1 END AS BIGINT) AS s, unnest(range(CAST(abs(c.f - c.g) AS BIGINT))) AS i FROM auto)""",
    "mo": "SELECT session_id, tick::DOUBLE AS t, max(value) AS motion FROM ev WHERE kind = 'error' GROUP BY 1, 2",
    "en": "SELECT session_id, engagement_id, coalesce(prev, fs)::DOUBLE AS start, fs::DOUBLE AS first_shot FROM sz",
    "wf": "SELECT e.session_id, e.engagement_id, mo.t, mo.motion FROM en e JOIN mo ON mo.session_id = e.session_id AND mo.t >= greatest(e.start, 0) AND mo.t < e.first_shot",
    "alw": "SELECT *, motion <= 10 AS low, lag(motion <= 10) OVER (PARTITION BY session_id, engagement_id ORDER BY t) AS b FROM wf",
    "aac": "SELECT session_id, engagement_id, coalesce(max(CASE WHEN low AND coalesce(NOT b, true) THEN t END), arg_min(t, {'m': motion, 't': t})) AS acquired FROM alw GROUP BY 1, 2",
    # a window shorter than a frame has its start
    "aq": "SELECT session_id, engagement_id, start, first_shot, CASE WHEN first_shot - start < 1 THEN start ELSE acquired END AS acquired FROM en LEFT JOIN aac USING (session_id, engagement_id)",
    "stab": """SELECT *, CASE WHEN raw = 1 THEN CASE WHEN r = 12 AND (l IS NULL OR l = 12) THEN 12 ELSE 11 END ELSE clear END AS fixed FROM (
        SELECT *, last_value(clear IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
        first_value(clear IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM (
        SELECT *, CASE WHEN raw = 0 THEN 10 WHEN raw = 2 THEN 12 WHEN raw IN (10, 11, 12) THEN raw END AS clear FROM sig))""",
    "stab2": """SELECT session_id, idx, coalesce(last_value(fixed IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(fixed IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 12) AS f FROM stab""",
    "stab3": """SELECT session_id, idx, CAST(list_sort([coalesce(lag(f) OVER w, f), f, coalesce(lead(f) OVER w, f)])[2] AS BIGINT) AS stable FROM stab2 WINDOW w AS (PARTITION BY session_id ORDER BY idx)""",
}


def sql(*names: str, body: str, more: dict[str, str] | None = None, recursive: bool = False) -> str:
    """A query after the named common expressions, and those that they need, in the order of CTES; recursive: some of `more` refer to themselves."""
    import re

    wanted, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += [other for other in CTES if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", CTES[name])]
    parts = [f"{name} AS ({text})" for name, text in CTES.items() if name in wanted] + [f"{name} AS ({text})" for name, text in (more or {}).items()]
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} {body}"


PAIRS = "[]::STRUCT(d BIGINT, g BIGINT)[]"


def optimal(sides: str, tolerance: int) -> dict[str, str]:
    """cp: the most pairs within the tolerance, then the least distance, of sides(session_id, d, g); a step a detection, whose row has a cell for each number of first truths: count (negative), distance, choice, pairs."""
    cell = "CASE WHEN abs(z.x - z.y) <= {t} THEN {{'c': z.q[z.j].c - 1, 's': z.q[z.j].s + abs(z.x - z.y), 'k': 3, 'p': list_append(z.q[z.j].p, {{'d': z.x, 'g': z.y}})}} ELSE {{'c': 1::BIGINT, 's': 0::BIGINT, 'k': 3, 'p': z.q[z.j].p}} END".format(t=tolerance)
    return {
        "opt": f"""SELECT session_id, 1 AS i, d, g, list_transform(range(0, len(g) + 1), lambda j: {{'c': 0::BIGINT, 's': 0::BIGINT, 'k': 0, 'p': {PAIRS}}}) AS cells FROM {sides} WHERE len(d) > 0 AND len(g) > 0
            UNION ALL SELECT session_id, i + 1, d, g, list_reduce(list_transform(range(1, len(g) + 1), lambda j: {{'j': j, 'x': d[i], 'y': g[j], 'q': cells}}), lambda a, z: list_append(a, list_min([
            {{'c': a[z.j].c, 's': a[z.j].s, 'k': 1, 'p': a[z.j].p}}, {{'c': z.q[z.j + 1].c, 's': z.q[z.j + 1].s, 'k': 2, 'p': z.q[z.j + 1].p}}, {cell}])), [cells[1]]) FROM opt WHERE i <= len(d)""",
        "cp": "SELECT session_id, p.d AS d, p.g AS g FROM (SELECT session_id, unnest(cells[-1].p) AS p FROM opt WHERE i = len(d) + 1)",
    }


#: op: the least total distance with the smaller side (d) wholly paired; f tells whether the sides were turned.
LEAST = {
    "ordered": "SELECT session_id, len(d) > len(g) AS f, CASE WHEN len(d) > len(g) THEN g ELSE d END AS d, CASE WHEN len(d) > len(g) THEN d ELSE g END AS g FROM sides WHERE len(d) > 0 AND len(g) > 0",
    "least": f"""SELECT session_id, f, 1 AS i, d, g, list_transform(range(0, len(g) + 1), lambda j: {{'s': 0::BIGINT, 'k': 0, 'p': {PAIRS}}}) AS cells FROM ordered
        UNION ALL SELECT session_id, f, i + 1, d, g, list_reduce(list_transform(range(1, len(g) + 1), lambda j: {{'j': j, 'x': d[i], 'y': g[j], 'q': cells}}), lambda a, z: list_append(a, list_min([
        {{'s': a[z.j].s, 'k': 1, 'p': a[z.j].p}}, {{'s': z.q[z.j].s + abs(z.x - z.y), 'k': 3, 'p': list_append(z.q[z.j].p, {{'d': z.x, 'g': z.y}})}}])),
        [{{'s': 1000000000000000::BIGINT, 'k': 1, 'p': {PAIRS}}}]) FROM least WHERE i <= len(d)""",
    "op": "SELECT session_id, CASE WHEN f THEN p.g ELSE p.d END AS d, CASE WHEN f THEN p.d ELSE p.g END AS g FROM (SELECT session_id, f, unnest(cells[-1].p) AS p FROM least WHERE i = len(d) + 1)",
}


def walked(name: str, starts: str, tolerance: int) -> dict[str, str]:
    """The most pairs at each offset o of starts(session_id, o, d, g): two pointers, first come, first paired; {name}b: the first best of each session."""
    return {
        name: f"""SELECT session_id, o, 1 AS i, 1 AS j, 0 AS n, d, g FROM ({starts})
            UNION ALL SELECT session_id, o, i + CASE WHEN d[i] - o <= g[j] + {tolerance} THEN 1 ELSE 0 END, j + CASE WHEN d[i] - o >= g[j] - {tolerance} THEN 1 ELSE 0 END,
            n + CASE WHEN abs(d[i] - o - g[j]) <= {tolerance} THEN 1 ELSE 0 END, d, g FROM {name} WHERE i <= len(d) AND j <= len(g)""",
        f"{name}b": f"SELECT session_id, CASE WHEN max(n) > 0 THEN arg_max(o, {{'n': n, 'o': -o}}) ELSE 0 END AS o, max(n) AS n FROM {name} GROUP BY 1",
    }


#: best: the offset that a coarse search and a fine one about its best find, in units of 12 minutes.
SEARCH = (
    walked("co", "SELECT session_id, unnest(range(-8400, 8400, 120)) AS o, d, g FROM sides", 600)
    | walked("fi", "SELECT session_id, cob.o + unnest(range(-600, 600, 12)) AS o, d, g FROM sides JOIN cob USING (session_id)", 600)
    | {"best": "SELECT session_id, CASE WHEN fib.n > cob.n THEN fib.o ELSE cob.o END AS o, CAST(greatest(fib.n, cob.n) AS BIGINT) AS n FROM cob JOIN fib USING (session_id)"}
)


def thinned(source: str, where: str, distance: int) -> str:
    """Peaks thinned by distance: a fold over all of a session's, tallest first, later first of equals."""
    return f"""SELECT session_id, -p.i AS idx, -p.h AS height FROM (SELECT session_id, unnest(list_reduce(list({{'h': -height, 'i': -idx}} ORDER BY -height, -idx),
        lambda a, x: CASE WHEN len(list_filter(a, lambda q: abs(q.i - x.i) < {distance})) > 0 THEN a ELSE list_append(a, x) END, []::STRUCT(h DOUBLE, i BIGINT)[])) AS p FROM {source} WHERE {where} GROUP BY 1)"""


def prominent(source: str, samples: str, least: float) -> str:
    return f"""SELECT session_id, idx, round(height, 6) AS height, round(prominence, 6) AS prominence FROM (SELECT p.session_id, p.idx, p.height, p.height - greatest(
        (SELECT min(s.value) FROM {samples} s WHERE s.session_id = p.session_id AND s.idx <= p.idx AND s.idx > coalesce((SELECT max(z.idx) FROM {samples} z WHERE z.session_id = p.session_id AND z.idx < p.idx AND z.value > p.height), -1)),
        (SELECT min(s.value) FROM {samples} s WHERE s.session_id = p.session_id AND s.idx >= p.idx AND s.idx < coalesce((SELECT min(z.idx) FROM {samples} z WHERE z.session_id = p.session_id AND z.idx > p.idx AND z.value > p.height), 1000000000))
        ) AS prominence FROM {source} p) WHERE prominence >= {least}"""


def louder(source: str, gap: float) -> str:
    return f"""SELECT session_id, p.t AS t, p.e AS e FROM (SELECT session_id, unnest(list_reduce(list({{'t': t::DOUBLE, 'e': e}} ORDER BY t, e),
        lambda a, x: CASE WHEN len(a) = 0 OR x.t - a[-1].t >= {gap} THEN list_append(a, x) WHEN x.e > a[-1].e THEN list_append(a[:-2], x) ELSE a END, []::STRUCT(t DOUBLE, e DOUBLE)[])) AS p FROM {source} GROUP BY 1)"""


def audio(level: float, distance: int, gap: float, tag: str) -> dict[str, str]:
    """Common expressions lv, pk and kept (with a tag) of the audio detector over the events' values."""
    return {
        f"lv{tag}": f"SELECT session_id, quantile_cont(value, {level}) AS level FROM sig GROUP BY 1",
        f"pc{tag}": f"SELECT smax.* FROM smax JOIN lv{tag} USING (session_id) WHERE height >= level",
        f"pk{tag}": thinned(f"pc{tag}", "true", distance),
        f"pt{tag}": f"SELECT session_id, idx AS t, height AS e FROM pk{tag}",
        f"kept{tag}": louder(f"pt{tag}", gap),
    }


DEDUP = """SELECT session_id, unnest(list_reduce(list(t::DOUBLE ORDER BY t), lambda a, x: CASE WHEN len(a) = 0 OR x - a[-1] >= {w} THEN list_append(a, x) ELSE a END, []::DOUBLE[])) AS time_s FROM {s} GROUP BY 1"""
RATES = "CASE WHEN n_gt > 0 THEN round(100.0::DOUBLE * tp / n_gt, 6) ELSE 0 END AS recall, CASE WHEN n_det > 0 THEN round(100.0::DOUBLE * tp / n_det, 6) ELSE 0 END AS precision, CASE WHEN tp > 0 THEN round(200.0::DOUBLE * tp / (n_det + n_gt), 6) ELSE 0 END AS f1"
SCORES = {
    "totals": """SELECT session_id, coalesce(n_det, 0) AS n_det, coalesce(n_gt, 0) AS n_gt, coalesce(tp, 0) AS tp, mean_error, median_error FROM (SELECT session_id, count(*) AS n_det FROM det GROUP BY 1)
        FULL JOIN (SELECT session_id, count(*) AS n_gt FROM gt GROUP BY 1) USING (session_id)
        LEFT JOIN (SELECT session_id, count(*) AS tp, round(avg(abs(d - g) * 60.0::DOUBLE), 6) AS mean_error, round(quantile_cont(abs(d - g) * 60.0::DOUBLE, 0.5), 6) AS median_error FROM cp GROUP BY 1) USING (session_id)"""
}
MED = "round_even(round(quantile_cont({c}, 0.5), 6), 1)"

ORACLES: dict[str, str] = {
    "player_mode": sql("ev", body="SELECT session_id, actor FROM (SELECT session_id, k % 7 AS actor, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(us)) AS r FROM ev GROUP BY 1, 2) WHERE r = 1"),
    "player_filter": sql(
        "ev",
        body="SELECT session_id, event_id, k % 7 AS actor FROM ev JOIN (SELECT session_id, actor FROM (SELECT session_id, k % 7 AS actor, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, min(us)) AS r FROM ev GROUP BY 1, 2) WHERE r = 1) c USING (session_id) WHERE k % 7 = c.actor",
    ),
    "shot_to_kill_asof": sql("att", body="SELECT * FROM att"),
    "hit_match_greedy": sql("fl", body="SELECT session_id, engagement_id, array_to_string(flags, ',') AS flags FROM fl"),
    "damage_asof": sql("fh", body="SELECT session_id, event_id, tick, hit_tick, damage FROM fh"),
    "hit_tick_groups": sql("hm", body="SELECT * FROM hm"),
    "kill_meta": sql("km", body="SELECT session_id, kill_tick, CAST(headshot AS BIGINT) AS headshot, weapon FROM km"),
    "engagement_map": sql("em", body="SELECT * EXCLUDE (st, flags) FROM em"),
    "one_tap_streak": sql("stk", body="SELECT * FROM stk"),
    "kpi_summary": sql(
        "em",
        "stk",
        body=f"""SELECT *, CASE WHEN mean_ttff_ms > 0 THEN round_even(std_ttff_ms / mean_ttff_ms, 3) END AS ttff_cv FROM (SELECT session_id, count(*) AS total_engagements, CAST(sum(shots_fired) AS BIGINT) AS total_shots,
        CAST(sum(shots_hit) AS BIGINT) AS total_hits, round_even(sum(shots_hit)::DOUBLE / greatest(sum(shots_fired), 1)::DOUBLE, 3) AS overall_hit_rate, round_even(sum(headshot)::DOUBLE / count(*), 3) AS headshot_rate,
        round_even(count(*) FILTER (shots_fired = 1)::DOUBLE / count(*), 3) AS one_tap_rate, round_even(round(avg(shots_fired), 6), 2) AS mean_shots,
        {", ".join(f"round_even(round(avg({c}), 6), 1) AS mean_{c}, {MED.format(c=c)} AS median_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}" for c in ("ttff_ms", "ttk_ms", "total_duration_ms"))},
        round_even(round(stddev_samp(ttff_ms), 6), 1) AS std_ttff_ms, {MED.format(c="inter_engagement_gap_ms")} AS median_gap_ms, round_even(round(avg(inter_engagement_gap_ms), 6), 1) AS mean_gap_ms FROM em GROUP BY 1) JOIN stk USING (session_id)""",
    ),
    "shot_pivot": sql("em", body=f"SELECT session_id, engagement_id, {', '.join(f'round(round_even(st[{k}] / 64.0::DOUBLE, 3), 6) AS shot_{k}_time_s, flags[{k}] AS shot_{k}_hit' for k in range(1, 16))} FROM em"),
    "rolling_hit_rate": sql(
        "em",
        body="""SELECT session_id, engagement_id, hit_rate, round(avg(hit_rate) OVER (PARTITION BY session_id ORDER BY engagement_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling_hit_rate,
        round(avg(hit_rate) OVER (PARTITION BY session_id), 6) AS session_hit_rate FROM em""",
    ),
    "first_diff_clip": sql("it", body="SELECT session_id, idx, value - coalesce(lag(value) OVER w, value) AS difference, greatest(value - coalesce(lag(value) OVER w, value), 0) AS rise FROM it WINDOW w AS (PARTITION BY session_id ORDER BY idx)"),
    "boxcar_envelope": sql(
        "it",
        body="""SELECT session_id, idx, round(sum(value) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 6) AS envelope4,
        round(sum(value) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS envelope5 FROM it""",
    ),
    "median3": sql("it", body="SELECT session_id, idx, list_sort([coalesce(lag(value) OVER w, value), value, coalesce(lead(value) OVER w, value)])[2] AS smooth FROM it WINDOW w AS (PARTITION BY session_id ORDER BY idx)"),
    "ffill_bfill": sql(
        "sig",
        body="""SELECT session_id, idx, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(label IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 12) AS label FROM sig""",
    ),
    "rms_energy": "SELECT vec_id, f AS frame, round(f * 4 / 1000.0::DOUBLE, 6) AS time_s, round(sqrt(list_sum(list_transform(embedding[f * 4 + 1 : f * 4 + 8], lambda x: x::DOUBLE * x::DOUBLE)) / 8), 6) AS energy FROM (SELECT vec_id, embedding, unnest(range(14)) AS f FROM embeddings)",
    "frame_delta": """SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, b), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / len(embedding), 6) AS delta FROM (
        SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS b FROM embeddings)""",
    "zone_motion": """SELECT vec_id, round(list_sum(list_transform(list_zip(z, b), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / len(z), 6) AS delta FROM (
        SELECT vec_id, z, lag(z) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS b FROM (SELECT vec_id, flatten(list_transform(range(1, 5), lambda r: embedding[r * 8 + 3 : r * 8 + 6])) AS z FROM embeddings))""",
    "padded_delta": sql("it", body="SELECT session_id, idx, value, round((value - coalesce(lag(value) OVER (PARTITION BY session_id ORDER BY idx), value))::DOUBLE, 6) AS delta FROM it"),
    "effective_rate": sql(
        "ev",
        body="""SELECT session_id, CASE WHEN count(*) > 1 THEN round(1 / (max(m) - min(m))::DOUBLE, 6) ELSE 30 END AS rate FROM (
        SELECT session_id, m, row_number() OVER (PARTITION BY session_id ORDER BY m) AS n FROM (SELECT DISTINCT session_id, m FROM ev WHERE kind = 'click')) WHERE n <= 2 GROUP BY 1""",
    ),
    "text_labels": """SELECT n_nationkey, array_to_string(list_transform(string_split(replace(lower(n_name), '_', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS label, 'clip_' || w || e AS clip,
        'raw_' || w || '_kills.csv' AS path, 'nation_' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS number, upper('raw_' || w || e) AS upper
        FROM (SELECT *, replace(lower(n_name), ' ', '_') AS w, CASE WHEN n_nationkey % 2 = 0 THEN '.mp4' ELSE '' END AS e FROM nation)""",
    "brightness": """SELECT vec_id, round(list_sum(list_transform(range(21), lambda i: greatest(embedding[3 * i + 1]::DOUBLE, embedding[3 * i + 2]::DOUBLE, embedding[3 * i + 3]::DOUBLE))) / 21, 6) AS brightness,
        round(list_sum(list_transform(range(21), lambda i: round_even(0.299::DOUBLE * (100 * embedding[3 * i + 3]::DOUBLE) + 0.587::DOUBLE * (100 * embedding[3 * i + 2]::DOUBLE) + 0.114::DOUBLE * (100 * embedding[3 * i + 1]::DOUBLE), 0))) / 21, 6) AS gray FROM embeddings""",
    "red_share": sql("ev", body="SELECT session_id, round(avg(CASE WHEN (k * 2 BETWEEN 0 AND 10 OR k * 2 BETWEEN 170 AND 180) AND value >= 80 AND value + 10 >= 80 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS red_pct FROM ev GROUP BY 1"),
    "maxpool_bucket": sql(
        "sig",
        body="SELECT session_id, CAST((idx + 3) // 4 AS BIGINT) AS bucket, max(CASE WHEN idx > 0 THEN value ELSE 0 END) AS peak FROM (SELECT *, max(idx) OVER (PARTITION BY session_id) AS last FROM sig) WHERE (idx + 3) // 4 * 4 <= last GROUP BY 1, 2",
    ),
    "subsample": sql("it", body="SELECT * FROM it WHERE idx % 8 = 0"),
    "percentile_threshold": sql("sig", body="SELECT session_id, round(quantile_cont(value, 0.987), 6) AS threshold FROM sig GROUP BY 1"),
    "local_maxima": sql(
        "it",
        body="SELECT session_id, (i0 + i1) // 2 AS idx, v AS height FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM rn WINDOW w AS (PARTITION BY session_id ORDER BY run)) WHERE v > p AND v > q",
        more={"rn": "SELECT session_id, run, min(idx) AS i0, max(idx) AS i1, any_value(value) AS v FROM (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY session_id ORDER BY idx) THEN 0 ELSE 1 END AS b FROM it)) GROUP BY 1, 2"},
    ),
    "peaks_height_distance": sql("smax", body=thinned("smax", "height >= 20", 4)),
    "peaks_prominence": sql("smax", "sig", body=prominent("pk", "sig", 30.0), more={"pk": thinned("smax", "true", 3)}),
    "rise_peaks": sql(
        "sig",
        body=prominent("pk", "rs", 30.0),
        more={
            "rs": "SELECT session_id, idx, greatest(value - coalesce(lag(value) OVER (PARTITION BY session_id ORDER BY idx), value), 0) AS value FROM sig",
            "rr": "SELECT session_id, run, min(idx) AS i0, max(idx) AS i1, any_value(value) AS v FROM (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY session_id ORDER BY idx) THEN 0 ELSE 1 END AS b FROM rs)) GROUP BY 1, 2",
            "rm": "SELECT session_id, (i0 + i1) // 2 AS idx, v AS height FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM rr WINDOW w AS (PARTITION BY session_id ORDER BY run)) WHERE v > p AND v > q",
            "pk": thinned("rm", "true", 3),
        },
    ),
}
_NARROW = {
    "pk": thinned("smax", "height >= 40", 3),
    "ab": "SELECT sig.session_id, sig.idx, value, value > 20 OR pk.idx IS NOT NULL AS a, pk.idx IS NOT NULL AS is_peak FROM sig LEFT JOIN pk ON pk.session_id = sig.session_id AND pk.idx = sig.idx",
    "rn": "SELECT *, count(*) OVER (PARTITION BY session_id, run) AS width FROM (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN a = lag(a) OVER (PARTITION BY session_id ORDER BY idx) THEN 0 ELSE 1 END AS b FROM ab))",
}
_AUDIO = audio(0.8, 3, 6.0, "a")
ORACLES |= {
    "rise_height_peaks": sql(
        "sig",
        body="SELECT session_id, idx, round(height, 6) AS height FROM (" + thinned("rm", "height >= 20", 4) + ")",
        more={
            "rs": "SELECT session_id, idx, greatest(value - coalesce(lag(value) OVER (PARTITION BY session_id ORDER BY idx), value), 0) AS value FROM sig",
            "rr": "SELECT session_id, run, min(idx) AS i0, max(idx) AS i1, any_value(value) AS v FROM (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY session_id ORDER BY idx) THEN 0 ELSE 1 END AS b FROM rs)) GROUP BY 1, 2",
            "rm": "SELECT session_id, (i0 + i1) // 2 AS idx, v AS height FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM rr WINDOW w AS (PARTITION BY session_id ORDER BY run)) WHERE v > p AND v > q",
        },
    ),
    "width_filter": sql("smax", "sig", body="SELECT session_id, idx, value AS height, width FROM rn WHERE is_peak AND width <= 2", more=_NARROW),
    "rejected_peaks": sql("smax", "sig", body="SELECT pk.session_id, pk.idx, pk.height FROM pk JOIN rn ON rn.session_id = pk.session_id AND rn.idx = pk.idx WHERE width > 2", more=_NARROW),
    "red_gate": sql("smax", "sig", body="SELECT pk.session_id, pk.idx, height FROM pk JOIN sig ON sig.session_id = pk.session_id AND sig.idx = pk.idx WHERE k >= 30", more={"pk": thinned("smax", "height >= 20", 4)}),
    "audio_detect": sql("smax", "sig", body="SELECT session_id, t AS time_s, round(e, 6) AS energy, round(e / level, 6) AS confidence FROM kepta JOIN lva USING (session_id)", more=_AUDIO),
    "confidence_stats": sql(
        "smax",
        "sig",
        body="SELECT session_id, round(min(c), 6) AS least, round(quantile_cont(c, 0.5), 6) AS median, round(avg(c), 6) AS mean, count(*) FILTER (c < 1.05) AS n_low, count(*) FILTER (c >= 1.08) AS n_sure FROM (SELECT session_id, e / level AS c FROM kepta JOIN lva USING (session_id)) GROUP BY 1",
        more=_AUDIO,
    ),
    "session_type": sql(
        "smax",
        "sig",
        body="""SELECT session_id, n_tap, n_spray, CASE WHEN abs(n_tap - 8) < abs(n_spray - 8) - 2 THEN 'tap' WHEN abs(n_spray - 8) < abs(n_tap - 8) - 2 THEN 'spray' WHEN n_tap > 9 THEN 'spray' ELSE 'tap' END AS kind FROM (
        SELECT session_id, coalesce(a, 0) AS n_tap, coalesce(b, 0) AS n_spray FROM (SELECT DISTINCT session_id FROM sig) LEFT JOIN (SELECT session_id, count(*) AS a FROM keptt GROUP BY 1) USING (session_id)
        LEFT JOIN (SELECT session_id, count(*) AS b FROM kepts GROUP BY 1) USING (session_id))""",
        more=audio(0.7, 3, 4.0, "t") | audio(0.9, 3, 4.0, "s"),
    ),
    "merge_keep_louder": sql("ev", body=f"SELECT session_id, t AS time_s, round(e, 6) AS energy FROM ({louder('src', 1500.0)})", more={"src": "SELECT session_id, m AS t, value AS e FROM ev WHERE kind IN ('signup', 'error')"}),
    "dedup_anchor": sql("ev", body=DEDUP.format(w=1440.0, s="(SELECT session_id, m AS t FROM ev WHERE kind IN ('signup', 'purchase'))")),
    "vote_cluster": sql(
        "ev",
        body=f"SELECT session_id, round(time_s, 6) AS time_s FROM ({DEDUP.format(w=1440.0, s='votes')})",
        more={
            "src": "SELECT session_id, m AS t, kind AS r FROM ev WHERE kind IN ('signup', 'error', 'view')",
            "cl": """SELECT session_id, unnest(list_reduce(list({'t': t::DOUBLE, 'r': r} ORDER BY t, r), lambda a, x: CASE WHEN len(a) = 0 OR x.t - a[-1].s > 900 THEN list_append(a, {'s': x.t, 'n': 1, 'm': x.t, 'r': [x.r]})
                ELSE list_append(a[:-2], {'s': a[-1].s, 'n': a[-1].n + 1, 'm': a[-1].m + x.t, 'r': list_append(a[-1].r, x.r)}) END, []::STRUCT(s DOUBLE, n BIGINT, m DOUBLE, r VARCHAR[])[])) AS c FROM src GROUP BY 1""",
            "votes": "SELECT session_id, c.m / c.n AS t FROM cl WHERE len(list_distinct(c.r)) >= 2",
        },
    ),
    "peaks_per_roi": sql(
        "ev",
        body="SELECT roi, count(*) AS n FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM rn WINDOW w AS (PARTITION BY session_id, roi ORDER BY run)) WHERE v > p AND v > q GROUP BY 1",
        more={
            "rn": "SELECT session_id, roi, run, any_value(value) AS v FROM (SELECT *, sum(b) OVER (PARTITION BY session_id, roi ORDER BY us, event_id) AS run FROM (SELECT session_id, kind AS roi, us, event_id, value, CASE WHEN value = lag(value) OVER (PARTITION BY session_id, kind ORDER BY us, event_id) THEN 0 ELSE 1 END AS b FROM ev)) GROUP BY 1, 2, 3"
        },
    ),
    "fuse_asof_backward": sql("ev", "gt", body="SELECT * FROM fused", more={"fused": "SELECT gt.session_id, gt.t AS time_s, coalesce(max(s.m), gt.t) AS fused FROM gt LEFT JOIN ev s ON s.session_id = gt.session_id AND s.kind = 'click' AND s.m BETWEEN gt.t - 720 AND gt.t GROUP BY 1, 2"}),
    "refinement_count": sql(
        "ev",
        "gt",
        body="SELECT session_id, count(*) FILTER (fused <> time_s) AS n_refined, max(time_s - fused) AS largest FROM fused GROUP BY 1",
        more={"fused": "SELECT gt.session_id, gt.t AS time_s, coalesce(max(s.m), gt.t) AS fused FROM gt LEFT JOIN ev s ON s.session_id = gt.session_id AND s.kind = 'click' AND s.m BETWEEN gt.t - 720 AND gt.t GROUP BY 1, 2"},
    ),
    "fuse_band": sql(
        "sides",
        body="""SELECT session_id, p.d AS det_time, p.g AS truth_time FROM (SELECT session_id, unnest(list_reduce(list_transform(d, lambda x: {'x': x, 'g': g}), lambda a, x:
        CASE WHEN list_min(list_filter(x.g, lambda y: abs(x.x - y) <= 1440 AND NOT list_contains(list_transform(a, lambda q: q.g), y))) IS NULL THEN a
        ELSE list_append(a, {'d': x.x, 'g': list_min(list_filter(x.g, lambda y: abs(x.x - y) <= 1440 AND NOT list_contains(list_transform(a, lambda q: q.g), y)))}) END, []::STRUCT(d BIGINT, g BIGINT)[])) AS p FROM sides)""",
    ),
    "align_full_outer": sql("al", body="SELECT * FROM al"),
    "calibration": sql(
        "smax",
        "sig",
        "stab3",
        body=f"""SELECT session_id, idx, 'brightness' AS panel, value FROM sig WHERE value IS NOT NULL UNION ALL SELECT session_id, idx, 'envelope', round(e, 6) FROM en UNION ALL SELECT session_id, idx, 'rise', round(value, 6) FROM rs
        UNION ALL SELECT session_id, idx, 'count', stable FROM stab3 UNION ALL SELECT session_id, idx, 'count_raw', raw FROM sig WHERE raw IS NOT NULL
        UNION ALL SELECT session_id, idx, 'count_kill', stable FROM (SELECT *, lag(stable) OVER (PARTITION BY session_id ORDER BY idx) AS b FROM stab3) WHERE stable < b
        UNION ALL SELECT session_id, idx, 'truth', NULL FROM sig WHERE kind = 'purchase' UNION ALL SELECT session_id, idx, 'kill_peak', round(height, 6) FROM ({prominent("pr2", "rs", 30.0)})
        UNION ALL SELECT session_id, idx, 'shot', value FROM rn WHERE is_peak AND width <= 2 UNION ALL SELECT pk.session_id, pk.idx, 'shot_rejected', pk.height FROM pk JOIN rn ON rn.session_id = pk.session_id AND rn.idx = pk.idx WHERE width > 2""",
        more=_NARROW
        | {
            "en": "SELECT session_id, idx, sum(value) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS e FROM sig",
            "rs": "SELECT session_id, idx, greatest(value - coalesce(lag(value) OVER (PARTITION BY session_id ORDER BY idx), value), 0) AS value FROM sig",
            "rr": "SELECT session_id, run, min(idx) AS i0, max(idx) AS i1, any_value(value) AS v FROM (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY session_id ORDER BY idx) THEN 0 ELSE 1 END AS b FROM rs)) GROUP BY 1, 2",
            "rm": "SELECT session_id, (i0 + i1) // 2 AS idx, v AS height FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM rr WINDOW w AS (PARTITION BY session_id ORDER BY run)) WHERE v > p AND v > q",
            "pr2": thinned("rm", "true", 3),
        },
    ),
    "aligned_rows": sql(
        "al",
        body="SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(audio_time, time), match_status, time) AS row, time + 60 AS video_time FROM al",
    ),
    "alignment_stats": sql(
        "al",
        body="""SELECT *, CAST(rate >= 85 AS BIGINT) AS passes FROM (SELECT *, CASE WHEN n_matched + n_audio_only > 0 THEN round(100.0::DOUBLE * n_matched / (n_matched + n_audio_only), 6) ELSE 0 END AS rate FROM (
        SELECT session_id, count(*) FILTER (match_status = 'matched') AS n_matched, count(*) FILTER (match_status = 'bot_count_only') AS n_bot_count_only, count(*) FILTER (match_status = 'audio_only') AS n_audio_only,
        round(avg(abs(delta)), 6) AS mean_abs_delta, round(quantile_cont(delta::DOUBLE, 0.5), 6) AS median_delta FROM al GROUP BY 1))""",
    ),
    "greedy_in_order": sql("greedy", body="SELECT session_id, p.d AS det_time, p.g AS truth_time FROM greedy"),
    "greedy_closest_pair": sql("cp", body="SELECT session_id, d AS det_time, g AS truth_time FROM cp"),
    "optimal_assignment": sql("sides", body="SELECT session_id, d::DOUBLE AS det_time, g::DOUBLE AS truth_time FROM cp", more=optimal("sides", 1440), recursive=True),
    "min_cost_assignment": sql("sides", body="SELECT session_id, d::DOUBLE AS det_time, g::DOUBLE AS truth_time FROM op WHERE abs(d - g) <= 1440", more=LEAST, recursive=True),
    "optimal_scores": sql("sides", "det", "gt", body=f"SELECT session_id, n_det, n_gt, tp, n_det - tp AS fp, n_gt - tp AS fn, {RATES}, mean_error, median_error FROM totals", more=optimal("sides", 1440) | SCORES, recursive=True),
    "offset_search": sql("sides", body="SELECT session_id, o AS best_offset, n AS best_tp FROM best", more=SEARCH, recursive=True),
    "validated_scores": sql(
        "sides",
        "det",
        "gt",
        body=f"SELECT session_id, best.o AS best_offset, n_det, n_gt, tp, n_det - tp AS fp, n_gt - tp AS fn, {RATES}, mean_error, median_error FROM totals JOIN best USING (session_id)",
        more=SEARCH | {"moved": "SELECT session_id, list_transform(d, lambda x: x - o) AS d, g FROM sides JOIN best USING (session_id)"} | optimal("moved", 540) | SCORES,
        recursive=True,
    ),
    "offset_grid": sql(
        "sides",
        body="SELECT session_id, CASE WHEN max(tp) > 0 THEN arg_max(o, tp * 100 - (o + 600) // 120) ELSE 0 END AS best_offset, max(tp) AS best_tp FROM tried GROUP BY 1",
        more={
            "offs": "SELECT unnest(range(-600, 601, 120)) AS o",
            "tried": """SELECT session_id, o, CAST(len(list_reduce(list_transform(d, lambda x: {'x': x - o, 'g': g}), lambda a, x: CASE WHEN len(list_filter(x.g, lambda y: abs(x.x - y) <= 360 AND NOT list_contains(a, y))) = 0 THEN a
                ELSE list_append(a, list_min(list_transform(list_filter(x.g, lambda y: abs(x.x - y) <= 360 AND NOT list_contains(a, y)), lambda y: {'r': abs(x.x - y), 'y': y})).y) END, []::BIGINT[])) AS BIGINT) AS tp FROM sides, offs""",
        },
    ),
    "offset_xcorr": sql(
        "det",
        "gt",
        "sides",
        body="SELECT session_id, best_offset, strength, CAST(coalesce(len(o), 0) AS BIGINT) AS n_matches FROM offs LEFT JOIN taken USING (session_id)",
        more={
            "df": "SELECT det.session_id, det.t - gt.t AS x FROM det JOIN gt ON gt.session_id = det.session_id AND gt.t BETWEEN det.t - (600 + 360 * sqrt(2)) AND det.t + (600 + 360 * sqrt(2))",
            "sums": "SELECT session_id, lag, round(sum(exp(-((x - lag) * (x - lag))::DOUBLE / 32400.0::DOUBLE)), 6) AS strength FROM df, (SELECT unnest(range(-600, 601, 60)) AS lag) GROUP BY 1, 2",
            "offs": "SELECT session_id, arg_max(lag, {'s': strength, 'l': -lag}) AS best_offset, max(strength) AS strength FROM sums GROUP BY 1",
            "taken": """SELECT session_id, list_reduce(list_transform(d, lambda x: {'x': x - best_offset, 'g': g}), lambda a, x: CASE WHEN len(list_filter(x.g, lambda y: abs(x.x - y) <= 180 AND NOT list_contains(a, y))) = 0 THEN a
                ELSE list_append(a, list_min(list_transform(list_filter(x.g, lambda y: abs(x.x - y) <= 180 AND NOT list_contains(a, y)), lambda y: {'r': abs(x.x - y), 'y': y})).y) END, []::BIGINT[]) AS o FROM sides JOIN offs USING (session_id)""",
        },
    ),
    "nearest_diag": sql(
        "det",
        "gt",
        body="SELECT det.session_id, det.t AS time_s, arg_min(gt.t, {'r': abs(gt.t - det.t), 't': gt.t}) AS nearest, min(abs(gt.t - det.t)) AS nearest_gap FROM det LEFT JOIN gt ON gt.session_id = det.session_id GROUP BY 1, 2",
    ),
    "misses_diag": sql(
        "cp",
        "det",
        "gt",
        body="""SELECT ms.session_id, ms.t AS time_s, arg_min(det.t, {'r': abs(det.t - ms.t), 't': det.t}) AS nearest, min(abs(det.t - ms.t)) AS nearest_gap
        FROM ms LEFT JOIN det ON det.session_id = ms.session_id GROUP BY 1, 2""",
        more={"ms": "SELECT session_id, t FROM gt WHERE NOT EXISTS (SELECT 1 FROM cp WHERE cp.session_id = gt.session_id AND cp.g = gt.t)"},
    ),
    "in_range_filter": sql("det", "gt", body="SELECT session_id, t AS time_s FROM det JOIN (SELECT session_id, min(t) - 60 AS lo, max(t) + 60 AS hi FROM gt GROUP BY 1) USING (session_id) WHERE t BETWEEN lo AND hi"),
    "out_of_range": sql("det", "gt", body="SELECT session_id, t AS time_s FROM det JOIN (SELECT session_id, min(t) - 60 AS lo, max(t) + 60 AS hi FROM gt GROUP BY 1) USING (session_id) WHERE t NOT BETWEEN lo AND hi"),
    "tp_fp_fn_labels": sql("lab", body="SELECT * FROM lab"),
    "match_scores": sql("det", "gt", "cp", body=f"SELECT session_id, n_det, n_gt, tp, n_det - tp AS fp, n_gt - tp AS fn, {RATES}, mean_error, median_error FROM totals", more=SCORES),
    "pass_gates": sql("det", "gt", "cp", body=f"SELECT session_id, CAST(recall >= 60 AND precision >= 60 AS BIGINT) AS passes FROM (SELECT session_id, {RATES} FROM totals)", more=SCORES),
    "signal_leaderboard": sql(
        "ev",
        "gt",
        body=f"SELECT signal, n_det, n_gt, tp, {RATES}, median_error FROM (SELECT signal, count(*) AS n_det, (SELECT count(*) FROM gt) AS n_gt FROM kept GROUP BY 1) JOIN (SELECT signal, count(*) AS tp, quantile_cont(p.s::DOUBLE, 0.5) AS median_error FROM prs GROUP BY 1) USING (signal)",
        more={
            "two": "SELECT DISTINCT session_id, m AS t, kind FROM ev WHERE kind IN ('signup', 'error')",
            "one": "SELECT 'delta' AS signal, session_id, t FROM two WHERE kind = 'signup' UNION ALL SELECT 'red', session_id, t FROM two WHERE kind = 'error' UNION ALL SELECT 'merged', session_id, CAST(time_s AS BIGINT) FROM (" + DEDUP.format(w=200.0, s="two") + ")",
            "df": "SELECT signal, one.session_id, one.t - gt.t AS x FROM one JOIN gt ON gt.session_id = one.session_id AND gt.t BETWEEN one.t - (600 + 360 * sqrt(2)) AND one.t + (600 + 360 * sqrt(2))",
            "sums": "SELECT signal, session_id, lag, round(sum(exp(-((x - lag) * (x - lag))::DOUBLE / 32400.0::DOUBLE)), 6) AS strength FROM df, (SELECT unnest(range(-600, 601, 60)) AS lag) GROUP BY 1, 2, 3",
            "offs": "SELECT signal, session_id, arg_max(lag, {'s': strength, 'l': -lag}) AS o FROM sums GROUP BY 1, 2",
            "moved": "SELECT signal, session_id, t - coalesce(o, 0) AS t FROM one LEFT JOIN offs USING (signal, session_id)",
            "kept": "SELECT signal, session_id, t, row_number() OVER (PARTITION BY signal, session_id ORDER BY t) AS i FROM moved JOIN (SELECT session_id, min(t) - 60 AS lo, max(t) + 60 AS hi FROM gt GROUP BY 1) USING (session_id) WHERE t BETWEEN lo AND hi",
            "gj": "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t) AS j FROM gt",
            "prs": """SELECT signal, session_id, unnest(list_reduce(list({'s': abs(kept.t - gj.t), 'i': i, 'j': j} ORDER BY abs(kept.t - gj.t), i, j), lambda a, x: CASE WHEN len(list_filter(a, lambda q: q.i = x.i OR q.j = x.j)) > 0 THEN a
                ELSE list_append(a, x) END, []::STRUCT(s BIGINT, i BIGINT, j BIGINT)[])) AS p FROM kept JOIN gj USING (session_id) WHERE abs(kept.t - gj.t) <= 720 GROUP BY 1, 2""",
        },
    ),
    "error_hist": sql(
        "cp",
        body="SELECT session_id, CAST(least(floor((e - lo) / ((hi - lo) / 30)) + 1, 30) AS BIGINT) AS bin, count(*) AS n FROM es JOIN (SELECT session_id, min(e) AS lo, max(e) AS hi FROM es GROUP BY 1) USING (session_id) WHERE lo < hi GROUP BY 1, 2",
        more={"es": "SELECT session_id % 10 AS session_id, (d - g)::DOUBLE AS e FROM cp"},
    ),
    "running_scoreboard": sql(
        "lab",
        body="""SELECT session_id, t, side, label, tp, fp, fn, round(recall, 6) AS recall, round(precision, 6) AS precision, CASE WHEN recall + precision > 0 THEN round(2 * precision * recall / (precision + recall), 6) ELSE 0 END AS f1 FROM (
        SELECT *, CASE WHEN g > 0 THEN tp / g::DOUBLE * 100 ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE * 100 ELSE 0 END AS precision FROM (SELECT session_id, t, side, label,
        CAST(sum(CAST(label = 'tp' AS INT)) OVER w AS BIGINT) AS tp, CAST(sum(CAST(label = 'fp' AS INT)) OVER w AS BIGINT) AS fp, CAST(sum(CAST(label = 'fn' AS INT)) OVER w AS BIGINT) AS fn, sum(CAST(side = 'truth' AS INT)) OVER w AS g
        FROM lab WINDOW w AS (PARTITION BY session_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))""",
    ),
    "state_machine": sql("tr", body="SELECT * FROM tr"),
    "sanity": sql(
        "tr",
        body="""SELECT session_id, n_kills, n_challenge, n_respawns, bad_states, round(min_gap, 6) AS min_gap, n_ghost, CAST(abs(n_challenge - 20) <= 15 AS BIGINT) AS count_ok FROM (
        SELECT session_id, count(*) FILTER (direction = 'kill') AS n_kills, count(*) FILTER (direction = 'kill' AND time_s BETWEEN 5 AND 50) AS n_challenge, count(*) FILTER (direction = 'respawn') AS n_respawns,
        array_to_string(list_sort(list_filter(list_distinct(list_concat(list(from_count), list(to_count))), lambda s: s NOT IN (8, 9, 10, 11))), ',') AS bad_states FROM tr GROUP BY 1) LEFT JOIN (
        SELECT session_id, min(g) AS min_gap, count(*) FILTER (g < 3.0) AS n_ghost FROM (SELECT session_id, time_s - lag(time_s) OVER (PARTITION BY session_id ORDER BY time_s) AS g FROM tr WHERE direction = 'kill') GROUP BY 1) USING (session_id)""",
    ),
    "set_states": sql("tr", body="SELECT from_count AS state FROM tr UNION SELECT to_count FROM tr EXCEPT SELECT unnest([8, 9, 10])"),
    "challenge_filter": sql("tr", body="SELECT session_id, time_s, from_count FROM tr WHERE direction = 'kill' AND time_s BETWEEN 5 AND 40"),
    "decrement_events": sql("sig", body="SELECT session_id, idx, label FROM (SELECT *, lag(label) OVER (PARTITION BY session_id ORDER BY idx) AS b FROM sig WHERE label IS NOT NULL) WHERE label < b"),
    "stabilize_counts": sql("stab3", body="SELECT * FROM stab3"),
    "step_counts": sql(
        "sig",
        body="""SELECT session_id, count(*) AS n, count(*) FILTER (label IS NULL) AS n_null, min(label) AS least, max(label) AS largest, quantile_cont(label::DOUBLE, 0.5) AS median, count(*) FILTER (label > b) AS n_up, count(*) FILTER (label < b) AS n_down
        FROM (SELECT *, lag(label) OVER (PARTITION BY session_id ORDER BY idx) AS b FROM sig) GROUP BY 1""",
    ),
    "step_segments": sql(
        "sig",
        body="SELECT session_id, label, s AS start, coalesce(lead(s) OVER (PARTITION BY session_id ORDER BY run), e) AS end FROM (SELECT session_id, run, any_value(label) AS label, min(idx)::DOUBLE AS s, max(idx)::DOUBLE AS e FROM rn GROUP BY 1, 2)",
        more={"rn": "SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN idx > 0 AND label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY session_id ORDER BY idx) THEN 0 ELSE 1 END AS b FROM sig)"},
    ),
    "confusion_matrix": sql("ev_e", body=f"SELECT truth, {', '.join(f'count(*) FILTER (pred = {x}) AS pred_{x}' for x in range(8, 13))}, count(*) FILTER (pred IS NULL) AS pred_none FROM ev_e GROUP BY 1"),
    "accuracy_by_conf": sql("ev_e", body="SELECT confidence, count(*) AS n, round(avg(CASE WHEN truth = pred THEN 100.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM ev_e GROUP BY 1"),
    "disagreements": sql("ev_e", body="SELECT * FROM ev_e WHERE truth IS DISTINCT FROM pred ORDER BY event_id LIMIT 20"),
    "label_counts": sql("ev_e", body="SELECT truth, confidence, count(*) AS n FROM ev_e GROUP BY 1, 2"),
    "benchmark_lookup": sql(
        "sig",
        body="SELECT w.session_id, w.idx AS frame_n, arg_min({'l': t.label}, {'r': abs(t.idx - w.idx), 'i': t.idx}).l AS pred FROM sig w LEFT JOIN sig t ON t.session_id = w.session_id AND t.kind = 'view' WHERE w.kind = 'click' GROUP BY 1, 2",
    ),
    "json_label": sql(
        "ev",
        body="""SELECT event_id, CASE WHEN ok THEN k % 16 END AS label, CASE WHEN ok THEN 'high' ELSE 'low' END AS confidence, CASE WHEN ok THEN 'n' || k ELSE 'invalid label; n' || k END AS notes FROM (SELECT *, k % 4 <> 0 AND k % 16 BETWEEN 8 AND 12 AS ok FROM ev)""",
    ),
    "step_lookup": sql(
        "ev",
        "gt",
        body="SELECT gt.session_id, gt.t AS time_s, coalesce((SELECT arg_max(s.k, s.t) FROM st s WHERE s.session_id = gt.session_id AND s.t <= gt.t), (SELECT arg_min(s.k, s.t) FROM st s WHERE s.session_id = gt.session_id)) AS k FROM gt",
        more={"st": "SELECT session_id, m AS t, max(k) AS k FROM ev WHERE kind = 'signup' GROUP BY 1, 2"},
    ),
    "range_window_frames": sql("wf", body="SELECT session_id, engagement_id, t AS time_s, round(motion, 6) AS motion FROM wf"),
    "settle_time": sql(
        "mo",
        body="SELECT session_id, coalesce(max(CASE WHEN low AND coalesce(NOT b, true) THEN t END), arg_min(t, {'m': motion, 't': t})) AS acquired FROM lw GROUP BY 1",
        more={"lw": "SELECT *, motion <= 10 AS low, lag(motion <= 10) OVER (PARTITION BY session_id ORDER BY t) AS b FROM mo"},
    ),
    "motion_profile": sql("wf", "en", body="SELECT session_id, engagement_id, (t - start) * 1000 AS relative_ms, round(motion, 6) AS motion FROM wf JOIN en USING (session_id, engagement_id) WHERE first_shot - start >= 2"),
    "acquisition": sql("aq", body="SELECT session_id, engagement_id, acquired, round_even((acquired - start) * 1000, 1) AS acquisition_ms, round_even((first_shot - acquired) * 1000, 1) AS true_ttff_ms FROM aq"),
    "acquisition_means": sql(
        "aq",
        body="""SELECT session_id, round(avg(round_even((first_shot - acquired) * 1000, 1)), 6) AS mean_true_ttff_ms, round(avg(round_even((first_shot - start) * 1000, 1)), 6) AS mean_ttff_ms
        FROM aq GROUP BY 1""",
    ),
    "running_tally": sql("ev", "gt", body="SELECT gt.session_id, gt.t AS time_s, count(s.m) AS n FROM gt LEFT JOIN ev s ON s.session_id = gt.session_id AND s.kind = 'click' AND s.m <= gt.t GROUP BY 1, 2"),
    "visible_events": sql("det", "gt", body="SELECT gt.session_id, gt.t AS time_s, det.t AS event_time, det.t - gt.t AS offset FROM gt JOIN det ON det.session_id = gt.session_id AND det.t - gt.t BETWEEN -4320 AND 7200"),
    "latest_event": sql("det", "gt", body="SELECT gt.session_id, gt.t AS time_s, max(det.t) AS latest FROM gt LEFT JOIN det ON det.session_id = gt.session_id AND det.t BETWEEN gt.t - 2160 AND gt.t GROUP BY 1, 2"),
    "within_duration": sql(
        "det",
        "gt",
        body="SELECT g.session_id, count(det.t) AS n FROM (SELECT session_id, max(t) AS duration FROM gt GROUP BY 1) g LEFT JOIN det ON det.session_id = g.session_id AND det.t <= g.duration GROUP BY 1",
    ),
    "last_events": sql("ev", body="SELECT session_id, event_id, us FROM ev ORDER BY us DESC, event_id DESC LIMIT 20"),
    "proximity": sql(
        "det",
        "gt",
        body="""SELECT gt.session_id, gt.t AS time_s, round(coalesce(max(CASE WHEN gt.t < det.t AND gt.t - det.t >= -900 THEN 1 + (gt.t - det.t) / 900.0::DOUBLE WHEN gt.t - det.t BETWEEN 0 AND 600 THEN 1 - (gt.t - det.t) / 600.0::DOUBLE END), 0), 6) AS intensity
        FROM gt LEFT JOIN det USING (session_id) GROUP BY 1, 2""",
    ),
    "pulse_decay": sql(
        "stab3",
        body="SELECT session_id, idx, round(coalesce(greatest(0, 1 - 0.08::DOUBLE * (idx - a)), 0), 6) AS pulse FROM (SELECT *, last_value(CASE WHEN stable <> b THEN idx END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx) AS a FROM (SELECT *, lag(stable) OVER (PARTITION BY session_id ORDER BY idx) AS b FROM stab3))",
    ),
    "even_sample": sql(
        "sig",
        body="SELECT w.session_id, w.frame_n, w.sample, sig.value FROM (SELECT session_id, unnest(range(10)) AS sample, CAST(round_even(unnest(range(10)) * max(idx) / 9.0::DOUBLE, 0) AS BIGINT) AS frame_n FROM sig GROUP BY 1) w JOIN sig ON sig.session_id = w.session_id AND sig.idx = w.frame_n",
    ),
    "ocr_normalize": r"""SELECT p_partkey, d AS digits, CASE WHEN f <> '' AND length(f) <= 2 AND TRY_CAST(f AS INT) BETWEEN 0 AND 12 THEN TRY_CAST(f AS BIGINT) END AS n FROM (SELECT p_partkey, d, CASE WHEN d IN ('00', '01') THEN '10' ELSE d END AS f FROM (
        SELECT p_partkey, regexp_replace(translate(trim(p_name || p_size), 'lI|TnNwWpPBEoODQmMyYaARzZ', '1111111111100000000000222'), '[^0-9]', '', 'g') AS d FROM part))""",
    "parse_ratio": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN p_size::BIGINT END AS kills, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN p_size::BIGINT END AS ammo FROM part",
    "roi_resolve": "SELECT c_custkey, CAST(round_even(0.5063::DOUBLE * (c_custkey + 640), 0) AS BIGINT) AS x1, CAST(round_even(0.06::DOUBLE * (c_custkey % 700 + 360), 0) AS BIGINT) AS y1, CAST(round_even(0.5235::DOUBLE * (c_custkey + 640), 0) AS BIGINT) AS x2, CAST(round_even(0.0775::DOUBLE * (c_custkey % 700 + 360), 0) AS BIGINT) AS y2 FROM customer",
    "digit_classify": """SELECT vec_id, CAST(CASE WHEN fr IS NULL THEN NULL WHEN c[1] >= 5 AND c[1] >= c[3] THEN 11 WHEN c[3] >= 5 AND c[3] > c[1] OR fr >= 8 THEN CASE WHEN c[10] <= 6 THEN 8 ELSE 9 END
        WHEN gap THEN 10 ELSE 12 END AS BIGINT) AS digit FROM (SELECT vec_id, c, list_min(list_filter(range(5, 15), lambda i: c[i + 1] > 1)) AS fr,
        len(list_filter(range(6, 14), lambda i: c[i + 1] <= 2 AND c[i] > 2 AND coalesce(list_max(c[i + 2 : 15]), 0) > 2)) > 0 AS gap FROM (
        SELECT vec_id, list_transform(embedding[1:15], lambda x: CAST(floor(abs(x::FLOAT) * 40) AS BIGINT)) AS c FROM embeddings))""",
    "axis_maps": sql("ev", body="SELECT event_id, CAST(trunc(40 + value / 500.0::DOUBLE * 1280) AS BIGINT) AS x, CAST(trunc(least(1 + value / 100 - 1, 0.4::DOUBLE) / 0.4::DOUBLE * 90) AS BIGINT) AS bar FROM ev"),
    "tick_rates": sql("ev", body="SELECT session_id, coalesce(CASE WHEN session_id % 5 <> 0 THEN CAST(round_even(sum(k) / greatest(count(*) / 2.0::DOUBLE, 1), 0) AS BIGINT) END, 64) AS rate FROM ev GROUP BY 1"),
}
ORACLES |= {
    "scanned_counts": sql(
        body=CTES["tr"].replace("FROM auto", "FROM chg"),
        more={"dg": ORACLES["digit_classify"], "lb": "SELECT vec_id // 50 AS session_id, vec_id AS idx, digit AS l FROM dg", "chg": CTES["auto"].replace("FROM lb2", "FROM lb")},
    ),
    "stream_dedup": ORACLES["dedup_anchor"],
    "stream_transitions": sql(
        "sig",
        body="SELECT session_id, c.t AS us, c.f AS from_count, c.g AS to_count FROM chg",
        more={"lb": "SELECT session_id, us AS idx, CASE WHEN k % 11 <> 0 THEN 8 + (k // 40) * 2 END AS l FROM sig", "chg": CTES["auto"].replace("idx::DOUBLE", "idx").replace("t DOUBLE", "t BIGINT").replace("FROM lb2", "FROM lb")},
    ),
    "stream_delta": sql("sig", body="SELECT session_id, us, round(value - coalesce(lag(value) OVER (PARTITION BY session_id ORDER BY us), value), 6) AS delta FROM sig"),
    "stream_energy": sql(
        "ev",
        body="""SELECT session_id, start_us, round(sqrt(avg(value * value)), 6) AS energy, count(*) AS n FROM (
        SELECT session_id, value, CAST((us // 86400000000 - i) * 86400000000 AS BIGINT) AS start_us FROM ev, (SELECT unnest(range(2)) AS i))
        WHERE start_us + 172800000000 <= (SELECT max(us) - 86400000000 FROM ev) GROUP BY 1, 2""",
    ),
    "stream_fusion": sql(
        "ev",
        body="""SELECT p.session_id, p.us AS kill_us, c.us AS shot_us FROM ev p JOIN ev c ON c.session_id = p.session_id AND c.us BETWEEN p.us - 43200000000 AND p.us
        WHERE p.kind = 'purchase' AND c.kind = 'click'""",
    ),
    "stream_last_shot": sql(
        "ev",
        body="""SELECT p.session_id, p.us AS kill_us, coalesce(max(c.us), p.us) AS fused_us FROM ev p LEFT JOIN ev c ON c.session_id = p.session_id AND c.kind = 'click' AND c.us BETWEEN p.us - 43200000000 AND p.us
        WHERE p.kind = 'purchase' AND p.us <= (SELECT max(us) - 345600000000 FROM ev) GROUP BY 1, 2""",
    ),
    "stream_in_order": sql(
        "sig",
        body="SELECT session_id, c.t AS us, c.f AS from_count, c.g AS to_count FROM chg WHERE c.t <= (SELECT max(us) - 86400000000 FROM sig)",
        more={"lb": "SELECT session_id, us AS idx, CASE WHEN k % 11 <> 0 THEN 8 + (k // 40) * 2 END AS l FROM sig", "chg": CTES["auto"].replace("idx::DOUBLE", "idx").replace("t DOUBLE", "t BIGINT").replace("FROM lb2", "FROM lb")},
    ),
    "stream_patches": """SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, b), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / len(embedding), 6) AS delta FROM (
        SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS b FROM embeddings)""",
    "otsu_levels": """SELECT vec_id, CAST(b AS BIGINT) AS level FROM (SELECT vec_id, b, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, b) AS r FROM (SELECT vec_id, b, power(m * n - q * t, 2) / (n * (t - n)) AS s FROM (
        SELECT vec_id, b, len(v)::DOUBLE AS t, list_sum(v)::DOUBLE AS m, len(list_filter(v, lambda x: x <= b))::DOUBLE AS n, coalesce(list_sum(list_filter(v, lambda x: x <= b)), 0)::DOUBLE AS q
        FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(floor(abs(x) * 512), 255) AS BIGINT)) AS v FROM embeddings), (SELECT unnest(range(256)) AS b)) WHERE n > 0 AND n < t)) WHERE r = 1""",
    "column_profiles": """SELECT vec_id, array_to_string(list_transform(range(16), lambda c: CASE WHEN c < 3 THEN 0 ELSE len(list_filter(range(4), lambda r: abs(embedding[r * 16 + c + 1]) * 512 > 60)) END), ',') AS profile FROM embeddings""",
}
