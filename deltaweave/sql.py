"""DuckDB SQL for the graph queries."""

#: Rounds of the accumulative programs, here and in the queries.
ROUNDS = 8

_HANDOFF = """
f AS (
  SELECT o_custkey AS src, (1 + o_orderkey % 97)::DOUBLE AS w,
    lead(o_custkey, 1) OVER n AS d1, lead(o_custkey, 2) OVER n AS d2
  FROM orders JOIN customer ON o_custkey = c_custkey
  WINDOW n AS (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey)
), e AS (
  SELECT src, d1 AS dst, min(w) AS weight FROM f WHERE d1 IS NOT NULL AND d1 <> src GROUP BY 1, 2
), e2 AS (
  SELECT src, d2 AS dst, min(w) AS weight FROM f WHERE d2 IS NOT NULL AND d2 <> src GROUP BY 1, 2
), ch AS (
  SELECT CASE (src * 31 + dst) % 50 WHEN 0 THEN 'R' WHEN 1 THEN 'I' ELSE 'D' END AS type, src, dst,
    CASE (src * 31 + dst) % 50 WHEN 0 THEN weight WHEN 1 THEN weight * 2 ELSE weight * 0.5 END AS weight
  FROM e WHERE (src * 31 + dst) % 50 IN (0, 1, 2)
  UNION ALL
  SELECT 'A', src, dst, weight FROM e2 WHERE (src * 31 + dst) % 20 = 3 AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = e2.src AND e.dst = e2.dst)
), g AS (
  SELECT e.src, e.dst, coalesce(ch.weight, e.weight) AS weight FROM e LEFT JOIN ch USING (src, dst) WHERE coalesce(ch.type, '') <> 'R'
  UNION ALL SELECT src, dst, weight FROM ch WHERE type = 'A'
), v AS (
  SELECT src AS id FROM e UNION SELECT dst FROM e
), gv AS (
  SELECT id FROM v UNION SELECT src FROM g UNION SELECT dst FROM g
)"""

_TRADE = """
t AS (
  SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, sum(l_quantity) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), e AS (
  SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight FROM t
), b AS (
  SELECT src, dst, weight FROM (SELECT *, avg(weight) OVER (PARTITION BY src) AS m FROM t) WHERE weight > m
), v AS (
  SELECT src AS id FROM t UNION SELECT dst FROM t
)"""


def _least(edges: str, start: str, step: str = "d.v + e.weight", best: str = "min", beats: str = "<") -> str:
    """A recursive table d (k, v): best value of each vertex over ``edges``."""
    return f"""d(k, v) USING KEY (k) AS (
  {start} UNION
  SELECT n.k, n.v FROM (SELECT e.dst AS k, {best}({step}) AS v FROM d JOIN {edges} e ON e.src = d.k GROUP BY e.dst) n
  LEFT JOIN recurring.d c ON c.k = n.k WHERE c.v IS NULL OR n.v {beats} c.v
)"""


_ZERO = "SELECT 0::BIGINT AS k, 0::DOUBLE AS v"
_SSSP = f"WITH RECURSIVE {_HANDOFF}, {_least('e', _ZERO)}"
_SSSP_G = f"WITH RECURSIVE {_HANDOFF}, {_least('g', _ZERO)}"
_WIDE = f"WITH RECURSIVE {_HANDOFF}, " + _least("e", "SELECT 0::BIGINT AS k, 'inf'::DOUBLE AS v", "least(d.v, e.weight)", "max", ">")
_WIDE_G = f"WITH RECURSIVE {_HANDOFF}, " + _least("g", "SELECT 0::BIGINT AS k, 'inf'::DOUBLE AS v", "least(d.v, e.weight)", "max", ">")
_DISTANCES = "SELECT id, v AS value FROM v LEFT JOIN d ON k = id"
_DISTANCES_G = "SELECT id, v AS value FROM gv LEFT JOIN d ON k = id"


def _widths(vertices: str) -> str:
    return f"SELECT id, CASE WHEN v IS NULL THEN 0 WHEN isfinite(v) THEN v END AS value FROM {vertices} LEFT JOIN d ON k = id"


def _sums(prelude: str, seed: str, step: str, edges: str = "x", rounds: int = ROUNDS) -> str:
    """Values and last deltas of an accumulative program after so many rounds, over a table of edges."""
    return f"""WITH RECURSIVE {prelude}, d(k, delta, i) AS (
  SELECT id, ({seed})::DOUBLE, 0 FROM v
  UNION ALL SELECT x.dst, sum({step}), d.i + 1 FROM d JOIN {edges} x ON x.src = d.k WHERE d.i < {rounds} GROUP BY x.dst, d.i + 1
) SELECT k AS id, round(sum(CASE WHEN i < {rounds} THEN delta ELSE 0 END), 6) AS value, round(sum(CASE WHEN i = {rounds} THEN delta ELSE 0 END), 6) AS delta
FROM d GROUP BY k"""


_PR = _HANDOFF + ", x AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM e)"


def _pr_at(k: int) -> str:
    return f"""d{k}(k, delta, i) AS (
  SELECT id, 0.2::DOUBLE, 0 FROM v UNION ALL
  SELECT x.dst, sum(0.8 * d.delta / x.n), d.i + 1 FROM d{k} d JOIN x ON x.src = d.k WHERE d.i < {k} GROUP BY x.dst, d.i + 1
), p{k} AS (SELECT k AS id, sum(CASE WHEN i < {k} THEN delta ELSE 0 END) AS value, sum(CASE WHEN i = {k} THEN delta ELSE 0 END) AS delta FROM d{k} GROUP BY k)"""


_THREE = f"""WITH RECURSIVE {_HANDOFF}, r(i, k, delta, value) AS (
  SELECT 0, id, CASE WHEN id = 0 THEN 0::DOUBLE ELSE 'inf'::DOUBLE END, 'inf'::DOUBLE FROM v
  UNION ALL
  SELECT i + 1, k, least(delta, m), CASE WHEN delta < value THEN delta ELSE value END FROM (
    SELECT r.i, r.k, r.delta, r.value, coalesce((SELECT min(s.delta + e.weight) FROM r s JOIN e ON e.src = s.k WHERE e.dst = r.k AND s.delta < s.value), 'inf'::DOUBLE) AS m
    FROM r WHERE r.i < 3)
), s AS (SELECT k AS id, delta, value FROM r WHERE i = 3)"""

_SUPPLIES = """
c AS (SELECT l_suppkey AS a, l_partkey + 1000000000 AS b, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2),
y AS (SELECT a AS src, b AS dst, weight FROM c UNION ALL SELECT b, a, weight FROM c), yv AS (SELECT DISTINCT src AS id FROM y)"""

#: Walks of exactly i edges from vertex 0; after r rounds values are the least of walks of fewer than r, deltas of up to r.
_WALKS = f"""WITH RECURSIVE {_HANDOFF}, w(k, d, i) AS (
  SELECT 0::BIGINT, 0::DOUBLE, 0 UNION ALL SELECT e.dst, min(w.d + e.weight), w.i + 1 FROM w JOIN e ON e.src = w.k WHERE w.i < 40 GROUP BY e.dst, w.i + 1
), n AS (SELECT range AS r FROM range(0, 40)), s AS (
  SELECT r, id, min(CASE WHEN i < r THEN d END) AS value, min(CASE WHEN i <= r THEN d END) AS delta FROM n CROSS JOIN v LEFT JOIN w ON k = id GROUP BY r, id
), m AS (
  SELECT r, count(*) FILTER (delta IS NOT NULL AND (value IS NULL OR delta < value)) AS pending, count(*) FILTER (value IS NULL) AS unknown, count(*) AS rows, coalesce(sum(value), 0) AS total FROM s GROUP BY r
)"""


def _u(seed, *keys: str) -> str:
    """A uniform number by the md5 of a seed and keys (SQL expressions)."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT::DOUBLE / 4503599627370496)"


def _normal(seed, what: str, *keys: str) -> str:
    a, b = (_u(seed, f"'{x}'", f"'{what}'", *keys) for x in "ab")
    return f"(sqrt(-2 * ln(greatest({a}, 1e-300))) * cos(2 * pi() * {b}))"


def _drawn_graph(nodes: str, degree: str, seed, weight: str, loops: bool) -> str:
    return f"""WITH n AS ({nodes}), k AS (SELECT range AS src, n.n FROM n, range(0, (SELECT n FROM n))), m AS (
  SELECT src, n, CAST({degree} AS BIGINT) AS many FROM k
), t AS (
  SELECT DISTINCT src, floor({_u(seed, "'target'", "src", "nth")} * n)::BIGINT AS dst FROM (SELECT src, n, unnest(range(1, many + 1)) AS nth FROM m)
) SELECT src, dst, {weight} AS weight FROM t {"" if loops else "WHERE src <> dst"}"""


_TRIES = 20


def _drawn_changes(prelude: str, flagged: str, chances: str, seed: int, weighted: bool) -> str:
    """Changes drawn from edges (src, dst, weight, c): at most one each; additions draw targets until one is free."""
    rounds = ""
    for k in range(_TRIES):
        won = " UNION ALL ".join(["SELECT src, dst FROM e", *[f"SELECT src, dst FROM won{j}" for j in range(k)]])
        rounds += f""", left{k} AS (
  SELECT src, old, u FROM {f"left{k - 1}" if k else "wanted"} l {f"WHERE NOT EXISTS (SELECT 1 FROM won{k - 1} w WHERE w.src = l.src AND w.old = l.old)" if k else ""}
), taken{k} AS MATERIALIZED ({won}), won{k} AS MATERIALIZED (
  SELECT src, old, dst, u FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY old) AS nth FROM (
    SELECT *, floor({_u(seed, "'new'", "src", "old", f"'{k}'")} * (SELECT count(*) FROM customer))::BIGINT AS dst FROM left{k}) f
    WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM taken{k} t WHERE t.src = f.src AND t.dst = f.dst)) WHERE nth = 1
)"""
    new = " UNION ALL ".join(f"SELECT 'A' AS type, src, dst, u AS weight FROM won{k}" for k in range(_TRIES))
    weight = "round(weight, 9)" if weighted else "NULL::DOUBLE"
    return f"""{prelude}, flagged AS ({flagged}), chances AS (SELECT *, {chances} FROM flagged), drawn AS (
  SELECT *, {_u(seed, "'kind'", "src", "dst")} AS draw, {_u(seed, "'amount'", "src", "dst")} AS u FROM chances
), typed AS (
  SELECT *, CASE WHEN draw < a THEN 'A' WHEN draw < a + r THEN 'R' WHEN draw < a + r + i THEN 'I' WHEN draw < a + r + i + dd THEN 'D' END AS type FROM drawn
), wanted AS (SELECT src, dst AS old, u FROM typed WHERE type = 'A'){rounds}, al AS (
  SELECT type, src, dst, CASE type WHEN 'I' THEN weight * (1 + u) WHEN 'D' THEN weight * u ELSE weight END AS weight FROM typed WHERE type <> 'A'
  UNION ALL {new}
) SELECT type, src, dst, {weight} AS weight FROM al {"" if weighted else "WHERE type IN ('A', 'R')"}"""


def _fixed_chances(rate: float, good: float, edge_share: float) -> str:
    """Chances that are the same for all edges, in the order of the arithmetic of the generator."""
    rates = {"A": edge_share * good, "R": edge_share * (1 - good), "I": (1 - edge_share) * (1 - good), "D": (1 - edge_share) * good}
    whole = sum(rates.values())
    return ", ".join(f"{rate * rates[k] / whole!r}::DOUBLE AS {n}" for k, n in (("A", "a"), ("R", "r"), ("I", "i"), ("D", "dd")))


def _critical_chances(good: float, edge_share: float) -> str:
    on = {"a": "0::DOUBLE", "r": f"cc * {edge_share} * {1 - good}", "i": f"cc * {1 - edge_share} * {1 - good}", "dd": f"cc * {good}"}
    off = {"a": edge_share * good, "r": edge_share * (1 - good), "i": (1 - edge_share) * (1 - good), "dd": (1 - edge_share) * good}
    cases = ", ".join(f"CASE WHEN c THEN {on[k]} ELSE dc * {off[k]!r} END AS {k}" for k in on)
    return cases


def _critical_rates(rate: float, critical: float) -> str:
    """Tables of edges with the rates of critical ones (cc) and of the others (dc)."""
    return f""", marked AS ({_CRITICAL}), counted AS (SELECT count(*) AS n, count(*) FILTER (c) AS nc FROM marked), rated AS (
  SELECT *, least({rate} * n / nc, {critical}) AS cc FROM counted
)"""


_CRITICAL_EDGES = "SELECT m.*, cc, (rate * n - cc * nc) / greatest(1, n - nc) AS dc FROM marked m CROSS JOIN rated"
_CRITICAL = "SELECT e.src, e.dst, e.weight, coalesce(b.v = a.v + e.weight, false) AS c FROM e LEFT JOIN d a ON a.k = e.src LEFT JOIN d b ON b.k = e.dst"

_K = 4
_SIM = "\n".join(
    f""", s{k} AS (
  SELECT x.id AS a, y.id AS b, CASE WHEN x.id = y.id THEN 1.0 ELSE coalesce(0.8 * sum(p.value) / (any_value(ni.n) * any_value(nj.n)), 0) END::DOUBLE AS value
  FROM v x CROSS JOIN v y LEFT JOIN b i ON i.dst = x.id LEFT JOIN b j ON j.dst = y.id LEFT JOIN s{k - 1} p ON p.a = i.src AND p.b = j.src
  LEFT JOIN n ni ON ni.id = x.id LEFT JOIN n nj ON nj.id = y.id GROUP BY x.id, y.id
)"""
    for k in range(1, _K + 1)
)

ORACLES = {
    "sssp": f"{_SSSP} {_DISTANCES}",
    "scheduled_sssp": f"{_SSSP} {_DISTANCES}",
    "sssp_rebuild": f"{_SSSP} {_DISTANCES}",
    "snapshot_restore": f"{_SSSP} {_DISTANCES}",
    "incr_sssp": f"{_SSSP_G} {_DISTANCES_G}",
    "widest_path": f"{_WIDE} {_widths('v')}",
    "incr_widest": f"{_WIDE_G} {_widths('gv')}",
    "scan_adjacency": f"WITH {_HANDOFF} SELECT src AS id, count(*) AS n, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS ends FROM e GROUP BY src",
    "out_degree": f"WITH {_HANDOFF} SELECT src AS id, count(*) AS degree FROM e GROUP BY src",
    "in_neighbors": f"WITH {_HANDOFF} SELECT dst AS id, string_agg(src::VARCHAR, ' ' ORDER BY src) AS sources FROM e GROUP BY dst",
    "invert_graph": f"WITH {_HANDOFF} SELECT dst AS src, src AS dst, weight FROM e",
    "normalize_weights": f"WITH {_TRADE} SELECT src, dst, round(weight, 9) AS weight FROM e",
    "symmetrize": f"WITH {_HANDOFF} SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY 1, 2",
    "inject_loops": f"WITH {_HANDOFF} SELECT src, dst, weight FROM e UNION ALL SELECT id, id, 0::DOUBLE FROM v",
    "sssp_critical_edges": f"{_SSSP} SELECT e.src, e.dst FROM e JOIN d a ON a.k = e.src JOIN d b ON b.k = e.dst WHERE b.v = a.v + e.weight",
    "widest_critical_edges": f"{_WIDE} SELECT e.src, e.dst FROM e JOIN d a ON a.k = e.src JOIN d b ON b.k = e.dst WHERE b.v = e.weight",
    "cc_max_label": f"WITH RECURSIVE {_HANDOFF}, {_least('e', 'SELECT id AS k, id AS v FROM v', 'd.v', 'max', '>')} SELECT k AS id, v AS label FROM d",
    "cc_min_label": f"WITH RECURSIVE {_HANDOFF}, {_least('e', 'SELECT id AS k, id AS v FROM v', 'd.v', 'min', '<')} SELECT k AS id, v AS label FROM d",
    "incr_cc": f"WITH RECURSIVE {_HANDOFF}, {_least('g', 'SELECT id AS k, id AS v FROM gv', 'd.v', 'max', '>')} SELECT k AS id, v AS label FROM d",
    "wcc": f"WITH RECURSIVE {_SUPPLIES}, {_least('y', 'SELECT id AS k, id AS v FROM yv', 'd.v', 'max', '>')} SELECT k AS id, v AS label FROM d",
    "min_in_edge": f"WITH {_HANDOFF} SELECT dst AS id, min(weight) AS value FROM e GROUP BY dst",
    "pagerank_k": _sums(_PR, "0.2", "0.8 * d.delta / x.n"),
    "pagerank_power": f"""WITH RECURSIVE {_PR}, d(i, k, r) AS (
  SELECT 0, id, 1::DOUBLE FROM v UNION ALL
  SELECT a.i + 1, a.k, 0.2 + coalesce((SELECT sum(0.8 * s.r / x.n) FROM d s JOIN x ON x.src = s.k WHERE x.dst = a.k), 0) FROM d a WHERE a.i < {ROUNDS}
) SELECT k AS id, round(r, 6) AS value FROM d WHERE i = {ROUNDS}""",
    "jacobi_k": _sums(_TRADE + ", x AS (SELECT src, dst, weight * 0.5 AS w FROM e WHERE src <> dst)", "0.2", "-x.w * d.delta"),
    "markov_k": _sums(
        """n AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)),
p AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
c AS (SELECT x.k AS src, y.k AS dst, count(*)::DOUBLE AS w FROM p JOIN n x ON x.event_type = a JOIN n y ON y.event_type = b GROUP BY 1, 2),
x AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM c), v AS (SELECT src AS id FROM x UNION SELECT dst FROM x)""",
        "1", "x.w * d.delta",
    ),
    "adsorption_k": _sums(_TRADE, "CASE WHEN id < 8 THEN 10 ELSE 0 END", "x.weight * d.delta * 0.1", "e"),
    "katz_k": _sums(
        """c AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000000 AS b FROM lineitem),
x AS (SELECT a AS src, b AS dst FROM c UNION ALL SELECT b, a FROM c), v AS (SELECT DISTINCT src AS id FROM x)""",
        "CASE WHEN id = 1 THEN 1e6 ELSE 0 END", "d.delta * 0.002", "x", 4,
    ),
    "simrank_k": f"""WITH {_TRADE.replace("v AS (", "tv AS (")}, v AS (SELECT src AS id FROM b UNION SELECT dst FROM b), n AS (SELECT dst AS id, count(*) AS n FROM b GROUP BY dst),
s0 AS (SELECT id AS a, id AS b, 1::DOUBLE AS value FROM v){_SIM}
SELECT a, b, round(value, 6) AS value FROM s{_K} WHERE a < b AND value > 0""",
    "apply_changes": f"WITH {_HANDOFF} SELECT src, dst, weight FROM g",
    "split_changes": f"WITH {_HANDOFF} SELECT CASE WHEN type IN ('A', 'D') THEN 'good' ELSE 'bad' END AS side, type, count(*) AS n, sum(weight) AS weight FROM ch GROUP BY 1, 2",
    "incr_pagerank": f"""WITH RECURSIVE {_HANDOFF}, x AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM g), d(k, delta, i) AS (
  SELECT id, 0.5::DOUBLE, 0 FROM gv UNION ALL
  SELECT x.dst, sum(0.5 * d.delta / x.n), d.i + 1 FROM d JOIN x ON x.src = d.k WHERE d.i < 50 GROUP BY x.dst, d.i + 1
) SELECT k AS id, round(sum(delta), 4) AS value FROM d GROUP BY k""",
    "pending_filter": f"{_THREE} SELECT id, delta, CASE WHEN isfinite(value) THEN value END AS value FROM s WHERE delta < value",
    "top_portion": f"""WITH RECURSIVE {_PR}, {_pr_at(2)} SELECT id FROM p2 WHERE round(delta, 9) <> 0
ORDER BY abs(round(delta, 9)) DESC, id LIMIT (SELECT greatest(1, count(*) // 100) FROM v)""",
    "priority_policies": f"""{_THREE}, o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY src), q AS (
  SELECT id, delta, CASE WHEN isfinite(value) THEN value END AS value, CASE WHEN delta < value THEN delta ELSE 2 * delta END AS p FROM s WHERE isfinite(delta))
SELECT id, p AS by_value, delta - value AS by_difference, p * n AS by_degree, -delta AS eager FROM q JOIN o USING (id)""",
    "term_report": f"{_SSSP} SELECT (SELECT sum(v) FROM d) AS total, (SELECT count(*) FROM v) - (SELECT count(*) FROM d) AS unknown, 0::BIGINT AS pending, (SELECT count(*) FROM v) AS rows",
    "remembered_best": f"{_SSSP} SELECT e.dst AS id, min(d.v + e.weight) AS value, arg_min(e.src, (d.v + e.weight) * 1e6 + e.src) AS best_from FROM e JOIN d ON d.k = e.src GROUP BY e.dst",
    "forget_contributions": f"{_SSSP} SELECT e.dst AS id, min(d.v + e.weight) AS value, arg_min(e.src, (d.v + e.weight) * 1e6 + e.src) AS best_from FROM e JOIN d ON d.k = e.src WHERE e.src % 3 <> 0 GROUP BY e.dst",
    "upsert_state": """SELECT coalesce(c_custkey, s_suppkey * 20) AS id, c_acctbal AS delta, coalesce(s_acctbal, CASE WHEN c_custkey IS NOT NULL THEN 0::DOUBLE END) AS value
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20""",
    "accumulate_state": "SELECT c_custkey AS id, greatest(0::DOUBLE, coalesce(max(o_totalprice), 0)) AS delta FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "get_state": "SELECT s_suppkey * 40 AS id, c_custkey IS NOT NULL AS present, c_acctbal AS value FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 40",
    "compare_results": f"WITH RECURSIVE {_HANDOFF}, {_least('e', _ZERO)}, {_least('g', _ZERO).replace('d(k', 'd9(k').replace('FROM d JOIN', 'FROM d9 d JOIN').replace('recurring.d c', 'recurring.d9 c')}"
    """, l AS (SELECT id, coalesce(v, 'inf'::DOUBLE) AS v FROM v LEFT JOIN d ON k = id), r AS (SELECT id, coalesce(v, 'inf'::DOUBLE) AS v FROM gv LEFT JOIN d9 ON k = id), j AS (
  SELECT l.id IS NULL OR r.id IS NULL AS alone, isfinite(l.v) <> isfinite(r.v) AS one, CASE WHEN isfinite(l.v) AND isfinite(r.v) THEN abs(l.v - r.v) END AS gap
  FROM l FULL JOIN r USING (id))
SELECT count(*) FILTER (gap > 1e-6) AS n_different, coalesce(sum(gap), 0) AS sum_difference, coalesce(max(gap), 0) AS max_difference,
  count(*) FILTER (NOT alone AND one) AS n_infinite_on_one_side, count(*) FILTER (alone) AS n_on_one_side FROM j""",
    "error_stats": f"""WITH RECURSIVE {_PR}, {_pr_at(4)}, {_pr_at(6)}, j AS (SELECT p4.value - p6.value AS g FROM p4 JOIN p6 USING (id))
SELECT round(min(g), 6) AS min_error, round(max(g), 6) AS max_error, round(avg(g), 6) AS mean_error, round(sqrt(avg(g * g)), 6) AS rms_error FROM j""",
    "different_neighbors": f"""WITH {_HANDOFF} SELECT dst, src, 'left' AS side FROM e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.src = e.src AND g.dst = e.dst)
UNION ALL SELECT dst, src, 'right' FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE g.src = e.src AND g.dst = e.dst)""",
    "weight_histogram": "SELECT floor(ln(l_quantity::DOUBLE) / ln(2))::BIGINT AS bucket, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1",
    "partition_contract": f"WITH {_HANDOFF} SELECT (id % 8)::INTEGER AS part, count(*) AS n FROM v GROUP BY 1",
    "scan_unweighted": f"WITH {_HANDOFF} SELECT id, count(dst) AS n, coalesce(string_agg(dst::VARCHAR, ' ' ORDER BY dst), '') AS ends FROM v LEFT JOIN e ON src = id GROUP BY id",
    "result_files": f"{_SSSP} SELECT id, v AS value, v AS delta FROM v LEFT JOIN d ON k = id",
    "result_summary": f"{_SSSP} SELECT sum(v) AS sum_delta, count(*) FILTER (v IS NULL) AS n_no_delta, sum(v) AS sum_value, count(*) FILTER (v IS NULL) AS n_no_value FROM v LEFT JOIN d ON k = id",
    "change_files": f"WITH {_HANDOFF} SELECT type, src, dst, weight FROM ch UNION ALL SELECT type, dst, src, weight FROM ch",
    "neighbor_files": f"{_SSSP} SELECT e.dst, e.src, d.v + e.weight AS contrib FROM e JOIN d ON d.k = e.src",
    "part_files": f"""WITH {_HANDOFF} SELECT (id % 8)::INTEGER AS part, count(*) AS n, 8 AS parts FROM v GROUP BY 1
UNION ALL SELECT (id % 5)::INTEGER, count(*), 5 FROM v GROUP BY 1""",
    "routed_scan": f"WITH {_HANDOFF} SELECT src, dst, weight FROM e WHERE src % 8 = src % 5",
    "partition_rules": f"WITH {_HANDOFF} SELECT (src % 6)::INTEGER AS part, count(*) AS n, unnest(['pair', 'mod']) AS rule FROM e GROUP BY src % 6",
    "accumulate_sum": """SELECT c_custkey AS id, 1 + coalesce(sum(o_orderkey % 13), 0)::DOUBLE AS delta, coalesce(sum(o_orderkey % 13), 0)::DOUBLE AS value
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "priority_accumulative": f"""WITH RECURSIVE {_TRADE}, x AS (SELECT src, dst, weight * 0.5 AS w FROM e WHERE src <> dst), d(k, delta, i) AS (
  SELECT id, 0.2::DOUBLE, 0 FROM v UNION ALL SELECT x.dst, sum(-x.w * d.delta), d.i + 1 FROM d JOIN x ON x.src = d.k WHERE d.i < 3 GROUP BY x.dst, d.i + 1
), p AS (SELECT k AS id, sum(CASE WHEN i < 3 THEN delta ELSE 0 END) AS value, sum(CASE WHEN i = 3 THEN delta ELSE 0 END) AS delta FROM d GROUP BY k), o AS (SELECT src AS id, count(*) AS n FROM x GROUP BY src)
SELECT id, round(CASE WHEN delta < 0 THEN value ELSE 2 * value END, 6) AS by_value, round(delta, 6) AS by_difference,
  round(CASE WHEN delta < 0 THEN value ELSE 2 * value END * n, 6) AS by_degree, round(abs(delta), 6) AS eager FROM p JOIN o USING (id)""",
    "stop_rules": f"""WITH RECURSIVE {_PR}, d(k, delta, i) AS (
  SELECT id, 0.2::DOUBLE, 0 FROM v UNION ALL SELECT x.dst, sum(0.8 * d.delta / x.n), d.i + 1 FROM d JOIN x ON x.src = d.k WHERE d.i < 30 GROUP BY x.dst, d.i + 1
), n AS (SELECT range AS r FROM range(0, 31)), s AS (
  SELECT r, id, coalesce(sum(delta), 0) AS value FROM n CROSS JOIN v LEFT JOIN d ON k = id AND i < r GROUP BY r, id
), t AS (SELECT r, sum(value) AS total, sum(value * value) AS squares, count(*) FILTER (value = 0) AS unknown FROM s GROUP BY r), c AS (
  SELECT *, lag(total) OVER (ORDER BY r) AS t0, lag(squares) OVER (ORDER BY r) AS s0, lag(unknown) OVER (ORDER BY r) AS u0 FROM t
), stops AS (
  SELECT 'diff' AS rule, min(r) AS r FROM c WHERE unknown = 0 AND u0 = 0 AND abs(total - t0) <= 50
  UNION ALL SELECT 'sum', min(r) FROM c WHERE total >= 900 UNION ALL SELECT 'squares', min(r) FROM c WHERE abs(squares - s0) < 60
) SELECT rule, stops.r::INTEGER AS rounds, round(total, 4) AS total FROM stops JOIN t USING (r)""",
    "stop_by_pairs": f"""{_WALKS}, stops AS (
  SELECT least((SELECT min(r) FROM m WHERE pending = 0), (SELECT min(r) FROM (SELECT *, lag(unknown) OVER (ORDER BY r) AS u0, lag(total) OVER (ORDER BY r) AS t0 FROM m) WHERE unknown = u0 AND abs(total - t0) < 1e-6)) AS r
) SELECT id, value, r::INTEGER AS rounds FROM s JOIN stops USING (r)""",
    "superstep_metrics": f"{_WALKS} SELECT r::INTEGER AS round, pending, unknown, rows, total FROM m WHERE r <= 6",
    "power_until": f"""WITH RECURSIVE {_PR}, d(i, k, r) AS (
  SELECT 0, id, 1::DOUBLE FROM v UNION ALL
  SELECT a.i + 1, a.k, 0.2 + coalesce((SELECT sum(0.8 * s.r / x.n) FROM d s JOIN x ON x.src = s.k WHERE x.dst = a.k), 0) FROM d a WHERE a.i < 30
), t AS (SELECT i, sum(r) AS total FROM d GROUP BY i), stops AS (SELECT min(i) AS i FROM (SELECT i, abs(total - lag(total) OVER (ORDER BY i)) AS moved FROM t) WHERE moved <= 20)
SELECT k AS id, round(r, 6) AS value FROM d JOIN stops USING (i)""",
    "neighbor_labels": f"""WITH RECURSIVE {_HANDOFF}, d(k, v, i) AS (
  SELECT id, id, 0 FROM v UNION ALL SELECT e.dst, min(d.v), d.i + 1 FROM d JOIN e ON e.src = d.k WHERE d.i < {ROUNDS} GROUP BY e.dst, d.i + 1
) SELECT k AS id, v AS label FROM d WHERE i = {ROUNDS}""",
    "sssp_supplies": f"WITH RECURSIVE {_SUPPLIES}, {_least('y', 'SELECT 1::BIGINT AS k, 0::DOUBLE AS v', 'd.v + e.weight')} SELECT id, v AS value FROM yv LEFT JOIN d ON k = id",
    "top_portion_cutoff": f"""WITH RECURSIVE {_PR}, {_pr_at(2)} SELECT id FROM p2 WHERE round(delta, 9) <> 0
ORDER BY abs(round(delta, 9)) DESC, id LIMIT (SELECT greatest(1, count(*) // 10) FROM v)""",
    "remembered_sssp": f"""WITH RECURSIVE {_HANDOFF}, gw AS (SELECT e.src, e.dst, coalesce(ch.weight, e.weight) AS weight FROM e LEFT JOIN ch ON ch.src = e.src AND ch.dst = e.dst AND ch.type IN ('I', 'D')),
{_least("gw", _ZERO)}, b AS (SELECT e.dst AS id, min(d.v + e.weight) AS got, arg_min(e.src, (d.v + e.weight) * 1e6 + e.src) AS sender FROM gw e JOIN d ON d.k = e.src GROUP BY e.dst)
SELECT id, v AS value, CASE WHEN id <> 0 THEN sender END AS best_from FROM v LEFT JOIN d ON k = id LEFT JOIN b USING (id)""",
    "scheduled_by_degree": f"{_SSSP} {_DISTANCES}",
    "prepared_deltas": f"""WITH RECURSIVE {_PR}, d(k, delta, i) AS (
  SELECT id, 0.2::DOUBLE, 0 FROM v UNION ALL SELECT x.dst, sum(0.8 * (d.delta * 0.5) / x.n), d.i + 1 FROM d JOIN x ON x.src = d.k WHERE d.i < {ROUNDS} GROUP BY x.dst, d.i + 1
) SELECT k AS id, round(sum(CASE WHEN i < {ROUNDS} THEN delta * 0.5 ELSE 0 END), 6) AS value, round(sum(CASE WHEN i = {ROUNDS} THEN delta ELSE 0 END), 6) AS delta FROM d GROUP BY k""",
    "streamed_sssp": f"{_SSSP_G} {_DISTANCES_G}",
    "unfinished_snapshots": "SELECT s_suppkey AS id, s_acctbal AS value, 2 AS epoch, 1 AS removed FROM supplier",
    "program_files": f"{_SSSP} SELECT id, v AS value, 'first' AS run, true AS timed FROM v LEFT JOIN d ON k = id",
    "generated_graph": _drawn_graph(
        "SELECT count(*) AS n FROM customer", f"least(n, floor(pow(1 - {_u(1535345, chr(39) + 'degree' + chr(39), 'src')}, 1 / (1 - 2.3::DOUBLE))))", 1535345,
        f"round({_u(1535345, chr(39) + 'weight' + chr(39), 'src', 'dst')}, 9)", False,
    ),
    "generated_uniform": _drawn_graph("SELECT count(*) AS n FROM supplier", f"floor({_u(7, chr(39) + 'degree' + chr(39), 'src')} * n)", 7, "1::DOUBLE", True),
    "generated_log_normal": _drawn_graph(
        "SELECT count(*) AS n FROM customer", f"least(least(10000, n), floor(exp({_normal(3, 'degree', 'src')} * 2.3 - 0.5)))", 3,
        f"round(ln(1 + exp({_normal(3, 'weight', 'src', 'dst')} * 0.8 + 0.4)), 6)", False,
    ),
    "generated_changes": _drawn_changes(_SSSP + _critical_rates(0.05, 0.2), _CRITICAL_EDGES.replace("rate *", "0.05 *"), _critical_chances(0.4, 0.2), 1, True),
    "random_changes": _drawn_changes(f"WITH {_HANDOFF}", "SELECT src, dst, weight FROM e", _fixed_chances(0.1, 0.4, 0.5), 2, True),
    "random_unweighted_changes": _drawn_changes(f"WITH {_HANDOFF}", "SELECT src, dst, weight FROM e", _fixed_chances(0.1, 0.4, 0.5), 2, False),
}
ORACLES |= {"label_files": ORACLES["cc_max_label"], "critical_files": ORACLES["sssp_critical_edges"], "simrank_pairs_k": ORACLES["simrank_k"]}
