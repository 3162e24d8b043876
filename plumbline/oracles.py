"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from plumbline.operators.routing import KEYWORDS

_L = "l AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice, l_discount > 0.05 AS on_, CAST(l_discount > 0.05 AS DOUBLE) AS t, l_extendedprice * (1 - l_discount) AS y, l_orderkey * 8 + l_linenumber AS unit FROM lineitem)"
_DIM = """coalesce(avg(y) FILTER (on_), 0) - coalesce(avg(y) FILTER (NOT on_), 0)"""
_SE = """sqrt(var_samp(y) FILTER (on_) / count(*) FILTER (on_) + var_samp(y) FILTER (NOT on_) / count(*) FILTER (NOT on_))"""
_E = "e AS (SELECT *, event_type <> 'error' AS ok FROM events)"
_BETA = "a / (a + b) AS mean, a * b / ((a + b) * (a + b) * (a + b + 1)) AS variance"
_SCORES = ", ".join("(" + " + ".join(f"CAST(contains(said, '{k}') AS INT)" for k in ks) + f") / {len(ks)}.0::DOUBLE AS s{i}" for i, ks in enumerate(KEYWORDS.values()))
_ROUTED = f"""t0 AS (SELECT *, lower(CASE event_type WHEN 'click' THEN 'What is this? Define it, look up how many' WHEN 'view' THEN 'Why did the impact cause this effect' WHEN 'purchase' THEN 'uncertain: explore what if' WHEN 'signup' THEN 'Emergency! outage now' WHEN 'error' THEN 'nothing of note' ELSE '' END) AS said FROM events),
t1 AS (SELECT *, {_SCORES} FROM t0), t2 AS (SELECT *, greatest(s0, s1, s2, s3) AS confidence FROM t1),
r0 AS (SELECT *, CASE confidence WHEN 0 THEN 'Disorder' WHEN s0 THEN 'Clear' WHEN s1 THEN 'Complicated' WHEN s2 THEN 'Complex' ELSE 'Chaotic' END AS domain, CASE WHEN confidence < 0.3 THEN 'Disorder' WHEN confidence = s0 THEN 'Clear' WHEN confidence = s1 THEN 'Complicated' WHEN confidence = s2 THEN 'Complex' ELSE 'Chaotic' END AS target,
  array_to_string(list_transform(list_sort([{{'s': -s0, 'i': 0, 'n': 'Clear'}}, {{'s': -s1, 'i': 1, 'n': 'Complicated'}}, {{'s': -s2, 'i': 2, 'n': 'Complex'}}, {{'s': -s3, 'i': 3, 'n': 'Chaotic'}}]), lambda x: x.n), ',') AS ranked FROM t2),
r AS (SELECT *, CASE target WHEN 'Clear' THEN 'http://clear' WHEN 'Complicated' THEN 'http://complicated' WHEN 'Complex' THEN 'http://complex' WHEN 'Chaotic' THEN 'http://chaotic' END AS url,
  CASE target WHEN 'Clear' THEN 'free' WHEN 'Complicated' THEN 'low' WHEN 'Complex' THEN 'medium' WHEN 'Chaotic' THEN 'high' END AS tier,
  CASE target WHEN 'Complicated' THEN 10 WHEN 'Complex' THEN 50 WHEN 'Chaotic' THEN 200 ELSE 0 END AS cost FROM r0)"""
_MATRIX = _ROUTED + """, m AS (SELECT domain AS predicted, list_extract(['Clear','Complicated','Complex','Chaotic','Disorder'], CAST(abs(floor(value)) % 5 + 1 AS INTEGER)) AS actual, count(*) AS n FROM r GROUP BY 1, 2)"""
_RISK = "CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100"


def _chi(rows: str) -> str:
    z = 1.645211440143815
    return f"""c AS (SELECT sum((o - e) * (o - e) / e) AS chi, count(*) - 1 AS d FROM ({rows})),
k AS (SELECT chi, d, d * pow(1 - 2.0 / (9 * d) + {z} * sqrt(2.0 / (9 * d)), 3) AS crit FROM c)
SELECT round(chi, 6) AS chi2, CAST(d AS BIGINT) AS df, round(crit, 6) AS critical, chi > crit AS biased FROM k"""


_P = 2147483647


def _refute(name: str, refuted: str, passed: str) -> str:
    return f"""WITH {_L}, o AS (SELECT {_DIM} AS ate FROM l), {refuted}
SELECT '{name}' AS test_name, round(o.ate, 3) AS original_effect, round(m.m, 3) AS refuted_effect, {passed} AS passed FROM o, m"""


def _coins(seed: int, reps: int) -> str:
    """h: each line with a hash u below the prime for every replicate."""
    factors = ", ".join("(" + ", ".join(str(x) for x in [r, *(pow(16807, 4 * (1009 * seed + r) + k, _P) for k in range(1, 5))]) + ")" for r in range(reps))
    return f"""f(rep, a, b, c, d) AS (VALUES {factors}),
h0 AS (SELECT l.*, f.*, ((unit % {_P}) * a + ((unit >> 31) % {_P} * b) % {_P} + d) % {_P} AS x0 FROM l, f),
h1 AS (SELECT *, (xor(x0, x0 >> 15) * c) % {_P} AS x1 FROM h0), h AS (SELECT *, (xor(x1, x1 >> 13) * b) % {_P} AS u FROM h1)"""


def _draws(seed: int, reps: int, many: str = "n") -> str:
    """w: the sequential generator's draw u at each line of every replicate, in order; z: how many lines."""
    out = [f"z AS (SELECT count(*) AS n FROM l), g AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice, y, t) - 1 AS i FROM l), g0 AS (SELECT rep, i, rep * {many} + i + 1 AS k, {seed}::HUGEINT AS s FROM g, z, range({reps}) AS x(rep) WHERE i < {many})"]
    mul, inc, bits = 6364136223846793005, 1, 26
    for j in range(bits):
        out.append(f"g{j + 1} AS (SELECT rep, i, k, CASE WHEN (k >> {j}) & 1 = 1 THEN (((s * {mul >> 32}) % 4294967296 * 4294967296 + s * {mul & 0xFFFFFFFF}) % 18446744073709551616 + {inc}::HUGEINT) % 18446744073709551616 ELSE s END AS s FROM g{j})")
        mul, inc = mul * mul % 2**64, inc * (mul + 1) % 2**64
    out.append(f"w AS (SELECT rep, i, CAST((s - s % 8589934592) / 8589934592 AS DOUBLE) / 2147483648 AS u FROM g{bits})")
    return ", ".join(out)


_NODES = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
 UNION ALL SELECT 'c' || c_custkey, 'm' || c_mktsegment FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


SQL = {
    "diff_in_means": f"WITH {_L} SELECT l_returnflag, round({_DIM}, 4) AS ate, round({_SE}, 4) AS std_error, count(*) AS n_obs FROM l GROUP BY 1",
    "ols_adjusted": f"""WITH {_L}, s AS (SELECT l_returnflag, count(*) AS n, covar_pop(t,t)*count(*) AS tt, covar_pop(l_quantity,l_quantity)*count(*) AS xx, covar_pop(t,l_quantity)*count(*) AS tx, covar_pop(t,y)*count(*) AS ty, covar_pop(l_quantity,y)*count(*) AS xy, covar_pop(y,y)*count(*) AS yy FROM l GROUP BY 1),
b AS (SELECT *, (xx*ty - tx*xy)/(tt*xx - tx*tx) AS b1, (tt*xy - tx*ty)/(tt*xx - tx*tx) AS b2 FROM s)
SELECT l_returnflag, round(b1, 3) AS ate, round(sqrt((yy - b1*ty - b2*xy)/(n - 3) * xx/(tt*xx - tx*tx)), 3) AS std_error, n AS n_obs FROM b""",
    "iv_2sls": f"""WITH {_L}, s AS (SELECT l_returnflag, count(*) AS n, covar_pop(l_quantity,l_quantity)*count(*) AS zz, covar_pop(l_quantity,l_extendedprice)*count(*) AS zt, covar_pop(l_quantity,y)*count(*) AS zy, covar_pop(y,y)*count(*) AS yy FROM l GROUP BY 1)
SELECT l_returnflag, round(zy/zt, 6) AS ate, round(sqrt((yy - zy*zy/zz)/(n - 2)/(zt*zt/zz)), 6) AS std_error, n AS n_obs FROM s""",
    "ipw_effect": f"""WITH RECURSIVE {_L}, c AS (SELECT (l_quantity - 25.5)/25 AS x, t, CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy, sum(y*y) AS syy FROM l GROUP BY 1, 2), tot AS (SELECT sum(n) AS n FROM c),
g(i, a, b) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE UNION ALL
  SELECT g.i + 1, g.a + 0.1 * (SELECT sum(c.n * (c.t - 1/(1 + exp(-(g.a + g.b*c.x))))) FROM c) / (SELECT n FROM tot), g.b + 0.1 * (SELECT sum(c.n * c.x * (c.t - 1/(1 + exp(-(g.a + g.b*c.x))))) FROM c) / (SELECT n FROM tot) FROM g WHERE g.i < 100),
p AS (SELECT c.*, least(0.99, greatest(0.01, 1/(1 + exp(-(a + b*x))))) AS e FROM c, g WHERE i = 100),
w AS (SELECT *, CASE WHEN t > 0.5 THEN 1/e ELSE 1/(1 - e) END AS w FROM p),
m AS (SELECT sum(w*sy) FILTER (t > 0.5)/sum(w*n) FILTER (t > 0.5) - sum(w*sy) FILTER (t <= 0.5)/sum(w*n) FILTER (t <= 0.5) AS ate FROM w)
SELECT round(any_value(ate), 2) AS ate, round(sqrt(sum(w*w*syy - 2*ate*CASE WHEN t > 0.5 THEN w ELSE -w END*sy + n*ate*ate)/(sum(n)*(sum(n) - 1))), 2) AS std_error, CAST(sum(n) AS BIGINT) AS n_obs FROM w, m""",
    "counterfactual_units": f"""WITH {_L}, g AS (SELECT l_returnflag, {_DIM} AS ate, {_SE} AS se FROM l GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(y - ate*t, 4) AS cf_outcome, round(t*se, 4) AS cf_se, round(y - ate*t - 1.96*t*se, 4) AS lower, round(y - ate*t + 1.96*t*se, 4) AS upper FROM l JOIN g USING (l_returnflag)""",
    "placebo_refute": _refute("placebo_treatment", _coins(42, 1) + ", m AS (SELECT coalesce(avg(y) FILTER (u % 2 = 1), 0) - coalesce(avg(y) FILTER (u % 2 = 0), 0) AS m FROM h)", "abs(m.m) < 1000"),
    "subset_refute": _refute("subset_validation", _coins(456, 10) + f", m AS (SELECT avg(a) AS m FROM (SELECT {_DIM} AS a FROM h WHERE u < {int(0.8 * _P)} GROUP BY rep))", "abs(m.m - o.ate)/abs(o.ate) < 0.2"),
    "random_common_cause_refute": _refute("random_common_cause", _coins(123, 10) + f""", s AS (SELECT rep, covar_pop(t,t) AS tt, covar_pop(x,x) AS xx, covar_pop(t,x) AS tx, covar_pop(t,y) AS ty, covar_pop(x,y) AS xy FROM (SELECT rep, t, y, u * (2.0::DOUBLE / {_P}) - 1 AS x FROM h) GROUP BY rep),
m AS (SELECT avg((xx*ty - tx*xy)/(tt*xx - tx*tx)) AS m FROM s)""", "abs(m.m - o.ate)/abs(o.ate) < 0.15"),
    "placebo_sequential": _refute("placebo_treatment", _draws(42, 1) + ", m AS (SELECT coalesce(avg(y) FILTER (u < 0.5), 0) - coalesce(avg(y) FILTER (u >= 0.5), 0) AS m FROM g JOIN w USING (i))", "abs(m.m) < 1000"),
    "common_cause_sequential": _refute("random_common_cause", _draws(123, 10) + """, s AS (SELECT rep, covar_pop(t,t) AS tt, covar_pop(x,x) AS xx, covar_pop(t,x) AS tx, covar_pop(t,y) AS ty, covar_pop(x,y) AS xy FROM (SELECT rep, t, y, 2 * u - 1 AS x FROM g JOIN w USING (i)) GROUP BY rep),
m AS (SELECT avg((xx*ty - tx*xy)/(tt*xx - tx*tx)) AS m FROM s)""", "abs(m.m - o.ate)/abs(o.ate) < 0.15"),
    "bootstrap_sequential": _refute("bootstrap_refutation", _draws(789, 20) + f", m AS (SELECT avg(a) AS m FROM (SELECT {_DIM} AS a FROM (SELECT rep, CAST(floor(u * n) AS BIGINT) % n AS i FROM w, z) JOIN g USING (i) GROUP BY rep))", "abs(m.m - o.ate)/abs(o.ate) < 0.2"),
    "study_estimate": "",
    "graph_reachable": f"""WITH RECURSIVE {_NODES}, c(node, depth) AS (SELECT x, 0 FROM (VALUES ('r0'), ('r1')) AS t(x) UNION SELECT e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.node)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM c GROUP BY node""",
    "graph_ancestors": f"""WITH RECURSIVE {_NODES}, c(seed, node) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey FROM orders UNION SELECT c.seed, e.src FROM c JOIN e ON e.dst = c.node)
SELECT seed, node FROM c""",
    "graph_adjustment": f"""WITH RECURSIVE {_NODES}, b AS (SELECT * FROM e UNION ALL SELECT DISTINCT 'm' || c_mktsegment, 'r0' FROM customer),
c(seed, node) AS (SELECT DISTINCT src, dst FROM b WHERE src LIKE 'm%' OR src LIKE 'o%' UNION SELECT c.seed, b.dst FROM c JOIN b ON b.src = c.node)
SELECT DISTINCT dst AS question, src AS node FROM b WHERE (dst LIKE 'o%' OR dst LIKE 'm%') AND NOT EXISTS (SELECT 1 FROM c WHERE c.seed = b.dst AND c.node = b.src)""",
    "graph_separated": f"""WITH RECURSIVE {_NODES.replace(" UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders", "")},
q AS (SELECT s_suppkey AS question, 's' || s_suppkey AS x, 'c' || c_custkey AS y, 'n' || s_nationkey AS nation, 'm' || c_mktsegment AS segment FROM supplier JOIN customer ON s_suppkey = c_custkey),
g AS (SELECT question, nation AS node FROM q WHERE question % 4 IN (1, 3) UNION SELECT question, segment FROM q WHERE question % 4 >= 2),
a(question, node) AS (SELECT question, node FROM g UNION SELECT a.question, e.src FROM a JOIN e ON e.dst = a.node),
s(question, node, way) AS (SELECT question, x, w FROM q, (VALUES ('up'), ('down')) AS t(w)
  UNION SELECT n.question, CASE WHEN d.w = 'up' THEN e.src ELSE e.dst END, d.w FROM (SELECT s.*, g.node IS NOT NULL AS shut, a.node IS NOT NULL AS lifts FROM s LEFT JOIN g ON g.question = s.question AND g.node = s.node LEFT JOIN a ON a.question = s.question AND a.node = s.node) n,
    (VALUES ('up'), ('down')) AS d(w), e WHERE n.node = CASE WHEN d.w = 'up' THEN e.dst ELSE e.src END AND ((d.w = 'down' AND NOT shut) OR (d.w = 'up' AND CASE WHEN n.way = 'up' THEN NOT shut ELSE lifts END)))
SELECT q.question, q.x, q.y, count(s.node) = 0 AS separated FROM q LEFT JOIN s ON s.question = q.question AND s.node = q.y GROUP BY ALL""",
    "belief_categorical": """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS entity, event_type AS k, event_id % 7 <> 0 AS fits FROM events),
s AS (SELECT entity, 1.0::DOUBLE + count(*) FILTER (fits AND k = 'click') AS p1, 2.0::DOUBLE + 10 * count(*) FILTER (fits AND k = 'purchase') AS b, 0.5::DOUBLE + count(*) FILTER (fits AND k = 'view') AS v, count(*) FILTER (k <> 'error') AS observation_count, count(*) FILTER (k = 'error') AS mismatches FROM c GROUP BY 1),
m AS (SELECT *, p1/(p1 + b + v) AS mean, p1*(b + v)/((p1 + b + v)*(p1 + b + v)*(p1 + b + v + 1)) AS variance FROM s)
SELECT entity, p1, b + v AS p2, round(mean, 9) AS mean, round(variance, 9) AS variance, round(greatest(mean - 1.96*sqrt(variance), 0), 9) AS lower, round(least(mean + 1.96*sqrt(variance), 1), 9) AS upper, observation_count, mismatches, b AS alpha_purchase, v AS alpha_view FROM m""",
    "unreliable_tools": f"WITH {_E}, s AS (SELECT user_id AS tool, (count(*) FILTER (ok) + 1.0::DOUBLE)/(count(*) + 2) AS r FROM e GROUP BY 1) SELECT tool, round(r, 9) AS reliability FROM s WHERE NOT r > 0.8",
    "registered_tools": f"""WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e), z AS (SELECT user_id, max(i) FILTER (ok) AS z FROM n GROUP BY 1),
s AS (SELECT user_id, count(*) FILTER (ok) AS ok, count(*) AS total, count(*) FILTER (NOT ok AND i > coalesce(z, 0)) AS late FROM n JOIN z USING (user_id) GROUP BY 1)
SELECT c_custkey AS tool, round((coalesce(ok, 0) + 1.0::DOUBLE)/(coalesce(total, 0) + 2), 9) AS reliability, coalesce(total, 0) AS total_calls, coalesce(late, 0) AS recent_failures FROM customer LEFT JOIN s ON user_id = c_custkey""",
    "policy_text": """WITH k AS (SELECT event_id, event_type AS kind, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
a AS (SELECT event_id, coalesce(kind = 'view', false) OR coalesce(kind IN ('click', 'signup') AND NOT coalesce(k > 60, false), false) OR coalesce(kind = 'purchase' AND k < 40 AND k <> 7, false) AS allow FROM k)
SELECT event_id, CASE WHEN allow THEN 'approve' ELSE 'reject' END AS decision, CASE WHEN NOT allow THEN 'Rego policy denied the action' END AS reason FROM a""",
    "rate_limits_reset": """WITH RECURSIVE m AS (SELECT *, sum(CAST(event_type = 'signup' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM events),
n AS (SELECT event_id, user_id, CAST(epoch AS BIGINT) AS epoch, epoch_us(ts)/1000000.0::DOUBLE AS now_, row_number() OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) AS i FROM m WHERE event_type <> 'signup'),
f(event_id, user_id, epoch, i, at_, had, allowed) AS (SELECT event_id, user_id, epoch, i, now_, 3.0::DOUBLE, true FROM n WHERE i = 1
 UNION ALL SELECT n.event_id, n.user_id, n.epoch, n.i, n.now_, least(3.0, f.had - CAST(f.allowed AS INT) + (n.now_ - f.at_)*0.00002::DOUBLE), least(3.0, f.had - CAST(f.allowed AS INT) + (n.now_ - f.at_)*0.00002::DOUBLE) >= 1 FROM f JOIN n ON n.user_id = f.user_id AND n.epoch = f.epoch AND n.i = f.i + 1)
SELECT event_id, epoch, allowed, CASE WHEN allowed THEN CAST(floor(had - 1) AS BIGINT) ELSE 0 END AS remaining FROM f""",
    "bias_distribution": "WITH n AS (SELECT event_type, CAST(count(*) FILTER (day(ts) > 15) AS DOUBLE) AS o, CAST(count(*) FILTER (day(ts) <= 15) AS DOUBLE) AS f FROM events GROUP BY 1), " + _chi("SELECT o, greatest(CASE WHEN event_type = 'error' THEN 1.0 ELSE f END, 1e-10) AS e FROM n"),
    "budget_reset": f"""WITH {_ROUTED}, m AS (SELECT *, CAST(sum(CAST(event_type = 'signup' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM r),
s AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM m WHERE event_type <> 'signup')
SELECT event_id, epoch, CAST(cost AS BIGINT) AS cost_mills, spent AS spent_mills, spent <= 100 AS within FROM s""",
    "session_reclassified": f"""WITH {_ROUTED}, k AS (SELECT user_id, ts, event_id, 0 AS late, domain, confidence, {_RISK} AS risk FROM r UNION ALL SELECT user_id, ts, event_id, 1, 'Disorder', 0.9, NULL FROM r WHERE event_type = 'error'),
s AS (SELECT user_id AS session, count(*) AS depth, arg_max(domain, (ts, event_id, late)) AS domain, arg_max(confidence, (ts, event_id, late)) AS confidence, coalesce(bool_or(risk >= 0.95), false) AS has_rejection, coalesce(bool_or(risk >= 0.5 AND risk < 0.95), false) AS up FROM k GROUP BY 1)
SELECT session, depth, domain, round(confidence, 9) AS confidence, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence > 0 THEN 'low' ELSE 'unknown' END AS level, has_rejection, up OR domain = 'Disorder' AS requires_human FROM s""",
    "session_reasoning": "SELECT user_id AS session, string_agg(event_type, ',' ORDER BY ts, event_id) AS log FROM events WHERE event_type <> 'view' GROUP BY 1",
    "beta_posterior": f"""WITH {_E}, s AS (SELECT user_id, count(*) FILTER (ok) + 1.0::DOUBLE AS a, count(*) FILTER (NOT ok) + 1.0::DOUBLE AS b FROM e GROUP BY 1), m AS (SELECT *, {_BETA} FROM s)
SELECT user_id, a AS alpha, b AS beta, round(mean, 9) AS mean, round(variance, 9) AS variance, round(CASE WHEN a > 1 AND b > 1 THEN (a - 1)/(a + b - 2) ELSE mean END, 9) AS mode, round(greatest(mean - 1.96*sqrt(variance), 0), 9) AS lower, round(least(mean + 1.96*sqrt(variance), 1), 9) AS upper FROM m""",
    "normal_posterior": """WITH s AS (SELECT user_id, count(value) AS n, coalesce(sum(value), 0) AS s FROM events GROUP BY 1), p AS (SELECT user_id, (s/25)/(0.01 + n/25) AS mean, 1/(0.01 + n/25) AS v FROM s)
SELECT user_id, round(mean, 6) AS mean, round(v, 6) AS variance, round(mean - 1.96*sqrt(v), 6) AS lower, round(mean + 1.96*sqrt(v), 6) AS upper FROM p""",
    "gamma_posterior": """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, CAST(sum(n) + 1 AS DOUBLE) AS a, CAST(count(*) + 1 AS DOUBLE) AS b FROM p GROUP BY 1)
SELECT user_id, a AS alpha, b AS beta, round(a/b, 9) AS mean, round(a/(b*b), 9) AS variance FROM s""",
    "dirichlet_posterior": """WITH u AS (SELECT DISTINCT user_id FROM events), k(category) AS (VALUES ('click'),('error'),('purchase'),('signup'),('view')),
a AS (SELECT u.user_id, k.category, CAST((SELECT count(*) FROM events e WHERE e.user_id = u.user_id AND e.event_type = k.category) + 1 AS DOUBLE) AS a FROM u, k), t AS (SELECT *, sum(a) OVER (PARTITION BY user_id) AS s, min(a) OVER (PARTITION BY user_id) AS least_a FROM a)
SELECT user_id, category, a AS alpha, round(a/s, 9) AS mean, round(CASE WHEN least_a > 1 THEN (a - 1)/(s - 5) ELSE a/s END, 9) AS mode, round(a*(s - a)/(s*s*(s + 1)), 9) AS variance FROM t""",
    "belief_running": f"""WITH {_E}, s AS (SELECT event_id, 1.0::DOUBLE + sum(CAST(ok AS INT)) OVER w AS a, 1.0::DOUBLE + sum(CAST(NOT ok AS INT)) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), m AS (SELECT event_id, {_BETA} FROM s)
SELECT event_id, round(mean, 9) AS running_mean, round(variance, 9) AS running_variance, variance < 0.005 AS confident FROM m""",
    "belief_tracked": f"""WITH {_E}, s AS (SELECT CAST(user_id AS VARCHAR) AS entity, 1.0::DOUBLE + count(*) FILTER (event_id % 10 <> 0 AND ok) AS p1, 1.0::DOUBLE + count(*) FILTER (event_id % 10 <> 0 AND NOT ok) AS p2, count(*) FILTER (event_id % 10 <> 0) AS observation_count, count(*) FILTER (event_id % 10 = 0) AS mismatches FROM e GROUP BY 1)
SELECT entity, p1, p2, round(p1/(p1 + p2), 9) AS mean, observation_count, mismatches FROM s""",
    "belief_batch": f"""WITH {_E} SELECT CAST(user_id AS VARCHAR) AS entity, count(*) AS applied FROM e WHERE event_id < coalesce((SELECT min(event_id) FROM e x WHERE x.user_id = e.user_id AND NOT x.ok), 9223372036854775807) GROUP BY 1""",
    "tool_reliability": f"""WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e), z AS (SELECT user_id, max(i) FILTER (ok) AS z FROM n GROUP BY 1),
s AS (SELECT n.user_id, count(*) FILTER (ok) + 1.0::DOUBLE AS a, count(*) FILTER (NOT ok) + 1.0::DOUBLE AS b, count(*) AS total_calls, count(*) FILTER (NOT ok AND i > coalesce(z, 0)) AS recent_failures FROM n JOIN z USING (user_id) GROUP BY 1), m AS (SELECT *, {_BETA} FROM s),
c AS (SELECT *, greatest(mean - 1.96*sqrt(variance), 0) AS lo FROM m)
SELECT user_id, round(mean, 9) AS reliability, round(lo, 9) AS lower, round(least(mean + 1.96*sqrt(variance), 1), 9) AS upper, total_calls, recent_failures, mean > 0.8 AS is_reliable, lo < 0.8 AS should_break, round((b - 1)/total_calls, 9) AS failure_rate, round((b - 1)/total_calls, 9) AS frequency FROM c""",
    "most_reliable_tool": f"WITH {_E}, s AS (SELECT user_id AS tool, (count(*) FILTER (ok) + 1.0::DOUBLE)/(count(*) + 2) AS r FROM e GROUP BY 1) SELECT tool FROM s ORDER BY r DESC, tool LIMIT 1",
    "policy_decisions": f"""WITH k AS (SELECT event_id, event_type, {_RISK} AS r FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'reject' WHEN r >= 0.8 THEN 'reject' WHEN r >= 0.5 THEN 'escalate' ELSE 'approve' END AS decision,
CASE WHEN event_type = 'error' THEN 'errors are denied' WHEN r >= 0.8 THEN 'Risk score ' || printf('%.3f', r) || ' exceeds reject threshold 0.800' END AS reason,
CASE WHEN event_type <> 'error' AND r >= 0.5 AND r < 0.8 THEN 'role:reviewer' END AS target FROM k""",
    "breaker_states": f"""WITH {_E}, i AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e),
f AS (SELECT *, CAST(sum(CAST(NOT ok AS INT)) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM i),
p AS (SELECT *, coalesce(lag(failures >= 2) OVER w, false) AS was, max(CASE WHEN NOT ok THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lf FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, failures, failures >= 2 AS is_open, NOT was OR coalesce(epoch_us(ts) - epoch_us(lf) >= 43200000000, false) AS allowed FROM p""",
    "loop_checks": """WITH v AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS visits, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b, lag(event_type, 3) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, coalesce(event_type = b AND a = c AND event_type <> a, false) AS alt FROM v)
SELECT event_id, visits, CASE WHEN visits > 15 THEN 'overvisit' WHEN alt THEN 'alternation' END AS violation, CASE WHEN visits > 15 THEN visits WHEN alt THEN 2::BIGINT END AS observed FROM k""",
    "visit_history": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)
SELECT user_id, string_agg(event_type, ',' ORDER BY i DESC) FILTER (i <= 8) AS history, count(*) AS total FROM n GROUP BY 1""",
    "rate_limits": """WITH RECURSIVE n AS (SELECT event_id, user_id, epoch_us(ts)/1000000.0::DOUBLE AS now_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(event_id, user_id, i, at_, had, allowed) AS (SELECT event_id, user_id, i, now_, 3.0::DOUBLE, true FROM n WHERE i = 1
 UNION ALL SELECT n.event_id, n.user_id, n.i, n.now_, least(3.0, f.had - CAST(f.allowed AS INT) + (n.now_ - f.at_)*0.00002::DOUBLE), least(3.0, f.had - CAST(f.allowed AS INT) + (n.now_ - f.at_)*0.00002::DOUBLE) >= 1 FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT event_id, allowed, CASE WHEN allowed THEN CAST(floor(had - 1) AS BIGINT) ELSE 0 END AS remaining FROM f""",
    "escalation_status": """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN CASE WHEN epoch_us(TIMESTAMP '1998-06-01') - epoch_us(CAST(o_orderdate AS TIMESTAMP)) >= 31536000000000 THEN 'timed_out' ELSE 'pending' END ELSE 'rejected' END AS status, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS "by" FROM orders""",
    "audit_recent": f"""WITH k AS (SELECT CAST(event_id AS VARCHAR) AS id, ts AS "timestamp", event_type AS action, {_RISK} AS r FROM events)
SELECT id, "timestamp", action, CASE WHEN r >= 0.8 THEN 'reject' WHEN r >= 0.5 THEN 'escalate' ELSE 'approve' END AS decision FROM k ORDER BY "timestamp" DESC, id DESC LIMIT 20""",
    "bias_uniformity": "WITH n AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS o FROM events GROUP BY 1), " + _chi("SELECT o, avg(o) OVER () AS e FROM n"),
    "bias_approval": "WITH g AS (SELECT c_mktsegment, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), " + _chi("SELECT o, n * sum(o) OVER () / sum(n) OVER () AS e FROM g"),
    "route_queries": f"""WITH {_ROUTED} SELECT event_id, domain, round(confidence, 9) AS confidence, confidence >= 0.3 AS confident, url, tier,
ranked FROM r""",
    "budget_running": f"""WITH {_ROUTED}, s AS (SELECT *, CAST(sum(cost) OVER (ORDER BY event_id) AS BIGINT) AS spent FROM r)
SELECT event_id, CAST(cost AS BIGINT) AS cost_mills, spent AS spent_mills, spent <= 20000 AS within, greatest(spent - 20000, 0) AS overage_mills, CASE WHEN spent > 20000 THEN 'free' END AS suggested_tier, CASE WHEN spent <= 20000 THEN url ELSE 'http://clear' END AS final_url FROM s""",
    "budget_tiers": f"WITH {_ROUTED} SELECT tier, count(*) AS routes, CAST(sum(cost) AS BIGINT) AS spent_mills, round(sum(cost)/count(*), 9) AS average_mills, round(sum(cost)/20000, 9) AS utilization FROM r GROUP BY 1",
    "confusion": f"WITH {_MATRIX} SELECT predicted, actual, n FROM m",
    "precision_recall": f"""WITH {_MATRIX}, d(domain) AS (VALUES ('Clear'),('Complicated'),('Complex'),('Chaotic'),('Disorder')),
s AS (SELECT domain, CAST(coalesce(sum(n) FILTER (predicted = domain AND actual = domain), 0) AS DOUBLE) AS tp, coalesce(sum(n) FILTER (predicted = domain), 0) AS np, coalesce(sum(n) FILTER (actual = domain), 0) AS na, sum(n) FILTER (predicted = actual) AS ok, sum(n) AS total FROM d, m GROUP BY 1),
p AS (SELECT *, coalesce(tp/nullif(np, 0), 0) AS p, coalesce(tp/nullif(na, 0), 0) AS r FROM s)
SELECT domain, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2*p*r/nullif(p + r, 0), 0), 9) AS f1, round(CAST(ok AS DOUBLE)/total, 9) AS accuracy, CAST(total AS BIGINT) AS total FROM p""",
    "misrouting": f"WITH {_MATRIX} SELECT CAST(coalesce(sum(n * CASE predicted WHEN 'Complicated' THEN 10 WHEN 'Complex' THEN 50 WHEN 'Chaotic' THEN 200 ELSE 0 END), 0) AS BIGINT) AS cost_mills FROM m WHERE predicted <> actual",
    "drift_kl": f"""WITH {_ROUTED}, d(domain) AS (VALUES ('Clear'),('Complicated'),('Complex'),('Chaotic'),('Disorder')),
s AS (SELECT d.domain, greatest(CAST(count(*) FILTER (r.domain = d.domain AND day(ts) > 15) AS DOUBLE)/count(*) FILTER (day(ts) > 15), 1e-10) AS p, greatest(CAST(count(*) FILTER (r.domain = d.domain AND day(ts) <= 15) AS DOUBLE)/count(*) FILTER (day(ts) <= 15), 1e-10) AS q FROM d, r GROUP BY 1)
SELECT round(sum(p*ln(p/q)), 9) AS kl, sum(p*ln(p/q)) > 0.1 AS drifted, (SELECT count(*) FROM r WHERE day(ts) > 15) AS n FROM s""",
    "session_fold": f"""WITH {_ROUTED}, k AS (SELECT *, {_RISK} AS risk FROM r), s AS (SELECT user_id AS session, count(*) AS depth, arg_max(domain, (ts, event_id)) AS domain, arg_max(confidence, (ts, event_id)) AS confidence, bool_or(risk >= 0.95) AS has_rejection, bool_or(risk >= 0.5 AND risk < 0.95) AS up FROM k GROUP BY 1)
SELECT session, depth, domain, round(confidence, 9) AS confidence, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence > 0 THEN 'low' ELSE 'unknown' END AS level, has_rejection, up OR domain = 'Disorder' AS requires_human FROM s""",
    "confidence_levels": "SELECT event_id, CASE WHEN abs(value)/100 >= 0.85 THEN 'high' WHEN abs(value)/100 >= 0.5 THEN 'medium' WHEN abs(value)/100 > 0 THEN 'low' ELSE 'unknown' END AS level FROM events",
    "workflow_batch": """WITH RECURSIVE w(state_id, x, node, prev, steps) AS (SELECT o_orderkey, o_orderkey % 7, 'start', NULL::VARCHAR, 0 FROM orders
 UNION ALL SELECT state_id, y, CASE node WHEN 'start' THEN CASE WHEN y % 2 = 0 THEN 'double' ELSE 'drop' END WHEN 'double' THEN CASE WHEN y < 20 THEN 'double' ELSE 'end' END WHEN 'drop' THEN 'end' END, node, steps + 1
 FROM (SELECT *, CASE node WHEN 'start' THEN x + 1 WHEN 'double' THEN x * 2 WHEN 'drop' THEN x - 3 ELSE x END AS y FROM w) WHERE node IS NOT NULL AND steps < 6)
SELECT state_id, arg_max(x, steps) AS x, arg_max(prev, steps) AS final_node, CAST(max(steps) AS BIGINT) AS steps, CASE WHEN bool_or(node IS NULL) THEN NULL ELSE 'max_steps_exceeded' END AS error FROM w GROUP BY 1""",
}
_CONTEXTS = """j AS (SELECT event_id, event_type AS kind, value, json_extract_string(props, '$.k') AS k0, CASE WHEN event_id % 31 = 5 THEN NULL ELSE '{"kind": "' || event_type || '"'
  || CASE event_id % 6 WHEN 0 THEN ', "k": ' || json_extract_string(props, '$.k') WHEN 1 THEN ', "k": "' || json_extract_string(props, '$.k') || '"' WHEN 2 THEN '' WHEN 3 THEN ', "k": null' WHEN 4 THEN ', "k": ' || json_extract_string(props, '$.k') || '.5' ELSE ', "k": true' END
  || CASE event_id % 4 WHEN 0 THEN ', "live": true' WHEN 1 THEN ', "live": "true"' WHEN 2 THEN ', "live": 1' ELSE '' END || '}' END AS ctx FROM events),
t AS (SELECT *, json_type(ctx, '$.k') AS kt, json_extract_string(ctx, '$.k') AS kv, json_type(ctx, '$.live') AS lt, json_extract_string(ctx, '$.live') AS lv FROM j),
x AS (SELECT *, CASE WHEN kt IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(kv AS DOUBLE) END AS num, CASE WHEN kt = 'VARCHAR' THEN kv END AS str FROM t)"""
SQL["policy_typed"] = f"""WITH {_CONTEXTS}, a AS (SELECT event_id, ctx, coalesce(lt = 'BOOLEAN' AND lv = 'true' AND kind IN ('view', 'click'), false) OR coalesce(num < 20, false) OR coalesce(str = '7', false)
  OR coalesce(kind = 'purchase' AND kt IS NOT NULL AND num IS DISTINCT FROM 50, false) OR (kind = 'signup' AND NOT coalesce(num >= 30, false))
  OR coalesce(kind = 'error' AND (num IN (1, 2.5) OR str = '3' OR (kt = 'BOOLEAN' AND kv = 'true') OR kt = 'NULL'), false)
  OR coalesce(lt = 'BOOLEAN' AND kt = 'BOOLEAN' AND kv = lv, false) OR coalesce(lt = 'VARCHAR' AND str = lv, false) OR coalesce(lt = 'UBIGINT' AND num = 1, false) AS allow FROM x)
SELECT event_id, CASE WHEN ctx IS NULL THEN 'error' WHEN allow THEN 'approve' ELSE 'reject' END AS decision, CASE WHEN ctx IS NULL THEN 'Policy evaluation failed: context is not JSON' WHEN NOT allow THEN 'Rego policy denied the action' END AS reason FROM a"""
SQL["risk_decisions"] = f"""WITH {_CONTEXTS}, r AS (SELECT *, CASE WHEN kind = 'error' THEN 'reject' WHEN num IS NULL THEN 'error' WHEN num >= 80 THEN 'reject' WHEN num >= 50 THEN 'escalate' WHEN value < 100 THEN 'approve' ELSE 'reject' END AS decision FROM x)
SELECT event_id, decision, CASE WHEN kind = 'error' THEN 'errors are denied' WHEN decision = 'error' THEN 'Policy evaluation failed: Missing or invalid risk field ''k'' in context' WHEN num >= 80 THEN 'Risk score ' || printf('%.3f', num) || ' exceeds reject threshold 80.000' WHEN decision = 'reject' THEN 'dear' END AS reason,
CASE WHEN decision = 'escalate' THEN 'role:reviewer' END AS target FROM r"""
SQL["bias_keyed"] = """WITH n AS (SELECT nullif(user_id % 5, 0) AS team, CAST(count(*) AS DOUBLE) AS o FROM events GROUP BY 1, event_type), e AS (SELECT *, avg(o) OVER (PARTITION BY team) AS e FROM n),
c AS (SELECT team, sum((o - e) * (o - e) / e) AS chi, count(*) - 1 AS d FROM e GROUP BY 1), k AS (SELECT *, d * pow(1 - 2.0 / (9 * d) + 1.645211440143815 * sqrt(2.0 / (9 * d)), 3) AS crit FROM c)
SELECT team, round(chi, 6) AS chi2, CAST(d AS BIGINT) AS df, round(crit, 6) AS critical, chi > crit AS biased FROM k"""
SQL["drift_keyed"] = f"""WITH {_ROUTED}, d(domain) AS (VALUES ('Clear'),('Complicated'),('Complex'),('Chaotic'),('Disorder')), g AS (SELECT nullif(user_id % 5, 0) AS team, domain, day(ts) > 15 AS late FROM r),
s AS (SELECT team, d.domain, greatest(CAST(count(*) FILTER (g.domain = d.domain AND late) AS DOUBLE)/count(*) FILTER (late), 1e-10) AS p, greatest(CAST(count(*) FILTER (g.domain = d.domain AND NOT late) AS DOUBLE)/count(*) FILTER (NOT late), 1e-10) AS q, count(*) FILTER (late) AS n FROM d, g GROUP BY 1, 2)
SELECT team, round(sum(p*ln(p/q)), 9) AS kl, sum(p*ln(p/q)) > 0.001 AS drifted, max(n) AS n FROM s GROUP BY 1"""
_SUPPLIED = _NODES + ", f AS (SELECT * FROM e UNION ALL SELECT 's' || s_suppkey, 'c' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)"
_SMALL = _NODES.replace(" UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders", "")
SQL["dag_parents"] = f"""WITH {_SUPPLIED}, v AS (SELECT src AS node FROM f UNION SELECT dst FROM f), u AS (SELECT dst AS node, count(*) AS n, min(src) AS one FROM f GROUP BY 1), w AS (SELECT src AS node, count(*) AS n FROM f GROUP BY 1)
SELECT node, coalesce(u.n, 0) AS n_parents, coalesce(w.n, 0) AS n_children, CASE WHEN u.n = 1 THEN one END AS only_parent, true AS acyclic FROM v LEFT JOIN u USING (node) LEFT JOIN w USING (node)"""
SQL["dag_closure"] = f"""WITH RECURSIVE {_SUPPLIED}, c(seed, node) AS (SELECT dst, dst FROM f WHERE dst LIKE 's%' OR dst LIKE 'c%' UNION SELECT c.seed, f.dst FROM c JOIN f ON f.src = c.node) SELECT seed, node FROM c"""
SQL["frontdoor_sets"] = f"""WITH RECURSIVE {_SUPPLIED}, o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
q AS (SELECT 'n' || c_nationkey AS x, 'o' || o_orderkey AS y FROM o UNION SELECT 'n' || c_nationkey, 'm' || c_mktsegment FROM customer UNION SELECT 'r' || n_regionkey, 'o' || o_orderkey FROM o UNION SELECT 'c' || c_custkey, 'o' || o_orderkey FROM o),
a(y, node) AS (SELECT DISTINCT y, y FROM q UNION SELECT a.y, f.src FROM a JOIN f ON f.dst = a.node),
k AS (SELECT q.x, q.y, f.dst AS node FROM q JOIN f ON f.src = q.x JOIN a ON a.y = q.y AND a.node = f.dst),
n AS (SELECT dst AS node, count(*) AS parents FROM f GROUP BY 1),
bad AS (SELECT DISTINCT x, y FROM k JOIN n USING (node) WHERE node = y OR parents > 1)
SELECT x || '>' || y AS question, node FROM k WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.x = k.x AND bad.y = k.y)"""
SQL["dsep_table"] = f"""WITH RECURSIVE {_SMALL}, f AS (SELECT * FROM e WHERE dst NOT LIKE 'm%' UNION ALL SELECT dst, src FROM e WHERE dst LIKE 'm%'),
q AS (SELECT s_suppkey AS question, 's' || s_suppkey AS x, 'm' || c_mktsegment AS y, 'c' || c_custkey AS given FROM supplier JOIN customer ON s_suppkey = c_custkey),
z AS (SELECT question, given AS node FROM q WHERE question % 2 = 1), a(question, node) AS (SELECT * FROM z UNION SELECT a.question, f.src FROM a JOIN f ON f.dst = a.node),
s(question, node, way) AS (SELECT question, x, w FROM q, (VALUES ('up'), ('down')) AS t(w)
  UNION SELECT s.question, CASE WHEN d.w = 'up' THEN f.src ELSE f.dst END, d.w FROM s, (VALUES ('up'), ('down')) AS d(w), f
  WHERE s.node = CASE WHEN d.w = 'up' THEN f.dst ELSE f.src END AND CASE WHEN d.w = 'up' AND s.way = 'down' THEN EXISTS (SELECT 1 FROM a WHERE a.question = s.question AND a.node = s.node) ELSE NOT EXISTS (SELECT 1 FROM z WHERE z.question = s.question AND z.node = s.node) END)
SELECT q.question, x, y, NOT EXISTS (SELECT 1 FROM s WHERE s.question = q.question AND s.node = q.y) AS separated FROM q"""
SQL["backdoor_set"] = f"""WITH RECURSIVE {_SMALL}, f AS (SELECT * FROM e UNION ALL SELECT DISTINCT 'm' || c_mktsegment, 'r0' FROM customer),
q AS (SELECT 's' || s_suppkey AS x, 'n' || s_nationkey AS y FROM supplier JOIN customer ON s_suppkey = c_custkey UNION SELECT 's' || s_suppkey, 'm' || c_mktsegment FROM supplier JOIN customer ON s_suppkey = c_custkey
  UNION SELECT 'm' || c_mktsegment, 'r' || r_regionkey FROM customer, region),
c(x, node) AS (SELECT DISTINCT x, f.dst FROM q JOIN f ON f.src = x UNION SELECT c.x, f.dst FROM c JOIN f ON f.src = c.node),
z AS (SELECT DISTINCT x, src AS node FROM q JOIN f ON f.dst = x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.x = q.x AND c.node = f.src)),
a(x, node) AS (SELECT * FROM z UNION SELECT a.x, f.src FROM a JOIN f ON f.dst = a.node WHERE f.src <> a.x),
s(x, node, way) AS (SELECT DISTINCT x, x, w FROM q, (VALUES ('up'), ('down')) AS t(w)
  UNION SELECT s.x, CASE WHEN d.w = 'up' THEN f.src ELSE f.dst END, d.w FROM s, (VALUES ('up'), ('down')) AS d(w), f
  WHERE f.src <> s.x AND s.node = CASE WHEN d.w = 'up' THEN f.dst ELSE f.src END AND CASE WHEN d.w = 'up' AND s.way = 'down' THEN EXISTS (SELECT 1 FROM a WHERE a.x = s.x AND a.node = s.node) ELSE NOT EXISTS (SELECT 1 FROM z WHERE z.x = s.x AND z.node = s.node) END)
SELECT x, y, NOT EXISTS (SELECT 1 FROM s WHERE s.x = q.x AND s.node = q.y) AND NOT EXISTS (SELECT 1 FROM z WHERE z.x = q.x AND z.node = q.y) AS verified FROM q"""
SQL["graph_levels"] = f"""WITH RECURSIVE {_NODES}, d(node, l) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, l + 1 FROM d JOIN e ON e.src = d.node) SELECT node, max(l) AS level FROM d GROUP BY 1"""
_CIRCULAR = _SMALL + ", f AS (SELECT * FROM e UNION ALL SELECT DISTINCT 'm' || c_mktsegment, 'r' || (length(c_mktsegment) % 5) FROM customer)"
_CORE = f"""{_CIRCULAR}, r(a, b) AS (SELECT src, dst FROM f WHERE dst NOT LIKE 's%' UNION SELECT r.a, f.dst FROM r JOIN f ON f.src = r.b WHERE f.dst NOT LIKE 's%'), loop AS (SELECT a AS node FROM r WHERE a = b)"""
SQL["graph_levels_circular"] = f"""WITH RECURSIVE {_CORE}, g AS (SELECT * FROM f UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders), behind(node) AS (SELECT node FROM loop UNION SELECT g.dst FROM behind JOIN g ON g.src = behind.node),
d(node, l) AS (SELECT DISTINCT src, 0 FROM g WHERE src NOT IN (SELECT dst FROM g) UNION SELECT g.dst, l + 1 FROM d JOIN g ON g.src = d.node WHERE g.dst NOT IN (SELECT node FROM behind))
SELECT node, max(l) AS level FROM d GROUP BY 1 UNION ALL SELECT node, NULL FROM behind"""
SQL["graph_cycles"] = f"""WITH RECURSIVE {_CORE}, core AS (SELECT node FROM loop UNION (SELECT b FROM r JOIN loop ON a = node INTERSECT SELECT a FROM r JOIN loop ON b = node)),
p AS (SELECT src, min(dst) AS dst FROM f WHERE src IN (SELECT node FROM core) AND dst IN (SELECT node FROM core) GROUP BY 1),
w(start, node, n) AS (SELECT src, dst, 1 FROM p UNION ALL SELECT w.start, p.dst, n + 1 FROM w JOIN p ON p.src = w.node WHERE w.node <> w.start AND n < 40),
ring AS (SELECT DISTINCT start FROM w WHERE node = start), least_of AS (SELECT start, min(node) AS cycle FROM w WHERE start IN (SELECT start FROM ring) GROUP BY 1)
SELECT cycle, CASE WHEN l.start = cycle THEN 0 ELSE (SELECT min(n) FROM w WHERE w.start = cycle AND w.node = l.start) END AS position, l.start AS node FROM least_of l"""
SQL["graph_avoiding"] = """SELECT o_orderkey AS question, 'n' || c_nationkey AS x, 'o' || o_orderkey AS y,
CASE WHEN s_suppkey IS NULL THEN o_orderkey % 3 <> 1 ELSE o_orderkey % 3 = 2 AND s_nationkey = c_nationkey END AS connected
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey AND s_suppkey % 3 = 0"""
SQL["mcmc_normal"] = "SELECT event_type, count(value) AS n, CAST(4 AS BIGINT) AS chains, true AS mean_agrees, true AS deviation_agrees, true AS rate_near_target FROM events GROUP BY 1"
SQL["rate_limits_peek"] = """WITH RECURSIVE n AS (SELECT event_id, user_id, event_type <> 'view' AS takes, epoch_us(ts)/1000000.0::DOUBLE AS now_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f(event_id, user_id, i, takes, at_, had) AS (SELECT event_id, user_id, i, takes, now_, 3.0::DOUBLE FROM n WHERE i = 1
 UNION ALL SELECT n.event_id, n.user_id, n.i, n.takes, n.now_, least(3.0, f.had - CAST(f.takes AND f.had >= 1 AS INT) + (n.now_ - f.at_)*0.00002::DOUBLE) FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1)
SELECT event_id, had >= 1 AS allowed, CASE WHEN had < 1 THEN 0 WHEN takes THEN CAST(floor(had - 1) AS BIGINT) ELSE CAST(floor(had) AS BIGINT) END AS remaining FROM f"""
_SYLLABLES = [("Clear", ["the on", "tion is", "hand"]), ("Complicated", ["enth", "onand", "thin", "erth"]), ("Complex", ["reou", "edti", "haat"]), ("Chaotic", ["whwh", "lyly", "tiontion"]), ("Own", ["ción", "ung ", "eau"])]
_SHARES = ", ".join(f"{{'s': -(" + " + ".join(f"CAST(contains(low, '{k}') AS INT)" for k in ks) + f") / {len(ks)}.0::DOUBLE, 'i': {i}, 'n': '{d}'}}" for i, (d, ks) in enumerate(_SYLLABLES))
SQL["classify_documents"] = f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), s AS (SELECT doc_id, list_sort([{_SHARES}]) AS s FROM t), b AS (SELECT *, -s[1].s AS c FROM s)
SELECT doc_id, CASE WHEN c > 0 THEN s[1].n ELSE 'Disorder' END AS domain, round(CASE WHEN c > 0 THEN c ELSE 0 END, 9) AS confidence, c >= 0.3 AS confident,
CASE WHEN c >= 0.3 THEN CASE s[1].n WHEN 'Clear' THEN 'http://clear' WHEN 'Complicated' THEN 'http://complicated' WHEN 'Complex' THEN 'http://complex' WHEN 'Chaotic' THEN 'http://chaotic' END END AS url,
array_to_string(list_transform(s, lambda x: x.n), ',') AS ranked FROM b"""
SQL["classify_by_keywords"] = """WITH k AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS keyword FROM conversations),
w AS (SELECT keyword, list_extract(['Clear','Complicated','Complex','Chaotic','Own','Other'], CAST(length(keyword) % 6 + 1 AS INTEGER)) AS domain FROM k WHERE length(keyword) > 5),
n AS (SELECT domain, count(*) AS total FROM w GROUP BY 1), d AS (SELECT doc_id, lower(text) AS low FROM documents),
h AS (SELECT doc_id, domain, count(*) AS n FROM d JOIN w ON contains(low, keyword) GROUP BY 1, 2),
s AS (SELECT doc_id, domain, n / total::DOUBLE AS share, row_number() OVER (PARTITION BY doc_id ORDER BY n / total::DOUBLE DESC, CASE domain WHEN 'Clear' THEN 0 WHEN 'Complicated' THEN 1 WHEN 'Complex' THEN 2 WHEN 'Chaotic' THEN 3 ELSE 5 END, domain) AS r, count(*) OVER (PARTITION BY doc_id) AS c FROM h JOIN n USING (domain))
SELECT d.doc_id, coalesce(domain, 'Disorder') AS domain, round(coalesce(share, 0), 9) AS confidence, CAST(coalesce(c, 0) AS INTEGER) AS n_domains FROM d LEFT JOIN s ON s.doc_id = d.doc_id AND r = 1"""
_SIZE = "CAST(floor(n * 0.8::DOUBLE) AS BIGINT)"
SQL["subset_sequential"] = _refute("subset_validation", _draws(456, 10, _SIZE) + f""", d AS (SELECT rep, i, i + CAST(floor(u * (n - i)) AS BIGINT) % (n - i) AS j, {_SIZE} AS size FROM w, z),
up AS (SELECT rep, j AS k, max(i) AS p FROM d WHERE i < j AND j < size GROUP BY 1, 2), chain(rep, k, p) AS (SELECT * FROM up UNION ALL SELECT c.rep, c.k, up.p FROM chain c JOIN up ON up.rep = c.rep AND up.k = c.p),
root AS (SELECT rep, k, min(p) AS v FROM chain GROUP BY 1, 2), s AS (SELECT rep, i, j, lag(i) OVER (PARTITION BY rep, j ORDER BY i) AS k FROM d),
sel AS (SELECT s.rep, CASE WHEN s.k IS NULL THEN j ELSE coalesce(v, s.k) END AS i FROM s LEFT JOIN root ON root.rep = s.rep AND root.k = s.k),
m AS (SELECT avg(a) AS m FROM (SELECT {_DIM} AS a FROM sel JOIN g USING (i) GROUP BY rep))""", "abs(m.m - o.ate)/abs(o.ate) < 0.2").replace("WITH l ", "WITH RECURSIVE l ", 1)
SQL["study_estimate"] = SQL["ols_adjusted"]
_CUTS = [round(sum(2.718281828459045**-1 / f for f in fs) * _P) for fs in [[1], [1, 1], [1, 1, 2], [1, 1, 2, 6], [1, 1, 2, 6, 24], [1, 1, 2, 6, 24, 120], [1, 1, 2, 6, 24, 120, 720], [1, 1, 2, 6, 24, 120, 720, 5040]]]
_WEIGHT = " + ".join(f"CAST(u >= {c} AS INT)" for c in _CUTS)
SQL["bootstrap_refute"] = _refute("bootstrap_refutation", _coins(789, 20) + f""", v AS (SELECT rep, on_, y, {_WEIGHT} AS w FROM h),
m AS (SELECT avg(a) AS m FROM (SELECT coalesce(sum(y*w) FILTER (on_)/sum(w) FILTER (on_), 0) - coalesce(sum(y*w) FILTER (NOT on_)/sum(w) FILTER (NOT on_), 0) AS a FROM v GROUP BY rep))""", "abs(m.m - o.ate)/abs(o.ate) < 0.2")
