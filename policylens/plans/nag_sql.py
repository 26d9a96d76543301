"""SQL twins of learning: feature vectors, and the learner's updates one after the other as a recursive query.

Every step of the recursion applies one update to the state of all groups that have one left, by the published formulas
over dense lists of slots: scales grow, accumulated gradients shrink with them, the normalized gradient step is taken, and
weights and accumulators are rounded to 32 bits, as they are stored.
"""

from __future__ import annotations

from policylens.plans import oracle as O


def _space(tag: int, text: str) -> str:
    return O.fnv(f"list_concat([{tag}::UHUGEINT, 0::UHUGEINT], {O.text_bytes(text)})")


def _pair(a: str, b: str) -> str:
    return O.fnv(O.word_bytes(b), O.fnv(O.word_bytes(a)))


#: Features of the log's actions: (action, feature, value).
LOGGED_FEATURES = "SELECT action, 'cost' AS feature, cost::FLOAT AS av FROM acts"


def phi(bits: int, context: bool = False, features: str = LOGGED_FEATURES) -> str:
    """Feature vectors of every (hour, segment, action): phi(hour, seg, action, slot, x)."""
    alone = "UNION ALL SELECT hour, seg, action, xh, (CASE WHEN name = 'hour' THEN hour ELSE 1 END)::DOUBLE FROM rq CROSS JOIN acts JOIN xf ON (xseg IS NULL OR xseg = seg) AND NOT (seg = 3 AND action = 'signup')"
    return f"""
rq AS (SELECT DISTINCT hour, seg FROM log),
xf AS (
  SELECT 'hour' AS name, NULL::BIGINT AS xseg, {_space(99, "'hour'")} AS xh
  UNION ALL SELECT concat('seg=s', seg), seg, {_space(99, "concat('seg=s', seg)")}
  FROM (SELECT DISTINCT seg FROM log)),
af AS (
  SELECT action, {_space(97, "concat('id=', action)")} AS ah, 1.0::FLOAT AS av FROM acts
  UNION ALL SELECT action, {_space(97, "feature")}, av FROM ({features})),
raw AS (
  SELECT hour, seg, action, {_space(98, "'bias'")} AS h, 1.0::DOUBLE AS v
  FROM rq JOIN acts ON NOT (seg = 3 AND action = 'signup')
  UNION ALL SELECT hour, seg, action, ah, av FROM rq JOIN af ON NOT (seg = 3 AND action = 'signup')
  UNION ALL SELECT hour, seg, action, {_pair("xh", "ah")},
    ((CASE WHEN name = 'hour' THEN hour ELSE 1 END)::DOUBLE * av::DOUBLE)::FLOAT
  FROM rq JOIN af ON NOT (seg = 3 AND action = 'signup')
  JOIN xf ON xseg IS NULL OR xseg = seg
  {alone if context else ""}),
phi AS MATERIALIZED (SELECT hour, seg, action, slot, sum(v)::FLOAT AS x FROM (
  {O.chain("raw", f"hour, seg, action, v, (m3 % {1 << bits})::BIGINT AS slot", O.mix("h"))})
  GROUP BY ALL HAVING sum(v)::FLOAT <> 0)"""


#: sl numbers the slots that occur; dense has every vector as a list over them.
DENSE = """
sl AS MATERIALIZED (SELECT slot, row_number() OVER (ORDER BY slot) AS j FROM (SELECT DISTINCT slot FROM phi)),
dense AS MATERIALIZED (
  SELECT p.hour, p.seg, p.action, list(coalesce(phi.x, 0)::DOUBLE ORDER BY j) AS x
  FROM (SELECT DISTINCT hour, seg, action FROM phi) p CROSS JOIN sl
  LEFT JOIN phi ON phi.hour = p.hour AND phi.seg = p.seg AND phi.action = p.action AND phi.slot = sl.slot GROUP BY ALL)"""

#: Models of the updates in lrows(capsule, shard, f, i, x, y, h, rate), i counting from 1 in each group:
#: model(capsule, shard, f, n, u, s, a, t, q).
NAG = """
nag AS (
  SELECT capsule, shard, f, 0::BIGINT AS i, z.v AS u, z.v AS s, z.v AS a, 0.0::DOUBLE AS t, 0.0::DOUBLE AS q
  FROM (SELECT DISTINCT capsule, shard, f FROM lrows), (SELECT list(0::FLOAT) AS v FROM sl) z
  UNION ALL
  SELECT capsule, shard, f, i,
    list_transform(list_zip(u, g, tot), lambda p: (p[1]::DOUBLE - p[2] / sqrt(p[3] + 1e-40) * rate * sqrt(t / q))::FLOAT),
    s, list_transform(tot, lambda v: v::FLOAT), t, q
  FROM (SELECT *, list_transform(list_zip(a1, g), lambda p: p[1] + p[2] * p[2]) AS tot
  FROM (SELECT *, list_transform(xn, lambda v: v * h * gap) AS g
  FROM (SELECT *, q0 + h * list_sum(list_transform(xn, lambda v: v * v)) AS q,
      list_sum(list_transform(list_zip(u, xn), lambda p: p[1]::DOUBLE * p[2])) - y AS gap
  FROM (SELECT *, list_transform(list_zip(x, s), lambda p: CASE WHEN p[2] > 0 THEN p[1] / p[2]::DOUBLE ELSE 0 END) AS xn,
      list_transform(list_zip(a, s0, s), lambda p: CASE WHEN p[2] > 0 AND p[3] > p[2]
        THEN p[1]::DOUBLE * (p[2]::DOUBLE / p[3]::DOUBLE) ** 2 ELSE p[1]::DOUBLE END) AS a1
  FROM (SELECT nag.capsule, nag.shard, nag.f, nag.i + 1 AS i, u, a, nag.s AS s0, nag.t + h AS t, nag.q AS q0, x, y, h, rate,
      list_transform(list_zip(nag.s, x), lambda p: greatest(p[1], abs(p[2])::FLOAT)) AS s
    FROM nag JOIN lrows AS r ON r.capsule = nag.capsule AND r.shard = nag.shard AND r.f = nag.f AND r.i = nag.i + 1)))))),
model AS MATERIALIZED (
  SELECT capsule, shard, f, m.i AS n, m.u AS u, m.s AS s, m.a AS a, m.t AS t, m.q AS q
  FROM (SELECT capsule, shard, f, arg_max(nag, i) AS m FROM nag GROUP BY ALL))"""

#: One row per model and slot that holds something.
SLOTS = """
slots AS (
  SELECT capsule, shard, f, slot, u, s, a FROM (
    SELECT capsule, shard, f, unnest(u) AS u, unnest(s) AS s, unnest(a) AS a, unnest(range(1, len(u) + 1)) AS j FROM model)
  JOIN sl USING (j) WHERE u <> 0 OR s <> 0 OR a <> 0)"""


def reward_log(seq_filter: str = "true", h: str = "1.0", rate: str = "0.5", low: str = "0.0", high: str = "500.0") -> str:
    """lrows of a capsule's whole reward log, in sequence order."""
    return f"""
lrows AS MATERIALIZED (
  SELECT rw.capsule, 0 AS shard, 0 AS f, row_number() OVER (PARTITION BY rw.capsule ORDER BY seq) AS i, x,
    least(greatest((rw.value - {low}) / ({high} - {low}), 0), 1)::DOUBLE AS y, ({h})::DOUBLE AS h, ({rate})::DOUBLE AS rate
  FROM rw JOIN logp ON logp.capsule = rw.capsule AND logp.id = rw.decision_id
  JOIN dense ON dense.hour = logp.hour AND dense.seg = logp.seg AND dense.action = logp.chosen_id WHERE {seq_filter})"""


def models(bits: int, **options: str) -> str:
    """Everything up to model and slots, over the reward log."""
    return ", ".join(["WITH RECURSIVE " + O.LOG, phi(bits), DENSE, reward_log(**options), NAG, SLOTS])


def cross_fitted(bits: int, context: bool, passes: list[float], rate: float = 0.5, features: str = LOGGED_FEATURES) -> str:
    """Everything up to lr, the evaluation rows with out-of-fold predictions of every eligible action."""
    steps = ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(passes))
    return ", ".join(["WITH RECURSIVE " + O.LOG, phi(bits, context, features), DENSE, f"""
lohi AS (SELECT capsule, min(reward) AS lo, max(reward) AS hi FROM er GROUP BY ALL),
lrows AS MATERIALIZED (
  SELECT er.capsule, event_id % 8 AS shard, f.f, x, 1.0::DOUBLE AS h, {rate} * p.multiple AS rate,
    row_number() OVER (PARTITION BY er.capsule, event_id % 8, f.f ORDER BY p.pass, ts_ms, id) AS i,
    least(greatest((reward - lo) / (hi - lo), 0), 1)::DOUBLE AS y
  FROM er JOIN lohi ON lohi.capsule = er.capsule JOIN dense ON dense.hour = er.hour AND dense.seg = er.seg AND dense.action = er.chosen_id,
    (VALUES (0), (1), (2), (3), (4)) f(f), (VALUES {steps}) p(pass, multiple)
  WHERE fold <> f.f)""", NAG, """
weights AS MATERIALIZED (
  SELECT *, list_transform(list_zip(u, s), lambda p: CASE WHEN p[2] > 0 THEN p[1]::DOUBLE / p[2]::DOUBLE ELSE 0 END) AS w FROM model),
lr AS MATERIALIZED (
  SELECT la.*, lo + least(greatest(list_sum(list_transform(list_zip(w, x), lambda p: p[1] * p[2])), 0), 1) * (hi - lo) AS rhat, n AS n_updates
  FROM la JOIN lohi ON lohi.capsule = la.capsule
  JOIN weights AS m ON m.capsule = la.capsule AND m.shard = la.event_id % 8 AND m.f = la.fold
  JOIN dense ON dense.hour = la.hour AND dense.seg = la.seg AND dense.action = la.action)"""])
