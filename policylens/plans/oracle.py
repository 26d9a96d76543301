"""SQL twins of the sample logs, as common table expressions for DuckDB."""

from __future__ import annotations

KEYS = "tenant, job, capsule"

LOG = """
ev AS (SELECT *, user_id % 4 AS seg, concat('router', user_id % 3) AS cap FROM events),
acts(action, idx, cost) AS (VALUES ('click', 0, 0.1::DOUBLE), ('error', 1, 0.9::DOUBLE),
  ('purchase', 2, 0.2::DOUBLE), ('signup', 3, 0.4::DOUBLE), ('view', 4, 0.05::DOUBLE)),
log AS (
  SELECT 'acme' AS tenant, 'default' AS job, cap AS capsule, concat('dec_', event_id) AS id,
    event_id, epoch_us(ts) // 1000 AS ts_ms, ts, seg, user_id, value, event_type AS chosen_id,
    hour(ts) AS hour,
    CASE seg WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' ELSE 'view' END AS fav,
    CASE WHEN seg = 3 THEN 4 ELSE 5 END AS k,
    event_id % 40 = 3 AS legacy,
    CASE WHEN event_id % 50 = 1 THEN 'unverified' ELSE 'learner' END AS mode,
    event_id // 100 AS model_version
  FROM ev WHERE NOT (seg = 3 AND event_type = 'signup')),
logp AS (
  SELECT log.*, a.idx AS chosen_index,
    CASE WHEN NOT legacy THEN CASE WHEN chosen_id = fav THEN 0.4::DOUBLE
      ELSE 0.6::DOUBLE / (k - 1) END END AS probability
  FROM log JOIN acts a ON a.action = log.chosen_id),
rw AS (
  SELECT 'acme' AS tenant, 'default' AS job, cap AS capsule,
    concat('dec_', event_id) AS decision_id, event_id, 2 * event_id + n AS seq,
    epoch_us(ts) // 1000 + 1000 * (event_id % 1200) AS ts_ms,
    CASE WHEN n = 0 THEN value ELSE value / 2 END AS value,
    least(greatest((CASE WHEN n = 0 THEN value ELSE value / 2 END) / 500.0::DOUBLE, 0), 1) AS value_norm,
    CASE WHEN n = 0 THEN concat('dec_', event_id) ELSE concat('dec_', event_id, ':2') END
      AS idempotency_key, props AS detail
  FROM ev, (VALUES (0), (1)) t(n)
  WHERE event_id % 10 <> 0 AND (n = 0 OR event_id % 7 = 0)),
fr AS (
  SELECT capsule, decision_id, arg_min(value, seq) AS reward, arg_min(value_norm, seq) AS reward_norm,
    count(*) AS reward_count, sum(value) AS reward_sum, sum(value_norm) AS norm_sum
  FROM rw GROUP BY ALL),
lg AS (
  SELECT logp.*, reward, reward_norm, coalesce(reward_count, 0) AS reward_count, reward_sum, norm_sum
  FROM logp LEFT JOIN fr ON fr.capsule = logp.capsule AND fr.decision_id = logp.id),
er AS (
  SELECT *, event_id % 5 AS fold FROM lg
  WHERE mode <> 'unverified' AND NOT legacy AND reward IS NOT NULL),
la AS (
  SELECT er.*, action, idx, CASE WHEN action = fav THEN 0.4::DOUBLE ELSE 0.6::DOUBLE / (k - 1) END AS mu
  FROM er JOIN acts ON NOT (seg = 3 AND action = 'signup'))
"""

CELLS = """
cs AS (SELECT capsule, seg, chosen_id, fold, sum(reward) AS s, count(*) AS n FROM er GROUP BY ALL),
folds(f) AS (VALUES (0), (1), (2), (3), (4)),
cm AS (
  SELECT capsule, seg, chosen_id, f, sum(CASE WHEN fold <> f THEN s END)
    / nullif(sum(CASE WHEN fold <> f THEN n ELSE 0 END), 0) AS mean
  FROM cs, folds GROUP BY ALL),
om AS (
  SELECT capsule, f, sum(CASE WHEN fold <> f THEN s END)
    / nullif(sum(CASE WHEN fold <> f THEN n ELSE 0 END), 0) AS overall,
    sum(CASE WHEN fold <> f THEN n ELSE 0 END) AS n_updates
  FROM cs, folds GROUP BY ALL),
lr AS (
  SELECT la.*, coalesce(cm.mean, om.overall) AS rhat, om.n_updates
  FROM la JOIN om ON om.capsule = la.capsule AND om.f = la.fold
  LEFT JOIN cm ON cm.capsule = la.capsule AND cm.seg = la.seg AND cm.chosen_id = la.action
    AND cm.f = la.fold)
"""


def terms(pi: str, w_max: str = "100.0") -> str:
    """Per-row terms of policies given as `tp(policy, falls, ... , pi)` rows per action.

    `pi` is SQL selecting everything of lr plus policy, pi and falls for every eligible action.
    """
    return f"""
tp AS ({pi}),
tm AS (
  SELECT capsule, policy, id, any_value(reward) AS r,
    sum(CASE WHEN action = chosen_id THEN pi END) / any_value(probability) AS raw_w,
    sum(pi * rhat) AS dm, sum(CASE WHEN action = chosen_id THEN rhat END) AS hat,
    sum(pi) AS mass, sum(CASE WHEN mu = 0 THEN pi ELSE 0 END) AS off,
    sum(CASE WHEN action = chosen_id THEN pi END) > 0 AS covered, bool_or(falls) AS falls
  FROM tp GROUP BY capsule, policy, id),
tt AS (
  SELECT *, least(raw_w, {w_max}) AS w, least(raw_w, {w_max}) * r AS wr,
    dm + least(raw_w, {w_max}) * (r - hat) AS dr, raw_w - (mass - off) AS gap,
    raw_w > {w_max} AS clipped
  FROM tm)
"""


CONSTANTS = """
  SELECT lr.*, concat('constant:', c.action) AS policy,
    lr.seg = 3 AND c.action = 'signup' AS falls,
    CASE WHEN lr.seg = 3 AND c.action = 'signup' THEN lr.mu
      WHEN lr.action = c.action THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pi
  FROM lr, acts c"""

#: Two-pass forms: the deviations are taken from means computed first.
METRICS = """
a1 AS (
  SELECT capsule, policy, count(*) AS n, avg(r) AS logged_mean, avg(dm) AS dm, avg(wr) AS ips,
    avg(dr) AS dr, CASE WHEN sum(w) > 0 THEN sum(wr) / sum(w) END AS snips, avg(w) AS wbar,
    sum(w) * sum(w) / sum(w * w) AS ess, avg(covered::INT) AS coverage,
    avg(clipped::INT) AS clip_rate, count(*) FILTER (clipped) AS clipped_rows,
    max(raw_w) AS max_weight, avg(raw_w) AS mean_weight, count(*) FILTER (falls) AS fallback_rows,
    avg(falls::INT) AS fallback_rate, avg(off) AS unsupported_mass, avg(gap) AS gap_mean,
    avg(dm - r) AS lift_dm, avg(wr - r) AS lift_ips, avg(dr - r) AS lift_dr
  FROM tt GROUP BY ALL),
a2 AS (
  SELECT tt.capsule, tt.policy, any_value(n) AS n,
    sqrt(sum((r - logged_mean) ** 2) / (any_value(n) - 1) / any_value(n)) AS logged_se,
    sqrt(sum((wr - ips) ** 2) / (any_value(n) - 1) / any_value(n)) AS ips_se,
    sqrt(sum((tt.dr - a1.dr) ** 2) / (any_value(n) - 1) / any_value(n)) AS dr_se,
    sqrt(sum((wr - w * snips) ** 2) / (any_value(n) - 1) / any_value(n)) / any_value(wbar) AS snips_se,
    sqrt(sum((wr - r - lift_ips) ** 2) / (any_value(n) - 1) / any_value(n)) AS lift_ips_se,
    sqrt(sum((tt.dr - r - lift_dr) ** 2) / (any_value(n) - 1) / any_value(n)) AS lift_dr_se,
    sqrt(sum(((wr - w * snips) / wbar - (r - logged_mean)) ** 2) / (any_value(n) - 1) / any_value(n))
      AS lift_snips_se,
    sqrt(sum((gap - gap_mean) ** 2) / (any_value(n) - 1) / any_value(n)) AS gap_se
  FROM tt JOIN a1 ON a1.capsule = tt.capsule AND a1.policy = tt.policy GROUP BY tt.capsule, tt.policy),
am AS (
  SELECT a1.*, snips - logged_mean AS lift_snips, a2.* EXCLUDE (capsule, policy, n),
    gap_mean / nullif(gap_se, 0) AS weight_z
  FROM a1 JOIN a2 ON a1.capsule = a2.capsule AND a1.policy = a2.policy)
"""


def evaluation(pi: str = CONSTANTS, w_max: str = "100.0") -> str:
    return "WITH " + ", ".join([LOG, CELLS, terms(pi, w_max), METRICS])


# FNV-1a, its finalizer and SplitMix64 over unsigned 128-bit integers.
TWO64 = "18446744073709551616::UHUGEINT"


def fnv(bytes_list: str, start: str = "14695981039346656037::UHUGEINT") -> str:
    return (
        f"list_reduce(list_concat([{start}], {bytes_list}), "
        f"lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {TWO64})"
    )


def text_bytes(text: str) -> str:
    """Bytes of ASCII text."""
    return f"list_transform(string_split({text}, ''), lambda x: ord(x)::UHUGEINT)"


def word_bytes(word: str) -> str:
    return (
        f"list_transform(range(8), lambda i: ({word} // (256::UHUGEINT ** i)::UHUGEINT) % 256::UHUGEINT)"
    )


def mix(h: str) -> list[tuple[str, str]]:
    """Steps (name, expression) of the finalizer; each uses the one before."""
    return [
        ("m1", f"(xor({h}, {h} // 8589934592::UHUGEINT) * 18397679294719823053::UHUGEINT) % {TWO64}"),
        ("m2", f"(xor(m1, m1 // 8589934592::UHUGEINT) * 14181476777654086739::UHUGEINT) % {TWO64}"),
        ("m3", "xor(m2, m2 // 8589934592::UHUGEINT)"),
    ]


def splitmix(state: str) -> list[tuple[str, str]]:
    return [
        ("z0", f"({state} + 11400714819323198485::UHUGEINT) % {TWO64}"),
        ("z1", f"(xor(z0, z0 // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {TWO64}"),
        ("z2", f"(xor(z1, z1 // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {TWO64}"),
        ("z3", "xor(z2, z2 // 2147483648::UHUGEINT)"),
    ]


def chain(source: str, keep: str, steps: list[tuple[str, str]]) -> str:
    """Nested selects that compute the steps one after another over `source`."""
    sql = source
    for name, expr in steps:
        sql = f"(SELECT *, {expr} AS {name} FROM {sql})"
    return f"SELECT {keep} FROM {sql}"


def signed(h: str) -> str:
    """The signed 64-bit number with the same bits."""
    return f"(CASE WHEN {h} >= 9223372036854775808::UHUGEINT THEN {h}::HUGEINT - 18446744073709551616::HUGEINT ELSE {h}::HUGEINT END)::BIGINT"
