"""DuckDB text of the surrogate frame, shared by the SQL counterparts of the queries."""

from __future__ import annotations

from uqframe.sources import surrogate as S


def samples() -> str:
    return """samples AS (
  SELECT row_id, CASE WHEN row_id % 2 = 1 THEN 'test' ELSE 'val' END AS split, (row_id % 9)::INT AS label, h,
    CASE WHEN h < 0.8 THEN (row_id % 9)::INT ELSE ((row_id % 9 + 1 + (row_id % 1009) % 8) % 9)::INT END AS latent
  FROM (SELECT o_orderkey AS row_id, ((o_orderkey * 7919 + o_custkey * 104729) % 10007) / 10007e0 AS h FROM orders)
)"""


def _softmax(z: str, v: str) -> str:
    e = f"list_transform({z}, lambda {v}: exp({v} - list_max({z})))"
    return f"list_transform({e}, lambda {v}2: {v}2 / list_sum({e}))"


def frame(systems=S.SYSTEMS, split: str | None = None) -> str:
    """CTEs up to ``preds``, one row per system and sample, as the Spark frame has them."""
    images, factors = {i: (a, b) for i, a, b in S.IMAGES}, dict(S.CHECKPOINTS)
    values = ", ".join(f"('{i}', '{c}', '{m}', {images[i][0]}, {images[i][1]}, {factors[c]}e0)" for i, c, m in systems)
    where = f"WHERE split = '{split}'" if split else ""
    return f"""{samples()}, systems(image, checkpoint, mode, c0, c1, f) AS (VALUES {values}),
logit AS (
  SELECT image, 'mE5' AS text, checkpoint, mode, split, row_id, label, h,
    list_transform(range(0, 9), lambda k: f * (3e0 * ((row_id * 31337 + k * c1 + c0) % 9973) / 9973e0 + CASE WHEN latent = k THEN 2e0 + 2e0 * h ELSE 0e0 END)) AS z,
    CASE WHEN row_id % 1000 = 1 THEN 0e0 ELSE 0.02e0 + 0.3e0 * (1 - h) END AS s
  FROM samples CROSS JOIN systems {where}
), memb AS (
  SELECT *, list_transform(range(0, CASE WHEN mode = 'pgs' THEN {S.MEMBERS} ELSE 0 END), lambda m: list_transform(range(0, 9), lambda k: z[k + 1] + s * (((row_id * 613 + k * 911 + m * 7907) % 4999) / 4999e0 - 0.5e0))) AS zm FROM logit
), mexp AS (
  SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS ez, list_transform(zm, lambda r: list_transform(r, lambda x: exp(x - list_max(r)))) AS em FROM memb
), mprob AS (
  SELECT *, list_transform(ez, lambda x: x / list_sum(ez)) AS pz, list_transform(em, lambda r: list_transform(r, lambda x: x / list_sum(r))) AS pm FROM mexp
), mean_ AS (
  SELECT *, CASE WHEN mode = 'pgs' THEN list_transform(range(1, 10), lambda k: list_sum(list_transform(pm, lambda r: r[k])) / {S.MEMBERS}) ELSE pz END AS probs,
    CASE WHEN mode = 'pgs' THEN list_transform(range(1, 10), lambda k: list_sum(list_transform(zm, lambda r: r[k])) / {S.MEMBERS}) END AS zbar FROM mprob
), ent AS (
  SELECT *, CASE WHEN mode = 'pgs' THEN -list_sum(list_transform(probs, lambda x: x * ln(least(1e0, greatest(x, 1e-12))))) END AS pred_entropy,
    CASE WHEN mode = 'pgs' THEN list_sum(list_transform(pm, lambda r: -list_sum(list_transform(r, lambda x: x * ln(least(1e0, greatest(x, 1e-12))))))) / {S.MEMBERS} END AS exp_entropy,
    CASE WHEN mode = 'pgs' THEN list_sum(list_transform(range(1, 10), lambda k: sqrt(list_sum(list_transform(pm, lambda r: pow(r[k] - probs[k], 2))) / {S.MEMBERS}))) / 9 END AS prob_std,
    list_transform(zbar, lambda x: exp(x - list_max(zbar))) AS eb FROM mean_
), preds AS (
  SELECT image, text, checkpoint, mode, split, row_id, label, (list_position(probs, list_max(probs)) - 1)::INT AS pred, probs,
    CASE WHEN mode = 'pgs' THEN greatest(0e0, pred_entropy - exp_entropy) END AS mi, pred_entropy, exp_entropy, prob_std,
    list_transform(eb, lambda x: x / list_sum(eb)) AS probs_loglin FROM ent
)"""


#: Metrics of one sample.
ROWS = """rows_ AS (
  SELECT *, (pred = label)::INT AS ok, list_max(probs) AS conf,
    list_sum(list_transform(range(0, 9), lambda k: pow(probs[k + 1] - CASE WHEN k = label THEN 1e0 ELSE 0e0 END, 2))) AS brier,
    -ln(least(1e0, greatest(probs[label + 1], 1e-12))) AS nll,
    len(list_filter(range(1, 15), lambda i: list_max(probs) > i / 15e0)) AS bin
  FROM preds
)"""
