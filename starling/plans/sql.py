"""The same results in plain SQL, for checking against another engine."""

from __future__ import annotations

import math


def r(expression: str, digits: int = 6) -> str:
    """Rounded, and without the minus sign of a negative zero."""
    return f"(round({expression}, {digits}) + 0.0)"


def features(dims: int, form: str = "f{j}", glue: str = ", ") -> str:
    return glue.join(form.format(j=j) for j in range(dims))


def d2(a: str, b: str, dims: int) -> str:
    return " + ".join(f"({a}.f{j} - {b}.f{j}) * ({a}.f{j} - {b}.f{j})" for j in range(dims))


def scaled(source: str, dims: int, name: str = "ff") -> str:
    """CTE: population-standardised features."""
    columns = features(dims, "(f{j} - (SELECT avg(f{j}) FROM {s})) / (SELECT stddev_pop(f{j}) FROM {s}) AS f{j}".replace("{s}", source))
    return f"{name} AS MATERIALIZED (SELECT row_id, {columns} FROM {source})"


PART_RAW = "raw AS (SELECT p_partkey AS row_id, p_size::DOUBLE AS f0, p_retailprice AS f1 FROM part)"
PART = f"{PART_RAW}, {scaled('raw', 2)}"
ORDER_RAW = (
    "raw AS MATERIALIZED (SELECT l_orderkey AS row_id, sum(l_quantity) AS f0, avg(l_extendedprice) AS f1, "
    "avg(l_discount) AS f2, count(*)::DOUBLE AS f3 FROM lineitem GROUP BY l_orderkey)"
)
ORDERS = f"{ORDER_RAW}, {scaled('raw', 4)}"
LABELLED = "lab AS MATERIALIZED (SELECT *, (row_id % 4)::INT AS cluster FROM ff)"
NOISY = "lab AS MATERIALIZED (SELECT *, (row_id % 5 - 1)::INT AS cluster FROM ff)"
EMBEDDING_CELLS = (
    "cells AS MATERIALIZED (SELECT vec_id AS row_id, label, generate_subscripts(embedding, 1) - 1 AS position, "
    "unnest(embedding)::DOUBLE AS value FROM embeddings)"
)
# The first component of the 64 coordinates: the covariance squared sixteen times over, scaled by its trace each
# time, is the axis times itself. Matrices are lists of 4096 numbers, row by row.
FIRST_AXIS = f"""{EMBEDDING_CELLS},
mu AS (SELECT position, avg(value) AS mean FROM cells GROUP BY 1), m AS (SELECT list(mean ORDER BY position) AS mean FROM mu),
d AS MATERIALIZED (SELECT row_id, position, value - mean AS x FROM cells JOIN mu USING (position)),
cov AS MATERIALIZED (SELECT a.position AS i, b.position AS j, sum(a.x * b.x) AS c FROM d a JOIN d b USING (row_id) GROUP BY 1, 2),
first AS (SELECT list(c ORDER BY i, j) AS c, sum(c) FILTER (i = j) AS t FROM cov),
power(step, p) AS (SELECT 0, list_transform(c, lambda x: x / t) FROM first UNION ALL
  SELECT step + 1, list_transform(q, lambda x: x / list_sum(list_transform(range(64), lambda i: q[i * 65 + 1])))
  FROM (SELECT step, list_transform(range(4096), lambda k: list_dot_product(
    p[(k // 64) * 64 + 1:(k // 64) * 64 + 64], p[(k % 64) * 64 + 1:(k % 64) * 64 + 64])) AS q FROM power WHERE step < 16)),
last AS (SELECT p, list_position(diag, list_max(diag)) - 1 AS top FROM
  (SELECT p, list_transform(range(64), lambda i: p[i * 65 + 1]) AS diag FROM power WHERE step = 16)),
axis AS (SELECT list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS v,
  list_dot_product(raw, list_transform(range(64), lambda i: list_dot_product(raw, c[i * 64 + 1:i * 64 + 64])))
  / list_dot_product(raw, raw) / t AS ratio
  FROM (SELECT p[top * 64 + 1:top * 64 + 64] AS raw FROM last), first)"""
EMBEDDING_CENTERS = "centers AS MATERIALIZED (SELECT label AS cluster, position, avg(value) AS value FROM cells GROUP BY ALL)"
EMBEDDING_GAPS = (
    "gaps AS MATERIALIZED (SELECT row_id, cluster, sum((x.value - c.value) * (x.value - c.value)) AS d2 "
    "FROM cells x JOIN centers c USING (position) GROUP BY ALL)"
)
SOFT = (
    "kernel AS (SELECT row_id, cluster, 1.0 / (1.0 + d2) AS w FROM gaps), "
    "soft AS MATERIALIZED (SELECT row_id, cluster, w / sum(w) OVER (PARTITION BY row_id) AS q FROM kernel)"
)
TARGET = (
    "weights AS (SELECT row_id, cluster, q, q * q / sum(q) OVER (PARTITION BY cluster) AS w FROM soft), "
    "target AS MATERIALIZED (SELECT row_id, cluster, q, w / sum(w) OVER (PARTITION BY row_id) AS p FROM weights)"
)


def silhouette(source: str, dims: int, name: str = "sil") -> str:
    """CTEs: per-row a, b and score by a full self join."""
    return f"""
    {name}_sums AS MATERIALIZED (
      SELECT i.row_id, i.cluster, j.cluster AS label, sum(sqrt({d2('i', 'j', dims)})) AS total, count(*) AS n
      FROM {source} i CROSS JOIN {source} j GROUP BY ALL),
    {name}_ab AS (
      SELECT row_id, cluster, max(n) FILTER (label = cluster) AS own,
             max(total) FILTER (label = cluster) / nullif(max(n) FILTER (label = cluster) - 1, 0) AS a,
             min(total / n) FILTER (label <> cluster) AS b
      FROM {name}_sums GROUP BY ALL),
    {name} AS MATERIALIZED (
      SELECT row_id, cluster, coalesce(a, 0.0) AS a, b,
             CASE WHEN b IS NULL THEN NULL WHEN own <= 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS silhouette
      FROM {name}_ab)"""


def dispersion(source: str, dims: int, name: str = "disp") -> str:
    """CTEs: Calinski-Harabasz and Davies-Bouldin in one row ``ch, db, w``."""
    means = features(dims, "avg(f{j}) AS f{j}")
    return f"""
    {name}_c AS MATERIALIZED (SELECT cluster, count(*) AS n, {means} FROM {source} GROUP BY cluster),
    {name}_g AS (SELECT count(*) AS n, {means} FROM {source}),
    {name}_s AS MATERIALIZED (
      SELECT x.cluster, avg(sqrt({d2('x', 'c', dims)})) AS spread, sum({d2('x', 'c', dims)}) AS ss
      FROM {source} x JOIN {name}_c c USING (cluster) GROUP BY x.cluster),
    {name}_b AS (SELECT sum(c.n * ({d2('c', 'g', dims)})) AS between_ss, count(*) AS k FROM {name}_c c CROSS JOIN {name}_g g),
    {name}_r AS (
      SELECT a.cluster, max((sa.spread + sb.spread) / sqrt({d2('a', 'b', dims)})) AS worst
      FROM {name}_c a JOIN {name}_c b ON a.cluster <> b.cluster
      JOIN {name}_s sa ON sa.cluster = a.cluster JOIN {name}_s sb ON sb.cluster = b.cluster GROUP BY a.cluster),
    {name} AS (
      SELECT (between_ss / (k - 1)) / (w / (n - k)) AS ch, (SELECT avg(worst) FROM {name}_r) AS db, w
      FROM {name}_b CROSS JOIN (SELECT n FROM {name}_g) CROSS JOIN (SELECT sum(ss) AS w FROM {name}_s))"""


def dbscan(eps: float, min_samples: int, source: str = "ff", dims: int = 2) -> str:
    """CTEs (recursive): ``lab`` with the density clusters of ``source``."""
    return f"""
    nb AS MATERIALIZED (SELECT a.row_id AS i, b.row_id AS j FROM {source} a JOIN {source} b ON {d2('a', 'b', dims)} <= {eps} * {eps}),
    core AS MATERIALIZED (SELECT i FROM nb GROUP BY i HAVING count(*) >= {min_samples}),
    links AS MATERIALIZED (SELECT i, j FROM nb WHERE i IN (FROM core) AND j IN (FROM core)),
    reach AS (SELECT i, i AS root FROM core UNION SELECT l.j, p.root FROM reach p JOIN links l ON l.i = p.i),
    parts AS MATERIALIZED (SELECT i, min(root) AS root FROM reach GROUP BY i),
    numbered AS MATERIALIZED (SELECT i, (dense_rank() OVER (ORDER BY root) - 1)::INT AS cluster FROM parts),
    borders AS (SELECT nb.i, min(n.cluster) AS cluster FROM nb JOIN numbered n ON n.i = nb.j WHERE nb.i NOT IN (FROM core) GROUP BY nb.i),
    lab AS MATERIALIZED (
      SELECT x.*, coalesce(n.cluster, b.cluster, -1)::INT AS cluster
      FROM {source} x LEFT JOIN numbered n ON n.i = x.row_id LEFT JOIN borders b ON b.i = x.row_id)"""


def nearest(centers: str, name: str, dims: int, source: str = "ff") -> str:
    return f"""{name} AS MATERIALIZED (
      SELECT x.row_id, {features(dims, 'any_value(x.f{j}) AS f{j}')}, min({{'d': {d2('x', 'c', dims)}, 'c': c.cluster}}) AS best
      FROM {source} x CROSS JOIN {centers} c GROUP BY x.row_id)"""


def lloyd(k: int, rounds: int, dims: int) -> str:
    """CTEs: ``assigned`` after fixed Lloyd rounds from the k lowest distinct rows."""
    parts = [
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY rid) - 1)::INT AS cluster, {features(dims)} FROM
        (SELECT {features(dims)}, min(row_id) AS rid FROM ff GROUP BY {features(dims)} ORDER BY rid LIMIT {k}))"""
    ]
    for i in range(rounds):
        parts.append(nearest(f"c{i}", f"a{i}", dims))
        means = features(dims, "avg(f{j}) AS f{j}")
        kept = features(dims, "coalesce(m.f{j}, p.f{j}) AS f{j}")
        parts.append(
            f"c{i + 1} AS MATERIALIZED (SELECT p.cluster, {kept} FROM c{i} p LEFT JOIN "
            f"(SELECT best.c AS cluster, {means} FROM a{i} GROUP BY best.c) m USING (cluster))"
        )
    parts.append(nearest(f"c{rounds}", "assigned", dims))
    return ", ".join(parts)


def dec(k: int, rounds: int, lr: float, dims: int = 2) -> str:
    """CTEs: centres after fixed refinement rounds (alpha 1), from means by row_id % k."""
    means = features(dims, "avg(f{j}) AS f{j}")
    parts = [f"c0 AS MATERIALIZED (SELECT (row_id % {k})::INT AS cluster, {means} FROM ff GROUP BY ALL)"]
    for i in range(rounds + 1):
        parts.append(
            f"k{i} AS (SELECT x.row_id, c.cluster, {features(dims, 'x.f{j} - c.f{j} AS g{j}')}, 1.0 / (1.0 + {d2('x', 'c', dims)}) AS w FROM ff x CROSS JOIN c{i} c), "
            f"q{i} AS MATERIALIZED (SELECT *, w / sum(w) OVER (PARTITION BY row_id) AS q FROM k{i})"
        )
        if i < rounds:
            moves = features(dims, "c.f{j} - " + str(lr) + " * s.g{j} / (SELECT count(*) FROM ff) AS f{j}")
            sums = features(dims, "sum(2.0 * w * (q - p) * g{j}) AS g{j}")
            parts.append(
                f"u{i} AS (SELECT *, q * q / sum(q) OVER (PARTITION BY cluster) AS v FROM q{i}), "
                f"p{i} AS (SELECT *, v / sum(v) OVER (PARTITION BY row_id) AS p FROM u{i}), "
                f"s{i} AS (SELECT cluster, {sums} FROM p{i} GROUP BY cluster), "
                f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, {moves} FROM c{i} c JOIN s{i} s USING (cluster))"
            )
    return ", ".join(parts)


def agreement(cells: str) -> str:
    """One row: adjusted Rand and normalised mutual information of (t, p)."""
    return f"""
    WITH cells AS MATERIALIZED (SELECT t, p, count(*)::DOUBLE AS n FROM ({cells}) GROUP BY ALL),
    a AS (SELECT sum(n) AS n FROM cells GROUP BY t), b AS (SELECT sum(n) AS n FROM cells GROUP BY p),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS ij, (SELECT sum(n * (n - 1) / 2) FROM a) AS i,
                 (SELECT sum(n * (n - 1) / 2) FROM b) AS j, (SELECT sum(n) FROM cells) AS n,
                 (SELECT sum(n * ln(n)) FROM cells) AS lij, (SELECT sum(n * ln(n)) FROM a) AS li, (SELECT sum(n * ln(n)) FROM b) AS lj),
    e AS (SELECT *, i * j / (n * (n - 1) / 2) AS expected FROM s)
    SELECT {r('(ij - expected) / ((i + j) / 2 - expected)')} AS adjusted_rand,
           {r('((lij - li - lj) / n + ln(n)) / ((2 * ln(n) - (li + lj) / n) / 2)')} AS normalized_mutual_info
    FROM e"""


def uniform(*keys: str) -> str:
    """Uniform number in (0, 1) from the md5 of the keys' text."""
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def normal(seed: int, *keys: str) -> str:
    return (
        f"(sqrt(-2.0 * ln({uniform(*keys, chr(39) + 'a' + chr(39), str(seed))})) * "
        f"cos({2.0 * math.pi!r} * {uniform(*keys, chr(39) + 'b' + chr(39), str(seed))}))"
    )


def sequential_filter(columns: list[str], source: str, method: str, threshold: float) -> str:
    """CTEs t0..tn: each column filtered on what the ones before left over."""
    parts = [f"t0 AS MATERIALIZED ({source})"]
    for i, c in enumerate(columns):
        if method == "iqr":
            q1, q3 = f"(SELECT quantile_cont({c}, 0.25) FROM t{i})", f"(SELECT quantile_cont({c}, 0.75) FROM t{i})"
            test = f"{c} >= {q1} - {threshold} * ({q3} - {q1}) AND {c} <= {q3} + {threshold} * ({q3} - {q1})"
        else:
            test = f"abs(({c} - (SELECT avg({c}) FROM t{i})) / (SELECT stddev_pop({c}) FROM t{i})) < {threshold}"
        parts.append(f"t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} WHERE {test})")
    return ", ".join(parts)
