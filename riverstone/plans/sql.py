"""Pieces of SQL (DuckDB) that the oracles of the registered queries share."""

from __future__ import annotations

E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings)"


def u(seed: int, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0)"


def sq(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def cosine(a: str, b: str) -> str:
    s = lambda x, y: f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: {x}[i] * {y}[i]))"
    return f"(1 - {s(a, b)} / sqrt({s(a, a)} * {s(b, b)}))"


CENTER = f"c AS (SELECT vec_id AS cid, f AS cf FROM e ORDER BY {u(3, 'vec_id')}, vec_id LIMIT 1)"
COSTS = f"d AS (SELECT e.vec_id, e.f, c.cid, {sq('e.f', 'c.cf')} AS d2 FROM e, c)"
RUN = "r AS (SELECT *, sum(d2) OVER (ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS acc, sum(d2) OVER () AS total FROM d)"
CANDIDATES = f"""h AS (SELECT t.range AS try, r.vec_id FROM range(3) t, r WHERE r.acc >= {u(5, 't.range')} * r.total AND r.vec_id <> r.cid QUALIFY row_number() OVER (PARTITION BY t.range ORDER BY r.vec_id) <= 3),
  h1 AS (SELECT list(vec_id ORDER BY vec_id) FILTER (WHERE try = 0) AS a, list(vec_id ORDER BY vec_id) FILTER (WHERE try = 1) AS b, list(vec_id ORDER BY vec_id) FILTER (WHERE try = 2) AS c FROM h),
  h2 AS (SELECT a[1] AS x, list_filter(b, lambda v: v <> a[1])[1] AS y, c FROM h1), h3 AS (SELECT x, y, list_filter(c, lambda v: v <> x AND v <> y)[1] AS z FROM h2),
  k AS (SELECT * FROM (SELECT unnest([0, 1, 2]) AS try, unnest([x, y, z]) AS candidate FROM h3) WHERE candidate IS NOT NULL)"""
COSTED = f"""n AS (SELECT candidate, sum(least(d2, nd)) AS new_cost, sum(CASE WHEN nd <= d2 THEN 1 ELSE 0 END) AS new_side
  FROM (SELECT q.candidate, d.d2, {sq('d.f', 'q.nf')} AS nd FROM d, (SELECT DISTINCT k.candidate, e.f AS nf FROM k JOIN e ON e.vec_id = k.candidate) q) GROUP BY 1)"""
BEST = "b AS (SELECT n.candidate, e.f AS bf FROM n JOIN e ON e.vec_id = n.candidate ORDER BY new_cost, candidate LIMIT 1)"
SPLIT = f"s AS (SELECT vec_id, CASE WHEN d2 < nd THEN 0 ELSE 1 END AS side, least(d2, nd) AS d2 FROM (SELECT d.vec_id, d.d2, {sq('d.f', 'b.bf')} AS nd FROM d, b))"
TREE = ", ".join((E, CENTER, COSTS, RUN, CANDIDATES, COSTED, BEST, SPLIT))
FIRST = "z0 AS (SELECT vec_id AS cluster, f FROM e WHERE vec_id < 3)"


def assigned(name: str, centroids: str, points: str = "e") -> str:
    return f"""{name} AS (SELECT vec_id, label, f, dist AS distance, cluster FROM (SELECT p.vec_id, p.label, p.f, z.cluster, {sq('p.f', 'z.f')} AS dist FROM {points} p, {centroids} z)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) = 1)"""


def flat(source: str) -> str:
    """cluster, dim, x of the rows of a source with cluster and f."""
    return f"(SELECT cluster, i - 1 AS dim, f[i] AS x FROM {source}, range(1, 65) t(i))"


def lloyd_round(k: int) -> str:
    a = assigned(f"a{k}", f"z{k}")
    m = f"m{k} AS (SELECT cluster, list(x ORDER BY dim) AS f FROM (SELECT cluster, dim, avg(x) AS x FROM {flat(f'a{k}')} GROUP BY 1, 2) GROUP BY 1)"
    return f"{a}, {m}, z{k + 1} AS (SELECT z{k}.cluster, coalesce(m{k}.f, z{k}.f) AS f FROM z{k} LEFT JOIN m{k} USING (cluster))"


def minibatch_round(k: int, size: int | str, weight: str = "1") -> str:
    """One batch, closed form: the weighted mean of what a cluster has seen, and starts counting at 0."""
    batch = f"p{k} AS (SELECT * FROM e WHERE vec_id // {size} = {k})"
    a = assigned(f"a{k}", f"z{k}", f"p{k}")
    m = f"m{k} AS (SELECT cluster, list(x ORDER BY dim) AS total, any_value(n) AS n FROM (SELECT cluster, i - 1 AS dim, sum(f[i] * {weight}) AS x, sum({weight}) AS n FROM a{k}, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)"
    z = f"""z{k + 1} AS (SELECT z.cluster, z.seen + coalesce(m.n, 0) AS seen, CASE WHEN m.n IS NULL THEN z.f
  ELSE list_transform(range(1, 65), lambda i: (z.f[i] * z.seen + m.total[i]) / (z.seen + m.n)) END AS f FROM z{k} z LEFT JOIN m{k} m USING (cluster))"""
    return f"{batch}, {a}, {m}, {z}"


def plus_plus(seed: int, k: int) -> str:
    """c0, c1 ... (cid, cf): seeds by k-means++; p0, p1 ... (vec_id, f, d2): rows and their distance to the nearest seed so far."""
    first = f"c0 AS (SELECT vec_id AS cid, f AS cf FROM e ORDER BY {u(seed, 'vec_id')}, vec_id LIMIT 1), p0 AS (SELECT vec_id, f, {sq('e.f', 'c0.cf')} AS d2 FROM e, c0)"
    run = "SELECT *, sum(d2) OVER (ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS acc, sum(d2) OVER () AS total FROM"
    more = [
        f"c{i} AS (SELECT vec_id AS cid, f AS cf FROM ({run} p{i - 1}) WHERE d2 > 0 AND acc >= {u(seed, str(i))} * total ORDER BY vec_id LIMIT 1), p{i} AS (SELECT p.vec_id, p.f, least(p.d2, {sq('p.f', f'c{i}.cf')}) AS d2 FROM p{i - 1} p, c{i})"
        for i in range(1, k)
    ]
    return ", ".join([first, *more])


def oversampled(seed: int, many: float, rounds: int) -> str:
    """c (round, cid, cf): candidates of k-means||; a (vec_id, cid): the candidate that each row is nearest to, the first of equals."""
    chance = lambda r: f"(CAST('0x' || substr(md5('{seed}:{r}:' || vec_id), 1, 8) AS BIGINT) / 4294967296.0)"
    out = [f"r0 AS (SELECT 0 AS round, vec_id AS cid, f AS cf FROM e ORDER BY {u(seed, 'vec_id')}, vec_id LIMIT 1)"]
    for r in range(1, rounds + 1):
        known = " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(r))
        out.append(f"d{r} AS (SELECT e.vec_id, any_value(e.f) AS f, min({sq('e.f', 'k.cf')}) AS d2 FROM e, ({known}) k GROUP BY 1)")
        out.append(f"r{r} AS (SELECT {r} AS round, vec_id AS cid, f AS cf FROM d{r}, (SELECT sum(d2) AS total FROM d{r}) WHERE d2 > 0 AND {chance(r)} < {many} * d2 / total)")
    out.append("c AS (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(rounds + 1)) + ")")
    out.append(f"a AS (SELECT e.vec_id, c.cid FROM e, c QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY {sq('e.f', 'c.cf')}, c.round, c.cid) = 1)")
    return ", ".join(out)
