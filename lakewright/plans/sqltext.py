"""Shared common table expressions of the SQL counterparts (DuckDB dialect)."""

from __future__ import annotations

import re

from lakewright.sources.derived import LOGS_SQL, PLANS_SQL, TRIALS_SQL


# Tables that several later ones read; DuckDB would otherwise compute them once per reader.
_SHARED = "accepted|repaired|stats|ids|splits|pool_ids|drawn|cand|cover|wl|nodes|sect|ops"


def with_(*ctes: str, select: str) -> str:
    tables = re.sub(rf"(?m)(^|, ?)({_SHARED}) AS \(", r"\1\2 AS MATERIALIZED (", ",\n".join(ctes))
    return "WITH RECURSIVE " + tables + "\n" + select


def fixed(expr: str, digits: int = 4) -> str:
    scale = 10**digits
    return f"array_to_string(list_transform({expr}, lambda x_: cast(cast(round(x_ * {scale}) AS bigint) AS varchar)), ',')"


def hash52(*parts: str) -> str:
    text = " || ':' || ".join(f"cast({p} AS varchar)" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 13))::bigint"


def uniform(*parts: str) -> str:
    return f"(({hash52(*parts)} + 0.5::double) / 4503599627370496::double)"


def normal(*parts: str) -> str:
    return f"(sqrt(-2.0 * ln({uniform(*parts, chr(39) + 'r' + chr(39))})) * cos(2.0 * pi() * {uniform(*parts, chr(39) + 'a' + chr(39))}))"


RAW = f"trials_raw AS ({TRIALS_SQL})"

ACCEPTED = r"""accepted AS (
  SELECT benchmark, file_name, sf, conf, engine_id, lake_id, lat AS latency,
    'sf' || sf || '_' || CASE WHEN regexp_matches(query_name, '^[a-z][\w-]*_\d+_(q\w+)$')
      THEN regexp_extract(query_name, '^[a-z][\w-]*_\d+_(q\w+)$', 1) ELSE query_name END AS query_id,
    list_concat(e_half, l_half, [engine_id::double, lake_id::double]) AS config
  FROM (
    SELECT *,
      CASE WHEN contains(conf, '|') THEN
        CASE WHEN len(list_filter(eh, lambda x: try_cast(x AS double) IS NULL)) > 0 THEN [0.0::double]
             ELSE list_transform(eh, lambda x: try_cast(x AS double)) END
      ELSE list_transform(string_split(conf, ';'), lambda x: coalesce(try_cast(
             regexp_replace(regexp_replace(trim(x), '[a-zA-Z]+$', ''), '^[^=]*=', '') AS double), 0.0::double)) END AS e_half,
      CASE WHEN contains(conf, '|') THEN
        CASE WHEN len(list_filter(lh, lambda x: try_cast(x AS double) IS NULL)) > 0 THEN [0.0::double]
             ELSE list_transform(lh, lambda x: try_cast(x AS double)) END
      ELSE [0.0::double] END AS l_half
    FROM (
      SELECT *, try_cast(trim(latency) AS double) AS lat,
        CASE engine WHEN 'spark' THEN 0 WHEN 'presto' THEN 1 WHEN 'trino' THEN 2 END AS engine_id,
        CASE datalake WHEN 'delta' THEN 0 WHEN 'iceberg' THEN 1 WHEN 'hudi' THEN 2 END AS lake_id,
        list_filter(string_split(split_part(conf, '|', 1), ';'), lambda x: trim(x) <> '') AS eh,
        list_filter(string_split(split_part(conf, '|', 2), ';'), lambda x: trim(x) <> '') AS lh
      FROM trials_raw) p
    WHERE lat >= 1500 AND engine_id IS NOT NULL AND lake_id IS NOT NULL
      AND engine <> '' AND datalake <> '' AND query_name <> '' AND sf <> '') q)"""

REC = "benchmark, query_id, engine_id, lake_id"

REPAIRED = f"""loc AS (
  SELECT {REC}, avg(ln(latency + 1)) AS mu, stddev_pop(ln(latency + 1)) AS sd
  FROM accepted WHERE latency <> 1500 GROUP BY ALL),
overall AS (
  SELECT engine_id, lake_id, avg(ln(latency + 1)) AS mu, stddev_pop(ln(latency + 1)) AS sd
  FROM accepted WHERE latency <> 1500 GROUP BY ALL),
repaired AS (
  SELECT a.benchmark, a.file_name, a.sf, a.query_id, a.engine_id, a.lake_id, a.conf, a.config,
    a.latency = 1500 AS repaired,
    CASE WHEN a.latency <> 1500 THEN a.latency ELSE greatest(1501.0::double,
      exp(coalesce(loc.mu, overall.mu, ln(10000.0)) + 0.5 * coalesce(CASE WHEN loc.sd IS NOT NULL THEN greatest(loc.sd, 0.1::double) END, CASE WHEN overall.sd IS NOT NULL THEN greatest(overall.sd, 0.1::double) END, 0.5::double)
        * {normal("42", "a.benchmark", "a.query_id", "a.engine_id", "a.lake_id", "a.conf")}) - 1) END AS latency
  FROM accepted a
  LEFT JOIN loc ON a.benchmark = loc.benchmark AND a.query_id = loc.query_id AND a.engine_id = loc.engine_id AND a.lake_id = loc.lake_id
  LEFT JOIN overall ON a.engine_id = overall.engine_id AND a.lake_id = overall.lake_id)"""

STATS = f"""stats AS (
  SELECT {REC}, min(latency) AS best_lat, count(*) AS n_records,
    arg_min(conf, (latency, conf)) AS best_conf, arg_min(config, (latency, conf)) AS best_config
  FROM repaired GROUP BY ALL),
qbest AS (
  SELECT benchmark, query_id, latency AS query_best, engine_id AS best_engine_id, lake_id AS best_lake_id,
    conf AS best_conf, config AS best_config
  FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, query_id ORDER BY latency, engine_id, lake_id, conf) AS rn FROM repaired)
  WHERE rn = 1)"""

SPLIT = """ids AS (SELECT DISTINCT benchmark, query_id FROM repaired),
splits AS (
  SELECT benchmark, query_id, CASE WHEN rk < floor(n * 0.7::double) THEN 'train'
    WHEN rk < floor(n * 0.7::double) + floor(n * 0.15::double) THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || benchmark || ':' || query_id)) - 1 AS rk, count(*) OVER () AS n FROM ids))"""


def workloads(split: str, wanted: int, seed: int) -> str:
    size_hash = hash52(str(seed), "attempt", "'size'")
    draw = hash52(str(seed), "attempt", "j")
    return f"""pool_ids AS (SELECT benchmark, query_id, row_number() OVER (ORDER BY benchmark, query_id) - 1 AS q_idx
  FROM splits WHERE split = '{split}'),
attempts AS (
  SELECT attempt, n, least(3, n) + {size_hash} % (least(15, n) - least(3, n) + 1) AS size
  FROM range(1, {wanted * 20 + 1}) r(attempt), (SELECT count(*) AS n FROM pool_ids) WHERE n > 0),
drawn AS (
  SELECT attempt, size, unnest(list_reduce(range(n - size, n), lambda taken, j: list_append(taken,
    CASE WHEN list_contains(taken, {draw} % (j + 1)) THEN j ELSE {draw} % (j + 1) END), CAST([] AS bigint[]))) AS q_idx
  FROM attempts),
cand AS (SELECT attempt, size, benchmark, query_id FROM drawn JOIN pool_ids USING (q_idx)),
cover AS (
  SELECT attempt, engine_id, lake_id FROM cand JOIN stats USING (benchmark, query_id)
  GROUP BY attempt, engine_id, lake_id HAVING count(DISTINCT (benchmark, query_id)) = min(size)),
wl AS (
  SELECT attempt AS workload_id FROM cover GROUP BY attempt HAVING count(*) >= 3 ORDER BY attempt LIMIT {wanted}),
members AS (SELECT workload_id, benchmark, query_id FROM cand JOIN wl ON attempt = workload_id),
covered AS (SELECT workload_id, engine_id, lake_id FROM cover JOIN wl ON attempt = workload_id),
totals AS (
  SELECT workload_id, engine_id, lake_id, sum(best_lat) AS total_lat
  FROM members JOIN covered USING (workload_id) JOIN stats USING (benchmark, query_id, engine_id, lake_id)
  GROUP BY ALL)"""


PLAN_FILES = f"plan_files AS ({PLANS_SQL})"
LOG_LINES = f"log_lines AS ({LOGS_SQL})"
