"""DuckDB text of the fixture views, prefixed to every oracle query.

The SQL body of a registered query may reference ``tx`` and ``scored``; ``with_fixture`` turns it into one runnable statement.
"""

from __future__ import annotations

FIXTURE_CTES = """WITH fx_base AS (
 SELECT e.event_id AS transaction_id, e.user_id AS customer_id, e.ts AS ts, e.value AS amount,
  e.event_type AS channel,
  CAST(regexp_extract(e.props, '[0-9]+', 0) AS INT) AS k,
  c.c_mktsegment AS merchant_category, concat('B', CAST(e.user_id % 10 AS VARCHAR(10))) AS bank,
  r.r_name AS location,
  CAST(hour(e.ts) AS INT) AS hour, CAST(isodow(e.ts) - 1 AS INT) AS day_of_week,
  CAST(month(e.ts) AS INT) AS month,
  CASE WHEN c.c_acctbal < 1000 THEN '<20' WHEN c.c_acctbal < 4000 THEN '20-29'
       WHEN c.c_acctbal < 7000 THEN '30-39' ELSE '40+' END AS age_group
 FROM events e JOIN customer c ON e.user_id = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
tx AS (
 SELECT fx_base.*,
  CAST(CASE WHEN k < 1 OR ((hour >= 22 OR hour < 6) AND amount > 100 AND k < 60) THEN 1 ELSE 0 END AS INT)
    AS is_fraud,
  CASE WHEN k < 1 THEN 'random'
       WHEN (hour >= 22 OR hour < 6) AND amount > 100 AND k < 60 THEN 'night_large' END AS fraud_technique
 FROM fx_base),
scored AS (
 SELECT tx.*,
  CAST(LEAST(1000, CAST(floor(amount * 2) AS INT)
   + CASE WHEN hour >= 22 OR hour < 6 THEN 200 ELSE 0 END
   + CAST((transaction_id * 37) % 100 AS INT)) AS DOUBLE) / CAST(1000 AS DOUBLE) AS score,
  CAST(LEAST(1000, CAST(floor(amount * 2) AS INT)
   + CAST((transaction_id * 37) % 100 AS INT)) AS DOUBLE) / CAST(1000 AS DOUBLE) AS score_b
 FROM tx)"""


def with_fixture(body: str) -> str:
    body = body.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE" + FIXTURE_CTES[4:] + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return FIXTURE_CTES + ",\n" + body[4:].lstrip()
    return FIXTURE_CTES + "\n" + body
