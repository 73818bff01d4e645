"""A module graph over the star-schema tables, as SQL that both Spark and other engines run.

Regions re-export their nations, nations their suppliers, customers import from either, suppliers import parts, and
parts of one brand and size import each other in rings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "lineitem")


def _id(prefix: str, key: str) -> str:
    return f"'{prefix}:' || cast({key} AS STRING)"


ENCODING = f"""
sup AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
tsup AS (
  SELECT {_id("n", "s_nationkey")} AS target, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS idx FROM sup
  UNION ALL
  SELECT {_id("r", "n_regionkey")}, s_suppkey, s_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) - 1 FROM sup),
tcnt AS (SELECT target, count(*) AS cnt FROM tsup GROUP BY target),
modules AS (
  SELECT {_id("r", "r_regionkey")} AS path, false AS has_side_effects, 0 AS own_decls FROM region
  UNION ALL SELECT {_id("n", "n_nationkey")}, n_nationkey % 7 = 0, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END FROM nation
  UNION ALL SELECT {_id("s", "s_suppkey")}, false, 1 FROM supplier
  UNION ALL SELECT {_id("p", "p_partkey")}, false, 1 FROM part
  UNION ALL SELECT {_id("c", "c_custkey")}, false, 0 FROM customer),
exports AS (
  SELECT {_id("r", "n_regionkey")} AS module, cast(n_nationkey AS BIGINT) AS ord, 'star' AS kind, cast(NULL AS STRING) AS name, cast(NULL AS STRING) AS local, cast(NULL AS STRING) AS imported, {_id("n", "n_nationkey")} AS src, false AS type_only FROM nation
  UNION ALL SELECT {_id("r", "r_regionkey")}, cast(1000 AS BIGINT), 'star', NULL, NULL, NULL, {_id("r", "1 - r_regionkey")}, false FROM region WHERE r_regionkey IN (0, 1)
  UNION ALL SELECT {_id("n", "s_nationkey")}, cast(s_suppkey AS BIGINT), 'named', s_name, NULL, s_name, {_id("s", "s_suppkey")}, s_acctbal < 0 FROM sup
  UNION ALL SELECT target, cast(1000000001 AS BIGINT), 'named', 'Top', NULL, s_name, {_id("s", "s_suppkey")}, false FROM tsup WHERE idx = 0 AND target LIKE 'n:%'
  UNION ALL SELECT {_id("n", "n_nationkey")}, cast(1000000002 AS BIGINT), 'named', 'Ext', NULL, 'Ext', 'ext:lib', false FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT {_id("n", "n_nationkey")}, cast(1000000003 AS BIGINT), 'local', 'Own', 'Own', NULL, NULL, false FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT {_id("s", "s_suppkey")}, cast(0 AS BIGINT), 'local', s_name, s_name, NULL, NULL, false FROM supplier
  UNION ALL SELECT {_id("p", "p_partkey")}, cast(0 AS BIGINT), 'local', 'P' || cast(p_partkey AS STRING), 'P' || cast(p_partkey AS STRING), NULL, NULL, false FROM part),
cust AS (
  SELECT c_custkey AS k, c_mktsegment AS seg, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN {_id("r", "n_regionkey")} ELSE {_id("n", "n_nationkey")} END AS target
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
ring AS (
  SELECT p_partkey AS k, coalesce(lead(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey), min(p_partkey) OVER (PARTITION BY p_brand, p_size)) AS nxt, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS fst
  FROM part WHERE p_size <= 10 AND p_type = 'ECONOMY'),
used_parts AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 7 AND l_quantity >= 49),
imports AS (
  SELECT {_id("c", "k")} AS module, cast(0 AS BIGINT) AS ord, target, CASE WHEN seg = 'MACHINERY' THEN 'namespace' WHEN seg = 'FURNITURE' AND k % 2 = 0 THEN 'dynamic' WHEN seg = 'FURNITURE' THEN 'sideEffect' ELSE 'named' END AS kind, seg = 'HOUSEHOLD' AND k % 2 = 0 AS type_only FROM cust
  UNION ALL SELECT {_id("s", "l_suppkey")}, cast(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS BIGINT), {_id("p", "l_partkey")}, 'named', false FROM used_parts
  UNION ALL SELECT {_id("p", "k")}, cast(0 AS BIGINT), {_id("p", "nxt")}, 'named', false FROM ring
  UNION ALL SELECT {_id("p", "k")}, cast(1 AS BIGINT), {_id("p", "fst")}, 'named', true FROM ring WHERE k % 2 = 0),
bindings AS (
  SELECT {_id("c", "k")} AS module, cast(0 AS BIGINT) AS ord, cast(0 AS BIGINT) AS bord, '*' AS imported FROM cust WHERE seg = 'MACHINERY'
  UNION ALL SELECT {_id("c", "k")}, cast(0 AS BIGINT), cast(0 AS BIGINT), CASE WHEN k % 10 = 0 THEN 'Missing' WHEN k % 10 = 1 THEN 'Top' WHEN k % 10 = 2 THEN 'Ext' ELSE coalesce(s_name, 'Missing') END
    FROM cust c LEFT JOIN tcnt t ON c.target = t.target LEFT JOIN tsup s ON s.target = c.target AND s.idx = c.k % t.cnt WHERE seg NOT IN ('MACHINERY', 'FURNITURE')
  UNION ALL SELECT {_id("c", "k")}, cast(0 AS BIGINT), cast(1 AS BIGINT), coalesce(s_name, 'Missing')
    FROM cust c LEFT JOIN tcnt t ON c.target = t.target LEFT JOIN tsup s ON s.target = c.target AND s.idx = (c.k + 1) % t.cnt WHERE seg NOT IN ('MACHINERY', 'FURNITURE') AND k % 3 = 0
  UNION ALL SELECT module, ord, cast(0 AS BIGINT), 'P' || substring(target, 3) FROM imports WHERE module LIKE 's:%' OR module LIKE 'p:%')
"""


def encoded(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables modules, exports, imports and bindings."""
    tables = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES)
    return spark.sql(f"WITH {tables}, {ENCODING} SELECT * FROM {name}")
