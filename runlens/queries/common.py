"""Registration of queries, and the adapters of ``sources.adapters`` as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

POINTS = """points AS (SELECT 'events' AS project_id, 'run' || (user_id % 8) AS run_id, event_type AS metric_name, '' AS tag, event_id AS step,
  epoch_us(ts) // 1000 AS timestamp_ms, (CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 101 = 0 THEN 'inf'::DOUBLE ELSE value END)::FLOAT AS value,
  NULL::VARCHAR AS cdn_key, NULL::VARCHAR AS text_data, ts AS inserted_at FROM events)"""
DENSE = """dense AS (SELECT 'p' || (l_suppkey % 2) AS project_id, 's' || (l_suppkey % 10) AS run_id, 'flag/' || l_returnflag AS metric_name,
  CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE (l_linenumber % 4)::VARCHAR END AS tag, l_orderkey % 1000 AS step, epoch_ms(l_shipdate) + l_partkey AS timestamp_ms,
  CASE WHEN l_orderkey % 50 NOT IN (7, 8) THEN l_extendedprice::FLOAT END AS value,
  CASE WHEN l_orderkey % 50 = 7 THEN 'a' || lpad(l_partkey::VARCHAR, 8, '0') || '.png' END AS cdn_key,
  CASE WHEN l_orderkey % 50 = 8 THEN 'line ' || l_partkey || chr(10) END AS text_data,
  epoch_ms(l_shipdate) + l_partkey % 1000 AS inserted_ms FROM lineitem)"""
LATEST = (
    DENSE
    + """, latest AS (SELECT * FROM dense QUALIFY row_number() OVER (PARTITION BY project_id, run_id, metric_name, tag, step
  ORDER BY inserted_ms DESC, value DESC NULLS LAST, cdn_key DESC NULLS LAST, text_data DESC NULLS LAST, timestamp_ms DESC) = 1)"""
)
RUNS = """runs AS (SELECT 'nation' || c_nationkey AS project_id, 'r' || o_orderkey AS run_id, 'Run ' || (o_orderkey % 700) AS run_name, o_orderkey AS k, o_orderstatus AS s,
  epoch_ms(o_orderdate) + o_orderkey % 1000 AS created,
  CASE WHEN o_orderstatus <> 'P' THEN epoch_ms(o_orderdate) + o_orderkey % 1000 + (o_orderkey % 90) * 1000 END AS main_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN epoch_ms(o_orderdate) + o_orderkey % 1000 + (o_orderkey % 650) * 1000 END AS system_at,
  epoch_ms(o_orderdate) + o_orderkey % 1000 + (o_orderkey % 700) * 1000 AS ingested,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END END AS exit_code,
  CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) + o_orderkey % 1000 + (o_orderkey % 600) * 1000 END AS terminated,
  CASE WHEN o_orderkey % 11 = 0 THEN epoch_ms(o_orderdate) + o_orderkey % 1000 + (o_orderkey % 20) * 86400000::BIGINT END AS deleted,
  CASE WHEN o_orderkey % 121 = 0 THEN epoch_ms(o_orderdate) + o_orderkey % 1000 + 40 * 86400000::BIGINT END AS purging,
  CASE WHEN o_orderkey % 363 = 0 THEN epoch_ms(o_orderdate) + o_orderkey % 1000 + 41 * 86400000::BIGINT END AS attempt
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
TEXTS = r"""texts AS (SELECT 'docs' AS project_id, source AS run_id, 'logs/' || lang AS metric_name, '' AS tag, doc_id AS step, doc_id * 1000 AS timestamp_ms,
  text || CASE doc_id % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(10) ELSE '' END AS text_data FROM documents)"""
MEDIA = "media AS (SELECT sha256(coalesce(html, '')) || '.bin' AS key, strlen(coalesce(html, '')) AS size, page_id * 3600000 AS created_ms, page_id, url FROM pages)"


def registry() -> tuple[dict, Callable]:
    """A module's queries and its registering decorator: ``@query(name, sql)``."""
    found: dict[str, tuple[Callable, str | None]] = {}

    def query(name: str, sql: str | None = None):
        def put(f: Callable) -> Callable:
            if name in found:
                raise ValueError(name)
            found[name] = (f, sql)
            return f

        return put

    return found, query
