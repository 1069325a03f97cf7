"""Where registered queries and the SQL beside them are kept, and SQL views of the driver's tables as ranking events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


EV = r"""ev AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts, regexp_extract(props, '"k":\s*(\d+)', 1) AS item, CAST(user_id AS VARCHAR) AS usr, event_type AS type, value FROM events)"""
RI = """ri AS (SELECT l_orderkey AS ranking, CAST(o_custkey AS VARCHAR) AS usr, epoch_ms(o_orderdate) AS ts, o_orderpriority AS priority,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS pos,
    CAST(l_partkey AS VARCHAR) AS item, CAST(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS BIGINT) AS label,
    l_extendedprice AS price, l_quantity AS quantity, l_discount AS relevancy FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RC = f"""{RI}, rc AS (SELECT ranking, item, usr, CASE label WHEN 2 THEN 'purchase' ELSE 'click' END AS type,
    ts + CAST(sum(quantity) OVER (PARTITION BY ranking ORDER BY pos) AS BIGINT) * 60000 AS ts, pos AS seq, ts AS shown FROM ri WHERE label > 0)"""
DAY = "86400000::BIGINT"
