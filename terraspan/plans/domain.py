"""The driver's tables as parcels, points, pixels, detections, lines and signals.

Each derivation is one SELECT that Spark and DuckDB both read, with the source
table's name in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan.functions import geometry as g

VIEWS = {
    # 25 parcels on a grid of 200: squares of 150, every second one a triangle
    "parcels": """SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS grp, CAST(n_nationkey AS BIGINT) AS ord, CAST((n_nationkey % 5) * 200 AS DOUBLE) AS x0,
        CAST(floor(n_nationkey / 5.0) * 200 AS DOUBLE) AS y0, n_nationkey % 2 = 1 AS tri FROM {nation}""",
    "points": "SELECT c_custkey AS pid, CAST((c_custkey * 7919) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 1000 AS DOUBLE) AS y FROM {customer}",
    # one row a pixel; 0 in all of red, green and blue is NoData
    "pixels": """SELECT (l_partkey * 31 + l_suppkey * 17) % 1000 AS "row", (l_partkey * 13 + l_suppkey * 101) % 1000 AS col, max(l_quantity * 4 % 200) AS red,
        max(CAST(round(l_tax * 1000) AS DOUBLE)) AS green, max(CAST(round(l_discount * 800) AS DOUBLE)) AS blue, max(l_quantity + round(l_discount * 100)) AS nir, min(l_quantity) AS edge FROM {lineitem} GROUP BY 1, 2""",
    "detections": """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Maleza' WHEN '2-HIGH' THEN 'weed' WHEN '3-MEDIUM' THEN 'crop' ELSE 'planta' END AS class,
        CAST((o_orderkey * 37) % 100 AS DOUBLE) / 100 AS conf, CAST((o_orderkey * 7919) % 990 AS DOUBLE) AS x1, CAST((o_custkey * 104729) % 990 AS DOUBLE) AS y1,
        CAST((o_orderkey * 7919) % 990 + 4 + o_custkey % 9 AS DOUBLE) AS x2, CAST((o_custkey * 104729) % 990 + 4 + o_orderkey % 11 AS DOUBLE) AS y2 FROM {orders}""",
    # segments of one dimension along each customer's line
    "segments": """SELECT o_custkey AS line, o_orderkey AS seg, CAST((o_orderkey * 31) % 5000 AS DOUBLE) AS x1, CAST(o_orderkey % 3 AS DOUBLE) AS y1,
        CAST((o_orderkey * 31) % 5000 + o_orderkey % 40 + 1 AS DOUBLE) AS x2, CAST(o_orderkey % 3 AS DOUBLE) AS y2 FROM {orders}""",
    "signal": "SELECT user_id AS line, event_id AS pos, CAST(value AS DOUBLE) AS v FROM {events}",
    "labels_boxes": """SELECT p_partkey AS lid, CAST((p_partkey * 7919) % 960 AS DOUBLE) AS rx1, CAST((p_partkey * 611953) % 960 AS DOUBLE) AS ry1,
        CAST((p_partkey * 7919) % 960 + 5 + p_size % 20 AS DOUBLE) AS rx2, CAST((p_partkey * 611953) % 960 + 5 + p_size % 15 AS DOUBLE) AS ry2 FROM {part}""",
    "lonlat": """SELECT s_suppkey AS id, CAST((s_suppkey * 7919) % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST((s_suppkey * 104729) % 1600 AS DOUBLE) / 10 - 80 AS lat FROM {supplier}""",
    "scored": "SELECT vec_id, CAST(label AS BIGINT) AS grp, CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS y, CAST(round({first} * 50) AS DOUBLE) / 50 AS score FROM {embeddings}",
}


def _first(engine: str) -> str:
    return "element_at(embedding, 1)" if engine == "spark" else "embedding[1]"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a DataFrame."""
    sql = VIEWS[name].replace("{first}", _first("spark")).replace('"row"', "row")
    source = re.search(r"FROM \{(\w+)\}", sql)[1]
    out = spark.sql(sql, **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})
    return out if name != "parcels" else out.withColumn("ring", parcel_ring())


def parcel_ring():
    x, y = F.col("x0"), F.col("y0")
    square = g.ring((x, y), (x + 150, y), (x + 150, y + 150), (x, y + 150))
    return F.when(F.col("tri"), g.ring((x, y), (x + 150, y), (x, y + 150))).otherwise(square)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names put before it."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n].replace('{first}', _first('duckdb')))})" for n in used]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(heads)}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(heads)}, {body[5:]}"
    return f"WITH {', '.join(heads)} {body}" if heads else body
