"""Queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import key_chunks
from tessera.plans import catalog_eval, catalog_items, catalog_retrieval
from tessera.sources.tables import table

_PARTS = (catalog_items, catalog_eval, catalog_retrieval)


def queries():
    own = {
        "p2_found": lambda s, d: key_chunks.skew_report(table(s, d, "examples"), table(s, d, "assignments")),
        "p2_subjects": lambda s, d: _named(key_chunks.profile(table(s, d, "examples"), F.col("subject"), F.col("ingested_at"), F.col("example_id")), "subject"),
        "p2_clients": lambda s, d: _named(key_chunks.profile(table(s, d, "assignments"), F.col("client_id"), F.col("assigned_at"), F.col("example_id")), "client_id"),
    }
    return own | {k: v for part in _PARTS for k, v in part.queries().items()}


def _named(df, name):
    return df.select(F.col("key").alias(name), "n_rows", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_at"), F.date_format("last_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_at"), "max_gap_s")


def _profile_sql(source, key, at):
    return f"""
        WITH g AS (SELECT {key} AS k, {at} AS t, {at} - lag({at}) OVER (PARTITION BY {key} ORDER BY {at}, example_id) AS gap FROM {source} WHERE {key} IS NOT NULL)
        SELECT k AS {key}, count(*) AS n_rows, strftime(min(t) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS first_at,
               strftime(max(t) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS last_at, round(epoch_us(max(gap)) / 1e6, 3) AS max_gap_s
        FROM g GROUP BY k"""


def oracle_sql():
    own = {
        "p2_found": """
            SELECT 'subject' AS field, subject AS key_value FROM examples WHERE subject IS NOT NULL GROUP BY subject HAVING count(*) * 20 >= (SELECT count(*) FROM examples)
            UNION ALL
            SELECT 'client_id', CAST(client_id AS VARCHAR) FROM assignments WHERE client_id IS NOT NULL GROUP BY client_id HAVING count(*) * 20 >= (SELECT count(*) FROM assignments)""",
        "p2_subjects": _profile_sql("examples", "subject", "ingested_at"),
        "p2_clients": _profile_sql("assignments", "client_id", "assigned_at"),
    }
    return own | {k: v for part in _PARTS for k, v in part.oracle_sql().items()}
