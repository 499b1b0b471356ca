"""Queries of this subpackage, by name, and the SQL that other engines can run."""

from __future__ import annotations

from tessera.llm import canonical, cross_split, near_duplicates, packing, reading_level, target_sample, tokens, truncation, vectors
from tessera.sources.tables import table


def queries():
    return {
        "p1_found": lambda s, d: truncation.truncated(table(s, d, "evaluation_records"), table(s, d, "examples")),
        "p1_report": lambda s, d: truncation.truncation_report(table(s, d, "evaluation_records"), table(s, d, "examples")),
        "p3_found": lambda s, d: cross_split.overlap_pairs(table(s, d, "examples")),
        "p3_report": lambda s, d: cross_split.overlap_report(table(s, d, "examples")),
        "p3_links": lambda s, d: cross_split.overlap_links(table(s, d, "examples")),
        "p4_found": lambda s, d: vectors.similar_pairs(table(s, d, "retrieved_examples")),
        "p4_neighbours": lambda s, d: vectors.neighbours(table(s, d, "retrieved_examples")),
        "p4_search": lambda s, d: vectors.search(table(s, d, "retrieved_examples")),
        "p5_found": lambda s, d: target_sample.unmet(table(s, d, "examples"), table(s, d, "sample_targets")),
        "p5_report": lambda s, d: target_sample.target_report(table(s, d, "examples"), table(s, d, "sample_targets")),
        "p5_sample": lambda s, d: target_sample.draw(table(s, d, "examples"), table(s, d, "sample_targets")),
        "p6_found": lambda s, d: near_duplicates.near_duplicate_pairs(table(s, d, "examples")),
        "p6_links": lambda s, d: near_duplicates.near_duplicate_links(table(s, d, "examples")),
        "p7_found": lambda s, d: canonical.copies(table(s, d, "examples")),
        "p7_collapsed": lambda s, d: canonical.collapsed(table(s, d, "examples")),
        "p8_ids": lambda s, d: tokens.token_ids(table(s, d, "documents")),
        "p9_found": lambda s, d: packing.oversized(table(s, d, "documents")),
        "p9_containers": lambda s, d: packing.pack(table(s, d, "documents")),
        "p9_report": lambda s, d: packing.fill_report(table(s, d, "documents")),
        "p9_mixture": lambda s, d: packing.mixture_report(table(s, d, "documents")),
        "p10_found": lambda s, d: reading_level.demanding(table(s, d, "documents"), table(s, d, "reading_labels")),
        "p10_levels": lambda s, d: reading_level.graded(table(s, d, "documents"), table(s, d, "reading_labels"), unnamed=True),
        "p10_profile": lambda s, d: reading_level.profile(table(s, d, "documents"), table(s, d, "reading_labels")),
    }


_SPLIT = "CASE WHEN lower(trim(split)) IN ('dev', 'valid', 'val') THEN 'validation' ELSE lower(trim(split)) END"
_TARGETS = f"""WITH have AS (SELECT {_SPLIT} AS split, subject, count(DISTINCT example_id) AS available FROM examples GROUP BY 1, 2),
  report AS (SELECT t.split, t.subject, CAST(greatest(coalesce(min_rows, 0), ceil(round(coalesce(target_share, 0) * coalesce(sample_size, 0), 6))) AS BIGINT) AS quota, coalesce(available, 0) AS available
    FROM sample_targets t LEFT JOIN have h ON t.split = h.split AND t.subject = h.subject)"""
_UNITS = """WITH u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT DISTINCT vec_id, CAST(vector AS DOUBLE[]) AS v FROM retrieved_examples
    WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0)),"""


def oracle_sql():
    return {
        "p4_found": _UNITS
        + """ s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id),
            r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s WHERE c >= 0.9)
            SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE k <= 5""",
        "p5_found": f"{_TARGETS} SELECT split, subject FROM report WHERE available < quota",
        "p5_sample": f"""WITH q AS (SELECT split, subject, max(CAST(greatest(coalesce(min_rows, 0), ceil(round(coalesce(target_share, 0) * coalesce(sample_size, 0), 6))) AS BIGINT)) AS quota FROM sample_targets GROUP BY 1, 2),
            e AS (SELECT DISTINCT {_SPLIT} AS split, subject, example_id FROM examples WHERE example_id IS NOT NULL),
            r AS (SELECT e.*, quota, row_number() OVER (PARTITION BY e.split, e.subject ORDER BY CAST('0x' || substr(md5('20260901:sample:' || e.split || ':' || example_id), 1, 8) AS BIGINT), example_id) AS n FROM e JOIN q ON e.split = q.split AND e.subject = q.subject)
            SELECT split, subject, example_id FROM r WHERE n <= quota""",
        "p5_report": f"{_TARGETS} SELECT split, subject, quota, available, greatest(0, quota - available) AS deficit FROM report",
    }
