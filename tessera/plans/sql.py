"""Pieces of SQL shared by the checks of the core queries."""

NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def norm(x: str) -> str:
    return NORM.format(x)


SPLIT = "CASE WHEN lower(trim(split)) IN ('dev', 'valid', 'val') THEN 'validation' ELSE lower(trim(split)) END"
PLACEHOLDER = "coalesce(lower(trim(subject)) IN ('', 'unknown', 'general', 'n/a', 'none'), true)"

# Latest delivery of each item, then the items without a broken rule.
LATEST = f"""latest AS (
  SELECT example_id, question, options, label, {SPLIT} AS split, subject, topic, provenance_group, explanation
  FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY ingested_at DESC) AS rn FROM examples WHERE example_id IS NOT NULL) WHERE rn = 1)"""
BLANK = r"({0} IS NULL OR NOT regexp_matches({0}, '[^\s\p{{Z}}]'))"
ITEMS = (
    LATEST
    + f""", items AS (
  SELECT * FROM latest WHERE NOT {BLANK.format("question")} AND options IS NOT NULL AND len(options) = 4
    AND len(list_filter(options, lambda o: {BLANK.format("o")})) = 0 AND label BETWEEN 0 AND 3 AND split IN ('train', 'validation', 'test'))"""
)
KEYED = (
    ITEMS
    + f""", base AS (SELECT example_id, split, subject, provenance_group, {norm("question")} AS nq, list_transform(options, lambda o: {norm("o")}) AS no FROM items),
  keyed AS (SELECT example_id, split, subject, provenance_group, nq, sha256('{{"options":[' || array_to_string(list_transform(no, lambda o: '"' || o || '"'), ',') || '],"question":"' || nq || '"}}') AS qh FROM base)"""
)
RECORDS = """records AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY recorded_at DESC) AS rn FROM evaluation_records WHERE record_id IS NOT NULL) WHERE rn = 1)"""
ASSIGNED = (
    ITEMS
    + """, assigned AS (
  SELECT DISTINCT a.example_id, a.client_id, a.original_split, a.role, i.subject FROM assignments a JOIN items i ON a.example_id = i.example_id WHERE a.client_id IS NOT NULL)"""
)
# Paired predictions: every event is an item, predicted by two arms.
PREDICTIONS = """predictions AS (
  SELECT arm, event_id AS example_id, CAST(user_id % 5 AS INTEGER) AS client_id, event_type AS subject, CAST(event_id % 4 AS INTEGER) AS gold, CAST(42 + event_id % 3 AS INTEGER) AS seed,
    CASE WHEN event_type = 'error' AND arm = 'left' THEN NULL ELSE CAST((CASE WHEN arm = 'left' THEN event_id + CAST(floor(value) AS BIGINT) ELSE event_id + CAST(floor(value / 3) AS BIGINT) % 3 END) % 4 AS INTEGER) END AS predicted,
    CAST((event_id + CAST(floor(value * 7) AS BIGINT)) % 4 AS INTEGER) AS likelihood_predicted
  FROM events CROSS JOIN (SELECT 'left' AS arm UNION ALL SELECT 'right' AS arm))"""
