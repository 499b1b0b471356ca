"""Queries on items: reading, checks, subjects, leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import assigned as A
from tessera.operators import leakage, subjects
from tessera.plans import sql
from tessera.plans.staging import stage
from tessera.sources import items as I
from tessera.sources.tables import table


def _items(s, d):
    return I.items(table(s, d, "examples"))


def _keyed(s, d):
    # The explanation is no key, and the last but the time to decide between equal times: what is kept is the same without it.
    return leakage.keyed(I.items(table(s, d, "examples").drop("explanation")), "portable")


def _sides(s, d):
    rows = _keyed(s, d)
    return rows.where("split = 'train'"), rows.where("split <> 'train'")


def _assigned(s, d):
    return A.assigned(_items(s, d), table(s, d, "assignments"))


def _nested(s, d):
    e = table(s, d, "examples")
    options = F.map_from_arrays(F.array(*[F.lit(x) for x in ("a", " B", "c ", "D")]), F.when(F.size("options") == 4, F.transform("options", lambda o: F.coalesce(o, F.lit("")))))
    data = F.struct(F.col("question"), options.alias("options"), F.get(F.array(*[F.lit(x) for x in "abcdef"]), F.col("label")).alias("answer"), F.col("explanation"))
    return I.adapt_nested(e.select(F.col("example_id").alias("id"), data.alias("data"), F.col("provenance_group").alias("source"), F.col("subject").alias("subject_name"), F.lit(None).cast("string").alias("topic_name"), "split"), F.col("split"))


def _flat(s, d):
    e = table(s, d, "examples")
    rows = e.select(F.lit(None).cast("string").alias("id"), "question", *[F.get("options", F.lit(i)).alias(f"op{c}") for i, c in enumerate("abcd")], F.col("label").alias("cop"), F.col("subject").alias("subject_name"), F.lit(None).cast("string").alias("topic_name"), F.col("provenance_group").alias("source"), F.lit("exam").alias("exam"), F.col("explanation").alias("exp"), "split")
    return I.adapt_flat(rows, F.col("split"))


def queries():
    return {
        "normalize_questions": lambda s, d: table(s, d, "examples").groupBy(text.normalize(F.col("question"), "portable").alias("nq")).agg(F.count("*").alias("n_rows")),
        "normalize_exact_questions": lambda s, d: table(s, d, "examples").groupBy(text.normalize(F.col("question"), "exact").alias("nq")).agg(F.count("*").alias("n_rows")),
        "token_stats": lambda s, d: table(s, d, "documents").select("doc_id", F.size(text.word_array(F.col("text"), "portable")).alias("n_words"), F.size(text.word_set(F.col("text"), "portable")).alias("n_distinct")),
        "label_parse": lambda s, d: table(s, d, "examples").select("example_id", I.label_index(F.col("label")).alias("label_index"), I.label_index(F.col("label"), base=1).alias("one_based"), I.label_index(F.get(F.array(*[F.lit(x) for x in "ABCDE"]), F.col("label"))).alias("from_letter")).distinct(),
        "canonical_splits": lambda s, d: table(s, d, "examples").groupBy("split", text.canonical_split(F.col("split")).alias("canonical")).agg(F.count("*").alias("n_rows")),
        "nested_adapter": lambda s, d: _nested(s, d).select("example_id", "question", F.array_join("options", "|").alias("options"), "label", "split", "subject", "topic", "provenance_group", "explanation"),
        "flat_adapter": lambda s, d: _flat(s, d).select("question", F.array_join("options", "|").alias("options"), "label", "split", "subject", "topic", "provenance_group", "explanation"),
        "stable_ids": lambda s, d: _flat(s, d).where(F.col("options").isNotNull() & ~F.exists("options", lambda o: o.isNull())).select("example_id", "question"),
        "item_violations": lambda s, d: I.latest(table(s, d, "examples"), "example_id", "ingested_at").select("example_id", F.array_join(I.violations(), ",").alias("broken")).where("broken <> ''"),
        "duplicate_ids": lambda s, d: I.duplicate_ids(table(s, d, "examples")),
        "head_per_split": lambda s, d: I.head_per_split(_items(s, d), {"train": 300, "validation": 40}).select("example_id", "split"),
        "retrieval_texts": lambda s, d: _items(s, d).select("example_id", F.concat(F.lit("Question: "), "question", F.lit("\n"), F.array_join(F.transform("options", lambda o, i: F.concat(F.char(65 + i), F.lit(". "), o)), "\n")).alias("retrieval_text"), F.char(65 + F.col("label")).alias("answer_label"), F.col("options")[F.col("label")].alias("correct_answer")),
        "question_hashes": lambda s, d: _keyed(s, d).select("example_id", "qh"),
        "subject_filter_audit": lambda s, d: subjects.filter_audit(I.latest(table(s, d, "examples"), "example_id", "ingested_at").withColumn("split", text.canonical_split(F.col("split")))),
        "subject_filter_histogram": lambda s, d: subjects.excluded_histogram(I.latest(table(s, d, "examples"), "example_id", "ingested_at").withColumn("split", text.canonical_split(F.col("split")))),
        "subject_histogram": lambda s, d: subjects.histogram(_assigned(s, d)),
        "loco_coverage": lambda s, d: subjects.other_client_coverage(_assigned(s, d)),
        "total_variation": lambda s, d: subjects.total_variation(_assigned(s, d)),
        "max_total_variation": lambda s, d: subjects.total_variation(_assigned(s, d)).agg(F.count("*").alias("n_pairs"), F.max("total_variation").alias("max_total_variation")),
        "subject_issues": lambda s, d: subjects.subject_issues(_assigned(s, d), min_rows=10),
        "exact_key_issues": lambda s, d: leakage.all_exact_issues(*_sides(s, d)),
        "jaccard_pairs": lambda s, d: leakage.lexical_pairs(*_sides(s, d)),
        "leakage_issues": lambda s, d: leakage.issues(*_sides(s, d)),
        "provenance_issues": lambda s, d: leakage.provenance_issues(*_sides(s, d)),
        "decontaminate_records": lambda s, d: leakage.decontaminate(_keyed(s, d)),
        "decontaminate_counts": lambda s, d: _decontaminated(s, d, leakage.decontamination_counts),
        "decontaminate_reasons": lambda s, d: _decontaminated(s, d, lambda _, dropped: leakage.drop_reasons(dropped)),
        "disjoint_check": lambda s, d: leakage.split_overlaps(_keyed(s, d)),
        "items_json": lambda s, d: I.from_json(I.to_json(_items(s, d))).select("example_id", "question", F.array_join("options", "|").alias("options"), "label", "split", "subject", "topic", "provenance_group", "explanation"),
    }


def _decontaminated(s, d, report):
    """A report of the keyed rows and what is dropped of them; both read the same staged rows."""
    rows = stage(_keyed(s, d), "keyed")
    return report(rows, leakage.decontaminate(rows))


_STRIP = r"nullif(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '')".format
_W = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
_PAIRS = f"""q AS (SELECT DISTINCT nq, split = 'train' AS tr, {_W.format("nq")} AS w FROM keyed WHERE nq <> ''),
  pairs AS (SELECT a.nq AS snq, b.nq AS enq, len(list_intersect(a.w, b.w)) AS shared, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS total
    FROM q a JOIN q b ON a.tr AND NOT b.tr AND a.nq <> b.nq AND least(len(a.w), len(b.w)) * 20 >= greatest(len(a.w), len(b.w)) * 17 AND len(list_intersect(a.w, b.w)) * 20 >= (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * 17)"""
_EXACT = """k AS (SELECT example_id, split, 0 AS kind, example_id AS value FROM keyed UNION ALL SELECT example_id, split, 1, nq FROM keyed UNION ALL SELECT example_id, split, 2, qh FROM keyed),
  exact AS (SELECT DISTINCT a.kind, a.example_id AS support_id, b.example_id AS evaluation_id, a.value FROM k a JOIN k b ON a.kind = b.kind AND a.value = b.value AND a.split = 'train' AND b.split <> 'train'
    UNION ALL SELECT 3, support_id, example_id, value FROM (SELECT provenance_group AS value, min(example_id) AS support_id FROM keyed WHERE split = 'train' AND provenance_group <> '' GROUP BY 1) s JOIN keyed e ON e.provenance_group = value AND e.split <> 'train')"""
# Drops in order: validation against test, then train against test and what stays of validation.
_MATCHES = f"""words AS (SELECT example_id, split, nq, {_W.format("nq")} AS w FROM keyed),
  keys AS (SELECT example_id, split, 0 AS kind, example_id AS value FROM keyed UNION ALL SELECT example_id, split, 1, nq FROM keyed UNION ALL SELECT example_id, split, 2, qh FROM keyed
    UNION ALL SELECT example_id, split, 3, provenance_group FROM keyed WHERE provenance_group <> ''),
  near AS (SELECT a.example_id AS p, a.split AS psplit, b.example_id AS r, b.split AS rsplit FROM words a JOIN words b ON a.split <> b.split AND b.split <> 'test' AND NOT (a.split = 'train') AND a.nq <> b.nq AND len(a.w) > 0 AND len(b.w) > 0
      AND least(len(a.w), len(b.w)) * 20 >= greatest(len(a.w), len(b.w)) * 17 AND len(list_intersect(a.w, b.w)) * 20 >= (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * 17),
  m AS (SELECT DISTINCT b.example_id AS r, b.split AS rsplit, a.example_id AS p, a.split AS psplit, a.kind FROM keys a JOIN keys b ON a.kind = b.kind AND a.value = b.value AND a.split <> b.split AND b.split <> 'test' AND a.split <> 'train'
    UNION ALL SELECT r, rsplit, p, psplit, 4 FROM near),
  dv AS (SELECT r, p, kind, row_number() OVER (PARTITION BY r ORDER BY kind, p) AS rn FROM m WHERE rsplit = 'validation' AND psplit = 'test'),
  dt AS (SELECT r, p, kind, row_number() OVER (PARTITION BY r ORDER BY kind, p) AS rn FROM m WHERE rsplit = 'train' AND (psplit = 'test' OR p NOT IN (SELECT r FROM dv))),
  dropped AS (SELECT 'validation' AS split, r AS example_id, p AS matched_id, kind FROM dv WHERE rn = 1 UNION ALL SELECT 'train', r, p, kind FROM dt WHERE rn = 1)"""
_KIND = "list_extract(['id', 'normalized_question', 'question_options_hash', 'provenance_group', 'lexical_near_duplicate'], kind + 1)"

_TV = f"""WITH {sql.ASSIGNED}, c AS (SELECT client_id, subject, count(*) AS n FROM assigned WHERE role = 'fit' GROUP BY 1, 2), z AS (SELECT client_id, sum(n) AS size FROM c GROUP BY 1),
            p AS (SELECT c.client_id, c.subject, CAST(c.n AS DOUBLE) / z.size AS share FROM c JOIN z ON c.client_id = z.client_id),
            m AS (SELECT a.client_id AS ca, b.client_id AS cb, sum(least(a.share, b.share)) AS common FROM p a JOIN p b ON a.subject IS NOT DISTINCT FROM b.subject AND a.client_id < b.client_id GROUP BY 1, 2)
            SELECT a.client_id AS client_a, b.client_id AS client_b, round(1 - coalesce(common, 0), 6) AS total_variation FROM z a JOIN z b ON a.client_id < b.client_id LEFT JOIN m ON ca = a.client_id AND cb = b.client_id"""


def oracle_sql():
    blank = sql.BLANK.format
    return {
        "normalize_questions": f"SELECT {sql.norm('question')} AS nq, count(*) AS n_rows FROM examples GROUP BY 1",
        "token_stats": rf"SELECT doc_id, len({_W.format(sql.norm('text')).replace('list_distinct(', '(')}) AS n_words, len({_W.format(sql.norm('text'))}) AS n_distinct FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        "label_parse": "SELECT DISTINCT example_id, CASE WHEN label BETWEEN 0 AND 3 THEN label END AS label_index, CASE WHEN label BETWEEN 1 AND 4 THEN label - 1 END AS one_based, CASE WHEN label BETWEEN 0 AND 3 THEN label END AS from_letter FROM examples",
        "canonical_splits": f"SELECT split, {sql.SPLIT} AS canonical, count(*) AS n_rows FROM examples GROUP BY 1, 2",
        "nested_adapter": f"""SELECT example_id, question, CASE WHEN len(options) = 4 THEN array_to_string(list_transform(options, lambda o: coalesce(o, '')), '|') END AS options, CASE WHEN label BETWEEN 0 AND 3 THEN label END AS label, {sql.SPLIT} AS split,
            coalesce(subject, 'medicine') AS subject, 'unknown' AS topic, {_STRIP('provenance_group')} AS provenance_group, {_STRIP('explanation')} AS explanation FROM examples""",
        "flat_adapter": f"""SELECT question, array_to_string(list_filter(options[1:4], lambda o: o IS NOT NULL), '|') AS options, CASE WHEN label BETWEEN 0 AND 3 THEN label END AS label, {sql.SPLIT} AS split, coalesce(subject, 'unknown') AS subject, 'unknown' AS topic,
            {_STRIP("coalesce(provenance_group, 'exam')")} AS provenance_group, {_STRIP('explanation')} AS explanation FROM (SELECT question, coalesce(options, []) AS options, label, split, subject, provenance_group, explanation FROM examples)""",
        "item_violations": f"""WITH {sql.LATEST} SELECT * FROM (SELECT example_id, array_to_string(list_filter([CASE WHEN {blank('example_id')} THEN 'id' END, CASE WHEN {blank('question')} THEN 'question' END,
            CASE WHEN options IS NULL OR len(options) <> 4 OR len(list_filter(options, lambda o: {blank('o')})) > 0 THEN 'options' END, CASE WHEN label IS NULL OR label NOT BETWEEN 0 AND 3 THEN 'label' END,
            CASE WHEN split IS NULL OR split NOT IN ('train', 'validation', 'test') THEN 'split' END], lambda x: x IS NOT NULL), ',') AS broken FROM latest) WHERE broken <> ''""",
        "duplicate_ids": "SELECT example_id, count(*) AS n_rows FROM examples GROUP BY 1 HAVING count(*) > 1",
        "head_per_split": f"WITH {sql.ITEMS} SELECT example_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY CAST('0x' || substr(md5('20260901:limit:' || example_id), 1, 8) AS BIGINT), example_id) AS rn FROM items) WHERE rn <= CASE split WHEN 'train' THEN 300 WHEN 'validation' THEN 40 ELSE 4611686018427387904 END",
        "retrieval_texts": f"""WITH {sql.ITEMS} SELECT example_id, 'Question: ' || question || chr(10) || 'A. ' || options[1] || chr(10) || 'B. ' || options[2] || chr(10) || 'C. ' || options[3] || chr(10) || 'D. ' || options[4] AS retrieval_text,
            chr(65 + label) AS answer_label, options[label + 1] AS correct_answer FROM items""",
        "question_hashes": f"WITH {sql.KEYED} SELECT example_id, qh FROM keyed",
        "subject_filter_audit": f"WITH {sql.LATEST} SELECT split, count(*) AS input_rows, count(*) FILTER (WHERE NOT {sql.PLACEHOLDER}) AS retained_rows, count(*) FILTER (WHERE {sql.PLACEHOLDER}) AS excluded_rows FROM latest GROUP BY split",
        "subject_filter_histogram": f"WITH {sql.LATEST} SELECT split, subject, count(*) AS n_rows FROM latest WHERE {sql.PLACEHOLDER} GROUP BY 1, 2",
        "subject_histogram": f"WITH {sql.ASSIGNED} SELECT client_id, role, subject, count(*) AS n_rows FROM assigned GROUP BY 1, 2, 3",
        "loco_coverage": f"""WITH {sql.ASSIGNED}, c AS (SELECT subject, client_id, count(*) AS own FROM assigned WHERE role = 'validation' GROUP BY 1, 2)
            SELECT n.client_id, n.subject, CAST(coalesce((SELECT sum(own) FROM c WHERE c.subject = n.subject AND c.client_id <> n.client_id), 0) AS BIGINT) AS other_rows FROM (SELECT DISTINCT client_id, subject FROM assigned WHERE role = 'support') n""",
        "total_variation": _TV,
        "subject_issues": f"""WITH {sql.ASSIGNED}, clients AS (SELECT DISTINCT client_id FROM assigned), c AS (SELECT subject, client_id, count(*) AS own FROM assigned WHERE role = 'validation' GROUP BY 1, 2),
            cov AS (SELECT n.client_id, n.subject, CAST(coalesce((SELECT sum(own) FROM c WHERE c.subject = n.subject AND c.client_id <> n.client_id), 0) AS BIGINT) AS o FROM (SELECT DISTINCT client_id, subject FROM assigned WHERE role = 'support') n)
            SELECT c.client_id, 'role_empty' AS rule, r.role AS detail FROM clients c CROSS JOIN (SELECT unnest(['fit', 'support', 'validation', 'test']) AS role) r WHERE NOT EXISTS (SELECT 1 FROM assigned x WHERE x.client_id = c.client_id AND x.role = r.role)
            UNION ALL SELECT DISTINCT client_id, 'placeholder_subject', role || '/' || coalesce(subject, 'null') FROM assigned WHERE {sql.PLACEHOLDER}
            UNION ALL SELECT client_id, 'one_support_subject', CAST(count(DISTINCT subject) AS VARCHAR) FROM assigned WHERE role = 'support' GROUP BY client_id HAVING count(DISTINCT subject) < 2
            UNION ALL SELECT client_id, 'thin_coverage', coalesce(subject || '=', '') || CAST(o AS VARCHAR) FROM cov WHERE o < 10""",
        "exact_key_issues": f"WITH {sql.KEYED}, {_EXACT} SELECT * FROM exact",
        "jaccard_pairs": f"WITH {sql.KEYED}, {_PAIRS} SELECT * FROM pairs",
        "leakage_issues": f"""WITH {sql.KEYED}, {_EXACT}, {_PAIRS} SELECT {_KIND} AS kind, support_id, evaluation_id, value FROM exact
            UNION ALL SELECT DISTINCT 'lexical_near_duplicate', s.example_id, e.example_id, printf('%.6f', shared / total) FROM pairs JOIN keyed s ON s.nq = snq AND s.split = 'train' JOIN keyed e ON e.nq = enq AND e.split <> 'train'""",
        "provenance_issues": f"""WITH {sql.KEYED}, s AS (SELECT provenance_group AS value, min(example_id) AS support_id, count(*) AS n_support FROM keyed WHERE split = 'train' AND provenance_group <> '' GROUP BY 1)
            SELECT 'provenance_group' AS kind, support_id, example_id AS evaluation_id, value, n_support FROM keyed JOIN s ON provenance_group = value WHERE split <> 'train'""",
        "decontaminate_records": f"WITH {sql.KEYED}, {_MATCHES} SELECT split, example_id, matched_id, {_KIND} AS kind FROM dropped",
        "disjoint_check": f"""WITH {sql.KEYED}, {_MATCHES.split("near AS (")[0].rstrip().rstrip(",")}, p AS (SELECT * FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) v(l, r)),
            f AS (SELECT l, r, b.example_id, min(b.kind) AS kind FROM p JOIN keys b ON b.split = r WHERE EXISTS (SELECT 1 FROM keys a WHERE a.split = l AND a.kind = b.kind AND a.value = b.value) GROUP BY 1, 2, 3)
            SELECT l AS left_split, r AS right_split, {_KIND} AS kind, count(*) AS n_rows FROM f GROUP BY l, r, kind""",
        "decontaminate_reasons": f"WITH {sql.KEYED}, {_MATCHES} SELECT split, {_KIND} AS kind, count(*) AS n_rows FROM dropped GROUP BY split, kind",
        "items_json": f"WITH {sql.ITEMS} SELECT example_id, question, array_to_string(options, '|') AS options, label, split, subject, topic, provenance_group, explanation FROM items",
        "max_total_variation": "SELECT count(*) AS n_pairs, max(total_variation) AS max_total_variation FROM (" + _TV + ")",
        "decontaminate_counts": f"""WITH {sql.KEYED}, {_MATCHES}, o AS (SELECT split, count(*) AS n FROM dropped GROUP BY 1) SELECT k.split, count(*) AS input_rows, coalesce(max(o.n), 0) AS dropped_rows, count(*) - coalesce(max(o.n), 0) AS retained_rows
            FROM keyed k LEFT JOIN o ON k.split = o.split GROUP BY k.split""",
    }
