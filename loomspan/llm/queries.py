"""The queries of the training-data problems: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from loomspan.llm import copies, lookalikes, nearcopies, packing, tokens
from loomspan.runtime import table


def _on(f, *names):
    return lambda s, d: f(*(table(s, d, n) for n in names))


QUERIES = {
    "p3_found": _on(copies.found, "task_files"),
    "p3_records": _on(copies.records, "task_files"),
    "p3_collision_check": _on(copies.collision_check, "task_files"),
    "p3_feed_report": _on(copies.feed_report, "task_files"),
    "p5_found": _on(nearcopies.found, "tasks"),
    "p5_groups": _on(nearcopies.groups, "tasks"),
    "p7_ids": _on(tokens.encode, "documents"),
    "p7_round_trip": _on(lambda d: tokens.decode(tokens.encode(d)), "documents"),
    "p7_summary": _on(tokens.token_summary, "documents"),
    "p8_assignments": _on(packing.assignments, "documents"),
    "p8_containers": _on(packing.containers, "documents"),
    "p8_invariants": _on(packing.invariants, "documents"),
    "p8_summary": _on(packing.summary, "documents"),
    "p9_found": _on(lookalikes.found, "documents"),
    "p9_groups": _on(lookalikes.groups, "documents"),
    "p9_canonical": _on(lookalikes.canonical_texts, "documents"),
}

_P3_WITH = r"""
WITH forms AS (
  SELECT DISTINCT file_id, feed, array_to_string([lower(w) FOR w IN regexp_extract_all(coalesce(json_extract_string(body, '$.task_name'), ''), '[\p{L}\p{N}]+')], ' ') || '|' ||
    array_to_string([lower(w) FOR w IN regexp_extract_all(coalesce(json_extract_string(body, '$.sql'), ''), '[\p{L}\p{N}]+')], ' ') AS form
  FROM task_files WHERE body IS NOT NULL AND json_valid(body) AND json_type(body) = 'OBJECT'),
grouped AS (SELECT form, min(file_id) AS keep_id, count(*) AS n_files FROM forms GROUP BY form)
"""

_P5_WITH = r"""
WITH RECURSIVE words AS (SELECT task_id, regexp_extract_all(lower(coalesce(task_name, '') || ' ' || coalesce(sql, '')), '[\p{L}\p{N}_]+') AS w FROM tasks),
grams AS (SELECT DISTINCT task_id, g FROM (SELECT task_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM words)),
sizes AS (SELECT task_id, count(*) AS n FROM grams GROUP BY task_id),
common AS (SELECT a.task_id AS task_a, b.task_id AS task_b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.task_id < b.task_id GROUP BY ALL)
"""

_DROPPED = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0001}-\x{E01EF}]"


def _p9_sql() -> str:
    """The same form in SQL: dropped characters, character by character replacement, composition."""
    wide = [(chr(c + 0xFEE0), chr(c)) for c in range(0x21, 0x7F)]
    pairs = lookalikes.LOOKALIKES.split()
    alike = list(zip(pairs[::2], pairs[1::2], strict=True))
    # Composed letters whose base has a look-alike, as the composed letter of that look-alike.
    composed = [(c, d) for c in map(chr, range(0x370, 0x530)) if len(d := lookalikes.whole_form(c)) == 1 and d != c and c not in dict(alike)]
    table = wide + alike + composed
    quote = lambda s: s.replace("'", "''")
    source, target = (quote("".join(x[i] for x in table)) for i in (0, 1))
    return rf"""
WITH forms AS (
  SELECT DISTINCT doc_id, text, nfc_normalize(translate(nfc_normalize(translate(regexp_replace(regexp_replace(text, '{_DROPPED}', '', 'g'), '\p{{Zs}}', ' ', 'g'), '{source}', '{target}')), '{source}', '{target}')) AS canonical FROM documents WHERE text IS NOT NULL),
shown AS (SELECT * FROM forms WHERE regexp_matches(canonical, '[^\s\p{{Cc}}]'))
"""


_P9_WITH = _p9_sql()

SQL: dict[str, str] = {
    "p3_found": _P3_WITH + "SELECT keep_id, file_id AS copy_id FROM forms JOIN grouped USING (form) WHERE file_id <> keep_id",
    "p3_records": _P3_WITH + "SELECT keep_id, n_files FROM grouped",
    "p3_collision_check": _P3_WITH + "SELECT count(DISTINCT form) AS n_forms, count(DISTINCT md5(form)) AS n_hashes, count(DISTINCT form) - count(DISTINCT md5(form)) AS n_collisions FROM forms",
    "p3_feed_report": _P3_WITH
    + """, every AS (SELECT DISTINCT file_id, feed FROM task_files), copied AS (SELECT DISTINCT file_id FROM forms JOIN grouped USING (form) WHERE file_id <> keep_id)
SELECT e.feed, count(*) AS n_files, count(c.file_id) AS n_copies FROM every e LEFT JOIN copied c USING (file_id) GROUP BY e.feed""",
    "p5_found": _P5_WITH + "SELECT task_a, task_b FROM common JOIN sizes x ON x.task_id = task_a JOIN sizes y ON y.task_id = task_b WHERE c >= 0.65 * (x.n + y.n - c)",
    "p5_groups": _P5_WITH
    + """, sets AS (SELECT task_id, md5(string_agg(g, '|' ORDER BY g)) AS h FROM grams GROUP BY task_id),
classes AS (SELECT task_id, min(task_id) OVER (PARTITION BY h) AS class_id FROM sets),
near AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM common JOIN sizes x ON x.task_id = task_a JOIN sizes y ON y.task_id = task_b JOIN classes a ON a.task_id = task_a JOIN classes b ON b.task_id = task_b
  WHERE c >= 0.65 * (x.n + y.n - c) AND a.class_id <> b.class_id),
both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT DISTINCT class_id AS a, class_id AS b FROM classes UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b)
SELECT c.task_id, c.class_id, (SELECT count(*) FROM both_ways w WHERE w.a = c.class_id) AS n_links, r.first_id AS group_id
FROM classes c JOIN (SELECT a, min(b) AS first_id FROM reach GROUP BY a) r ON r.a = c.class_id""",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_invariants": "SELECT * FROM (VALUES ('overfull', 0::BIGINT), ('with_gaps', 0::BIGINT), ('unnumbered', 0::BIGINT), ('misplaced', 0::BIGINT), ('needlessly_cut', 0::BIGINT)) AS t(broken, n)",
    "p9_found": _P9_WITH + "SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM shown a JOIN shown b ON a.canonical = b.canonical AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p9_groups": _P9_WITH
    + """, looks AS (SELECT canonical, min(doc_id) AS first_id, count(*) AS n_docs, count(DISTINCT text) AS n_spellings FROM shown GROUP BY canonical HAVING count(DISTINCT text) > 1)
SELECT doc_id, first_id, n_docs, n_spellings FROM shown JOIN looks USING (canonical)""",
    "p9_canonical": _P9_WITH + "SELECT d.doc_id, f.canonical FROM documents d LEFT JOIN forms f USING (doc_id)",
}
