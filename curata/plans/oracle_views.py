"""DuckDB twins of the fixture views in ``curata.sources.tables``.

An oracle query names the views it needs; ``with_views`` prepends them (and
what they depend on) as common table expressions, so each oracle string runs
on the bare parquet tables the driver registers.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "notes_orders": ((), """
        SELECT o.o_orderkey AS note_id, o.o_custkey AS subject_id, c.c_mktsegment AS task,
               coalesce(b.brands, []::VARCHAR[]) AS labels
        FROM orders o
        LEFT JOIN customer c ON o.o_custkey = c.c_custkey
        LEFT JOIN (SELECT l.l_orderkey, list_sort(list(p.p_brand)) AS brands
                   FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                   GROUP BY l.l_orderkey) b ON b.l_orderkey = o.o_orderkey"""),
    "notes_docs": ((), """
        SELECT d.doc_id AS note_id, d.source AS subject_id, d.lang AS task, d.text,
               list_concat(CASE WHEN l.quality = 1 THEN ['quality'] ELSE []::VARCHAR[] END,
                           CASE WHEN l.toxic = 1 THEN ['toxic'] ELSE []::VARCHAR[] END) AS labels
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "keyed_orders": (("notes_orders",), """
        SELECT note_id // 5 AS note_id, subject_id, CASE WHEN note_id % 5 < 4 THEN task || '-' || CAST(note_id % 5 AS VARCHAR) END AS task,
               labels FROM notes_orders"""),
    "keyed_docs": (("notes_docs",), """
        SELECT note_id // 5 AS note_id, subject_id, CASE WHEN note_id % 5 < 4 THEN task || '-' || CAST(note_id % 5 AS VARCHAR) END AS task,
               text, labels FROM notes_docs"""),
    "preds": ((), """
        SELECT task, note_id, label_id, y_true,
               CAST(((note_id * 7919 + label_id * 104729) % 101) AS DOUBLE) / 100.0 AS y_prob,
               (CAST(((note_id * 7919 + label_id * 104729) % 101) AS DOUBLE) / 100.0 - 0.5) * 8.0 AS logit
        FROM (SELECT d.lang AS task, d.doc_id AS note_id, CAST(0 AS INTEGER) AS label_id,
                     CAST(l.quality AS INTEGER) AS y_true
              FROM documents d JOIN labels l ON d.doc_id = l.doc_id
              UNION ALL
              SELECT d.lang, d.doc_id, CAST(1 AS INTEGER), CAST(l.toxic AS INTEGER)
              FROM documents d JOIN labels l ON d.doc_id = l.doc_id) x"""),
    "vectors": ((), """
        SELECT vec_id AS note_id, 't' || CAST(vec_id % 3 AS VARCHAR) AS task,
               CAST(embedding AS DOUBLE[]) AS embedding, CAST(label AS INTEGER) AS label
        FROM embeddings"""),
    "epoch_metrics": ((), """
        SELECT event_type AS study, user_id AS trial,
               CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS INTEGER)
                   AS epoch,
               value
        FROM events"""),
    "trials": ((), """
        SELECT event_type AS study, event_id AS trial,
               CASE WHEN event_id % 3 = 0 THEN 'PRUNED' ELSE 'COMPLETE' END AS state, value,
               CAST([5e-6, 1e-5, 2e-5, 3e-5, 5e-5, 8e-5][CAST(event_id % 6 AS INTEGER) + 1] AS DOUBLE)
                   AS learning_rate,
               CAST([0.0, 100.0, 250.0, 500.0, 750.0][CAST(event_id % 5 AS INTEGER) + 1] AS DOUBLE) AS warmup_steps
        FROM events"""),
    "section_notes": ((), """
        SELECT doc_id AS note_id, lang AS task,
               CASE WHEN doc_id % 3 = 0 THEN
                      'Chief Complaint: ' || text || chr(10) || chr(10) || 'Present Illness: ' || text
                      || chr(10) || chr(10) || 'Discharge: '
                    WHEN doc_id % 3 = 1 THEN
                      'Present Illness: ' || text || chr(10) || chr(10) || 'Discharge: '
                    ELSE
                      'Medical History: ' || text || chr(10) || chr(10) || 'Brief Hospital Course' || chr(10)
                      || text || chr(10) || chr(10) || 'Discharge: '
               END AS text
        FROM documents"""),
    "code_list": ((), """
        SELECT * FROM (VALUES ('Brand#1'), ('Brand#2'), ('Brand#UNKNOWN')) t(ccs)"""),
    "task_alias": ((), """
        SELECT * FROM (VALUES (0, 'a', 'AUTOMOBILE'), (1, 'b', 'BUILDING'), (2, 'c', 'FURNITURE'),
                              (3, 'd', 'HOUSEHOLD'), (4, 'e', 'MACHINERY')) t(pos, alias, task)"""),
    "results_cells": (("preds",), """
        SELECT train_step, eval_task,
               '[{''torchmetrics.auroc'': ' || CAST(v AS VARCHAR) || '}]' AS cell
        FROM (SELECT s.train_step, p.task AS eval_task,
                     round(avg(CASE WHEN (p.y_prob >= (s.train_step + 1) / 5.0) = (p.y_true = 1)
                                    THEN 1.0 ELSE 0.0 END), 4) AS v
              FROM preds p,
                   (SELECT CAST(dense_rank() OVER (ORDER BY task) - 1 AS INTEGER) AS train_step
                    FROM (SELECT DISTINCT task FROM preds)) s
              GROUP BY 1, 2) x"""),
}


def with_views(names: list[str] | tuple[str, ...], body: str) -> str:
    """`WITH <views> <body>`; views listed in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH {ctes}\n{body}"
