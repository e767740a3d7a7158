"""The jobs as queries: each runs twice into one new folder, and what stands there after the second run is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobs import stride_ledger, text_log_screen
from strideline.plans.catalogue import _METRICS, query, r6
from strideline.sources.shared import fresh_folder

_LEDGER = ["t_start", "t_end", "stride_time", "swing_time", "stance_time", "swing_ratio", "excursion", "mean_x"]


@query(_METRICS + f" SELECT session, stride_id, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in _LEDGER)}, n_samples, reject_reason, 'stride' AS kind, CAST(DATE '1970-01-01' + CAST(floor(t_end / 24) AS INT) AS VARCHAR) AS day FROM m")
def job1_stride_ledger(spark, d):
    # a pattern, as the table may be one file or a folder of files
    folder = fresh_folder(spark, "job1")
    for _ in range(2):
        rows = stride_ledger.run(spark, f"{d}/events[.]parquet", f"{folder}/ledger", f"{folder}/checkpoint")
    return rows.select("session", F.col("stride_id").cast("long").alias("stride_id"), *[r6(c, c) for c in _LEDGER], F.col("n_samples").cast("long").alias("n_samples"), "reject_reason", "kind", F.col("day").cast("string").alias("day"))


_M = text_log_screen.MEASURES
_SCALED = ", ".join(f"({c} - avg({c}) OVER w) / greatest(stddev_pop({c}) OVER w, 1e-8) AS z_{c}" for c in _M)
_LEADING = "list_max([" + ", ".join(f"{{'by': abs(round(z_{c}, 6)), 'name': '{c}'}}" for c in _M) + "]).name"


@query(f"""count_of AS (SELECT doc_id, source, length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g'))::DOUBLE AS solid, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::DOUBLE AS words,
  (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::DOUBLE AS lines, len(regexp_extract_all(coalesce(text, ''), '[0-9]'))::DOUBLE AS n_digits, len(regexp_extract_all(coalesce(text, ''), '[A-Z]'))::DOUBLE AS n_capitals FROM documents),
measured AS (SELECT doc_id, source, words, coalesce(solid / nullif(words, 0), 0) AS word_length, words / lines AS line_words, coalesce(n_digits / nullif(solid, 0), 0) AS digits, coalesce(n_capitals / nullif(solid, 0), 0) AS capitals FROM count_of),
scaled AS (SELECT *, {_SCALED} FROM measured WHERE words > 0 WINDOW w AS (PARTITION BY source)),
far AS (SELECT *, sqrt({' + '.join(f'z_{c} * z_{c}' for c in _M)}) AS distance, {_LEADING} AS strongest FROM scaled),
bounded AS (SELECT *, avg(distance) OVER w + 3 * stddev_pop(distance) OVER w AS bound FROM far WINDOW w AS (PARTITION BY source))
SELECT doc_id, source, {', '.join(f'round({c}, 6) AS {c}' for c in _M)}, round(distance, 6) AS distance, round(bound, 6) AS bound, strongest, CASE WHEN distance > bound THEN 'unusual' ELSE 'usual' END AS verdict FROM bounded
UNION ALL SELECT doc_id, source, {', '.join(f'round({c}, 6)' for c in _M)}, NULL, NULL, NULL, 'blank' FROM measured WHERE words = 0""", "")
def job2_text_log_screen(spark, d):
    folder = fresh_folder(spark, "job2")
    for _ in range(2):
        rows = text_log_screen.run(spark, f"{d}/documents.parquet", folder)
    return rows.select("doc_id", "source", *[r6(c, c) for c in [*_M, "distance", "bound"]], "strongest", "verdict")
