"""Interval algebra over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import intervals as I
from wordloom.plans.registry import query, table
from wordloom.plans.staging import EV, complement_sql, islands_sql, recordings, regions

GAP, PAD, THRESHOLD, LEAST_CUT = 900_000, 350, 21_600_000, 3_600_000
MONTH = 2_678_400_000
SPEECH = ("view", "click")
SPOKEN = "WHERE event_type IN ('view', 'click')"


def speech(spark, sf):
    return regions(spark, sf, *SPEECH).select("doc_id", "start", "end")


@query("speech_regions", f'WITH {EV}, {islands_sql("m", "ev", GAP, PAD)} SELECT doc_id, "start", "end" FROM m')
def speech_regions(spark, sf):
    return I.merge_regions(regions(spark, sf), MONTH, PAD, GAP).select("doc_id", "start", "end")


@query("normalized_regions", f'WITH {EV}, {islands_sql("m", "ev")} SELECT doc_id, "start", "end" FROM m')
def normalized_regions(spark, sf):
    return I.normalized(regions(spark, sf), MONTH).select("doc_id", "start", "end")


SILENCE = f'{EV}, {islands_sql("sp", "ev", extra=SPOKEN)}, {complement_sql("gaps", "sp")}, sil AS (SELECT * FROM gaps WHERE "end" - "start" >= {THRESHOLD})'


@query("silence_candidates", f"WITH {SILENCE} SELECT * FROM sil")
def silence_candidates(spark, sf):
    return I.silence_candidates(speech(spark, sf), recordings(spark, sf), THRESHOLD)


CUTS = f"""{SILENCE}, {islands_sql("pr", "ev", extra="WHERE event_type = 'purchase'")}, hit AS (
  SELECT s.doc_id, s."start" AS c, s."end" AS d, greatest(p."start", s."start") AS "start", least(p."end", s."end") AS "end"
  FROM sil s JOIN pr p ON s.doc_id = p.doc_id AND p."start" < s."end" AND p."end" > s."start"
  UNION ALL SELECT doc_id, "start", "end", "end", "end" FROM sil
), cuts AS (
  SELECT doc_id, "start", "end" FROM (
    SELECT doc_id, coalesce(lag("end") OVER (PARTITION BY doc_id, c, d ORDER BY "start", "end"), c) AS "start", "start" AS "end" FROM hit
  ) WHERE "end" > "start" AND "end" - "start" >= {LEAST_CUT}
)"""


@query("subtract_protected", f"WITH {CUTS} SELECT * FROM cuts")
def subtract_protected(spark, sf):
    return I.subtract_protected(silence_candidates(spark, sf), regions(spark, sf, "purchase"), LEAST_CUT)


KEPT = f'{CUTS}, {complement_sql("rest", "cuts")}, kept AS (SELECT * FROM rest WHERE "end" - "start" > 1)'


@query("kept_regions", f"WITH {KEPT} SELECT * FROM kept")
def kept_regions(spark, sf):
    return I.kept_regions(subtract_protected(spark, sf), recordings(spark, sf), 1)


@query("cut_summary", f"""WITH {CUTS}, per AS (SELECT doc_id, count(*) AS n, sum("end" - "start")::BIGINT AS removed FROM cuts GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n, 0) AS cut_count, coalesce(removed, 0) AS removed, duration - coalesce(removed, 0) AS output_duration,
       CASE WHEN coalesce(removed, 0) <= 1 THEN 'no_cuts' WHEN duration - removed <= 1 THEN 'error' ELSE 'cut' END AS status
FROM docs LEFT JOIN per ON docs.doc_id = per.doc_id""")
def cut_summary(spark, sf):
    return I.cut_summary(subtract_protected(spark, sf), recordings(spark, sf), 1)


@query("keep_expression", f"""WITH {KEPT} SELECT doc_id, string_agg(printf('between(t,%.3f,%.3f)', "start" / 1000.0, "end" / 1000.0), '+' ORDER BY "start") AS expression FROM kept GROUP BY doc_id""")
def keep_expression(spark, sf):
    return I.keep_expression(kept_regions(spark, sf).withColumns({c: F.col(c) / 1000.0 for c in ("start", "end")}))


WINDOWS = """SELECT doc_id, w AS window_index, w * {step} AS "start", least(w * {step} + {window}, duration) AS "end"
FROM (SELECT doc_id, duration, unnest(range(0, CASE WHEN duration <= 0 THEN 0 ELSE 1 + greatest(0, ceil((duration - {window}) / {step}.0))::BIGINT END)) AS w FROM {source})"""


def lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("duration"))


@query("window_schedule", WINDOWS.format(step=240, window=280, source="(SELECT doc_id, n_chars AS duration FROM documents)"))
def window_schedule(spark, sf):
    return I.fixed_windows(lengths(spark, sf), 280, 40)


@query("render_segments", f"WITH {EV} " + WINDOWS.format(step=86_400_000, window=86_400_000, source="docs"))
def render_segments(spark, sf):
    return I.fixed_windows(recordings(spark, sf), 86_400_000)


@query("region_schedule", f"""WITH {EV}, {islands_sql("m", "ev", GAP, PAD)}, w AS (
  SELECT doc_id, "start" + k * 600000 AS "start", least("start" + k * 600000 + 700000, "end") AS "end"
  FROM (SELECT *, unnest(range(0, 1 + greatest(0, ceil(("end" - "start" - 700000) / 600000.0))::BIGINT)) AS k FROM m)
) SELECT doc_id, "start", "end", row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end") - 1 AS window_index FROM w""")
def region_schedule(spark, sf):
    return I.region_windows(speech_regions(spark, sf), 700_000, 100_000)


@query("segment_overlap", f"""WITH {EV}, {islands_sql("m", "ev", GAP)}, s AS ({WINDOWS.format(step=86_400_000, window=86_400_000, source="docs")})
SELECT s.doc_id, window_index, s."start" AS l_start, s."end" AS l_end, m."start" AS r_start, m."end" AS r_end,
       greatest(s."start", m."start") AS "start", least(s."end", m."end") AS "end"
FROM s JOIN m ON s.doc_id = m.doc_id AND s."start" < m."end" AND m."start" < s."end" """)
def segment_overlap(spark, sf):
    return I.overlap_join(render_segments(spark, sf), I.merge_regions(regions(spark, sf), MONTH, 0, GAP), 43_200_000)


@query("speech_length", f"""WITH {EV}, {islands_sql("m", "ev")}, g AS (SELECT doc_id, sum("end" - "start")::BIGINT AS total FROM m GROUP BY doc_id) SELECT * FROM g""")
def speech_length(spark, sf):
    return I.total_length(normalized_regions(spark, sf))


@query("absolute_regions", f"""WITH {EV} SELECT doc_id, "start" % 3600000 + "start" // 3600000 * 3600000 AS "start", "start" % 3600000 + "start" // 3600000 * 3600000 + 500 AS "end" FROM ev""")
def absolute_regions(spark, sf):
    own = regions(spark, sf).withColumn("chunk", F.expr("start div 3600000"))
    chunks = own.select("doc_id", "chunk", (F.col("chunk") * 3_600_000).alias("offset")).distinct()
    return I.shifted(own.select("doc_id", "chunk", F.expr("start % 3600000").alias("start"), F.expr("start % 3600000 + 500").alias("end")), chunks)


@query("longest_silence", f"""WITH {EV}, {islands_sql("m", "ev")}, {complement_sql("gaps", "m")}, a AS (SELECT doc_id, sum("end" - "start")::BIGINT AS speech FROM m GROUP BY doc_id),
b AS (SELECT doc_id, max("end" - "start") AS longest_silence FROM gaps GROUP BY doc_id) SELECT a.doc_id, speech, coalesce(longest_silence, 0) AS longest_silence FROM a LEFT JOIN b ON a.doc_id = b.doc_id""")
def longest_silence(spark, sf):
    own = normalized_regions(spark, sf)
    gaps = I.complement(own, recordings(spark, sf)).groupBy("doc_id").agg(F.max(F.col("end") - F.col("start")).alias("longest_silence"))
    return I.total_length(own).withColumnRenamed("total", "speech").join(gaps, "doc_id", "left").withColumn("longest_silence", F.coalesce("longest_silence", F.lit(0)))
