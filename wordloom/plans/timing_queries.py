"""Word timings, anchors, validation, lineage and subtitles, over events as words and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wordloom.operators import anchors as A, lineage as L, quality as Q, subtitles as S, timing as M, validate as V
from wordloom.plans.registry import query, table
from wordloom.plans.staging import EV, WORDS, recordings, regions, timed_words, turns
from wordloom.plans.text_queries import BLANK_SPLIT, GATE, HALVES, KEY, LINES, documents, halves, line_ranges, word_index

# integer ms, so that both engines agree to the last digit
MS = EV + """, wm AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY "start", event_id) - 1 AS index, event_id, event_type, "start", "end", 2678400000 AS duration FROM ev)"""
O = "OVER (PARTITION BY doc_id ORDER BY index)"


def words_ms(spark, sf):
    order = Window.partitionBy("doc_id").orderBy("start", "event_id")
    return regions(spark, sf).withColumn("index", (F.row_number().over(order) - 1).cast("bigint")).withColumn("duration", F.lit(2_678_400_000).cast("bigint"))


FORWARD = f'fw AS (SELECT *, max("start" - index * 20000000) OVER (PARTITION BY doc_id ORDER BY index ROWS UNBOUNDED PRECEDING) + index * 20000000 AS pushed FROM wm)'


@query("min_gap_clamp", f"WITH {MS}, {FORWARD} SELECT doc_id, index, pushed FROM fw")
def min_gap_clamp(spark, sf):
    return M.forward_gap(words_ms(spark, sf), "start", 20_000_000, "pushed").select("doc_id", "index", "pushed")


BACKWARD = f"""pn AS (SELECT *, CASE WHEN index = max(index) OVER (PARTITION BY doc_id) THEN least(pushed, duration - 10000000) ELSE pushed END AS p FROM fw),
bw AS (SELECT *, min(p - index * 20000000) OVER (PARTITION BY doc_id ORDER BY index DESC ROWS UNBOUNDED PRECEDING) + index * 20000000 AS placed FROM pn)"""


@query("back_gap_clamp", f"WITH {MS}, {FORWARD}, {BACKWARD} SELECT doc_id, index, placed::DOUBLE AS placed FROM bw")
def back_gap_clamp(spark, sf):
    pushed = M.forward_gap(words_ms(spark, sf), "start", 20_000_000, "pushed")
    return M.backward_gap(pushed, "pushed", 20_000_000, "duration", "placed").select("doc_id", "index", F.col("placed").cast("double").alias("placed"))


@query("midpoint_fences", f"""WITH {MS}, {FORWARD}, {BACKWARD}, l AS (SELECT *, coalesce((lag(placed) {O} + placed) / 2.0::DOUBLE, 0) AS l, coalesce((lead(placed) {O} + placed) / 2.0::DOUBLE, duration) AS r FROM bw),
s AS (SELECT *, greatest(l, placed - 15000000) AS s, least(r, placed + 15000000) AS e FROM l), t AS (SELECT *, e - s < 20000000 - 1e-9 AS small, greatest(l, placed - 10000000) AS s0 FROM s)
SELECT doc_id, index, (CASE WHEN small THEN greatest(l, least(r, s0 + 20000000) - 20000000) ELSE s END)::DOUBLE AS span_start, (CASE WHEN small THEN least(r, s0 + 20000000) ELSE e END)::DOUBLE AS span_end FROM t""")
def midpoint_fences(spark, sf):
    return M.fences(back_gap_clamp(spark, sf).join(words_ms(spark, sf).select("doc_id", "index", "duration"), ["doc_id", "index"]), "placed", F.lit(30_000_000.0), 20_000_000.0, "duration").select("doc_id", "index", "span_start", "span_end")


@query("monotonic_check", f"""WITH {MS}, n AS (SELECT doc_id, "start" <= "end" AND coalesce("end" <= lead("start") {O}, true) AS ok FROM wm) SELECT doc_id, bool_and(ok) AS monotonic FROM n GROUP BY doc_id""")
def monotonic_check(spark, sf):
    return M.monotonic(words_ms(spark, sf))


CLOSE = """cw AS (SELECT doc_id, index, "start", "end", 700000.0::DOUBLE AS duration FROM (SELECT doc_id, index, ("start" // 4000) AS "start", ("end" // 4000) AS "end" FROM wm))"""


def close_words(spark, sf):
    """Words with whole seconds that are dense enough to collide."""
    w = words_ms(spark, sf)
    return w.select("doc_id", "index", F.expr("cast(start div 4000 as double)").alias("start"), F.expr("cast(end div 4000 as double)").alias("end"), F.lit(700000.0).alias("duration"))


def _focus_sql(gap: str) -> str:
    return f"""fa AS (SELECT *, least(duration, greatest(0.0, "start")) AS a FROM cw), fb AS (SELECT *, least(duration, greatest(a, "end")) AS b FROM fa),
fc AS (SELECT *, least(duration, greatest(0.0, (a + b) / 2)) AS c, row_number() {O} AS k FROM fb),
fd AS (SELECT *, max(c - k * {gap}) OVER (PARTITION BY doc_id ORDER BY index ROWS UNBOUNDED PRECEDING) + k * {gap} AS f FROM fc),
fe AS (SELECT *, CASE WHEN lead(index) {O} IS NULL THEN least(f, duration - {gap} / 2) ELSE f END AS p FROM fd),
ff AS (SELECT *, min(p - k * {gap}) OVER (PARTITION BY doc_id ORDER BY index DESC ROWS UNBOUNDED PRECEDING) + k * {gap} AS m FROM fe),
fg AS (SELECT *, coalesce((lag(m) {O} + m) / 2, 0) AS l, coalesce((lead(m) {O} + m) / 2, duration) AS r, greatest({gap}, b - a) AS w FROM ff),
fh AS (SELECT *, greatest(l, m - w / 2) AS s, least(r, m + w / 2) AS e FROM fg), fi AS (SELECT *, e - s < {gap} - 1e-9 AS small, greatest(l, m - {gap} / 2) AS s0 FROM fh),
fj AS (SELECT *, CASE WHEN small THEN greatest(l, least(r, s0 + {gap}) - {gap}) ELSE s END AS s9, CASE WHEN small THEN least(r, s0 + {gap}) ELSE e END AS e9 FROM fi),
fo AS (SELECT doc_id, index, "start", "end", round(s9, 3) AS focus_start, least(floor(duration * 1000) / 1000, round(e9, 3)) AS focus_end, min(m) OVER (PARTITION BY doc_id) >= {gap} / 2 - 1e-9 AS fits, abs(m - c) AS center_shift FROM fj)"""


FOCUS = f"{MS}, {CLOSE}, {_focus_sql('256.0::DOUBLE')}"


def focused(spark, sf):
    return M.focus_spans(close_words(spark, sf), least=256.0)


@query("focus_spans", f"WITH {FOCUS} SELECT doc_id, index, focus_start, focus_end, fits FROM fo")
def focus_spans(spark, sf):
    return focused(spark, sf).select("doc_id", "index", "focus_start", "focus_end", "fits")


@query("focus_report", f"""WITH {FOCUS} SELECT doc_id, count_if("end" <= "start")::BIGINT AS zero_duration_words, count_if(abs(focus_start - "start") > 0.001 OR abs(focus_end - "end") > 0.001)::BIGINT AS focus_adjusted_words, round(max(center_shift), 3) AS max_center_shift FROM fo GROUP BY doc_id""")
def focus_report(spark, sf):
    return M.focus_report(focused(spark, sf))


@query("isotonic_centers", f"""WITH {MS}, v AS (SELECT doc_id, index, ((event_id * 7919) % 1000)::DOUBLE - index * 4 AS v FROM wm), p AS (
  SELECT a.doc_id, a.index AS i, b.index AS j, avg(c.v) AS m FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.index <= b.index JOIN v c ON c.doc_id = a.doc_id AND c.index BETWEEN a.index AND b.index GROUP BY ALL
), q AS (SELECT v.doc_id, v.index, p.i, min(p.m) AS m FROM v JOIN p ON p.doc_id = v.doc_id AND p.i <= v.index AND p.j >= v.index GROUP BY ALL)
SELECT doc_id, index, round(max(m) + index * 4, 6) AS isotonic FROM q GROUP BY doc_id, index""")
def isotonic_centers(spark, sf):
    words = words_ms(spark, sf).withColumn("v", (F.col("event_id") * 7919 % 1000).cast("double"))
    return M.isotonic(words, "v", 4.0).select("doc_id", "index", F.round("isotonic", 6).alias("isotonic"))


# coarse bounds: every third word, off by an amount that depends on its event
COARSE = """co AS (SELECT doc_id, index, "start" + (event_id % 11 - 5) * 1.0::DOUBLE AS "start", "end" + (event_id % 11 - 5) * 1.0::DOUBLE AS "end" FROM (
  SELECT doc_id, index, event_id, ("start" // 1000)::DOUBLE AS "start", ("start" // 1000 + event_id % 4)::DOUBLE AS "end" FROM wm) WHERE index % 3 = 0),
aw AS (SELECT doc_id, index, ("start" // 1000)::DOUBLE AS "start", ("start" // 1000 + event_id % 4)::DOUBLE AS "end", index // 5 AS seg FROM wm),
ro AS (SELECT doc_id, index, "start" + 0.5::DOUBLE AS "start", "end" + 0.5::DOUBLE AS "end" FROM aw WHERE index % 2 = 1)"""


def aligned(spark, sf):
    start = F.expr("cast(start div 1000 as double)")
    return words_ms(spark, sf).select("doc_id", "index", "event_id", start.alias("start"), (start + F.col("event_id") % 4).alias("end"), F.expr("cast(index div 5 as string)").alias("segment_id"))


def coarse(spark, sf):
    off = (F.col("event_id") % 11 - 5).cast("double")
    return aligned(spark, sf).filter("index % 3 = 0").select("doc_id", "index", (F.col("start") + off).alias("start"), (F.col("end") + off).alias("end"))


def rough(spark, sf):
    return aligned(spark, sf).filter("index % 2 = 1").select("doc_id", "index", (F.col("start") + 0.5).alias("start"), (F.col("end") + 0.5).alias("end"))


@query("outlier_guard", f"""WITH {MS}, {COARSE}, j AS (SELECT aw.*, co."start" AS cs, co."end" AS ce, (aw."start" + aw."end") / 2 AS c, greatest(aw."end" - aw."start", 0) AS raw FROM aw LEFT JOIN co ON aw.doc_id = co.doc_id AND aw.index = co.index),
k AS (SELECT *, raw > 2.5 AS long, coalesce(abs(c - (cs + ce) / 2) > 4, false) AS far FROM j), g AS (SELECT *, (long OR far) AND cs IS NOT NULL AS guarded FROM k)
SELECT doc_id, index, long AS long_duration, far AS coarse_outlier, guarded, CASE WHEN guarded THEN (cs + ce) / 2 ELSE c END AS center, least(2.5, greatest(0.005, CASE WHEN guarded THEN greatest(0.005, ce - cs) ELSE raw END))::DOUBLE AS width FROM g""")
def outlier_guard(spark, sf):
    return M.guard_outliers(aligned(spark, sf), coarse(spark, sf)).select("doc_id", "index", "long_duration", "coarse_outlier", "guarded", "center", "width")


SHIFT = f"""{MS}, {COARSE}, j AS (SELECT aw.*, (co."start" + co."end") / 2 - (aw."start" + aw."end") / 2 AS dc, (ro."start" + ro."end") / 2 - (aw."start" + aw."end") / 2 AS dr
FROM aw LEFT JOIN co ON aw.doc_id = co.doc_id AND aw.index = co.index LEFT JOIN ro ON aw.doc_id = ro.doc_id AND aw.index = ro.index),
sh AS (SELECT doc_id, seg::VARCHAR AS segment_id, CASE WHEN count(dc) > 0 THEN 'coarse' ELSE 'rough' END AS anchor_kind, CASE WHEN count(dc) > 0 THEN count(dc) ELSE count(dr) END AS anchor_count, coalesce(median(dc), median(dr), 0.0) AS shift FROM j GROUP BY doc_id, seg)"""


@query("segment_shift", f"WITH {SHIFT} SELECT * FROM sh")
def segment_shift(spark, sf):
    return M.segment_shifts(aligned(spark, sf), coarse(spark, sf), rough(spark, sf))


@query("calibrated_words", f"""WITH {SHIFT} SELECT aw.doc_id, index, round("start" + shift, 3) AS "start", round(greatest("start" + shift + 0.005, "end" + shift), 3) AS "end" FROM aw JOIN sh ON aw.doc_id = sh.doc_id AND aw.seg::VARCHAR = sh.segment_id""")
def calibrated_words(spark, sf):
    return M.calibrate_segments(aligned(spark, sf), coarse(spark, sf), rough(spark, sf)).select("doc_id", "index", "start", "end")


@query("shift_report", f"WITH {SHIFT} SELECT doc_id, count(*) AS segment_count, count_if(abs(shift) > 0.25)::BIGINT AS nontrivial_shifts, round(max(abs(shift)), 3) AS max_abs_shift FROM sh GROUP BY doc_id")
def shift_report(spark, sf):
    return M.shift_report(segment_shift(spark, sf))


@query("utterance_refinement", f"""WITH {MS}, {COARSE}, f AS (SELECT doc_id, index, "start" AS fs, "end" AS fe FROM co WHERE index % 2 = 0), d AS (SELECT aw.doc_id, aw.index, "start", "end", seg, fs, fe, median(("start" + "end") / 2 - (fs + fe) / 2) OVER (PARTITION BY aw.doc_id, seg) AS sh FROM aw LEFT JOIN f ON aw.doc_id = f.doc_id AND aw.index = f.index)
SELECT doc_id, index, coalesce(fs + sh, "start") AS "start", coalesce(fe + sh, "end") AS "end", CASE WHEN fs IS NOT NULL THEN 'mfa_3.4.1_fine_tuned' WHEN sh IS NULL THEN 'qwen3_forced_aligner_mfa_missing_fallback' ELSE 'qwen3_forced_aligner_mfa_unmatched_fallback' END AS source FROM d""")
def utterance_refinement(spark, sf):
    fine = coarse(spark, sf).filter("index % 2 = 0").select("doc_id", "index", F.col("start").alias("fine_start"), F.col("end").alias("fine_end"))
    return M.refine_utterances(aligned(spark, sf).withColumnRenamed("segment_id", "utterance_id"), fine).select("doc_id", "index", "start", "end", "source")


@query("boundary_percentiles", f"""WITH {EV}, v AS (SELECT doc_id, ("end" - "start")::DOUBLE AS v FROM ev), r AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM v),
p AS (SELECT doc_id, v AS p95_low FROM r WHERE k = floor(0.95 * (n - 1))) SELECT v.doc_id, count(*) AS samples, median(v) AS median, round(quantile_cont(v, 0.95), 3) AS p95, any_value(p95_low) AS p95_low FROM v JOIN p ON v.doc_id = p.doc_id GROUP BY v.doc_id""")
def boundary_percentiles(spark, sf):
    values = regions(spark, sf).select("doc_id", (F.col("end") - F.col("start")).cast("double").alias("v"))
    return Q.median_and_p95(values, "v").withColumn("p95", F.round("p95", 3))


@query("degenerate_segments", f"""WITH {MS}, s AS (SELECT doc_id, index // 7 AS segment_id, ("start" // 1000)::DOUBLE / CASE WHEN index % 14 < 7 THEN 1 ELSE 1e10 END AS s, ("start" // 1000 + event_id % 3)::DOUBLE / CASE WHEN index % 14 < 7 THEN 1 ELSE 1e10 END - CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END AS e FROM wm)
SELECT doc_id, segment_id, count(*) > 1 AND (bool_or(e < s) OR max(e) - min(s) <= 0.05 OR (count(*) >= 6 AND count_if(e - s <= 0.006) >= 0.9 * count(*))) AS degenerate FROM s GROUP BY doc_id, segment_id""")
def degenerate_segments(spark, sf):
    scale = F.when(F.col("index") % 14 < 7, 1.0).otherwise(1e10)
    start = F.expr("cast(start div 1000 as double)")
    items = words_ms(spark, sf).select("doc_id", F.expr("index div 7").alias("segment_id"), (start / scale).alias("start"), ((start + F.col("event_id") % 3) / scale - F.when(F.col("event_id") % 97 == 0, 5.0).otherwise(0.0)).alias("end"))
    return M.is_degenerate(items)


GAP = 1 / 128  # sums of such steps and of halves of whole seconds are exact, so that both engines agree to the last digit
CLEAN = f"""{MS}, {COARSE}, gj AS (SELECT aw.*, co."start" AS cs, co."end" AS ce, (aw."start" + aw."end") / 2 AS c, greatest(aw."end" - aw."start", 0) AS raw FROM aw LEFT JOIN co ON aw.doc_id = co.doc_id AND aw.index = co.index),
gk AS (SELECT *, raw > 2.5 AS long, coalesce(abs(c - (cs + ce) / 2) > 4, false) AS far FROM gj), gg AS (SELECT *, (long OR far) AND cs IS NOT NULL AS guarded FROM gk),
gw AS (SELECT doc_id, index, long, far, guarded, CASE WHEN guarded THEN (cs + ce) / 2 ELSE c END AS center, least(2.5, greatest(0.0078125, CASE WHEN guarded THEN greatest(0.0078125, ce - cs) ELSE raw END))::DOUBLE AS width, row_number() {O} - 1 AS k FROM gg),
gv AS (SELECT doc_id, k, center - k * 0.0078125::DOUBLE AS v, sum(center - k * 0.0078125::DOUBLE) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM gw),
gp AS (SELECT a.doc_id, a.k AS i, b.k AS j, (b.upto - a.upto + a.v) / (b.k - a.k + 1) AS m FROM gv a JOIN gv b ON a.doc_id = b.doc_id AND a.k <= b.k),
gq AS (SELECT gv.doc_id, gv.k, gp.i, min(gp.m) AS m FROM gv JOIN gp ON gp.doc_id = gv.doc_id AND gp.i <= gv.k AND gp.j >= gv.k GROUP BY ALL), gf AS (SELECT doc_id, k, max(m) + k * 0.0078125::DOUBLE AS fitted FROM gq GROUP BY doc_id, k),
gb AS (SELECT l.doc_id, 1 + count_if(l.m <= r.m) AS blocks FROM (SELECT doc_id, j, max(m) AS m FROM gp GROUP BY ALL) l JOIN (SELECT doc_id, i, min(m) AS m FROM gp GROUP BY ALL) r ON l.doc_id = r.doc_id AND r.i = l.j + 1 GROUP BY l.doc_id),
ga AS (SELECT gw.*, coalesce(blocks, 1) AS blocks, least(2678400.0, greatest(0.0, fitted)) AS c FROM gw JOIN gf ON gw.doc_id = gf.doc_id AND gw.k = gf.k LEFT JOIN gb ON gw.doc_id = gb.doc_id),
gd AS (SELECT *, max(c - (k + 1) * 0.0078125::DOUBLE) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) + (k + 1) * 0.0078125::DOUBLE AS f FROM ga),
ge AS (SELECT *, CASE WHEN lead(k) OVER (PARTITION BY doc_id ORDER BY k) IS NULL THEN least(f, 2678400.0 - 0.0078125::DOUBLE / 2) ELSE f END AS p FROM gd),
gm AS (SELECT *, min(p - (k + 1) * 0.0078125::DOUBLE) OVER (PARTITION BY doc_id ORDER BY k DESC ROWS UNBOUNDED PRECEDING) + (k + 1) * 0.0078125::DOUBLE AS m FROM ge),
gl AS (SELECT *, coalesce((lag(m) OVER (PARTITION BY doc_id ORDER BY k) + m) / 2, 0) AS l, coalesce((lead(m) OVER (PARTITION BY doc_id ORDER BY k) + m) / 2, 2678400.0) AS r FROM gm),
gh AS (SELECT *, greatest(l, m - width / 2) AS s, least(r, m + width / 2) AS e FROM gl), gi AS (SELECT *, e - s < 0.0078125::DOUBLE - 1e-9 AS small, greatest(l, m - 0.0078125::DOUBLE / 2) AS s0 FROM gh),
gx AS (SELECT *, CASE WHEN small THEN greatest(l, least(r, s0 + 0.0078125::DOUBLE) - 0.0078125::DOUBLE) ELSE s END AS s9, CASE WHEN small THEN least(r, s0 + 0.0078125::DOUBLE) ELSE e END AS e9 FROM gi),
gz AS (SELECT doc_id, index, round(s9, 6) AS "start", round(greatest(s9 + 0.0078125::DOUBLE, e9), 6) AS "end", guarded, blocks, round(abs(m - center), 6) AS center_shift, long AS long_duration, far AS coarse_outlier FROM gx)"""


def cleaned(spark, sf):
    words = aligned(spark, sf).withColumn("duration", F.lit(2_678_400.0))
    return M.acoustic_cleanup(words, coarse(spark, sf), least=GAP).select("doc_id", "index", "start", "end", "guarded", "blocks", "center_shift", "long_duration", "coarse_outlier")


@query("acoustic_cleanup", f"WITH {CLEAN} SELECT * FROM gz")
def acoustic_cleanup(spark, sf):
    return cleaned(spark, sf).withColumns({c: F.round(c, 6) for c in ("start", "end", "center_shift")})


@query("cleanup_report", f"""WITH {CLEAN}, r AS (SELECT doc_id, center_shift, row_number() OVER (PARTITION BY doc_id ORDER BY center_shift) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM gz), q AS (SELECT doc_id, round(center_shift, 3) AS p95_center_shift FROM r WHERE k = floor(0.95 * (n - 1)))
SELECT gz.doc_id, count_if(guarded)::BIGINT AS guarded_words, count_if(long_duration)::BIGINT AS long_duration_words, count_if(coarse_outlier)::BIGINT AS coarse_outlier_words, max(blocks) AS isotonic_block_count, count_if(center_shift > 0.001)::BIGINT AS center_adjusted_words, round(max(center_shift), 3) AS max_center_shift, any_value(p95_center_shift) AS p95_center_shift
FROM gz JOIN q ON gz.doc_id = q.doc_id GROUP BY gz.doc_id""")
def cleanup_report(spark, sf):
    return M.cleanup_report(acoustic_cleanup(spark, sf))


@query("conflict_resolution")
def conflict_resolution(spark, sf):
    words = aligned(spark, sf).withColumns({"safe_start": F.col("start"), "safe_end": F.col("start"), "source": F.when(F.col("index") % 2 == 0, "mfa_3.4.1_fine_tuned").otherwise("qwen3_forced_aligner")})
    return M.resolve_conflicts(words.withColumn("end", F.col("end") + (F.col("event_id") % 5) * 20_000.0 - F.when(F.col("event_id") % 7 == 0, 100_000.0).otherwise(0.0)))


# ---- anchors ----

ANCHORED = f"""{MS}, {COARSE}, an AS (SELECT coalesce(c.doc_id, r.doc_id) AS doc_id, coalesce(c.index, r.index) AS index, coalesce(c."start", r."start") AS "start", coalesce(c."end", r."end") AS "end", CASE WHEN c.doc_id IS NULL THEN 'rough' ELSE 'coarse' END AS origin
FROM (SELECT * FROM co WHERE index % 9 <> 0) c FULL JOIN (SELECT * FROM ro WHERE index % 5 = 1) r ON c.doc_id = r.doc_id AND c.index = r.index)"""


def anchors(spark, sf):
    return A.anchor_precedence(coarse(spark, sf).filter("index % 9 <> 0"), rough(spark, sf).filter("index % 5 = 1"))


@query("anchor_precedence", f"WITH {ANCHORED} SELECT * FROM an")
def anchor_precedence(spark, sf):
    return anchors(spark, sf)


@query("anchor_coverage", f"WITH {ANCHORED}, n AS (SELECT aw.doc_id, count(*) AS words, count(an.doc_id) AS anchored FROM aw LEFT JOIN an ON aw.doc_id = an.doc_id AND aw.index = an.index GROUP BY aw.doc_id) SELECT *, anchored / words::DOUBLE AS coverage, anchored / words::DOUBLE >= 0.35 AS enough FROM n")
def anchor_coverage(spark, sf):
    return A.anchor_coverage(aligned(spark, sf).select("doc_id", "index"), anchors(spark, sf), 0.35)


INTERPOLATED = f"""{ANCHORED}, nb AS (SELECT aw.doc_id, aw.index, an."start" AS os, an."end" AS oe,
  last_value(CASE WHEN an.doc_id IS NOT NULL THEN {{'i': an.index, 's': an."start", 'e': an."end"}} END IGNORE NULLS) OVER (PARTITION BY aw.doc_id ORDER BY aw.index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN an.doc_id IS NOT NULL THEN {{'i': an.index, 's': an."start", 'e': an."end"}} END IGNORE NULLS) OVER (PARTITION BY aw.doc_id ORDER BY aw.index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a
  FROM aw LEFT JOIN an ON aw.doc_id = an.doc_id AND aw.index = an.index),
ip AS (SELECT doc_id, index,
  CASE WHEN os IS NOT NULL THEN os WHEN b IS NOT NULL AND a IS NOT NULL THEN b.e + (a.s - b.e) * ((index - b.i) / (a.i - b.i)::DOUBLE) WHEN b IS NOT NULL THEN b.e + (index - b.i) * greatest(0.005, b.e - b.s)
       WHEN a IS NOT NULL THEN greatest(0.0, a.s - (a.i - index) * greatest(0.005, a.e - a.s) - greatest(0.005, a.e - a.s)) END::DOUBLE AS "start",
  CASE WHEN os IS NOT NULL THEN oe WHEN b IS NOT NULL AND a IS NOT NULL THEN b.e + (a.s - b.e) * ((index - b.i) / (a.i - b.i)::DOUBLE) + greatest(0.005, (a.s - b.e) / (a.i - b.i)::DOUBLE) WHEN b IS NOT NULL THEN b.e + (index - b.i) * greatest(0.005, b.e - b.s) + greatest(0.005, b.e - b.s)
       WHEN a IS NOT NULL THEN greatest(0.005, a.s - (a.i - index) * greatest(0.005, a.e - a.s)) END::DOUBLE AS "end" FROM nb)"""


@query("anchor_interpolation", f"""WITH {INTERPOLATED} SELECT doc_id, index, round("start", 5) AS "start", round("end", 5) AS "end" FROM ip""")
def anchor_interpolation(spark, sf):
    timed = A.interpolated(aligned(spark, sf).select("doc_id", "index"), anchors(spark, sf))
    return timed.select("doc_id", "index", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"))


@query("plausible_anchors", f"""WITH {MS}, {COARSE} SELECT ro.doc_id, ro.index, coalesce((ro."start" + ro."end") / 2 BETWEEN co."start" - 4 AND co."end" + 4, true) AS plausible FROM ro LEFT JOIN co ON ro.doc_id = co.doc_id AND ro.index = co.index WHERE ro."end" - ro."start" > 0.005""")
def plausible_anchors(spark, sf):
    r = A.usable_observations(rough(spark, sf))
    return A.plausible_matches(r.select("doc_id", "index", F.col("index").alias("rough_index")), r, coarse(spark, sf)).select("doc_id", "index", "plausible")


def segments(spark, sf):
    return A.alignment_segments(aligned(spark, sf).select("doc_id", F.expr("index div 40").alias("chunk_index"), "index", F.col("event_id").cast("string").alias("text")), anchors(spark, sf), 12)


SEGMENTS = f"""{ANCHORED}, sw AS (SELECT aw.doc_id, aw.index // 40 AS chunk, aw.index, event_id::VARCHAR AS text, (an."start" + an."end") / 2 AS t, row_number() OVER (PARTITION BY aw.doc_id, aw.index // 40 ORDER BY aw.index) - 1 AS k
  FROM aw JOIN wm ON wm.doc_id = aw.doc_id AND wm.index = aw.index LEFT JOIN an ON an.doc_id = aw.doc_id AND an.index = aw.index),
sa AS (SELECT *, first_value(t IGNORE NULLS) OVER (PARTITION BY doc_id, chunk ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM sw),
sf AS (SELECT doc_id, chunk, k, 0::BIGINT AS seg, 0::BIGINT AS begin, t AS first, t AS last FROM sa WHERE k = 0
  UNION ALL SELECT doc_id, chunk, k, seg + cut, CASE WHEN cut = 1 THEN k ELSE begin END, CASE WHEN cut = 1 THEN t ELSE coalesce(first, t) END, CASE WHEN cut = 1 THEN t ELSE coalesce(t, last) END
  FROM (SELECT sa.doc_id, sa.chunk, sa.k, sa.t, p.seg, p.begin, p.first, p.last, CASE WHEN sa.k - p.begin >= 12 OR coalesce(ahead - p.last > 8 OR ahead - p.first > 35, false) THEN 1 ELSE 0 END AS cut FROM sf p JOIN sa ON sa.doc_id = p.doc_id AND sa.chunk = p.chunk AND sa.k = p.k + 1)),
sg AS (SELECT sw.doc_id, printf('c%03d-%03d', sw.chunk, seg) AS segment_id, sw.chunk AS source_chunk, min(index) AS word_start, max(index) + 1 AS word_end, count(*) AS word_count, string_agg(text, ' ' ORDER BY index) AS text
  FROM sw JOIN sf ON sw.doc_id = sf.doc_id AND sw.chunk = sf.chunk AND sw.k = sf.k GROUP BY sw.doc_id, sw.chunk, seg)"""


@query("alignment_segments", f"WITH RECURSIVE {SEGMENTS} SELECT * FROM sg")
def alignment_segments(spark, sf):
    return segments(spark, sf)


CROPS = f"""{SEGMENTS}, pc AS (SELECT aw.doc_id, 2678400.0::DOUBLE / count(*) AS p FROM aw GROUP BY aw.doc_id), en AS (SELECT doc_id FROM an GROUP BY doc_id HAVING count(*) >= 2),
am AS (SELECT doc_id, index AS i, "start" AS s, "end" AS e, ("start" + "end") / 2 AS m FROM an),
cx AS (SELECT sg.*, pc.p, (SELECT count(*) FROM am WHERE am.doc_id = sg.doc_id AND i >= word_start AND i < word_end) AS n,
  (SELECT arg_min(am, i) FROM am WHERE am.doc_id = sg.doc_id AND i >= word_start AND i < word_end) AS f, (SELECT arg_max(am, i) FROM am WHERE am.doc_id = sg.doc_id AND i >= word_start AND i < word_end) AS l,
  (SELECT arg_max(am, i) FROM am WHERE am.doc_id = sg.doc_id AND i < word_start) AS b, (SELECT arg_min(am, i) FROM am WHERE am.doc_id = sg.doc_id AND i > word_start) AS a
  FROM sg JOIN pc ON pc.doc_id = sg.doc_id JOIN en ON en.doc_id = sg.doc_id),
cy AS (SELECT *, CASE WHEN n > 0 THEN f.m - (f.i - word_start) * p WHEN b IS NOT NULL THEN b.m + (word_start - b.i) * p ELSE a.m - (a.i - word_start) * p END AS c1 FROM cx),
cz AS (SELECT *, CASE WHEN n > 0 THEN l.m + (word_end - 1 - l.i) * p ELSE c1 + greatest(0, word_end - word_start - 1) * p END AS c2 FROM cy),
da AS (SELECT *, CASE WHEN n > 0 THEN least(c1 - p / 2, f.s) ELSE c1 - p / 2 END AS b0, CASE WHEN n > 0 THEN greatest(c2 + p / 2, l.e) ELSE c2 + p / 2 END AS e0, greatest(4.0, greatest(0, c2 - c1) + greatest(1.0, 2 * p)) AS wanted FROM cz),
db AS (SELECT *, greatest(0, (wanted - (e0 - b0)) / 2) + 1.35 AS pad FROM da), dc AS (SELECT *, b0 - pad AS b1, e0 + pad AS e1, e0 + pad - (b0 - pad) AS span, least(55.0, greatest(12.0, wanted + 2.7)) AS wide, (c1 + c2) / 2 AS mid FROM db),
cr AS (SELECT doc_id, segment_id, word_start, word_end, round(greatest(0, CASE WHEN span > 55 THEN mid - wide / 2 ELSE b1 END), 4) AS crop_start, round(least(2678400.0, CASE WHEN span > 55 THEN mid + wide / 2 ELSE e1 END), 4) AS crop_end, n AS rough_anchor_count, round(span, 4) AS raw_crop_span, span > 55 AS crop_clipped FROM dc)"""


def crops(spark, sf):
    docs = recordings(spark, sf).withColumn("duration", F.col("duration") / 1000)
    return A.estimate_crops(segments(spark, sf), aligned(spark, sf).select("doc_id", "index"), anchors(spark, sf), docs)


def to_tenths(df, *columns):
    return df.withColumns({c: F.round(c, 1) for c in columns})


@query("crop_estimates", f"WITH RECURSIVE {CROPS} SELECT * REPLACE (round(crop_start, 1) AS crop_start, round(crop_end, 1) AS crop_end, round(raw_crop_span, 1) AS raw_crop_span) FROM cr WHERE crop_end > crop_start")
def crop_estimates(spark, sf):
    """Rounded to tenths once more: the fourth digit depends on the order of sums."""
    return to_tenths(crops(spark, sf), "crop_start", "crop_end", "raw_crop_span")


@query("rough_fallback", f"""WITH RECURSIVE {CROPS}, nb AS{INTERPOLATED.split(", nb AS", 1)[1].split("nb AS", 1)[-1]}, fc AS (SELECT cr.*, greatest(0.005, crop_end - crop_start) AS long, unnest(range(word_start, word_end)) AS index FROM cr WHERE crop_end > crop_start),
fd AS (SELECT fc.*, ip."start" AS ws, ip."end" AS we FROM fc JOIN ip ON ip.doc_id = fc.doc_id AND ip.index = fc.index), fe AS (SELECT *, least(long, greatest(0.0, coalesce(ws, crop_start) - crop_start)) AS s FROM fd)
SELECT doc_id, segment_id, index, round(s, 1) AS "start", round(least(long, greatest(s + 0.005, coalesce(we, crop_start + long) - crop_start)), 1) AS "end" FROM fe""")
def rough_fallback(spark, sf):
    return to_tenths(A.rough_fallback(aligned(spark, sf).select("doc_id", "index"), anchors(spark, sf), crops(spark, sf)), "start", "end")


@query("fuzzy_align")
def fuzzy_align(spark, sf):
    """Tokens of every conversation's even turns against those of its odd ones."""
    t = turns(spark, sf).select("doc_id", "window_index", F.posexplode(F.split(F.lower("text"), r"\s+")).alias("pos", "token"))
    index = (F.col("window_index") * 100_000 + F.col("pos")).cast("bigint").alias("index")
    return A.fuzzy_align(t.filter("window_index % 2 = 0").select("doc_id", index, "token"), t.filter("window_index % 2 = 1").select("doc_id", index, "token"))


@query("window_word_times", f"""WITH RECURSIVE tw AS (SELECT conv_id AS doc_id, turn AS w, {BLANK_SPLIT.format('text')} AS words FROM conversations), n AS (SELECT doc_id, w, words, list_transform(words, lambda x: {KEY}) AS keys, row_number() OVER (PARTITION BY doc_id ORDER BY w) AS k FROM tw WHERE len(words) > 0),
p AS (SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS w, CAST([] AS VARCHAR[]) AS new, CAST([] AS VARCHAR[]) AS keys, 0.0::DOUBLE AS begin, 0.0::DOUBLE AS long, 0.0::DOUBLE AS last, 0::BIGINT AS before FROM n WHERE k = 1
  UNION ALL SELECT doc_id, k, w, new, all_keys, begin, long, CASE WHEN len(new) > 0 THEN greatest(begin + long * (len(new) - 1) / len(new) + 0.005, begin + long) ELSE last END, before + was
  FROM (SELECT *, greatest(0.01, greatest(begin + 0.01, s, e) - begin) AS long FROM (
    SELECT n.doc_id, n.k, n.w, n.w * 24.0::DOUBLE AS s, n.w * 24.0::DOUBLE + 28 AS e, p.last, p.before, len(p.new) AS was, greatest(n.w * 24.0::DOUBLE, p.last) AS begin, n.words[ov + 1 : len(n.words)] AS new, p.keys || n.keys[ov + 1 : len(n.keys)] AS all_keys
    FROM (SELECT p.*, coalesce(list_max(list_filter(range(2, least(48, len(p.keys), len(n.keys)) + 1), lambda z: p.keys[len(p.keys) - z + 1 : len(p.keys)] = n.keys[1 : z])), 0) AS ov FROM p JOIN n ON n.doc_id = p.doc_id AND n.k = p.k + 1) p JOIN n ON n.doc_id = p.doc_id AND n.k = p.k + 1)))
SELECT doc_id, before + i AS pos, new[i + 1] AS text, round(begin + long * i / len(new), 6) AS "start", round(greatest(begin + long * i / len(new) + 0.005, begin + long * (i + 1) / len(new)), 6) AS "end", w AS window_index FROM (SELECT *, unnest(range(len(new))) AS i FROM p)""")
def window_word_times(spark, sf):
    found = A.window_word_times(turns(spark, sf).withColumns({"start": F.col("window_index") * 24.0, "end": F.col("window_index") * 24.0 + 28.0}))
    return found.withColumns({c: F.round(c, 6) for c in ("start", "end")})


@query("character_bounds", rf"""WITH {LINES}, k AS (SELECT doc_id, index, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^''\p{{L}}\p{{N}}]', '', 'g') AS token FROM wi)
SELECT doc_id, index, o AS "offset", substring(token, (o + 1)::INTEGER, 1) AS character, index + o / length(token)::DOUBLE AS "start", index + (o + 1) / length(token)::DOUBLE AS "end" FROM (SELECT *, unnest(range(length(token))) AS o FROM k WHERE token <> '')""")
def character_bounds(spark, sf):
    from wordloom.functions.text import normalize_word

    words = word_index(spark, sf).select("doc_id", "index", normalize_word(F.col("text")).alias("token"), F.col("index").cast("double").alias("start"), (F.col("index") + 1.0).alias("end"))
    return A.character_bounds(words).withColumn("offset", F.col("offset").cast("bigint"))


@query("character_alignment")
def character_alignment(spark, sf):
    """Every document's words, crop by crop of 60, from pieces of two of them, some letters lost."""
    crop = ("doc_id", "crop")  # words come dealt by document: they are gathered where they are
    words = word_index(spark, sf).select("doc_id", F.expr("index div 60").alias("crop"), "index", F.lower("clean").alias("token"))
    pieces = words.withColumn("pair", F.expr("index div 2")).groupBy(*crop, "pair").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "token"))), lambda w: w["token"]), "").alias("token"))
    at = F.col("pair") % 30
    pieces = pieces.select(*crop, F.col("pair").alias("index"), F.when(F.col("pair") % 3 == 0, F.expr("substring(token, 2)")).otherwise(F.col("token")).alias("token"), (at * 1.0).alias("start"), (at + 0.9).alias("end"))
    found = A.align_characters(words, pieces, words.select(*crop).distinct().withColumn("duration", F.lit(30.0)), crop)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "index", "start", "end", "mode")


@query("bisected_segments", f"""WITH {MS}, s AS (SELECT doc_id, 'c' || (index // 9) AS id, min(index) AS a, max(index) + 1 AS b FROM wm GROUP BY doc_id, index // 9), h AS (SELECT doc_id, id, a, b, unnest([0, 1]) AS k FROM s WHERE b - a > 1)
SELECT doc_id, id || '.' || k AS segment_id, CASE WHEN k = 0 THEN a ELSE a + (b - a) // 2 END AS word_start, CASE WHEN k = 0 THEN a + (b - a) // 2 ELSE b END AS word_end FROM h""")
def bisected_segments(spark, sf):
    s = words_ms(spark, sf).groupBy("doc_id", F.expr("index div 9").alias("g")).agg(F.min("index").alias("word_start"), (F.max("index") + 1).alias("word_end"))
    return A.bisected(s.select("doc_id", F.concat(F.lit("c"), F.col("g").cast("string")).alias("segment_id"), "word_start", "word_end"))


@query("segments_with_descendants", f"""WITH {MS}, s AS (SELECT DISTINCT doc_id, 'c' || (index // 9) AS segment_id FROM wm) SELECT DISTINCT s.doc_id, s.segment_id FROM s JOIN wm ON s.doc_id = wm.doc_id AND wm.index % 9 = 4 AND wm.event_id % 3 = 0 AND s.segment_id = 'c' || (wm.index // 9)""")
def segments_with_descendants(spark, sf):
    w, g = words_ms(spark, sf), F.concat(F.lit("c"), F.expr("cast(index div 9 as string)"))
    done = w.filter("index % 9 = 4 and event_id % 3 = 0").select("doc_id", F.concat(g, F.lit(".0.1")).alias("segment_id"))
    return A.has_descendants(w.select("doc_id", g.alias("segment_id")).distinct(), done)


@query("bisection", f"""WITH RECURSIVE {MS}, b AS (SELECT doc_id, 'c' || (index // 13) AS segment_id, min(index) AS word_start, max(index) + 1 AS word_end FROM wm GROUP BY doc_id, index // 13),
t AS (SELECT *, EXISTS (SELECT 1 FROM wm WHERE wm.doc_id = b.doc_id AND wm.index >= word_start AND wm.index < word_end AND event_id % 23 = 0) AS failed FROM b
  UNION ALL SELECT h.*, EXISTS (SELECT 1 FROM wm WHERE wm.doc_id = h.doc_id AND wm.index >= h.word_start AND wm.index < h.word_end AND event_id % 23 = 0) FROM (
    SELECT doc_id, segment_id || '.' || k AS segment_id, CASE WHEN k = 0 THEN word_start ELSE word_start + (word_end - word_start) // 2 END AS word_start, CASE WHEN k = 0 THEN word_start + (word_end - word_start) // 2 ELSE word_end END AS word_end
    FROM (SELECT *, unnest([0, 1]) AS k FROM t WHERE failed AND word_end - word_start > 1)) h)
SELECT doc_id, segment_id, word_start, word_end, CASE WHEN failed THEN 'fallback' ELSE 'exact' END AS mode FROM t WHERE NOT failed OR word_end - word_start = 1""")
def bisection(spark, sf):
    """Segments halved until no half fails, or it is a word: those fail that hold a word of certain events."""
    w = words_ms(spark, sf)
    upto = w.select("doc_id", F.col("index").alias("i"), F.sum((F.col("event_id") % 23 == 0).cast("int")).over(Window.partitionBy("doc_id").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("bad"))

    def fails(segments):
        last = upto.select("doc_id", (F.col("i") + 1).alias("word_end"), F.col("bad").alias("b1"))
        first = upto.select("doc_id", (F.col("i") + 1).alias("word_start"), F.col("bad").alias("b0"))
        both = segments.join(last, ["doc_id", "word_end"]).join(first, ["doc_id", "word_start"], "left")
        return both.select(*segments.columns, (F.col("b1") > F.coalesce("b0", F.lit(0))).alias("failed"))

    s = w.groupBy("doc_id", F.expr("index div 13").alias("g")).agg(F.min("index").alias("word_start"), (F.max("index") + 1).alias("word_end"))
    return A.bisect_until(s.select("doc_id", F.concat(F.lit("c"), F.col("g").cast("string")).alias("segment_id"), "word_start", "word_end"), fails, 13)


RETRIED = f"""{HALVES}, kk AS (SELECT *, list_transform(a, lambda x: {KEY}) AS ka, list_transform(b, lambda x: {KEY}) AS kb FROM hv),
ov AS (SELECT *, CASE WHEN len(a) = 0 THEN 0 ELSE coalesce(list_max(list_filter(range(2, least(48, len(a), len(b)) + 1), lambda n: ka[len(ka) - n + 1 : len(ka)] = kb[1 : n])), 0) END AS o FROM kk),
documents AS (SELECT doc_id * 1000 + window_index AS doc_id, array_to_string(a || b[o + 1 : len(b)], ' ') AS text, (window_index % 3 + 1) * 30.0::DOUBLE AS n_chars FROM ov)"""


@query("retried_windows", f"""WITH {RETRIED}, {GATE} SELECT doc_id // 1000 AS doc_id, doc_id % 1000 AS window_index, text, len(reasons) = 0 OR (text = '' AND duration <= 2.5) AS ok, CASE WHEN text = '' AND duration <= 2.5 THEN '' ELSE array_to_string(reasons, ',') END AS reasons, text = '' AND duration <= 2.5 AS accepted_empty FROM gate""")
def retried_windows(spark, sf):
    """Windows whose two halves were transcribed anew, stitched and judged."""
    h = halves(spark, sf).withColumn("duration", (F.col("window_index") % 3 + 1) * 2.0)
    parts = h.select("doc_id", "window_index", "duration", F.posexplode(F.array(F.array_join("a", " "), F.array_join("b", " "))).alias("half", "text"))
    return A.merged_retries(parts).withColumn("reasons", F.array_join("reasons", ","))


@query("grid_refinement", f"""WITH {MS}, u AS (SELECT doc_id, index, index // 6 AS utt, event_id, ("start" // 1000)::DOUBLE AS s, ("start" // 1000 + 2)::DOUBLE AS e FROM wm),
g AS (SELECT doc_id, index, utt, s + (utt % 7)::DOUBLE + 0.25 AS fs, e + (utt % 7)::DOUBLE - 0.25 AS fe FROM u WHERE utt % 4 <> 0 AND utt % 4 <> 1 AND event_id % 3 <> 0),
d AS (SELECT u.*, fs, fe, median((s + e) / 2 - (fs + fe) / 2) OVER (PARTITION BY u.doc_id, u.utt) AS sh FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.index = g.index)
SELECT doc_id, index, coalesce(fs + sh, s) AS "start", coalesce(fe + sh, e) AS "end", CASE WHEN fs IS NOT NULL THEN '{M.REFINED}' WHEN utt % 4 = 0 THEN '{M.MISSING}' WHEN utt % 4 = 1 THEN '{M.INVALID}' ELSE '{M.UNMATCHED}' END AS source FROM d""")
def grid_refinement(spark, sf):
    """Utterances without a grid, with one that can't be read, and with one that has most of their words."""
    start = F.expr("cast(start div 1000 as double)")
    w = words_ms(spark, sf).select("doc_id", "index", "event_id", F.expr("index div 6").alias("utterance_id"), F.col("event_id").cast("string").alias("text"), start.alias("start"), (start + 2).alias("end"))
    offsets = w.groupBy("doc_id", "utterance_id").agg((F.min("start") - 0.5).alias("offset"))
    has = offsets.filter("utterance_id % 4 <> 0").select("doc_id", "utterance_id", (F.col("utterance_id") % 4 != 1).alias("valid"))
    late = (F.col("utterance_id") % 7).cast("double")
    grid = w.filter("utterance_id % 4 > 1 and event_id % 3 <> 0").join(offsets, ["doc_id", "utterance_id"]).select("doc_id", "utterance_id", F.col("index").alias("pos"), (F.col("start") + late + 0.25 - F.col("offset")).alias("start"), (F.col("end") + late - 0.25 - F.col("offset")).alias("end"), F.col("text").alias("label"))
    return M.refine_utterances(w, M.match_grids(w, offsets, grid), has).select("doc_id", "index", "start", "end", "source")


@query("retry_windows", f"""WITH {EV} SELECT doc_id, event_id, h AS half, CASE WHEN h = 0 THEN s ELSE greatest(s, (s + e) / 2 - 1.5) END AS "start", CASE WHEN h = 0 THEN least(e, (s + e) / 2 + 1.5) ELSE e END AS "end"
FROM (SELECT doc_id, event_id, ("start" // 1000)::DOUBLE AS s, ("end" // 1000)::DOUBLE AS e, unnest([0, 1]) AS h FROM ev)""")
def retry_windows(spark, sf):
    w = regions(spark, sf).select("doc_id", "event_id", F.expr("cast(start div 1000 as double)").alias("start"), F.expr("cast(end div 1000 as double)").alias("end"))
    return A.retry_windows(w).select("doc_id", "event_id", "half", "start", "end")


# ---- quality, validation, lineage ----


@query("source_counts", "WITH w AS (SELECT d.source AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled_fallback' ELSE 'mfa_label_' || quality END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, source, count(*) AS words FROM w GROUP BY doc_id, source")
def source_counts(spark, sf):
    return Q.source_counts(labelled(spark, sf))


def labelled(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("mfa_label_"), F.col("quality").cast("string")).alias("label"))
    return documents(spark, sf).join(labels, "doc_id", "left").select(F.col("source").alias("doc_id"), F.coalesce("label", F.lit("unlabelled_fallback")).alias("source"))


@query("coverage", "WITH c AS (SELECT d.source AS doc_id, count(*) AS words, count(l.doc_id) AS effective FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source) SELECT *, effective / words::DOUBLE AS rate, CASE WHEN effective / words::DOUBLE < 0.9 THEN 'low_coverage' END AS warning FROM c")
def coverage(spark, sf):
    return Q.coverage(labelled(spark, sf))


@query("missing_windows", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_windows(spark, sf):
    return L.missing(documents(spark, sf).select("doc_id"), table(spark, sf, "labels"), ("doc_id",))


SCHEDULE = """sc AS (SELECT conv_id AS doc_id, turn AS window_index, turn * 24.0::DOUBLE AS "start", turn * 24.0::DOUBLE + 28 AS "end" FROM conversations), rs AS (
  SELECT doc_id, window_index, "start" + CASE WHEN (doc_id + window_index) % 4 = 0 THEN 0.5 ELSE 0.001 END::DOUBLE AS "start", "end", CASE WHEN window_index % 5 = 4 THEN NULL ELSE 'x' END AS text, doc_id % 3 <> 0 AS ok FROM sc WHERE (doc_id * 7 + window_index) % 6 <> 0)"""


def schedule(spark, sf):
    w = F.col("window_index")
    return turns(spark, sf).select("doc_id", "window_index", (w * 24.0).alias("start"), (w * 24.0 + 28).alias("end"))


def results(spark, sf):
    d, w = F.col("doc_id"), F.col("window_index")
    return schedule(spark, sf).filter((d * 7 + w) % 6 != 0).withColumns({"start": F.col("start") + F.when((d + w) % 4 == 0, 0.5).otherwise(0.001), "text": F.when(w % 5 != 4, "x"), "ok": d % 3 != 0})


@query("unfinished_windows", f"WITH {SCHEDULE} SELECT doc_id, window_index FROM sc WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.doc_id = sc.doc_id AND rs.window_index = sc.window_index)")
def unfinished_windows(spark, sf):
    return L.missing(schedule(spark, sf), results(spark, sf)).select("doc_id", "window_index")


@query("resumable_windows", f"""WITH {SCHEDULE} SELECT rs.doc_id, rs.window_index FROM rs JOIN sc ON rs.doc_id = sc.doc_id AND rs.window_index = sc.window_index WHERE abs(rs."start" - sc."start") <= 0.002 AND abs(rs."end" - sc."end") <= 0.002 AND text IS NOT NULL AND ok""")
def resumable_windows(spark, sf):
    return L.resumable(schedule(spark, sf), results(spark, sf)).select("doc_id", "window_index")


@query("resume_counts", f"WITH {SCHEDULE} SELECT sc.doc_id, count(rs.doc_id) AS resumed, count(*) - count(rs.doc_id) AS \"new\" FROM sc LEFT JOIN rs ON rs.doc_id = sc.doc_id AND rs.window_index = sc.window_index GROUP BY sc.doc_id")
def resume_counts(spark, sf):
    return L.resume_counts(results(spark, sf), schedule(spark, sf), "window_index")


@query("unknown_keys", "SELECT DISTINCT event_type AS key FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def unknown_keys(spark, sf):
    given = table(spark, sf, "events").select(F.col("event_type").alias("key")).distinct()
    known = given.sparkSession.range(1).select(F.explode(F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))).alias("key"))
    return L.unknown_keys(given, known)


@query("valid_segments", f"""WITH {MS}, s AS (SELECT doc_id, (index // 8)::VARCHAR AS segment_id, CASE WHEN event_id % 50 = 0 THEN index - index % 8 ELSE index END AS wi, "start" AS s, "end" - CASE WHEN event_id % 60 = 1 THEN 100000000 ELSE 0 END AS e FROM wm)
SELECT doc_id, segment_id, count(*) = count(DISTINCT wi) AND bool_and(e >= s) AS valid FROM s GROUP BY doc_id, segment_id""")
def valid_segments(spark, sf):
    return L.valid_segments(words_ms(spark, sf).select("doc_id", F.expr("cast(index div 8 as string)").alias("segment_id"), F.when(F.col("event_id") % 50 == 0, F.col("index") - F.col("index") % 8).otherwise(F.col("index")).alias("word_index"), F.col("start").cast("double").alias("start"), (F.col("end") - F.when(F.col("event_id") % 60 == 1, 100_000_000).otherwise(0)).cast("double").alias("end")))


@query("cover_check", f"""WITH {MS}, s AS (SELECT doc_id, CASE WHEN event_id % 400 = 0 THEN 0 ELSE index END AS i FROM wm) SELECT doc_id, count(*) = count(DISTINCT i) AND min(i) = 0 AND max(i) = count(*) - 1 AS cover FROM s GROUP BY doc_id""")
def cover_check(spark, sf):
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return V.is_cover(words_ms(spark, sf).select("doc_id", F.when(F.col("event_id") % 400 == 0, 0).otherwise(F.col("index")).alias("i"), n.alias("n")), "i", "n")


@query("timeline_violations", f"""WITH {WORDS}, t AS (SELECT *, lag("end") {O} AS pe FROM tw), v AS (
  SELECT doc_id, index, 'C5' AS rule FROM t WHERE NOT ("start" >= 0 AND "start" <= "end" AND "end" <= duration) UNION ALL
  SELECT doc_id, index, 'C6' FROM t WHERE "start" < pe - 1e-6 UNION ALL
  SELECT doc_id, index, 'C7' FROM t WHERE NOT ("start" >= 0 AND "start" < "end" AND "end" <= duration) UNION ALL
  SELECT doc_id, index, 'C8' FROM t WHERE "start" < pe - 1e-6) SELECT doc_id, rule, index FROM v""")
def timeline_violations(spark, sf):
    words = timed_words(spark, sf).drop("duration").withColumns({"clean": F.col("text"), "source": F.col("event_type"), "focus_start": F.col("start"), "focus_end": F.col("end")})
    return V.word_violations(words, recordings(spark, sf).withColumn("duration", F.lit(2_678_400.0)))


BROKEN = f"""{LINES}, sp AS (SELECT doc_id, sentence_index AS index, min(index) AS a, max(index) + 1 - CASE WHEN sentence_index % 17 = 3 THEN 1 ELSE 0 END AS b FROM wi GROUP BY doc_id, sentence_index)"""


def broken_ranges(spark, sf):
    return line_ranges(spark, sf).select("doc_id", F.col("sentence_index").alias("index"), "word_start", (F.col("word_end") - F.when(F.col("sentence_index") % 17 == 3, 1).otherwise(0)).alias("word_end"))


@query("range_violations", f"""WITH {BROKEN}, n AS (SELECT doc_id, count(*) AS n FROM wi GROUP BY doc_id), r AS (SELECT sp.*, n, row_number() OVER (PARTITION BY sp.doc_id ORDER BY index) - 1 AS k, lag(b) OVER (PARTITION BY sp.doc_id ORDER BY index) AS pb, lead(a) OVER (PARTITION BY sp.doc_id ORDER BY index) AS na FROM sp JOIN n ON sp.doc_id = n.doc_id)
SELECT doc_id, 'C9' AS rule, index FROM r WHERE NOT (index = k AND a = coalesce(pb, 0) AND a < b AND b <= n AND (na IS NOT NULL OR b = n))""")
def range_violations(spark, sf):
    return V.range_violations(broken_ranges(spark, sf), word_index(spark, sf))


@query("pointer_violations", f"""WITH {BROKEN} SELECT wi.doc_id, 'C10' AS rule, wi.index FROM wi LEFT JOIN sp ON wi.doc_id = sp.doc_id AND wi.index >= sp.a AND wi.index < greatest(sp.b, sp.a + 1) WHERE sp.index IS DISTINCT FROM wi.sentence_index""")
def pointer_violations(spark, sf):
    return V.pointer_violations(word_index(spark, sf), broken_ranges(spark, sf))


@query("run_states", """WITH e AS (SELECT user_id AS job_id, event_id AS seq, event_type AS stage, CASE WHEN value < 10 THEN 'failed' WHEN value < 30 THEN 'reused' ELSE 'complete' END AS status FROM events),
l AS (SELECT job_id, stage, arg_max(status, seq) AS status FROM e GROUP BY job_id, stage), w AS (SELECT job_id, count(DISTINCT 'slow ' || stage) AS warnings FROM e WHERE seq % 9 = 0 GROUP BY job_id)
SELECT l.job_id, count(*)::INTEGER AS stages, bool_and(status IN ('complete', 'reused')) AS all_complete, coalesce(any_value(w.warnings), 0)::INTEGER AS warnings FROM l LEFT JOIN w ON l.job_id = w.job_id GROUP BY l.job_id""")
def run_states(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.lit("stage").alias("kind"), F.col("event_type").alias("stage"), F.when(F.col("value") < 10, "failed").when(F.col("value") < 30, "reused").otherwise("complete").alias("status"), F.lit("f").alias("fingerprint"), F.lit(None).cast("string").alias("message"))
    warned = e.filter("seq % 9 = 0").withColumns({"kind": F.lit("warning"), "message": F.concat(F.lit("slow "), "stage")})
    return L.run_state(e.unionByName(warned)).select("job_id", F.size("stages").alias("stages"), "all_complete", F.size("warnings").alias("warnings"))


@query("stage_fingerprints", """SELECT p_partkey, sha256('{"inputs":"' || p_brand || '","models":"m","name":"' || p_name || '","schema_version":1,"settings":"' || p_size || '"}') AS fingerprint FROM part""")
def stage_fingerprints(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.lit(1).alias("schema_version"), F.col("p_brand").alias("inputs"), F.col("p_size").cast("string").alias("settings"), F.lit("m").alias("models"))
    return L.stage_fingerprints(p).select("p_partkey", "fingerprint")


# ---- subtitles ----

CLOCK = "printf('%02d:%02d:%02d.%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query("vtt_cues", f"""WITH {MS} SELECT doc_id, index, (index + 1) || chr(10) || {CLOCK.format('"start"')} || ' --> ' || {CLOCK.format('"end"')} || chr(10) || event_type || chr(10) AS cue FROM wm""")
def vtt_cues(spark, sf):
    return S.vtt_cues(words_ms(spark, sf).withColumnRenamed("event_type", "text"))


@query("vtt_documents", f"""WITH {MS}, c AS (SELECT doc_id, index, (index + 1) || chr(10) || {CLOCK.format('"start"')} || ' --> ' || {CLOCK.format('"end"')} || chr(10) || event_type || chr(10) AS cue FROM wm) SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(cue, chr(10) ORDER BY index) AS vtt FROM c GROUP BY doc_id""")
def vtt_documents(spark, sf):
    return S.vtt_documents(words_ms(spark, sf).withColumnRenamed("event_type", "text"))


ACLOCK = "printf('%d:%02d:%02d.%02d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000 // 10)"
AEVENT = "'Dialogue: {n},' || " + ACLOCK.format("({a} - seg)") + " || ',' || " + ACLOCK.format("({b} - seg)") + " || ',Default,,0,0,0,,'"
IDLE_SQL = r"""printf('{{\fnGeist\b1\an5\pos(%.2f,%.2f)\fs60', 130.0 + index, 240.0) || '""" + S.IDLE_STYLE + "}}' || event_type"


def _ass_sql() -> str:
    def row(n: int, a: str, b: str, body: str, test: str) -> str:
        return "SELECT doc_id, segment, index, " + str(n) + " AS layer, " + AEVENT.replace("{n}", str(n)).replace("{a}", a).replace("{b}", b) + " || " + body + f" AS event FROM x WHERE {test}"

    idle = IDLE_SQL.replace("{{", "{").replace("}}", "}")
    active = idle.replace(S.IDLE_STYLE, S.ACTIVE_STYLE)
    box = "'m ' || printf('%.2f %.2f', x0 + 18.0, 200.0) || ' l ' || printf('%.2f %.2f', x0 + 82.0, 200.0) || ' b ' || printf('%.2f %.2f %.2f %.2f %.2f %.2f', x0 + 100.0, 200.0, x0 + 100.0, 200.0, x0 + 100.0, 218.0) || ' l ' || printf('%.2f %.2f', x0 + 100.0, 262.0) || ' b ' || printf('%.2f %.2f %.2f %.2f %.2f %.2f', x0 + 100.0, 280.0, x0 + 100.0, 280.0, x0 + 82.0, 280.0) || ' l ' || printf('%.2f %.2f', x0 + 18.0, 280.0) || ' b ' || printf('%.2f %.2f %.2f %.2f %.2f %.2f', x0, 280.0, x0, 280.0, x0, 262.0) || ' l ' || printf('%.2f %.2f', x0, 218.0) || ' b ' || printf('%.2f %.2f %.2f %.2f %.2f %.2f', x0, 200.0, x0, 200.0, x0 + 18.0, 200.0)"
    return " UNION ALL ".join([
        row(0, "b0", "b1", idle, "f1 <= f0"), row(0, "b0", "f0", idle, "f1 > f0 AND f0 > b0"), row(0, "f1", "b1", idle, "f1 > f0 AND b1 > f1"),
        row(1, "f0", "f1", "'{" + S.GLOW_STYLE + "}' || " + box + " || '{\\p0}'", "f1 > f0"), row(2, "f0", "f1", "'{" + S.BOX_STYLE + "}' || " + box + " || '{\\p0}'", "f1 > f0"), row(3, "f0", "f1", active, "f1 > f0"),
    ])


@query("ass_events", f"""WITH {MS}, s AS (SELECT *, "start" - 60000 AS s0, "end" + 60000 AS s1, ("start" + 30000) AS fs, ("end" - event_id % 7 * 200000) AS fe, 80.0::DOUBLE + index AS x0 FROM wm),
g AS (SELECT *, unnest(range(greatest(s0, 0) // 86400000, (s1 - 1) // 86400000 + 1)) AS segment FROM s), h AS (SELECT *, segment * 86400000 AS seg, greatest(s0, segment * 86400000) AS b0, least(s1, segment * 86400000 + 86400000, 2678400000) AS b1 FROM g WHERE segment < 31),
x AS (SELECT *, greatest(b0, fs) AS f0, least(b1, fe) AS f1 FROM h WHERE b1 > b0) {_ass_sql()}""")
def ass_events(spark, sf):
    w = words_ms(spark, sf)
    rect = F.struct((F.col("index") + 80.0).alias("x"), F.lit(200.0).alias("y"), F.lit(100.0).alias("width"), F.lit(80.0).alias("height"), (F.col("index") + 90.0).alias("textX"), F.lit(210.0).alias("textY"), F.lit(80.0).alias("textWidth"), F.lit(60.0).alias("textHeight"), F.lit(60.2).alias("fontSize"))
    words = w.select("doc_id", F.col("index").alias("sentence_index"), "index", F.col("event_type").alias("text"), (F.col("start") - 60000).alias("s_start"), (F.col("end") + 60000).alias("s_end"), (F.col("start") + 30000).alias("focus_start"), (F.col("end") - F.col("event_id") % 7 * 200000).alias("focus_end"), rect.alias("rect"))
    from wordloom.operators.intervals import fixed_windows

    segs = fixed_windows(recordings(spark, sf), 86_400_000).withColumnRenamed("window_index", "segment")
    return S.ass_events(words, segs).select("doc_id", "segment", "index", "layer", "event")


@query("utterances", f"""WITH {MS} SELECT doc_id, printf('utt_%05d', index) AS utterance_id, index AS sentence_index, round(greatest(0.0, s - 0.25), 6) AS "offset", round(least(2678400.0, e + 0.25) - greatest(0.0, s - 0.25), 6) AS duration FROM (SELECT doc_id, index, ("start" // 1000)::DOUBLE AS s, ("end" // 1000)::DOUBLE AS e FROM wm)""")
def utterances(spark, sf):
    s = words_ms(spark, sf).select("doc_id", F.col("index").alias("sentence_index"), F.expr("cast(start div 1000 as double)").alias("start"), F.expr("cast(end div 1000 as double)").alias("end"))
    return S.utterances(s, recordings(spark, sf).withColumn("duration", F.lit(2_678_400.0)), 0.25)


@query("wer_report")
def wer_report(spark, sf):
    """Every document's words against the same with some lost or changed, times shifted."""
    gold = word_index(spark, sf).select("doc_id", "index", F.col("clean").alias("text"), (F.col("index") * 0.4).alias("start"), (F.col("index") * 0.4 + 0.3).alias("end"))
    said = gold.filter("(index * 31 + doc_id) % 17 <> 0").withColumns({"text": F.when((F.col("index") + F.col("doc_id")) % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), "start": F.col("start") + 0.05})
    return Q.quality_report(said, gold)
