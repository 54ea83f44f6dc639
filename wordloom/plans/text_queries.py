"""Words, sentences, quality gates and text rules over documents, conversations, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions import identity, text as T, times
from wordloom.operators import quality as Q, transcripts as R
from wordloom.plans.registry import query, table
from wordloom.plans.staging import turns

TOKENS = r"""regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+(?:''[\p{{L}}\p{{N}}]+)?')"""
BLANK_SPLIT = r"""list_filter(regexp_split_to_array({0}, '[\s\p{{Z}}\x85\x1c-\x1f]+'), lambda x: x <> '')"""
W = f"w AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS word FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents))"
GRAMS4 = "g AS (SELECT * FROM (SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE gram IS NOT NULL)"
TOP = f"{GRAMS4}, c AS (SELECT doc_id, gram, count(*) AS count, min(pos) AS first FROM g GROUP BY doc_id, gram), top AS (SELECT doc_id, gram, count FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first) = 1)"


def _repeats() -> str:
    parts = []
    for n in Q.REPEAT_SIZES:
        gram = " || ' ' || ".join(["word"] + [f"lead(word, {k}) OVER o" for k in range(1, n)])
        parts.append(f"SELECT doc_id, count(*) AS n FROM (SELECT *, pos // {n} - row_number() OVER (PARTITION BY doc_id, gram, pos % {n} ORDER BY pos) AS run FROM (SELECT doc_id, pos, {gram} AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE gram IS NOT NULL) GROUP BY doc_id, gram, pos % {n}, run")
    return "rep AS (SELECT doc_id, max(n) AS repeats FROM (" + " UNION ALL ".join(parts) + ") GROUP BY doc_id)"


def documents(spark, sf):
    return table(spark, sf, "documents")


@query("quality_tokens_stats", f"WITH {W} SELECT doc_id, count(*) AS words, count(DISTINCT word) AS distinct_words FROM w GROUP BY doc_id")
def quality_tokens_stats(spark, sf):
    return Q.gate_counts(documents(spark, sf).select("doc_id", "text")).filter("n > 0").select("doc_id", F.col("n").alias("words"), F.col("distinct").alias("distinct_words"))


@query("dominant_4gram", f"WITH {W}, {TOP} SELECT * FROM top")
def dominant_4gram(spark, sf):
    return Q.dominant_gram(documents(spark, sf))


@query("consecutive_repeats", f"WITH {W}, {_repeats()} SELECT * FROM rep")
def consecutive_repeats(spark, sf):
    return Q.consecutive_repeats(documents(spark, sf))


GATE = f"""{W}, {TOP}, {_repeats()}, n AS (SELECT doc_id, count(*) AS n, count(DISTINCT word) AS d FROM w GROUP BY doc_id), q AS (
  SELECT docs.doc_id, text, n_chars / 15.0 AS duration, coalesce(n.n, 0) AS n, coalesce(d, 0) / greatest(coalesce(n.n, 0), 1)::DOUBLE AS u, coalesce(repeats, 1) AS r, coalesce(count, 0) AS t
  FROM documents docs LEFT JOIN n ON docs.doc_id = n.doc_id LEFT JOIN rep ON docs.doc_id = rep.doc_id LEFT JOIN top ON docs.doc_id = top.doc_id
), gate AS (SELECT *, list_filter([
  CASE WHEN n < 3 THEN 'too_few_words' END, CASE WHEN n >= 40 AND (r >= 8 OR r >= 4 AND u < 0.08) THEN 'consecutive_ngram_loop' END,
  CASE WHEN n >= 80 AND t >= greatest(12, n * 2 // 100) THEN 'dominant_ngram_loop' END, CASE WHEN n >= 100 AND u < 0.08 THEN 'low_vocabulary' END,
  CASE WHEN duration > 0 AND n / duration > 5.5 THEN 'implausibly_fast' END], lambda x: x IS NOT NULL) AS reasons FROM q)"""


def gate(spark, sf):
    return Q.transcript_quality(documents(spark, sf), F.col("n_chars") / 15.0)


@query("transcript_quality", f"WITH {GATE} SELECT doc_id, n AS word_count, u AS unique_ratio, r AS max_repeats, t AS top_count, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS ok FROM gate")
def transcript_quality(spark, sf):
    return gate(spark, sf).withColumn("reasons", F.array_join("reasons", ","))


@query("window_acceptance", f"""WITH {GATE} SELECT doc_id, CASE WHEN trim(text) = '' THEN reasons = ['too_few_words'] AND duration <= 2.5 ELSE reasons = ['too_few_words'] AND duration <= 10 END AS accepted,
len(reasons) > 0 AND duration <= 120 AND len(list_filter(reasons, lambda x: x NOT IN ('consecutive_ngram_loop', 'low_vocabulary'))) = 0 AS quarantined FROM gate""")
def window_acceptance(spark, sf):
    both = gate(spark, sf).join(documents(spark, sf).select("doc_id", "text", (F.col("n_chars") / 15.0).alias("duration")), "doc_id")
    return both.select("doc_id", Q.accept_short(F.col("reasons"), F.col("text"), F.col("duration")).alias("accepted"), Q.quarantine(F.col("reasons"), F.col("duration"), 120, ("consecutive_ngram_loop", "low_vocabulary")).alias("quarantined"))


LINES = rf"""li AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS sentence_index, toks FROM (
  SELECT doc_id, line, {BLANK_SPLIT.format('t')} AS toks FROM (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
) WHERE len(toks) > 0), wi AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index, pos) - 1 AS index, text, clean, sentence_index FROM (
  SELECT doc_id, sentence_index, pos, text, regexp_replace(text, '[^''\p{{L}}\p{{N}}]', '', 'g') AS clean FROM (SELECT doc_id, sentence_index, unnest(range(len(toks))) AS pos, unnest(toks) AS text FROM li)
) WHERE clean <> '')"""


@query("word_index", f"WITH {LINES} SELECT * FROM wi")
def word_index(spark, sf):
    return R.word_index(documents(spark, sf))


@query("line_ranges", f"WITH {LINES} SELECT doc_id, sentence_index, min(index) AS word_start, max(index) + 1 AS word_end, string_agg(text, ' ' ORDER BY index) AS text FROM wi GROUP BY doc_id, sentence_index")
def line_ranges(spark, sf):
    return R.ranges(word_index(spark, sf))


def _boundary() -> str:
    stem = "regexp_replace(b, '\\.$', '')"
    listed = ", ".join(f"'{a}'" for a in T.WORD_ABBREVIATIONS)
    return f"""regexp_matches(b, '[!?]$') OR (b LIKE '%.' AND lower({stem}) NOT IN ({listed}) AND NOT (regexp_matches({stem}, '^(?:[A-Za-z]\\.)+[A-Za-z]$') AND coalesce(regexp_matches(nxt, '^[a-z]'), false)))"""


SENTENCES = rf"""{LINES}, b AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY index) AS nxt, lead(sentence_index) OVER (PARTITION BY doc_id ORDER BY index) AS nxs, regexp_replace(text, '["”’'')\]}}]+$', '') AS b FROM wi),
e AS (SELECT *, CASE WHEN {_boundary()} OR coalesce(nxs <> sentence_index, true) THEN 1 ELSE 0 END AS ends FROM b),
se AS (SELECT doc_id, index, text, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM e)"""


def sentence_words(spark, sf):
    return R.sentence_ranges(word_index(spark, sf), "sentence_index")


@query("sentence_ranges", f"WITH {SENTENCES} SELECT doc_id, sentence, min(index) AS word_start, max(index) + 1 AS word_end, string_agg(text, ' ' ORDER BY index) AS text FROM se GROUP BY doc_id, sentence")
def sentence_ranges(spark, sf):
    return R.ranges(sentence_words(spark, sf), "sentence")


@query("range_assignment", f"WITH {SENTENCES} SELECT doc_id, index, sentence FROM se")
def range_assignment(spark, sf):
    spans = sentence_ranges(spark, sf).select("doc_id", "sentence", "word_start", "word_end")
    return R.assign_ranges(word_index(spark, sf).select("doc_id", "index"), spans, "sentence")


@query("sequence_mismatches", f"""WITH {LINES.replace("wi AS (", "wi AS MATERIALIZED (")}, c AS (SELECT doc_id, index, CASE WHEN index % 50 = 3 THEN text || '!' ELSE text END AS text FROM wi WHERE index % 1000 <> 999)
SELECT coalesce(a.doc_id, c.doc_id) AS doc_id, coalesce(a.index, c.index) AS index, a.text AS "left", c.text AS "right" FROM wi a FULL JOIN c ON a.doc_id = c.doc_id AND a.index = c.index WHERE a.text IS DISTINCT FROM c.text""")
def sequence_mismatches(spark, sf):
    words = word_index(spark, sf).select("doc_id", "index", "text")
    other = words.filter("index % 1000 <> 999").withColumn("text", F.when(F.col("index") % 50 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return R.sequence_mismatches(words, other)


LINE_WORDS = f"lw AS (SELECT doc_id, line, {BLANK_SPLIT.format('t')} AS toks FROM (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"


def line_words(spark, sf):
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.withColumn("line", F.col("line").cast("bigint")).withColumn("words", F.size(T.tokens(F.col("text"))))


@query("chunk_packing", f"""WITH RECURSIVE {LINE_WORDS}, n AS (SELECT doc_id, line, len(toks) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM lw), p AS (
  SELECT doc_id, line, k, n AS size, 0::BIGINT AS chunk FROM n WHERE k = 1
  UNION ALL SELECT n.doc_id, n.line, n.k, CASE WHEN p.size > 0 AND p.size + n.n > 300 THEN n.n ELSE p.size + n.n END, p.chunk + CASE WHEN p.size > 0 AND p.size + n.n > 300 THEN 1 ELSE 0 END
  FROM p JOIN n ON n.doc_id = p.doc_id AND n.k = p.k + 1
) SELECT doc_id, line, chunk FROM p""")
def chunk_packing(spark, sf):
    return R.pack_chunks(line_words(spark, sf))


@query("long_line_split", f"""WITH RECURSIVE {LINE_WORDS}, p AS (
  SELECT doc_id, line, toks, 0::BIGINT AS part, 0 AS cut, 0 AS size FROM lw
  UNION ALL SELECT doc_id, line, toks, part + 1, cut + size, CASE WHEN left_ <= 30 THEN left_ ELSE coalesce(list_max(list_filter(range(21, 31), lambda k: regexp_matches(toks[cut + size + k], '[.?!,;:]$'))), 30) END::INTEGER
  FROM (SELECT *, len(toks) - cut - size AS left_ FROM p) WHERE left_ > 0
) SELECT doc_id, line, part - 1 AS part, array_to_string(toks[cut + 1 : cut + size], ' ') AS text FROM p WHERE part > 0""")
def long_line_split(spark, sf):
    return R.split_long(line_words(spark, sf), 30)


@query("sentence_lines")
def sentence_lines(spark, sf):
    return R.sentence_lines(documents(spark, sf))


@query("padded_batches", f"""WITH RECURSIVE {LINE_WORDS}, n AS (SELECT doc_id, line AS item, len(toks) AS d, row_number() OVER (PARTITION BY doc_id ORDER BY len(toks), line) AS k FROM lw), p AS (
  SELECT doc_id, item, k, 1 AS c, 0::BIGINT AS batch FROM n WHERE k = 1
  UNION ALL SELECT n.doc_id, n.item, n.k, CASE WHEN p.c + 1 > 4 OR n.d * (p.c + 1) > 80 THEN 1 ELSE p.c + 1 END, p.batch + CASE WHEN p.c + 1 > 4 OR n.d * (p.c + 1) > 80 THEN 1 ELSE 0 END
  FROM p JOIN n ON n.doc_id = p.doc_id AND n.k = p.k + 1
) SELECT doc_id, item, batch FROM p""")
def padded_batches(spark, sf):
    return R.padded_batches(line_words(spark, sf).select("doc_id", F.col("line").alias("item"), F.col("words").alias("duration")), 4, 80)


KEY = r"""regexp_replace(replace(lower(x), 'ß', 'ss'), '[^\p{L}\p{N}_'']', '', 'g')"""
HALVES = f"""hv AS (SELECT conv_id AS doc_id, turn AS window_index, t[1 : greatest(len(t) // 2 + 3, 0)] AS a, t[greatest(len(t) // 2 - 2, 1) : len(t)] AS b FROM (SELECT *, {BLANK_SPLIT.format('text')} AS t FROM conversations))"""


def halves(spark, sf):
    t = F.col("t")
    return turns(spark, sf).withColumn("t", T.tokens(F.col("text"))).select("doc_id", "window_index", F.slice(t, 1, F.floor(F.size(t) / 2).cast("int") + 3).alias("a"), F.slice(t, F.greatest(F.floor(F.size(t) / 2).cast("int") - 2, F.lit(1)), F.size(t)).alias("b"))


@query("stitch_pairs", f"""WITH {HALVES}, k AS (SELECT *, list_transform(a, lambda x: {KEY}) AS ka, list_transform(b, lambda x: {KEY}) AS kb FROM hv)
SELECT doc_id, window_index, coalesce(list_max(list_filter(range(2, least(48, len(a), len(b)) + 1), lambda n: ka[len(ka) - n + 1 : len(ka)] = kb[1 : n])), 0)::INTEGER AS overlap FROM k""")
def stitch_pairs(spark, sf):
    keys = halves(spark, sf).withColumns({c: T.stitch_keys(F.array_join(c, " ")) for c in "ab"})
    return keys.select("doc_id", "window_index", R.overlap_length(F.col("a"), F.col("b")).alias("overlap"))


@query("stitched_transcript", f"""WITH RECURSIVE {HALVES}, u AS (SELECT doc_id, window_index * 2 AS o, a AS t FROM hv UNION ALL SELECT doc_id, window_index * 2 + 1, b FROM hv),
n AS (SELECT doc_id, t, list_transform(t, lambda x: {KEY}) AS kt, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k FROM u WHERE len(t) > 0), p AS (
  SELECT doc_id, k, t, kt FROM n WHERE k = 1
  UNION ALL SELECT doc_id, k, t || nt[ov + 1 : len(nt)], kt || nk[ov + 1 : len(nk)] FROM (
    SELECT p.doc_id, n.k, p.t, p.kt, n.t AS nt, n.kt AS nk, coalesce(list_max(list_filter(range(2, least(48, len(p.kt), len(n.kt)) + 1), lambda s: p.kt[len(p.kt) - s + 1 : len(p.kt)] = n.kt[1 : s])), 0) AS ov
    FROM p JOIN n ON n.doc_id = p.doc_id AND n.k = p.k + 1)
) SELECT doc_id, array_to_string(t, ' ') AS text FROM p QUALIFY k = max(k) OVER (PARTITION BY doc_id)""")
def stitched_transcript(spark, sf):
    h = halves(spark, sf)
    parts = h.select("doc_id", (F.col("window_index") * 2).alias("window_index"), F.array_join("a", " ").alias("text")).unionByName(h.select("doc_id", (F.col("window_index") * 2 + 1).alias("window_index"), F.array_join("b", " ").alias("text")))
    return R.stitch(parts)


@query("normalized_words", rf"""WITH {LINES} SELECT doc_id, index, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^''\p{{L}}\p{{N}}]', '', 'g') AS word, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_'']', '', 'g') AS stitch_key FROM wi""")
def normalized_words(spark, sf):
    return word_index(spark, sf).select("doc_id", "index", T.normalize_word(F.col("text")).alias("word"), T.stitch_key(F.col("text")).alias("stitch_key"))


@query("squeezed_text", rf"""SELECT doc_id, array_to_string({BLANK_SPLIT.format(r"replace(regexp_replace(text, '\[[^\]\n]+\]\s*', ' ', 'g'), chr(8203), '')")}, ' ') AS text FROM documents""")
def squeezed_text(spark, sf):
    return documents(spark, sf).select("doc_id", T.squeezed(T.strip_tags(F.col("text"))).alias("text"))


@query("slugify_title", """SELECT p_partkey, CASE WHEN s = '' THEN 'podcast' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(substring(regexp_replace(regexp_replace(regexp_replace(replace(lower(p_name || ' / ' || p_type), 'ß', 'ss'), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 72), '-+$', '') AS s FROM part)""")
def slugify_title(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slugify(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query("fingerprints", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS fingerprint FROM part""")
def fingerprints(spark, sf):
    return table(spark, sf, "part").select("p_partkey", identity.stable_hash(size=F.col("p_size"), name=F.col("p_name"), brand=F.col("p_brand")).alias("fingerprint"))


@query("job_ids", """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || left(sha256('{"name":"' || p_name || '"}'), 12) AS job_id, true AS valid FROM part""")
def job_ids(spark, sf):
    ids = table(spark, sf, "part").select("p_partkey", identity.job_id(F.col("p_name"), identity.stable_hash(name=F.col("p_name"))).alias("job_id"))
    return ids.withColumn("valid", T.is_job_id(F.col("job_id")))


HOSTS = ("example.com", "example.org")
URLS = """u AS (SELECT page_id, unnest([url, url || '?list=PL1&v=2', 'https://user:pw@' || regexp_replace(url, '^https?://', ''), 'ftp://example.com/a', 'https://example.com/', url || '?v=1#t', '/tmp/a.wav']) AS url, unnest(range(7)) AS form FROM pages)"""


def urls(spark, sf):
    u = F.col("url")
    forms = F.array(u, F.concat(u, F.lit("?list=PL1&v=2")), F.concat(F.lit("https://user:pw@"), F.regexp_replace(u, "^https?://", "")), F.lit("ftp://example.com/a"), F.lit("https://example.com/"), F.concat(u, F.lit("?v=1#t")), F.lit("/tmp/a.wav"))
    return table(spark, sf, "pages").select("page_id", F.posexplode(forms).alias("form", "url")).withColumn("form", F.col("form").cast("bigint"))


@query("url_policy", f"""WITH {URLS}, p AS (SELECT *, lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS h, regexp_extract(url, '(?i)^https?://[^/?#]+(/[^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM u)
SELECT page_id, form, regexp_matches(url, '(?i)^https?://[^/]') AS web, regexp_matches(url, '(?i)^https?://') AND (h IN ('example.com', 'example.org') OR h LIKE '%.example.com' OR h LIKE '%.example.org') AND NOT regexp_matches(url, '(?i)^https?://[^/?#]*@')
  AND NOT (lower(path) LIKE '/playlist%' OR regexp_matches(q, '(?i)(^|&)list=')) AND path NOT IN ('', '/') AS allowed, regexp_replace(url, '[?#].*$', '') AS clean_url FROM p""")
def url_policy(spark, sf):
    u = F.col("url")
    return urls(spark, sf).select("page_id", "form", T.is_web_source(u).alias("web"), T.url_allowed(u, HOSTS).alias("allowed"), T.url_without_query(u).alias("clean_url"))


# a character before a path that isn't part of it stands in for look-behind: no path begins where another ends
@query("redact_text", r"""WITH t AS (SELECT doc_id, substring('see https://a.example.com/x?k=' || doc_id || ' hf_' || repeat('aB3', 8) || ' C:\Users\' || doc_id || '\a.wav or /home/u/' || doc_id || '.txt, ' || text, 1, 1000) AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(https?://[^\s?"''<>]+)\?[^\s"''<>]+', '\1?<redacted-query>', 'gi'), 'hf_[A-Za-z0-9]{20,}', '<redacted-token>', 'g') AS t FROM t),
b AS (SELECT doc_id, regexp_replace(t, '(^|[^\p{L}\p{N}_])[A-Za-z]:[\\/][^\s"''<>]+', '\1<local-path>', 'g') AS t FROM a)
SELECT doc_id, regexp_replace(t, '(^|[^\p{L}\p{N}_/:])/[^\s"''<>]+', '\1<local-path>', 'g') AS text FROM b""")
def redact_text(spark, sf):
    i = F.col("doc_id").cast("string")
    t = F.concat(F.lit("see https://a.example.com/x?k="), i, F.lit(" hf_" + "aB3" * 8 + " C:\\Users\\"), i, F.lit("\\a.wav or /home/u/"), i, F.lit(".txt, "), "text")
    return documents(spark, sf).select("doc_id", T.redact(t).alias("text"))


@query("worker_errors", r"""SELECT page_id, substring('GET ' || regexp_replace(url, '(https?://[^\s?"''<>]+)\?[^\s"''<>]+', '\1?<redacted-query>', 'gi') || '?<redacted-query> failed: ' || repeat('x', 300), 1, 240) AS text FROM pages WHERE url NOT LIKE '%?%' AND length(url) < 100""")
def worker_errors(spark, sf):
    """The 240 characters that a worker's error may have (F14); a URL's query is never among them."""
    p = table(spark, sf, "pages").filter(~F.col("url").contains("?") & (F.length("url") < 100))
    # the cut comes first, so the text is given as long as it is once its query is hidden
    raw = F.concat(F.lit("GET "), "url", F.lit("?a"), F.lit("b" * 15), F.lit(" failed: "), F.lit("x" * 300))
    return p.select("page_id", T.redact(raw, 240).alias("text"))


@query("human_sizes", """SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576.0::DOUBLE) ELSE printf('%.1f GiB', b / 1073741824.0::DOUBLE) END AS size
FROM (SELECT doc_id, n_chars * (1 + doc_id % 5) * CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN 1000 ELSE 100000 END AS b FROM documents)""")
def human_sizes(spark, sf):
    size = F.col("n_chars") * (1 + F.col("doc_id") % 5) * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 1000).otherwise(100_000)
    return documents(spark, sf).select("doc_id", T.human_bytes(size).alias("size"))


@query("display_arguments", """SELECT page_id, form, CASE WHEN form % 4 = 1 THEN '<redacted>' WHEN form % 4 = 2 THEN '"' || page_id || ' é"' ELSE 'page=' || page_id END AS shown FROM (SELECT page_id, unnest(range(4)) AS form FROM pages)""")
def display_arguments(spark, sf):
    i = F.col("page_id").cast("string")
    forms = F.posexplode(F.array(F.concat(F.lit("page="), i), F.concat(F.lit("x Token="), i), F.concat(i, F.lit(" é")), F.concat(F.lit("page="), i))).alias("form", "a")
    return table(spark, sf, "pages").select("page_id", forms).select("page_id", F.col("form").cast("bigint").alias("form"), T.display_argument(F.col("a")).alias("shown"))


@query("last_json_objects", """SELECT page_id, '{"n":' || page_id || '}' AS object FROM pages""")
def last_json_objects(spark, sf):
    i = F.col("page_id").cast("string")
    noisy = F.concat(F.lit('start\n{"n": 1}\n[download] 3%\n'), F.lit('{"n":'), i, F.lit('}\n{"broken": \n[1, 2]\ndone'))
    return table(spark, sf, "pages").select("page_id", T.last_json_object(noisy).alias("object"))


@query("clock_times", """SELECT l_orderkey, l_linenumber, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS vtt, printf('%d:%02d:%02d.%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000 // 10) AS ass
FROM (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 997)::BIGINT AS ms FROM lineitem)""")
def clock_times(spark, sf):
    ms = F.round(F.col("l_extendedprice") * 997).cast("bigint")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", times.vtt_time(ms).alias("vtt"), times.ass_time(ms).alias("ass"))


@query("small_rules", """SELECT p_partkey, greatest(0.25, least(2.0, p_retailprice * 0.002)) AS tolerance, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE (30000 + p_partkey) / (p_size % 5)::DOUBLE END AS fps, CASE WHEN 400 + p_size * 40 <= 820 THEN 52.0 ELSE least(76.0, greatest(56.0, (400 + p_size * 40) * 0.046)) END::DOUBLE AS font,
round(p_retailprice * 160)::BIGINT AS first_frame, round((p_retailprice + p_size) * 160)::BIGINT - round(p_retailprice * 160)::BIGINT AS frames FROM part""")
def small_rules(spark, sf):
    p = table(spark, sf, "part")
    rate = F.concat((30000 + F.col("p_partkey")).cast("string"), F.lit("/"), (F.col("p_size") % 5).cast("string"))
    first, count = times.frame_bounds(F.col("p_retailprice"), F.col("p_retailprice") + F.col("p_size"), 160, F.lit(10**9))
    return p.select("p_partkey", times.duration_tolerance(F.col("p_retailprice")).alias("tolerance"), times.frames_per_second(rate).alias("fps"), times.font_cap(400 + F.col("p_size") * 40).alias("font"), first.alias("first_frame"), count.alias("frames"))


@query("wer_distance")
def wer_distance(spark, sf):
    """Token edits between each document and the next one, all words of either."""
    docs = documents(spark, sf).select("doc_id", T.quality_tokens(F.col("text")).alias("t"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("o"))
    return Q.word_distance(docs.join(other, "doc_id"), "t", "o").select("doc_id", "distance")
