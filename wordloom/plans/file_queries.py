"""Files that recordings come with and leave: written from the tables, read back by the readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import identity, text as T, times
from wordloom.operators import lineage as L
from wordloom.plans.registry import query, table
from wordloom.sources import config, files, sinks

NAMES = ("key", "region", "name")


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; on one machine, where none is set, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{root.rstrip('/')}/wordloom-files-{uuid.uuid4().hex}"


def nations(spark, sf) -> DataFrame:
    """(key, region, name): few rows, of which each becomes a file."""
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_regionkey").cast("bigint").alias("region"), F.col("n_name").alias("name"))


N = "n AS (SELECT n_nationkey::BIGINT AS key, n_regionkey::BIGINT AS region, n_name AS name FROM nation)"


def written_texts(spark, df: DataFrame, *keys: str) -> str:
    path = folder(spark)
    sinks.write_texts(df, path, keys[0], "text", keys[1:])
    return path


@query("media_inventory", f"WITH {N} SELECT key, octet_length(encode(name || ' é'))::BIGINT + 1 AS size_bytes, sha256(name || ' é' || chr(10)) AS sha256, '.txt' AS suffix FROM n")
def media_inventory(spark, sf):
    path = written_texts(spark, nations(spark, sf).withColumn("text", F.concat("name", F.lit(" é"))), "key")
    found = files.media_files(spark, f"{path}/*/*")
    return found.select(F.regexp_extract("path", r"key=(\d+)", 1).cast("bigint").alias("key"), "size_bytes", "sha256", "suffix")


@query("folder_sizes", f"WITH {N} SELECT region, count(*) AS files, sum(length(name) + 1)::BIGINT AS size_bytes FROM n GROUP BY region")
def folder_sizes(spark, sf):
    path = written_texts(spark, nations(spark, sf).withColumn("text", F.col("name")), "region", "key")
    found = files.media_files(spark, f"{path}/*/*/*").withColumn("path", F.regexp_replace("path", r"/key=\d+/", "/"))
    return files.folder_sizes(found).select(F.regexp_extract("folder", r"region=(\d+)", 1).cast("bigint").alias("region"), "files", "size_bytes")


@query("transcript_files", f"WITH {N} SELECT key, name || chr(10) || 'two ' || key || chr(10) AS text FROM n")
def transcript_files(spark, sf):
    """A transcript a file, read whole."""
    path = written_texts(spark, nations(spark, sf).withColumn("text", F.concat("name", F.lit("\ntwo "), "key")), "key")
    return files.transcripts(spark, path).select(F.regexp_extract("text", r"two (\d+)", 1).cast("bigint").alias("key"), "text")


@query("chunk_files", f"WITH {N} SELECT key::INTEGER AS chunk_index, printf('chunk_%03d.txt', key) AS file, name || ' said so' AS text FROM n")
def chunk_files(spark, sf):
    """Chunks named by their number, tags in them, beside a hidden file that isn't one."""
    path = written_texts(spark, nations(spark, sf).withColumn("text", F.concat(F.lit("[tag] "), "name", F.lit("  said\n so"))), "key")
    target = folder(spark)
    for r in files.media_files(spark, f"{path}/*/*").select("path", F.regexp_extract("path", r"key=(\d+)", 1).cast("int").alias("key")).collect():
        sinks.copy_path(spark, r.path, f"{target}/chunk_{r.key:03d}.txt")
        sinks.copy_path(spark, r.path, f"{target}/._chunk_{r.key:03d}.txt")
    return files.chunk_files(spark, target)


@query("window_files", f"""WITH {N} SELECT key, w::BIGINT AS window_index, w * 24.0::DOUBLE AS "start", w * 24.0::DOUBLE + 28 AS "end", name AS text, w = 0 AS ok FROM n CROSS JOIN (SELECT unnest(range(3)) AS w) WHERE key % 7 <> 3""")
def window_files(spark, sf):
    """Windows of checkpoints, some of which were cut short."""
    one = lambda w: F.format_string(f'"{w}":{{"start":{w * 24.0},"end":{w * 24.0 + 28},"text":"%s","quality":{{"ok":{str(w == 0).lower()},"reasons":["%d"]}}}}', "name", "key")
    whole = F.concat(F.lit('{"windows":{'), F.concat_ws(",", one(0), one(1), one(2)), F.lit("}}"))
    text = F.when(F.col("key") % 7 == 3, F.substring(whole, 1, 60)).otherwise(whole)
    found = files.stt_windows(spark, written_texts(spark, nations(spark, sf).withColumn("text", text), "key"))
    return found.filter("text is not null").select(F.col("reasons")[0].cast("bigint").alias("key"), "window_index", "start", "end", "text", "ok")


@query("region_files", f"""WITH {N} SELECT key + k * 0.25::DOUBLE AS "start", key + k * 0.25::DOUBLE + 0.125 AS "end" FROM n CROSS JOIN (SELECT unnest(range(4)) AS k) WHERE key % 5 <> 1""")
def region_files(spark, sf):
    one = lambda k: F.format_string("[%s,%s]", (F.col("key") + k * 0.25).cast("string"), (F.col("key") + k * 0.25 + 0.125).cast("string"))
    whole = F.concat(F.lit('{"regions":['), F.concat_ws(",", *[one(k) for k in range(4)]), F.lit(",[1]]}"))
    text = F.when(F.col("key") % 5 == 1, F.lit("not json")).otherwise(whole)
    return files.speech_regions(spark, written_texts(spark, nations(spark, sf).withColumn("text", text), "key")).select("start", "end")


@query("observed_files", f"""WITH {N} SELECT i AS index, name || i AS text, key * 1.0::DOUBLE AS "start", key + i * 0.5::DOUBLE AS "end" FROM n CROSS JOIN (SELECT unnest(range(3)) AS i)""")
def observed_files(spark, sf):
    one = lambda i: F.format_string(f'{{"text":"%s{i}","start":%s,"end":%s}}', "name", "key", (F.col("key") + i * 0.5).cast("string"))
    text = F.concat(F.lit('{"items":['), F.concat_ws(",", one(0), one(1), one(2)), F.lit("]}"))
    return files.observed_words(spark, written_texts(spark, nations(spark, sf).withColumn("text", text), "key")).select("index", "text", "start", "end")


@query("layout_files", f"WITH {N} SELECT key * 10 + k AS sentence_index, name AS word FROM n CROSS JOIN (SELECT unnest(range(3)) AS k) WHERE k < CASE key % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END")
def layout_files(spark, sf):
    """Records a line, up to the first that isn't whole."""
    one = lambda k: F.format_string(f'{{"sentence_index":%d,"words":[{{"x":1.5,"text":"%s"}}]}}', F.col("key") * 10 + k, "name")
    line = lambda k: F.when(F.col("key") % 4 == k, F.substring(one(k), 1, 25)).otherwise(one(k))
    text = F.concat_ws("\n", line(0), line(1), one(2))
    found = files.layouts(spark, written_texts(spark, nations(spark, sf).withColumn("text", text), "key"))
    return found.select("sentence_index", F.col("words")[0]["text"].alias("word"))


@query("grid_files", f"""WITH {N} SELECT key + k * 0.25::DOUBLE AS "start", key + k * 0.25::DOUBLE + 0.25 AS "end", pos, name || k AS label FROM n CROSS JOIN (SELECT unnest([0, 2]) AS k, unnest([0, 1]) AS pos)""")
def grid_files(spark, sf):
    """Word tiers in the long text form and in the short one; blank intervals are silence."""

    def marks(k: int) -> list:
        label = F.concat("name", F.lit(str(k))) if k != 1 else F.lit(" ")
        return [(F.col("key") + k * 0.25).cast("string"), (F.col("key") + k * 0.25 + 0.25).cast("string"), label]

    short_tier = F.concat(*[F.concat(a, F.lit("\n"), b, F.lit('\n"'), c, F.lit('"\n')) for a, b, c in map(marks, range(3))])
    short = F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n99\n<exists>\n2\n"IntervalTier"\n"phones"\n0\n99\n1\n0\n99\n"p"\n"IntervalTier"\n"Words"\n0\n99\n3\n'), short_tier)
    long_tier = F.concat(*[F.concat(F.lit(f"intervals [{k + 1}]:\nxmin = "), a, F.lit("\nxmax = "), b, F.lit('\ntext = "'), c, F.lit('"\n')) for k, (a, b, c) in enumerate(map(marks, range(3)))])
    long = F.concat(F.lit('File type = "ooTextFile"\nxmin = 0\nxmax = 99\nitem []:\nitem [1]:\nclass = "IntervalTier"\nname = "phones"\nintervals [1]:\nxmin = 0\nxmax = 99\ntext = "p"\nitem [2]:\nclass = "IntervalTier"\nname = "words"\n'), long_tier)
    text = F.when(F.col("key") % 2 == 0, long).otherwise(short)
    found = files.grid_words(spark, written_texts(spark, nations(spark, sf).withColumn("text", text), "key"))
    return found.select("start", "end", "pos", "label")


@query("stored_tables", "SELECT r_regionkey::BIGINT AS key, r_name AS name, 'parquet' AS kind FROM region UNION ALL SELECT r_regionkey, r_name, 'json' FROM region")
def stored_tables(spark, sf):
    """Tables written whole, as Parquet and as JSON, a second time over the first."""
    rows = table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("key"), F.col("r_name").alias("name"))
    at, beside = folder(spark), folder(spark)
    for some in (rows.limit(1), rows):
        sinks.write_table(some, at)
        sinks.write_json(some, beside)
    back = spark.read.parquet(at).withColumn("kind", F.lit("parquet"))
    return back.unionByName(spark.read.schema("key bigint, name string").json(beside).withColumn("kind", F.lit("json")))


@query("settings", "SELECT * FROM (VALUES ('speech', 'window_seconds', 28.0::DOUBLE), ('speech', 'overlap_seconds', 4.0), ('speech', 'padding_seconds', 0.35), ('speech', 'merge_gap_seconds', 0.5), ('alignment', 'batch_items', 4.0), ('alignment', 'padded_seconds', 80.0), ('output', 'width', 1280.0), ('output', 'height', 1080.0), ('output', 'fps', 30.0), ('output', 'segment_seconds', 300.0), ('output', 'silence_threshold', 5.0), ('refused', 'unknown', 1.0), ('refused', 'negative', 1.0), ('refused', 'overlap', 1.0)) v(part, name, value)")
def settings(spark, sf):
    """Settings with two given, and mappings that are refused."""
    import tomllib

    given = config.from_mapping(tomllib.loads("[speech]\nmerge_gap_seconds = 0.5\n[output]\nwidth = 1280"))
    rows = [(part, name, float(value)) for part, values in given.fields().items() if isinstance(values, dict) for name, value in values.items()]
    for why, bad in (("unknown", {"speech": {"x": 1}}), ("negative", {"output": {"fps": -1}}), ("overlap", {"speech": {"overlap_seconds": 30.0}})):
        try:
            config.from_mapping(bad)
        except ValueError:
            rows.append(("refused", why, 1.0))
    return spark.createDataFrame(rows, "part string, name string, value double")


# ---- probes, pages, layouts, artifacts, logs ----

PROBES = """p AS (SELECT p_partkey, p_size, p_partkey % 6 AS form FROM part)"""


def probes(spark, sf):
    """Six kinds of probe: sound, without audio, without a duration, of an odd rate, two videos, broken."""
    form, size = F.col("form"), F.col("p_size").cast("string")
    audio = F.concat(F.lit('{"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":2,"duration":"'), size, F.lit('.5"}'))
    rate = F.when(form == 3, "24000/1001").otherwise("30/1")
    video = F.concat(F.lit('{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"avg_frame_rate":"'), rate, F.lit('"}'))
    streams = F.when(form == 1, video).when(form == 4, F.concat_ws(",", video, video, audio)).otherwise(F.concat_ws(",", video, audio))
    length = F.when(form == 2, F.lit("{}")).otherwise(F.concat(F.lit('{"duration":"'), size, F.lit('.25"}')))
    whole = F.concat(F.lit('{"streams":['), streams, F.lit('],"format":'), length, F.lit("}"))
    return table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 6).alias("form")).withColumn("probe", F.when(form == 5, "oops").otherwise(whole))


@query("audio_probes", f"""WITH {PROBES} SELECT p_partkey, CASE WHEN form IN (1, 5) THEN NULL WHEN form = 2 THEN p_size + 0.5 ELSE p_size + 0.25 END::DOUBLE AS duration_seconds, CASE WHEN form NOT IN (1, 5) THEN 'aac' END AS codec, CASE WHEN form NOT IN (1, 5) THEN 48000 END AS sample_rate, CASE WHEN form NOT IN (1, 5) THEN 2 END AS channels, CASE WHEN form IN (1, 5) THEN 'no audio stream' END AS problem FROM p""")
def audio_probes(spark, sf):
    return files.audio_probes(probes(spark, sf)).select("p_partkey", "duration_seconds", "codec", "sample_rate", "channels", "problem")


@query("video_problems", f"""WITH {PROBES} SELECT p_partkey, CASE WHEN form IN (1, 4, 5) THEN 'streams' WHEN form = 3 THEN 'frame rate' WHEN form = 2 OR p_size % 4 = 0 THEN 'duration' END AS problem FROM p""")
def video_problems(spark, sf):
    """Against a duration that is a little off, and for every fourth size far off."""
    expected = F.col("p_size") + 0.1 + F.when(F.col("p_size") % 4 == 0, 9.0).otherwise(0.0)
    rows = probes(spark, sf).withColumn("expected", expected)
    return files.video_problems(rows, 1920, 1080, 30.0, "expected").select("p_partkey", "problem")


PAGE_SQL = r"""SELECT page_id, lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host, page_id::VARCHAR AS video_id, CASE WHEN page_id % 5 = 0 THEN page_id::VARCHAR ELSE 'T ' || page_id END AS title, regexp_replace(url, '[?#].*$', '') AS source_page,
CASE WHEN page_id % 2 = 0 THEN 'c' END AS channel_id, CASE page_id % 5 WHEN 1 THEN 'playlist' WHEN 2 THEN 'live' WHEN 3 THEN 'login' END AS problem FROM pages"""


@query("page_metadata", PAGE_SQL)
def page_metadata(spark, sf):
    """What may be kept of a downloader's output, and which pages are refused."""
    i = F.col("page_id").cast("string")
    kind = F.col("page_id") % 5
    extra = F.when(kind == 1, ',"_type":"playlist"').when(kind == 2, ',"live_status":"is_upcoming"').when(kind == 3, ',"availability":"private"').otherwise("")
    title = F.when(kind == 0, "").otherwise(F.concat(F.lit("T "), i))
    channel = F.when(F.col("page_id") % 2 == 0, ',"channel_id":"c"').otherwise("")
    output = F.concat(F.lit('note\n{"id":"'), i, F.lit('","title":"'), title, F.lit('","cookies":"secret"'), extra, channel, F.lit("}\ndone"))
    pages = table(spark, sf, "pages").select("page_id", F.concat("url", F.lit("?v=1")).alias("url"), output.alias("output"))
    return files.page_metadata(pages).select("page_id", "host", "video_id", "title", "source_page", "channel_id", "problem")


@query("valid_layouts", """SELECT p_partkey AS sentence_index, p_partkey % 4 = 0 OR p_partkey % 4 = 3 AS valid FROM part""")
def valid_layouts(spark, sf):
    """Layouts of two words: of other texts, of a width of 0, sound, with sizes as they should be."""
    key = F.col("p_partkey") % 4
    names = ("x", "y", "width", "height", "textX", "textY", "textWidth", "textHeight", "fontSize")

    def word(text, width):
        return F.struct(*[(width if n == "width" else F.lit(2.5)).alias(n) for n in names], F.lit("700").alias("fontWeight"), text.alias("text"))

    words = F.array(word(F.col("p_brand"), F.lit(3.5)), word(F.when(key == 1, F.lit("other")).otherwise(F.col("p_type")), F.when(key == 2, 0.0).otherwise(4.0)))
    part = table(spark, sf, "part").withColumns({"doc_id": F.lit(1), "sentence_index": F.col("p_partkey"), "words": words, "texts": F.array("p_brand", "p_type")})
    return L.valid_layouts(part.select("doc_id", "sentence_index", "words"), part.select("doc_id", "sentence_index", "texts")).select("sentence_index", "valid")


@query("valid_artifacts", """SELECT 'f' || o_custkey AS fingerprint, bool_and(o_orderkey % 9 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0) AS valid FROM orders GROUP BY o_custkey""")
def valid_artifacts(spark, sf):
    """A customer's orders as artifacts: some changed, some lost, some outside the folder."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("fingerprint"), F.col("o_orderkey").cast("string").alias("k"))
    path = F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("../"), "k")).otherwise(F.concat(F.lit("a/"), "k"))
    o = o.withColumns({"path": path, "sha256": F.sha2(F.col("k").cast("binary"), 256)})
    listed = o.groupBy("fingerprint").agg(F.collect_list(F.struct("path", "sha256")).alias("artifacts"))
    there = o.filter("o_orderkey % 11 <> 0").select("path", F.when(F.col("o_orderkey") % 9 == 0, "changed").otherwise(F.col("sha256")).alias("sha256"))
    return L.valid_artifacts(listed, there)


@query("checkpoint_documents", """SELECT 'j' || o_custkey AS job_id, o_orderpriority AS stage, '{"schema_version":1,"fingerprint":"f' || o_custkey || '","status":"complete","completed_at":"2024-01-01T00:00:00+00:00","elapsed_seconds":1.235,"artifacts":[' ||
string_agg('{"path":"a/' || o_orderkey || '","sha256":"' || sha256(o_orderkey::VARCHAR) || '","size_bytes":' || length(o_orderkey::VARCHAR) || '}', ',' ORDER BY 'a/' || o_orderkey) || ']}' AS document FROM orders GROUP BY o_custkey, o_orderpriority""")
def checkpoint_documents(spark, sf):
    k = F.col("o_orderkey").cast("string")
    o = table(spark, sf, "orders").select(F.concat(F.lit("j"), F.col("o_custkey").cast("string")).alias("job_id"), F.col("o_orderpriority").alias("stage"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("fingerprint"), F.concat(F.lit("a/"), k).alias("path"), F.sha2(k.cast("binary"), 256).alias("sha256"), F.length(k).cast("bigint").alias("size_bytes"))
    stages = o.select("job_id", "stage", "fingerprint").distinct().withColumns({"completed_at": F.lit("2024-01-01T00:00:00+00:00"), "elapsed_seconds": F.lit(1.2345678)})
    return L.checkpoint_documents(stages, o)


@query("manifest_documents", """WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN value < 5 THEN 'failed' ELSE 'complete' END AS status FROM events), l AS (SELECT user_id, event_type, arg_max(status, event_id) AS status FROM e GROUP BY ALL),
w AS (SELECT user_id, string_agg('"slow ' || event_type || '"', ',' ORDER BY first) AS warnings FROM (SELECT user_id, event_type, min(event_id) AS first FROM e WHERE event_id % 9 = 0 GROUP BY ALL) GROUP BY user_id)
SELECT 'j' || l.user_id AS job_id, '{"schema_version":1,"job_id":"j' || l.user_id || '","fingerprint":"f","status":"' || CASE WHEN bool_and(status = 'complete') THEN 'complete' ELSE 'failed' END || '","stages":{' || string_agg('"' || event_type || '":{"status":"' || status || '","fingerprint":"g"}', ',' ORDER BY event_type) || '},"warnings":[' || coalesce(any_value(warnings), '') || ']}' AS document
FROM l LEFT JOIN w ON l.user_id = w.user_id GROUP BY l.user_id""")
def manifest_documents(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("seq"), F.lit("stage").alias("kind"), F.col("event_type").alias("stage"), F.when(F.col("value") < 5, "failed").otherwise("complete").alias("status"), F.lit("g").alias("fingerprint"), F.lit(None).cast("string").alias("message"))
    warned = e.filter("seq % 9 = 0").withColumns({"kind": F.lit("warning"), "message": F.concat(F.lit("slow "), "stage")})
    return L.manifest_documents(e.select("job_id").distinct().withColumn("fingerprint", F.lit("f")), e.unionByName(warned))


@query("log_lines", """SELECT user_id AS job_id, string_agg('[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00] ' || event_type, chr(10) ORDER BY event_id) AS text FROM events GROUP BY user_id""")
def log_lines(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("message"))
    return L.log_lines(e)


@query("item_bounds", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN least(l_quantity, l_discount * 100) END::DOUBLE AS "start", CASE WHEN l_linenumber % 3 <> 0 THEN greatest(l_quantity, l_discount * 100) END::DOUBLE AS "end" FROM lineitem""")
def item_bounds(spark, sf):
    """Bounds as text, every third end not a finite number, some in the wrong order."""
    bad = F.when(F.col("l_orderkey") % 3 == 0, "NaN").when(F.col("l_orderkey") % 3 == 1, "Infinity").otherwise("soon")
    start, end = F.col("l_quantity").cast("double").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, bad).otherwise((F.col("l_discount") * 100).cast("double").cast("string"))
    a, b = times.item_bounds(start, end)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", a.alias("start"), b.alias("end"))


@query("linear_bounds", """SELECT l_orderkey, l_linenumber, (l_linenumber - 1) * (64.0::DOUBLE / 8) AS "start", l_linenumber * (64.0::DOUBLE / 8) AS "end", 64.0::DOUBLE / greatest(l_linenumber - 1, 1) AS pace FROM lineitem""")
def linear_bounds(spark, sf):
    a, b = times.linear_bounds(F.col("l_linenumber") - 1, F.lit(8), F.lit(64.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", a.alias("start"), b.alias("end"), times.seconds_per_word(F.lit(64.0), F.col("l_linenumber") - 1).alias("pace"))


@query("escaped_paths", r"""SELECT p_partkey, replace(replace(replace('C:\sub\' || p_name || '''s.ass', '\', '\\'), ':', '\:'), '''', '\''') AS path FROM part""")
def escaped_paths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.filter_path_escape(F.concat(F.lit("C:\\sub\\"), "p_name", F.lit("'s.ass"))).alias("path"))


@query("nested_fingerprints", """SELECT p_partkey, sha256('{"models":{"a":{"x":' || p_size || ',"z":null},"b":null},"name":' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"' || p_name || '"' END || '}') AS fingerprint FROM part""")
def nested_fingerprints(spark, sf):
    """Nulls stay, and names are sorted at every depth."""
    models = F.struct(F.lit(None).cast("string").alias("b"), F.struct(F.lit(None).cast("string").alias("z"), F.col("p_size").alias("x")).alias("a"))
    p = table(spark, sf, "part").withColumns({"models": models, "name": F.when(F.col("p_partkey") % 3 != 0, F.col("p_name"))})
    return p.select("p_partkey", identity.fingerprint(p, "models", "name").alias("fingerprint"))
