"""Readers for the files that recordings come with. All return DataFrames; broken files are rows to filter, not errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.text import file_suffix, last_json_object, url_without_query
from wordloom.functions.times import duration_tolerance, finite, frames_per_second
from wordloom.operators.transcripts import chunk_sources

ITEM = "struct<text:string,start:double,end:double>"
LAYOUT = (
    "struct<sentence_index:bigint,words:array<struct<x:double,y:double,width:double,height:double,textX:double,textY:double,"
    "textWidth:double,textHeight:double,fontSize:double,fontWeight:string,text:string>>>"
)


def stem(path="path"):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256, suffix) of local sources."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), file_suffix(F.col("path")).alias("suffix"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """(folder, files, size_bytes) of media_files, by the folder that holds them."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))


#: What a media probe prints, as far as it is read.
PROBE = (
    "struct<format:struct<duration:string>,streams:array<struct<codec_type:string,codec_name:string,duration:string,"
    "sample_rate:string,channels:string,width:string,height:string,avg_frame_rate:string>>>"
)


def parsed_probes(probes: DataFrame, text: str = "probe") -> DataFrame:
    """Adds `p` (PROBE), and the streams by kind, to rows with the JSON of a media probe; null where it can't be read."""
    parsed = probes.withColumn("p", F.from_json(text, PROBE, {"mode": "PERMISSIVE"}))
    streams = F.coalesce("p.streams", F.array().cast("array<struct<codec_type:string,codec_name:string,duration:string,sample_rate:string,channels:string,width:string,height:string,avg_frame_rate:string>>"))
    return parsed.withColumns({"audios": F.filter(streams, lambda x: x["codec_type"] == "audio"), "videos": F.filter(streams, lambda x: x["codec_type"] == "video")})


def audio_probes(probes: DataFrame, text: str = "probe") -> DataFrame:
    """Rows with duration_seconds, codec, sample_rate, channels and problem (S6): of the first audio stream, the duration of
    the whole if it is told. A source without one, or without a finite duration above 0, has a problem instead."""
    first = F.try_element_at("audios", F.lit(1))
    rows = parsed_probes(probes, text).withColumn("first", first)
    raw = F.coalesce(F.nullif("p.format.duration", F.lit("")), F.nullif("first.duration", F.lit("")))
    rows = rows.withColumn("duration_seconds", finite(raw))
    problem = F.when(F.size("audios") == 0, "no audio stream").when(F.coalesce(F.col("duration_seconds") <= 0, F.lit(True)), "no duration")
    rows = rows.withColumns({"codec": F.col("first.codec_name"), "sample_rate": F.col("first.sample_rate").try_cast("int"), "channels": F.col("first.channels").try_cast("int"), "problem": problem})
    return rows.withColumn("duration_seconds", F.when(F.col("problem").isNull(), F.col("duration_seconds"))).drop("p", "audios", "videos", "first")


def video_problems(probes: DataFrame, width: int, height: int, fps: float, expected: str, require_audio: bool = True, text: str = "probe") -> DataFrame:
    """Rows with `problem` (P14), the first of the rules that a rendered video breaks, null if it breaks none; `expected`
    names the column with the duration it should have."""
    rows = parsed_probes(probes, text).withColumns({"v": F.try_element_at("videos", F.lit(1)), "a": F.try_element_at("audios", F.lit(1))})
    duration = finite(F.coalesce(F.nullif("p.format.duration", F.lit("")), F.nullif("v.duration", F.lit(""))))
    rate, wanted = frames_per_second(F.coalesce("v.avg_frame_rate", F.lit("0/1"))), finite(F.col(expected))
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    rules = [
        ("streams", (F.size("videos") != 1) | (F.size("audios") != int(require_audio))),
        ("video codec", ~F.col("v.codec_name").eqNullSafe("h264")),
        ("dimensions", (number("v.width") != width) | (number("v.height") != height)),
        ("frame rate", F.abs(rate - fps) > 0.02),
        ("audio codec", F.lit(require_audio) & ~F.col("a.codec_name").eqNullSafe("aac")),
        ("sample rate", F.lit(require_audio) & (number("a.sample_rate") != 48000)),
        ("duration", ~F.coalesce((duration > 0) & (wanted > 0) & (F.abs(duration - wanted) <= duration_tolerance(wanted)), F.lit(False))),
    ]
    problem = F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules])
    return rows.withColumn("problem", problem).drop("p", "audios", "videos", "v", "a")


#: What a downloader tells of a page, as far as it is read.
PAGE = "struct<_type:string,entries:array<string>,is_live:boolean,live_status:string,availability:string,id:string,title:string,channel_id:string>"


def page_metadata(pages: DataFrame, output: str = "output", url: str = "url") -> DataFrame:
    """Rows with what may be kept of a downloader's output (S4, S5): kind, host, video_id, title, source_page, channel_id, and
    `problem` for playlists, live or upcoming pages, and pages that need a login."""
    rows = pages.withColumn("m", F.from_json(last_json_object(F.col(output)), PAGE))
    listed = F.coalesce(F.col("m._type").isin("playlist", "multi_video"), F.lit(False)) | (F.coalesce(F.size("m.entries"), F.lit(0)) > 0)
    live = F.coalesce(F.col("m.is_live"), F.lit(False)) | F.coalesce(F.col("m.live_status").isin("is_live", "is_upcoming"), F.lit(False))
    closed = F.coalesce(F.col("m.availability").isin("private", "subscriber_only", "needs_auth"), F.lit(False))
    problem = F.when(F.col("m").isNull(), "no metadata").when(listed, "playlist").when(live, "live").when(closed, "login")
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    rows = rows.withColumns({
        "kind": F.lit("youtube"), "host": F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), "video_id": F.coalesce("m.id", F.lit("")),
        "title": F.coalesce(some(F.col("m.title")), some(F.col("m.id")), F.lit("youtube-video")), "source_page": url_without_query(F.col(url)), "channel_id": some(F.col("m.channel_id")), "problem": problem,
    })
    return rows.drop("m")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): a document per text file, named by its stem."""
    return spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_index, file, text) of a folder of chunk_*.txt, in order."""
    return chunk_sources(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def _json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("doc_id"), "value")
    return text.select("doc_id", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"))


def speech_regions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, end) of {"regions": [[start, end], ...]} files."""
    regions = _json_documents(spark, path, "struct<regions:array<array<double>>>").select("doc_id", F.explode("j.regions").alias("r"))
    return regions.filter(F.size("r") == 2).select("doc_id", F.col("r")[0].alias("start"), F.col("r")[1].alias("end"))


def stt_windows(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, window_index, start, end, text, ok, reasons) of {"windows": {"0": {...}}} files (S11, D6), by number."""
    entry = "struct<start:double,end:double,text:string,quality:struct<ok:boolean,reasons:array<string>>>"
    w = _json_documents(spark, path, f"struct<windows:map<string,{entry}>>").select("doc_id", F.explode("j.windows").alias("k", "w"))
    out = w.select("doc_id", F.col("k").try_cast("bigint").alias("window_index"), "w.start", "w.end", "w.text", F.col("w.quality.ok").alias("ok"), F.col("w.quality.reasons").alias("reasons"))
    return out.filter("window_index is not null")


def observed_words(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, index, text, start, end) of {"items": [{text, start, end}]} files."""
    items = _json_documents(spark, path, f"struct<items:array<{ITEM}>>").select("doc_id", F.posexplode("j.items").alias("index", "i"))
    return items.select("doc_id", F.col("index").cast("bigint").alias("index"), "i.text", "i.start", "i.end")


def valid_prefix(lines: DataFrame, schema: str, key: str = "path", order: str = "line", text: str = "value") -> DataFrame:
    """Parsed JSON lines up to the first that isn't whole (S12): a write cut short leaves a usable beginning."""
    parsed = lines.withColumn("j", F.from_json(text, schema)).withColumn("bad", F.try_parse_json(text).isNull())
    first_bad = F.min(F.when(F.col("bad"), F.col(order))).over(Window.partitionBy(key))
    return parsed.withColumn("first_bad", first_bad).filter(f"first_bad is null or {order} < first_bad").select(key, order, "j.*")


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line, sentence_index, words) of layout files, a JSON record a line (S12, D12). Files of one name in several
    folders stay apart."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return valid_prefix(whole.filter(F.trim("value") != ""), LAYOUT).select(stem().alias("doc_id"), "line", "sentence_index", "words")


def grid_words(spark: SparkSession, path: str) -> DataFrame:
    """(utterance_id, pos, start, end, label) of TextGrid files (S7, D11). Files of one name in several folders stay apart."""
    grids = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("utterance_id"), F.col("value").alias("text"))
    return parse_grids(grids).withColumn("utterance_id", stem("utterance_id"))


#: The interval tier of a TextGrid in the short form: the same values without their names, one a line.
SHORT_TIER = r'(?s)"IntervalTier"\s*"([^"]*)"\s*[-0-9.eE+]+\s+[-0-9.eE+]+\s+[0-9]+\s+(.*)'


def parse_grids(grids: DataFrame) -> DataFrame:
    """Intervals of the word tier of TextGrids (utterance_id, text): the tier named words, else the first whose name has
    word in it; blank labels go (S7). Long and short text format; quotes in labels are doubled."""
    long_form = F.col("text").rlike(r"item\s*\[\d*\]\s*:")
    cut = F.when(long_form, F.split("text", r"item\s*\[\d+\]\s*:")).otherwise(F.split("text", r'(?="IntervalTier")|(?="TextTier")'))
    tiers = grids.select("utterance_id", long_form.alias("long"), F.posexplode(cut).alias("tier", "body")).filter("tier > 0")
    name = F.lower(F.when(F.col("long"), F.regexp_extract("body", r'name\s*=\s*"([^"]*)"', 1)).otherwise(F.regexp_extract("body", SHORT_TIER, 1)))
    wanted = tiers.withColumn("rank", F.when(name == "words", 0).when(name.contains("word"), 1)).filter("rank is not null")
    chosen = wanted.groupBy("utterance_id").agg(F.min_by(F.struct("body", "long"), F.struct("rank", "tier")).alias("c")).select("utterance_id", "c.*")
    named = r'xmin\s*=\s*([-0-9.eE+]+)\s*xmax\s*=\s*([-0-9.eE+]+)\s*text\s*=\s*"((?:[^"]|"")*)"'
    bare = r'([-0-9.eE+]+)\s+([-0-9.eE+]+)\s+"((?:[^"]|"")*)"'

    def part(k: int):
        return F.when(F.col("long"), F.regexp_extract_all("body", F.lit(named), F.lit(k))).otherwise(F.regexp_extract_all(F.regexp_extract("body", SHORT_TIER, 2), F.lit(bare), F.lit(k)))

    rows = chosen.select("utterance_id", F.explode(F.arrays_zip(*[part(k).alias(c) for k, c in zip((1, 2, 3), "abc", strict=True)])).alias("i"))
    rows = rows.select("utterance_id", F.col("i.a").try_cast("double").alias("start"), F.col("i.b").try_cast("double").alias("end"), F.trim(F.replace("i.c", F.lit('""'), F.lit('"'))).alias("label")).filter("label <> ''")
    order = Window.partitionBy("utterance_id").orderBy("start", "end")
    return rows.withColumn("pos", F.row_number().over(order) - 1)
