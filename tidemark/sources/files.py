"""Files as tables: discovery, registration by content hash, probe documents, transcripts and recorded replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numbers import clamp, rounded

# File name suffixes by kind.
VIDEO = "mp4 mov mkv m4v avi webm mts m2ts ts mxf mpg mpeg 3gp 3g2 ogv".split()
AUDIO = "wav mp3 m4a aac flac ogg oga opus aif aiff caf".split()
IMAGE = "jpg jpeg png webp heic heif avif tif tiff".split()

PROBE = "streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,avg_frame_rate:string,channels:int,sample_rate:string,tags:map<string,string>>>, format struct<format_name:string,duration:string,tags:map<string,string>>"
TRANSCRIPT = "segments array<struct<start:double,end:double,text:string,avg_logprob:double,words:array<struct<start:double,end:double,word:string>>>>"
REPLAY = (
    "transcribe struct<model:string,language:string,utterances:array<struct<start_ms:bigint,end_ms:bigint,text:string,speaker_id:string,confidence:double>>>,"
    "detect_shots struct<model:string,shots:array<struct<start_ms:bigint,end_ms:bigint,representative_frame_ms:bigint,change_score:double>>>,"
    "analyze_audio struct<model:string,hop_ms:int,rms_db:array<double>,events:array<struct<start_ms:bigint,end_ms:bigint,event_type:string,raw_label:string,confidence:double>>>,"
    "ocr struct<model:string,observations:array<struct<start_ms:bigint,end_ms:bigint,text:string,confidence:double>>>,"
    "embed_frames struct<model:string,dim:int,frames:array<struct<timestamp_ms:bigint,vector:array<double>,labels:array<string>>>>"
)


def kind_of(name: Column) -> Column:
    """Video, audio or image by a file name's suffix; null for others and for names that begin with a dot."""
    suffix = F.lower(F.regexp_extract(name, r"(?:^|/)[^/.][^/]*\.([^./]+)$", 1))
    return F.when(suffix.isin(VIDEO), "video").when(suffix.isin(AUDIO), "audio").when(suffix.isin(IMAGE), "image")


def discovered(spark: SparkSession, path: str) -> DataFrame:
    """Media files below a folder, with size, time of change and kind; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), kind_of(F.col("path")).alias("kind")).where("kind is not null")


def registered(known: DataFrame, found: DataFrame, digest: str = "sha256", order: str = "path") -> DataFrame:
    """Rows of ``found`` whose digest isn't known yet, one of each digest (the first by ``order``). Null digests stay out."""
    first = Window.partitionBy(digest).orderBy(order)
    new = found.where(F.col(digest).isNotNull()).join(known.select(digest).distinct(), digest, "left_anti")
    return new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").select(*found.columns)


def rate(text: Column) -> Column:
    """Frames a second of a fraction such as 30000/1001."""
    return F.try_divide(F.substring_index(text, "/", 1).try_cast("double"), F.substring_index(text, "/", -1).try_cast("double"))


def probed(frame: DataFrame, column: str = "probe") -> DataFrame:
    """Facts of a probe document in JSON: ``duration_ms``, ``width``, ``height``, ``fps``, ``variable``, ``channels``, ``kind`` and
    ``created``. A document that can't be read gives nulls."""
    p = F.from_json(F.col(column), PROBE)
    streams = F.coalesce(p["streams"], F.array())
    first = lambda kind: F.get(F.filter(streams, lambda s: s["codec_type"] == kind), 0)
    video, audio = first("video"), first("audio")
    declared, measured = F.least(rate(video["r_frame_rate"]), F.lit(240.0)), rate(video["avg_frame_rate"])
    return frame.withColumns({
        "duration_ms": F.floor(p["format"]["duration"].try_cast("double") * 1000 + 0.5),
        "width": video["width"], "height": video["height"], "fps": rounded(declared, 3),
        "variable": F.coalesce(F.abs(measured - declared) / declared > 0.01, F.lit(False)),
        "channels": audio["channels"],
        "kind": F.when(video.isNotNull(), "video").when(audio.isNotNull(), "audio"),
        "created": F.coalesce(p["format"]["tags"]["creation_time"], video["tags"]["creation_time"]),
    })


def utterances(frame: DataFrame, by: list[str], column: str = "transcript", gap_ms: int = 2000) -> DataFrame:
    """Utterances of transcripts in JSON: segments are split where two words lie more than ``gap_ms`` apart; a segment
    without words stays whole. Confidence is 1 + the mean log probability, between 0 and 1."""
    segments = frame.select(*by, F.posexplode(F.from_json(F.col(column), TRANSCRIPT)["segments"]).alias("segment", "s"))
    ms = lambda c: F.floor(c * 1000 + 0.5)
    whole = F.array(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("word")))
    words = segments.select(*by, "segment", F.col("s.avg_logprob").alias("p"), F.posexplode(F.when(F.size("s.words") > 0, F.col("s.words")).otherwise(whole)).alias("i", "w"))
    timed = words.select(*by, "segment", "p", "i", ms(F.col("w.start")).alias("start"), ms(F.col("w.end")).alias("end"), F.trim("w.word").alias("word"))
    w = Window.partitionBy(*by, "segment").orderBy("i")
    new = F.coalesce(F.col("start") - F.lag("end").over(w) > gap_ms, F.lit(True))
    part = timed.withColumn("_new", new.cast("int")).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
    out = part.groupBy(*by, "segment", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), text.alias("text"), F.first("p").alias("p"))
    return out.select(*by, "start", "end", "text", F.coalesce(rounded(clamp(1 + F.col("p"))), F.lit(0.5)).alias("confidence"))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Recorded observations, one row per asset: ``asset`` (file name) and the outputs of each observer. The bundle is a
    JSON document per file; malformed ones give a row with nulls."""
    whole = spark.read.text(path, wholetext=True)
    assets = F.from_json("value", f"assets map<string,struct<{REPLAY.replace(' struct', ':struct')}>>")["assets"]
    return whole.select(F.explode_outer(assets).alias("asset", "o")).select("asset", "o.*")
