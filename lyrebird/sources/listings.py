"""Readers of media listings: JSON lines, landed API pages, url lists, local files, meetings, profiles, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.functions.keys import video_id
from lyrebird.functions.quality import members_only
from lyrebird.functions.time import iso_duration
from lyrebird.operators.bounds import broadcast_if_small

LISTING = (
    "id string, title string, upload_date string, duration string, view_count long, like_count long, comment_count long, channel string, channel_url string, "
    "thumbnail string, thumbnails array<struct<url:string>>, webpage_url string, url string, description string, availability string, tags array<string>, _corrupt string"
)
API_PAGE = "items array<struct<id:string,snippet:struct<title:string,publishedAt:timestamp,description:string,liveBroadcastContent:string>,contentDetails:struct<duration:string>,statistics:struct<viewCount:string>,liveStreamingDetails:struct<actualStartTime:timestamp,actualEndTime:timestamp,scheduledStartTime:timestamp>>>"
MEETINGS = "id string, topic string, start_time timestamp, duration int, recording_files array<struct<file_type:string,recording_type:string,download_url:string,text:string>>"
MEDIA_SUFFIXES = ("mp3", "mp4", "m4a", "wav", "webm", "mkv", "mov", "avi", "flac", "ogg")


def normal_listing(raw: DataFrame) -> DataFrame:
    """Listing rows under the engine's names; rows without id or title, and lines that aren't JSON, go."""
    ok = raw.filter(F.col("id").isNotNull() & F.col("title").isNotNull())
    return ok.select(
        F.col("id").alias("video_id"),
        "title",
        F.try_to_timestamp("upload_date", F.lit("yyyyMMdd")).alias("published_at"),
        F.col("duration").try_cast("double").cast("int").alias("duration_s"),
        "view_count",
        "like_count",
        "comment_count",
        F.col("channel").alias("channel_name"),
        "channel_url",
        F.coalesce("thumbnail", F.try_element_at("thumbnails", F.lit(-1))["url"]).alias("thumbnail"),
        F.coalesce("webpage_url", F.when(F.col("url").startswith("http"), F.col("url")), F.concat(F.lit("https://www.youtube.com/watch?v="), "id")).alias("url"),
        "description",
        "tags",
        members_only(F.col("availability"), F.col("title")).alias("members_only"),
    )


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; blank and broken lines are skipped. A file that isn't UTF-8 throughout is read as Latin-1, all of it.

    Files are split at line ends over tasks, however large they are; whether a file is UTF-8 is found out first, file by file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    odd = lines.filter(~F.is_valid_utf8("value")).select("file").distinct().withColumn("odd", F.lit(True))
    known = lines.join(broadcast_if_small(odd), "file", "left")
    decoded = known.select(F.when(F.col("odd"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value")).alias("value"))
    rows = decoded.filter(F.trim("value") != "").select(F.from_json("value", LISTING, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return normal_listing(rows.select("r.*"))


def api_videos(pages: DataFrame, since: Column | None = None, live: bool = False, upcoming: bool = False) -> DataFrame:
    """Videos of landed API pages: live has started and not ended, upcoming is scheduled and not started."""
    v = pages.select(F.explode("items").alias("i")).select("i.*")
    d = F.col("liveStreamingDetails")
    rows = v.select(
        F.col("id").alias("video_id"),
        F.col("snippet.title").alias("title"),
        F.col("snippet.publishedAt").alias("published_at"),
        iso_duration(F.col("contentDetails.duration")).alias("duration_s"),
        F.col("statistics.viewCount").try_cast("long").alias("view_count"),
        F.coalesce(d["actualStartTime"].isNotNull() & d["actualEndTime"].isNull(), F.lit(False)).alias("is_live"),
        F.coalesce(d["scheduledStartTime"].isNotNull() & d["actualStartTime"].isNull(), F.lit(False)).alias("is_upcoming"),
        members_only(F.lit(None).cast("string"), F.concat_ws(" ", F.col("snippet.title"), F.col("snippet.description"))).alias("members_only"),
    )
    rows = rows.filter(F.lit(live) | ~F.col("is_live")).filter(F.lit(upcoming) | ~F.col("is_upcoming"))
    return rows if since is None else rows.filter(F.col("published_at") >= since)


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct video ids of a list of urls; comments and blank lines are skipped."""
    ok = lines.filter(~F.col(column).rlike(r"^\s*(#|$)"))
    return ok.select(video_id(F.trim(F.col(column))).alias("video_id")).filter("video_id is not null").distinct()


def local_media(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Media files below a folder, newest first: id from the path's MD5; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    out = files.filter(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*MEDIA_SUFFIXES)).select(F.concat(F.lit("local_"), F.substring(F.md5("path"), 1, 11)).alias("video_id"), "path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"))
    return out if limit is None else out.orderBy(F.desc("modified_at"), "path").limit(limit)


def meetings(raw: DataFrame) -> DataFrame:
    """Meetings with their first transcript file."""
    first = F.get(F.filter("recording_files", lambda f: f["file_type"].isin("TRANSCRIPT", "VTT") | (f["recording_type"] == "audio_transcript")), F.lit(0))
    return raw.select(F.col("id").alias("source_id"), F.col("topic").alias("title"), F.col("start_time").alias("published_at"), (F.col("duration") * 60).alias("duration_s"), first["download_url"].alias("transcript_url"), first["text"].alias("value")).filter("transcript_url is not null or value is not null")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Voice profiles, one JSON file each. A folder without profiles is an error: none is ever made up."""
    out = spark.read.option("multiLine", "true").schema("name string, embeddings array<array<double>>, centroid array<double>, threshold double, metadata map<string,string>").json(path)
    if out.limit(1).count() == 0:
        raise FileNotFoundError(f"no voice profile in {path}")
    return out


def seed_hash(urls: Column) -> Column:
    """MD5 of a seed list's sorted urls, as JSON with a blank after each comma."""
    return F.md5(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(urls), lambda u: F.concat(F.lit('"'), u, F.lit('"'))), ", "), F.lit("]")))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Urls and hash of a seed file, a JSON object with ``sources``, a list that isn't empty and whose entries have a url; anything else is an error."""
    raw = spark.read.option("multiLine", "true").schema("sources array<struct<url:string>>, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    row = raw.limit(1).collect()  # one small file
    if not row or row[0]["_corrupt"] is not None or not row[0]["sources"]:
        raise ValueError(f"{path} has no list 'sources' that holds something")
    missing = [i for i, s in enumerate(row[0]["sources"]) if s is None or s["url"] is None]
    if missing:
        raise ValueError(f"source {missing[0]} of {path} has no 'url'")
    urls = F.col("sources.url")
    return raw.select(urls.alias("urls"), seed_hash(urls).alias("seed_hash"))
