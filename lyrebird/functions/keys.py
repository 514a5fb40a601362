"""Hashes, ids, urls and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyrebird.schemas import GUEST, PRIMARY


def cache_key(query: Column, ids: Column, model: Column) -> Column:
    """SHA-256 of the query, its sorted ids and the model."""
    return F.sha2(F.concat(query, F.array_join(F.array_sort(ids), ","), model), 256)


def chunk_hash(source: Column, start: Column, end: Column, text: Column) -> Column:
    """The first 16 hex digits of SHA-256 of source:start:end:text; times with three decimals."""
    return F.substring(F.sha2(F.concat_ws(":", source, F.format_string("%.3f", start), F.format_string("%.3f", end), text), 256), 1, 16)


def content_hash(media_id: Column, published: Column | None = None, audio_md5: Column | None = None) -> Column:
    """MD5 of the id and of whichever of date and audio hash are there."""
    parts = [media_id]
    if published is not None:
        parts.append(F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss"))
    if audio_md5 is not None:
        parts.append(audio_md5)
    return F.md5(F.concat_ws("", *parts))


def video_id(url: Column) -> Column:
    """The 11-character id after v=, /embed/, /v/, /shorts/, youtu.be/ or as the whole text; null if there is none."""
    got = F.regexp_extract(url, r"(?:[?&]v=|/embed/|/v/|/shorts/|youtu\.be/|^)([A-Za-z0-9_-]{11})(?:[&?#/].*)?$", 1)
    return F.when(got != "", got)


def video_id_of_file(name: Column) -> Column:
    """The first 11-character token of a path's file name, else its stem."""
    name = F.substring_index(name, "/", -1)
    token = F.regexp_extract(name, r"(?:^|[^A-Za-z0-9_-])([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)", 1)
    return F.when(token != "", token).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def deep_link(url: Column, start: Column, source_type: Column) -> Column:
    """The url with &t=<seconds>s for a youtube start other than 0."""
    return F.when((source_type == "youtube") & (start != 0), F.concat(url, F.lit("&t="), F.floor(start).cast("long").cast("string"), F.lit("s"))).otherwise(url)


def base_url(url: Column) -> Column:
    return F.substring_index(url, "&t=", 1)


def normal_label(label: Column, default: str = GUEST, primary: tuple[str, ...] = ("CH", "HOST")) -> Column:
    """Speaker labels under their one name; null or empty becomes the default. ``primary``: the primary speaker's other names, in upper case."""
    up = F.upper(F.trim(label))
    return F.when(up.isin(*primary, PRIMARY.upper()), PRIMARY).when(up.isin("G1", "G2", "GUEST"), GUEST).when(label.isNull() | (up == ""), default).otherwise(label)


def repaired_source_type(source_type: Column, url: Column, source_id: Column) -> Column:
    """A known type becomes youtube or zoom, zoom last, where id or url say so; null and empty become youtube."""
    says = lambda name, part: F.coalesce(F.contains(source_id, F.lit(name)), F.lit(False)) | F.coalesce(F.contains(url, F.lit(part)), F.lit(False))
    return F.when(source_type.isNull(), "youtube").when(says("zoom", "zoom"), "zoom").when(says("youtube", "youtube.com") | (source_type == ""), "youtube").otherwise(source_type)


def provenance_of(method: Column) -> Column:
    """Provenance of a transcript by its method; whisper where unknown."""
    return F.when(method.isin("youtube", "yt_caption", "captions"), "yt_caption").when(method == "yt_dlp", "yt_dlp").when(method.isin("owner", "manual"), "owner").otherwise("whisper")


def pair_digest(*columns: str) -> Column:
    """256 bits of several columns together, null being a value of its own: short to shuffle where the columns are long texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.sha2(F.col(c).cast("string"), 256)), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws("|", *parts), 256))
