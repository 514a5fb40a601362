"""The engine's functions under names of the session's catalogue, for users of SQL.

Scalar functions and ``word_blocks`` are SQL functions: Catalyst inlines their bodies, so they cost what the expression costs. ``cues`` walks a
subtitle file's lines, ``duration_chunks`` an ordered partition; both are Python table functions that hold one cue or one chunk at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.udtf import UserDefinedTableFunction
from pyspark.sql import functions as F


#: name(parameters) -> (type, body). Null arguments follow the DataFrame forms of the same names.
SCALARS: dict[str, tuple[str, str]] = {
    "video_id(url STRING)": ("STRING", r"nullif(regexp_extract(url, r'(?:[?&]v=|/embed/|/v/|/shorts/|youtu\.be/|^)([A-Za-z0-9_-]{11})(?:[&?#/].*)?$', 1), '')"),
    "base_url(url STRING)": ("STRING", "substring_index(url, '&t=', 1)"),
    "deep_link(url STRING, start DOUBLE, source_type STRING)": ("STRING", "CASE WHEN source_type = 'youtube' AND start <> 0 THEN concat(url, '&t=', CAST(floor(start) AS STRING), 's') ELSE url END"),
    "m_ss(seconds DOUBLE)": ("STRING", "concat(CAST(floor(floor(seconds) / 60) AS STRING), ':', lpad(CAST(floor(seconds) % 60 AS STRING), 2, '0'))"),
    "parse_m_ss(t STRING)": ("BIGINT", r"CASE WHEN t RLIKE r'^(\d+):(\d{1,2})$' THEN try_cast(split_part(t, ':', 1) AS BIGINT) * 60 + try_cast(split_part(t, ':', 2) AS BIGINT) END"),
    "cue_time(seconds DOUBLE, mark STRING)": (
        "STRING",
        "concat(CASE WHEN seconds < 360000 THEN lpad(CAST(floor(floor(seconds * 1000 + 1e-6) / 3600000) AS STRING), 2, '0') ELSE CAST(floor(floor(seconds * 1000 + 1e-6) / 3600000) AS STRING) END, ':',"
        " lpad(CAST(floor(floor(seconds * 1000 + 1e-6) / 60000) % 60 AS STRING), 2, '0'), ':', lpad(CAST(floor(floor(seconds * 1000 + 1e-6) / 1000) % 60 AS STRING), 2, '0'), mark, lpad(CAST(floor(seconds * 1000 + 1e-6) % 1000 AS STRING), 3, '0'))",
    ),
    "parse_cue_time(t STRING)": (
        "DOUBLE",
        r"CASE WHEN t RLIKE r'^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})\s*$' THEN coalesce(try_cast(regexp_extract(t, r'^\s*(\d+):\d+:\d+[.,]', 1) AS DOUBLE), 0D) * 3600"
        r" + CAST(regexp_extract(t, r'(\d+):\d+[.,]', 1) AS DOUBLE) * 60 + CAST(regexp_extract(t, r'(\d+)[.,]', 1) AS DOUBLE) + CAST(rpad(regexp_extract(t, r'[.,](\d+)', 1), 3, '0') AS DOUBLE) / 1000 END",
    ),
    "word_count(t STRING)": ("INT", r"size(filter(split(t, r'\s+'), w -> w <> ''))"),
    "token_estimate(t STRING)": ("BIGINT", r"CAST(floor(size(filter(split(t, r'\s+'), w -> w <> '')) * 1.33D) AS BIGINT)"),
    "clean_segment(t STRING)": (
        "STRING",
        r"CASE WHEN length(trim(regexp_replace(t, r'\s+', ' '))) > 20 AND NOT trim(regexp_replace(t, r'\s+', ' ')) RLIKE r'[.!?:]$' THEN concat(trim(regexp_replace(t, r'\s+', ' ')), '.') ELSE trim(regexp_replace(t, r'\s+', ' ')) END",
    ),
    "chunk_hash(source STRING, start DOUBLE, stop DOUBLE, t STRING)": ("STRING", "substring(sha2(concat_ws(':', source, format_string('%.3f', start), format_string('%.3f', stop), t), 256), 1, 16)"),
}

TABLES: dict[str, tuple[str, str]] = {
    "word_blocks(t STRING, n INT)": (
        "block INT, text STRING",
        r"SELECT pos, col FROM (SELECT posexplode(flatten(transform(array(filter(split(t, r'\s+'), x -> x <> '')), w -> transform(filter(sequence(0, greatest(size(w) - 1, 0), n), i -> i < size(w)), i -> array_join(slice(w, i + 1, n), ' '))))))",
    ),
}

_TIMES = re.compile(r"([0-9:.,]+)\s*-->\s*([0-9:.,]+)")
_TIME = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})")


def _seconds(t: str) -> float | None:
    m = _TIME.fullmatch(t)
    return m and int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3]) + int(m[4].ljust(3, "0")) / 1000


class Cues:
    """The cues of one SRT or VTT text by a walk over its lines: a line of times opens one, a blank line closes it, and what comes between is its text.

    Numbers and headings before a line of times are left out, as are cues without text or with times that can't be read. Null gives none.
    """

    def eval(self, value: str | None) -> Iterator[tuple[int, float, float, str]]:
        n, times, lines = 0, None, []
        for line in [*re.split(r"\r\n?|\n", value or ""), ""]:
            if line.strip():
                if times is None:
                    found = _TIMES.search(line)
                    times = found and (_seconds(found[1]), _seconds(found[2]))
                else:
                    lines.append(line)
                continue
            text = re.sub(r"<[^>]*>", "", " ".join(lines)).replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
            text = " ".join(text.split())
            if times and None not in times and text:
                yield n, *times, text
                n += 1
            times, lines = None, []


class DurationChunks:
    """Chunks of one item's segments (media_id, start_sec, end_sec, text), given as a table partitioned by the item and ordered by start: one ends
    where the next segment would carry it past ``seconds``. Blank and null texts are left out; a time of null ends nothing."""

    def __init__(self):
        self.n, self.chunk = 0, None

    def eval(self, row: Row, seconds: float) -> Iterator[tuple[Any, ...]]:
        text = (row["text"] or "").strip(" \t\n\x0b\f\r")
        if not text:
            return
        known = self.chunk and row["end_sec"] is not None and self.chunk["start"] is not None
        if known and row["end_sec"] - self.chunk["start"] > seconds:
            yield self._close()
        if not self.chunk:
            self.chunk = {"media_id": row["media_id"], "start": row["start_sec"], "texts": []}
        self.chunk["end"] = row["end_sec"]
        self.chunk["texts"].append(text)

    def _close(self) -> tuple[Any, ...]:
        c, self.chunk, self.n = self.chunk, None, self.n + 1
        return c["media_id"], self.n - 1, c["start"], c["end"], len(c["texts"]), " ".join(c["texts"])

    def terminate(self) -> Iterator[tuple[Any, ...]]:
        if self.chunk:
            yield self._close()


def table_functions() -> dict[str, UserDefinedTableFunction]:
    return {
        "cues": F.udtf(Cues, returnType="seq: int, start_sec: double, end_sec: double, text: string"),
        "duration_chunks": F.udtf(DurationChunks, returnType="media_id: bigint, chunk_index: int, start_sec: double, end_sec: double, n_rows: bigint, text: string"),
    }


def register(spark: SparkSession) -> list[str]:
    """Put all functions into the session's catalogue, over earlier ones of their names; returns the names."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for head, (columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({columns}) RETURN {body}")
    for name, function in table_functions().items():
        spark.udtf.register(name, function)
    return sorted([h.split("(")[0] for h in (*SCALARS, *TABLES)] + list(table_functions()))
