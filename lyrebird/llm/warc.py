"""Content-addressed WARC archive: payload bytes once per verified SHA-256, exact record headers beside them.

Two tables in the shared folder make the archive: ``payloads`` (sha256, payload) and ``records`` (one exact header
block per page, with the SHA-256 of its payload). A record is rebuilt by joining them; what is read back
is parsed from the rebuilt bytes, and digest and length are recomputed from its payload and compared with its header.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is a response, the
others revisit it; smaller payloads make responses only. All DataFrame functions.

Defined results: a null payload is empty; a null url leaves out its header; line breaks in a url are percent-encoded in
the header; a null page_id ranks lowest; of repeated rows with one page_id one is the response; extra columns are
ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.common import join_dealt, materialize

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line, or null where the value is null."""
    return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))


def _record_id(page_id: Column, uid: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit("page"), page_id.cast("string"), uid.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *(p for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for p in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]), F.lit(">"))


def write_archive(pages: DataFrame, payload: str = "html", least: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Write the archive of ``pages`` (page_id, url, payload column); returns its tables (records, payloads)."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    hashed = src.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    payloads = materialize(hashed.select("sha256", "payload").dropDuplicates(["sha256"]), "payloads")
    rows = materialize(hashed.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"), F.monotonically_increasing_id().alias("uid")), "captures")
    winner = rows.filter(F.col("n") >= least).groupBy("sha256").agg(F.max(F.struct("page_id", "uid")).alias("w"))
    rows = join_dealt(rows, winner, "sha256", "left")
    revisit = F.col("w").isNotNull() & (F.col("w.uid") != F.col("uid"))
    clean = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("uid"))),
        _line("WARC-Date", F.lit(DATE)),
        F.coalesce(_line("WARC-Target-URI", clean), F.lit("")),
        F.coalesce(_line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(REVISIT)), _line("WARC-Refers-To", _record_id(F.col("w.page_id"), F.col("w.uid"))), F.coalesce(_line("X-Refers-To-Page-Id", F.col("w.page_id").cast("string")), F.lit("")))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("n")).cast("string")),
        F.lit(EOL),
    )
    records = materialize(rows.select("sha256", revisit.alias("revisit"), header.cast("binary").alias("header")), "records")
    return records, payloads


def rebuild(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """The archive's records: sha256, revisit and ``record``, the exact bytes (header, payload, two line ends)."""
    end = F.lit(EOL * 2).cast("binary")
    full = records.filter("not revisit")
    # only payloads too short for revisits have many responses
    whole = join_dealt(full, payloads, "sha256").select("sha256", "revisit", F.concat("header", "payload", end).alias("record"))
    return whole.unionByName(records.filter("revisit").select("sha256", "revisit", F.concat("header", end).alias("record")))


def _field(header: Column, name: str) -> Column:
    got = F.regexp_extract(header, f"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(got != "", got)


def parse(built: DataFrame) -> DataFrame:
    """What each rebuilt record says; payload_bytes and payload_digest are recomputed from its bytes, and must agree with its header."""
    # one byte is one character in ISO-8859-1; only the head is decoded
    head = F.decode(F.substring("record", 1, 4096), "ISO-8859-1")
    cut = F.instr(head, EOL * 2)
    full = F.when(cut > 0, F.substring_index(head, EOL * 2, 1)).otherwise(F.substring_index(F.decode("record", "ISO-8859-1"), EOL * 2, 1))
    header = F.concat(full, F.lit(EOL))
    parsed = built.select("sha256", "revisit", header.alias("h"), F.expr("substring(record, octet_length(record) - 3)").alias("tail"), F.col("record"))
    length = _field(F.col("h"), "Content-Length").cast("int")
    parsed = parsed.select("sha256", "revisit", "h", "tail", length.alias("length"), F.expr("substring(record, length(h) + 3, octet_length(record) - length(h) - 6)").alias("payload"))
    out = parsed.select(
        "sha256",
        "revisit",
        _field(F.col("h"), "X-Page-Id").cast("long").alias("page_id"),
        _field(F.col("h"), "WARC-Type").alias("record_type"),
        F.substring_index(_field(F.col("h"), "WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        _field(F.col("h"), "X-Refers-To-Page-Id").cast("long").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "length",
        F.when(~F.col("revisit"), F.sha1("payload")).alias("sha1"),
        F.when(~F.col("revisit"), F.unhex(F.sha2("payload", 256)) == F.col("sha256")).alias("verified"),
    )
    bad = (F.col("length") != F.col("payload_bytes")) | (~F.col("revisit") & ((F.col("sha1") != F.col("payload_digest")) | ~F.col("verified")))
    return out.withColumn("payload_digest", F.when(bad, F.raise_error(F.lit("a record read back differs from what was written"))).otherwise(F.col("payload_digest"))).drop("length", "sha1", "verified")


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (of the full payload), record_type and refers_to of every record, from rebuilt bytes."""
    got = materialize(parse(rebuild(records, payloads)), "read_back")
    sizes = got.filter("not revisit").groupBy("sha256").agg(F.first("payload_bytes").alias("full"), F.first("payload_digest").alias("digest"))
    again = join_dealt(got.filter("revisit"), sizes, "sha256").select("page_id", F.col("full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    return got.filter("not revisit").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(again)
