"""Secret scan with corpus-wide ownership frequency.

A scan of every whole text finds candidates: the three base kinds (assign, access, hex), and two wider kinds,
token (vendor prefixes) and private key blocks (to the first END line if it comes before another BEGIN, else the BEGIN line). Each candidate's value is hashed, and the hashes are
aggregated over the corpus by distinct owners and distinct repositories. A value seen with many owners, or in very many
repositories of few owners, is a widely copied example; one that stays with few of both is a live-looking credential. Base spans are always
reported; a wider span is reported when its value looks live and no base span covers it.

Defined results: null or empty text has no candidates; repeated rows each give a row; a null owner or repository
counts as one more value of its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.common import fresh, materialize
from lyrebird.llm.rows import split_by_keys, text_key

# The base kinds' patterns and least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE_KINDS = ("assign", "access", "hex")
LEAST = {"assign": 8, "access": 16, "hex": 32}

# Public prefixes of vendors' credentials.
WIDE = re.compile(
    r"(?P<token>\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{16,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}))"
    r"|(?P<key>-----BEGIN [A-Z ]*PRIVATE KEY-----)"
)
# A signed web token is three runs of these characters, joined by dots; it starts at such a head in the first run.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)(?=(\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+))")
SIGNED_HEAD = re.compile(r"\beyJ")
SIGNED_LEAST = len("eyJ") + 8
#: Owners and repositories up to which a value looks live.
MAX_OWNERS, MAX_REPOS = 2, 1000

KINDS = (*BASE_KINDS, "token", "key")

_HEX_RUN = re.compile(r"[0-9a-f]{32,}")
#: Substrings without which a pattern can't match; looking for them is much cheaper.
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_WIDE_HINTS = ("gh", "glpat-", "xox", "sk-", "sk_live_", "AIza", "eyJ", "-----BEGIN ")

FOUND = "array<struct<kind:int,start:int,end:int,value:binary>>"


def _signed(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of possible signed tokens, by start. A run is read a few times, however many heads it holds."""
    if "eyJ" in text:
        for m in SIGNED.finditer(text):
            for head in SIGNED_HEAD.finditer(text, m.start(), m.end(1)):
                if m.end(1) - head.start() >= SIGNED_LEAST:
                    yield head.start(), m.end(2)


def _wide(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is a token) of the wider kinds, leftmost and without overlaps."""
    others, signed = WIDE.finditer(text), _signed(text)
    other, sign = next(others, None), next(signed, None)
    at = 0
    while other or sign:
        if sign and (not other or sign[0] < other.start()):
            if sign[0] >= at:
                at = sign[1]
                yield *sign, True
            sign = next(signed, None)
        elif other.start() >= at:
            at = other.end()
            yield other.start(), at, bool(other["token"])
            other = next(others, None)
        else:  # it starts inside a signed token: look again behind that
            others = WIDE.finditer(text, at)
            other = next(others, None)


def scan(text: str) -> list[tuple[int, int, int, bytes]]:
    """(kind number, start, end, 128-bit hash of the value) of all candidates, by start, then kind. Code points, end exclusive."""
    out = []

    def tell(kind: int, start: int, end: int, value: str) -> None:
        out.append((kind, start, end, hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()))

    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                tell(0, m.start(), m.end(), m[2])
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                tell(1, m.start(), m.end(), m[0])
    for m in _HEX_RUN.finditer(text):  # a run of 32 or more is a whole match of HEX: both are as long as they can be
        tell(2, m.start(), m.end(), m[0])
    if ("_" in text or "-" in text or "AIza" in text) and any(h in text for h in _WIDE_HINTS):
        close = stop = begin = 0  # of the next END line and the next BEGIN, or -1 if none is left: each is looked for once
        for start, end, token in _wide(text):
            if not token:
                if 0 <= close < end:
                    close = text.find("-----END ", end)
                    stop = text.find("-----", close + 9) if close >= 0 else -1
                if 0 <= begin < end:
                    begin = text.find("-----BEGIN ", end)
                end = stop + 5 if stop >= 0 and not 0 <= begin < close else end
            tell(3 if token else 4, start, end, text[start:end])
    return sorted(out, key=lambda x: (x[1], x[0]))


def find_candidates(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", repo_col: str | None = None, key: Column | None = None) -> DataFrame:
    """One row per document: its id, uid, owner, repo, ``key`` (a string; null where none is given) and candidates ``found``."""
    repo = F.col(repo_col) if repo_col else F.col(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())]))
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in scan(t)] if (t := text.as_py()) else [] for text in b.column(5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(found, kind)], ["doc_id", "uid", "owner", "repo", "key", "found"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(owner_col).cast("string").alias("owner"), repo.cast("string").alias("repo"), (F.lit(None).cast("string") if key is None else key).alias("key"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, f"doc_id long, uid long, owner string, repo string, key string, found {FOUND}")


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value: n_owners and n_repos. Distinct (value, owner, repo) first, then owners: a hot value is counted over many tasks."""
    seen = candidates.select(F.explode("found.value").alias("value"), F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo")).distinct()
    owners = seen.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("n_owners"))
    repos = seen.select("value", "repo").distinct().groupBy("value").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "value")


#: Rows of a value from which it is joined by broadcast, and the most such values.
HOT_ROWS, HOT_VALUES = 1000, 20_000


def _with_ownership(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """The rows (with ``value``) and their value's n_owners and n_repos. A value in very many repositories, as a widely copied
    example is, comes by broadcast, at most ``HOT_VALUES`` of them: its rows stay where they are."""
    owners = materialize(owners, "ownership")
    total = owners.agg(F.sum("n_repos")).first()[0] or 0
    often = F.col("n_repos") > max(HOT_ROWS, total // HOT_VALUES)
    hot = F.broadcast(owners.filter(often))
    return rows.join(hot, "value").unionByName(rows.join(hot, "value", "left_anti").join(owners.filter(~often), "value"))


def _live(max_owners: int, max_repos: int) -> Column:
    return (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)


def _joined(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_corpus(docs: DataFrame, max_owners: int = MAX_OWNERS, id_col: str = "doc_id", owner_col: str = "source", repo_col: str | None = None, max_repos: int = MAX_REPOS) -> DataFrame:
    """Per document: doc_id, uid, base and spans (arrays of start, kind, end, live, n_owners, n_repos) and n_live, n_example.

    A value with at most ``max_owners`` owners and ``max_repos`` repositories is live-looking, one with more of either a copied example.
    """
    found = materialize(find_candidates(docs, id_col, owner_col, repo_col), "candidates")
    some = found.filter(F.size("found") > 0)
    kept = some.select("uid", F.explode("found").alias("f")).select("uid", "f.kind", "f.start", "f.end", "f.value")
    judged = _with_ownership(kept, ownership(some)).withColumn("live", _live(max_owners, max_repos))
    span = F.struct("start", "kind", "end", "live", "n_owners", "n_repos")
    per_doc = judged.groupBy("uid").agg(F.sort_array(F.collect_list(span)).alias("all"))
    joined = found.select("doc_id", "uid").join(per_doc, "uid", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,n_owners:bigint,n_repos:bigint>>")))
    base = F.filter("all", lambda s: s["kind"] < 3)
    wide = lambda s: s["live"] & ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    return (
        joined.withColumn("base", base)
        .withColumn("spans", F.filter("all", lambda s: (s["kind"] < 3) | wide(s)))
        .withColumn("n_live", F.size(F.filter("spans", lambda s: s["live"])).cast("long"))
        .withColumn("n_example", F.size(F.filter("spans", lambda s: ~s["live"])).cast("long"))
        .drop("all")
    )


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_example."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_live", "n_example")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with each of the (start, end) spans, which may overlap, replaced by ``mark``."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_corpus(docs: DataFrame, max_owners: int = MAX_OWNERS, owner_col: str = "source", max_repos: int = MAX_REPOS) -> DataFrame:
    """The documents, all of them and with their own columns, with live-looking secrets replaced in ``text``.

    Rows meet the verdicts by the digest of their text: only rows whose text may hold a live value are joined and scanned again.
    """
    columns, place = docs.columns, docs.columns.index("text")
    found = materialize(find_candidates(docs, "doc_id", owner_col, key=text_key()), "candidates")
    some = found.filter(F.size("found") > 0)
    kept = some.select("key", F.explode("found.value").alias("value")).distinct()
    live = _with_ownership(kept, ownership(some)).filter(_live(max_owners, max_repos))
    per_text = materialize(live.groupBy("key").agg(F.collect_set("value").alias("live")), "live")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, values in zip(b.column(place), b.column(len(columns)), strict=True):
                t, live_values = text.as_py(), set(values.as_py() or ())
                texts.append(redact(t, [(s, e) for _, s, e, v in scan(t) if v in live_values]) if t and live_values else t)
            cols = list(b.columns[: len(columns)])
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, columns)

    rest, hits, name = split_by_keys(docs, text_key(), per_text.select("key"))
    if hits is None:
        return docs
    values = fresh((*columns, name), "live")
    joined = hits.join(per_text.select(F.col("key").alias(name), F.col("live").alias(values)), name, "left").select(*columns, values)
    return rest.unionByName(joined.mapInArrow(replace, docs.schema))
