"""Benchmark decontamination over a distributed positional inverted index.

The index holds, for blocks of documents of bounded size, the word positions of every term that occurs in the
benchmark; it is one stored row per block, built and searched without a shuffle. Term frequencies over all documents
order each window's terms: its rarest terms' posting lists, shifted by their offsets in the window, are
intersected first, until the list is empty or all terms agree (an exact phrase). Proximity matches are the
minimal spans of a document with all terms of a window, each as often as the window has it, in any order, within ``slack`` more
words than it has, but for exact occurrences of the window. A span is minimal if no shorter one inside it has all these terms.

The benchmark is searched in slices of about ``SLICE_BYTES`` of text, which bounds what is broadcast; an item of over ``PIECE_WORDS`` words goes there
in pieces that overlap by a window less one word, so that none of its windows is lost.

Defined results: a null or empty text has no words and no hits; a benchmark item without words has no window;
one with fewer words than the width is one window; repeated items are distinct by item_id; repeated documents each
give a row; extra columns are ignored; empty tables give no hits or no rows. A null item_id counts as ''. A very long document is a
block of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.common import materialize, worker_slot
from lyrebird.llm.rows import text_key, without_keys

#: Tokens of a block, about; a longer document is a block of its own.
BLOCK_TOKENS = 1_500_000
#: Benchmark text that one search broadcasts at most.
SLICE_BYTES = 16 << 20

#: Words of an item's piece, about.
PIECE_WORDS = 200_000

#: Bytes to word bytes (A-Z lower-cased) or to blanks: words are digits, letters and all bytes past ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_INDEX = "block long, terms array<int>, counts array<int>, postings binary, docs binary, ids array<{id}>"
_MATCHES = "block long, ord int, doc_id {id}, n_words long, found array<struct<item:string,kind:string,start:long,end:long>>"
_ARROW_IDS = {"bigint": pa.int64(), "string": pa.string()}


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Windows:
    """The distinct windows of benchmark items, as term numbers."""

    def __init__(self, items: list[tuple[str, str | None]], width: int) -> None:
        self.vocab: dict[bytes, int] = {}
        by_window: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            terms = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            for i in range(max(1, len(terms) - width + 1) if terms else 0):
                by_window.setdefault(tuple(terms[i : i + width]), set()).add(item or "")
        self.windows = list(by_window)
        self.items = [sorted(by_window[w]) for w in self.windows]

    def ordered(self, freq: np.ndarray) -> list[list[tuple[int, int]]]:
        """Each window's (term, offset), rarest term first."""
        return [sorted(((t, i) for i, t in enumerate(w)), key=lambda x: (freq[x[0]], x)) for w in self.windows]

    def terms_by_length(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(window numbers, their terms as a matrix), for each length."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(self.windows):
            by.setdefault(len(w), []).append(k)
        return [(np.array(ks), np.array([self.windows[k] for k in ks])) for ks in by.values()]


def _index_block(terms: np.ndarray, docs: list[tuple[int, int]], ids: list, block: int) -> dict:
    """One row of the index. terms: the block's words as term numbers or -1, with a -1 between documents."""
    at = np.flatnonzero(terms >= 0).astype(np.uint32)
    which = terms[at]
    order = np.argsort(which, kind="stable")
    found, counts = np.unique(which, return_counts=True)
    return {"block": block, "terms": found.astype(np.int32), "counts": counts.astype(np.int32), "postings": at[order].tobytes(), "docs": np.array(docs, np.int64).tobytes(), "ids": ids}


def build_index(docs: DataFrame, vocab) -> DataFrame:
    """Positional postings of the terms in the broadcast ``vocab``, one row per block of documents (doc_id a long or a string, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_slot("nothing", object)
        number = vocab.value
        schema = pa.schema([("block", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary()), ("docs", pa.binary()), ("ids", pa.list_(_ARROW_IDS[id_type]))])
        block, parts, directory, ids, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush() -> pa.RecordBatch:
            row = _index_block(np.concatenate(parts), directory, ids, block)
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                row = np.full(len(words) + 1, -1, np.int32)
                row[:-1] = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
                parts.append(row)
                directory.append((size, len(words)))
                ids.append(doc_id)
                size += len(row)
                if size >= BLOCK_TOKENS:
                    yield flush()
                    block, parts, directory, ids, size = block + 1, [], [], [], 0
        if parts:
            yield flush()

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, _INDEX.format(id=id_type))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges lo to hi, ends excluded."""
    size = hi - lo
    return np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def near_spans(lists: list[np.ndarray], need: list[int], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last position) of the minimal spans of at most ``longest`` words that hold ``need[i]`` postings of each sorted list i; the shortest list first.

    Only what lies near postings of the first list is looked at.
    """
    rare = lists[0]
    for post, n in zip(lists, need, strict=True):
        rare = rare[np.searchsorted(post, rare + longest) - np.searchsorted(post, rare - longest, "right") >= n]
        if not rare.size:
            return rare, rare
    near = [post[np.unique(_ranges(np.searchsorted(post, rare - longest, "right"), np.searchsorted(post, rare + longest)))] for post in lists]
    first = np.sort(np.concatenate(near))
    last, ok = first.copy(), np.ones(len(first), bool)
    for post, n in zip(near, need, strict=True):
        i = np.searchsorted(post, first) + n - 1
        ok &= i < len(post)
        last = np.maximum(last, post[np.minimum(i, len(post) - 1)])
    ok &= last - first < longest
    first, last = first[ok], last[ok]
    shortest = np.r_[last[1:] != last[:-1], True] if len(last) else ok[:0]  # the last start for an end
    return first[shortest], last[shortest]


def search_block(row: dict, windows: Windows, order: list[list[tuple[int, int]]], matrices: list, slack: int | None) -> list[tuple[int, int, str, int, int]]:
    """(document's place, window, kind, start, end) of a block's matches; starts count the document's words."""
    terms, counts = np.asarray(row["terms"], np.int64), np.asarray(row["counts"], np.int64)
    ends = np.cumsum(counts)
    postings = np.frombuffer(row["postings"], np.uint32).astype(np.int64)
    lists = {int(t): postings[e - c : e] for t, c, e in zip(terms, counts, ends, strict=True)}
    starts = np.frombuffer(row["docs"], np.int64).reshape(-1, 2)[:, 0]
    there = np.zeros(len(windows.vocab), bool)
    there[terms] = True
    out = []

    def tell(kind: str, k: int, at: np.ndarray, length: int) -> None:
        place = np.searchsorted(starts, at, "right") - 1
        out.extend((int(p), k, kind, int(a - starts[p]), int(a - starts[p]) + length) for p, a in zip(place, at, strict=True))

    for numbers, matrix in matrices:
        for k in numbers[there[matrix].all(axis=1)].tolist():
            plan = order[k]
            term, offset = plan[0]
            rare = lists[term]
            at = rare - offset
            for term, offset in plan[1:]:
                post = lists[term]
                i = np.searchsorted(post, at + offset)
                at = at[post[np.minimum(i, len(post) - 1)] == at + offset]
                if not at.size:
                    break
            if at.size:
                tell("exact", k, at, len(plan))
            if slack is not None:
                need = Counter(term for term, _ in plan)
                lo, hi = near_spans([lists[t] for t in need], list(need.values()), len(plan) + slack)
                same = np.searchsorted(starts, lo, "right") == np.searchsorted(starts, hi, "right")
                other = ~(np.isin(lo, at) & (hi - lo == len(plan) - 1))
                for a, b in zip(lo[same & other].tolist(), hi[same & other].tolist(), strict=True):
                    tell("near", k, np.array([a]), b - a + 1)
    return out


def _search(index: DataFrame, windows, freq, slack: int | None) -> DataFrame:
    """Matches of each document of the index; every document has a row."""
    id_type = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows.__new__(Windows)
        vars(w).update(windows.value)
        order, matrices = w.ordered(freq.value), w.terms_by_length()
        for batch in batches:
            for row in batch.to_pylist():
                found: dict[int, list[dict]] = {}
                for place, k, kind, start, end in search_block(row, w, order, matrices, slack):
                    found.setdefault(place, []).extend({"item": item, "kind": kind, "start": start, "end": end} for item in w.items[k])
                n = len(row["ids"])
                lengths = np.frombuffer(row["docs"], np.int64).reshape(-1, 2)[:, 1]
                kind = pa.list_(pa.struct([("item", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(row["ids"], _ARROW_IDS[id_type]), pa.array(lengths), pa.array([found.get(i, []) for i in range(n)], kind)], ["block", "ord", "doc_id", "n_words", "found"])

    return index.mapInArrow(run, _MATCHES.format(id=id_type))


def _pieces(items: DataFrame, width: int) -> DataFrame:
    """(item, part, text) of (item, text): long items in overlapping pieces."""
    most = PIECE_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                starts = range(0, max(1, len(words) - width + 1), most)
                parts = [b" ".join(words[i : i + most + width - 1]).decode("utf-8", "surrogatepass") for i in starts]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["item", "part", "text"])

    return items.mapInArrow(run, "item string, part int, text string")


def find_matches(docs: DataFrame, benchmark: DataFrame, width: int = 13, slack: int | None = None) -> DataFrame:
    """Per document: doc_id, n_words and found, an array of (item, kind 'exact' or 'near', start, end) in words.

    ``slack`` None leaves out proximity matches. ``doc_id`` may be a string; else it is cast to long.
    """
    spark = docs.sparkSession
    if docs.schema["doc_id"].dataType.simpleString() != "string":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    items = materialize(_pieces(benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")), width), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // SLICE_BYTES))
    out = None
    for s in range(slices):
        some = items if slices == 1 else items.filter(F.pmod(F.xxhash64("item", "part"), F.lit(slices)) == s)
        windows = Windows([(r["item"], r["text"]) for r in some.toLocalIterator()], width)
        index = materialize(build_index(docs, spark.sparkContext.broadcast(windows.vocab)), "index")
        pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n")).toArrow()
        freq = np.zeros(len(windows.vocab), np.int64)
        freq[pairs["terms"].to_numpy()] = pairs["n"].to_numpy()
        found = _search(index, spark.sparkContext.broadcast(vars(windows)), spark.sparkContext.broadcast(freq), slack)
        out = found if out is None else out.unionByName(found)
    if slices > 1:
        out = out.groupBy("block", "ord").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    return out.select("doc_id", "n_words", "found")


def _kind(kind: str) -> Column:
    return F.filter("found", lambda m: m["kind"] == kind)


def judge(matches: DataFrame, share: int = 20) -> DataFrame:
    """From exact matches: n_hit words, n_items, items_sha256 and contaminated (share * n_hit >= n_words); from near ones n_near_items."""
    spans = F.array_sort(F.transform(_kind("exact"), lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, m: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), m["e"] - F.greatest(m["s"], a["to"]))).alias("n"), F.greatest(a["to"], m["e"]).alias("to")),
        lambda a: a["n"],
    )
    distinct = lambda kind: F.array_sort(F.array_distinct(F.transform(_kind(kind), lambda m: m["item"])))
    return (
        matches.withColumn("n_hit", covered)
        .withColumn("items", distinct("exact"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
            F.size(distinct("near")).cast("long").alias("n_near_items"),
        )
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, slack: int | None = None) -> DataFrame:
    """Per document the verdict of ``judge``; n_near_items only where ``slack`` is given."""
    out = judge(find_matches(docs, benchmark, width, slack))
    return out.drop("n_near_items") if slack is None else out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The documents, with their own columns, that no benchmark passage contaminates.

    A text decides on its own: rows go by the digest of their text, whatever their doc_id is.
    """
    rows = docs.select(text_key().alias("doc_id"), F.col("text").cast("string").alias("text"))
    judged = materialize(contamination(rows, benchmark, width).filter("contaminated").select("doc_id"), "judged")
    return without_keys(docs, text_key(), judged)
