"""Exact Jaccard self-join of word-shingle sets through token-combination prefixes.

Tokens (shingle hashes) have one global order, rare before frequent. A set x that is similar to y misses
at most t = |x| - ceil(p|x|/q) tokens of it. Rare tokens are indexed one by one, frequent ones as pairs: frequent
tokens fall into G classes by hash, and c tokens of one class in a prefix survive c - 1 lost tokens as
some pair. A prefix runs until (rare tokens) + sum over classes of (c - 1) reaches t + 1, so it is extended
past the plain t + 1 where frequent tokens come in, and two similar sets share at least one signature.
G follows the size class of the smaller set of a pair, so that pairs stay proportional to the size; a set whose
partners may be of a smaller class is indexed for both.

Frequencies are counted over all documents, in hash buckets of bounded number; the order follows the bucket's
count, and a token is rare if its bucket shows that it occurs at most ``RARE`` times. Sets with the same tokens are one node. For each signature one
node is compared with every other (a star, not all pairs); where that leaves nodes of one signature in
different components, their pairs are tried too, so that no link between components is lost. An exact bound from
parity bits of the sets rules out nearly all pairs that don't link before a set is fetched; the others are verified on whole sets,
one set a pair against its star's. Signatures and nodes with very many rows are counted first and dealt over many tasks.

Only connectivity is computed: pairs of different sets that the star has already put into one component are never verified, so the
operator gives components, but neither all links nor the number of links of a document.

Defined results: null or empty text, or text without words: no tokens, linked with nothing, component is its own
doc_id. Repeated rows each give a row. A null doc_id gets the component's smallest known doc_id. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lyrebird.llm.common import by_bytes, cap_batches, drop_scratch, fresh, hot_keys, join_dealt, materialize, release, worker_slot
from lyrebird.llm.components import connected_components
from lyrebird.llm.rows import split_by_keys, text_key, with_keys
from lyrebird.llm.words import WordHashes, mix, shingle_set

#: Buckets of the token frequency table, and with it the rows that reach the driver.
BUCKET_BITS = 17
#: Occurrences up to which a token counts as rare, as its bucket proves it.
RARE = 3
#: 64-bit words of a set's parity bits.
PARITY_WORDS = 16
#: Rows of a signature, a set or a group from which they are dealt over many tasks.
HOT_ROWS = 1000
#: Pairs of a node that are verified together, about.
DEAL_PAIRS = 128

_NO_PARITY = np.zeros(PARITY_WORDS, np.int64)

_SHIFT = np.uint64(64 - BUCKET_BITS)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Documents' distinct tokens counted in 2**BUCKET_BITS hash buckets, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = worker_slot("words", WordHashes), np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in (part for b in batches for part in by_bytes(b, 0)):
            got = [shingle_set(text.as_py(), k, hashes) >> _SHIFT for text in batch.column(0)]
            if got:
                total += np.bincount(np.concatenate(got).astype(np.int64), minlength=len(total))
        used = np.flatnonzero(total)
        if used.size:
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    counts = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return out


class Signatures:
    """Signatures of a token set under the threshold p/q."""

    def __init__(self, counts: np.ndarray, p: int, q: int) -> None:
        self._counts, self._p, self._q = counts, p, q
        # about as many classes as a set may lose tokens make the fewest pairs
        self._shift = max(0, round(log2(q / (1.5 * (q - p))))) if p < q else 4

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        n, p, q = len(tokens), self._p, self._q
        lost = n - -(-p * n // q)
        count = self._counts[(tokens >> _SHIFT).astype(np.int64)]
        levels = range((-(-p * n // q)).bit_length() - 1, n.bit_length())
        need = lost + 1 + max(map(self._groups, levels))
        rare = int((count <= RARE).sum())
        if need < n // 2:  # only the rarest tokens are looked at: sort no others
            some = count <= np.partition(count, need)[need]
            tokens, count = tokens[some], count[some]
        tokens = tokens[np.lexsort((tokens, count))]
        if rare > lost:
            return tokens[: lost + 1]
        out = [tokens[:rare]]
        for level in levels:
            groups = self._groups(level)
            out.append(self._pairs(tokens[rare:], lost + 1 - rare, groups) if groups else tokens[rare : lost + 1])
        return np.unique(np.concatenate(out))

    def _groups(self, level: int) -> int:
        """Classes of frequent tokens for pairs whose smaller set has 2**level to 2**(level + 1) - 1 tokens; 0: single tokens only."""
        groups = 1 << (level - self._shift) if level >= self._shift else 0
        return groups if groups and -(-self._p * (1 << level) // self._q) > groups else 0

    @staticmethod
    def _pairs(tokens: np.ndarray, needed: int, groups: int) -> np.ndarray:
        """Pairs within each of ``groups`` classes (a power of two), over the shortest prefix in which the classes survive ``needed`` losses."""
        tokens = tokens[: needed + groups]  # the prefix can't be longer
        kind = (tokens >> np.uint64(20)) & np.uint64(groups - 1)
        by = np.argsort(kind, kind="stable")
        later = np.empty(len(tokens), bool)  # not the first of its class: each such token adds one to what the prefix survives
        later[by[0]] = False
        later[by[1:]] = kind[by[1:]] == kind[by[:-1]]
        end = int(np.searchsorted(np.cumsum(later), needed)) + 1
        inside = by[by < end]
        token, kind, out = tokens[inside], kind[inside], []
        for gap in range(1, len(inside)):
            same = kind[gap:] == kind[:-gap]
            if not same.any():
                break
            out.append(mix(token[:-gap][same] * np.uint64(3) + mix(token[gap:][same]) + np.uint64(groups)))
        return np.concatenate(out) if out else tokens[:0]


def _signed_sets(rows: DataFrame, k: int, p: int, q: int, counts) -> DataFrame:
    """The rows' own columns without ``text``, n tokens, 128-bit set_id (null: no tokens), parity words and signatures of every document."""
    carried = [f for f in rows.schema if f.name != "text"]
    place = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sign = worker_slot("words", WordHashes), Signatures(counts.value, p, q)
        for batch in (part for b in batches for part in by_bytes(b, place)):
            ns, ids, parities, sigs, ends = [], [], [], [], [0]
            for text in batch.column(place):
                s = shingle_set(text.as_py(), k, hashes)
                ns.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                parities.append(_parity(s) if len(s) else _NO_PARITY)
                if len(s):
                    sigs.append(sign(s).view(np.int64))
                ends.append(ends[-1] + (len(sigs[-1]) if len(s) else 0))
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int64)
            words = pa.array(np.concatenate(parities) if parities else np.empty(0, np.int64))
            added = {
                "n": pa.array(ns, pa.int64()),
                "set_id": pa.array(ids, pa.binary()),
                "parity": pa.ListArray.from_arrays(pa.array(range(0, len(ns) * PARITY_WORDS + 1, PARITY_WORDS), pa.int32()), words),
                "sigs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
            }
            own = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*own, *added.values()], [*(f.name for f in carried), *added])

    kept = StructType([*carried, *StructType.fromDDL("n long, set_id binary, parity array<long>, sigs array<long>")])
    return rows.mapInArrow(run, kept)


def _parity(tokens: np.ndarray) -> np.ndarray:
    """One bit per residue of a token: whether the set holds an odd number of such tokens."""
    odd = np.bincount((tokens & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fetch_sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Whole token sets (as bytes) of the nodes ``wanted`` (node, set_id, text_hash), from their texts: (node, tokens).

    A Bloom filter of the texts' hashes keeps the other texts out of Python; the join by set_id is exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_slot("words", WordHashes)
        for batch in (part for b in batches for part in by_bytes(b, 0)):
            data = [s.tobytes() for text in batch.column(0) if len(s := shingle_set(text.as_py(), k, hashes))]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary()), pa.array(data, pa.binary())], ["set_id", "tokens"])

    some = with_keys(rows, F.col("text_hash"), wanted.select("text_hash"))
    found = some.select("text").mapInArrow(run, "set_id binary, tokens binary")
    return found.dropDuplicates(["set_id"]).join(wanted, "set_id").select("node", "tokens")


def _per_sig(rows: DataFrame, hot: DataFrame | None, **aggregates: Column) -> DataFrame:
    """The rows (with ``sig``) and their signature's aggregates. Rows of hot signatures are aggregated before they are shuffled and get the result by broadcast."""
    over = Window.partitionBy("sig")
    if hot is None:
        return rows.withColumns({name: a.over(over) for name, a in aggregates.items()})
    warm = rows.join(F.broadcast(hot.select("sig")), "sig", "left_semi")
    stats = warm.groupBy("sig").agg(*(a.alias(name) for name, a in aggregates.items()))
    cold = rows.join(F.broadcast(hot.select("sig")), "sig", "left_anti").withColumns({name: a.over(over) for name, a in aggregates.items()})
    return cold.unionByName(warm.join(F.broadcast(stats), "sig").select(cold.columns))


def _verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach p/q.

    A pair carries the set of b only; the set of a comes once for all pairs of a in its group, in front of them. The pairs of
    an a with very many are dealt over several groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            xs, kinds, tokens, keep = batch.column(0), batch.column(2).to_pylist(), batch.column(3), []
            for i, pair in enumerate(kinds):
                y = np.frombuffer(tokens[i].as_buffer(), np.uint64)
                if not pair:
                    first = y.copy()
                    keep.append(False)
                    continue
                x, y = (first, y) if len(first) <= len(y) else (y, first)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(q * both >= p * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([xs.filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    hot = hot_keys(pairs.select("a"), "a", DEAL_PAIRS)
    deal = pairs.withColumn("deal", F.lit(0))
    if hot is not None:
        parts = hot.select("a", F.ceil(F.col("n") / DEAL_PAIRS).cast("int").alias("parts"))
        deal = pairs.join(F.broadcast(parts), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0)).alias("deal"))
    firsts = deal.select("a", "deal").distinct().join(sets.select(F.col("node").alias("a"), "tokens"), "a").select("a", F.lit(None).cast("long").alias("b"), F.lit(False).alias("pair"), "tokens", "deal")
    others = deal.join(sets.select(F.col("node").alias("b"), "tokens"), "b").select("a", "b", F.lit(True).alias("pair"), "tokens", "deal")
    dealt = firsts.unionByName(others).repartition("a", "deal").sortWithinPartitions("a", "deal", "pair")
    return dealt.select("a", "b", "pair", "tokens").mapInArrow(run, "a long, b long")


def _close(m: str, n: str, p: int, q: int) -> Column:
    """Whether sets of these sizes can reach p/q."""
    return F.expr(f"{q} * least({m}, {n}) >= {p} * greatest({m}, {n})")


def _bits(sizes: DataFrame, side: str) -> DataFrame:
    """Node, size and parity words, one column each, of one side of a pair."""
    return sizes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), *(F.col("parity")[i].alias(f"w{i}_{side}") for i in range(PARITY_WORDS)))


def _may_link(p: int, q: int) -> Column:
    """Whether sets a and b can reach p/q by their parities and sizes: they differ in at least as many tokens as their parity bits do."""
    differ = " + ".join(f"bit_count(w{i}_a ^ w{i}_b)" for i in range(PARITY_WORDS))
    return F.expr(f"{p + q} * ({differ}) <= {q - p} * (n_a + n_b)")


def _star(shared: DataFrame, hot: DataFrame | None, p: int, q: int) -> DataFrame:
    """Pairs (a, b) of each signature's most famous node, a, with its others. Fame is the number of signatures that a node
    shares with any other: an unchanged original has more of them than its changed copies."""
    with_pivot = _per_sig(shared, hot, pivot=F.max(F.struct("fame", "node", "n")))
    pairs = with_pivot.filter("node <> pivot.node").filter(_close("n", "pivot.n", p, q)).select(F.col("pivot.node").alias("a"), F.col("node").alias("b"))
    return pairs.distinct()


def jaccard_groups(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """The columns of ``docs`` without ``text``, n (size of the token set) and ``group``, a number for each component; null without tokens.

    All tables of the way are dropped; the result is a stored table.
    """
    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if c != "text"), F.xxhash64("text").alias("text_hash"), "text")
    cap_batches(spark)
    counts = spark.sparkContext.broadcast(token_frequencies(docs, k))
    signed = materialize(_signed_sets(docs, k, p, q, counts), "signed")
    counts.destroy()
    nodes = materialize(
        signed.filter("n > 0")
        .groupBy("set_id")
        .agg(F.first("n").alias("n"), F.first("text_hash").alias("text_hash"), F.first("parity").alias("parity"), F.first("sigs").alias("sigs"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    # signatures are most of the bytes: no table and no shuffle keeps them longer than it must
    members = materialize(signed.drop("sigs", "parity", "text_hash"), "members")
    drop_scratch(signed)
    release(spark)
    exploded = nodes.select("node", F.explode("sigs").alias("sig"))
    hot = hot_keys(exploded.select("sig"), "sig", HOT_ROWS)
    groups_of = materialize(_per_sig(exploded, hot, lo=F.min("node"), hi=F.max("node")).filter("lo < hi").select("sig", "node"), "groups")
    sizes = materialize(nodes.drop("sigs"), "sizes")
    drop_scratch(nodes)
    del signed, exploded
    release(spark)
    size = sizes.select("node", "n")
    fame = groups_of.groupBy("node").agg(F.count("*").alias("fame")).join(size, "node")
    shared = groups_of.join(fame, "node")
    # the bound rules out most pairs before a set is fetched
    star = materialize(_star(shared, hot, p, q).join(_bits(sizes, "b"), "b").join(_bits(sizes, "a"), "a").filter(_may_link(p, q)).select("a", "b"), "star")
    links = _links(docs, star, sizes, k, p, q)
    groups = connected_components(links)
    label = shared.select("sig", "node").join(groups, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
    split = materialize(_per_sig(label, hot, lo=F.min("root"), hi=F.max("root")).filter("lo < hi").select("sig", "node", "root"), "split")
    drop_scratch(groups_of)
    left, right = (split.select("sig", F.col("node").alias(x), F.col("root").alias(f"root_{x}")).join(_bits(sizes, x), x) for x in "ab")
    rest = left.join(right, "sig").filter("root_a <> root_b and a < b").filter(_close("n_a", "n_b", p, q)).filter(_may_link(p, q)).select("a", "b").distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    drop_scratch(split, star)
    if rest.limit(1).count():
        more = _links(docs, rest, sizes, k, p, q)
        drop_scratch(groups)
        groups = connected_components(links.unionByName(more))
        drop_scratch(more)
    drop_scratch(links, rest)
    by_set = sizes.select("set_id", "node").join(groups, "node", "left").select("set_id", F.coalesce("root", "node").alias("group"))
    known = join_dealt(members.filter("set_id is not null"), by_set, "set_id", least=HOT_ROWS).drop("set_id")
    bare = members.filter("set_id is null").drop("set_id").withColumn("group", F.lit(None).cast("long"))
    found = materialize(known.unionByName(bare), "found")
    drop_scratch(members, sizes, groups)
    return found


def _links(docs: DataFrame, pairs: DataFrame, sizes: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """The pairs that link, by their whole sets, as a stored table; only sets of these pairs are fetched."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialize(sizes.select("node", "set_id", "text_hash").join(nodes, "node"), "wanted")
    sets = materialize(_fetch_sets(docs, wanted, k), "sets")
    links = materialize(_verified(pairs, sets, p, q), "links")
    drop_scratch(wanted, sets)
    release(docs.sparkSession)
    return links


def jaccard_components(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id (smallest doc_id reachable over links with q*inter >= p*union)."""
    found = jaccard_groups(_texts(docs), k, p, q)
    known = found.filter("group is not null")
    lowest = known.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = join_dealt(known, lowest, "group", least=HOT_ROWS).unionByName(found.filter("group is null").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """Of each component of documents one row, with its own columns: that of the smallest doc_id; of rows that share it any with the smallest text digest.

    Rows are told apart by doc_id and text, so rows that only share their doc_id stay or go each by its own text. A null doc_id
    comes after all others. Documents without words stay, each of them.
    """
    key = text_key("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("string").alias("text"))
    found = jaccard_groups(rows, k, p, q).filter("group is not null").groupBy("group", "key", "doc_id").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    per_row = _kept_of(found, order)
    judged = materialize(per_row, "judged")
    rest, hits, name = split_by_keys(docs, key, judged.select("key"))
    if hits is None:
        return docs
    columns = docs.columns
    kept = fresh((*columns, name), "kept")
    met = hits.join(judged.select(F.col("key").alias(name), F.col("kept").alias(kept)), name, "left")
    clean = met.filter(F.col(kept).isNull()).select(columns)
    one = met.filter(F.col(kept)).groupBy(name).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in columns))).alias("row"))
    return rest.unionByName(clean).unionByName(one.select(*(F.col("row")[c].alias(c) for c in columns)))


def _kept_of(found: DataFrame, order: Column) -> DataFrame:
    """(key, kept) of the rows that a decision touches: all but those kept that stand once. The smallest of a group is kept."""
    lowest = found.groupBy("group").agg(F.min(order).alias("lowest"))
    return join_dealt(found, lowest, "group", least=HOT_ROWS).select("key", "rows", (F.col("key") == F.col("lowest.key")).alias("kept")).filter("rows > 1 or not kept").select("key", "kept")
