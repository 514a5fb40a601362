"""Summaries of texts of any length by a tree of calls: blocks of words are summarised, their summaries are joined into a shorter text, and so on
until an item's text fits one call.

An item's text is its rows in order; it is never put together. A row knows how many words of the item stand before it (an ordered scan, so an item may
hold most of all rows), is cut where blocks begin, and its pieces go to their blocks. Only a block is gathered, of at most ``words`` words.
A summariser is a function of (text, most words) that gives a column: built-in functions, or a model behind a pandas UDF.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lyrebird.functions import text as text_functions
from lyrebird.operators import scan
from lyrebird.storage import drop, stored

# Words of a call (about 50,000 tokens) and of a part's summary.
BLOCK_WORDS, PART_WORDS = 37_500, 750

SUMMARISERS: dict[str, Callable[[Column, int], Column]] = {}


def summariser(name: str):
    def add(fn):
        SUMMARISERS[name] = fn
        return fn

    return add


@summariser("lead")
def lead(text: Column, most: int) -> Column:
    """The first words."""
    return F.array_join(F.slice(text_functions.words(text), 1, most), " ")


def salient_sentences(text: str, most: int) -> str:
    """Sentences, in their order, whose words are the most frequent of the text on average, as many as fit into ``most`` words.

    Ties go to the earlier sentence; if not even the best one fits, its first words are taken.
    """
    sentences = [s.split() for s in regex.split(r"(?<=[.!?])\s+", text)]
    often = Counter(w.lower() for s in sentences for w in s)
    score = [sum(often[w.lower()] for w in s) / max(len(s), 1) for s in sentences]
    room, taken = most, {}
    for i in sorted(range(len(sentences)), key=lambda i: (-score[i], i)):
        if sentences[i] and (len(sentences[i]) <= room or not taken):
            taken[i] = sentences[i][:room]
            room -= len(taken[i])
    return " ".join(w for i in sorted(taken) for w in taken[i])


@summariser("salient")
def salient(text: Column, most: int) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else salient_sentences(t, most))

    return run(text)


def _blocks(ranges: DataFrame, key: str, words: int) -> DataFrame:
    """(key, block, text, more, and the sums of n_words, n_calls, words_read) of rows (with the text ``_t``) dealt into ranges; ``more``: block 0 isn't the only one."""
    ranges = ranges.withColumn("_w", text_functions.words(F.col("_t"))).drop("_t").withColumn("_len", F.size("_w").cast("long")).filter("_len > 0")
    ranges = ranges.withColumn("n_words", F.coalesce("n_words", "_len"))
    here = Window.partitionBy("_p", key).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    per = ranges.groupBy("_p", key).agg(F.sum("_len").alias("_sum"))
    carry = scan.carried(per, key, {"_before": F.coalesce(F.sum("_sum").over(scan.parts_before(key)), F.lit(0))})
    placed = scan.with_carry(ranges.withColumn("_in", F.coalesce(F.sum("_len").over(here), F.lit(0))), key, carry)
    placed = placed.withColumn("_from", F.col("_in") + F.coalesce("_before", F.lit(0)))
    start = F.col("_from")
    first, last = F.floor(start / words), F.floor((start + F.col("_len") - 1) / words)

    def piece(b: Column) -> Column:
        begin = F.greatest(b * words, start)
        own = lambda c: F.when(b == first, F.col(c)).otherwise(0).alias(c)
        return F.struct(b.alias("block"), F.slice("_w", (begin - start + 1).cast("int"), ((b + 1) * words - begin).cast("int")).alias("w"), F.lit(False).alias("more"), own("n_words"), own("n_calls"), own("words_read"))

    nothing = F.lit(0).cast("long")
    mark = F.struct(nothing.alias("block"), F.array().cast("array<string>").alias("w"), F.lit(True).alias("more"), nothing.alias("n_words"), nothing.alias("n_calls"), nothing.alias("words_read"))
    # one row of an item holds the first word of block 1: it tells block 0 that it isn't alone
    pieces = F.concat(F.transform(F.sequence(first, last), piece), F.filter(F.array(mark), lambda _: (start <= words) & (start + F.col("_len") > words)))
    out = placed.select(key, "_p", "_pos", F.inline(pieces))
    text = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_pos", "w"))), lambda x: x["w"])), " ")
    return out.groupBy(key, "block").agg(text.alias("text"), F.max("more").alias("more"), *(F.sum(c).alias(c) for c in ("n_words", "n_calls", "words_read")), F.sum(F.size("w").cast("long")).alias("_len"))


def tree_summaries(df: DataFrame, key: str, order: list[str], name: str = "lead", words: int = BLOCK_WORDS, most: int = PART_WORDS, text: str = "text", partitions: int | None = None) -> DataFrame:
    """Per item the summary, n_words (of its text), n_calls, words_read (by all calls) and n_rounds.

    A text of at most ``words`` words is summarised by one call. A longer one is cut into blocks of ``words`` words; their summaries, each after
    "PART <n>:", make the text of the next round. A summary has at most ``most`` words, which is less than half of a block, so each
    round at least halves an item's text; a longer one is an error. A summary of null (a failed call) stands as [ERROR] in the next round, and is null as an
    item's last. Items without a word have no row; null is a key of its own; rows equal in ``order`` go by the MD5 of their text.
    """
    if not 0 < 2 * (most + 2) <= words:
        raise ValueError("a part's summary and its two words of heading may take half of a block at most")
    nothing = F.lit(0).cast("long")
    places = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    rows = df.select(F.col(key).alias("item"), *places, F.md5(text).alias("_tie"), F.col(text).alias("_t"), F.lit(None).cast("long").alias("n_words"), nothing.alias("n_calls"), nothing.alias("words_read"))
    by, rounds, done = ["item", *(f"_o{i}" for i in range(len(order))), "_tie"], 0, []
    while True:
        ranges = scan.spread(rows, by, partitions)
        rounds += 1
        blocks = _blocks(ranges, "item", words).withColumn("summary", SUMMARISERS[name](F.col("text"), most))
        fits = F.coalesce(text_functions.word_count(F.col("summary")), F.lit(0)) <= most
        summary = F.when(fits, F.col("summary")).otherwise(F.raise_error(F.lit(f"a summary has over {most} words")))
        out = stored(blocks.select("item", "block", summary.alias("summary"), "n_words", (F.col("n_calls") + 1).alias("n_calls"), (F.col("words_read") + F.col("_len")).alias("words_read"), ((F.col("block") == 0) & ~F.col("more")).alias("last")), "summaries")
        drop(ranges)
        done.append(out.filter("last").select(F.col("item").alias(key), "summary", "n_words", "n_calls", "words_read", F.lit(rounds).alias("n_rounds")))
        rest = out.filter("not last")
        if rest.isEmpty():
            break
        part = F.concat(F.lit("PART "), F.col("block") + 1, F.lit(": "), F.coalesce("summary", F.lit("[ERROR]")))
        rows = rest.select("item", "block", part.alias("_t"), "n_words", "n_calls", "words_read")
        by = ["item", "block"]
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result
