"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

Targets: the sources, by code point and null last, weigh 1, 2, 3 and so on repeating, and share all words; no target exceeds ``CAP`` times its source's
words, and the excess is shared again by weight. Rates: the copies x of a document of size s minimise the relative entropy to one
copy of every document under the source's word constraint, which gives x = min(CAP, exp(m s)) with one dual variable m a source. Newton iterations
solve the dual: each adds up gradient and curvature over (source, size) counts, keeps a bracket, and falls back to bisection where a step leaves it. Rates
are fixed-point numbers and their sums decimals, so that reruns agree bit for bit.

Copies: running sums of wanted copies over all (source, size) in order, rounded, give whole copies of each size, off by less than the longest
document a source. That rest is then made up by a few copies of one size a power of two, the largest first, and what no whole
copy can make up by cutting, or adding a part to, one document. The copies of a size are dealt to its documents in the order of a hash of
doc_id; documents of one size differ by one copy at most.

Only counts move more than once: documents are put in order once (doc_id, source, size), and meet the counts of their size by broadcast
where a size has very many documents.

Defined results: a null text, or one without words, has size 0 and takes nothing. Equal doc_ids are documents of their own. An
empty table gives no rows; if no document has words, all targets are 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.common import join_counted, materialize
from lyrebird.operators.scan import ranked, running_sum

#: A source's words may be taken so many times at most.
CAP = 3
#: Fixed-point unit of rates.
UNIT = 1 << 32
ROUNDS = 60
#: A source's sum of rates is near enough to its target if off by less than this share of it, or half a word.
NEAR = 1e-6
_WIDE = "decimal(38,0)"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: number of words."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, sid, target, full (target at the cap) from (source, source_size). The shares of the rest are found by rounds over the sources, each adding two numbers up."""
    placed = ranked(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "sid").drop("_null")
    weighed = materialize(placed.withColumn("weight", F.col("sid") % 3 + 1), "weights")
    total = int(weighed.agg(F.sum("source_size")).first()[0] or 0)
    most = F.col("source_size") * CAP
    full, at_cap, share, out_of = F.lit(False), -1, 0, 1
    while True:
        capped, rest = weighed.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        capped, rest = int(capped or 0), int(rest or 0)
        if capped == at_cap or not rest:
            break
        at_cap, share, out_of = capped, total - capped, rest
        # the cap is reached if CAP * size <= weight * share / out_of, in whole numbers
        full = most.cast("decimal(20,0)") * F.lit(out_of).cast("decimal(17,0)") <= F.col("weight").cast("decimal(2,0)") * F.lit(share).cast("decimal(20,0)")
    target = F.when(full, most.cast("double")).otherwise(F.col("weight") * F.lit(float(share)) / F.lit(float(out_of)))
    return materialize(weighed.select("source", "source_size", "sid", target.alias("target"), full.alias("full")), "targets")


def _rate(m: Column, feature: Column) -> Column:
    """min(CAP, exp(m * feature)) in units."""
    return F.least(F.lit(CAP * UNIT), F.round(F.exp(F.least(m * feature, F.lit(5.0))) * UNIT).cast("long"))


def solve(bins: DataFrame, known: DataFrame) -> DataFrame:
    """(sid, m): the dual variable of every source that is neither empty nor at its cap.

    ``bins`` are (sid, size, n) with size > 0. Sizes are measured in means of their source.
    """
    per = bins.groupBy("sid").agg(F.sum("n").alias("docs"))
    unknown = lambda name: F.lit(None).cast("double").alias(name)
    start = known.filter("not full and source_size > 0").join(per, "sid").select("sid", "target", (F.col("docs") / F.col("source_size")).alias("scale"), F.lit(0.0).alias("m"), unknown("low"), unknown("high"))
    state = materialize(start, "dual")
    for _ in range(ROUNDS):
        at = bins.join(state, "sid").withColumn("feature", F.col("size") * F.col("scale")).withColumn("rate", _rate(F.col("m"), F.col("feature")))
        words = F.col("n").cast("decimal(19,0)") * F.col("size").cast("decimal(18,0)")
        free = F.when(F.col("rate") < CAP * UNIT, F.round(F.col("rate") / UNIT * F.col("feature") * UNIT).cast("long")).otherwise(0)
        sums = at.groupBy("sid").agg(F.sum((words * F.col("rate").cast("decimal(20,0)")).cast(_WIDE)).alias("g"), F.sum((words * free.cast("decimal(20,0)")).cast(_WIDE)).alias("h"))
        off = (F.col("g") / UNIT).cast("double") - F.col("target")
        curve = (F.col("h") / UNIT).cast("double")
        here = state.join(sums, "sid").withColumn("off", off).withColumn("step", F.when(curve > 0, F.col("m") - off / curve))
        low, high = F.when(F.col("off") <= 0, F.col("m")).otherwise(F.col("low")), F.when(F.col("off") > 0, F.col("m")).otherwise(F.col("high"))
        here = here.withColumn("low", low).withColumn("high", high)
        wider = F.when(F.col("high").isNull(), F.col("low") + F.greatest(F.lit(1.0), F.abs("low"))).when(F.col("low").isNull(), F.col("high") - F.greatest(F.lit(1.0), F.abs("high"))).otherwise((F.col("low") + F.col("high")) / 2)
        inside = F.coalesce((F.col("low").isNull() | (F.col("step") > F.col("low"))) & (F.col("high").isNull() | (F.col("step") < F.col("high"))), F.lit(False))
        far = F.abs("off") > F.greatest(F.lit(0.5), F.col("target") * NEAR)
        state = materialize(here.select("sid", "target", "scale", F.when(far, F.when(inside, F.col("step")).otherwise(wider)).otherwise(F.col("m")).alias("m"), "low", "high", far.alias("far")), "dual")
        if state.filter("far").isEmpty():
            break
        state = state.drop("far")
    return state.select("sid", "m", "scale")


def copies(bins: DataFrame, known: DataFrame, dual: DataFrame) -> DataFrame:
    """sid, size, n, rate, k (whole copies of all documents of that size together) and cut (words that one of them takes more, or less)."""
    rate = F.when(F.col("full"), F.lit(CAP * UNIT)).otherwise(F.coalesce(_rate(F.col("m"), F.col("size") * F.col("scale")), F.lit(0)))
    wanted = bins.join(known.select("sid", "target", "full"), "sid").join(dual, "sid", "left").select("sid", "size", "n", "target", rate.cast("long").alias("rate"), (-F.col("size")).alias("_down"))
    wanted = wanted.withColumn("want", (F.col("n").cast("decimal(18,0)") * F.col("rate").cast("decimal(19,0)")).cast(_WIDE))
    summed = running_sum(wanted, ["sid", "_down"], "want", "before")
    to = lambda c: F.floor((c + F.lit(UNIT // 2)) / F.lit(UNIT).cast("decimal(11,0)")).cast("long")
    whole = materialize(summed.select("sid", "size", "n", "target", "rate", (to((F.col("before") + F.col("want")).cast(_WIDE)) - to(F.col("before").cast(_WIDE))).alias("k")), "copies")
    moves = _make_up(whole)
    moved = whole.join(moves, ["sid", "size"], "left")
    return materialize(moved.select("sid", "size", "n", "rate", (F.col("k") + F.coalesce("move", F.lit(0))).alias("k"), F.coalesce("cut", F.lit(0)).cast("long").alias("cut")), "made-up")


def _make_up(whole: DataFrame) -> DataFrame:
    """(sid, size, move, cut): copies more or less of one size for each power of two, so that the source meets its target, and the words one document then takes more or less.

    A source has at most 63 powers of two, so its walk is bounded.
    """
    room = F.col("n") * CAP - F.col("k")
    levels = whole.groupBy("sid", F.length(F.bin("size")).alias("level")).agg(
        F.max(F.struct(room.alias("room"), "size")).alias("plus"),
        F.max(F.struct(F.col("k").alias("room"), "size")).alias("minus"),
        F.sum(F.col("k") * F.col("size")).alias("taken"),
        F.max("target").alias("target"),
    )
    rows = levels.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("level", "plus", "minus")), asc=False).alias("levels"), (F.round(F.max("target")).cast("long") - F.sum("taken")).alias("rest"))
    none = F.lit(0).cast("long")
    start = F.struct(F.col("rest").alias("rest"), F.array().cast("array<struct<size:bigint,move:bigint,cut:bigint>>").alias("moves"), none.alias("plus"), none.alias("minus"))

    def step(a: Column, e: Column) -> Column:
        nearest = lambda words, size: F.round(words / size).cast("long")
        more = F.when(a["rest"] > 0, F.least(e["plus"]["room"], nearest(a["rest"], e["plus"]["size"]))).otherwise(none)
        less = F.when(a["rest"] < 0, F.least(e["minus"]["room"], nearest(-a["rest"], e["minus"]["size"]))).otherwise(none)
        size = F.when(more > 0, e["plus"]["size"]).otherwise(e["minus"]["size"])
        move = F.struct(size.alias("size"), (more - less).alias("move"), none.alias("cut"))
        return F.struct(
            (a["rest"] - (more - less) * size).alias("rest"),
            F.when(more + less > 0, F.concat(a["moves"], F.array(move))).otherwise(a["moves"]).alias("moves"),
            F.greatest(a["plus"], F.when(e["plus"]["room"] > more, e["plus"]["size"]).otherwise(none)).alias("plus"),
            F.greatest(a["minus"], F.when(e["minus"]["room"] > less, e["minus"]["size"]).otherwise(none)).alias("minus"),
        )

    def finish(a: Column) -> Column:
        cut = F.struct(F.when(a["rest"] > 0, a["plus"]).otherwise(a["minus"]).alias("size"), none.alias("move"), a["rest"].alias("cut"))
        return F.when(a["rest"] != 0, F.concat(a["moves"], F.array(cut))).otherwise(a["moves"])

    return rows.select("sid", F.inline(F.aggregate("levels", start, step, finish))).groupBy("sid", "size").agg(F.sum("move").alias("move"), F.sum("cut").alias("cut"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (the last one perhaps a part) and rate (copies wanted) of every document."""
    key = F.concat_ws(":", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")), F.col("size").cast("string"))
    slim = sizes(docs).withColumn("_h", F.xxhash64("doc_id"))
    placed = materialize(ranked(slim, ["source", "size", "_h", "doc_id"], "place").select("doc_id", "source", "size", "place"), "placed")
    counts = materialize(placed.groupBy("source", "size").agg(F.count("*").alias("n"), F.min("place").alias("first")), "counts")
    known = targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    every = materialize(counts.alias("c").join(known.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "c.size", "c.n", "c.first", "s.sid", "s.source_size", "s.target"), "bins")
    bins = every.filter("size > 0").select("sid", "size", "n")
    made = copies(bins, known, solve(bins, known))
    about = every.join(made.drop("n"), ["sid", "size"], "left").select(key.alias("key"), "n", "first", "source_size", "target", "rate", "k", "cut")
    rows = placed.select("doc_id", "size", "place", key.alias("key"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = join_counted(rows, materialize(about, "about"), ["key"], "n", total)
    at, k = F.col("place") - F.col("first"), F.coalesce("k", F.lit(0))
    own = F.floor(k / F.col("n")).cast("long") + F.when(at < k % F.col("n"), 1).otherwise(0)
    # the first document of a size has most copies, the last one fewest
    cut = F.when((F.col("cut") > 0) & (at == F.col("n") - 1), F.col("cut")).when((F.col("cut") < 0) & (at == 0), F.col("cut")).otherwise(0)
    taken = F.greatest(F.lit(0), F.least(F.col("size") * CAP, own * F.col("size") + cut)).cast("long")
    out = found.select("doc_id", "size", "source_size", "target", taken.alias("taken"), (F.coalesce("rate", F.lit(0)) / UNIT).alias("rate"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int").alias("copies"), "rate")
