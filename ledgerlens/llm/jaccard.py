"""Operator 6: exact join of documents by the Jaccard distance of their word n-grams.

1 - Jaccard is a metric, and two documents link when it is at most 0.25. Pivots alone cannot cut this
space into regions: most documents share nothing with any pivot, all their distances are 1, and every
triangle-inequality window holds all of them. So the first cut is by shared n-grams, and pivots work
inside:

1. Regions. Each document's n-grams are put in one order for the whole corpus, rare before frequent. Two
   linked documents share one among the first quarter of either, so each n-gram there opens a region with all
   documents that have it in that part. A document is replicated to each of its regions.
2. In each region a first pivot is chosen and the others' distances to it are computed. Those within 0.25 form
   its ball: they are all joined through it and need no comparison with each other.
3. A region whose documents are in different components after that is joined again, recursively. In a large one
   more pivots are taken, the smaller components' first, and each document's distance to each of them is computed. They
   create Voronoi regions: a document goes to its nearest pivot, and to each pivot before that whose distance is no more
   than twice 0.25 farther (its partner, if nearer to that one, cannot be missed then); the pivots, compared with all, leave.
   Where this makes no region smaller, it stays as it is and is given twice as many pivots next time. In small regions,
   and in all once few members of other components are left, documents of different components are compared
   if the triangle inequality over the first pivot (distances that differ by 0.25 at most), the sizes and the places
   of the shared n-gram leave it possible. It ends when each region is in one component or empty, so every pair that
   could be a link has been compared or is joined already.

The order only directs work: any order gives the same links. Texts that are equal are looked at once.

Defined results: null, empty and blank texts have no n-grams and are linked with nothing, their component is their
own doc_id; rows with the same text are linked with each other (a text with an n-gram is at distance 0 from its
copy), rows that repeat a doc_id included; null doc_ids count as rows, and a component of these alone has a null id;
further columns are not looked at; an empty table gives no rows. N-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import kernels as K
from ledgerlens.llm.common import HOT, cut, digest, discard, distinct_texts, meet, release
from ledgerlens.llm.components import components
from ledgerlens.llm.repeats import joined

#: Fixed by the contract: words in an n-gram, and the similarity of a link: 100 * intersection >= 75 * union.
N = 5
#: The most n-grams that are told to every task as frequent, and how often one must occur in one task to be counted, or
#: in one in SAMPLED texts (a power of two; there, only of the lower LOW of hashes, as others are seldom early).
FREQUENT, OFTEN, SAMPLED, LOW = 500_000, 3, 8, 0.4
#: The greatest distance of a link. A region of LEAF documents is joined without further pivots, and so are all when
#: what can be met there is no more than WHOLE times the documents in regions.
FAR, LEAF, WHOLE = 0.25, 512, 4
#: Large corpora have their regions made and looked through in up to ROUNDS rounds, each of a share of the n-grams and of no less than SOME rows.
#: A round of comparing sends n-grams of pairs up to ROUND times a quarter of all that the texts have. A text that is in more than HUB of
#: the pairs is sent in several rounds.
ROUNDS, SOME, ROUND, HUB = 4, 4_000_000, 1, 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of each text in ascending order, all in a row, and the text of each."""
    buf, off = K.flat(texts)
    low = _LOWER[buf]
    starts, ends, first = K.spans(low, off)
    pre = K.prefix(K.word_hashes(low, starts, ends, 0), 0)
    h = K.window_hash(pre, n, 0)
    inside = K.windows_inside(first, n)
    text = np.searchsorted(first, inside, side="right") - 1
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n))
    h = np.concatenate([h[inside], K.span_hash(pre, first[few], first[few + 1], 0)])
    text = np.concatenate([text, few])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def frequent_grams(spark: SparkSession, texts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent n-grams in ascending order, and how often tasks have seen each. A hint for the order only."""

    low = K.U(LOW * 2**64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[np.ndarray] = []
        some: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            for found, least, unit in ((have, OFTEN, 0), (some, 1, 32)):
                h, n = np.unique(np.concatenate(found) if found else np.zeros(0, K.U), return_counts=True)
                found.clear()
                yield pa.RecordBatch.from_arrays([pa.array(h[n >= least].view(np.int64)), pa.array(n[n >= least].astype(np.int64) << unit)], names=["g", "n"])

        for whole in batches:
            for batch in K.pieces(whole):
                h, text = grams(batch.column(1))
                have.append(h)
                chosen = batch.column(0).to_numpy(zero_copy_only=False) % SAMPLED == 0
                some.append(h[chosen[text] & (h < low)])
                if sum(map(len, have)) > 4_000_000:
                    yield from out()
        yield from out()

    # in n the lower 32 bits are how often tasks have seen the n-gram, the upper ones how many sampled texts have it
    counted = texts.select("key", "text").mapInArrow(tally, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    often, sampled = F.col("n").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("n", 32)
    seen = cut(spark, counted.filter((often > 0) | (sampled >= OFTEN)).select("g", F.greatest(often, sampled * SAMPLED).alias("n")), "frequent")
    release(spark)
    classed = seen.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).collect()
    total, least = 0, 2**62
    for row in sorted(classed, key=lambda r: -r.b):
        total += row.k
        if total > most:
            break
        least = row.low
    found = seen.filter(F.col("n") >= least).toPandas()
    discard(spark, seen)
    g = found["g"].to_numpy(np.int64).view(K.U)
    order = np.argsort(g)
    return g[order], found["n"].to_numpy(np.int64)[order]


def early_grams(keys: int, texts: pa.Array, known: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of the first quarter of each text in the order of the corpus, their text and place; and each text's number of n-grams.

    Of a text with n of them these are n - ceil(3n/4) + 1: a partner has 3/4 in common, so the first common one is among them.
    """
    h, text = grams(texts)
    often = np.zeros(len(h), np.int64)
    if len(known) and len(h):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        often = np.where(known[at] == h, count[at], 0)
    order = np.lexsort((h, often, text))
    h, text = h[order], text[order]
    n = np.bincount(text, minlength=keys)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    early = place <= n[text] - -(-3 * n[text] // 4)
    return h[early], text[early], place[early], n


def regions(texts: DataFrame, frequent) -> DataFrame:
    """g, key, at (number of n-grams << 32 | place of g): each text in the regions of the first quarter of its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.pieces(whole):
                h, text, place, n = early_grams(batch.num_rows, batch.column(1), *frequent.value)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(n[text] << 32 | place)], names=["g", "key", "at"])

    return texts.select("key", "text").mapInArrow(run, "g long, key long, at long")


def unpacked(at: str) -> list[Column]:
    return [F.shiftright(at, 32).cast("int").alias("n"), F.col(at).bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place")]


def possible(a: str, b: str) -> Column:
    """Whether the n-grams from the shared one on can be enough: intersection >= 3/7 of the sizes' sum."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.place"), F.col(f"{b}.n") - F.col(f"{b}.place"))
    return 7 * left >= 3 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _lists(first: np.ndarray, h: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h))


def plausible(spark: SparkSession, texts: DataFrame, pairs: DataFrame, frequent, budget: int, name: str) -> DataFrame:
    """a, b, total, ok: whether enough of the first quarters' n-grams is common for a link.

    All that two texts have in common is in both first quarters, or in the later part of the one whose first quarter ends earlier.
    N-grams are looked at by 16 bits. Where lost of a text's n-grams have the same 16 bits as others of it, at most that many
    common ones are not seen, so what is seen and the smaller of both losses is no less than what is common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.pieces(whole):
                h, text, _, n = early_grams(batch.num_rows, batch.column(1), *frequent.value)
                short = np.unique(text.astype(K.U) << K.U(16) | h & K.U(0xFFFF))
                first = np.searchsorted(short >> K.U(16), np.arange(batch.num_rows + 1, dtype=K.U))
                later = n - np.bincount(text, minlength=batch.num_rows)
                lost = n - later - np.diff(first)
                lists = _lists(first, short.astype(np.uint16).view(np.int16))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(later, pa.int64()), pa.array(lost, pa.int64()), lists], names=["key", "later", "lost", "early"])

    early = cut(spark, joined(texts, _keys(pairs)).select("key", "text").mapInArrow(run, "key long, later long, lost long, early array<short>"), f"{name}-early")
    most = F.size(F.array_intersect("x.early", "y.early")) + F.least("x.lost", "y.lost") + F.greatest("x.later", "y.later")
    judged = []
    for some in dealt(pairs, budget):
        both = _both(some, early, "later", "lost", "early")
        judged.append(cut(spark, both.select("a", "b", "total", (7 * most >= 3 * F.col("total")).alias("ok")), f"{name}-plausible"))
        release(spark)
    discard(spark, early)
    return functools.reduce(DataFrame.unionByName, judged)


def dealt(pairs: DataFrame, budget: int, *by: str) -> list[DataFrame]:
    """The pairs in parts whose texts have about budget n-grams each, so that what is sent at a time does not grow with the number of pairs."""
    every = pairs.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    k = max(1, -(-every // max(budget, 1)))
    return [pairs.filter(F.pmod(F.xxhash64(*(by or ("a", "b"))), F.lit(k)) == i) for i in range(k)] if k > 1 else [pairs]


def _keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def _both(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """pairs with x and y, the columns of a and b."""
    first = pairs.join(rows.select(F.col("key").alias("a"), F.struct(*columns).alias("x")), "a")
    return first.join(rows.select(F.col("key").alias("b"), F.struct(*columns).alias("y")), "b")


def oriented(spark: SparkSession, pairs: DataFrame, name: str) -> DataFrame:
    """a, b, total, sent, to, part: of each pair the text that is in more of the pairs is sent to the other one.

    So no text is sent more than some sqrt(2 * pairs) others: all these are in as many pairs as it is itself, or more. Pairs of one
    sent text have one part, up to HUB or so of them.
    """
    degree = cut(spark, pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), f"{name}-degree")
    both = pairs.join(degree.select(F.col("key").alias("a"), F.col("n").alias("x")), "a").join(degree.select(F.col("key").alias("b"), F.col("n").alias("y")), "b")
    more = F.col("x") >= F.col("y")
    turned = both.select("a", "b", "total", F.when(more, F.col("a")).otherwise(F.col("b")).alias("sent"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("to"), F.greatest("x", "y").alias("n"))
    piece = F.pmod(F.xxhash64("to"), F.ceil(F.col("n") / HUB))
    found = cut(spark, turned.select("a", "b", "total", "sent", "to", F.xxhash64("sent", piece).alias("part")), f"{name}-oriented")
    discard(spark, degree)
    return found


def compared(spark: SparkSession, texts: DataFrame, pairs: DataFrame, frequent, budget: int, name: str, exact: bool = False) -> DataFrame:
    """a, b, common, total (of n-grams): pairs that have been compared; common is null where a link is out of the question, unless exact.

    One text's n-grams are sent to the other, which stays in its bucket; only those of one part of the pairs are on disk at a time.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.pieces(whole):
                h, text = grams(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(np.searchsorted(text, np.arange(batch.num_rows + 1)), h.view(np.int64))], names=["sent", "grams"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.pieces(whole):
                h, text = grams(batch.column(4))
                first = np.searchsorted(text, np.arange(batch.num_rows + 1))
                got = batch.column(3)
                other, at = got.flatten().to_numpy().view(K.U), np.concatenate([[0], np.cumsum(np.diff(got.offsets.to_numpy()))])
                n = [_in_both(h[first[i] : first[i + 1]], other[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), batch.column(2)], names=["a", "b", "common", "total"])

    close = pairs
    if not exact:
        # of a pair's n-grams 16 bits each of a quarter are sent
        judged = plausible(spark, texts, pairs, frequent, 16 * budget, name)
        close = judged.filter("ok").select("a", "b", "total")
    release(spark)
    close, done = oriented(spark, close, name), []
    for some in dealt(close, budget, "part"):
        sent = cut(spark, joined(texts, some.select(F.col("sent").alias("key")).distinct()).select("key", "text").mapInArrow(sets, "sent long, grams array<long>"), f"{name}-sets")
        lists = some.join(sent, "sent").select(F.col("to").alias("key"), "a", "b", "total", "grams")
        done.append(cut(spark, joined(texts, lists).select("a", "b", "total", "grams", "text").mapInArrow(common, "a long, b long, common int, total int"), f"{name}-compared"))
        release(spark)
        discard(spark, sent)
    discard(spark, close)
    if not exact:
        done.append(judged.filter("not ok").select("a", "b", F.lit(None).cast("int").alias("common"), "total"))
    return functools.reduce(DataFrame.unionByName, done)


def _in_both(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sets in ascending order have in common."""
    if not len(x) or not len(y):
        return 0
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    return int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))


def linked() -> Column:
    return 100 * F.col("common").cast("long") >= 75 * (F.col("total") - F.col("common")).cast("long")


def _headed(spark: SparkSession, rows: DataFrame, hot: DataFrame) -> DataFrame:
    """g, key, at, p (place, key, at of the first pivot), least (size): rows of regions of two or more.

    The first pivot has its n-gram earliest: it can be near to most. Regions of the n-grams in hot (a broadcast table) are
    summed up in every task first; all others are small enough for one task each.
    """
    head = F.min(F.struct(F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"), "key", "at"))
    least, many, region = F.min(F.shiftright("at", 32)), F.count(F.lit(1)), Window.partitionBy("g")
    few = rows.join(F.broadcast(hot), "g", "left_anti").withColumn("p", head.over(region)).withColumn("least", least.over(region)).withColumn("many", many.over(region)).filter("many > 1").drop("many")
    heads = rows.join(F.broadcast(hot), "g", "left_semi").groupBy("g").agg(head.alias("p"), least.alias("least"), many.alias("many")).filter("many > 1").drop("many")
    return few.unionByName(rows.join(F.broadcast(cut(spark, heads, "heads")), "g"))


def links(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """v, c: the component of every text that is linked with a different one."""
    known_grams = frequent_grams(spark, texts)
    frequent = spark.sparkContext.broadcast(known_grams)
    rows = cut(spark, regions(texts, frequent), "early")
    many = rows.count()
    budget, rounds = int(ROUND * many), min(ROUNDS, 1 + many // SOME)
    hot = known_grams[0][known_grams[1] * HOT > texts.count()].view(np.int64)  # FREQUENT at most
    hot = spark.createDataFrame([(int(g),) for g in hot], "g long")
    made = []
    for i in range(rounds):
        own = F.pmod("g", F.lit(rounds)) == i
        some = _headed(spark, rows.filter(own), hot.filter(own)).select("g", "key", *unpacked("at"), F.struct("p.key", *unpacked("p.at")).alias("p"), "least")
        # who cannot be near to the smallest there can be near to nobody there
        made.append(cut(spark, some.filter(7 * (F.col("n") - F.col("place")) >= 3 * (F.col("n") + F.col("least"))).drop("least"), f"regions{i}"))
        release(spark)
    shared = functools.reduce(DataFrame.unionByName, made)
    discard(spark, rows)
    near = shared.select(F.struct("key", "n", "place").alias("m"), "p").filter(F.col("m.key") != F.col("p.key"))
    pairs = cut(spark, near.filter(possible("m", "p")).select(*_pair("p", "m")).distinct(), "pairs")
    release(spark)
    known = cut(spark, compared(spark, texts, pairs, frequent, budget, "star"), "known")
    release(spark)
    # the first pivot has been compared with all that it can be near to
    open_ = shared.filter(F.col("key") != F.col("p.key")).select("g", "key", "n", "place", F.col("p.key").alias("p"), F.lit(2).alias("pivots"))
    size = members = shared.count()
    for step in range(1, 1000):
        found = cut(spark, components(spark, known.filter(linked()).select("a", "b"), f"found{step}"), f"found{step}")
        open_ = opened(spark, open_, found, known, min(ROUNDS, 1 + members // SOME), step)
        if step == 1:
            discard(spark, *made)
        # members of a region's other components, summed up: twice the pairs that joining all of them whole can give
        left, members = open_.agg(F.coalesce(F.sum(F.col("m") - F.col("own")), F.lit(0)), F.count(F.lit(1))).first()
        if not left:
            return found
        small = F.lit(True) if left <= WHOLE * size else F.col("m") <= LEAF
        leaf, large = open_.filter(small), open_.filter(~small)
        pairs = cut(spark, _met(leaf).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti"), f"pairs{step}")
        release(spark)
        more = compared(spark, texts, pairs, frequent, budget, f"round{step}")
        if large.isEmpty():
            known, open_ = cut(spark, known.unionByName(more), f"known{step}"), large.select("g", "key", "n", "place", "p", "pivots")
        else:
            order = Window.partitionBy("g").orderBy("own", F.xxhash64("key", F.lit(step)), "key")
            chosen = cut(spark, large.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("pivots")).select("g", F.struct("key", "n").alias("q"), F.col("key").alias("pivot"), "rank"), f"pivots{step}")
            asked = large.select("g", F.struct("key", "n").alias("m")).join(chosen, "g").filter(F.col("m.key") != F.col("pivot")).select(*_pair("m", "q")).distinct()
            asked = asked.join(known.filter(F.col("common").isNotNull()).select("a", "b"), ["a", "b"], "left_anti")
            exact = compared(spark, texts, cut(spark, asked, f"asked{step}"), frequent, budget, f"pivots{step}", exact=True)
            known = cut(spark, known.unionByName(more).unionByName(exact), f"known{step}")
            open_ = cut(spark, voronoi(large, chosen, known), f"cells{step}")
        release(spark)
    raise RuntimeError("regions do not become smaller")


def opened(spark: SparkSession, members: DataFrame, found: DataFrame, known: DataFrame, rounds: int, step: int) -> DataFrame:
    """The members of regions that are in more than one component, with c, own and m (rows of the component there and of the region), and d from the first pivot."""
    done = []
    for i in range(rounds):
        # not by the bits that the regions were made by
        some = members.filter(F.pmod(F.xxhash64("g"), F.lit(rounds)) == i)
        labelled = cut(spark, some.join(found.select(F.col("v").alias("key"), "c"), "key", "left").withColumn("c", F.coalesce("c", "key")), f"labelled{step}")
        share = cut(spark, labelled.groupBy("g", "c").agg(F.count(F.lit(1)).alias("own")), f"share{step}")
        mixed = share.groupBy("g").agg(F.sum("own").alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
        both = cut(spark, share.join(mixed, "g").select("g", "c", "own", "m", F.col("own").alias("n")), f"mixed{step}")
        done.append(cut(spark, meet(labelled, both, ["g", "c"]).join(_distances(known), ["p", "key"], "left"), f"open{step}"))
        release(spark)
        discard(spark, labelled, share, both)
    return functools.reduce(DataFrame.unionByName, done)


def voronoi(large: DataFrame, chosen: DataFrame, known: DataFrame) -> DataFrame:
    """g, key, n, place, p, pivots: the members of regions, but for the pivots, in the regions that the pivots create.

    A member goes to its nearest pivot, the first of equals, and to each one before it that is no more than 2 * FAR
    farther. For if x is nearest to i, y to j < i, and d(x, y) <= FAR: d(x, j) <= d(y, j) + FAR <= d(y, i) + FAR <= d(x, i) + 2 FAR.
    A region that does not come out in smaller ones stays, with twice the number of pivots to be tried next.
    """
    member = ["g", "key", "n", "place", "p", "pivots"]
    others = large.select(*member).join(chosen.select("g", F.col("pivot").alias("key")), ["g", "key"], "left_anti")
    to = others.join(chosen, "g").join(_distances(known).select(F.col("p").alias("pivot"), "key", "d"), ["pivot", "key"])
    nearest = to.groupBy(*member).agg(F.min(F.struct("d", "rank")).alias("near"), F.collect_list(F.struct("d", "rank")).alias("all"))
    inside = F.filter("all", lambda x: (x["rank"] == F.col("near.rank")) | (x["rank"] < F.col("near.rank")) & (x["d"] <= F.col("near.d") + 2 * FAR + 1e-9))
    cells = nearest.select(*member, F.explode(F.transform(inside, lambda x: x["rank"])).alias("cell"))
    counts = cells.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("k")).groupBy("g").agg(F.max("k").alias("most"), F.sum("k").alias("every"))
    helped = counts.join(others.groupBy("g").agg(F.count(F.lit(1)).alias("m")), "g").filter((4 * F.col("most") <= 3 * F.col("m")) & (2 * F.col("every") <= 3 * F.col("m"))).select("g")
    smaller = cells.join(helped, "g", "left_semi").select(F.xxhash64("g", "cell").alias("g"), "key", "n", "place", "p", F.lit(2).alias("pivots"))
    return smaller.unionByName(others.join(helped, "g", "left_anti").withColumn("pivots", 2 * F.col("pivots")))


def _pair(x: str, y: str) -> list[Column]:
    """a, b, total of n-grams."""
    return [F.least(f"{x}.key", f"{y}.key").alias("a"), F.greatest(f"{x}.key", f"{y}.key").alias("b"), (F.col(f"{x}.n") + F.col(f"{y}.n")).alias("total")]


def _distance() -> Column:
    return 1 - F.col("common") / (F.col("total") - F.col("common"))


def _distances(known: DataFrame) -> DataFrame:
    """p, key, d: both ways, for all pairs whose distance is known."""
    exact = known.filter(F.col("common").isNotNull()).select("a", "b", _distance().alias("d")).dropDuplicates(["a", "b"])
    return exact.select(F.col("a").alias("p"), F.col("b").alias("key"), "d").unionByName(exact.select(F.col("b").alias("p"), F.col("a").alias("key"), "d"))


def _met(rows: DataFrame) -> DataFrame:
    """a, b: members of one region in different components that can be near each other."""
    window = F.coalesce(F.abs(F.col("x.d") - F.col("y.d")) <= FAR + 1e-9, F.lit(True))
    met = rows.alias("x").join(rows.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.key") < F.col("y.key")) & possible("x", "y") & window)
    return met.select(*_pair("x", "y"))


def grouped(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n_shingles, c (of the component) for every row of docs."""
    texts = distinct_texts(spark, docs, "grams")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.pieces(whole):
                n = np.bincount(grams(batch.column(1))[1], minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["key", "n_shingles"])

    size = texts.select("key", "text").mapInArrow(sizes, "key long, n_shingles long")
    sized = size.join(links(spark, texts).select(F.col("v").alias("key"), "c"), "key", "left").select("key", "n_shingles", F.coalesce("c", "key").alias("c"))
    rows = cut(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    of_text = cut(spark, sized.join(texts.select("key", "digest"), "key").join(copies, "digest"), "groups")
    release(spark)
    discard(spark, texts)
    return cut(spark, meet(rows, of_text, ["digest"]), "grouped")


def jaccard_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows = grouped(spark, docs)
    least = cut(spark, rows.filter("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    of_none = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return meet(rows.filter("n_shingles > 0"), least, ["c"]).select("doc_id", "n_shingles", "component_id").unionByName(of_none)


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, of each group of linked ones only one of the least doc_id; rows without n-grams all stay."""
    rows = grouped(spark, docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    stay = rows.filter("n_shingles > 0").groupBy("c").agg(F.min(order).alias("r")).select("r.*")
    # of a group's rows with its least doc_id and text, the one that is met first in a task, and of the tasks' one
    own = docs.select(digest(F.col("text")).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.struct(*docs.columns).alias("row"))
    known = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "digest"]
    found = own.select(*known, "row").join(stay.select(*known), ["id", "none", "digest"], "left_semi")
    kept = found.groupBy("id", "none", "digest").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return kept.unionByName(docs.filter(~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")))
