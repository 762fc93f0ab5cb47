"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

Every source has a target number of words. A document's whole copies, the
integer part of target / source size, are certain. The remaining words R are
drawn without replacement: a document of x words is included with probability

    p = min(1, c * class of x),    c such that the sum of p * x is R.

Documents with p = 1 are taken surely, the others ranked by

    (u / (1 - u)) / (p / (1 - p)),    u uniform from an md5 of doc_id and text,

and the ranking is cut where the words reach the rest, which fixes the sample's
size in words; one document that fits the last gap best is added. A size's
class is itself, for more than CLASS bits rounded down to so many, so a source
has some ten thousand classes however long its texts are.

The cut is found without sorting a source in one task: words are summed in
1024 x 1024 cells of the ranking (map-side combined), and only the cell that
holds the cut is ordered, by groups of equal rows. Of rows that share doc_id
and text as many are taken as fit.

Defined results: a null or empty text has size 0 and takes 0 words; a null
source is one source, ordered last; a null doc_id is an id like others; of
repeated rows the first by place in their table are taken; an empty table gives
an empty result; extra columns are not read, and ``mix`` keeps them whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex_bits, word_count, written

#: No document is taken more often than this.
MAX_COPIES = 3
#: Weights of the sources by code point, repeating.
WEIGHTS = (1, 2, 3)
#: Cells of each of the two levels of the ranking's histogram; bits of a size's class.
CELLS, CLASS = 1024, 12


def _source_key(source: Column) -> Column:
    """A key without nulls: null differs from every string."""
    return F.coalesce(F.concat(F.lit("+"), source), F.lit(""))


def _targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Targets of sources: shares by weight, stopped at ``cap`` times the size, excess reshared.

    Water filling in closed form: by ascending cap / weight, a source stops at
    its cap if its cap is within its share of what earlier sources left.
    """
    every = Window.orderBy("__ratio", "__rank")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("__rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    level = (
        weighed.withColumn("__ratio", (F.lit(cap) * F.col("__source_size")).cast("double") / F.col("__w"))
        .withColumn("__left", F.sum("__source_size").over(whole) - F.coalesce(F.sum(F.lit(cap) * F.col("__source_size")).over(before), F.lit(0)))
        .withColumn("__weight", F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .withColumn("__level", F.col("__left").cast("double") / F.col("__weight"))
        .withColumn("__full", F.col("__ratio") <= F.col("__level"))
        .withColumn("__open", F.max(F.when(~F.col("__full"), F.col("__level"))).over(whole))
    )
    return level.withColumn(
        "__target",
        F.when(F.col("__full"), (F.lit(cap) * F.col("__source_size")).cast("double")).otherwise(F.col("__open") * F.col("__w")),
    ).select("__sk", "__source_size", "__target")


def size_class(size: Column) -> Column:
    """A size with all but its CLASS leading bits cleared."""
    low = F.greatest(F.lit(0), F.length(F.bin(size)) - CLASS)
    return F.call_function("shiftleft", F.call_function("shiftright", size, low), low)


def _factors(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds to each source __c and __sure: p is c times the size's class, and 1 from the class __sure on.

    From the greatest class down, a class is sure if, with all greater ones
    sure, c times it is 1 at least.
    """
    x = F.col("__size").cast("decimal(38,0)")
    classes = sized.where("__size > 0").groupBy("__sk", F.col("__class")).agg(F.sum(x).alias("w"), F.sum(x * F.col("__class")).alias("q"))
    down = Window.partitionBy("__sk").orderBy(F.desc("__class")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__sk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("decimal(38,0)")
    tried = (
        classes.join(sources.select("__sk", "__rest"), "__sk")
        .withColumn("__above", F.coalesce(F.sum("w").over(down), none))
        .withColumn("__q", F.sum("q").over(whole) - F.coalesce(F.sum("q").over(down), none))
        .withColumn("__c", (F.col("__rest") - F.col("__above").cast("double")) / F.col("__q").cast("double"))
    )
    full = F.col("__c") * F.col("__class") >= 1.0
    facts = tried.groupBy("__sk").agg(F.min(F.when(full, F.col("__class"))).alias("__sure"), F.max(F.when(~full, F.struct("__class", "__c"))).alias("o"), F.sum(F.when(full, F.col("w"))).cast("long").alias("__sure_words"))
    return sources.join(facts.select("__sk", "__sure", F.greatest(F.col("o.__c"), F.lit(0.0)).alias("__c"), F.coalesce("__sure_words", F.lit(0)).alias("__sure_words")), "__sk", "left")


def _place(df: DataFrame) -> DataFrame:
    """Adds __in, whether a row is surely taken, and __k, the rank of others: the cell number of the Pareto variable."""
    p = F.col("__c") * F.col("__class")
    u = (F.col("__h") + 0.5) / 4503599627370496.0
    q = (u / (1 - u)) / (p / (1 - p))
    sure = F.coalesce(F.col("__class") >= F.col("__sure"), F.lit(False)) & (F.col("__size") > 0)
    return df.withColumn("__in", sure).withColumn("__k", F.when((F.col("__size") > 0) & ~sure & (F.col("__c") > 0), F.floor(q / (1 + q) * 1099511627776.0)))


def _sized(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The documents' slim rows; __row is a place in their table, __doc (if ``whole``) the row itself."""
    text = docs["text"].cast("string")
    mark = F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return docs.select(
        docs["doc_id"].alias("__id"), docs["source"].cast("string").alias("source"), _source_key(docs["source"].cast("string")).alias("__sk"),
        word_count(text).alias("__size"), hex_bits(F.md5(mark.cast("binary")), 1, 13).alias("__h"), F.monotonically_increasing_id().alias("__row"),
        *([F.struct("*").alias("__doc")] if whole else []),
    ).withColumn("__class", size_class(F.col("__size")))


def _plan(slim: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """One row a source: its size, target, whole copies, __sure, __c, and the ranks before which rows are taken and of which parts are.

    __parts: up to two of (k, h, take, rows), groups of equal rows of which
    ``take`` are taken.
    """
    sizes = slim.groupBy("__sk", "source").agg(F.sum("__size").alias("__source_size"))
    sources = written(
        _targets(sizes, weights, cap)
        .withColumn("__whole", F.when(F.col("__source_size") > 0, F.least(F.lit(cap), F.floor(F.col("__target") / F.col("__source_size")))).otherwise(0).cast("long"))
        .withColumn("__rest", F.col("__target") - (F.col("__whole") * F.col("__source_size")).cast("double")),
        "mix-sources",
    )
    sources = written(_factors(slim, sources).withColumn("__left", F.col("__rest") - F.col("__sure_words")), "mix-factors")
    rows = _place(slim.drop("source").join(sources, "__sk")).where(F.col("__k").isNotNull())

    def cut(cells: DataFrame) -> DataFrame:
        """The first cell of each source at whose end the words exceed the rest, and the words before it."""
        upto = Window.partitionBy("__sk").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
        over = cells.withColumn("__upto", F.sum("__words").over(upto)).where(F.col("__base") + F.col("__upto") > F.col("__left"))
        first = F.min_by(F.struct("__cell", (F.col("__base") + F.col("__upto") - F.col("__words")).alias("base")), "__cell")
        return written(over.groupBy("__sk").agg(first.alias("c")).select("__sk", F.col("c.__cell").alias("__cut"), F.col("c.base").alias("__base")), "mix-cut")

    first = rows.groupBy("__sk", F.shiftright("__k", 30).alias("__cell")).agg(F.sum("__size").alias("__words"), F.first("__left").alias("__left")).withColumn("__base", F.lit(0).cast("long"))
    one = cut(first)
    inner = rows.join(one, "__sk").where(F.shiftright("__k", 30) == F.col("__cut"))
    two = cut(inner.groupBy("__sk", F.shiftright("__k", 20).alias("__cell")).agg(F.sum("__size").alias("__words"), F.first("__left").alias("__left"), F.first("__base").alias("__base")))
    # Equal rows are one group of the last cell.
    cell = rows.join(two, "__sk").where(F.shiftright("__k", 20) == F.col("__cut"))
    groups = cell.groupBy("__sk", "__k", "__h").agg(F.first("__size").alias("__size"), F.count(F.lit(1)).alias("__m"), F.first("__base").alias("__base"), F.first("__left").alias("__left"))
    before = Window.partitionBy("__sk").orderBy("__k", "__h").rowsBetween(Window.unboundedPreceding, -1)
    last = groups.withColumn("__before", F.col("__base") + F.coalesce(F.sum(F.col("__size") * F.col("__m")).over(before), F.lit(0)))
    over = last.where(F.col("__before") + F.col("__size") * F.col("__m") > F.col("__left"))
    fits = F.greatest(F.lit(0), F.floor((F.col("__left") - F.col("__before")) / F.col("__size"))).cast("long")
    stop = over.groupBy("__sk").agg(F.min_by(F.struct(F.col("__k").alias("k"), F.col("__h").alias("h"), fits.alias("take"), F.col("__m").alias("rows"), (F.col("__left") - F.col("__before") - fits * F.col("__size")).alias("gap")), F.struct("__k", "__h")).alias("__stop"))
    edge = written(sources.join(stop, "__sk", "left").select("__sk", "__source_size", "__target", "__whole", "__sure", "__c", "__stop"), "mix-edge")
    rank = F.struct(F.col("__k").alias("k"), F.col("__h").alias("h"))
    at = F.struct(F.col("__stop.k").alias("k"), F.col("__stop.h").alias("h"))
    gap = F.col("__stop.gap")
    open_rows = _place(slim.drop("source").join(edge, "__sk")).where(F.col("__k").isNotNull() & ((rank > at) | ((rank == at) & (F.col("__stop.take") < F.col("__stop.rows")))))
    off = F.abs(gap - F.col("__size"))
    fill = open_rows.where(off < gap).groupBy("__sk", "__k", "__h").agg(F.min(off).alias("off"), F.count(F.lit(1)).alias("rows")).groupBy("__sk").agg(F.min(F.struct("off", F.col("__k").alias("k"), F.col("__h").alias("h"), "rows")).alias("f"))
    part = lambda k, h, take, n: F.struct(k.alias("k"), h.alias("h"), take.cast("long").alias("take"), n.cast("long").alias("rows"))
    same = F.coalesce((F.col("f.k") == F.col("__stop.k")) & (F.col("f.h") == F.col("__stop.h")), F.lit(False))
    found = F.array(
        F.when(F.col("__stop").isNotNull(), part(F.col("__stop.k"), F.col("__stop.h"), F.col("__stop.take") + same.cast("long"), F.col("__stop.rows"))),
        F.when(F.col("f").isNotNull() & ~same, part(F.col("f.k"), F.col("f.h"), F.lit(1), F.col("f.rows"))),
    )
    return written(edge.join(fill, "__sk", "left").withColumn("__parts", F.filter(found, lambda x: x.isNotNull() & (x["take"] > 0))).drop("f"), "mix-plan")


def _chosen(slim: DataFrame, plan: DataFrame) -> DataFrame | None:
    """(__row) of the rows taken of groups of equal rows that are taken in part; None without such a group.

    The first rows by place are taken: rows are counted by the partition that
    numbered them, and ordered within one such partition only.
    """
    parts = plan.select("__sk", "__sure", "__c", F.explode("__parts").alias("p")).where("p.take < p.rows")
    if parts.isEmpty():
        return None
    own = _place(slim.drop("source").join(parts, "__sk")).where("__k = p.k AND __h = p.h").select("__sk", "__k", "__h", "p.take", "__row", F.shiftright("__row", 33).alias("__block"))
    own = written(own, "mix-equal")
    group = ["__sk", "__k", "__h"]
    upto = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counted = own.groupBy(*group, "__block").agg(F.count(F.lit(1)).alias("n"), F.first("take").alias("take")).withColumn("__before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where("__before < take")
    rows = own.drop("take").join(written(counted, "mix-blocks"), [*group, "__block"])
    whole = rows.where("__before + n <= take").select("__row")
    place = F.row_number().over(Window.partitionBy(*group, "__block").orderBy("__row"))
    cut = rows.where("__before + n > take").withColumn("__i", place).where(F.col("__i") + F.col("__before") <= F.col("take")).select("__row")
    return written(whole.unionByName(cut), "mix-chosen")


def _copies(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """The slim rows with their source's facts and __copies."""
    chosen = _chosen(slim, plan)
    joined = _place(slim.join(plan, "__sk"))
    rank = F.struct(F.col("__k").alias("k"), F.col("__h").alias("h"))
    below = F.col("__k").isNotNull() & (F.col("__stop").isNull() | (rank < F.struct(F.col("__stop.k").alias("k"), F.col("__stop.h").alias("h"))))
    whole = F.exists("__parts", lambda x: (x["k"] == F.col("__k")) & (x["h"] == F.col("__h")) & (x["take"] == x["rows"]))
    extra = [F.col("__in"), below, F.coalesce(whole, F.lit(False))]
    if chosen is not None:
        joined = joined.join(chosen.withColumn("__chosen", F.lit(True)), "__row", "left")
        extra.append(F.coalesce("__chosen", F.lit(False)))
    taken = reduce(lambda a, b: a | b, extra)
    return joined.withColumn("__copies", F.when(F.col("__size") == 0, 0).otherwise(F.col("__whole") + taken.cast("long")).cast("long"))


def mix_table(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    slim = written(_sized(docs), "mix-rows")
    return _copies(slim, _plan(slim, weights, cap)).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of ``docs``.

    Documents without words count for no target; they are kept once.
    """
    slim = written(_sized(docs), "mix-rows")
    plan = _plan(slim, weights, cap)
    rows = _sized(docs, whole=True)
    if not plan.where("exists(__parts, p -> p.take < p.rows)").isEmpty():
        # Places of rows decide, so the documents are written with theirs.
        rows = written(rows, "mix-documents")
    times = F.when(F.col("__size") == 0, 1).otherwise(F.col("__copies")).cast("int")
    return _copies(rows.drop("source"), plan).withColumn("__i", F.explode(F.array_repeat(F.lit(True), times))).select("__doc.*")
