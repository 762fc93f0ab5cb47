"""Sparse evidence: balanced interleave of hits, citations of hits, support counts, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import with_citations
from ..functions.text import citation_kind, clean, hit_text


def balanced(hits: DataFrame, limit: int, by: str = "query_id") -> DataFrame:
    """Interleaves law and court hits 1 : 2, up to ``limit`` a query.

    hits: (by, kind law or court, position from 1, ...). The i-th law goes to
    turn i at place 0, the j-th court to turn j div 2 at place 1 + j mod 2, and
    turns are filled from whichever side still has hits. Adds hit_pos.
    """
    i = F.col("position") - 1
    law = F.col("kind") == "law"
    turn, place = F.when(law, i).otherwise(F.floor(i / 2)), F.when(law, 0).otherwise(1 + i % 2)
    rank = F.row_number().over(Window.partitionBy(by).orderBy("__turn", "__place"))
    return hits.withColumn("__turn", turn.cast("long")).withColumn("__place", place.cast("int")).withColumn("hit_pos", rank).where(F.col("hit_pos") <= limit).drop("__turn", "__place")


def hit_citations(hits: DataFrame) -> DataFrame:
    """Adds citations: those found in a hit's citation, title, source and text, and the declared one; sorted."""
    said = with_citations(hits.withColumn("__text", hit_text(F.col("citation"), F.col("title"), F.col("source"), F.col("text"))), "__text", "__found")
    declared = F.filter(F.array(clean(F.col("citation"))), lambda c: c != "")
    every = F.array_union(F.array_union(F.col("__found.laws"), F.col("__found.courts")), declared)
    return said.withColumn("citations", F.array_sort(every)).drop("__text", "__found")


def support_counts(cited: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_id, citation, support): in how many hits a citation is; hits may repeat it.

    cited: (query_id, hit_pos, citation) long. The vocabulary (citation) is a
    left-semi join; Spark chooses its form by the sides' sizes.
    """
    rows = cited if vocabulary is None else cited.join(vocabulary.select("citation"), "citation", "left_semi")
    return rows.groupBy("query_id", "citation").agg(F.count_distinct("hit_pos").alias("support"))


def sparse_support(hits: DataFrame, vocabulary: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Support counts of the balanced hits, and the citations outside the vocabulary (query_id, hit_pos, citation)."""
    long = hit_citations(balanced(hits, limit)).select("query_id", "hit_pos", F.explode("citations").alias("citation"))
    return support_counts(long, vocabulary), long.join(vocabulary.select("citation"), "citation", "left_anti").select("query_id", "hit_pos", "citation")


def discovered_citations(hits: DataFrame, limit: int) -> DataFrame:
    """Distinct citations that balanced hits may support."""
    return hit_citations(balanced(hits, limit)).select(F.explode("citations").alias("citation")).distinct()


def vocabulary(laws: DataFrame, courts: DataFrame) -> DataFrame:
    """(citation, kind) of the two vocabularies; blanks go."""
    own = lambda df, kind: df.select(clean(F.col("citation")).alias("citation")).where("citation <> ''").distinct().withColumn("kind", F.lit(kind))
    return own(laws, "law").unionByName(own(courts, "court"))


def vocabulary_overlap(entries: DataFrame) -> DataFrame:
    """Violations: citations that are of both kinds."""
    both = entries.groupBy("citation").agg(F.count_distinct("kind").alias("n")).where("n > 1")
    return both.select(F.lit("one kind").alias("rule"), F.col("citation").alias("key"), F.lit("law and court").alias("message"))


def targeted_vocabulary(laws: DataFrame, courts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Vocabulary entries among the candidates; a citation of both kinds is a law."""
    found = vocabulary(laws, courts).join(candidates.select("citation").distinct(), "citation", "left_semi")
    return found.groupBy("citation").agg(F.max("kind").alias("kind"))  # law sorts after court


def corpus_vocabulary(documents: DataFrame) -> DataFrame:
    """(citation, kind) of all documents' citation arrays, kind by prefix."""
    return documents.select(F.explode("citations").alias("citation")).distinct().withColumn("kind", citation_kind(F.col("citation")))


def outside(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows whose citation is not in the vocabulary."""
    return cited.join(entries.select("citation"), "citation", "left_anti")


def kinds(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds kind; null marks a citation that the vocabulary lacks."""
    return cited.join(entries.select("citation", "kind"), "citation", "left")


def required(citations: Column) -> Column:
    """A list as it must be: sorted and distinct."""
    return F.array_sort(F.array_distinct(citations))
