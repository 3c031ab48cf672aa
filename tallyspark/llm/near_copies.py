"""Near copies by word shingles: operator 8's index of SimHashes, an exact way for the pairs beyond it.  The pipeline's stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, forget, settled, stored
from .decontamination import RADIUS
from .set_links import groups, linked, nodes_of, sets_of, sketches, small_batches
from .simhash_dedup import first_of, links

SHINGLE, SIMILARITY = 5, 0.8


def indexed(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of `nodes` that connect those whose SimHashes `fp` differ in at most two bits, by operator 8's index of byte
    positions: posting lists, the tally of shared bytes, the bits.  Nodes of one SimHash meet its smallest."""
    one = stored(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("one"), F.count("*").alias("many")))
    equal = nodes.where("n > 0").join(one.where("many > 1"), "fp").where("node <> one").select(F.col("one").alias("a"), F.col("node").alias("b"))
    end = lambda name: one.select(F.col("fp").alias(f"{name}_fp"), F.col("one").alias(name))
    found = links(one.select(F.col("fp").alias("__fp"))).toDF("a_fp", "b_fp")
    return equal.union(found.join(end("a"), "a_fp").join(end("b"), "b_fp").select("a", "b"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near copies, that of the smallest id; the columns of `docs`.

    Near copies are texts whose sets of `shingle` words (A-Z lower-cased; fewer words: all of them) have a
    Jaccard similarity of `similarity` or more; groups are what these links connect.  Candidates are the pairs that the
    byte-position index of the SimHashes links (see `indexed`).  At the similarity most pairs differ in more bits than any index of
    byte positions allows, so those that share a value that their sketches retain are candidates, too (see `set_links.linked`), but for
    those whose SimHashes differ in over `radius` bits: at 0.8 a pair in about a million lies beyond 24.  The whole sets decide on all.  Null, empty and blank texts are
    one group.  Rows that repeat an id are one document: the smallest text stays.  A group
    whose ids are all null keeps one row for each distinct text; where one does, rows with a null id of other groups stay, too, one for each text.  Long texts are worked on whole, one at a time.  An empty
    table gives an empty one.  Other columns, whatever their names, are kept.
    """
    c = Carried(docs)
    key, text = c.col(id_col), c.col(text_col)
    with small_batches(docs.sparkSession):
        nodes = nodes_of(sketches(c.df, {"id": key}, text, shingle, bits=True), similarity)
        first = settled(lambda: groups(nodes, linked(nodes, sets_of(c.df, key, text, nodes, shingle), similarity, radius, near=indexed(nodes))).select(F.col("first").alias("__first")).distinct())
        forget(nodes)
    return first_of(c, key, text, first)
