"""Links between sequences and fragments: expansion, decompression and their statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs


def link_rows(compressed: DataFrame) -> DataFrame:
    """``seq_id, ord, coarse_id, c_start, c_end, diff`` in concatenation order."""
    rows = compressed.select("seq_id", F.posexplode("links").alias("ord", "link"))
    return rows.select("seq_id", "ord", "link.coarse_id", "link.c_start", "link.c_end", "link.diff")


def coarse_links(compressed: DataFrame) -> DataFrame:
    """The inverse links: a view of the compressed table, never stored."""
    return link_rows(compressed).select("coarse_id", F.col("seq_id").alias("org_seq_id"), "c_start", "c_end")


def links_per_coarse(coarse: DataFrame, compressed: DataFrame) -> DataFrame:
    """Number of links of every fragment, 0 included."""
    n = coarse_links(compressed).groupBy("coarse_id").agg(F.count("*").alias("n"))
    return coarse.select("coarse_id").join(n, "coarse_id", "left").select("coarse_id", F.coalesce("n", F.lit(0)).alias("n_links"))


def expand_hits(hits: DataFrame, links: DataFrame, max_evalue: float = 5.0) -> DataFrame:
    """Accepted hits joined to the links that their interval touches: ``query_id, org_seq_id, coarse_id, evalue``.

    ``hits(query_id, coarse_id, hit_start, hit_end, evalue)``. An equi-join by fragment with the overlap as a residual
    condition; the e-value filter comes first. A hit that starts behind its end is turned round.
    """
    h = hits.where(F.col("evalue") <= max_evalue).select("query_id", "coarse_id", F.least("hit_start", "hit_end").alias("hs"), F.greatest("hit_start", "hit_end").alias("he"), "evalue")
    return h.join(links, "coarse_id").where(exprs.interval_overlap(F.col("hs"), F.col("he"), F.col("c_start"), F.col("c_end"))).select("query_id", "org_seq_id", "coarse_id", "evalue")


def expand_whole(ids: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct originals that any part of the fragments ``ids(coarse_id)`` went into."""
    own = ids.select(F.col("coarse_id").alias("want")).distinct()
    return links.join(own, F.col("coarse_id") == F.col("want"), "left_semi").select("org_seq_id").distinct()


def first_match(candidates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first candidate of each key in order: as a rank filter, which Spark cuts before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return candidates.withColumn("match_rank", rank).where("match_rank = 1").drop("match_rank")


def distinct_originals(expanded: DataFrame) -> DataFrame:
    """Each reached sequence once, with its best e-value."""
    return expanded.groupBy("org_seq_id").agg(F.min("evalue").alias("evalue"))


def expand_both(hits: DataFrame, links: DataFrame, query_links: DataFrame, max_evalue: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Distinct original targets and queries when both sides are compressed; ``hits.query_id`` is a query fragment."""
    targets = distinct_originals(expand_hits(hits, links, max_evalue))
    h = hits.where(F.col("evalue") <= max_evalue).select(F.col("query_id").cast("long").alias("coarse_id"), "q_start", "q_end", "evalue")
    q = h.join(query_links, "coarse_id").where(exprs.interval_overlap(F.least("q_start", "q_end"), F.greatest("q_start", "q_end"), F.col("c_start"), F.col("c_end")))
    return targets, q.groupBy("org_seq_id").agg(F.min("evalue").alias("evalue"))


def reachable(originals: DataFrame, ids: DataFrame) -> DataFrame:
    return originals.join(ids.select(F.col("org_seq_id").alias("reach_id")), F.col("seq_id") == F.col("reach_id"), "left_semi")


def decompress(compressed: DataFrame, coarse: DataFrame, strict: bool = True) -> DataFrame:
    """``seq_id, name, residues``: every link's stretch of its fragment, edited, joined in order.

    A link to an unknown fragment is an error if ``strict``. Sequences without links are empty.
    """
    c = coarse.select(F.col("coarse_id").alias("frag_id"), F.col("residues").alias("frag"))
    rows = link_rows(compressed).join(c, F.col("coarse_id") == F.col("frag_id"), "left" if strict else "inner")
    if strict:
        frag = F.when(F.col("frag").isNull(), F.raise_error(F.concat(F.lit("no such fragment: "), F.col("coarse_id").cast("string")))).otherwise(F.col("frag"))
    else:
        frag = F.col("frag")
    piece = exprs.apply_script(F.substring(frag, F.col("c_start") + 1, F.col("c_end") - F.col("c_start")), F.col("diff"))
    joined = rows.select("seq_id", "ord", piece.alias("piece")).groupBy("seq_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "").alias("residues"))
    return compressed.select("seq_id", "name").join(joined, "seq_id", "left").select("seq_id", "name", F.coalesce("residues", F.lit("")).alias("residues"))


def database_stats(sequences: DataFrame) -> DataFrame:
    return sequences.agg(F.count("*").alias("n_sequences"), F.coalesce(F.sum(F.length("residues").cast("long")), F.lit(0)).alias("n_residues"), F.coalesce(F.max(F.length("residues")), F.lit(0)).alias("max_length"))


def compression_ratio(sequences: DataFrame, coarse: DataFrame) -> DataFrame:
    """Fragment residues as percent of original residues (residues only, no headers or newlines)."""
    n = sequences.agg(F.sum(F.length("residues").cast("long")).alias("original"))
    m = coarse.agg(F.sum(F.length("residues").cast("long")).alias("coarse"), F.count("*").alias("n_fragments"))
    return n.crossJoin(m).select("original", "coarse", "n_fragments", (100 * F.col("coarse") / F.col("original")).alias("ratio"))
