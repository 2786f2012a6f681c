"""Registry of the queries on training data: name -> callable (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graftline.llm.bpe import decode_table, encode_table
from graftline.llm.clusters import Clusters
from graftline.llm.mix import Mix
from graftline.llm.neighbours import nearest, nearest_pairs
from graftline.llm.quantiles import merge_sketches, read_sketches, sketch_table
from graftline.llm.split import split_table
from graftline.llm.topn import cluster, scan_report, top_n_per_group
from graftline.operators.pairs import exact_neighbours
from graftline.session import materialize, scratch_path, table


def usable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the collision log with two different ends and a distance from 0 to 2."""
    log = table(spark, sf_dir, "glove_sampl")
    ends = F.col("edge1").isNotNull() & F.col("edge2").isNotNull() & (F.col("edge1") != F.col("edge2"))
    return log.filter(ends & F.col("distance").between(0.0, 2.0)).withColumn("distance", F.col("distance") + F.lit(0.0))


def p1_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest items of every edge1, with distance and rank."""
    return top_n_per_group(usable_lines(spark, sf_dir), "edge1", "edge2", "distance", 10, largest=False)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest items of every edge1."""
    return p1_topn(spark, sf_dir).select("edge1", "edge2")


def p1_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups that the search for these items reads and skips."""
    path = scratch_path(spark, "clustered")
    cluster(usable_lines(spark, sf_dir), "edge1", "edge2", "distance", path, largest=False)
    return scan_report(spark, path, 10).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_read").alias("n_read"), F.sum("n_skipped").alias("n_skipped"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the largest sets of at least 3 vectors any two of which are within cosine distance 0.20."""
    return Clusters(table(spark, sf_dir, "glove_100_angular"), "row_id", "train", 100, 0.20).found


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical members of these clusters."""
    return Clusters(table(spark, sf_dir, "glove_100_angular"), "row_id", "train", 100, 0.20).described()


def p2_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every cluster, and whether its typical rows are three of its members."""
    clusters = Clusters(table(spark, sf_dir, "glove_100_angular"), "row_id", "train", 100, 0.20)
    clusters.found = materialize(clusters.found, "found")
    typical = clusters.described().select("cluster_row", "size", F.explode("typical").alias("row_id"))
    inside = typical.join(clusters.found.withColumn("hit", F.lit(1)), ["cluster_row", "row_id"], "left")
    return inside.groupBy("cluster_row", "size").agg((F.count("hit") == 3).alias("good"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest other vectors of every usable vector, at any distance."""
    return nearest(table(spark, sf_dir, "glove_100_angular"), "row_id", "train", 100, 5, exact=True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the 5 nearest within cosine distance 0.20, found from either side, each once."""
    found = nearest_pairs(table(spark, sf_dir, "glove_100_angular"), "row_id", "train", 100, 5, 0.20)
    return found.select(F.least("row", "other").alias("row_a"), F.greatest("row", "other").alias("row_b")).distinct()


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the 5 nearest at any distance the index finds, for every row whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "glove_100_angular")
    fit = F.forall("train", lambda e: e.isNotNull() & (F.abs(e) < float("inf"))) & F.exists("train", lambda e: e != 0)
    good = vectors.filter(F.col("row_id").isNotNull() & (F.size("train") == 100)).filter(fit).select(F.col("row_id").alias("vec_id"), F.col("train").alias("embedding"))
    true = exact_neighbours(good.filter("vec_id % 50 = 0"), good, "cosine", 5).select(F.col("query_id").alias("row"), F.col("id").alias("other"))
    found = nearest(vectors, "row_id", "train", 100, 5).select("row", "other", F.lit(1).alias("hit"))
    both = true.join(found, ["row", "other"], "left")
    counted = both.agg(F.countDistinct("row").alias("n_queries"), F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_hit"))
    return counted.select("n_queries", "n_true", (F.col("n_hit") >= 0.9 * F.col("n_true")).alias("enough"))


QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = usable_lines(spark, sf_dir).filter("i is not null and j is not null")
    return sketch_table(lines.withColumn("day", F.to_date("logged_at")), ["i", "j", "day"], "distance")


def p5_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of every (i, j) and day; lines without a date form a day of their own."""
    return read_sketches(_daily(spark, sf_dir), ["i", "j", "day"], QUANTILES)


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of every (i, j), from the merged sketches of its days."""
    return read_sketches(merge_sketches(_daily(spark, sf_dir), ["i", "j"]), ["i", "j"], QUANTILES)


RANK_ERROR = 0.03  # of the ranks above a percentile, as checked


def p5_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every (i, j) the lines and whether the true ranks of its percentiles are within ``RANK_ERROR`` of the ranks above, plus 2."""
    found = materialize(p5_percentiles(spark, sf_dir).select("i", "j", *QUANTILES), "percentiles")
    lines = usable_lines(spark, sf_dir).filter("i is not null and j is not null").select("i", "j", "distance").join(found, ["i", "j"])
    sides = {c: (F.sum((F.col("distance") < F.col(c)).cast("long")), F.sum((F.col("distance") <= F.col(c)).cast("long"))) for c in QUANTILES}
    ranks = lines.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), *[side.alias(f"{c}_{n}") for c, both in sides.items() for n, side in enumerate(both)])
    slack = {c: RANK_ERROR * (1 - q) * F.col("n") + 2 for c, q in QUANTILES.items()}
    good = {c: (F.col(f"{c}_0") - slack[c] <= q * F.col("n")) & (F.col(f"{c}_1") + slack[c] >= q * F.col("n")) for c, q in QUANTILES.items()}
    return ranks.select("i", "j", "n", *[ok.alias(f"{c}_good") for c, ok in good.items()])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with a median below 0.25 and a 90th percentile above it.

    The median is below 0.25 if at least half the values are, and the 90th percentile above it if fewer than
    nine tenths are not. The sketches give both counts, and settle the keys where these are off by more than
    the sketch can be wrong; the lines of the other keys are counted.
    """
    keys = ["i", "j"]
    merged = merge_sketches(_daily(spark, sf_dir), keys)
    ranks = read_sketches(merged, keys, {}, {"below": (0.25, False), "upto": (0.25, True)})
    need, most, slack = F.ceil(F.col("n") * 0.5), F.col("n") * 0.9, F.col("slack")
    yes = (F.col("below") - slack >= need) & (F.col("upto") + slack < most)
    no = (F.col("below") + slack < need) | (F.col("upto") - slack >= most)
    ranks = materialize(ranks.select(*keys, F.when(yes, 1).when(no, -1).otherwise(0).alias("state")), "ranks")
    lines = usable_lines(spark, sf_dir).join(ranks.filter("state = 0").select(*keys), keys)
    exact = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("distance") < 0.25).cast("long")).alias("below"), F.sum((F.col("distance") <= 0.25).cast("long")).alias("upto"))
    return ranks.filter("state = 1").select(*keys).unionByName(exact.filter((F.col("below") >= need) & (F.col("upto") < most)).select(*keys))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose encoding is the empty list: null and empty texts."""
    return p6_ids(spark, sf_dir).filter(F.size("ids") == 0).select("doc_id")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every text as decoded from its ids."""
    return decode_table(p6_ids(spark, sf_dir), "doc_id").select("doc_id", F.md5("text").alias("digest"))


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "text")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with shard and position."""
    return _mix(spark, sf_dir).rows


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked and actual share of every source of the targets."""
    return _mix(spark, sf_dir).report


def p7_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a mix of the largest size at which every source that has documents reaches its share."""
    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "text", fit=True).report


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every target the documents there are, and whether no document is in the mix more often than it may be, none twice as
    the same copy, and the whole not above its share."""
    mix = _mix(spark, sf_dir)
    rows = mix.rows.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("copies"))
    worst = rows.groupBy("source").agg(F.max("n").alias("n"), F.max(F.col("n") - F.col("copies")).alias("twice"))
    out = mix.report.join(worst, "source", "left")
    fits = (F.coalesce("n", F.lit(0)) <= F.col("max_repeats")) & (F.coalesce("twice", F.lit(0)) == 0)
    return out.select("source", "n_docs", fits.alias("within_repeats"), (F.col("mix_tokens") <= F.col("target_tokens")).alias("within_share"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which every document is in the mix as often as it may be, and that still lack tokens."""
    return _mix(spark, sf_dir).report.filter("short").select("source")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 512 tokens of every document, overlapping by 32."""
    return split_table(table(spark, sf_dir, "documents"), "doc_id", "text", 512, 32)


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text the characters that its pieces cover, and whether all are within the limit and begin before the end of the one before."""
    pieces = split_table(table(spark, sf_dir, "documents"), "doc_id", "text", 512, 32, keep_text=False)
    before = F.lag("end_char", 1, 0).over(Window.partitionBy("doc_id").orderBy("piece"))
    linked = (F.col("start_char") <= F.col("before")) & ((F.col("piece") == 0) | (F.col("start_char") < F.col("before")))
    good = linked & (F.col("end_char") > F.col("before")) & (F.col("n_tokens") <= 512) & (F.col("n_tokens") > 0)
    new = F.col("end_char") - F.col("before")
    return pieces.withColumn("before", before).groupBy("doc_id").agg(F.sum(new).cast("long").alias("n_chars"), F.bool_and(good).alias("good"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be cut: each of them has exactly one second piece."""
    pieces = split_table(table(spark, sf_dir, "documents"), "doc_id", "text", 512, 32, keep_text=False)
    return pieces.filter("piece = 1").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_topn": p1_topn,
    "p1_scan": p1_scan,
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p2_checked": p2_checked,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p3_recall": p3_recall,
    "p5_found": p5_found,
    "p5_checked": p5_checked,
    "p5_daily": p5_daily,
    "p5_percentiles": p5_percentiles,
    "p6_found": p6_found,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_fitted": p7_fitted,
    "p7_checked": p7_checked,
    "p8_found": p8_found,
    "p8_pieces": p8_pieces,
    "p8_checked": p8_checked,
}
