"""Registry of the core queries: name -> callable (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions import vectors
from graftline.functions.families import E2LSH, CrossPolytope, Family, SimHash, codes, minhash_codes
from graftline.functions.probability import binomial
from graftline.operators import candidates as cand
from graftline.operators import diagnostics, knn, pairs, sets, tree
from graftline.operators.msf import component_labels, msf
from graftline.operators.skew import per_key, plan_per_key, skew_join
from graftline.plans.config import repetitions_within
from graftline.session import materialize, scratch_path, table
from graftline.sources import logs
from graftline.sources.hdf5 import HDF5Source, write_hdf5
from graftline.sources.index_store import Index
from graftline.streaming.incremental import TreeStream, append_points


def usable_distance() -> Column:
    """Lines of the collision log that count: two different ends and a number from 0 to 2."""
    return F.col("edge1").isNotNull() & F.col("edge2").isNotNull() & (F.col("edge1") != F.col("edge2")) & F.col("distance").between(0.0, 2.0)


def shown_mean() -> Column:
    """The mean to six decimals. Means of few six-decimal numbers often lie half-way, where engines round
    differently, so they are lifted by less than any of them can tell."""
    return F.round(F.col("mean_value") + F.lit(1e-10), 6).alias("mean_distance")


def p4_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, distinct (edge1, edge2) and mean usable distance of every (i, j)."""
    log = table(spark, sf_dir, "glove_sampl").filter("i is not null and j is not null")
    out = per_key(log, ["i", "j"], ["edge1", "edge2"], "distance", usable_distance())
    return out.select("i", "j", "n_lines", "n_pairs", shown_mean())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys (i, j) with more than 1.5 % of all rows whose i and j are not null."""
    log = table(spark, sf_dir, "glove_sampl").filter("i is not null and j is not null")
    plan = plan_per_key(log, ["i", "j"])
    keys = per_key(log, ["i", "j"], ["edge1", "edge2"], "distance", usable_distance(), plan=plan)
    return keys.filter(F.col("n_lines") > 0.015 * plan.total).select("i", "j")


def p4_above_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every (i, j), the usable lines whose distance exceeds the mean of the key, by a skew-proof join."""
    log = table(spark, sf_dir, "glove_sampl").filter("i is not null and j is not null")
    means = per_key(log, ["i", "j"], ["edge1", "edge2"], "distance", usable_distance()).select("i", "j", shown_mean())
    lines = log.filter(usable_distance()).select("i", "j", "line_no", "distance")
    joined = skew_join(lines, means, ["i", "j"], ["line_no"])
    return joined.groupBy("i", "j").agg(F.sum((F.col("distance") > F.col("mean_distance")).cast("long")).alias("n_above"))


# ---- spanning trees, neighbours and hash joins over the embeddings

DIM = 64
SIM = SimHash(DIM, 8, 10)
E2 = E2LSH(DIM, 4, 6, width=2.0)
CROSS = CrossPolytope(DIM, 4, 3)
DELTA = 0.5  # of the queries that split edges by their chance of having been missed
LSH_PREFIX = 7
SIM_TREE = SimHash(DIM, 50, 12)  # tables enough for the rule to hold where vectors lie far apart
E2_TREE = E2LSH(DIM, 50, 8, width=2.0)
PARTS = E2LSH(2, 20, 12, width=40.0)  # over part_points
GLOVE = SimHash(100, 12, 16)  # over glove_points
CLOSEST = 500


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an id and a vector of the right length."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & (F.size("embedding") == DIM)).select("vec_id", "embedding", "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).filter("vec_id % 50 = 0")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("w",)})


def _tree(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(pairs.exact_tree(points(spark, sf_dir), name))

    query.__doc__ = f"Exact minimum spanning tree under the {name} metric."
    return query


def exact_mst_weight(spark, sf_dir):
    return pairs.exact_tree(points(spark, sf_dir), "euclidean").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("w"), 6).alias("weight"))


def mst_by_label(spark, sf_dir):
    return rounded(pairs.exact_trees_by(points(spark, sf_dir), "euclidean", "label"))


def all_pairs_euclidean(spark, sf_dir):
    return rounded(pairs.all_pairs(points(spark, sf_dir), "euclidean"))


def all_pairs_cosine(spark, sf_dir):
    return rounded(pairs.all_pairs(points(spark, sf_dir), "cosine"))


def normalize_vectors(spark, sf_dir):
    unit = points(spark, sf_dir).select("vec_id", vectors.normalize("embedding").alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda s, v: s + v)
    return unit.select("vec_id", F.round(vectors.norm("u"), 6).alias("norm"), F.round(total, 6).alias("total"))


def knn_exact_euclidean(spark, sf_dir):
    return rounded(pairs.exact_neighbours(asked(spark, sf_dir), points(spark, sf_dir), "euclidean", 10, keep_self=True), "dist")


def knn_exact_cosine(spark, sf_dir):
    return rounded(pairs.exact_neighbours(asked(spark, sf_dir), points(spark, sf_dir), "cosine", 10, keep_self=True), "dist")


def knn_from_index_exact(spark, sf_dir):
    return rounded(pairs.exact_neighbours(asked(spark, sf_dir), points(spark, sf_dir), "cosine", 10), "dist")


def closest_pairs_exact(spark, sf_dir):
    return rounded(pairs.closest_pairs(points(spark, sf_dir), "euclidean", 20))


def _codes(family: Family):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return codes(points(spark, sf_dir), family).select("vec_id", "rep", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))

    query.__doc__ = f"Hash codes of every point: {family.describe()}."
    return query


def sim_codes(spark, sf_dir):
    return codes(points(spark, sf_dir), SIM)


def bucket_sizes_by_prefix(spark, sf_dir):
    table_ = sim_codes(spark, sf_dir)
    levels = [cand.bucket_sizes(table_, p).groupBy("rep").agg(F.lit(p).alias("prefix"), F.count(F.lit(1)).alias("buckets"), F.max("n").alias("largest"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs")) for p in range(0, SIM.depth + 1, 2)]
    return reduce(DataFrame.unionByName, levels)


def bucket_runs(spark, sf_dir):
    return cand.bucket_runs(sim_codes(spark, sf_dir))


def lsh_pairs_full_hash(spark, sf_dir):
    return cand.prefix_pairs(sim_codes(spark, sf_dir), SIM.depth)


def lsh_pairs_prefix(spark, sf_dir):
    return cand.prefix_pairs(sim_codes(spark, sf_dir), LSH_PREFIX)


def lsh_pairs_incremental(spark, sf_dir):
    return cand.new_pairs(sim_codes(spark, sf_dir), LSH_PREFIX)


def pair_lcp(spark, sf_dir):
    return cand.pair_lcp(sim_codes(spark, sf_dir), LSH_PREFIX)


def _labels(spark, sf_dir):
    """Components of the pairs that share a whole code."""
    return component_labels(lsh_pairs_full_hash(spark, sf_dir), points(spark, sf_dir).select("vec_id"))


def lsh_pairs_filtered(spark, sf_dir):
    left = cand.unconnected(lsh_pairs_prefix(spark, sf_dir), _labels(spark, sf_dir))
    return rounded(cand.weigh(left, points(spark, sf_dir), "cosine"))


def failure_probability_table(spark, sf_dir):
    grid = spark.range(1, 20).select((F.col("id") / 10).alias("distance")).crossJoin(spark.range(0, 11).select(F.col("id").cast("int").alias("prefix")))
    d, p = F.col("distance"), F.col("prefix")
    return grid.select("distance", "prefix", F.round(SIM.failure(d, p), 6).alias("simhash"), F.round(SIM.failure(d, p, 4), 6).alias("simhash_half"), F.round(E2.failure(d, F.least(p, F.lit(E2.depth))), 6).alias("e2lsh"))


def _split(spark, sf_dir):
    return cand.confirm(pairs.exact_tree(points(spark, sf_dir), "cosine"), SIM, 3, DELTA)


def confirmed_split(spark, sf_dir):
    return rounded(_split(spark, sf_dir), "w", "fail")


def bound_weight(spark, sf_dir):
    return rounded(cand.bound_weight(_split(spark, sf_dir)), "weight", "bound")


def epsilon_accept(spark, sf_dir):
    eps = spark.createDataFrame([(0.01,), (0.2,), (0.5,), (1.0,)], "epsilon double")
    return eps.crossJoin(F.broadcast(cand.bound_weight(_split(spark, sf_dir)))).select("epsilon", (F.col("weight") <= (1 + F.col("epsilon")) * F.col("bound")).alias("accepted"))


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and price of every part as a vector in a square of 100 by 100: points dense enough for hash buckets to prune."""
    price = F.when(F.col("p_retailprice") < float("inf"), F.col("p_retailprice"))
    parts = table(spark, sf_dir, "part").filter("p_partkey is not null and p_size is not null").filter(price.isNotNull())
    return parts.select(F.col("p_partkey").alias("vec_id"), F.array((F.col("p_size") * 2).cast("float"), (price - 900.0).cast("float")).alias("embedding"))


def glove_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable vectors of the collection, which has near groups and copies."""
    fit = F.forall("train", lambda e: e.isNotNull() & (F.abs(e) < float("inf"))) & F.exists("train", lambda e: e != 0)
    vectors_ = table(spark, sf_dir, "glove_100_angular").filter(F.col("row_id").isNotNull() & (F.size("train") == 100)).filter(fit)
    return vectors_.select(F.col("row_id").alias("vec_id"), F.col("train").alias("embedding"))


def find_tree_simhash(spark, sf_dir):
    return rounded(tree.find_tree(points(spark, sf_dir), SIM_TREE, switch=None).described())


def find_tree_e2lsh(spark, sf_dir):
    return rounded(tree.find_tree(points(spark, sf_dir), E2_TREE, switch=None).described())


def find_epsilon_tree_simhash(spark, sf_dir):
    return rounded(tree.find_epsilon_tree(points(spark, sf_dir), SIM_TREE, switch=None).described())


def find_tree_parts(spark, sf_dir):
    """Tree of the parts by size and price, with the prefix at which it was accepted."""
    return rounded(tree.find_tree(part_points(spark, sf_dir), PARTS).described())


def find_epsilon_tree_parts(spark, sf_dir):
    return rounded(tree.find_epsilon_tree(part_points(spark, sf_dir), PARTS, epsilon=0.2).described())


def find_tree_parts_pruned(spark, sf_dir):
    """The same tree, without comparing points that confirmed edges already connect."""
    return rounded(tree.find_tree(part_points(spark, sf_dir), PARTS, prune_connected=True).described())


def find_tree_parts_levels(spark, sf_dir):
    """Figures of the level at which the tree of the parts was accepted."""
    found = tree.find_tree(part_points(spark, sf_dir), PARTS)
    return rounded(found.metrics().filter("accepted").select("prefix", "path", "n_edges", "n_confirmed", "weight", "bound"), "weight", "bound")


def exact_mst_parts(spark, sf_dir):
    return rounded(pairs.exact_tree(part_points(spark, sf_dir), "euclidean"))


def tree_connected(spark, sf_dir):
    edges = pairs.exact_tree(points(spark, sf_dir), "euclidean")
    return tree.is_connected(materialize(edges, "tree"), points(spark, sf_dir))


def component_labels_query(spark, sf_dir):
    return _labels(spark, sf_dir)


def local_msf_by_rep(spark, sf_dir):
    return rounded(tree.forests_by_table(sim_codes(spark, sf_dir), points(spark, sf_dir), LSH_PREFIX, "cosine"))


def merge_msf(spark, sf_dir):
    local = tree.forests_by_table(sim_codes(spark, sf_dir), points(spark, sf_dir), LSH_PREFIX, "cosine").select("i", "j", "w").distinct()
    return rounded(msf(local))


def knn_lsh(spark, sf_dir):
    return rounded(knn.knn(asked(spark, sf_dir), points(spark, sf_dir), SIM, 10), "dist")


def _sketch_recall(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        true = pairs.exact_neighbours(asked(spark, sf_dir), points(spark, sf_dir), "cosine", 10)
        found = knn.knn(asked(spark, sf_dir), points(spark, sf_dir), SIM, 10, filter_type=mode, bits=32, miss=0.01).select("query_id", "id", F.lit(1).alias("hit"))
        both = true.join(found, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_hit"))
        return both.select("n_queries", "n_true", (F.col("n_hit") >= 0.9 * F.col("n_true")).alias("enough"))

    query.__doc__ = f"Whether the search with the {mode} sketch filter finds nine tenths of the 10 nearest."
    return query


def knn_lsh_sketch_derived(spark, sf_dir):
    """Neighbours by sketches whose limits follow from the k-th distances so far."""
    return rounded(knn.knn(asked(spark, sf_dir), points(spark, sf_dir), SIM, 10, filter_type="simple", bits=32, miss=0.01), "dist")


def nation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter("n_nationkey is not null and n_regionkey is not null").select(F.col("n_nationkey").cast("long").alias("vec_id"), F.array(F.col("n_nationkey").cast("float"), (F.col("n_regionkey") * 10).cast("float")).alias("embedding"))


def knn_few_points(spark, sf_dir):
    """Neighbours among so few points that all are compared."""
    few = nation_points(spark, sf_dir)
    return rounded(knn.knn(few, few, E2LSH(2, 4, 4, width=8.0), 3), "dist")


def rejected_arguments(spark, sf_dir):
    """Arguments that the operators refuse, and whether they do."""
    few, family = nation_points(spark, sf_dir), E2LSH(2, 4, 4)
    path = scratch_path(spark, "taken")
    few.write.parquet(f"{path}/points")
    checks = {
        "negative prefix": lambda: cand.prefix_of("code", -1),
        "no symbols": lambda: E2LSH(2, 4, 0),
        "other length": lambda: codes(few, E2LSH(3, 4, 4)).collect(),
        "unknown metric": lambda: pairs.exact_tree(few, "dot"),
        "unknown filter": lambda: knn.knn(few, few, family, 3, filter_type="ring"),
        "sketches of lengths": lambda: knn.knn(few, few, family, 3, filter_type="simple"),
        "recall of nothing": lambda: knn.closest_pairs(few, family, 3, recall=0.0),
        "negative epsilon": lambda: tree.find_epsilon_tree(few, family, -0.1),
        "insufficient memory": lambda: repetitions_within(1000, 1000, DIM, 8),
        "existing path": lambda: Index(few, family).save(path),
    }

    def refused(call) -> bool:
        try:
            call()
        except Exception:
            return True
        return False

    return spark.createDataFrame([(name, refused(call)) for name, call in checks.items()], "argument string, refused boolean")


def closest_pairs_lsh(spark, sf_dir):
    """The 500 closest pairs of the collection, with the prefix at which they were accepted; distances to nine decimals, as copies tie."""
    found, figures = knn.closest_pairs(glove_points(spark, sf_dir), GLOVE, CLOSEST, digits=9)
    return rounded(found).withColumns({"prefix": F.lit(figures["prefix"]), "path": F.lit(figures["path"])})


def closest_pairs_glove_exact(spark, sf_dir):
    return rounded(pairs.closest_pairs(glove_points(spark, sf_dir), "cosine", CLOSEST, digits=9))


def _by_table(spark, sf_dir):
    met = cand.met(sim_codes(spark, sf_dir), LSH_PREFIX).select("rep", F.array_join(F.col("key").cast("array<string>"), ",").alias("key"), "i", "j")
    return cand.weigh(met, points(spark, sf_dir), "cosine")


def cap_unconfirmed(spark, sf_dir):
    return rounded(cand.cap_unconfirmed(cand.confirm(_by_table(spark, sf_dir), SIM, 3, DELTA), 10 * points(spark, sf_dir).count()).select("rep", "i", "j", "w", "confirmed"))


def reservoir_pairs(spark, sf_dir):
    return rounded(cand.reservoir(_by_table(spark, sf_dir), 2, ["rep", "key"]).select("rep", "i", "j", "w"))


def bernoulli_pairs(spark, sf_dir):
    return cand.bernoulli(lsh_pairs_prefix(spark, sf_dir), 0.25)


def random_path(spark, sf_dir):
    return cand.random_path(points(spark, sf_dir))


def recall_over_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "recall_results").select("run_id", "w0", "w1", "w2")
    return rounded(diagnostics.recall_over_runs(runs, ["w0", "w1", "w2"]).select("run_id", "least", "share"), "least", "share")


def distance_histogram(spark, sf_dir):
    log = table(spark, sf_dir, "glove_sampl").filter("i = 24 and j = 0")
    return diagnostics.histogram(log, "distance", 0.0, 2.0, 70)


def tree_median_edge(spark, sf_dir):
    return rounded(diagnostics.median_edge(materialize(pairs.exact_tree(points(spark, sf_dir), "euclidean"), "tree")))


def tree_log_weights(spark, sf_dir):
    good = glove_points(spark, sf_dir)
    return diagnostics.tree_weights(table(spark, sf_dir, "tree_edges"), good, "cosine").withColumn("weight", F.round("weight", 4))


def incremental_append_tree(spark, sf_dir):
    old, new = (points(spark, sf_dir).filter(c).select("vec_id", "embedding") for c in ("vec_id % 10 <> 0", "vec_id % 10 = 0"))
    return rounded(append_points(pairs.exact_tree(old, "euclidean"), old, new, "euclidean"))


def index_save_load_roundtrip(spark, sf_dir):
    index = Index(points(spark, sf_dir).filter("vec_id % 2 = 0"), SIM).insert(points(spark, sf_dir))
    path = scratch_path(spark, "index")
    index.save(path)
    return Index.load(spark, path).codes.select("vec_id", "rep", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


def collision_log_roundtrip(spark, sf_dir):
    """The whole log, with its nulls and the distances that aren't finite."""
    path = scratch_path(spark, "log")
    logs.write_collisions(table(spark, sf_dir, "glove_sampl"), path)
    return logs.read_collisions(spark, path)


def recall_log_roundtrip(spark, sf_dir):
    """All recall results through the text log."""
    path = scratch_path(spark, "recalls")
    logs.write_recalls(table(spark, sf_dir, "recall_results"), path)
    return logs.read_recalls(spark, path)


def tree_log_roundtrip(spark, sf_dir):
    """The edges of the exact tree through the text log."""
    path = scratch_path(spark, "tree")
    logs.write_tree(pairs.exact_tree(points(spark, sf_dir), "euclidean"), path)
    return logs.read_tree(spark, path)


def _saved_index(spark: SparkSession, sf_dir: str) -> tuple[Index, Index]:
    index, path = Index(points(spark, sf_dir), SIM), scratch_path(spark, "index")
    index.save(path)
    return index, Index.load_or_build(points(spark, sf_dir), SIM, path)


def index_lookup(spark, sf_dir):
    """The vector of one id and its code in one table, from a saved index."""
    _, index = _saved_index(spark, sf_dir)
    code = index.code_of(7, 1).select("vec_id", "rep", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))
    return code.join(index.get(7), "vec_id").select("vec_id", "rep", "code", F.size("embedding").alias("dim"), F.round(vectors.norm("embedding"), 6).alias("norm"))


def index_description(spark, sf_dir):
    """What a saved index says about itself, and whether it equals the one it was saved from."""
    built, index = _saved_index(spark, sf_dir)
    about = index.describe()
    return spark.createDataFrame([(about["points"], about["repetitions"], about["depth"], about["family"], index.equals(built))], "points long, repetitions int, depth int, family string, same boolean")


def stream_append_tree(spark, sf_dir):
    """The tree after points have arrived in micro-batches, a file each."""
    arriving = scratch_path(spark, "arriving")
    points(spark, sf_dir).select("vec_id", "embedding").repartition(4, "vec_id").write.parquet(arriving)
    stream = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(arriving)
    state = TreeStream(spark)
    state.start(stream, availableNow=True).awaitTermination()
    return rounded(state.tree)


def hdf5_roundtrip(spark, sf_dir):
    """Vectors through HDF5 files; ids are positions in the order of the points."""
    path = scratch_path(spark, "hdf5")
    write_hdf5(points(spark, sf_dir), "vec_id", "embedding", path)
    spark.dataSource.register(HDF5Source)
    stored = spark.read.format("hdf5").option("dataset", "train").load(path)
    total = F.aggregate("train", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return stored.select("row_id", F.size("train").alias("dim"), F.round(total, 6).alias("total"))


def binomial_table(spark, sf_dir):
    grid = spark.range(0, 13).select(F.col("id").alias("n")).crossJoin(spark.range(0, 13).select(F.col("id").alias("k")))
    return grid.select("n", "k", binomial(F.col("n"), F.col("k")).alias("ways"))


def memory_plan(spark, sf_dir):
    n = points(spark, sf_dir).count()
    rows = [(limit, n, repetitions_within(limit, n, DIM, 8)) for limit in (2_000_000, 8_000_000, 900_000_000)]
    return spark.createDataFrame(rows, "memory_limit long, n long, repetitions long")


# ---- token sets of the documents


def document_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sets.shingles("text").alias("tokens"))


def jaccard_pairs_documents(spark, sf_dir):
    """Pairs of distinct sets of five-word shingles with similarity 0.8 or more, by their smallest documents."""
    reps, _ = sets.classes(document_sets(spark, sf_dir))
    return rounded(sets.similar(reps))


def jaccard_classes_documents(spark, sf_dir):
    """The class of equal sets of every document that has one."""
    return sets.classes(document_sets(spark, sf_dir))[1]


def jaccard_knn_documents(spark, sf_dir):
    reps, _ = sets.classes(document_sets(spark, sf_dir))
    queries_ = document_sets(spark, sf_dir).filter("doc_id % 50 = 0").select(F.col("doc_id").alias("id"), "tokens")
    return rounded(sets.set_neighbours(queries_, reps, 5), "dist")


def jaccard_mst_documents(spark, sf_dir):
    reps, _ = sets.classes(document_sets(spark, sf_dir))
    return rounded(msf(sets.similar(reps)))


WORDS = sets.MinHash(24, 3)
ALIKE = 0.5  # of word sets, where texts that differ in some words are alike


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of each set of words, by its smallest document."""
    return sets.classes(table(spark, sf_dir, "documents").select("doc_id", sets.word_set("text").alias("tokens")))[0]


def jaccard_pairs_words(spark, sf_dir):
    """Pairs of distinct word sets with similarity 0.5 or more."""
    return rounded(sets.similar(document_words(spark, sf_dir), ALIKE))


def jaccard_mst_words(spark, sf_dir):
    """Spanning forest of these pairs."""
    return rounded(msf(sets.similar(document_words(spark, sf_dir), ALIKE)))


def minhash_pairs_words(spark, sf_dir):
    """Those of these pairs that share a MinHash bucket, with the chance of missing one so similar."""
    return rounded(sets.bucket_similar(document_words(spark, sf_dir), WORDS, ALIKE), "w", "fail")


def minhash_codes_documents(spark, sf_dir):
    found = minhash_codes(document_sets(spark, sf_dir), 2, 2)
    return found.select("doc_id", "rep", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


QUERIES = {
    "p4_found": p4_found,
    "p4_keys": p4_keys,
    "p4_above_mean": p4_above_mean,
    "exact_mst_euclidean": _tree("euclidean"),
    "exact_mst_cosine": _tree("cosine"),
    "exact_mst_angular": _tree("angular"),
    "simhash_codes": _codes(SIM),
    "e2lsh_codes": _codes(E2),
    "crosspolytope_codes": _codes(CROSS),
    "component_labels": component_labels_query,
    "knn_lsh_sketch_simple": _sketch_recall("simple"),
    "knn_lsh_sketch_default": _sketch_recall("default"),
    **{
        f.__name__: f
        for f in (
            exact_mst_weight, mst_by_label, all_pairs_euclidean, all_pairs_cosine, normalize_vectors, knn_exact_euclidean, knn_exact_cosine,
            knn_from_index_exact, closest_pairs_exact, bucket_sizes_by_prefix, bucket_runs, lsh_pairs_full_hash, lsh_pairs_prefix,
            lsh_pairs_incremental, pair_lcp, lsh_pairs_filtered, failure_probability_table, confirmed_split, bound_weight, epsilon_accept,
            find_tree_simhash, find_tree_e2lsh, find_epsilon_tree_simhash, tree_connected, local_msf_by_rep, merge_msf, knn_lsh,
            knn_lsh_sketch_derived, knn_few_points, rejected_arguments, closest_pairs_lsh, closest_pairs_glove_exact, find_tree_parts, find_epsilon_tree_parts, find_tree_parts_pruned, find_tree_parts_levels, exact_mst_parts, cap_unconfirmed, reservoir_pairs, bernoulli_pairs, random_path, recall_over_runs,
            distance_histogram, tree_median_edge, tree_log_weights, incremental_append_tree, index_save_load_roundtrip,
            collision_log_roundtrip, recall_log_roundtrip, tree_log_roundtrip, index_lookup, index_description, stream_append_tree, hdf5_roundtrip, binomial_table, memory_plan, jaccard_pairs_documents, jaccard_classes_documents, jaccard_knn_documents,
            jaccard_mst_documents, minhash_codes_documents, jaccard_pairs_words, jaccard_mst_words, minhash_pairs_words,
        )
    },
}
