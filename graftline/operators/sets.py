"""Jaccard joins of token sets: classes of equal sets, prefix-filtered joins, neighbours.

Equal sets form one class, represented by its smallest id, so copies never multiply into pairs. The join is
exact: with the tokens of every set ordered from rare to frequent, two sets of similarity t or more share one of
the first ``n - ceil(t * n) + 1`` tokens, so only those are joined on, and sizes must agree within t. Of the smaller set the
first ``n - ceil(2t / (1 + t) * n) + 1`` are enough. Every joined row has a bitmap of its set's tokens: two sets differ in at least
as many tokens as their bitmaps in bits, so pairs that differ too much end in the join, and few are left to be compared by tokens.
Both joins run in tiles (``settiles``), which need a number for each token; should two tokens share one, Spark joins the rows instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.functions.families import minhash_codes
from graftline.functions.probability import failure, minhash_collision
from graftline.operators import settiles
from graftline.operators.candidates import prefix_of
from graftline.session import materialize


# Fixed value: white space of Unicode, as a character class of any regular expression engine
BLANKS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
HOT = 4096  # sets with a token in their prefixes; more are cut so that no task gets all their pairs
BITS = [f"s{k}" for k in range(8)]  # of a bitmap, 64 each


def words_of(text: Column | str) -> Column:
    """The words of a text, between runs of white space; none of a null, empty or blank text."""
    return F.filter(F.coalesce(F.split(text, BLANKS), F.array().cast("array<string>")), lambda w: w != "")


def word_set(text: Column | str) -> Column:
    """The distinct words of a text, sorted."""
    return F.array_sort(F.array_distinct(words_of(text)))


def shingles(text: Column | str, words: int = 5) -> Column:
    """Distinct runs of ``words`` words, sorted; a shorter text is one run, a text without words has none."""

    def runs(parts: Column) -> Column:
        count = F.greatest(F.size(parts) - words + 1, F.lit(1))
        some = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice(parts, k, words), " "))))
        return F.when(F.size(parts) > 0, some).otherwise(F.array().cast("array<string>"))

    # the lambda variable binds the words, so that the text is split once and not for every run
    return F.element_at(F.transform(F.array(words_of(text)), runs), 1)


def classes(sets: DataFrame, set_id: str = "doc_id", tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """``reps(id, tokens)``, one of each set that isn't empty, and ``membership(<set_id>, rep)``."""
    full = sets.filter(F.size(tokens) > 0).select(F.col(set_id).alias("id"), F.col(tokens).alias("tokens"), F.sha2(F.array_join(tokens, "\x1f"), 256).alias("digest"))
    heads = full.groupBy("digest").agg(F.min("id").alias("rep"))
    reps = full.groupBy("digest").agg(F.min("id").alias("id"), F.min_by("tokens", "id").alias("tokens")).select("id", "tokens")
    membership = full.select("id", "digest").join(heads, "digest").select(F.col("id").alias(set_id), "rep")
    return reps, membership


def bitmaps(reps: DataFrame) -> DataFrame:
    """``id, n, s0, ...``: the size of every set and the bits of its hashed tokens."""
    hashes = reps.select("id", F.size("tokens").alias("n"), F.expr("transform(tokens, t -> xxhash64(t))").alias("h"))
    word = "aggregate(h, 0L, (s, x) -> s | if(pmod(x, {n}) = {k}, shiftleft(1L, cast(pmod(shiftright(x, 8), 64) as int)), 0L))"
    return hashes.select("id", "n", *[F.expr(word.format(n=len(BITS), k=k)).alias(s) for k, s in enumerate(BITS)])


def _near(threshold: float) -> Column:
    """Whether rows ``x`` and ``y``, the smaller, may be of sets so similar, by their sizes and bitmaps."""
    differ = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in BITS[1:]), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    smaller = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.id") < F.col("x.id")))
    sizes = F.col("x.n") + F.col("y.n")
    return smaller & (F.col("y.n") >= F.col("x.n") * threshold - 1e-9) & (differ <= sizes * ((1 - threshold) / (1 + threshold)) + 1e-6)


def _met(rows: DataFrame, threshold: float, smaller: Column | None = None) -> DataFrame:
    """``i, j``: pairs of rows ``key, id, n, s0, ...`` with a common key that may be so similar; of the smaller set only rows with
    ``smaller`` count. One side of a frequent key is cut and the other copied to the cuts."""
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1)
    sized = rows.join(often, "key").withColumn("cuts", F.ceil(F.col("c") / HOT).cast("int"))
    y = sized if smaller is None else sized.filter(smaller)
    y = y.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("key", "cut", "id", "n", *BITS)
    x = sized.withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).select("key", "cut", "id", "n", *BITS)
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.cut") == F.col("y.cut"))
    found = x.alias("x").join(y.alias("y"), same & _near(threshold))
    return found.select(F.least("x.id", "y.id").alias("i"), F.greatest("x.id", "y.id").alias("j")).distinct()


def _ranked(reps: DataFrame) -> DataFrame:
    """``id, token, n, place``: tokens as hashes, the rarest of a set first."""
    flat = reps.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).select("id", "n", F.xxhash64("t").alias("token"))
    often = flat.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "token")
    return flat.join(often, "token").withColumn("place", F.row_number().over(order)).select("id", "token", "n", "place", "df")


def similar(reps: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``i, j, w``: pairs i < j of sets with Jaccard similarity of at least ``threshold``; w is the distance."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    reps = materialize(reps, "sets")
    if settiles.distinct_numbers(reps):
        return settiles.joined(reps, threshold, lambda sets: settiles.prefix_keys(sets, threshold))
    first = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    fewer = F.col("n") - F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - 1e-9) + 1
    head = _ranked(reps).filter(F.col("place") <= first).select("id", F.col("token").alias("key"), (F.col("place") <= fewer).alias("early"))
    rows = materialize(head.join(bitmaps(reps), "id"), "prefixes")
    return _verified(materialize(_met(rows, threshold, F.col("early")), "candidates"), reps, threshold)


def _verified(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    both = pairs.join(reps.select(F.col("id").alias("i"), F.col("tokens").alias("x")), "i").join(reps.select(F.col("id").alias("j"), F.col("tokens").alias("y")), "j")
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return both.withColumn("_s", shared).withColumn("_u", union).filter(F.col("_s") >= threshold * F.col("_u") - 1e-9).select("i", "j", (F.lit(1.0) - F.col("_s") / F.col("_u")).alias("w"))


@dataclass(frozen=True)
class MinHash:
    """``repetitions`` tables of ``depth`` least seeded hashes, for the Jaccard distance of token sets."""

    repetitions: int
    depth: int
    seed: int = 42
    metric = "jaccard"

    def codes(self, sets: DataFrame, set_id: str = "id", tokens: str = "tokens") -> DataFrame:
        """``vec_id, rep, code`` of the sets that aren't empty."""
        return minhash_codes(sets, self.repetitions, self.depth, self.seed, set_id, tokens).withColumnRenamed(set_id, "vec_id")

    def collision(self, distance: Column) -> Column:
        return minhash_collision(distance)

    def failure(self, distance: Column, prefix: Column | int, seen: Column | int | None = None) -> Column:
        return failure(self.collision(distance), prefix, self.repetitions if seen is None else seen, self.repetitions, self.depth)


def bucket_similar(reps: DataFrame, family: MinHash, threshold: float, prefix: int | None = None) -> DataFrame:
    """``i, j, w, fail``: pairs of sets with Jaccard similarity of at least ``threshold`` that share a bucket at ``prefix``, by
    default the whole code, and the chance that a pair so similar is missed."""
    prefix = family.depth if prefix is None else prefix
    reps = materialize(reps, "sets")
    if settiles.distinct_numbers(reps):
        repetitions, depth, seed = family.repetitions, family.depth, family.seed
        near = settiles.joined(reps, threshold, lambda sets: settiles.bucket_keys(sets, repetitions, depth, seed, prefix))
        return near.withColumn("fail", family.failure(F.col("w"), prefix))
    keys = family.codes(reps).select(F.col("vec_id").alias("id"), F.xxhash64("rep", prefix_of("code", prefix)).alias("key"))
    rows = materialize(keys.join(bitmaps(reps), "id"), "codes")
    near = _verified(materialize(_met(rows, threshold), "candidates"), reps, threshold)
    return near.withColumn("fail", family.failure(F.col("w"), prefix))


def set_neighbours(queries: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, id, dist``: the ``k`` nearest distinct sets that share a token with each query, by (dist, id).

    ``queries(id, tokens)``; a set of the query's own id is left out.
    """
    q = queries.select(F.col("id").alias("query_id"), F.size("tokens").alias("nq"), F.explode("tokens").alias("t"))
    r = reps.select("id", F.size("tokens").alias("nr"), F.explode("tokens").alias("t"))
    shared = q.join(r, "t").filter("query_id <> id").groupBy("query_id", "id", "nq", "nr").agg(F.count(F.lit(1)).alias("s"))
    dist = shared.select("query_id", "id", (F.lit(1.0) - F.col("s") / (F.col("nq") + F.col("nr") - F.col("s"))).alias("dist"))
    order = Window.partitionBy("query_id").orderBy("dist", "id")
    return dist.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "dist")
