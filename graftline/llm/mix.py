"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a seeded hash, so every block is a random part of its source.
A source's quota of tokens becomes whole passes over its blocks plus a random choice of blocks that fit, and one
that is cut between documents for what is left. The exact numbers of drawn blocks per source are then divided among the
output shards by halving: at every node of a binary tree a multivariate hypergeometric draw decides how
many blocks of each source go left, so the leaves hold exact quotas that add up. Each leaf takes disjoint
runs of the source's permuted blocks and shuffles its documents locally. The driver only sees block totals,
at most about twice ``MAX_BLOCKS``, and the plan, a row for each drawn block: at most as many, and for each source its repeats. There are at
most ``MAX_BLOCKS // BLOCKS_A_SHARD`` shards, so each draws many blocks however large the mix is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.llm.bpe import BYTE_BPE_50K, count_table
from graftline.session import materialize

MAX_BLOCKS = 1 << 15
BLOCK_TOKENS = 1 << 12
SHARD_TOKENS = 1 << 17
BLOCKS_A_SHARD = 8
LEAST_DRAWS = 16


@dataclass
class Share:
    """A source with its target and what it has; ``take`` is its quota in tokens."""

    source: str
    target_share: float
    max_repeats: int
    n_docs: int = 0
    n_tokens: int = 0
    take: float = 0.0
    blocks: int = 0
    draws: list[tuple[int, int]] = field(default_factory=list)
    cut: float = 0.0


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Divide ``counts`` of blocks per source among shards: a row per shard; the columns add up to ``counts``
    and the rows differ in size by rounding only."""
    out = np.zeros((shards, len(counts)), np.int64)
    stack = [(0, shards, np.asarray(counts, np.int64))]
    while stack:
        lo, hi, n = stack.pop()
        if hi - lo == 1:
            out[lo] = n
            continue
        mid = (lo + hi) // 2
        total = int(n.sum())
        left = rng.multivariate_hypergeometric(n, round(total * (mid - lo) / (hi - lo)), method="marginals") if total else n
        stack += [(lo, mid, left), (mid, hi, n - left)]
    return out


class Mix:
    """The mix of ``docs`` by ``targets``; ``rows`` are its documents, ``report`` the shares reached.

    ``docs``: id, source and text. ``targets``: ``source``, ``target_share`` of the tokens of all documents
    and ``max_repeats``, the most copies of one document. A source that can't reach its share with all copies
    gives what it has and is reported as short; the others aren't enlarged for it. With ``fit`` the size of the
    mix is lowered until every source that has tokens and repeats reaches its share. Documents without tokens
    (null or empty text) and sources without a target aren't mixed, though the latter's tokens count in the
    total. Null or negative shares and repeats count as 0, targets with a null source are ignored, a source
    named twice is an error. Repeated rows are documents of their own. The same seed gives the same mix.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, doc_id: str, source: str, text: str, vocabulary: str = BYTE_BPE_50K, seed: int = 0, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, fit: bool = False):
        spark = self.spark = docs.sparkSession
        self.doc_id, self.seed = doc_id, seed
        plain = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), F.col(text).alias("_text"))
        self.docs = materialize(count_table(plain, ["_id", "_source"], "_text", vocabulary), "mix-tokens")
        self.total = self.docs.agg(F.sum("n_tokens")).first()[0] or 0
        self.shares = self._shares(targets)
        self._quotas(block_tokens, fit)
        self._draw(shard_tokens)

    def _shares(self, targets: DataFrame) -> list[Share]:
        named = targets.filter("source is not null").select(
            "source", F.greatest(F.coalesce(F.nanvl(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0)).alias("repeats")
        )
        has = self.docs.groupBy("_source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        rows = named.join(has, F.col("source") == F.col("_source"), "left").collect()
        shares = sorted((Share(r["source"], r["share"], r["repeats"], r["n_docs"] or 0, r["n_tokens"] or 0) for r in rows), key=lambda s: s.source)
        if len({s.source for s in shares}) < len(shares):
            raise ValueError("a source has two targets")
        return shares

    def _quotas(self, block_tokens: int, fit: bool) -> None:
        able = [s.max_repeats * s.n_tokens / s.target_share for s in self.shares if s.target_share > 0 and s.max_repeats * s.n_tokens]
        self.goal = min([self.total, *able]) if fit else self.total
        for s in self.shares:
            s.take = min(s.target_share * self.goal, s.max_repeats * s.n_tokens)
        size = max(block_tokens, math.ceil(sum(s.take for s in self.shares) / MAX_BLOCKS))
        most = max(1, MAX_BLOCKS // max(1, len(self.shares)))
        for s in self.shares:  # at least some blocks to a quota, so that a small one isn't left to a single block
            fine = min(size, max(1, s.take / LEAST_DRAWS))
            s.blocks = max(math.ceil(s.n_tokens / size), min(most, math.ceil(s.n_tokens / fine)))

    def _draw(self, shard_tokens: int) -> None:
        used = [s for s in self.shares if s.blocks and s.take > 0]
        schema = "_source string, _block int, copy int, shard int, room double"
        if not used:
            self.plan = self.spark.createDataFrame([], schema)
            return
        blocks = self.spark.createDataFrame([(s.source, s.blocks) for s in used], "_source string, _blocks int")
        placed = self.docs.filter("n_tokens > 0").join(F.broadcast(blocks), "_source")
        self.placed = placed.withColumn("_block", F.pmod(F.xxhash64("_id", F.lit(self.seed)), F.col("_blocks")).cast("int")).drop("_blocks")
        sums = self.placed.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("n")).collect()
        size: dict[str, dict[int, int]] = {s.source: {} for s in used}
        for r in sums:
            size[r["_source"]][r["_block"]] = r["n"]
        rng = np.random.default_rng(self.seed)
        drawn = []
        for s in used:
            have = size[s.source]
            whole, order, draws = int(s.take // s.n_tokens), np.array(sorted(have)), []
            for copy in range(whole):
                draws += [(int(b), copy, math.inf) for b in rng.permutation(order)]
            room = s.take - whole * s.n_tokens
            cut = None
            for b in rng.permutation(order):
                if have[int(b)] <= room:
                    draws.append((int(b), whole, math.inf))
                    room -= have[int(b)]
                elif cut is None:
                    cut = int(b)
            if cut is not None and room >= 1:
                draws.append((cut, whole, float(room)))
            drawn.append([draws[k] for k in rng.permutation(len(draws))])
        tokens = sum(s.take for s in used)
        shards = max(1, min(math.ceil(tokens / shard_tokens), MAX_BLOCKS // BLOCKS_A_SHARD))
        quotas = split_tree(np.array([len(d) for d in drawn]), shards, rng)
        ends = quotas.cumsum(axis=0)
        rows = []
        for k, (s, draws) in enumerate(zip(used, drawn, strict=True)):
            for shard in range(shards):
                rows += [(s.source, b, copy, shard, room) for b, copy, room in draws[int(ends[shard, k] - quotas[shard, k]) : int(ends[shard, k])]]
        self.quotas = quotas
        self.plan = self.spark.createDataFrame(rows, schema)

    @property
    def rows(self) -> DataFrame:
        """``shard, position, <id>, source, copy, n_tokens``: every document of the mix, in shuffled order."""
        if not hasattr(self, "placed"):
            kind = self.docs.schema["_id"].dataType
            schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("position", T.IntegerType()), T.StructField(self.doc_id, kind), T.StructField("source", T.StringType()), T.StructField("copy", T.IntegerType()), T.StructField("n_tokens", T.LongType())])
            return self.spark.createDataFrame([], schema)
        joined = self.placed.join(F.broadcast(self.plan), ["_source", "_block"])
        whole = joined.filter("room = double('infinity')")
        # one block per source is cut, so this window holds a block, not a source
        order = Window.partitionBy("_source", "_block", "copy").orderBy(F.xxhash64("_id", F.lit(self.seed + 1)), "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
        cut = joined.filter("room < double('infinity') and n_tokens <= room").withColumn("_sum", F.sum("n_tokens").over(order)).filter("_sum <= room").drop("_sum")
        local = Window.partitionBy("shard").orderBy(F.xxhash64("_id", "copy", F.lit(self.seed + 2)), "_id", "copy")
        both = whole.unionByName(cut).withColumn("position", F.row_number().over(local))
        return both.select("shard", "position", F.col("_id").alias(self.doc_id), F.col("_source").alias("source"), "copy", "n_tokens")

    @property
    def report(self) -> DataFrame:
        """A row for each target: what it asked for, what there is, what the mix holds, and whether it is short: all
        its documents are drawn as often as they may be, and that isn't enough."""
        schema = "source string, target_share double, max_repeats int, n_docs long, n_tokens long, target_tokens double"
        asked = self.spark.createDataFrame([(s.source, s.target_share, s.max_repeats, s.n_docs, s.n_tokens, s.target_share * self.goal) for s in self.shares], schema)
        got = self.rows.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"))
        none = F.lit(0).cast("long")
        out = asked.join(got, "source", "left").withColumn("mix_tokens", F.coalesce("mix_tokens", none))
        drawn = F.col("mix_tokens") == F.col("n_tokens") * F.col("max_repeats")
        out = out.withColumn("short", drawn & (F.col("mix_tokens") < F.col("target_tokens")))
        whole = F.sum("mix_tokens").over(Window.partitionBy())
        return out.withColumn("actual_share", F.when(whole > 0, F.col("mix_tokens") / whole).otherwise(0.0))
