"""Settings of a search and the planning done before Spark sees a query."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from graftline.functions.families import E2LSH, CrossPolytope, Family, SimHash
from graftline.operators import knn, tree
from graftline.operators.tree import TreeResult

FAMILIES = {"euclidean": E2LSH, "cosine": SimHash, "angular": CrossPolytope}


@dataclass(frozen=True)
class Settings:
    """What can be tuned. ``delta`` is divided by the number of points unless ``per_edge``."""

    metric: str = "euclidean"
    repetitions: int = 16
    depth: int = 8
    delta: float = 0.1
    epsilon: float = 0.2
    per_edge: bool = False
    recall: float = 0.8
    k: int = 10
    filter_type: str = "none"
    seed: int = 42

    def __post_init__(self):
        if self.metric not in FAMILIES:
            raise ValueError(f"unknown metric {self.metric}; one of {sorted(FAMILIES)}")
        if not (0 < self.delta < 1 and 0 <= self.epsilon and 0 < self.recall <= 1 and self.k > 0):
            raise ValueError("delta and recall must be shares, epsilon not negative and k positive")

    def family(self, dim: int) -> Family:
        """The metric's family of hash functions."""
        kind = FAMILIES[self.metric]
        family = kind(dim, self.repetitions, self.depth, self.seed)
        return replace(family, weights="angular") if self.metric == "angular" else family


def find_tree(points: DataFrame, dim: int, settings: Settings) -> TreeResult:
    """Spanning tree of points under the settings, right with high probability."""
    return tree.find_tree(points, settings.family(dim), settings.delta, settings.per_edge)


def find_epsilon_tree(points: DataFrame, dim: int, settings: Settings) -> TreeResult:
    """Spanning tree at most ``1 + epsilon`` times as heavy as the least."""
    return tree.find_epsilon_tree(points, settings.family(dim), settings.epsilon, settings.delta, settings.per_edge)


def neighbours(queries: DataFrame, points: DataFrame, dim: int, settings: Settings) -> DataFrame:
    """Neighbours of the queries; ``1 - recall`` is the chance of a miss that ends the search."""
    return knn.knn(queries, points, settings.family(dim), settings.k, 1 - settings.recall, settings.filter_type)


def closest_pairs(points: DataFrame, dim: int, settings: Settings) -> DataFrame:
    """The ``k`` closest pairs at the wanted recall."""
    return knn.closest_pairs(points, settings.family(dim), settings.k, settings.recall)[0]


def repetitions_within(memory_limit: int, n: int, dim: int, depth: int) -> int:
    """Most tables that fit into ``memory_limit`` bytes beside the vectors (4 bytes a number): a table takes 8
    bytes for the code and 4 for the id of every point, and ``4 * depth * dim`` for its projections."""
    left = memory_limit - 4 * n * dim
    tables = left // (12 * n + 4 * depth * dim) if n else 0
    if tables < 1:
        raise ValueError("insufficient memory")
    return int(tables)
