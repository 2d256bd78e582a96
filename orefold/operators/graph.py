"""Closures over triples ``(s, p, o)`` by repeated joins until nothing is new."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(df: DataFrame) -> DataFrame:
    """Cut the plan that grows each round by a checkpoint; on one machine without a folder for it, by the cache."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir() and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that they share")
    return df.checkpoint() if sc.getCheckpointDir() else df.cache()


def closure(edges: DataFrame, source: str = "s", target: str = "o") -> DataFrame:
    """``ancestor, descendant, distance`` with the least distance, from child ``source`` to parent ``target``.

    A round adds the pairs of the next distance; there are only so many pairs, so the rounds end, cycles or not.
    """
    step = edges.select(F.col(source).alias("descendant"), F.col(target).alias("ancestor")).distinct()
    found = _kept(step.withColumn("distance", F.lit(1)))
    front = found
    for distance in itertools.count(2):
        hop = step.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("next"))
        new = front.join(hop, "ancestor").select("descendant", F.col("next").alias("ancestor")).distinct()
        new = new.join(found, ["descendant", "ancestor"], "left_anti").withColumn("distance", F.lit(distance))
        front = _kept(new)
        if front.isEmpty():
            return found.select("ancestor", "descendant", "distance")
        found = _kept(found.unionByName(front))


def symmetric_closure(edges: DataFrame, source: str = "s", target: str = "o") -> DataFrame:
    """All other members that can be reached in either direction."""
    both = edges.select(source, target).union(edges.select(target, source)).distinct()
    return closure(both, source, target).filter("ancestor <> descendant")


def inherited_properties(classes: DataFrame, domains: DataFrame) -> DataFrame:
    """``class, property`` of all ancestors but the class's own; domains have ``property, class``."""
    up = classes.select(F.col("descendant").alias("class"), "ancestor")
    far = up.join(domains.select("property", F.col("class").alias("ancestor")), "ancestor").select("class", "property").distinct()
    return far.join(domains.select("class", "property"), ["class", "property"], "left_anti")


def with_optional(triples: DataFrame, subject_class: str, optional: dict[str, str]) -> DataFrame:
    """Subjects of a class with the objects of optional predicates, null where absent."""
    out = triples.filter((F.col("p") == "type") & (F.col("o") == subject_class)).select("s")
    for predicate, name in optional.items():
        out = out.join(triples.filter(F.col("p") == predicate).select("s", F.col("o").alias(name)), "s", "left")
    return out
