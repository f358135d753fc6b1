"""Rules over triples: derive new triples from known ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepane.session import save_round, staging_path

Rule = Callable[[DataFrame], DataFrame]
#: Gets the newest triples and all known ones (the newest included).
JoinRule = Callable[[DataFrame, DataFrame], DataFrame]
_SPO = ["s", "p", "o"]

_COMPARE = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    "=": lambda a, b: a == b,
}


def derive_threshold(
    triples: DataFrame, predicate: str, op: str, bound: float, out: tuple[str, str]
) -> DataFrame:
    """``?s predicate ?o`` with ``?o op bound`` derives ``?s out[0] out[1]``."""
    value = F.col("o").try_cast("double")
    return (
        triples.filter((F.col("p") == predicate) & _COMPARE[op](value, F.lit(float(bound))))
        .select("s", F.lit(out[0]).alias("p"), F.lit(out[1]).alias("o"))
        .distinct()
    )


def derive_rewrite(triples: DataFrame, template: tuple[str, str, str]) -> DataFrame:
    """Each triple derives a triple with its terms permuted: ``("s", "o", "p")`` swaps two."""
    return triples.select(
        *[F.col(source).alias(target) for source, target in zip(template, _SPO)]
    ).distinct()


def derive_fixpoint(
    triples: DataFrame,
    rules: Sequence[Rule] = (),
    max_iter: int | None = None,
    linear: Sequence[Rule] = (),
    joins: Sequence[JoinRule] = (),
) -> DataFrame:
    """All triples the rules derive from the input, repeated until nothing new appears.

    A round starts from the triples the last one found: ``linear`` rules read one triple at a time and get only those,
    ``joins`` combine triples and get them beside all known ones. Other ``rules`` get all known triples each time.
    Triples that came out before are dropped by an anti-join. Each round is saved to shared storage, so the plan stays
    short and a lost executor does not replay earlier rounds. Rounds go on until one finds nothing; with
    ``max_iter`` they stop with an error after so many.
    """
    folder = staging_path(triples.sparkSession, "rules")
    fresh = known = save_round(triples.select(*_SPO).distinct(), folder, 0)
    derived = known.limit(0)
    rounds = 0
    while max_iter is None or rounds < max_iter:
        found = [rule(known) for rule in rules] + [rule(fresh) for rule in linear]
        found += [join(fresh, known) for join in joins]
        candidates = reduce(DataFrame.unionByName, [c.select(*_SPO) for c in found]).distinct()
        rounds += 1
        fresh = save_round(candidates.join(known, _SPO, "left_anti"), folder, rounds)
        if fresh.isEmpty():
            return derived
        derived, known = derived.unionByName(fresh), known.unionByName(fresh)
    raise RuntimeError(f"no fixpoint after {max_iter} rounds")
