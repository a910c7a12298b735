"""References to records that do not exist: anti-joins by null mask under declared match semantics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full", "strict")


def orphan_references(
    references: DataFrame,
    targets: DataFrame,
    key: Sequence[str],
    target_key: Sequence[str] | None = None,
    match: str = "simple",
    nullable: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of `references` whose composite key has no row in `targets`; all columns of references are kept.

    References are grouped by their null mask and each mask is anti-joined on its non-null columns:

    - simple: a key with any null refers to nothing and is no orphan (SQL's MATCH SIMPLE)
    - partial: a key is judged by its non-null columns; with all null it refers to nothing
    - full: all columns null refers to nothing, some null is an orphan whatever the targets hold
    - strict: a key with any null has no target and is an orphan

    `nullable` names the key columns that can be null (default: all); masks of other columns aren't planned.
    Nulls in targets never match under simple, full and strict; under partial only the compared columns count.
    Repeated references stay repeated, repeated targets count once, empty targets make every reference an orphan,
    and columns of references with the names of target columns don't clash.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    target_key = list(target_key or key)
    prefix = "_t"
    while any(c.startswith(prefix) for c in references.columns):
        prefix += "_"
    own = [f"{prefix}{i}" for i in range(len(key))]
    found = targets.select(*[F.col(t).alias(o) for t, o in zip(target_key, own)])
    can_be_null = [i for i, k in enumerate(key) if nullable is None or k in nullable]

    def anti(rows: DataFrame, used: list[int]) -> DataFrame:
        # distinct targets: partial aggregation drops copies before the shuffle
        keys = found.select(*[own[i] for i in used]).where(reduce(lambda a, b: a & b, [F.col(own[i]).isNotNull() for i in used])).distinct()
        return rows.join(keys, [F.col(key[i]) == F.col(own[i]) for i in used], "left_anti")

    def masked(nulls: Sequence[int]) -> DataFrame:
        tests = [F.col(k).isNull() if i in nulls else F.col(k).isNotNull() for i, k in enumerate(key)]
        return references.where(reduce(lambda a, b: a & b, tests))

    everything = list(range(len(key)))
    parts = [anti(masked(()), everything)]
    if match in ("strict", "full") and can_be_null:
        some = reduce(lambda a, b: a | b, [F.col(key[i]).isNull() for i in can_be_null])
        if match == "full" and len(can_be_null) == len(key):
            some &= reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in key])
        parts.append(references.where(some))
    elif match == "partial":
        for size in range(1, min(len(can_be_null), len(key) - 1) + 1):
            for nulls in combinations(can_be_null, size):
                parts.append(anti(masked(nulls), [i for i in everything if i not in nulls]))
    return reduce(DataFrame.unionByName, parts)
