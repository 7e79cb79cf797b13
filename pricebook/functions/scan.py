"""Regular-expression matches with their positions, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

_MARK = "\u0001"
#: Up to as many matches each measures all text before it.
_FEW = 16


def matches(c: Column, pattern: str) -> Column:
    """array<struct<hit string, at int>>: every match and its 0-based character offset.

    The text is split around marked matches; hits sit at the odd positions and the
    length of the pieces before one gives its offset (a running length where there are many).
    """
    pieces = F.split(F.regexp_replace(F.replace(c, F.lit(_MARK), F.lit("")), f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    nothing = F.from_json(F.lit("[]"), "array<struct<hit:string,at:int>>")
    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("odd"), nothing.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        found = F.array(F.struct(piece.alias("hit"), acc["pos"].alias("at")))
        return F.struct(
            (acc["pos"] + F.length(piece)).alias("pos"),
            (~acc["odd"]).alias("odd"),
            F.when(acc["odd"], F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"),
        )

    def few(p: Column) -> Column:
        def hit(k: Column) -> Column:
            before = F.slice(p, F.lit(1), 2 * k - 1)
            return F.struct(F.get(p, 2 * k - 1).alias("hit"), F.length(F.array_join(before, "")).alias("at"))

        return F.transform(F.sequence(F.lit(1), F.shiftright(F.size(p), 1)), hit)

    def one(p: Column) -> Column:
        return F.array(F.struct(F.get(p, F.lit(1)).alias("hit"), F.length(F.get(p, F.lit(0))).alias("at")))

    # One piece: no match.
    found = let(
        pieces,
        lambda p: F.when(F.size(p) == 3, one(p))
        .when(F.size(p) > 2 * _FEW + 1, F.aggregate(p, start, step, lambda acc: acc["out"]))
        .when(F.size(p) > 1, few(p)),
    )
    return F.coalesce(found, nothing)


def around(c: Column, at: Column, before: int, width) -> Column:
    """The slice of ``width`` characters that starts ``before`` characters ahead of ``at``."""
    return F.substring(c, F.greatest(at - before, F.lit(0)) + 1, width if isinstance(width, Column) else F.lit(width))


def any_of(words: list[str]) -> str:
    """A pattern that matches any of the given literal texts; most places fail at a look at their first character."""
    firsts = "".join(sorted({w[0] if w[0].isalnum() else "\\" + w[0] for w in words}))
    return f"(?=[{firsts}])(?:" + "|".join("\\Q" + w + "\\E" for w in words) + ")"
