"""Path functions as column expressions. Paths are ordered by component, so order by ``parts(path)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: str | Column) -> Column:
    return F.split(path, "/")


def normalize(path: str | Column) -> Column:
    """Canonical key: ``\\`` to ``/``, a leading ``//?/`` gone, empty, ``.`` and ``..`` segments collapsed, leading ``/`` kept."""
    text = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^//\\?/", "")
    kept = F.filter(F.split(text, "/"), lambda s: (s != "") & (s != "."))
    stack = F.aggregate(
        kept,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(F.startswith(text, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(stack, "/"))


def directory_of(path: str | Column) -> Column:
    """Parent directory; ``.`` for a bare name."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), "/")).otherwise(F.lit("."))


def directory_prefix(path: str | Column, depth: int | Column) -> Column:
    """The first ``depth`` components of the parent directory; ``.`` at depth 0 or for a bare name."""
    p = parts(path)
    n = F.least(F.size(p) - 1, F.lit(depth) if isinstance(depth, int) else depth)
    return F.when(n > 0, F.array_join(F.slice(p, 1, F.greatest(n, F.lit(0))), "/")).otherwise(F.lit("."))


def depth_of(path: str | Column) -> Column:
    return F.size(parts(path)) - 1


def file_name(path: str | Column) -> Column:
    return F.element_at(parts(path), -1)


def ancestors(path: str | Column) -> Column:
    """All prefixes of a path by component, itself first, the empty one (the root) last."""
    p = parts(path)
    return F.transform(F.sequence(F.size(p), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(p, 1, F.greatest(n, F.lit(0))), "/"))


def relative_specifier(source: str | Column, target: str | Column) -> Column:
    """How the module ``source`` imports ``target``: common directories stripped, ``..`` per directory left, no extension, ``./`` in front."""
    d, t = F.slice(parts(source), 1, F.greatest(F.size(parts(source)) - 1, F.lit(0))), parts(F.regexp_replace(target, r"\.(d\.ts|[cm]?[jt]sx?)$", ""))
    shared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.size(d), F.size(t) - 1), F.lit(1))),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (i <= F.size(d)) & (i <= F.size(t) - 1) & (F.get(d, i - 1) == F.get(t, i - 1)), i).otherwise(n),
    )
    up = F.size(d) - shared
    rest = F.array_join(F.slice(t, shared + 1, F.size(t)), "/")
    return F.when(up > 0, F.concat(F.repeat(F.lit("../"), up), rest)).otherwise(F.concat(F.lit("./"), rest))
