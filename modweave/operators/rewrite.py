"""The import rewrite plan as tables: which statements can go straight to definitions, and why others cannot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modweave.operators.analyses import SKIPS


def scope(sites: DataFrame, only: str | None = None, barrel: str | None = None) -> DataFrame:
    """Sites whose importer matches the regular expression ``only`` and whose target is ``barrel``, where given."""
    out = sites if only is None else sites.where(F.col("module").rlike(only))
    return out if barrel is None else out.where(F.col("target") == barrel)


def statement_skips(symbols: DataFrame) -> DataFrame:
    """(module, ord, reason) of statements that stay: a barrel with side effects, else a namespace, else the first binding's reason."""
    first = F.min_by("skip", F.when(F.col("skip").isNotNull(), F.col("bord")))
    per = symbols.groupBy("module", "ord").agg(F.bool_or("side_effects").alias("effects"), F.bool_or(F.col("imported") == "*").alias("whole"), first.alias("first"))
    reason = F.when(F.col("effects"), "barrelHasSideEffects").when(F.col("whole"), "namespaceImport").otherwise(F.col("first"))
    return per.select("module", "ord", reason.alias("reason")).where("reason is not null")


def merge_conflicts(symbols: DataFrame, imports: DataFrame, bindings: DataFrame) -> DataFrame:
    """Statements with a definition module that the same file imports as a namespace elsewhere: (module, ord)."""
    whole = bindings.where("imported = '*'").join(imports, ["module", "ord"]).select("module", F.col("ord").alias("other"), F.col("target").alias("def_module"))
    return symbols.where("verdict = 'definition'").join(whole, ["module", "def_module"]).where("ord != other").select("module", "ord").distinct()


def targets(symbols: DataFrame, skipped: DataFrame) -> DataFrame:
    """(module, ord, def_module, names) of statements that are rewritten whole: what comes from which definition module, in binding order."""
    kept = symbols.join(skipped.select("module", "ord"), ["module", "ord"], "left_anti").where("skip is null")
    named = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("bord", "def_name"))), lambda s: s["def_name"]))
    return kept.groupBy("module", "ord", "def_module").agg(F.array_join(named, ", ").alias("names"))


def skip_totals(skips: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SKIPS)), F.col("reason"))
    return skips.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), rank)


def style_vote(specifiers: DataFrame) -> DataFrame:
    """(module, style) by majority of a module's internal specifiers; a tie takes the style of the first."""
    relative = F.startswith("specifier", F.lit("."))
    per = specifiers.groupBy("module").agg(F.count_if(relative).alias("r"), F.count_if(~relative).alias("a"), F.min_by(relative, F.col("ord")).alias("first"))
    style = F.when(F.col("r") > F.col("a"), "relative").when(F.col("r") < F.col("a"), "alias").otherwise(F.when(F.col("first"), "relative").otherwise("alias"))
    return per.select("module", style.alias("style"))
