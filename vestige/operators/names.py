"""Names that look like known ones: folded, in another scope, or a few edits away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import confusables, osa

#: The least length of a bare name that may be swapped into another scope, and of a name that edits are looked for in.
SWAPPED, EDITED = 4, 6


def scope(name: Column) -> Column:
    """@scope of @scope/name, else ''."""
    return F.regexp_extract(name, "^(@[^/]+)/", 1)


def bare(name: Column) -> Column:
    return F.regexp_replace(name, "^@[^/]+/", "")


def package_name(spec: Column) -> Column:
    """A package's lower-cased name without its version."""
    s = F.regexp_replace(F.lower(F.trim(spec)), "(?<=.)==.*", "")
    return F.regexp_replace(s, "(?<=.)@.*", "")


def deletions(name: Column, most: int) -> Column:
    """name and what is left of it without up to so many of its characters."""
    out = F.array(name)
    for _ in range(most):
        out = F.array_distinct(F.flatten(F.transform(out, lambda v: F.concat(F.array(v), F.when(F.length(v) > 0, F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1)))).otherwise(F.array().cast("array<string>"))))))
    return out


def look_alikes(specs: DataFrame, known: DataFrame, most: int = 1) -> DataFrame:
    """Names of specs (a column spec) that look like a known one (a column name): name, looks_like, rule, distance.

    rule is "scope" (the same name, plain or folded, in another scope or none), "fold" (equal when look-alike characters are folded) or "edit"
    (at most so many edits by optimal string alignment), in this order; of a name the first rule's least known one is given.  A name that
    is known, null or empty, one with a URL, or one in a known name's scope looks like none.

    Candidates meet by equal keys: folded names, folded bare names, and deletion neighbours (two names within d edits share one of what is
    left of them without up to d characters), so no name is compared with all.  Each name is looked at once, however often it is there.
    """
    k = known.select(package_name(F.col("name")).alias("known")).where("known <> ''").distinct()
    n = specs.select(package_name(F.col("spec")).alias("name")).where("name <> '' and name not like 'git+%' and name not like '%://%'").distinct()
    n = n.join(k, n.name == k.known, "left_anti")
    owners = k.select(scope(F.col("known")).alias("owner")).where("owner <> ''").distinct()
    n = n.join(owners, scope(F.col("name")) == owners.owner, "left_anti")

    def keys(name: Column) -> Column:
        folded, own = confusables(name), bare(name)
        sides = [F.array(F.concat(F.lit("f:"), folded)), F.when(F.length(own) >= SWAPPED, F.array(F.concat(F.lit("s:"), own), F.concat(F.lit("s:"), confusables(own)))).otherwise(F.array().cast("array<string>"))]
        sides.append(F.when(F.length(name) >= EDITED - most, F.transform(deletions(name, most), lambda v: F.concat(F.lit("e:"), v))).otherwise(F.array().cast("array<string>")))
        return F.explode(F.array_distinct(F.concat(*sides)))

    pairs = n.withColumn("key", keys(F.col("name"))).join(k.withColumn("key", keys(F.col("known"))), "key").select("name", "known").distinct()
    swapped = (scope(F.col("name")) != scope(F.col("known"))) & (F.length(bare(F.col("known"))) >= SWAPPED) & ((bare(F.col("name")) == bare(F.col("known"))) | (confusables(bare(F.col("name"))) == confusables(bare(F.col("known")))))
    far = pairs.withColumn("distance", osa(F.col("name"), F.col("known")))
    rule = F.when(swapped, 1).when(confusables(F.col("name")) == confusables(F.col("known")), 2).when((F.length("name") >= EDITED) & (F.col("distance") <= most), 3)
    best = far.withColumn("r", rule).where("r is not null").groupBy("name").agg(F.min(F.struct("r", "known", "distance")).alias("b"))
    return best.select("name", F.col("b.known").alias("looks_like"), F.element_at(F.array(F.lit("scope"), F.lit("fold"), F.lit("edit")), F.col("b.r")).alias("rule"), F.col("b.distance").alias("distance"))
