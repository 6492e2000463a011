"""Names resolved across files: qualified names against a table of symbols, from the inside out.

A name that is written in a scope is looked for there, then in each scope around it, and last globally; at each step the namespaces
that a using-directive opened there count after the scope itself, and so do using-declarations and namespace aliases.
Each way to read a name is a row with its rank; one equi-join with the symbols, and the least rank that hits stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.keys import CLASS_LIKE
from loomline.sources.tables import stored

#: What ``owned`` and ``directives`` need of elements.
COLUMNS = ("type", "name", "location", "line", "col", "path", "namespace", "owner")
#: Kinds that names may refer to as owners or scopes.
SCOPES = (*CLASS_LIKE, "union_decl", "enum_decl", "namespace")
_OPENERS = "array<struct<kind:string,scope:array<string>,name:string,target:string,line:int>>"


def qualified(path: Column, name: Column) -> Column:
    """The whole name."""
    return F.array_join(F.concat(path, F.array(name)), "::")


def bare(name: Column) -> Column:
    """A written name without template arguments and blanks."""
    plain = name
    for _ in range(3):  # arguments within arguments
        plain = F.regexp_replace(plain, r"<[^<>]*>", "")
    return F.regexp_replace(plain, r"\s+", "")


def table(found: DataFrame, kinds: tuple[str, ...] = SCOPES) -> DataFrame:
    """(qualified, symbol): one symbol (id, type, location, line) per whole name of the elements found; of several the first by place, but namespaces last."""
    named = found.where(F.col("type").isin(*kinds) & F.col("name").isNotNull() & F.col("path").isNotNull())
    order = F.struct(F.col("type") == "namespace", "location", "line", "col")
    return named.groupBy(qualified(F.col("path"), F.col("name")).alias("qualified")).agg(F.min_by(F.struct("id", "type", "location", "line"), order).alias("symbol"))


def openers(found: DataFrame) -> DataFrame:
    """(location, openers): what a file's using-directives, using-declarations and namespace aliases open, each once per scope."""
    kinds = ("using_directive", "using_declaration", "namespace_alias")
    rows = found.where(F.col("type").isin(*kinds) & F.col("path").isNotNull())
    first = rows.groupBy("location", "type", "path", F.coalesce("name", F.lit("")).alias("name"), bare(F.col("namespace")).alias("target")).agg(F.min("line").alias("line"))
    one = F.struct(F.col("type").alias("kind"), F.col("path").alias("scope"), "name", "target", "line")
    return first.groupBy("location").agg(F.collect_list(one).cast(_OPENERS).alias("openers"))


def resolve(references: DataFrame, found: DataFrame, kinds: tuple[str, ...] = SCOPES) -> DataFrame:
    """references (ref, location, line, path, written) with ``symbol`` and ``qualified``: what each name stands for, null if nothing is found.

    ref is unique. found is read twice: a stored table. Only what a file opens before the reference, in a scope around it, counts.
    """
    refs = references.withColumn("_name", bare(F.col("written"))).join(openers(found), "location", "left")
    refs = refs.withColumn("openers", F.coalesce("openers", F.array().cast(_OPENERS)))
    n = F.size("path")
    global_ = F.col("_name").startswith("::")
    join = lambda scope, name: F.array_join(F.concat(scope, F.array(name)), "::")
    prefix = lambda p, k: F.slice(p, 1, F.greatest(k, F.lit(0)))
    ladder = lambda p, size, name, rank: F.transform(F.sequence(F.lit(0), size), lambda k: F.struct((rank + 2 * k).cast("int").alias("rank"), join(prefix(p, size - k), name).alias("qualified")))
    around = lambda o: (o["line"] < F.col("line")) & (F.size(o["scope"]) <= n) & (prefix(F.col("path"), F.size(o["scope"])) == o["scope"])
    head = F.substring_index("_name", "::", 1)
    tail = F.substring(F.col("_name"), F.length(head) + 1, F.length("_name"))

    def opened(o: Column) -> Column:
        """The names that an opener makes of the written one, looked for from its own scope outwards."""
        at = 2 * (n - F.size(o["scope"])) + 1
        name = F.when(o["kind"] == "using_directive", F.concat(o["target"], F.lit("::"), F.col("_name"))).when(o["name"] == head, F.concat(o["target"], tail))
        return F.transform(F.sequence(F.lit(0), F.size(o["scope"])), lambda k: F.struct(at.cast("int").alias("rank"), F.when(name.isNotNull(), join(prefix(o["scope"], F.size(o["scope"]) - k), name)).alias("qualified")))

    own = ladder(F.col("path"), n, F.col("_name"), F.lit(0))
    more = F.flatten(F.transform(F.filter("openers", around), opened))
    tried = F.when(global_, F.array(F.struct(F.lit(0).alias("rank"), F.substring(F.col("_name"), F.lit(3), F.length("_name")).alias("qualified")))).otherwise(F.concat(own, more))
    ways = refs.select("ref", F.explode(tried).alias("way")).select("ref", "way.rank", F.regexp_replace("way.qualified", "^::", "").alias("qualified")).where("qualified IS NOT NULL")
    # the symbols are a table of their own, so that Spark can split the many ways to read a frequent name
    hits = ways.join(stored(table(found, kinds)), "qualified").groupBy("ref").agg(F.min_by(F.struct("symbol", "qualified"), F.struct("rank", "qualified")).alias("_hit"))
    return references.join(hits, "ref", "left").select(*references.columns, F.col("_hit.symbol").alias("symbol"), F.col("_hit.qualified").alias("qualified"))


def owned(found: DataFrame) -> DataFrame:
    """Members defined outside of their classes, in any file, with the class they belong to: found's columns, and ``symbol`` and ``qualified`` of the owner.

    What the scanner found in the same file is looked up in the same way, so that the nearer class wins whichever file it is in.
    """
    kept = stored(found)
    outside = kept.where("owner IS NOT NULL")
    prefix = F.when(F.size("path") > 0, F.concat(F.array_join("path", "::"), F.lit("::"))).otherwise("")
    # a member found in its own file has the class's path: the scope it is written in is what the owner has more than its name
    scope = F.when(F.col("owner").startswith(prefix) & F.col("parent_id").isNull(), F.col("path")).otherwise(F.array().cast("array<string>"))
    written = F.when(F.col("owner").startswith(prefix) & F.col("parent_id").isNull(), F.substring(F.col("owner"), F.length(prefix) + 1, F.length("owner"))).otherwise(F.col("owner"))
    refs = outside.select(F.col("id").alias("ref"), "location", "line", scope.alias("path"), written.alias("written"))
    hits = resolve(refs, kept, (*CLASS_LIKE, "union_decl")).select("ref", "symbol", "qualified")
    return outside.join(hits, outside["id"] == hits["ref"], "left").drop("ref")


def directives(found: DataFrame) -> DataFrame:
    """Using-directives (location, line, namespace) with the namespace that each opens, by its whole name and place."""
    kept = stored(found)
    refs = kept.where("type = 'using_directive' AND path IS NOT NULL").select(F.col("id").alias("ref"), "location", "line", "path", F.col("namespace").alias("written"))
    return resolve(refs, kept, ("namespace",)).select("location", "line", F.col("written").alias("namespace"), "qualified", F.col("symbol.location").alias("opened_in"))
