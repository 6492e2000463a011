"""Which files include which: edges from include lines, and all headers that a source reaches."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.sources.tables import let_go, stored


#: What a path has that may not be normal; most have not, and stay as they are.
_ODD = r"//|/$|^$|(?:^|/)\.\.?(?:/|$)"


def normal_path(path: Column) -> Column:
    """path without ``.``, empty parts and ``..`` behind a folder; a leading slash stays."""
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), none, step)
    made = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(path.rlike(_ODD), made).otherwise(path)


def edges(found: DataFrame, files: DataFrame, dirs: list[str]) -> DataFrame:
    """(location, line, name, target): each include line of the elements ``found`` with the file that it names, or null if that is not among files.

    A quoted name is looked for in the including file's folder and then in dirs, another only in dirs; the first place stands.
    """
    found = found.where("type = 'inclusion_directive' AND name IS NOT NULL").groupBy("location", "line", "name").agg(F.bool_or(F.col("include_kind") == "quoted").alias("quoted"))
    # read twice, but files are scanned once; of a line only its number goes to where its paths are looked up
    lines = stored(found.withColumn("id", F.monotonically_increasing_id()))
    folder = F.regexp_extract("location", r"^(.*/)?[^/]*$", 1)
    none = F.array().cast("array<string>")
    own = F.when(F.col("quoted"), F.array(normal_path(F.concat(folder, F.col("name"))))).otherwise(none)
    under = [F.concat(F.lit(d.rstrip("/") + "/"), F.col("name")) for d in dirs]
    # a name is looked at once for all dirs
    plain = [p if re.search(_ODD, d.rstrip("/") + "/x") is None else normal_path(p) for d, p in zip(dirs, under, strict=True)]
    given = F.when(F.col("name").rlike(_ODD), F.array(*map(normal_path, under))).otherwise(F.array(*plain)) if dirs else none
    tried = lines.select("id", F.posexplode(F.concat(own, given)).alias("rank", "target"))
    # a table of its own, so that Spark can split the many lines that name a frequent header
    there = stored(files.select(F.col("location").alias("target")).distinct())
    best = tried.join(there, "target").groupBy("id").agg(F.min_by("target", "rank").alias("target"))
    return lines.join(best, "id", "left").select("location", "line", "name", "target")


def closure(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(source, header, depth): all files that a source includes, directly (1) or through others, with the least depth.

    A file has one row with what it reaches, level by level, as numbers; in each round it takes from the files that it includes what these
    reached last, less what it has. So cycles end, and rows that are shuffled in a round number the files and edges, not the
    pairs. sources (location) limits where it begins: only what these reach is followed.
    """
    steps = stored(edges.where("target IS NOT NULL").select(F.col("location").alias("_from"), F.col("target").alias("_to")).distinct())
    if sources is not None:
        steps = _reachable(steps, sources)
    files = steps.select(F.col("_from").alias("name")).union(steps.select("_to")).distinct()
    names = stored(files.select("name", F.monotonically_increasing_id().alias("id")))
    number = lambda end: names.select(F.col("name").alias(end), F.col("id").alias(end[1:]))
    arcs = stored(steps.join(number("_from"), "_from").join(number("_to"), "_to").select("from", "to"))
    levels = "array<array<bigint>>"
    fresh = F.collect_list("to")
    state = stored(arcs.groupBy(F.col("from").alias("id")).agg(fresh.alias("fresh")).select("id", "fresh", F.array("fresh").alias("levels")))
    while not state.where("size(fresh) > 0").isEmpty():
        last = state.where("size(fresh) > 0").select(F.col("id").alias("to"), "fresh")
        reached = arcs.join(last, "to").select(F.col("from").alias("id"), "fresh", F.lit(None).cast(levels).alias("levels"))
        both = reached.unionByName(state.select("id", F.lit(None).cast("array<bigint>").alias("fresh"), "levels"))
        merged = both.groupBy("id").agg(F.flatten(F.collect_list("fresh")).alias("found"), F.first("levels", ignorenulls=True).alias("levels"))
        new = merged.select("id", F.array_except("found", F.flatten("levels")).alias("fresh"), "levels")
        before, state = state, stored(new.select("id", "fresh", F.concat("levels", F.array("fresh")).alias("levels")))
        let_go(before)
    begun = state if sources is None else state.join(number("_source").join(sources.select(F.col("location").alias("_source")).distinct(), "_source", "left_semi").select(F.col("source").alias("id")), "id", "left_semi")
    pairs = begun.join(names, "id").select(F.col("name").alias("source"), F.posexplode("levels").alias("pos", "reached"))
    pairs = pairs.select("source", (F.col("pos") + 1).alias("depth"), F.explode("reached").alias("id"))
    return pairs.join(names, "id").select("source", F.col("name").alias("header"), "depth")


def _reachable(steps: DataFrame, sources: DataFrame) -> DataFrame:
    """The steps (_from, _to) that begin in a source or in what sources reach; each file is followed once."""
    wave = stored(sources.select(F.col("location").alias("_from")).distinct())
    seen, out = wave, []
    while not wave.isEmpty():
        out.append(stored(steps.join(wave, "_from", "left_semi")))
        to = out[-1].select(F.col("_to").alias("_from")).distinct()
        wave = stored(to.join(seen, "_from", "left_anti"))
        seen = seen.unionByName(wave)
    return reduce(DataFrame.unionByName, out) if out else steps.where("false")
