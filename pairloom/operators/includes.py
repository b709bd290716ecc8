"""Include directories of source files, and what files include directly and through others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

# fixed values: directory names that are tried as include directories, in this order
INCLUDE_DIRS = (
    "include", "inc", "src", "lib", "common", "public", "headers",
    "third_party", "external", "vendor", "deps", "dependencies",
)
INCLUDE = r"""(?m)^[ \t]*#[ \t]*include[ \t]*["<]([^">\n]+)[">]"""


def included_names(content: Column) -> Column:
    """Names in the include lines of a source text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(INCLUDE), F.lit(1)))


def _folders(path: Column) -> Column:
    """The directories above a relative path, the nearest first; the root is the empty text."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def include_dirs(files: DataFrame, names: tuple[str, ...] = INCLUDE_DIRS) -> DataFrame:
    """project, path, dirs: existing directories of these names below each directory from the file's own up to
    the project's root, nearest first, then in the order of the names.

    ``files``: project, path (relative to the project's root, ``/`` between parts). A
    directory exists if some file of the project lies in or below it. The join is on the
    directory, so a project of any size is spread.
    """
    tmp = Scratch(files.sparkSession, "include-dirs")
    own = tmp.save(files.where("project IS NOT NULL AND path IS NOT NULL").select("project", "path").distinct(), "files")
    there = own.select("project", F.explode(_folders(F.col("path"))).alias("dir")).where("dir <> ''").distinct()
    last = F.element_at(F.split("dir", "/"), -1)
    order = F.array_position(F.array(*map(F.lit, names)), last)
    named = there.withColumn("nth", order).where("nth > 0").select("project", "dir", "nth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.size(F.split("dir", "/")) - 1), "/").alias("above"))
    above = own.select("project", "path", F.posexplode(_folders(F.col("path"))).alias("level", "above"))
    found = above.join(tmp.save(named, "named"), ["project", "above"])
    dirs = found.groupBy("project", "path").agg(F.array_sort(F.collect_list(F.struct("level", "nth", "dir"))).alias("d"))
    return own.join(dirs, ["project", "path"], "left").select("project", "path", F.coalesce(F.transform("d", lambda x: x.dir), F.array().cast("array<string>")).alias("dirs"))


def include_edges(files: DataFrame, names: tuple[str, ...] = INCLUDE_DIRS) -> DataFrame:
    """project, path, included (null where no file of the project has the name), name: a row for each include line.

    ``files``: project, path, content. A name is looked for in the file's own directory,
    then in its include directories, then in the root.
    """
    tmp = Scratch(files.sparkSession, "include-edges")
    lines = tmp.save(files.select("project", "path", F.explode(included_names(F.col("content"))).alias("name")), "lines")
    dirs = include_dirs(files.select("project", "path"), names)
    places = dirs.select("project", "path", F.array_distinct(F.concat(F.array(F.get(_folders(F.col("path")), F.lit(0))), "dirs", F.array(F.lit("")))).alias("places"))
    tried = lines.join(places, ["project", "path"]).select("project", "path", "name", F.posexplode("places").alias("nth", "place"))
    plain = F.regexp_replace(F.concat_ws("/", F.nullif("place", F.lit("")), "name"), r"(^|/)(\./)+", "$1")
    # a/../b is b
    plain = F.regexp_replace(F.regexp_replace(plain, r"[^/]+/\.\./", ""), r"[^/]+/\.\./", "")
    there = tmp.save(files.where("path IS NOT NULL").select("project", F.col("path").alias("included")).distinct(), "there")
    hits = tried.withColumn("included", plain).join(there, ["project", "included"]).groupBy("project", "path", "name").agg(F.min_by("included", "nth").alias("included"))
    return lines.join(hits, ["project", "path", "name"], "left").select("project", "path", "included", "name")


def reach(edges: DataFrame, source: str, target: str, hops: int = 4) -> DataFrame:
    """All pairs (source, target) joined by a path of one edge or more; on a cycle a node reaches itself.

    Paths of up to ``hops`` edges (a power of two) come from joining the edges with themselves. Each
    further round joins the pairs that the last one found with them, and keeps what is new, so a
    graph takes depth / hops rounds and a pair is extended once. Nulls are no nodes.
    """
    tmp = Scratch(edges.sparkSession, "reach")
    step = tmp.save(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s IS NOT NULL AND t IS NOT NULL").distinct(), "step1")
    n = 1
    while n < hops:
        n *= 2
        step = tmp.save(step.unionByName(_joined(step, step)).distinct(), f"step{n}")
    reached = new = step
    k = 0
    while not new.isEmpty():
        k += 1
        more = _joined(new, step).distinct().join(reached, ["s", "t"], "left_anti")
        new = tmp.save(more, f"new{k}")
        reached = reached.unionByName(new)
    return reached.select(F.col("s").alias(source), F.col("t").alias(target))


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("s", F.col("t").alias("m")).join(b.select(F.col("s").alias("m"), "t"), "m").select("s", "t")
