"""From raw specifiers to edges: joins against the set of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import paths

# Fixed value: what a specifier without an extension may stand for, in order.
SUFFIXES = ("", ".ts", ".tsx", ".d.ts", ".mts", ".cts", "/index.ts", "/index.tsx")


def _normal(path: Column) -> Column:
    """A path with ``.`` and ``..`` worked out; excess ``..`` stops at the root."""
    step = lambda done, part: F.when((part == ".") | (part == ""), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def typescript_edges(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """(src, dst, kind, line, specifier): relative, root and aliased specifiers that name a project file; others are dropped.

    Each (folder, specifier) is resolved once: candidates in order of preference
    meet the file set by equality, and the least place wins.
    """
    asked = imports.where("skipped = 0").select(F.col("path").alias("src"), "specifier", "kind", "line")
    folder = F.when(paths.folder_of("src") == ".", "").otherwise(paths.folder_of("src"))
    asked = asked.withColumn("folder", F.when(F.startswith("specifier", F.lit(".")), folder).otherwise(""))
    distinct = asked.select("folder", "specifier").distinct()
    relative = F.when(F.startswith("specifier", F.lit(".")), F.concat_ws("/", "folder", "specifier"))
    bases = [relative, *[F.when(F.startswith("specifier", F.lit(a)), F.concat(F.lit(b), F.when(F.lit(a.endswith("/")), "/").otherwise(""), F.substr("specifier", F.lit(len(a) + 1)))) for a, b in aliases]]
    base = F.filter(F.array(*bases), lambda x: x.isNotNull())
    clean = F.transform(base, lambda x: F.regexp_replace(_normal(x), r"\.[cm]?jsx?\z", ""))
    every = F.flatten(F.transform(clean, lambda x: F.array(*[F.concat(x, F.lit(s)) for s in SUFFIXES])))
    tried = distinct.select("folder", "specifier", F.posexplode(every).alias("ord", "id"))
    found = tried.join(files.select("id"), "id").groupBy("folder", "specifier").agg(F.min_by("id", "ord").alias("dst"))
    return asked.join(found, ["folder", "specifier"]).select("src", "dst", "kind", "line", "specifier")


def python_keys(files: DataFrame) -> DataFrame:
    """(key, id): dotted names from the root and from each file's source root; on a collision the least path wins."""
    parts = F.split(F.regexp_replace("id", r"\.py\z", ""), "/")
    rows = files.select("id", parts.alias("p")).withColumn("init", F.element_at("p", -1) == "__init__").withColumn("dir", F.slice("p", 1, F.size("p") - 1))
    inits = rows.where("init").select(F.array_join("dir", "/").alias("pkg")).distinct()
    # how deep the run of packages above a file goes
    above = rows.select("id", F.explode(F.sequence(F.lit(0), F.size("dir"))).alias("n"), "dir").withColumn("pkg", F.array_join(F.slice("dir", F.lit(1), F.col("n")), "/")).where("n > 0")
    plain = above.join(inits, "pkg", "left_anti").groupBy("id").agg(F.max("n").alias("stop"))
    rows = rows.join(plain, "id", "left").withColumn("stop", F.coalesce("stop", F.lit(0)))
    named = F.when(F.col("init"), F.col("dir")).otherwise(F.col("p"))
    local = F.slice(named, F.col("stop") + 1, F.greatest(F.size(named) - F.col("stop"), F.lit(0)))
    keys = rows.select("id", F.explode(F.array_distinct(F.array(F.array_join(named, "."), F.array_join(local, ".")))).alias("key")).where("key <> ''")
    return keys.groupBy("key").agg(F.min("id").alias("id"))


def python_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, kind, line) of absolute and relative imports; self-edges and what isn't in the project are dropped."""
    rows = imports.where("skipped = 0").select(F.col("path").alias("src"), "is_from", "module", "names", "level", "kind", "line")
    names = F.filter("names", lambda x: x != "*")
    absolute = rows.where("level = 0").select("src", "kind", "line", F.explode(F.concat(F.array("module"), F.when(F.col("is_from"), F.transform(names, lambda x: F.concat_ws(".", "module", x))).otherwise(F.array().cast("array<string>")))).alias("key"))
    flat = absolute.join(python_keys(files), "key").select("src", F.col("id").alias("dst"), "kind", "line")
    folder = F.slice(F.split("src", "/"), 1, F.size(F.split("src", "/")) - 1)
    base = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - (F.col("level") - 1), F.lit(0)))
    target = F.concat(base, F.when(F.col("module") == "", F.array().cast("array<string>")).otherwise(F.split("module", "\\.")))
    relative = rows.where("level > 0").withColumn("t", target).select("src", "kind", "line", F.explode(F.concat(F.array("t"), F.transform(names, lambda x: F.concat(F.col("t"), F.array(x))))).alias("t"))
    tried = relative.select("src", "kind", "line", F.posexplode(F.array(F.concat(F.array_join("t", "/"), F.lit(".py")), F.array_join(F.concat("t", F.array(F.lit("__init__.py"))), "/"))).alias("ord", "id"), F.array_join("t", "/").alias("want"))
    near = tried.join(files.select("id"), "id").groupBy("src", "kind", "line", "want").agg(F.min_by("id", "ord").alias("dst")).select("src", "dst", "kind", "line")
    return flat.unionByName(near).where("src <> dst")


def function_graph(facts: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, raw edges) of functions, by name: own file first, then imported names, ``this`` methods, constructors.

    A use belongs to the innermost declaration around it (the greatest start at or
    before it), else to its file's top-level code.
    """
    decls = facts.where("fact = 'function'").groupBy("path", "name").agg(F.min_by(F.struct("line", "start", "stop"), "start").alias("d")).select("path", "name", "d.*")
    nodes = decls.select(F.concat_ws("#", "path", "name").alias("id"), F.col("path").alias("file"), "line")
    links = facts.where("fact = 'import'").select("path", F.col("target").alias("specifier"), F.lit("value").alias("kind"), "line", F.lit(0).alias("skipped")).distinct()
    resolved = typescript_edges(links.select("path", "specifier", "kind", "line", "skipped"), files, aliases)
    targets = resolved.select(F.col("src").alias("path"), F.col("dst").alias("from_file"), "specifier").distinct()
    bound = facts.where("fact = 'import'").select("path", F.col("name").alias("local"), F.col("owner").alias("name"), F.col("target").alias("specifier")).join(targets, ["path", "specifier"]).drop("specifier")
    foreign = bound.join(decls.select(F.col("path").alias("from_file"), "name"), ["from_file", "name"]).select("path", "local", F.concat_ws("#", "from_file", "name").alias("dst"))
    constructors = decls.where(F.endswith("name", F.lit(".constructor"))).select("path", F.regexp_replace("name", r"\.constructor\z", "").alias("cls"), F.concat_ws("#", "path", "name").alias("dst"))
    uses = facts.where("fact IN ('call', 'reference', 'new', 'method')").select("path", "fact", "name", "line", F.col("start").alias("at"))
    around = uses.join(decls.select("path", F.col("name").alias("caller"), "start", "stop"), "path").where("start <= at AND at <= stop").groupBy("path", "fact", "name", "line", "at").agg(F.max_by("caller", "start").alias("caller"))
    uses = uses.join(around, ["path", "fact", "name", "line", "at"], "left")
    own = uses.where("fact IN ('call', 'reference')").join(decls.select("path", "name", F.concat_ws("#", "path", "name").alias("dst")), ["path", "name"])
    other = uses.where("fact IN ('call', 'reference')").join(foreign.withColumnRenamed("local", "name"), ["path", "name"])
    made = uses.where("fact = 'new'").join(constructors.withColumnRenamed("cls", "name"), ["path", "name"])
    afar = bound.join(constructors.select(F.col("path").alias("from_file"), F.col("cls").alias("name"), "dst"), ["from_file", "name"]).select("path", F.col("local").alias("name"), "dst")
    made_afar = uses.where("fact = 'new'").join(afar, ["path", "name"])
    cls = F.regexp_extract("caller", r"^(.*)\.[^.]*$", 1)
    methods = uses.where("fact = 'method'").withColumn("dst", F.concat(F.col("path"), F.lit("#"), cls, F.lit("."), F.col("name"))).join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    columns = ["path", "fact", "caller", "dst", "line"]
    every = reduce(DataFrame.unionByName, [f.select(*columns) for f in (own, other, made, made_afar, methods)])
    src = F.concat_ws("#", "path", F.coalesce("caller", F.lit("<module>")))
    edges = every.select(src.alias("src"), "dst", F.when(F.col("fact") == "reference", "reference").otherwise("call").alias("kind"), "line")
    top = edges.where(F.endswith("src", F.lit("#<module>"))).select(F.col("src").alias("id")).distinct().select("id", paths.file_of("id").alias("file"), F.lit(1).alias("line"))
    return nodes.unionByName(top), edges


def unused_imports(facts: DataFrame) -> DataFrame:
    """(file, line, name): imported names without a use; imports for side effects bind nothing."""
    uses = facts.where("fact = 'use'").select("path", "name").distinct()
    return facts.where("fact = 'binding'").select("path", "name", "line").join(uses, ["path", "name"], "left_anti").select(F.col("path").alias("file"), "line", "name")
