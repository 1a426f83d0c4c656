"""Who calls whom and which file needs which: joins on names, with names that say too little left out first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from .ranking import numbered, paged


def _functions(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("symbol_type").isin("function", "method"))


def trusted_names(chunks: DataFrame, least: int = rules.NAME_CHARS, most: int = rules.SAME_NAME) -> DataFrame:
    """repo and short_name of functions whose name is long enough and shared by few; all languages count together."""
    counted = _functions(chunks).where(F.length("short_name") >= least).groupBy("repo", "short_name").agg(F.count("*").alias("n_same"))
    return counted.where(F.col("n_same") <= most)


def _callees(chunks: DataFrame, least: int, most: int) -> DataFrame:
    # tables of names grow with the code, whatever their estimated size: joined by sorting, here and where callees are used
    named = _functions(chunks).join(trusted_names(chunks, least, most).hint("merge"), ["repo", "short_name"], "left_semi")
    return named.select("repo", F.col("short_name").alias("called"), F.col("path").alias("callee_path"), F.col("pos").alias("callee_pos"),
                        F.col("language").alias("callee_language"), F.col("name").alias("callee"), F.col("signature").alias("callee_signature"))


def call_edges(chunks: DataFrame, least: int = rules.NAME_CHARS, most: int = rules.SAME_NAME) -> DataFrame:
    """A row per caller and callee: the called name is trusted, the language is the same, and they differ.

    ord is the place of the call among the caller's called names. Names are filtered before the join, so a frequent
    name never meets its callers.
    """
    calls = _functions(chunks).select("repo", "path", "pos", "language", F.col("name").alias("caller"), F.posexplode("called_names").alias("ord", "called"))
    joined = calls.join(_callees(chunks, least, most).hint("merge"), ["repo", "called"]).where(
        (F.col("language") == F.col("callee_language")) & ((F.col("path") != F.col("callee_path")) | (F.col("pos") != F.col("callee_pos"))))
    keys = ["repo", "path", "pos", "language", "caller", "callee_path", "callee_pos", "callee", "callee_signature"]
    return joined.groupBy(*keys).agg(F.min("ord").alias("ord"))


def callees_of(edges: DataFrame, most: int = 4) -> DataFrame:
    """The first callees of each caller that have a signature, in call order: their signatures and distinct names."""
    order = Window.partitionBy("repo", "path", "pos").orderBy("ord", "callee_path", "callee_pos")
    first = edges.where(F.length("callee_signature") > 0).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    taken = F.array_sort(F.collect_list(F.struct("k", "callee_signature", F.element_at(F.split("callee", "::", -1), -1).alias("short"))))
    rows = first.groupBy("repo", "path", "pos").agg(taken.alias("t"))
    return rows.select("repo", "path", "pos", F.transform("t", lambda t: t["callee_signature"]).alias("signatures"),
                       F.array_distinct(F.transform("t", lambda t: t["short"])).alias("names"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def callers_of(edges: DataFrame, named: int = 3) -> DataFrame:
    """Per callee: how many callers, in how many other files, and a sentence that names the first few."""
    # bounded: only the first callers in order are kept in the row
    order = Window.partitionBy("repo", "callee_path", "callee_pos").orderBy("path", "pos")
    ranked = edges.withColumn("k", F.row_number().over(order))
    other = F.when(F.col("path") != F.col("callee_path"), F.col("path"))
    first = F.array_sort(F.collect_list(F.when(F.col("k") <= named, F.struct("k", F.concat("caller", F.lit(" in "), file_name(F.col("path"))).alias("t")))))
    rows = ranked.groupBy("repo", "callee_path", "callee_pos").agg(F.count("*").alias("n_callers"), F.count_distinct(other).alias("n_other_files"), first.alias("first"))
    shown = F.array_join(F.transform("first", lambda x: x["t"]), ", ")
    more = F.when(F.col("n_callers") > named, F.concat(F.lit(" and "), F.col("n_callers") - named, F.lit(" more"))).otherwise("")
    where = F.when(F.col("n_other_files") > 0, F.concat(F.lit(", "), "n_other_files", F.lit(" of them in other files"))).otherwise("")
    plural = F.when(F.col("n_callers") == 1, "").otherwise("s")
    text = F.concat(F.lit("It is called by "), "n_callers", F.lit(" function"), plural, F.lit(" ("), shown, more, F.lit(")"), where, F.lit("."))
    return rows.select("repo", F.col("callee_path").alias("path"), F.col("callee_pos").alias("pos"), "n_callers", "n_other_files", text.alias("summary"))


def hot_callees(loop_calls: DataFrame, chunks: DataFrame, least: int = rules.NAME_CHARS, most: int = rules.SAME_NAME) -> DataFrame:
    """Functions called inside a loop of another leaf function, with the first such place, whatever the languages.

    loop_calls has repo, path, pos, caller, line, ord and called. The first place of each name in a caller is taken
    before the join.
    """
    place = F.struct("path", "pos", "line", "ord", "caller")
    per_name = loop_calls.groupBy("repo", "called", "path", "pos").agg(F.min(place).alias("place"))
    joined = per_name.join(_callees(chunks, least, most).hint("merge"), ["repo", "called"]).where((F.col("path") != F.col("callee_path")) | (F.col("pos") != F.col("callee_pos")))
    first = joined.groupBy("repo", "callee_path", "callee_pos", "callee").agg(F.min("place").alias("place"))
    return first.select("repo", F.col("callee_path").alias("path"), F.col("callee_pos").alias("pos"), "callee",
                        F.col("place.path").alias("caller_path"), F.col("place.caller").alias("caller"), F.col("place.line").alias("line"))


def _normal(path: Column) -> Column:
    """A path without . and .. parts; null if it leads out of the top folder."""
    step = lambda done, part: F.when(part == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1))).when(
        part.isin("", "."), done).otherwise(F.array_append(done, part))
    return F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")


def resolve_includes(includes: DataFrame, files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """repo, path, target, kind (internal, local or external) and dependency of every include.

    internal: files of the repository, by path. A target means the files whose path ends with it: dir/h.h, or a.b.c as c in a
    folder ending a/b. A relative target (leading dots of Python, . and .. in a path) is looked up from the including file's
    folder alone. The join is on the last part; the rest is compared after it. All matches are kept, a file never depends
    on itself.
    local: what is no internal file but stands beside the including one in listing (repo, path of all files, read or not; without
    it, files), and relative modules that are not found: own code, by the first part of a module or as written.
    external: everything else, and system includes that are no file of the repository: as written, of Python the first part.
    """
    python = F.endswith("path", F.lit(".py"))
    system = F.coalesce("is_system", F.lit(False)) if "is_system" in includes.columns else F.lit(False)
    wanted = includes.select("repo", "path", "target", python.alias("python"), system.alias("system")).distinct()
    here = F.regexp_replace("path", r"/?[^/]*$", "")
    n_dots = F.length(F.regexp_extract("target", r"^(\.*)", 1))
    module = F.replace(F.regexp_replace("target", r"^\.+", ""), F.lit("."), F.lit("/"))
    relative = F.when(F.col("python"), n_dots > 0).otherwise(F.regexp_like("target", F.lit(r"(^|/)\.\.?/")))
    up = F.when(F.col("python") & (n_dots > 1), F.repeat(F.lit("../"), (n_dots - 1).cast("int"))).otherwise("")
    beside = F.concat(here, F.lit("/"), up, F.when(F.col("python"), module).otherwise(F.col("target")))
    parts = F.when(F.col("python"), F.split("target", r"\.", -1)).otherwise(F.split("target", "/", -1))
    wanted = wanted.select("*", relative.alias("relative"), _normal(beside).alias("beside"), parts.alias("parts"))
    wanted = wanted.withColumn("last", F.element_at("parts", -1)).withColumn("folders", F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/"))

    name = file_name(F.col("path"))
    stem = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    listed = files.select("repo", F.col("path").alias("file"), F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), name.alias("name"), stem.alias("stem")).distinct()
    by_key = listed.select("repo", "file", "folder", F.explode(F.array(F.struct(F.lit(True).alias("python"), F.col("stem").alias("last")), F.struct(F.lit(False).alias("python"), F.col("name").alias("last")))).alias("k"))
    by_key = by_key.select("repo", "file", "folder", "k.python", "k.last")
    ends = (F.col("folders") == "") | (F.col("folder") == F.col("folders")) | F.endswith("folder", F.concat(F.lit("/"), "folders"))
    found = wanted.where(~F.col("relative")).join(by_key.hint("merge"), ["repo", "python", "last"]).where(ends & (F.col("file") != F.col("path"))).select("repo", "path", "target", "file")

    spots = F.when(F.col("python"), F.array(F.concat("beside", F.lit(".py")), F.concat("beside", F.lit("/__init__.py")))).otherwise(F.array("beside"))
    spots = wanted.select("repo", "path", "target", "relative", F.explode(spots).alias("file"))
    known = files.select("repo", F.col("path").alias("file")).distinct()
    there = spots.where("relative and file <> path").join(known.hint("merge"), ["repo", "file"], "left_semi").select("repo", "path", "target", "file")
    internal = found.unionByName(there).select("repo", "path", "target", F.lit("internal").alias("kind"), F.col("file").alias("dependency"))
    rest = wanted.join(internal.select("repo", "path", "target").hint("merge"), ["repo", "path", "target"], "left_anti")
    standing = known if listing is None else listing.select("repo", F.col("path").alias("file")).distinct()
    near = spots.where("file <> path").join(standing.hint("merge"), ["repo", "file"], "left_semi").select("repo", "path", "target", F.lit(True).alias("near")).distinct()
    rest = rest.join(near.hint("merge"), ["repo", "path", "target"], "left")
    is_local = ~F.col("system") & (F.col("near").isNotNull() | (F.col("python") & F.col("relative")))
    first = F.when(F.col("python") & ~F.col("relative"), F.element_at("parts", 1)).otherwise(F.col("target"))
    rest = rest.select("repo", "path", "target", F.when(F.coalesce(is_local, F.lit(False)), "local").otherwise("external").alias("kind"), first.alias("dependency"))
    return internal.unionByName(rest).distinct()


def file_edges(resolved: DataFrame) -> DataFrame:
    return resolved.where("kind = 'internal'").select("repo", "path", "dependency").distinct()


def used_by(edges: DataFrame, named: int = 1000) -> DataFrame:
    """Per file how many files depend on it, and the first of them by path, at most `named`; used_by_pages gives all."""
    first = edges.withColumn("k", F.row_number().over(Window.partitionBy("repo", "dependency").orderBy("path"))).where(F.col("k") <= named)
    first = first.groupBy("repo", "dependency").agg(F.sort_array(F.collect_list("path")).alias("used_by"))
    rows = edges.groupBy("repo", "dependency").agg(F.count("*").alias("n_users")).join(first.hint("merge"), ["repo", "dependency"])
    return rows.select("repo", F.col("dependency").alias("path"), "n_users", "used_by")


def used_by_pages(edges: DataFrame, size: int = 1000) -> DataFrame:
    """Per file and page all files that depend on it, sorted: path, page, used_by (an array of at most size)."""
    rows = paged(edges.select("repo", F.col("dependency").alias("used"), "path"), ["repo", "used"], "path", size)
    return rows.select("repo", F.col("used").alias("path"), "page", F.col("path").alias("used_by"))


def core_files(edges: DataFrame, most: int = 4) -> DataFrame:
    """The files with the most users in each repository."""
    counted = edges.groupBy("repo", "dependency").agg(F.count_distinct("path").alias("n_users"))
    order = Window.partitionBy("repo").orderBy(F.desc("n_users"), "dependency")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("repo", F.col("dependency").alias("path"), "n_users", "place")


def dependency_edges(edges: DataFrame, most: int = 40) -> DataFrame:
    """The first edges of each repository's diagram; files are numbered over all edges."""
    ends = edges.select("repo", F.explode(F.array("path", "dependency")).alias("file")).distinct()
    number = numbered(ends, ["repo"], ["file"], "id").withColumn("id", (F.col("id") - 1).cast("int"))
    order = Window.partitionBy("repo").orderBy("path", "dependency")
    ranked = edges.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    ranked = ranked.join(edges.groupBy("repo").agg(F.count("*").alias("n_edges")), "repo")
    a = number.select("repo", F.col("file").alias("path"), F.col("id").alias("from_id"))
    b = number.select("repo", F.col("file").alias("dependency"), F.col("id").alias("to_id"))
    return ranked.join(a, ["repo", "path"]).join(b, ["repo", "dependency"]).select(
        "repo", "path", "dependency", "from_id", "to_id", "k", (F.col("n_edges") > most).alias("is_cut"))


def import_inventory(
    includes: DataFrame, files: DataFrame, standard: tuple[str, ...], install_names: dict[str, str] | None = None, required: tuple[str, ...] = (), page_size: int = 1000
) -> DataFrame:
    """Packages that Python files import from outside: not relative, not of the standard library, no file of the repository.

    install_name, whether the package is required (else optional), how many files import it, place: the order in which packages are first
    seen, by path and line; and the names of the files, sorted by path, a row for each page of at most page_size.
    """
    line = F.col("line") if "line" in includes.columns else F.lit(0)
    python = includes.where(F.endswith("path", F.lit(".py")) & ~F.startswith("target", F.lit(".")) & ~F.regexp_like("path", F.lit(r"(^|/)(\.[^/]*|__pycache__)/")))
    rows = python.select("repo", F.element_at(F.split("target", r"\.", -1), 1).alias("package"), "path", line.alias("line"))
    stems = files.select("repo", F.regexp_replace(file_name(F.col("path")), r"(.)\.[^.]*$", "$1").alias("package")).distinct()
    outside = rows.where(~F.col("package").isin(*standard)).join(stems, ["repo", "package"], "left_anti")
    each = outside.groupBy("repo", "package", "path").agg(F.min("line").alias("line"))
    used = each.groupBy("repo", "package").agg(F.count("*").alias("n_files"), F.min(F.struct("path", "line", "package")).alias("_first"))
    # one row per package: as many as there are names of packages
    used = used.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("_first"))).drop("_first")
    names = F.create_map(*[F.lit(x) for pair in install_names.items() for x in pair]) if install_names else None
    used = used.withColumn("install_name", F.coalesce(names[F.col("package")], F.col("package")) if names is not None else F.col("package"))
    used = used.withColumn("is_required", F.col("package").isin(*required) if required else F.lit(False))
    pages = paged(each, ["repo", "package"], "path", page_size).withColumn("path", F.transform("path", file_name)).withColumnRenamed("path", "files")
    return used.join(pages, ["repo", "package"])
