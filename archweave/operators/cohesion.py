"""Concepts that lie scattered over a tree: from file names and folders to findings and the one move to begin with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# File names that a framework owns, folders that say nothing, words that are noise.
_FRAMEWORK = r"(?i)^(route|page|layout|index|loading|error|template|default|not-found|middleware|proxy|actions?|handler)$"
_SKIPPED = r"(?i)^(\[.*\]|\(.*\)|src|app|apps|api|lib|libs|pages|packages|modules|components|utils|helpers|hooks|server|client|shared|common|__tests__|tests?|e2e|examples?|dist|build)$"
_NOISE = "^(use|api|get|set|app|lib|the|new)$"
_EXTENSION = r"\.(ts|tsx|js|jsx|mjs|cjs)$"
_CONVENTION = "(^|/)(app|pages)(/|$)"
#: A cluster's least size, that of a mirror, findings shown, files from which an anchor is worth a pilot.
CLUSTER, MIRROR, FINDINGS, PILOT = 40, 20, 5, 10


def first_word(name: Column) -> Column:
    """The first camel-case word of three letters or more that isn't noise, in lower case."""
    words = F.transform(F.regexp_extract_all(name, F.lit("([A-Z]?[a-z0-9]+|[A-Z]+(?![a-z]))"), F.lit(1)), F.lower)
    return F.get(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(_NOISE)), F.lit(0))


def classify_physical(path: Column) -> Column:
    """struct<concept, anchor> of a file, null where nothing says anything.

    Mostly the first word of its name, at its folder. A framework's file has the topmost folder that means something,
    at the path above it.
    """
    parts = F.split(path, "/")
    n = F.size(parts)
    base = F.regexp_replace(F.element_at(parts, -1), _EXTENSION, "")
    folders = F.slice(parts, 1, n - 1)
    at = lambda k: F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, k), "/"), F.lit("")), F.lit("."))
    named = F.struct(first_word(base).alias("concept"), at(n - 1).alias("anchor"))
    hits = F.filter(F.transform(folders, lambda s, i: F.struct(F.when(~s.rlike(_SKIPPED), first_word(s)).alias("concept"), i.alias("i"))), lambda x: x["concept"].isNotNull())
    top = F.get(hits, F.lit(0))
    owned = F.struct(top["concept"].alias("concept"), at(top["i"]).alias("anchor"))
    found = F.when(base.rlike(_FRAMEWORK), owned).otherwise(named)
    return F.when(path.rlike(_EXTENSION) & found["concept"].isNotNull(), found)


def anchors(files: DataFrame) -> DataFrame:
    """files (repo, path) -> (repo, concept, anchor, n)."""
    found = files.select("repo", classify_physical(F.col("path")).alias("x")).where("x is not null")
    return found.groupBy("repo", F.col("x.concept").alias("concept"), F.col("x.anchor").alias("anchor")).agg(F.count("*").alias("n"))


def physical_cohesion(counted: DataFrame, cluster: int = CLUSTER, mirror: int = MIRROR, most: int = FINDINGS) -> DataFrame:
    """``anchors`` -> (repo, concept, n_files, max_cluster, n_anchors, mirrored, place): the worst ``most`` of each repository."""
    one = counted.groupBy("repo", "concept").agg(F.sum("n").alias("n_files"), F.max("n").alias("max_cluster"), F.count("*").alias("n_anchors"), (F.count_if(F.col("n") >= mirror) >= 2).alias("mirrored"))
    found = one.where((F.col("max_cluster") >= cluster) | F.col("mirrored"))
    return found.withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("max_cluster"), "concept")).cast("long")).where(F.col("place") <= most)


def reshape_pilot(findings: DataFrame, counted: DataFrame) -> DataFrame:
    """(repo, concept, anchor, n, target) of each repository's first finding: the smallest anchor that may move and is worth it.

    Where none has ``PILOT`` files, the largest; what a framework owns or the target folder has already stays. A
    repository whose first concept has nothing to move has no row.
    """
    top = findings.where("place = 1").select("repo", "concept")
    target = F.concat(F.lit("src/features/"), "concept")
    fixed = F.concat("anchor", F.lit("/")).rlike(_CONVENTION) | (F.col("anchor") == target) | F.col("anchor").startswith(F.concat(target, F.lit("/")))
    movable = counted.join(top, ["repo", "concept"], "left_semi").where(~fixed)
    big = F.col("n") >= PILOT
    pick = F.min(F.struct((~big).cast("int").alias("small"), F.when(big, F.col("n")).otherwise(-F.col("n")).alias("by"), "anchor", "n"))
    # Of small anchors the largest counts, and of equals the last by name, as the end of the ascending list.
    last = F.max(F.struct("n", "anchor"))
    rows = movable.groupBy("repo", "concept").agg(pick.alias("x"), last.alias("y"))
    use = lambda c: F.when(F.col("x.small") == 0, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    return rows.select("repo", "concept", use("anchor").alias("anchor"), use("n").alias("n"), target.alias("target"))


def reshape_moves(pilots: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """(repo, from_path, to_path): the first ``most`` files of each pilot and where they would go."""
    placed = files.select("repo", "path", classify_physical(F.col("path")).alias("x")).where("x is not null").select("repo", "path", "x.concept", "x.anchor")
    rows = placed.join(pilots.select("repo", "concept", "anchor", "target"), ["repo", "concept", "anchor"])
    ranked = rows.withColumn("k", F.row_number().over(W.partitionBy("repo").orderBy("path"))).where(F.col("k") <= most)
    return ranked.select("repo", F.col("path").alias("from_path"), F.concat("target", F.lit("/"), F.regexp_extract("path", "[^/]*$", 0)).alias("to_path"))


# Words of folders that stand for persistence, and folders of the other layers.
PERSISTENCE_WORDS = (
    *("turso", "prisma", "supabase", "airtable", "drizzle", "kysely", "mongoose", "mongodb", "firebase", "firestore", "planetscale", "neon"),
    *("pipedrive", "repository", "repositories", "persistence", "infrastructure", "infra", "db", "auth", "session"),
)
FOLDER_LAYERS = {"DomainModel": ("domain", "entities", "models"), "ApplicationOrchestration": ("application", "use-cases", "usecases", "services", "workflows"), "PresentationAdapters": ("presentation", "components", "pages", "app", "ui", "views", "controllers", "routes")}


def suggest_layer(folder: Column) -> Column:
    """The layer that a folder's path suggests, null if none: API shells, domain, persistence words, then the deepest known folder.

    A folder below ``lib`` is never presentation.
    """
    path = F.array_join(F.filter(F.split(folder, r"[/\\]"), lambda s: s != ""), "/")
    lower = F.lower(path)
    words = "|".join(PERSISTENCE_WORDS)
    base = F.regexp_replace(F.regexp_extract(lower, "[^/]*$", 0), r"\.(ts|tsx|js|jsx|mjs|cjs)$", "")
    persists = base.rlike(rf"^({words})([._-].*)?$") | lower.rlike(rf"/({words})(/|$)") | lower.rlike(rf"^({words})/")
    shell = path.rlike(r"(?:^|/)(?:src/)?(?:app|pages)(?:/[^/]+)*/api(?:/|$)") | (path.rlike(r"(?:^|/)api(?:/|$)") & ~path.rlike(r"(?:^|/)app(?:/|$)"))
    known = {name: layer for layer, own in FOLDER_LAYERS.items() for name in own}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    layers = F.transform(F.filter(F.split(path, "/"), lambda s: ~s.isin("lib", "src")), lambda s: F.try_element_at(table, s))
    under_lib = F.array_contains(F.split(path, "/"), "lib")
    fit = F.filter(layers, lambda x: x.isNotNull() & ~(under_lib & (x == "PresentationAdapters")))
    return F.when(shell, "ApplicationOrchestration").when(path.rlike("(?:^|/)domain(?:/|$)"), "DomainModel").when(persists, "PersistenceAdapters").when(F.size(fit) > 0, F.element_at(fit, -1))
