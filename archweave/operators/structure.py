"""Structure rules over classes and files, invariants and their evidence, safety counts, completeness of a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.contract import Contract, StructureRule
from archweave.functions.paths import glob_to_regex

#: Sensors that never block.
ADVISORY_SENSORS = ("no-anemic-model",)

# Patterns that hint at what a file does.
_PREDICATES = r"\b(?:export\s+)?(?:async\s+)?function\s+(?:can|calculate|compute|should|ensure|validate|is|has)[A-Z]\w*|\b(?:export\s+)?const\s+(?:can|calculate|compute|should|ensure|validate|is|has)[A-Z]\w*\s*="
_BRANCHES = r"(?i)\bif\s*\(\s*(?:!)?(?:order|invoice|cart|user|account|policy|aggregate|entity|amount|total|balance|status|state)\b"
_IO = r"""\bfrom\s+['"](?:@?prisma/client|@supabase/|drizzle-orm|typeorm|knex|mongodb|pg|mysql2|better-sqlite3|ioredis|redis)['"]|require\(\s*['"](?:@?prisma/client|pg|knex|typeorm)"""
_HANDLER = r"\b(?:@Controller|@Get|@Post|@Put|@Delete|Router\(\)|createRouter|express\.Router|fastify\.(?:get|post)|export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|DELETE|PATCH)\b|export\s+const\s+(?:GET|POST|PUT|DELETE|PATCH)\s*=)"
_HTTP = r"""(?:^|[;\n])[^\S\n]*(?:import\s+(?:type\s+)?(?:[^;]{0,512}?\s+from\s+)?|export\s+(?:type\s+)?[^;]{0,512}?\s+from\s+)['"]next/server(?:\.js)?['"]"""
EXPORTS = r"\bexport\s+(?:async\s+)?(?:function|class|const|let|var|type|interface|enum|default)\b|\bexport\s*\{"
_MAPPING = r"\b(?:mapTo|toDomain|toDto|fromRow|toEntity|fromPrisma|serialize|deserialize)\w*\s*[(=]"


def derive_file_hints(sources: DataFrame) -> DataFrame:
    """sources (repo, path, content) -> (repo, path, orchestration_heavy, adapter_thick); short files have neither."""
    text = F.col("content")
    count = lambda p: F.regexp_count(text, F.lit(p))
    rows = sources.select("repo", "path", "content", count(_PREDICATES).alias("p"), count(_BRANCHES).alias("b"), count(r"\bif\s*\(").alias("i"), count(r"\bswitch\s*\(").alias("s"))
    heavy = (F.col("p") >= 2) | ((F.col("p") >= 1) & (F.col("b") >= 2)) | ((F.col("b") >= 3) & (F.col("i") + F.col("s") >= 6))
    io, handler, mapping = text.rlike(_IO), text.rlike(_HANDLER) | text.rlike(_HTTP), text.rlike(_MAPPING)
    signal = (F.col("p") >= 1) | (F.col("b") >= 2)
    thick = ((io | handler) & signal) | (io & mapping & ((F.col("i") >= 4) | (F.col("p") >= 1))) | (handler & io)
    enough = F.length(text) >= 40
    return rows.select("repo", "path", F.coalesce(enough & heavy, F.lit(False)).alias("orchestration_heavy"), F.coalesce(enough & thick, F.lit(False)).alias("adapter_thick"))


def count_lines_exports(sources: DataFrame) -> DataFrame:
    """(repo, path, n_lines, n_exports): lines as newlines and one."""
    return sources.select("repo", "path", (F.regexp_count("content", F.lit("\n")) + 1).cast("long").alias("n_lines"), F.regexp_count("content", F.lit(EXPORTS)).cast("long").alias("n_exports"))


def _in_scope(rule: StructureRule, path: Column, layer: Column) -> Column:
    """The rule's layer, and one of its globs if it has any; braces in them are literals."""
    found = layer == rule.layer
    if rule.globs:
        found &= path.rlike("|".join(glob_to_regex(g, braces=False) for g in rule.globs))
    return found


def _blocks(rule: StructureRule) -> bool:
    return rule.enforced and rule.sensor not in ADVISORY_SENSORS


def structure_violations(shapes: DataFrame, hints: DataFrame, files: DataFrame, contract: Contract) -> DataFrame:
    """(repo, structure_id, sensor, file, subject, fails_strict) of rules that classes or files break.

    shapes (repo, file, class_name, exported, public_setters, public_mutable, public_constructor, static_factory,
    data_only, mutating array<struct<name, guarded>>); hints as of ``derive_file_hints``; files (repo, path, layer).
    Rules are Column expressions, so each table is read once, whatever the number of rules.
    """
    placed = shapes.where("exported").join(files.where("layer is not null").select("repo", F.col("path").alias("file"), "layer"), ["repo", "file"])
    mutable = F.col("public_setters") | F.col("public_mutable")
    name = F.array(F.col("class_name"))
    none = F.array().cast("array<string>")
    unguarded = F.transform(F.filter("mutating", lambda m: ~m["guarded"]), lambda m: F.concat(F.col("class_name"), F.lit("."), m["name"]))
    subjects = {
        "aggregate-private-state": F.when(mutable, name).otherwise(none),
        "always-valid-factory": F.when(F.col("public_constructor") & ~F.col("static_factory") & (mutable | (F.size("mutating") > 0)), name).otherwise(none),
        "domain-event-on-mutation": unguarded,
        "no-anemic-model": F.when(F.coalesce("data_only", F.lit(False)), name).otherwise(none),
    }
    of_file = {"orchestration-only": F.col("orchestration_heavy"), "thin-adapter": F.col("adapter_thick")}

    def found(rows: DataFrame, rules: list[tuple[StructureRule, Column]]) -> DataFrame | None:
        if not rules:
            return None
        def of(rule: StructureRule, subjects: Column) -> Column:
            row = lambda s: F.struct(F.lit(rule.id).alias("structure_id"), F.lit(rule.sensor).alias("sensor"), s.alias("subject"), F.lit(_blocks(rule)).alias("fails_strict"))
            return F.transform(F.when(_in_scope(rule, F.col("file"), F.col("layer")), subjects).otherwise(none), row)

        each = F.flatten(F.array(*[of(r, c) for r, c in rules]))
        return rows.select("repo", "file", F.explode(each).alias("x")).select("repo", "x.structure_id", "x.sensor", "file", "x.subject", "x.fails_strict")

    hinted = hints.join(files.where("layer is not null"), ["repo", "path"]).withColumnRenamed("path", "file")
    parts = [
        found(placed, [(r, subjects[r.sensor]) for r in contract.structure if r.sensor in subjects]),
        found(hinted, [(r, F.when(of_file[r.sensor], F.array(F.col("file"))).otherwise(none)) for r in contract.structure if r.sensor in of_file]),
    ]
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.union, parts) if parts else files.sparkSession.createDataFrame([], "repo string, structure_id string, sensor string, file string, subject string, fails_strict boolean")


def empty_scope(files: DataFrame, contract: Contract) -> DataFrame:
    """(repo, rule, sensor, source, fails_strict) of structure rules and invariants whose globs match no file of a repository."""
    scoped = [(r.id, r.sensor, r.source, _blocks(r), r.globs) for r in contract.structure if r.globs] + [(i.id, "invariant-coverage", i.source, i.enforced, i.globs) for i in contract.invariants if i.globs]
    hits = [F.coalesce(F.bool_or(F.col("path").rlike("|".join(glob_to_regex(g, braces=False) for g in globs))), F.lit(False)).alias(f"hit_{i}") for i, (*_, globs) in enumerate(scoped)]
    schema = "array<struct<rule:string,sensor:string,source:string,fails_strict:boolean>>"
    missing = [F.when(~F.col(f"hit_{i}"), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("sensor"), F.lit(at).alias("source"), F.lit(b).alias("fails_strict"))) for i, (r, s, at, b, _) in enumerate(scoped)]
    rows = files.groupBy("repo").agg(*hits) if hits else files.select("repo").distinct()
    return rows.select("repo", F.explode(F.array_compact(F.array(*missing)) if missing else F.array().cast(schema)).alias("x")).select("repo", "x.*")


def _regex_literal(text: str) -> str:
    return "".join(f"\\{c}" if c in r".*+?^${}()|[]\/-" else c for c in text)


def invariant_coverage(sources: DataFrame, contract: Contract) -> DataFrame:
    """(repo, invariant, by_test, by_symbol, covered, partial, kind, fails_strict) of every invariant of every repository.

    sources (repo, path, content, is_test). A test file that mentions the id is evidence; so is a source that calls or
    defines the symbol (of 'Class.method', in a file that has the class too). Without test files nothing can be proven
    by tests: such an invariant is partial. kind: why it is uncovered, null if it isn't. One pass, one row a repository
    and task before the shuffle.
    """
    text, checks = F.coalesce(F.col("content"), F.lit("")), []
    for i, inv in enumerate(contract.invariants):
        mentioned = F.col("is_test") & text.contains(inv.id)
        symbol = F.lit(False)
        if inv.symbol:
            owner, _, method = inv.symbol.rpartition(".")
            called = text.rlike(rf"(?:function\s+|\b){_regex_literal(method)}\s*[(<]") | text.contains(inv.symbol)
            symbol = called & text.contains(owner.split(".")[0]) if owner else called
        checks += [F.bool_or(mentioned).alias(f"t_{i}"), F.bool_or(symbol).alias(f"s_{i}")]
    per_repo = sources.groupBy("repo").agg(F.coalesce(F.bool_or("is_test"), F.lit(False)).alias("has_tests"), *checks)
    rows = []
    for i, inv in enumerate(contract.invariants):
        wants = inv.test is not False
        by_test = F.col("has_tests") & F.lit(wants) & F.col(f"t_{i}")
        by_symbol = F.col(f"s_{i}")
        any_ = by_test | by_symbol
        partial = ~F.col("has_tests") & F.lit(wants) & ~any_
        covered = any_ | F.lit(inv.test is False and not inv.symbol)
        kind = F.when(covered & ~partial, F.lit(None).cast("string")).when(F.col("has_tests"), "tests-disappeared").otherwise("never-had-tests")
        rows.append(F.struct(F.lit(inv.id).alias("invariant"), by_test.alias("by_test"), by_symbol.alias("by_symbol"), (covered & ~partial).alias("covered"), partial.alias("partial"), kind.alias("kind"), (F.lit(inv.enforced) & ~(covered & ~partial) & ~partial).alias("fails_strict")))
    schema = "array<struct<invariant:string,by_test:boolean,by_symbol:boolean,covered:boolean,partial:boolean,kind:string,fails_strict:boolean>>"
    return per_repo.select("repo", F.explode(F.array(*rows) if rows else F.array().cast(schema)).alias("x")).select("repo", "x.*")


# The warning of each kind of safety finding.
_SAFETY = {
    "dynamic-import": "DYNAMIC_IMPORT_NOT_ALLOWLISTED",
    "dynamic-require": "DYNAMIC_REQUIRE_NOT_ALLOWLISTED",
    "ts-suppression": "TS_SUPPRESSION_THRESHOLD_EXCEEDED",
    "any-cast": "ANY_CAST_THRESHOLD_EXCEEDED",
    "in-memory-store": "IN_MEMORY_STORE_IN_PRODUCTION_SOURCE",
}


def safety_report(uses: DataFrame, repos: DataFrame, contract: Contract, most: dict[str, int] | None = None, allowed: tuple[str, ...] = (), allow_in_memory: bool = False, allow_disabled_peers: bool = False) -> DataFrame:
    """(repo, rule_id, n, file, line): one row for each kind whose count is above its threshold, with the first evidence.

    uses (repo, file, line, ordinal, kind). most: threshold by kind, 0 if not named. allowed: globs of files whose dynamic
    imports were reviewed. Rules of the contract that should isolate peers but don't are a kind of their own, without a file.
    """
    kinds = [k for k in _SAFETY if k != "in-memory-store" or not allow_in_memory]
    rows = uses.where(F.col("kind").isin(kinds))
    if allowed:
        rows = rows.where(~(F.col("kind").startswith("dynamic-") & F.col("file").rlike("|".join(glob_to_regex(g) for g in allowed))))
    limit = reduce(lambda w, k: w.when(F.col("kind") == k, (most or {}).get(k, 0)), kinds, F.when(F.lit(False), 0))
    rule = reduce(lambda w, k: w.when(F.col("kind") == k, _SAFETY[k]), kinds, F.when(F.lit(False), ""))
    first = F.min_by(F.struct("file", "line"), "ordinal")
    counted = rows.groupBy("repo", "kind").agg(F.count("*").alias("n"), first.alias("x")).where(F.col("n") > limit)
    found = counted.select("repo", rule.alias("rule_id"), "n", "x.file", "x.line")
    open_peers = 0 if allow_disabled_peers else sum(not r.allowed and r.source == r.target and not r.peer_isolation for r in contract.rules)
    if not open_peers:
        return found
    return found.union(repos.select("repo", F.lit("PEER_ISOLATION_DISABLED"), F.lit(open_peers).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("long")))


def completeness_verdict(repos: DataFrame, violations: DataFrame, warnings: DataFrame, invariants: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo, completeness, n_blocking, n_warnings, valid, strict_valid), also of clean repositories.

    snapshots (repo, completeness, requirements_match): facts that were collected for other requirements prove nothing
    (unavailable). An enforced invariant that is partial makes a complete analysis partial. valid: complete, and nothing
    blocks; strict: and no warning fails strict. violations (repo, fails_strict), warnings (repo, fails_strict).
    """
    enforced = invariants.groupBy("repo").agg(F.bool_or(F.col("partial") & F.col("enforced")).alias("open"))
    blocking = violations.groupBy("repo").agg(F.count_if("fails_strict").alias("n_blocking"))
    warned = warnings.groupBy("repo").agg(F.count("*").alias("n_warnings"), F.count_if("fails_strict").alias("n_strict"))
    joined = repos.join(snapshots, "repo", "left").join(enforced, "repo", "left").join(blocking, "repo", "left").join(warned, "repo", "left").fillna(0, ["n_blocking", "n_warnings", "n_strict"])
    base = F.when(F.coalesce("requirements_match", F.lit(False)), F.col("completeness")).otherwise("unavailable")
    done = F.when((base == "complete") & F.coalesce("open", F.lit(False)), "partial").otherwise(base)
    valid = (done == "complete") & (F.col("n_blocking") == 0)
    return joined.select("repo", done.alias("completeness"), "n_blocking", "n_warnings", valid.alias("valid"), (valid & (F.col("n_strict") == 0)).alias("strict_valid"))


def contract_warnings(files: DataFrame, contract: Contract, samples: int = 5) -> DataFrame:
    """(repo, code, layer, detail, n, fails_strict): what is off about a contract as such, and on the files of each repository.

    files (repo, path, layer). Patterns are matched in one pass of aggregates; samples of unclassified files are the
    first by path, held as a bounded array a repository.
    """
    known = [x.name for x in contract.layers]
    fixed = [] if contract.layers else [("CONFIG_NO_LAYERS", None, None)]
    fixed += [("CONFIG_LAYER_WITHOUT_PATTERNS", x.name, None) for x in contract.layers if not x.patterns]
    fixed += [("CONFIG_DUPLICATE_LAYER", n, None) for n in dict.fromkeys(n for n in known if known.count(n) > 1)]
    for r in contract.rules if known else ():
        fixed += [("CONFIG_RULE_UNKNOWN_FROM_LAYER", r.source, r.target)] if r.source not in known else []
        fixed += [("CONFIG_RULE_UNKNOWN_TO_LAYER", r.source, r.target)] if r.target not in known else []
    globs = [(x.name, p) for x in contract.layers if not x.optional for p in x.patterns]
    hits = [F.coalesce(F.bool_or(F.col("path").rlike(glob_to_regex(p))), F.lit(False)).alias(f"hit_{i}") for i, (_, p) in enumerate(globs)]
    first = W.partitionBy("repo").orderBy("path")
    lone = files.where("layer is null").select("repo", "path", F.row_number().over(first).alias("k"))
    lone = lone.groupBy("repo").agg(F.max("k").cast("long").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= samples, F.col("path")))), ",").alias("paths"))
    per_repo = files.groupBy("repo").agg(F.count("*").alias("files"), *hits).join(lone, "repo", "left")
    row = lambda code, layer, detail, n, strict: F.struct(F.lit(code).alias("code"), F.lit(layer).cast("string").alias("layer"), (detail if isinstance(detail, Column) else F.lit(detail)).cast("string").alias("detail"), n.cast("long").alias("n"), F.lit(strict).alias("fails_strict"))
    each = [row(c, a, b, F.lit(None), True) for c, a, b in fixed]
    each += [F.when(~F.col(f"hit_{i}"), row("CONFIG_LAYER_PATTERN_NO_MATCHES", name, p, F.lit(None), False)) for i, (name, p) in enumerate(globs)]
    each += [F.when(F.col("n") > 0, row("CONFIG_UNCLASSIFIED_FILES", None, F.col("paths"), F.col("n"), True))]
    return per_repo.select("repo", F.explode(F.array_compact(F.array(*each))).alias("x")).select("repo", "x.*")
