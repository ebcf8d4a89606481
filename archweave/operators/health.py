"""Design health of repositories: smells, false greens, honesty of baselines, fitness, pilots and plans.

All reports are aggregates keyed by repository; evidence lists are bounded top-k lists, found by row_number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.contract import Contract
from archweave.operators import structure

# What paths and contents hint at.
_PERSISTENCE_PATH = r"(?i)(?:^|/)(?:repositories?|persistence|infra/(?:db|data|persistence)|adapters/(?:persistence|repository)|data-access)(?:/|$)"
_UI_PATH = r"(?i)(?:^|/)(?:components?|pages|hooks|ui|views|screens|app/(?:\(.*\)/)?[^/]+/page\.|app/.*/page\.)"
_ROUTE_PATH = r"(?i)(?:^|/)(?:routes?|controllers?|api/|pages/api/|app/api/|handlers?)(?:/|$)|(?:route|controller|handler)\.(?:ts|tsx|js|jsx)$"
_NOT_PRODUCT = (
    r"(?i)(?:^|/)(?:tests?|__tests__|fixtures?|testdata|mocks?|stubs?|examples?|samples?|seeds?|seeders?|migrations?|demos?|generated|codegen)(?:/|$)"
    r"|(?:^|/)(?:(?:fixture|seed|seeder|migration|demo|generated)|[^/]*(?:\.generated|\.gen|[-_.](?:fixture|seed|seeder|migration|demo|generated)))\.(?:ts|tsx|js|jsx|mts|cts)$"
)
_BANNER = r"(?i)(?:@generated|GENERATED FILE|generated by|do not edit)"
_ROUTE_CALL = r"\bdefineRoute\s*(?:<[\s\S]{1,512}?>)?\s*\("
_ROUTE_DECLARATION = r"\b(?:export\s+)?(?:declare\s+)?(?:async\s+)?function\s+defineRoute\s*(?:<[\s\S]{1,512}?>)?\s*\("
_RULE_NAMES = r"\b(?:export\s+)?(?:(?:async\s+)?function\s+((?:can|calculate|compute|should)[A-Z]\w*)|const\s+((?:can|calculate|compute|should)[A-Z]\w*)\s*=)"
_UI_DECISION = r"(?i)^(?:can(?:Edit|Delete|View|Manage|Select|Open|Close)|should(?:Show|Render|Display|Open|Close|Disable|Enable))"
_UI_STATE = (
    r"(?i)\b(?:permissions?|roles?|acl|session|currentUser|isOwner|readOnly|useState|useMemo|useContext|localState|uiState|selected(?:Id|Row|Tab)?"
    r"|is(?:Open|Closed|Expanded|Collapsed|Selected|Loading|Pending|Hovered|Focused|Disabled))\b(?:\s*\.\s*\w+|\s*\[[^\]]+\])*"
)
_STRINGS = r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*\""""
_BUSINESS = r"(?i)\b(?:amount|total|price|tax|discount|balance|quantity|inventory|order|cart|invoice|credit|policy|threshold|limit|status)\b"
_SOURCE_FILE = r"\.(ts|tsx|js|jsx|mts|cts)$"
_IO_FOLDERS = ("airtable", "supabase", "prisma", "drizzle", "typeorm", "sequelize", "mongoose", "knex", "kysely", "firebase", "firestore", "mongodb", "persistence", "repositories", "repository")
#: Bounds of a god module; smells in the order in which pilots are picked.
GOD_LINES, GOD_EXPORTS = 400, 12
PILOT_ORDER = ("facade-sql-in-routes", "io-under-application", "handler-in-persistence", "domain-logic-in-ui", "god-module", "soft-contract", "mixed-pattern-cluster")
CORES = ("DomainModel", "ApplicationOrchestration", "PersistenceAdapters", "PresentationAdapters")


def _rules_in_ui(text: Column) -> Column:
    """Whether some rule-like helper is declared, other than a mere UI decision: up to 800 characters or ';' are looked at."""
    # The names are looked for first: the long capture, three times a text, is paid at helpers only, not at every keyword.
    names = _RULE_NAMES.replace("((?:can", "(?:(?:can")
    pattern = rf"(?={names})(?=((?s:.{{0,800}}))){_RULE_NAMES}"
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "rest"), (2, "f"), (3, "c"))])

    def is_rule(x: Column) -> Column:
        name = F.when(x["f"] != "", x["f"]).otherwise(x["c"])
        until = F.instr(x["rest"], ";")
        statement = F.when(until > 0, F.substring(x["rest"], F.lit(1), until)).otherwise(x["rest"])
        at = F.call_function("instr", statement, name)
        bare = F.concat(F.substring(statement, F.lit(1), at - 1), F.substring(statement, at + F.length(name), F.length(statement)))
        context = F.regexp_replace(F.regexp_replace(bare, _STRINGS, ""), _UI_STATE, "")
        return ~name.rlike(_UI_DECISION) | context.rlike(_BUSINESS)

    return F.exists(found, is_rule)


def smell_evidence(sources: DataFrame, contract: Contract) -> DataFrame:
    """sources (repo, path, content, layer) -> (repo, smell, path) of files that show one. Map-only."""
    text, path, layer = F.col("content"), F.col("path"), F.coalesce(F.col("layer"), F.lit(""))
    io, handler = text.rlike(structure._IO), text.rlike(structure._HANDLER) | text.rlike(structure._HTTP)
    defines = F.regexp_count(text, F.lit(_ROUTE_CALL)) > F.regexp_count(text, F.lit(_ROUTE_DECLARATION))
    exports = F.regexp_count(text, F.lit(structure.EXPORTS))
    lines = F.regexp_count(text, F.lit("\n")) + 1
    tests = {
        "god-module": (lines >= GOD_LINES) & (exports >= GOD_EXPORTS) & ~path.rlike(_NOT_PRODUCT) & ~F.substring(text, 1, 400).rlike(_BANNER),
        "domain-logic-in-ui": (path.rlike(_UI_PATH) | layer.rlike("(?i)presentation")) & _rules_in_ui(text),
        "facade-sql-in-routes": path.rlike(_ROUTE_PATH) & io,
        "io-under-application": layer.rlike("(?i)application|orchestr") & io & ~F.regexp_extract(path, "[^/]*$", 0).rlike("(?i)port|adapter|repository"),
        "handler-in-persistence": (path.rlike(_PERSISTENCE_PATH) | layer.rlike("(?i)persist")) & (handler | defines),
    }
    rows = sources.where(path.rlike(_SOURCE_FILE) & ~path.rlike(r"node_modules/|\.d\.ts$") & (text != ""))
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    return rows.select("repo", F.explode(found).alias("smell"), "path")


def smell_paths(evidence: DataFrame, files: DataFrame, without_rules: DataFrame) -> DataFrame:
    """(repo, smell, path), all of them: of files (``smell_evidence``), of layers without rules, and of layouts that are mixed.

    without_rules (repo, layer), only of layers that have files; files (repo, path).
    """
    layouts = {"layout:features/*": r"/features/[^/]+/|^features/", "layout:hex-domain-application-infra": r"/(?:domain|application|infrastructure|adapters)/", "layout:services/*": r"/(?:services|modules)/[^/]+/|(?:^|/)services/[^/]+\.(?:ts|tsx)$"}
    flags = files.where(F.col("path").rlike(_SOURCE_FILE)).groupBy("repo").agg(F.count("*").alias("n"), *[F.bool_or(F.col("path").rlike(p)).alias(f"l{i}") for i, p in enumerate(layouts.values())])
    hits = F.array_compact(F.array(*[F.when(F.col(f"l{i}"), F.lit(k)) for i, k in enumerate(layouts)]))
    mixed = flags.select("repo", "n", hits.alias("hits")).where("size(hits) >= 2 and n >= 8").select("repo", F.lit("mixed-pattern-cluster").alias("smell"), F.explode("hits").alias("path"))
    soft = without_rules.select("repo", F.lit("soft-contract").alias("smell"), F.concat(F.lit("layer:"), F.col("layer")).alias("path"))
    return evidence.union(mixed).union(soft)


def design_smells(evidence: DataFrame, files: DataFrame, without_rules: DataFrame, most: int = 12) -> DataFrame:
    """(repo, smell, n, evidence): of what ``smell_paths`` finds, how many, and the first ``most``, joined."""
    ranked = smell_paths(evidence, files, without_rules).withColumn("k", F.row_number().over(W.partitionBy("repo", "smell").orderBy("path")))
    top = F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.col("path"))))
    return ranked.groupBy("repo", "smell").agg(F.count("*").alias("n"), F.array_join(top, ",").alias("evidence"))


def design_fitness(smells: DataFrame, coverage: DataFrame, blocking: DataFrame) -> DataFrame:
    """(repo, n_smells, status): design-weak if nothing blocks, there are files, half of them governed, and smells are left."""
    one = coverage.groupBy("repo").agg(F.max("total").alias("total"), F.max("percent").alias("percent"))
    joined = one.join(smells.groupBy("repo").agg(F.count("*").alias("n_smells")), "repo", "left").join(blocking.select("repo", "n_blocking"), "repo", "left").fillna(0, ["n_smells", "n_blocking"])
    weak = (F.col("n_blocking") == 0) & (F.col("total") > 0) & (F.col("percent") >= 50) & (F.col("n_smells") > 0)
    return joined.select("repo", "n_smells", F.when(weak, "design-weak").when(F.col("n_smells") > 0, "smells-with-open-edges").otherwise("ok").alias("status"))


def false_green_risk(coverage: DataFrame, files: DataFrame, contract: Contract) -> DataFrame:
    """(repo, empty_cores, io_paths): core layers are empty while application globs cover folders of persistence.

    Folders are looked for one and two levels below the fixed part of each glob.
    """
    bases = sorted({"/".join(_fixed_part(g)) for x in contract.layers if any(w in x.name.lower() for w in ("application", "orchestr")) for g in x.patterns} - {""})
    core = F.col("layer").rlike("(?i)^domain") | F.col("layer").rlike("(?i)persist|infra|dataaccess")
    empty = coverage.where((F.col("n_files") == 0) & core).groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("empty_cores"))
    hits = []
    for base in bases:
        rest = F.split(F.substring(F.col("path"), len(base) + 2, 10_000), "/")
        inside = F.col("path").startswith(f"{base}/")
        for depth in (1, 2):
            at = F.get(rest, F.lit(depth - 1))
            hits.append(F.when(inside & (F.size(rest) > depth) & F.lower(at).isin(*_IO_FOLDERS), F.concat_ws("/", F.lit(base), F.array_join(F.slice(rest, 1, depth), "/"))))
    if not hits:
        return empty.limit(0).withColumn("io_paths", F.lit(""))
    folders = files.select("repo", F.explode(F.array_compact(F.array(*hits))).alias("folder")).groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("folder")), ",").alias("io_paths"))
    return empty.join(folders, "repo").select("repo", "empty_cores", "io_paths")


def _fixed_part(glob: str) -> list[str]:
    out = []
    for part in glob.split("/"):
        if set(part) & set("*?{["):
            break
        out.append(part)
    return out


def baseline_honesty(counts: DataFrame) -> DataFrame:
    """counts (repo, has_baseline, frozen, active, suppressed, total) -> (repo, status).

    dirty-freeze: nothing is active, but 10 keys are frozen, or 5 and some suppress, or half of three or more findings.
    """
    share = F.col("suppressed") / F.greatest(F.col("total"), F.lit(1))
    dirty = (F.col("active") == 0) & (F.col("frozen") > 0) & ((F.col("frozen") >= 10) | ((F.col("frozen") >= 5) & (F.col("suppressed") > 0)) | ((F.col("total") >= 3) & (share >= 0.5)))
    status = F.when(~F.col("has_baseline"), F.when(F.col("total") > 0, "missing-with-debt").otherwise("absent")).when(dirty, "dirty-freeze").when(F.col("frozen") > 0, "active-freeze").otherwise("empty-freeze")
    return counts.select("repo", status.alias("status"))


def fitness_score(coverage: DataFrame, violations: DataFrame, gates: DataFrame, contract: Contract) -> DataFrame:
    """(repo, parts, score, tone): 0.4 coverage, 0.3 clean edges, 0.2 gates that are on, 0.1 density of deny rules.

    gates (repo, on). A repository without gates counts as 40.
    """
    half_up = lambda c: F.floor(c + 0.5)
    layers, denied = len(contract.layers), sum(not r.allowed for r in contract.rules)
    density = min(100, int(denied / max(1, layers * (layers - 1)) * 120 + 0.5)) if layers else 0
    one = coverage.groupBy("repo").agg(F.max("percent").alias("of_coverage"))
    joined = one.join(violations.groupBy("repo").agg(F.count("*").alias("n")), "repo", "left").fillna(0, ["n"])
    joined = joined.join(gates.groupBy("repo").agg(half_up(F.count_if("on") / F.count("*") * 100).alias("g")), "repo", "left")
    parts = joined.select("repo", F.col("of_coverage").cast("long"), F.greatest(F.lit(0), 100 - F.least(F.lit(100), F.col("n") * 4)).cast("long").alias("of_edges"), F.coalesce("g", F.lit(40)).cast("long").alias("of_gates"), F.lit(density).cast("long").alias("of_rules"))
    score = half_up((F.col("of_coverage") * 4 + F.col("of_edges") * 3 + F.col("of_gates") * 2 + F.col("of_rules")) / 10).cast("long")
    tone = F.when(F.col("score") >= 90, "elite").when(F.col("score") >= 70, "strong").when(F.col("score") >= 50, "ok").otherwise("weak")
    return parts.withColumn("score", score).withColumn("tone", tone)


def core_ratchet(coverage: DataFrame, violations: DataFrame, contract: Contract) -> DataFrame:
    """(repo, layer, action, refused) of core layers: ratchet (optional, but has files), strict, or stay-empty.

    refused: violations or low-coverage, where the repository isn't fit for the ratchet; null if it is.
    """
    optional = [x.name for x in contract.layers if x.optional]
    n = violations.groupBy("repo").agg(F.count("*").alias("n"))
    rows = coverage.where(F.col("layer").isin(*CORES)).join(n, "repo", "left").fillna(0, ["n"])
    is_optional = F.col("layer").isin(optional) if optional else F.lit(False)
    action = F.when(~is_optional, F.when(F.col("n_files") > 0, "strict")).when(F.col("n_files") > 0, "ratchet").otherwise("stay-empty")
    refused = F.when(F.col("n") > 0, "violations").when((F.col("total") == 0) | (F.col("percent") < 50), "low-coverage")
    return rows.select("repo", "layer", action.alias("action"), refused.alias("refused")).where("action is not null")


def rules_under_contract(invariants: DataFrame, coverage: DataFrame, contract: Contract) -> DataFrame:
    """(repo, layer, n_structure, n_invariants, n_covered, n_uncovered, teeth): teeth are on, deferred or none.

    invariants: as of ``structure.invariant_coverage``. Below 50 % of governed files, or without any, teeth are deferred.
    """
    layers = sorted({r.layer for r in contract.structure} | {i.layer for i in contract.invariants})
    layer_of = {i.id: i.layer for i in contract.invariants}
    of = reduce(lambda w, kv: w.when(F.col("invariant") == kv[0], kv[1]), layer_of.items(), F.when(F.lit(False), ""))
    covered = invariants.withColumn("layer", of).groupBy("repo", "layer").agg(F.count_if("covered").alias("n_covered"))
    enforced = any(structure._blocks(r) for r in contract.structure) or any(i.enforced for i in contract.invariants)
    one = coverage.groupBy("repo").agg(F.max("percent").alias("percent"), F.count_if(F.col("n_files") > 0).alias("populated"))
    each = F.array(*[F.struct(F.lit(x).alias("layer"), F.lit(sum(r.layer == x for r in contract.structure)).cast("long").alias("n_structure"), F.lit(sum(i.layer == x for i in contract.invariants)).cast("long").alias("n_invariants")) for x in layers])
    teeth = F.when(F.lit(not enforced), "none").when((F.col("percent") >= 50) & (F.col("populated") >= 1), "on").otherwise("deferred")
    rows = one.select("repo", teeth.alias("teeth"), F.explode(each).alias("x")).select("repo", "x.*", "teeth")
    joined = rows.join(covered, ["repo", "layer"], "left").fillna(0, ["n_covered"])
    return joined.select("repo", "layer", "n_structure", "n_invariants", "n_covered", (F.col("n_invariants") - F.col("n_covered")).alias("n_uncovered"), "teeth")


def demoted_violations(violations: DataFrame, coverage: DataFrame) -> DataFrame:
    """Violations of structure rules and invariants don't block where half of the files aren't governed."""
    one = coverage.groupBy("repo").agg(((F.max("percent") >= 50) & (F.count_if(F.col("n_files") > 0) >= 1)).alias("ripe"))
    return violations.join(one, "repo", "left").withColumn("fails_strict", F.col("fails_strict") & F.coalesce("ripe", F.lit(True))).drop("ripe")


def next_pilot(smells: DataFrame) -> DataFrame:
    """(repo, smell, score): the one smell to begin with; files of evidence weigh most, then the fixed order.

    smells (repo, smell, n, evidence) of which evidence of layers and layouts is no file; ties go to the earlier smell.
    """
    rank = F.array_position(F.array(*map(F.lit, PILOT_ORDER)), F.col("smell")).cast("int") - 1
    n_files = F.size(F.filter(F.split("evidence", ","), lambda e: (e != "") & ~e.rlike("^(layout|layer|rule):")))
    scored = smells.select("repo", "smell", rank.alias("rank"), n_files.alias("n_files")).where("rank >= 0")
    place = F.row_number().over(W.partitionBy("repo").orderBy("smell")) - 1
    scored = scored.withColumn("score", (F.col("n_files") * 100 - F.col("rank") * 10 - place).cast("long"))
    return scored.groupBy("repo").agg(F.max_by("smell", F.struct("score", -F.col("rank"))).alias("smell"), F.max("score").alias("score"))


def pilot_residual(before: DataFrame, after: DataFrame, pilots: DataFrame) -> DataFrame:
    """Evidence (repo, smell, path) before and after, on the files of each repository's pilot (repo, smell, path).

    (repo, smell, n_before, n_after, cleared, reduced): cleared if the smell is gone from the repository.
    """
    on = lambda rows, name: rows.join(pilots, ["repo", "smell", "path"], "left_semi").groupBy("repo", "smell").agg(F.countDistinct("path").alias(name))
    left = after.select("repo", "smell").distinct().withColumn("there", F.lit(True))
    keys = pilots.select("repo", "smell").distinct()
    joined = keys.join(on(before, "n_before"), ["repo", "smell"], "left").join(on(after, "n_after"), ["repo", "smell"], "left").join(left, ["repo", "smell"], "left").fillna(0, ["n_before", "n_after"])
    cleared = F.col("there").isNull()
    return joined.select("repo", "smell", "n_before", "n_after", cleared.alias("cleared"), ((F.col("n_after") < F.col("n_before")) | (cleared & (F.col("n_before") > 0))).alias("reduced"))


# Contract smells: rules and layers as tables, so that repositories may have contracts of their own.

_PERIPHERAL, _CORE, _ADAPTER = "(?i)observab|audit|telemetry|monitor|logging|metric|tracing", "(?i)application|orchestr|persist|repositor", "(?i)adapter|persist|integrat|infra|gateway"
_BASE_WORDS = ("infra", "infrastructure", "base", "core", "shared", "common", "kernel", "platform", "foundation")


def _own_family_base(source: Column, target: Column) -> Column:
    """Whether the target reads as the base of the source's family: its first word is in the source, the rest are base words."""
    words = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+)"), F.lit(1)), F.lower)
    own, base = words(source), words(target)
    family = F.get(base, F.lit(0))
    rest = F.slice(base, 2, F.greatest(F.size(base), F.lit(1)))
    return (F.size(base) >= 2) & (F.length(family) >= 2) & ~family.rlike("^(adapters?|gateways?)$") & F.array_contains(own, family) & F.forall(rest, lambda w: w.isin(*_BASE_WORDS))


def contract_smell_edges(rules: DataFrame, layers: DataFrame, coverage: DataFrame) -> DataFrame:
    """rules (repo, source, target, allowed), layers (repo, layer, optional), coverage (repo, layer, n_files) -> (repo, smell, edge, detail)."""
    allow = rules.where("allowed and source <> target").select("repo", "source", "target").distinct()
    back = allow.select("repo", F.col("target").alias("source"), F.col("source").alias("target"))
    both = allow.join(back, ["repo", "source", "target"], "left_semi").where("source < target")
    pair = F.concat("source", F.lit("<->"), "target")
    arrow = F.concat("source", F.lit("->"), "target")
    peripheral = F.col("source").rlike(_PERIPHERAL) & F.col("target").rlike(_CORE)
    lateral = ~peripheral & F.col("source").rlike(_ADAPTER) & F.col("target").rlike(_ADAPTER) & ~_own_family_base(F.col("source"), F.col("target"))
    edge = lambda rows, smell, label, prefix="edge:": rows.select("repo", F.lit(smell).alias("smell"), label.alias("edge"), F.concat(F.lit(prefix), label).alias("detail"))
    selfs = rules.where("source = target").select("repo", "source", "target").distinct()
    sides = rules.where("source <> target").select("repo", "source", "target", F.explode(F.array("source", "target")).alias("layer")).distinct().where("layer <> ''")
    known = sides.join(layers.withColumn("known", F.lit(True)), ["repo", "layer"], "left").join(coverage.select("repo", "layer", "n_files"), ["repo", "layer"], "left")
    why = F.when(F.col("known").isNull(), "unknown").when((F.col("n_files") == 0) & ~F.coalesce("optional", F.lit(False)), "empty")
    dead = known.withColumn("why", why).where("why is not null").select("repo", F.lit("contract-dead-rule").alias("smell"), arrow.alias("edge"), F.concat(F.lit("rule:"), arrow, F.lit(" ("), "why", F.lit(" layer: "), "layer", F.lit(")")).alias("detail"))
    own = selfs.select("repo", F.lit("contract-dead-rule").alias("smell"), arrow.alias("edge"), F.concat(F.lit("rule:"), arrow, F.lit(" (self edge has no effect)")).alias("detail"))
    return edge(both, "contract-bidirectional-allow", pair).union(edge(allow.where(peripheral), "contract-peripheral-depends-core", arrow)).union(edge(allow.where(lateral), "contract-lateral-adapter-allow", arrow)).union(dead).union(own).distinct()


def _lifecycle(review_by: Column, today: str) -> Column:
    real = F.try_to_date(review_by, "yyyy-MM-dd").cast("string") == review_by
    return F.when(review_by.isNull(), "undated").when(~review_by.rlike(r"^\d{4}-\d{2}-\d{2}$") | ~F.coalesce(real, F.lit(False)), "malformed").when(review_by < today, "expired").otherwise("current")


def acknowledged(acks: DataFrame, today: str) -> DataFrame:
    """acks (repo, smell, edge, review_by) -> (repo, smell, edge, status): dated entries decide, a current one first.

    The edge of a two-way smell is put in order; one that isn't well formed matches nothing.
    """
    parts = F.transform(F.split("edge", "<->"), lambda p: F.trim(p))
    fine = (F.size(parts) == 2) & F.forall(parts, lambda p: p != "")
    edge = F.when(F.col("smell") == "contract-bidirectional-allow", F.when(fine, F.array_join(F.array_sort(parts), "<->"))).otherwise(F.trim("edge"))
    status = _lifecycle(F.col("review_by"), today)
    rank = F.when(status == "current", 3).when(status.isin("expired", "malformed"), 2).otherwise(1)
    rows = acks.select("repo", "smell", edge.alias("edge"), status.alias("status"), rank.alias("rank")).where("edge is not null")
    return rows.groupBy("repo", "smell", "edge").agg(F.max_by("status", "rank").alias("status"))


def contract_smells(edges: DataFrame, acks: DataFrame, today: str) -> DataFrame:
    """(repo, smell, edge, detail, ack): the edges of ``contract_smell_edges`` that no current or undated entry covers, and stale entries.

    ack: none, expired or malformed (such entries don't suppress); stale: an entry whose edge isn't there any more.
    """
    known = acknowledged(acks, today)
    joined = edges.join(known, ["repo", "smell", "edge"], "left").withColumn("ack", F.coalesce("status", F.lit("none")))
    open_ = joined.where("ack not in ('current', 'undated')").select("repo", "smell", "edge", "detail", "ack")
    stale = known.join(edges.select("repo", "smell", "edge").distinct(), ["repo", "smell", "edge"], "left_anti").select("repo", "smell", "edge", F.lit(None).cast("string").alias("detail"), F.lit("stale").alias("ack"))
    return open_.union(stale)


# Plans: what kind of work each violation is.

_PURE = r"(?i)(^|/)(constants|types|enums|shared-types|shared/(?:types|constants)|test-projects)(/|\.|$)|(?:^|/)[^/]*(?:constants|types)(?:\.[cm]?[jt]sx?)?$"
_EMITS = r"(?i)(^|/)(?:kernel(?:/|$)|events?(?:/|\.|$)|bootstrap(?:\.[cm]?[jt]sx?)?$|emitter(?:\.[cm]?[jt]sx?)?$)|(?:^|/)(?:intents?|publish)(?:/|\.|$)"
_USE_CASE = r"(?i)(use-?cases?|usecases?|application|orchestrat|services?|handlers?)(/|\.|$)"
_SMALL = {"FORBIDDEN_GLOBAL": "inject-port", "RAW_EVENT_PUBLISH": "registered-intent", "PUBLISH_MISSING_SOURCE": "add-source-metadata", "PUBLISH_SOURCE_LAYER_MISMATCH": "fix-source-layer", "LAYER_INTENT_REFERENCE_VIOLATION": "intent-relocation"}
_MEDIUM = {"CAPABILITY_VIOLATION": "inject-port", "CIRCULAR_DEPENDENCY": "break-cycle", "ARKRULE_STRUCTURE": "review-contract", "ARKRULE_INVARIANT": "review-contract", "INVARIANT_UNCOVERED": "review-contract"}


def import_kind() -> Column:
    """pure-shared, kernel-emit, use-case or unknown: what an import's target stands for."""
    target = F.trim(F.replace(F.coalesce("target", F.lit("")), F.lit("\\"), F.lit("/")))
    source, to = F.coalesce("from_layer", F.lit("")), F.coalesce("to_layer", F.lit(""))
    emits = (source == "PersistenceAdapters") & (target.rlike(_EMITS) | F.concat_ws(" ", to, target).rlike("(?i)events?|intents?|kernel|bootstrap"))
    case = target.rlike(_USE_CASE) | (source.isin("DomainModel", "ApplicationOrchestration") & (to == "PersistenceAdapters"))
    return F.when(target.rlike(_PURE), "pure-shared").when(emits, "kernel-emit").when(case, "use-case").otherwise("unknown")


def _flag(name: str, have: list[str]) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in have else F.lit(False)


def classify_remediation(violations: DataFrame) -> DataFrame:
    """With class (mechanical-safe, judgment, deferred), confidence and kind of remediation: an ordered decision table.

    violations (rule_id, edge_kind, ...); of the flags peer_isolation, type_only, source_pure_types,
    target_types_only, named_types_only and port_proof those that aren't there are false.
    """
    flag = lambda n: _flag(n, violations.columns)
    row = lambda c, x, k=None: F.struct(F.lit(c).alias("class"), F.lit(x).alias("confidence"), F.lit(k).cast("string").alias("remediation"))
    runtime = F.coalesce(F.col("edge_kind").isin("require", "dynamic-import"), F.lit(False))
    layer = (
        F.when(flag("peer_isolation"), row("judgment", 0.9))
        .when(runtime, row("judgment", 0.75))
        .when(flag("type_only") & flag("source_pure_types"), row("mechanical-safe", 0.88, "pure-type-file-relocate"))
        .when(flag("target_types_only"), row("mechanical-safe", 0.85, "import-type-from-pure-type-module"))
        .when(flag("named_types_only") & ~flag("type_only"), row("mechanical-safe", 0.86, "import-type-of-type-exports"))
        .when(flag("type_only"), row("mechanical-safe", 0.9, "type-only-import-move"))
        .when(flag("port_proof"), row("judgment", 0.82, "port-proof-inject-binding"))
        .otherwise(row("judgment", 0.7))
    )
    rule = F.col("rule_id")
    out = (
        F.when(rule == "LAYER_IMPORT_VIOLATION", layer)
        .when(rule.isin("FORBIDDEN_GLOBAL", "CAPABILITY_VIOLATION"), row("judgment", 0.8))
        .when(rule == "CIRCULAR_DEPENDENCY", row("judgment", 0.7))
        .when((rule == "INVARIANT_UNCOVERED") | rule.startswith("ARKRULE_"), row("judgment", 0.85))
        .when(rule != "", row("judgment", 0.6))
        .otherwise(row("deferred", 0.3))
    )
    return violations.withColumn("_x", out).select("*", "_x.*").drop("_x")


def fix_class(violations: DataFrame) -> DataFrame:
    """With fix_class and effort, by rule, and for imports by what their target stands for."""
    flag = lambda n: _flag(n, violations.columns)
    row = lambda c, e: F.struct(F.lit(c).alias("fix_class"), F.lit(e).alias("effort"))
    kind = import_kind()
    layer = (
        F.when(flag("type_only") | flag("target_types_only") | flag("named_types_only"), row("file-move", "small"))
        .when(flag("peer_isolation"), row("cross-slice-boundary", "medium"))
        .when(kind == "pure-shared", row("file-move", "small"))
        .when(kind.isin("kernel-emit", "use-case") | flag("port_proof"), row("port-inversion", "medium"))
        .otherwise(row("review-contract", "medium"))
    )
    out = F.when(F.col("rule_id") == "LAYER_IMPORT_VIOLATION", layer)
    for of, effort in ((_SMALL, "small"), (_MEDIUM, "medium")):
        for rule, name in of.items():
            out = out.when(F.col("rule_id") == rule, row(name, effort))
    return violations.withColumn("_x", out.otherwise(row("review-contract", "small"))).select("*", "_x.*").drop("_x")


def remediation_plan(classified: DataFrame, order: list[str]) -> DataFrame:
    """With step: per repository, value edges before type-only ones, then mechanical-safe, judgment, deferred, then ``order``."""
    types = (_flag("type_only", classified.columns) | _flag("named_types_only", classified.columns)).cast("int")
    rank = F.when(F.col("class") == "mechanical-safe", 0).when(F.col("class") == "judgment", 1).otherwise(2)
    return classified.withColumn("step", F.row_number().over(W.partitionBy("repo").orderBy(types, rank, *order)).cast("long"))


def plan_summary(plan: DataFrame, coverage: DataFrame) -> DataFrame:
    """(repo, n_mechanical, n_judgment, n_deferred, goal_met): met if nothing blocks and half of the files are governed."""
    n = lambda c: F.count_if(F.col("class") == c)
    counts = plan.groupBy("repo").agg(n("mechanical-safe").alias("n_mechanical"), n("judgment").alias("n_judgment"), n("deferred").alias("n_deferred"), F.count_if("blocking").alias("n_blocking"))
    one = coverage.groupBy("repo").agg(F.max("total").alias("total"), F.max("percent").alias("percent"))
    joined = one.join(counts, "repo", "left").fillna(0, ["n_mechanical", "n_judgment", "n_deferred", "n_blocking"])
    return joined.select("repo", "n_mechanical", "n_judgment", "n_deferred", ((F.col("n_blocking") == 0) & (F.col("total") > 0) & (F.col("percent") >= 50)).alias("goal_met"))


def freeze_guard(breakdown: DataFrame) -> DataFrame:
    """(repo, edge): where a baseline must not be written, since violations crowd on one edge of layers."""
    return breakdown.where("concentrated").select("repo", F.concat("from_layer", F.lit("->"), "to_layer").alias("edge"))
