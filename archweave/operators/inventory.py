"""Rules that scripts hold without a contract: candidates for extraction, with their places.

Which files are looked at, and as what, is Column work over paths, layers and contents; only files that may hold a
candidate go to the scan, which keeps places (one small helper a file inside Arrow batches); what the scan finds is
judged, numbered and held against the contract in Columns and joins again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.keys import scope, shared, sized
from archweave.ship import ship_package

# Which layers are domain, which may hold controllers, by name or by the roots of their intents.
_DOMAIN_NAME = r"(?i)domain|entity|aggregate|model"
_DOMAIN_ROOTS = ("Domain",)
_CONTROLLER_NAME = r"(?i)application|orchestration|presentation|adapter|framework|interface|delivery|transport|inbound|controller"
_CONTROLLER_ROOTS = ("Application", "Orchestration", "Presentation", "Adapter", "Interface", "Delivery", "Transport")
# Files that are no pilots, user interface, input and output, error modules.
_NO_PILOT = (
    r"(?i)(?:^|/)(?:tests?|__tests__|fixtures?|testdata|mocks?|stubs?|examples?|samples?|seeds?|seeders?|migrations?|excluded|exclusions?)(?:/|$)",
    r"(?i)(?:^|/)[^/]*\.(?:test|spec|fixture|mock|stub|seed|seeder)\.[^/]+$",
    r"(?i)(?:^|/)(?:seed|seeder|fixture|mock|stub)\.[^/]+$",
)
_GENERATED = r"(?i)GENERATED FILE\s+[—-]\s+do not edit by hand"
_GENERATED_WITHIN = 320
_UI = r"(?i)(?:^|/)(?:components|ui|layouts|styles|hooks|theme|tokens|i18n|locales?)(?:/|$)"
_PAGE = (r"(?i)(?:^|/)(?:src/)?(?:app|pages)/.+\.(?:tsx|jsx)$", r"(?i)(?:page|layout|loading|error|template|default)\.(?:tsx|jsx)$")
_ROUTE = r"(?i)route\.(?:ts|js|tsx|jsx)$"
_CONTROLLER_PATHS = (r"(?i)controller|handler|resolver", r"(?i)(?:^|/)(?:app|pages)(?:/[^/]+)*/api(?:/|$)", r"(?i)(?:^|/)actions?(?:/|\.|$)")
_CONTROLLER_TEXTS = (r"""['"]use server['"]""", r"@(Controller|Get|Post|Put|Delete|Patch)\b", r"\bexport\s+(?:async\s+)?function\s+(?:GET|POST|PUT|DELETE|PATCH)\b", r"\bexport\s+const\s+(?:GET|POST|PUT|DELETE|PATCH)\s*=")
_IO_PATH = r"(?i)(?:^|/)(?:integrations?|repos?|clients?|infra(?:structure)?|adapters?)(?:/|$)"
_ERROR_PATH = (r"(?i)\.error\.(?:ts|js|tsx|jsx)$", r"(?i)(?:^|/)[^/]*(?:-access)?\.error\.", r"(?i)(?:^|/)errors?(?:/|$)")
# What a candidate looks like.
_VALIDATION = r"\b(if\s*\([^)]{0,80}(amount|total|price|qty|quantity|balance)[^)]{0,40}\)|throw new (Error|BadRequest|ValidationError)|z\.object\(|yup\.|class-validator|@Is[A-Z])"
_CONSTANT = r"""\b(const|let)\s+([A-Z][A-Z0-9_]{2,})\s*=\s*(\d{2,}|['"][^'"]{8,}['"])"""
_CLASS = r"export\s+class\s+([A-Za-z_][A-Za-z0-9_]*)\s*\{([^}]{0,800})\}"
_METHOD, _FIELD = r"\b[a-zA-Z_][a-zA-Z0-9_]*\s*\(", r":\s*[A-Za-z]"
_MUTATION = r"this\.\w+\s*="
_GUARD = r"\b(ensureInvariants|assertInvariants|validate|publish|emit)\b"
_GUARD_WITHIN = 200
_ERROR_CLASS = r"\bextends\s+(?:Error|[A-Za-z_$][A-Za-z0-9_$]*Error)\b"
# Names of constants that are technical, and those of texts for users.
_TECHNICAL = (
    r"(?i)^(?:TEST|SPEC|TIMEOUT|PORT|VERSION|MAX_RETRY|MIN_RETRY|TTL|CACHE|HEADER|COOKIE|MIME|CONTENT_TYPE|HTTP_STATUS|NODE_ENV|LOG_LEVEL|FEATURE_FLAG|ID_PREFIX|Z_INDEX)(?:_|$)",
    r"(?i)^(?:ROUTE|PATH|LABEL|TITLE|HEADING|CLASS|STYLE|COLOR|THEME|BREAKPOINT|QUERY|PARAM|ICON|ARIA|MSG|COPY|I18N|LOCALE|PAGE|NAV|MENU|TAB|BTN|BUTTON|PLACEHOLDER|TOOLTIP|SHADOW|RADIUS|GAP|PADDING|MARGIN|FONT|WIDTH|HEIGHT|OPACITY|DURATION|EASE|ANIM)_",
    r"(?i)_(?:ROUTE|PATH|LABEL|TITLE|COLOR|THEME|CLASS|STYLE|ICON|ARIA|MSG|COPY|TIMEOUT|PORT|VERSION|RETRY|DELAY|INTERVAL|TTL|CACHE)$",
    r"(?i)_(?:TIMEOUT(?:_MS)?|MS|BYTES|BUCKET|STORAGE_KEY|WINDOW_MS)$",
    r"(?i)^(?:DEFAULT_(?:BASE_URL|TIMEOUT(?:_MS)?|RETRY|PORT|HOST|HEADERS?|CACHE|TTL|MS|LOCALE|LANG|TIMEZONE|TZ)|REQUEST_(?:TIMEOUT(?:_MS)?|HEADERS?|RETRY|ID_PREFIX)|STORAGE_(?:KEY|PREFIX|BUCKET)|DAY_MS$|APP_DOMAIN$|BASE_URL$)$",
    r"(?i)^(?:FAVORITES_STORAGE|LISTINGS_CACHE|DOCS_PATH|METRICS_INTERVAL)",
    r"(?i)^(?:DEV|DEMO|SEED|FIXTURE)_[A-Z0-9_]+$",
    r"(?i)^(?:PG|POSTGRES|OID)_[A-Z0-9_]+$",
    r"(?i)_(?:OID|OIDS)$",
    r"(?i)^(?:INT2|INT4|INT8|FLOAT4|FLOAT8|NUMERIC|DATE|TIME|TIMESTAMP|TIMESTAMPTZ|JSON|JSONB|UUID)OID$",
    r"(?i)(?:^|_)(?:SCHEMA|PROTOCOL|RESOLVER|FORMAT)_(?:URL|URI|VERSION|ID|IDENTITY)$",
)
_MESSAGE = (
    r"(?i)^(?:ERROR|SUCCESS|WARNING|INFO|HINT|HELP|EMPTY|TOAST|SNACK|ALERT|BANNER|DIALOG|MODAL|TOOLTIP|CAPTION|SUBTITLE|HEADLINE|USER|UI|DISPLAY|FEEDBACK)_(?:MSG|MESSAGE|TEXT|COPY|LABEL|TITLE|BODY|DESC|DESCRIPTION|HINT|HELP)?",
    r"(?i)_(?:MSG|MESSAGE|TEXT|COPY|TOAST|SNACK|ALERT|BANNER|CAPTION|HINT|HELP_TEXT|ERROR_TEXT|EMPTY_TEXT|PLACEHOLDER_TEXT|USER_MESSAGE|FEEDBACK)$",
)
_STATE_NAME = r"(?i)^(?:STATUS|STATE|PHASE|ROLE|TYPE|KIND|ORDER|PAYMENT|CART|INVOICE|POLICY)_[A-Z0-9_]+$"
_SENTENCE = r"""(?s)^['"](?:.*\s.*|.*[.!?…])['"]$"""
#: Contracts' layers up to this many rows are broadcast to the files, beyond it both are shuffled.
_MOST_LAYERS = 200_000
#: Kinds in the order in which a file's are numbered, with the middle of their ids.
KINDS = {"validation-in-controller": "val", "magic-business-constant": "magic", "anemic-entity": "anemic", "mutation-without-guard": "mut"}


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def _owns(prefixes: Column, roots: tuple[str, ...]) -> Column:
    """Whether an intent prefix is one of the roots, or below one."""
    root = rf"^(?:{'|'.join(roots)})(?:\.|$)"
    return F.coalesce(F.exists(prefixes, lambda p: F.regexp_replace(F.trim(p), r"\.+$", "").rlike(root)), F.lit(False))


def _roles(files: DataFrame) -> DataFrame:
    """Files that may be pilots, with controller, domain, constants (whether constants count) and mutators."""
    path, text, layer = F.col("_path"), F.col("content"), F.col("layer")
    ui = path.rlike(_UI) | (path.rlike(_PAGE[0]) & path.rlike(_PAGE[1]))
    shape = _any(path, _CONTROLLER_PATHS) | _any(text, _CONTROLLER_TEXTS) | (path.rlike(_ROUTE) & ~ui)
    governed = layer.isNotNull()
    controller = shape & (~governed | layer.rlike(_CONTROLLER_NAME) | _owns(F.col("prefixes"), _CONTROLLER_ROOTS))
    domain = F.when(governed, layer.rlike(_DOMAIN_NAME) | _owns(F.col("prefixes"), _DOMAIN_ROOTS)).otherwise(path.rlike(_DOMAIN_NAME))
    pilots = files.where(~_any(path, _NO_PILOT) & ~F.substring("content", 1, _GENERATED_WITHIN).rlike(_GENERATED))
    marked = pilots.withColumns({"_ui": ui, "_controller": controller, "_domain": domain})
    constants = F.expr("_domain or ((layer is null or _controller) and not _ui)") & (F.col("_domain") | ~path.rlike(_IO_PATH))
    marked = marked.withColumns({"_checks": F.expr("_controller and not _ui"), "_constants": constants, "_mutators": F.col("_domain") & ~_any(path, _ERROR_PATH)})
    wanted = [(F.col("_checks"), _VALIDATION), (F.col("_constants"), _CONSTANT), (F.col("_domain"), _CLASS), (F.col("_mutators"), _MUTATION)]
    return marked.where(reduce(lambda a, b: a | b, [flag & text.rlike(pattern) for flag, pattern in wanted]))


_FINDERS = {kind: re.compile(p, re.A) for kind, p in zip(KINDS, (_VALIDATION, _CONSTANT, _CLASS, _MUTATION), strict=True)}
_METHODS, _FIELDS, _GUARDS, _ERRORS = (re.compile(p, re.A) for p in (_METHOD, _FIELD, _GUARD, _ERROR_CLASS))


def _unguarded(text: str) -> int | None:
    """Where the first field is assigned outside error classes, with no guard near; a class begins at the last 'class '."""
    classes = [m.start() for m in re.finditer("class ", text)]
    for m in _FINDERS["mutation-without-guard"].finditer(text):
        # As an occurrence may begin at the place itself, only those before it are classes.
        k = bisect_left(classes, m.start()) - 1
        end = text.find("{", classes[k], m.start()) if k >= 0 else -1
        if end >= 0 and _ERRORS.search(text, classes[k], end):
            continue
        if not _GUARDS.search(text[max(0, m.start() - _GUARD_WITHIN) : m.start() + _GUARD_WITHIN]):
            return m.start()
    return None


def places_of(text: str, checks: bool, constants: bool, domain: bool, mutators: bool) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(kind, offset, name, value) in order of kind and place."""
    validation, constant, entity, mutation = KINDS
    if checks:
        yield from ((validation, m.start(), None, None) for m in _FINDERS[validation].finditer(text))
    if constants:
        yield from ((constant, m.start(), m[2], m[3]) for m in _FINDERS[constant].finditer(text))
    if domain:
        for m in _FINDERS[entity].finditer(text):
            if len(_FIELDS.findall(m[2])) >= 2 and len(_METHODS.findall(m[2])) <= 1:
                yield entity, m.start(), m[1], None
    if mutators and (at := _unguarded(text)) is not None:
        yield mutation, at, None, None


def _scan(files: DataFrame, keys: list[str]) -> DataFrame:
    ship_package(files.sparkSession)
    kept = [*keys, "path", "layer", "suggested_layer"]
    schema = ", ".join([*[f"{c} string" for c in kept], "nth long, kind string, line long, name string, value string"])
    names = [*kept, "nth", "kind", "line", "name", "value"]
    kinds = [*[pa.string()] * len(kept), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for *own, text, checks, constants, domain, mutators in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = [m.start() for m in re.finditer("\n", text)]
                for nth, (kind, at, name, value) in enumerate(places_of(text, checks, constants, domain, mutators)):
                    for column, x in zip(out, (*own, nth, kind, bisect_left(ends, at) + 1, name, value), strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return files.select(*[F.col(c).cast("string") for c in kept], "content", "_checks", "_constants", "_domain", "_mutators").mapInArrow(run, schema)


def rule_candidates(sources: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """sources (repo, [snapshot], path, content, layer) -> (repo, [snapshot], id, kind, file, line, confidence, layer,
    suggested_layer, rule_id, name).

    layer: the file's in the contract, null if it has none; then its path decides what it is. contexts (repo,
    [snapshot], ordinal, layer, prefixes): the contract's layers and the intent prefixes that they own, from which the
    domain layer is taken too (the first; else DomainModel). rule_id: the invariant or structure rule that would hold
    the candidate. Ids number a repository's candidates by file (by code point), kind and place. A null content has none;
    a path that is there twice is numbered twice.
    """
    keys = scope(sources)
    files = sources.select(*keys, "path", "layer", F.col("content")).where("content is not null and path is not null")
    if contexts is None:
        files = files.withColumns({"prefixes": F.array().cast("array<string>"), "suggested_layer": F.lit("DomainModel")})
    else:
        of = shared(files, contexts)
        domain = F.col("layer").rlike(_DOMAIN_NAME) | _owns(F.col("prefixes"), _DOMAIN_ROOTS)
        homes = contexts.where(domain).groupBy(*of).agg(F.min_by("layer", "ordinal").alias("suggested_layer"))
        owned = contexts.groupBy(*of, "layer").agg(F.max("prefixes").alias("prefixes"))
        files = files.join(sized(owned, _MOST_LAYERS), [*of, "layer"], "left").join(sized(homes, _MOST_LAYERS), of, "left")
        files = files.withColumn("suggested_layer", F.coalesce("suggested_layer", F.lit("DomainModel")))
    files = files.withColumn("_path", F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", ""))
    found = _scan(_roles(files), keys)
    name, value = F.col("name"), F.col("value")
    message = _any(name, _MESSAGE) | (value.rlike(_SENTENCE) & ~name.rlike(_STATE_NAME))
    noise = (F.col("kind") == "magic-business-constant") & (_any(name, _TECHNICAL) | message)
    kept = found.where(~F.coalesce(noise, F.lit(False)))
    # Slim rows: no text passes this shuffle. A running number needs no more than the row before.
    number = F.row_number().over(W.partitionBy(*keys).orderBy("path", "nth"))
    numbered = kept.withColumn("seq", number)
    middle = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind"))
    rule = (
        F.when(F.col("kind") == "validation-in-controller", F.concat(F.lit("INV-EXTRACT-"), "seq"))
        .when(F.col("kind") == "magic-business-constant", F.concat(F.lit("INV-"), "name"))
        .when(F.col("kind") == "anemic-entity", "no-anemic-model")
        .otherwise("events-on-mutation")
    )
    sure = F.when(F.col("kind") == "validation-in-controller", "direct-evidence").otherwise("heuristic")
    return numbered.select(*keys, F.concat(F.lit("inv-"), middle, F.lit("-"), "seq").alias("id"), "kind", F.col("path").alias("file"), "line", sure.alias("confidence"), "layer", "suggested_layer", rule.alias("rule_id"), "name")


def rules_inventory(candidates: DataFrame, contracted: DataFrame) -> DataFrame:
    """(repo, [snapshot], inventoried, under_contract): candidates whose rule the contract (repo, [snapshot], rule_id) has."""
    keys = scope(candidates)
    known = contracted.select(*keys, "rule_id").distinct().withColumn("_known", F.lit(1))
    joined = candidates.join(known, [*keys, "rule_id"], "left")
    return joined.groupBy(*keys).agg(F.count("*").alias("inventoried"), F.count("_known").alias("under_contract"))
