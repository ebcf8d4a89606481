"""Architecture contracts: small, driver-side, turned into Column expressions that run inside code generation.

A contract is a handful of layers, globs and rules. Made into expressions, classification and rules need no join and
no shuffle, whatever the size of the fleet; a fleet with several contracts calls the operators once for each.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Layer:
    name: str
    patterns: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    optional: bool = False
    pure: bool = False
    deny: tuple[str, ...] = ()
    forbidden_globals: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    source: str
    target: str
    allowed: bool = False
    peer_isolation: bool = False
    slice_folders: tuple[str, ...] = ()
    message: str = ""


@dataclass(frozen=True)
class StructureRule:
    """A sensor over a layer's classes or files; ``globs`` narrow it, none means the whole layer."""

    id: str
    layer: str
    sensor: str
    enforced: bool = False
    globs: tuple[str, ...] = ()
    source: str = ""


@dataclass(frozen=True)
class Invariant:
    """Must be named in a test (``test`` true or None) or show its ``symbol``; test False asks for no test."""

    id: str
    layer: str
    enforced: bool = False
    test: bool | None = None
    symbol: str | None = None
    globs: tuple[str, ...] = ()
    source: str = ""


@dataclass(frozen=True)
class Contract:
    layers: tuple[Layer, ...]
    rules: tuple[Rule, ...] = field(default=())
    structure: tuple[StructureRule, ...] = ()
    invariants: tuple[Invariant, ...] = ()


#: The intent prefixes of the layers, by default.
DEFAULT_PREFIXES = {
    "DomainModel": ("Domain.",),
    "ApplicationOrchestration": ("Application.",),
    "PersistenceAdapters": ("Adapter.Persistence.", "Adapter.Repository."),
    "IntegrationAdapters": ("Adapter.Integration.", "Adapter.External."),
    "WorkflowSagaEngine": ("Workflow.",),
    "BackgroundJobsScheduling": ("Job.",),
    "PresentationAdapters": ("Presentation.", "Adapter.Presentation.", "Adapter.Api."),
    "ReportingReadModels": ("Reporting.",),
    "ExtensibilityMetadata": ("Metadata.",),
    "SecurityAuditObservability": ("Security.", "Audit.", "Observability."),
    "Kernel": ("Kernel.",),
}
#: What an intent's name may begin with.
INTENT_PREFIXES = ("Domain.", "Application.", "Adapter.", "Workflow.", "Job.", "Presentation.", "Reporting.", "Metadata.", "Security.", "Audit.", "Observability.", "Kernel.")

#: The contract of the derived test fleet.
FLEET = Contract(
    layers=(
        Layer("DomainModel", ("src/domain/**",), ("**/*.gen.ts",)),
        Layer("ApplicationOrchestration", ("src/application/**",)),
        Layer("PersistenceAdapters", ("src/adapters/persistence/**",)),
        Layer("PresentationAdapters", ("src/presentation/**", "src/features/**/ui/**")),
        Layer("Features", ("src/features/**",)),
        Layer("Kernel", ("src/kernel/**",)),
        Layer("ReportingReadModels", ("src/reporting/**",), optional=True),
    ),
    rules=(
        Rule("DomainModel", "ApplicationOrchestration", message="domain stays free of application"),
        Rule("DomainModel", "PersistenceAdapters", message="domain stays free of persistence"),
        Rule("DomainModel", "PresentationAdapters", message="domain stays free of presentation"),
        Rule("ApplicationOrchestration", "PresentationAdapters", message="application stays free of presentation"),
        Rule("PresentationAdapters", "PersistenceAdapters", message="presentation goes through application"),
        Rule("Features", "Features", peer_isolation=True, slice_folders=("features",), message="features are isolated"),
        Rule("Kernel", "Kernel", message="never fires: same layer"),
    ),
)

#: The same fleet with effect walls, structure rules and invariants.
WALLED = Contract(
    layers=tuple(
        replace(x, **{"DomainModel": {"pure": True, "forbidden_globals": ("Date",)}, "ApplicationOrchestration": {"deny": ("filesystem", "network"), "forbidden_globals": ("process", "process.env")}, "PresentationAdapters": {"deny": ("persistence",)}}.get(x.name, {}))
        for x in FLEET.layers
    ),
    rules=FLEET.rules,
    structure=(
        StructureRule("S1", "DomainModel", "aggregate-private-state", True, source="rules/domain.json"),
        StructureRule("S2", "DomainModel", "always-valid-factory", source="rules/domain.json"),
        StructureRule("S3", "DomainModel", "domain-event-on-mutation", True, ("src/domain/**",), "rules/domain.json"),
        StructureRule("S4", "DomainModel", "no-anemic-model", True, source="rules/domain.json"),
        StructureRule("S5", "ApplicationOrchestration", "orchestration-only", True, source="rules/application.json"),
        StructureRule("S6", "PersistenceAdapters", "thin-adapter", source="rules/adapters.json"),
        StructureRule("S7", "DomainModel", "aggregate-private-state", True, ("src/billing/**",), "rules/domain.json"),
    ),
    invariants=(
        Invariant("INV-1", "DomainModel", True, source="rules/domain.json"),
        Invariant("INV-2", "DomainModel", True, symbol="Order.place", source="rules/domain.json"),
        Invariant("INV-3", "DomainModel", test=False, source="rules/domain.json"),
        Invariant("INV-4", "Kernel", globs=("src/nowhere/*.ts",), source="rules/kernel.json"),
    ),
)
