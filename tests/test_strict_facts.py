"""Facts documents read strictly: every table, and a reject for each departure from the form."""

from __future__ import annotations

import copy
import json

from archweave.sources.strict_facts import TABLES, read_facts_strictly

GOOD = {
    "repo": "r", "snapshot": "s", "schemaVersion": "1.1", "completeness": "complete", "completenessReasons": [],
    **dict.fromkeys(("resolverIdentity", "compilerIdentity", "compilerOptionsHash", "tsconfigHash", "evidenceRequirementsHash"), "x"),
    "files": [{"path": p, "contentHash": "h", "parseStatus": "parsed", "parseDiagnosticCount": 0, "exportsOnlyTypes": False, "typeOnlyExportNames": ["T"], "hasTopLevelSideEffects": True} for p in ("a.ts", "é/b.ts")],
    "dependencies": [{"from": "a.ts", "specifier": "./b", "kind": "import", "typeOnly": False, "line": 3, "resolution": "resolved-project", "target": "é/b.ts", "namedBindings": []}, {"from": "a.ts", "kind": "require", "typeOnly": False, "line": 4, "resolution": "dynamic"}],
    "capabilityUses": [{"file": "a.ts", "line": 1, "symbol": "fetch", "capability": "network", "source": "ambient-global"}],
    "ambientUses": [{"file": "a.ts", "line": 1, "symbol": "fetch"}],
    "publishCalls": [{"file": "a.ts", "line": 1, "objectHasIntent": True, "arkPublishCandidate": True, "hasSource": False}],
    "intentReferences": [{"file": "a.ts", "line": 1, "intent": "Domain.X"}],
    "safetyUses": [{"file": "a.ts", "line": 1, "kind": "in-memory-store", "symbol": "m"}, {"file": "a.ts", "line": 2, "kind": "any-cast"}],
    "classShapes": [{"file": "a.ts", "className": "C", "exported": True, "hasPublicMutableFields": True, "hasPublicSetters": False, "hasPublicConstructor": True, "hasStaticFactory": False, "mutatingMethods": [{"name": "m", "referencesGuardOrPublish": True}]}],
}


def changed(name, change):
    doc = copy.deepcopy(GOOD)
    doc["repo"] = name
    change(doc)
    return json.dumps(doc)


def put(*path_and_value):
    *path, last, value = path_and_value

    def change(doc):
        for p in path:
            doc = doc[p]
        doc[last] = value

    return change


def drop(*path):
    return lambda doc: __import__("functools").reduce(lambda d, p: d[p], path[:-1], doc).pop(path[-1])


BAD = {
    "key": (put("files", 0, "extra", 1), "$.files[0].extra", "unknown-key"),
    "top": (put("more", 1), "$.more", "unknown-key"),
    "enum": (put("dependencies", 0, "kind", "include"), "$.dependencies[0].kind", "invalid"),
    "capability": (put("capabilityUses", 0, "capability", "magic"), "$.capabilityUses[0].capability", "invalid"),
    "version": (put("schemaVersion", "2.0"), "$.schemaVersion", "invalid"),
    "number": (put("ambientUses", 0, "line", "1"), "$.ambientUses[0].line", "invalid"),
    "zero": (put("ambientUses", 0, "line", 0), "$.ambientUses[0].line", "invalid"),
    "fraction": (put("ambientUses", 0, "line", 1.5), "$.ambientUses[0].line", "invalid"),
    "null": (put("publishCalls", 0, "hasSource", None), "$.publishCalls[0].hasSource", "invalid"),
    "empty": (put("intentReferences", 0, "intent", ""), "$.intentReferences[0].intent", "invalid"),
    "missing": (drop("files", 1, "contentHash"), "$.files[1].contentHash", "missing"),
    "identity": (drop("tsconfigHash"), "$.tsconfigHash", "missing"),
    "array": (drop("safetyUses"), "$.safetyUses", "invalid"),
    "object": (put("ambientUses", [7]), "$.ambientUses[0]", "invalid"),
    "method": (put("classShapes", 0, "mutatingMethods", [{"name": "m", "referencesGuardOrPublish": True, "x": 1}]), "$.classShapes[0].mutatingMethods", "invalid"),
    "names": (put("files", 0, "typeOnlyExportNames", ["a", 1]), "$.files[0].typeOnlyExportNames", "invalid"),
    "target": (drop("dependencies", 0, "target"), "$.dependencies[0].target", "conflict"),
    "specifier": (put("dependencies", 1, "resolution", "unresolved"), "$.dependencies[1].specifier", "conflict"),
    "symbol": (put("safetyUses", 1, "symbol", "x"), "$.safetyUses[1].symbol", "conflict"),
    "file": (put("ambientUses", 0, "file", "z.ts"), "$.ambientUses[0].file", "unknown-file"),
    "reasons": (put("completeness", "partial"), "$.completenessReasons", "incomplete"),
}


def test_each_departure_is_one_reject_and_its_document_gives_no_facts(spark, tmp_path):
    lines = [json.dumps(GOOD), *[changed(name, change) for name, (change, _, _) in BAD.items()], "{broken", "[1]", ""]
    (tmp_path / "f.json").write_text("\n".join(lines))
    got = read_facts_strictly(spark, str(tmp_path))
    want = {(name, at, reason) for name, (_, at, reason) in BAD.items()} | {(None, "$", "not-json")}
    assert {(r.repo, r.at, r.reason) for r in got["rejects"].collect()} == want
    assert {name: {r.repo for r in got[name].collect()} for name in TABLES.values()} == dict.fromkeys(TABLES.values(), {"r"})
    first = got["dependencies"].orderBy("ordinal").first()
    assert (first.from_path, first.to_path, first.line, first.type_only, first.named_bindings, first.snapshot) == ("a.ts", "é/b.ts", 3, False, [], "s")
    assert [tuple(m) for m in got["class_shapes"].first().mutating] == [("m", True)] and got["safety_uses"].count() == 2


def test_paths(spark, tmp_path):
    bad = ["/a.ts", "C:/a.ts", "a//b.ts", "../a.ts", "a/./b.ts", "a\\b.ts", "a/", ""]
    (tmp_path / "f.json").write_text("\n".join([changed(f"p{i}", put("files", 1, "path", p)) for i, p in enumerate(bad)] + [changed("twice", put("files", 1, "path", "a.ts"))]))
    got = read_facts_strictly(spark, str(tmp_path))["rejects"].collect()
    assert {(r.repo, r.reason) for r in got if r.at == "$.files[1].path"} == {(f"p{i}", "invalid") for i in range(len(bad))} | {("twice", "duplicate-path")}


def test_empty_folder(spark, tmp_path):
    (tmp_path / "f.json").write_text("")
    got = read_facts_strictly(spark, str(tmp_path))
    assert all(df.collect() == [] for df in got.values())
