from __future__ import annotations

from archweave.derive import facts
from archweave.jobs import queries

SF = "/root/testdata/sf0.001"


def brute(spark):
    files = {(r.repo, r.path) for r in queries._classified(spark, SF).collect()}
    ahead: dict = {}
    for r in facts(spark, SF, "dependencies").collect():
        a, b = (r.repo, r.from_path), (r.repo, r.to_path)
        if not r.type_only and a != b and a in files and b in files:
            ahead.setdefault(a, set()).add(b)

    def reach(node):
        seen, open_ = set(), [node]
        while open_:
            for n in ahead.get(open_.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    open_.append(n)
        return seen

    of = {n: reach(n) for n in ahead}
    groups = {frozenset(m for m in of[n] if n in of.get(m, ())) for n in ahead if n in of[n]}
    return {(next(iter(g))[0], ",".join(sorted(p for _, p in g))) for g in groups}


def test_all_dependencies_match_reachability(spark):
    want = brute(spark)
    found = queries.queries()
    assert {(r.repo, r.members) for r in found["find_all_cycles"](spark, SF).collect()} == want
    assert {r for r, _ in want} - {"src1", "src7"}
    got = {(r.repo, r.file, r.blocking) for r in found["apply_cycle_policy_to_all"](spark, SF).collect()}
    assert got == {(r, m.split(",")[0], r == "src1") for r, m in want if r != "src7"}
