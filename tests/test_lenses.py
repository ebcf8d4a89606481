"""Lenses read violations of every repository and every path of a smell."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from archweave.jobs import oracle, queries
from archweave.operators import coach
from tests.harness import difference

#: What paths of derived files go through, twenty files each, and the layers of it.
FOLDERS = ["domain", "application", "adapters/persistence", "presentation", "features/en", "kernel", "lib", "features/en/ui", "domain/gen"]
LAYERS = ["DomainModel", "ApplicationOrchestration", "PersistenceAdapters", "PresentationAdapters", "Features", "Kernel", None, "PresentationAdapters", None]
DENIED = {("DomainModel", "ApplicationOrchestration"), ("DomainModel", "PersistenceAdapters"), ("DomainModel", "PresentationAdapters"), ("ApplicationOrchestration", "PresentationAdapters"), ("PresentationAdapters", "PersistenceAdapters")}


def written(folder, repos):
    """One document for each name of ``repos``, by doc_id; a file refers to files 20 and more numbers on."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', 5, 'prose')", list(enumerate(repos)))
    con.execute(f"COPY documents TO '{folder}/documents.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def two(tmp_path_factory):
    """Files of two repositories, a name of four letters and one of five, in turns."""
    return written(tmp_path_factory.mktemp("two"), ["src1" if i % 2 else "src10" for i in range(400)])


def test_compass_reads_violations_of_all_repositories(spark, two):
    def layer(i):
        return LAYERS[i // 20 % 9]

    ends = [(i, (i + 20 * (k * k + i % 5)) % 400) for i in range(400) for k in (1, 2, 3)]
    want = {repo: {f"{layer(i)}->{layer(j)}" for i, j in ends if (layer(i), layer(j)) in DENIED and i % 2 == odd} for repo, odd in (("src1", 1), ("src10", 0))}
    got = {r.repo: r for r in queries.queries()["compass"](spark, two).where("lens = 'direction'").collect()}
    assert {k: (r.status, r.n, set(r.evidence.split(","))) for k, r in got.items()} == {k: ("residual", len(v), v) for k, v in want.items()}


def test_compass_counts_paths_that_smells_do_not_list(spark, two):
    """Smells list twelve paths; a lens counts all, and lists the first twelve."""
    large = [i for i in range(0, 400, 11) if i // 20 % 9 != 8]
    want = {repo: sorted(["layout:features/*", "layout:hex-domain-application-infra", *(f"src/{FOLDERS[i // 20 % 9]}/f{i}.ts" for i in large if i % 2 == odd)]) for repo, odd in (("src1", 1), ("src10", 0))}
    got = {r.repo: r for r in queries.queries()["compass"](spark, two).where("lens = 'cohesion'").collect()}
    assert {k: (r.n, r.evidence) for k, r in got.items()} == {k: (len(v), ",".join(v[:12])) for k, v in want.items()}
    assert all(r.n > 15 for r in got.values())


def test_evidence_is_the_first_of_all_parts(spark):
    """Of many pieces, in parts of several each; with one piece and with none of them listed."""
    found = spark.range(3000).select(F.lit("r").alias("repo"), F.lit("s").alias("source"), F.lit("i").alias("id"), F.format_string("e%05d", 2 * F.col("id")).alias("evidence"))
    lenses = spark.createDataFrame([("s", "i", "lens", 0)], "source string, id string, lens string, priority long")
    for rows, most, want in ((found, 12, range(0, 24, 2)), (found, 0, ()), (found.where("evidence = 'e00042'"), 12, (42,))):
        row = coach.compass(rows.union(rows), lenses, found.select("repo").distinct(), most).first()
        assert (row.n, row.evidence) == (rows.count(), ",".join(f"e{i:05}" for i in want))


@pytest.mark.parametrize("name", ["compass", "top_residual", "deepening_candidates"])
def test_lenses_are_those_of_sql(spark, two, name):
    assert difference(spark, queries.queries()[name], oracle.oracle_sql()[name], two) is None


def test_candidates_have_lenses_of_all_repositories(spark, tmp_path):
    """src1 and src10 have one violation each and no smell, so the lens is all that there is to name."""
    own = {3: "src1", 23: "src1", 8: "src10", 28: "src10"}
    folder = written(tmp_path, [own.get(i, "other") for i in range(60)])
    got = queries.queries()["deepening_candidates"](spark, folder).where("repo <> 'other'").orderBy("repo").collect()
    assert [tuple(r) for r in got] == [(repo, 1, "lens:direction", "residual") for repo in ("src1", "src10")]
    assert difference(spark, queries.queries()["deepening_candidates"], oracle.oracle_sql()["deepening_candidates"], folder) is None
