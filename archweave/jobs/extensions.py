"""Registered queries with a user's validators and interceptors over the derived events, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archweave.derive import facts, with_views
from archweave.operators import extensions as ext
from archweave.ship import ship_package

Query = Callable[[SparkSession, str], DataFrame]

_PAYLOAD = """CASE event_id % 6 WHEN 0 THEN '{"k":3,"lines":[{"n":1},{"n":0}]}' WHEN 1 THEN '{"k":"x"}' WHEN 2 THEN '{"lines":[{"n":-4}]}' WHEN 3 THEN '{"k":' WHEN 4 THEN '{"k":-1,"lines":[]}' END"""


def _check_lines(payload: object) -> list[tuple[object, str]]:
    """A payload without lines raises, as a user's code may."""
    return [(("lines", i, "n"), "lines count something") for i, line in enumerate(payload["lines"]) if line["n"] < 1]


def _check_sign(payload: object) -> list[tuple[object, str]] | None:
    return [(("k",), "k is below zero")] if payload is not None and payload.get("k", 0) < 0 else None


def _total(payload: object) -> object:
    return {"total": sum(x["n"] for x in payload["lines"])}


def _mark(payload: object) -> object:
    return {"k": 5, "mark": "late"} if "k" not in payload else None


def _events(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    return facts(spark, sf, "domain_events").withColumns({"payload": F.expr(_PAYLOAD), "event_version": F.lit("2")})


def external_payload_issues(spark: SparkSession, sf: str) -> DataFrame:
    checks = (ext.Validator("Domain.Order.Placed", "2", _check_lines), ext.Validator("Domain.Order.Placed", "2", _check_sign))
    return ext.validate_with(_events(spark, sf).where("intent = 'Domain.Order.Placed'"), checks).select("event_id", "version", "path", "code", F.when(F.col("code") == "invalid", F.col("message")).alias("message"))


def coded_interceptions(spark: SparkSession, sf: str) -> DataFrame:
    coded = (ext.CodedInterceptor("total", "Domain.Order.Placed", _total), ext.CodedInterceptor("mark", "Domain.Order.Placed", _mark, F.col("event_id") % 4 == 2))
    rows = ext.intercept_with(_events(spark, sf), coded)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("event_id", "payload", joined("interceptions"), joined("failures"), F.size("errors").cast("long").alias("n_errors"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (external_payload_issues, coded_interceptions)}


def oracle_sql() -> dict[str, str]:
    base = f"{with_views('domain_events')}, e AS (SELECT event_id, intent, event_id % 6 AS v, event_id % 4 AS w, {_PAYLOAD} AS payload FROM domain_events)"
    return {
        "external_payload_issues": f"""{base}, i(v, path, code, message) AS (VALUES
 (0, 'lines[1].n', 'invalid', 'lines count something'), (1, 'k', 'type', NULL), (1, '$', 'validator-error', NULL), (1, '$', 'validator-error', NULL), (2, 'k', 'missing-required', NULL), (2, 'lines[0].n', 'invalid', 'lines count something'),
 (3, 'k', 'missing-required', NULL), (3, '$', 'not-json', NULL), (3, '$', 'not-json', NULL), (4, 'k', 'invalid', 'k is below zero'), (5, 'k', 'missing-required', NULL), (5, '$', 'validator-error', NULL))
 SELECT event_id, '2' AS version, path, code, message FROM e JOIN i ON i.v = e.v WHERE intent = 'Domain.Order.Placed'""",
        "coded_interceptions": f"""{base}, o AS (SELECT *, intent = 'Domain.Order.Placed' AS own FROM e)
 SELECT event_id, CASE WHEN NOT own THEN payload WHEN v = 0 THEN '{{"k":3,"lines":[{{"n":1}},{{"n":0}}],"total":1}}' WHEN v = 2 AND w = 2 THEN '{{"k":5,"lines":[{{"n":-4}}],"mark":"late"}}' WHEN v = 4 THEN '{{"k":-1,"lines":[],"total":0}}' ELSE payload END AS payload,
  CASE WHEN NOT own THEN '' WHEN v IN (0, 4) THEN 'total' WHEN v = 2 AND w = 2 THEN 'mark' ELSE '' END AS interceptions,
  CASE WHEN NOT own OR v IN (0, 4) THEN '' WHEN v = 2 THEN 'total' WHEN w = 2 AND v IN (3, 5) THEN 'total,mark' ELSE 'total' END AS failures,
  CASE WHEN NOT own OR v IN (0, 2, 4) THEN CAST(0 AS BIGINT) WHEN w = 2 AND v IN (3, 5) THEN 2 ELSE 1 END AS n_errors FROM o""",
    }
