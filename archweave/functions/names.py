"""Intent names, hashes and keys as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from archweave.contract import INTENT_PREFIXES

#: FNV-1a, 32 bits.
_FNV_START, _FNV_PRIME = 2166136261, 16777619


def intent_problem(intent: Column) -> Column:
    """null for a valid intent name, else 'empty', 'prefix' or 'segment'."""
    known = reduce(lambda a, b: a | b, [intent.startswith(p) for p in INTENT_PREFIXES])
    rest = F.substring(intent, F.instr(intent, ".") + 1, F.length(intent))
    return F.when(intent.isNull() | (intent == ""), "empty").when(~known, "prefix").when(~rest.rlike("^[A-Za-z][A-Za-z0-9_.]*$"), "segment")


def intent_layer(intent: Column, prefixes: dict[str, tuple[str, ...]]) -> Column:
    """Layer of the longest prefix that matches; the earlier declared one among equals."""
    dotted = [(layer, p if p.endswith(".") else f"{p}.", i) for i, (layer, own) in enumerate(prefixes.items()) for p in own]
    out = None
    for layer, prefix, _ in sorted(dotted, key=lambda x: (-len(x[1]), x[2])):
        out = F.when(intent.startswith(prefix), layer) if out is None else out.when(intent.startswith(prefix), layer)
    return out if out is not None else F.lit(None).cast("string")


def _utf16(text: Column) -> Column:
    """array<bigint> of a text's UTF-16 units; characters beyond U+FFFF, which are rare, are two."""
    plain = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    points = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    units = F.flatten(F.transform(points, lambda p: F.when(p > 0xFFFF, F.array(F.lit(0xD800) + F.shiftright(p - 0x10000, 10), F.lit(0xDC00) + (p - 0x10000).bitwiseAND(F.lit(0x3FF)))).otherwise(F.array(p))))
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), units).otherwise(plain)


def stable_hash(text: Column) -> Column:
    """'fnv1a-' and eight hex digits, over UTF-16 units."""
    value = F.aggregate(_utf16(text), F.lit(_FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(_FNV_PRIME)).bitwiseAND(F.lit(4294967295)))
    return F.concat(F.lit("fnv1a-"), F.lower(F.lpad(F.hex(value), 8, "0")))


def baseline_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
