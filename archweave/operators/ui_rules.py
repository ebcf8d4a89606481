"""Functions of user interface files that hold rules: what ``plans.design_delta`` compares.

Lexical: comments, strings and templates are blanked, spans of functions are found by their brackets, and operators and
calls are counted in them. Only files of the user interface that name a rule go to the scan, one small helper a file
inside Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.keys import scope
from archweave.operators import plans
from archweave.ship import ship_package

# Which files, names and calls count.
_SOURCE = r"(?i)\.[cm]?[jt]sx?$"
_UI_PATH = r"(?i)(?:^|/)(?:components?|pages|hooks|ui|views|screens)(?:/|$)|(?:^|/)app/(?!api/)"
_UI_LAYER = r"(?i)presentation|ui|view"
_BOOLEAN = re.compile(r"^(can|should)[A-Z_]|policy", re.I)
_CALCULATION = re.compile(r"^(calculate|compute)[A-Z_]", re.I)
_SHOWN = re.compile(r"(?:route|routing|path|label|className|style|render|display|view|modal|dialog|tooltip|navigate|navigation|href|tab|menu|component|toast|breadcrumb|sidebar|drawer|popover|layout|theme|icon)", re.I)
_SHOWING = re.compile(r"^(?:use[A-Z_]|render|navigate|redirect|push|replace|open|close|show|hide|setState|set[A-Z_]|toast|alert|confirm)")
_PREDICATES = {"includes", "some", "every", "has"}
SMELL = "domain-logic-in-ui"

_NAME = r"[A-Za-z_$][\w$]*"
_TEXTS = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*\"""", re.S)
_WORD = re.compile(rf"(?<![\w$.]){_NAME}", re.A)
_BEFORE = re.compile(r"(?:(?P<function>function)\s*\*?|(?P<variable>const|let|var|,)|(?P<new>new))\s*\Z", re.A)
_BINDING = re.compile(rf"\s*(?::[^=;]*?)?=(?![=>])\s*(?:async(?![\w$])\s*)?(?:(?P<function>function(?![\w$])\s*\*?\s*(?:{_NAME})?)|(?P<one>{_NAME}\s*=>\s*)|(?=[(<]))", re.A)
_TYPES = re.compile(r"\s*(?:<[^()]*?>)?\s*(?=\()", re.A)
_RETURNS = re.compile(r"\s*(?::\s*[^\s{};=][^{};=]*)?(?P<arrow>=>)?\s*", re.A)
_GENERIC = re.compile(r"(?<=[\w$])<[\w$\s,.|\[\]<>]*>(?=\s*\()", re.A)
_LOOP = re.compile(rf"(?<![\w$])for\s*\(\s*(?:const|let|var)\s+{_NAME}\s+in(?![\w$])", re.A)
_MARKUP = re.compile(r"(?:\A|[(\[{},;=?:&|>]|(?<![\w$])return)\s*<(?:>|[A-Za-z])", re.A)
_OPERATOR = re.compile(
    rf"=>|(?P<comparison>[!=]==?|[<>]=|(?<!<)<(?!<)|(?<!>)>(?!>)|(?<![\w$.])(?:instanceof|in)(?![\w$]))|<<=?|>>>?=?"
    rf"|(?:\*\*|&&|\|\||\?\?|[-+*/%&|^])=|\+\+|--|(?P<logical>&&|\|\||\?\?)|(?P<arithmetic>\*\*|[-+*/%])|(?P<call>(?<![\w$]){_NAME})(?=\s*\()",
    re.A,
)
_OPERAND = re.compile(r"""(?:[)\]'"`]|(?<![\w$])(?!(?:return|typeof|case|in|of|void|await|yield|delete|instanceof)\Z)[\w$]+)\Z""", re.A)
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "with"}
_OPEN, _CLOSE = "([{", ")]}"
_BRACKET = re.compile(r"[()\[\]{}]")
_STOP = re.compile(r"[()\[\]{};,\n]")
_GOES_ON = re.compile(r"\s*(?:&&|\|\||\?|:|[.+*/%<>=-])", re.A)
_UNFINISHED = re.compile(r"(?:&&|\|\||[?:+*/%<>=(-])\s*\Z", re.A)


def _blank(match: re.Match) -> str:
    """As many characters; strings keep their quotes, as operands."""
    text = match[0]
    if text[0] == "/":
        return re.sub(r"[^\n]", " ", text)
    return text[0] + re.sub(r"[^\n]", " ", text[1:-1]) + text[0] if len(text) > 1 else " "


def _closed(code: str, at: int) -> int:
    """After the bracket that closes the one at ``at``; the end if none does."""
    depth = 0
    for m in _BRACKET.finditer(code, at):
        depth += 1 if m[0] in _OPEN else -1
        if depth == 0:
            return m.end()
    return len(code)


def _expression(code: str, at: int) -> int:
    """Where an arrow's expression ends: at a separator outside brackets, or at the end of a line that isn't carried on."""
    depth = 0
    for m in _STOP.finditer(code, at):
        if m[0] in _OPEN:
            depth += 1
        elif m[0] in _CLOSE:
            depth -= 1
            if depth < 0:
                return m.start()
        elif depth == 0 and m[0] in ";,":
            return m.start()
        elif depth == 0 and code[at : m.start()].strip() and not _GOES_ON.match(code, m.end()) and not _UNFINISHED.search(code[max(at, m.start() - 40) : m.start()]):
            return m.start()
    return len(code)


def _body(code: str, word: re.Match) -> tuple[int, int] | None:
    """The span of the body, if a function is declared or bound at this word."""
    before = _BEFORE.search(code[max(0, word.start() - 40) : word.start()])
    kind = before.lastgroup if before else "method"
    at, arrow = word.end(), False
    if kind == "new":
        return None
    if kind == "variable":
        binding = _BINDING.match(code, at)
        if not binding:
            return None
        if binding["one"]:
            at = binding.end()
            return (at, _closed(code, at)) if code[at : at + 1] == "{" else (at, _expression(code, at))
        at, arrow = binding.end(), not binding["function"]
    types = _TYPES.match(code, at)
    if not types:
        return None
    after = _RETURNS.match(code, _closed(code, types.end()))
    if bool(after["arrow"]) != arrow:
        return None
    at = after.end()
    if code[at : at + 1] == "{":
        return at, _closed(code, at)
    return (at, _expression(code, at)) if arrow else None


def _evidence(body: str) -> dict[str, int] | None:
    """Counts of operators and predicates; null where the body shows something."""
    body = _LOOP.sub("for (", _GENERIC.sub("", body))
    if _MARKUP.search(body):
        return None
    n = dict.fromkeys(("comparison", "logical", "predicates", "arithmetic"), 0)
    for m in _OPERATOR.finditer(body):
        kind = m.lastgroup
        before = body[max(0, m.start() - 80) : m.start()].rstrip()
        if kind == "call":
            if m[0] in _NO_CALL or re.search(r"(?<![\w$.])(?:new|function)\Z", before):
                continue
            if _SHOWING.search(m[0]) or _SHOWN.search(m[0]):
                return None
            n["predicates"] += m[0] in _PREDICATES
        elif kind and (kind != "arithmetic" or _OPERAND.search(before)):
            n[kind] += 1
    return n


def rules_of(content: str) -> Iterator[tuple[int, str, str, int, str]]:
    """(offset, name, kind, magnitude, detail) of a script's functions that are named and built like rules."""
    code = _TEXTS.sub(_blank, content)
    for word in _WORD.finditer(code):
        boolean, calculation = _BOOLEAN.search(word[0]), _CALCULATION.search(word[0])
        if not (boolean or calculation) or _SHOWN.search(word[0]):
            continue
        span = _body(code, word)
        n = _evidence(code[slice(*span)]) if span else None
        if n is None:
            continue
        held = n["comparison"] + n["logical"] + n["predicates"]
        kind, magnitude = ("calculation-rule", n["arithmetic"]) if calculation and n["arithmetic"] else ("authorization-policy-rule", held if boolean else 0)
        if magnitude:
            yield word.start(), word[0], kind, magnitude, f"comparisons:{n['comparison']};logical:{n['logical']};predicates:{n['predicates']};arithmetic:{n['arithmetic']}"


def ui_rule_findings(sources: DataFrame) -> DataFrame:
    """sources (repo, [snapshot], path, content, layer) -> (repo, [snapshot], path, line, smell, symbol, kind, magnitude,
    detail, fingerprint).

    Rule-named functions, bound functions and methods of files whose path or layer is of the user interface, with how
    many operators and predicates they hold; those that show something are none. line is that of the name. The
    fingerprint is of smell, path, symbol and kind, so it outlives moves inside the file. A null content has none.
    """
    ship_package(sources.sparkSession)
    keys = scope(sources)
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", "")
    shown = F.col("path").rlike(_UI_PATH) | F.coalesce(F.col("layer").rlike(_UI_LAYER), F.lit(False))
    files = sources.select(*keys, path.alias("path"), "content", "layer").where(F.col("path").rlike(_SOURCE) & ~F.col("path").endswith(".d.ts") & shown)
    files = files.where(F.col("content").rlike("(?i)policy|can[A-Z_]|should[A-Z_]|calculate[A-Z_]|compute[A-Z_]"))
    names = [*keys, "path", "line", "symbol", "kind", "magnitude", "detail"]
    kinds = [*[pa.string()] * (len(keys) + 1), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = ", ".join(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in zip(names, kinds, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for *own, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = [m.start() for m in re.finditer("\n", content)]
                for at, *found in rules_of(content):
                    for column, x in zip(out, (*own, bisect_left(ends, at) + 1, *found), strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    found = files.select(*[F.col(k).cast("string") for k in keys], "path", "content").mapInArrow(run, schema)
    identity = F.concat_ws("|", F.lit(SMELL), "path", "symbol", "kind")
    return found.select(*keys, "path", "line", F.lit(SMELL).alias("smell"), "symbol", "kind", "magnitude", "detail", F.concat(F.lit("sha256:"), F.sha2(identity, 256)).alias("fingerprint"))


def ui_design_delta(base: DataFrame, candidate: DataFrame, touched: DataFrame) -> DataFrame:
    """(repo, path, smell, symbol, kind, change): rules that user interface files of the candidate's sources gained on touched paths."""
    return plans.design_delta(ui_rule_findings(base), ui_rule_findings(candidate), touched)
