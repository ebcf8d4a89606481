"""Removal of repeated runs of lines: a suffix array over line-ID sequences by distributed prefix doubling.

A document is the sequence of its lines that hold a word, each an ID (a 64-bit hash). A run of ``min_lines`` or more
lines that also starts earlier, in the order of (doc_id, place in the document), is a later copy, and its lines are
deleted. Runs are judged on the input; overlaps count; runs never cross documents. With ``long_words``, a line of that
many words or more is a run of its own, whatever its neighbours are; words are parted by ASCII white space.

Prefix doubling: suffixes are ranked by their first line, then by pairs of ranks (own, that of the suffix ``length``
lines on) by twice as many lines, and so on. The suffixes of equal rank after a round are an interval of the suffix
array whose longest common prefix is ``length`` lines or more. A suffix that is alone, or whose continuation is, shares
no longer run, and leaves; so rounds get smaller, and end when no class of two is left.

Deletion goes by the deepest interval: each suffix deletes as many lines as the last round had in which an earlier
suffix shared its class. A common run has such a suffix at each of its lines, so the union of these is the union of all
maximal repeated runs, though lengths are known to powers of two only; ``longest_match`` is the greatest of them.

Ranks: classes of two or more, one row each, are sorted; a class's rank is its number in that order, with gaps. A line
with a third of all occurrences is one row a task before the shuffle. The continuation's rank is looked up by a range
frame of exactly ``length`` lines inside the document.

Documents with one text (by MD5) are told apart from the rest first: only the earliest enters the array, the others are
later copies from end to end, as the array would find in as many rounds as their lines have doublings. Line IDs aren't
confirmed: a false run of two lines needs two collisions of 64 bits side by side.

Defined results: null and empty texts have no lines; lines without a word are kept and don't part runs; documents
without doc_id come last; rows of the same doc_id and text are one document, treated alike; rows of the same doc_id with
other texts are in the order of the MD5 of the text; other columns are kept by ``deduplicated_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from archweave.lineage import cut
from archweave.ship import ship_package

MIN_LINES = 2
#: Words from which the pipeline takes one line for a run: the window of operator 3.
LONG_WORDS = 50
SPACE = " \t\n\x0b\f\r"
_NONE = (1 << 63) - 1
_PLACE = ["d", "g", "s"]


def _doc(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_NONE))


def _tag(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def _order(tag: Column) -> Column:
    """The first 60 bits of an MD5: they order the texts of one doc_id."""
    return F.conv(F.substring(tag, 1, 15), 16, 10).cast("long")


def _is_long(line: Column, long_words: int) -> Column:
    """Whether a line has so many words; lines too short for that aren't split."""
    return (F.length(line) >= 2 * long_words - 1) & (F.size(F.split(F.trim(line, F.lit(SPACE)), "[ \\t\\x0B\\f\\r]+")) >= long_words)


def line_ids(docs: DataFrame, long_words: int | None = None, without: DataFrame | None = None) -> DataFrame:
    """(d, g, s, h): document, order of its text, place among its lines with a word, line ID; with long_words also long.

    without: (d, g) of documents that are left out, before their lines become rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    known = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), *([] if long_words is None else [_is_long(x, long_words).alias("long")])))
    document = docs.select(_doc(F.col("doc_id")).alias("d"), _order(_tag(F.col("text"))).alias("g"), known.alias("lines"))
    if without is not None:
        document = document.join(without, ["d", "g"], "left_anti")
    return document.select("d", "g", F.posexplode("lines").alias("s", "x")).select("d", "g", "s", "x.*")


def _recurring(suffixes: DataFrame, key: list[str]) -> DataFrame:
    """(key..., first, rank) of the keys that suffixes at two places or more have; ranks are in the order of the keys."""
    place = F.struct(*_PLACE)
    classes = suffixes.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    return classes.orderBy(*key).select(*key, "first", F.monotonically_increasing_id().alias("rank"))


def suffix_classes(lines: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """For each length 1, 2, 4, ...: (length, table (d, g, s, r, later)) of the suffixes whose first ``length`` lines recur.

    r is the rank of the class, later whether an earlier suffix is in it; at length 1, further columns of ``lines`` are
    there too. Ends when there is none.
    """
    lines = cut(lines)
    further = [c for c in lines.columns if c not in (*_PLACE, "h")]
    later = (F.struct(*_PLACE) > F.col("first")).alias("later")
    suffixes = cut(lines.join(_recurring(lines, ["h"]), "h").select(*_PLACE, F.col("rank").alias("r"), later, *further))
    length = 1
    while not suffixes.isEmpty():
        yield length, suffixes
        onward = W.partitionBy("d", "g").orderBy("s").rangeBetween(length, length)
        pairs = suffixes.select(*_PLACE, "r", F.first("r").over(onward).alias("r2")).where("r2 is not null")
        suffixes = cut(pairs.join(_recurring(pairs, ["r", "r2"]), ["r", "r2"]).select(*_PLACE, F.col("rank").alias("r"), later))
        length *= 2


def later_copies(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(d, g, runs, longest): runs (s, length) of later copies, the longest known from each start, and the greatest length.

    Of runs shorter than min_lines only those of one line that ``lines`` has as long. min_lines: a power of two.
    """
    if min_lines & (min_lines - 1):
        raise ValueError("min_lines: a power of two")
    found = lines.select(*_PLACE, F.lit(0).alias("length")).limit(0)
    for length, suffixes in suffix_classes(lines):
        counts = F.lit(length >= min_lines) | (F.col("long") if "long" in suffixes.columns else F.lit(False))
        found = found.union(suffixes.where(F.col("later") & counts).select(*_PLACE, F.lit(length).alias("length")))
    deepest = found.repartition("d", "g").groupBy(*_PLACE).agg(F.max("length").alias("length"))
    return deepest.groupBy("d", "g").agg(F.collect_list(F.struct("s", "length")).alias("runs"), F.max("length").cast("long").alias("longest"))


def _covered(runs: list[dict]) -> set[int]:
    gone: set[int] = set()
    done = 0
    for s, length in sorted((r["s"], r["length"]) for r in runs):
        gone.update(range(max(s, done), s + length))
        done = max(done, s + length)
    return gone


def _kept(min_lines: int, long_words: int | None = None):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("longest_match", "n_lines", "n_removed", "n_runs", "kept_text")}
            for text, runs, is_copy, longest in zip(*(batch.column(c).to_pylist() for c in ("text", "runs", "is_copy", "longest")), strict=True):
                lines = (text or "").split("\n")
                words = [bool(line.strip(SPACE)) for line in lines]
                n = sum(words)
                gone = _covered(runs or [])
                if is_copy and n >= min_lines:
                    gone, longest = set(range(n)), 1 << (n.bit_length() - 1)
                elif is_copy and long_words is not None:
                    of_words = [line for line, word in zip(lines, words, strict=True) if word]
                    gone = {s for s, line in enumerate(of_words) if len(line.encode().split()) >= long_words}
                    longest = int(bool(gone))
                kept, seq = [], 0
                for line, has_word in zip(lines, words, strict=True):
                    if not (has_word and seq in gone):
                        kept.append(line)
                    seq += has_word
                out["longest_match"].append(longest or 0)
                out["n_lines"].append(n)
                out["n_removed"].append(len(gone))
                out["n_runs"].append(sum(s - 1 not in gone for s in gone))
                out["kept_text"].append("\n".join(kept) if gone else text)
            yield pa.record_batch([batch.column("doc"), *(pa.array(v, pa.string() if c == "kept_text" else pa.int64()) for c, v in out.items())], names=["doc", *out])

    return f


def remove_repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """Per row of ``docs``: (doc, longest_match, n_lines, n_removed, n_runs, kept_text); doc is a struct of its columns.

    longest_match: the greatest length, of those doubled from 1, at which some run of the document is a later copy; 0
    if none of min_lines is, and no long line.
    """
    ship_package(docs.sparkSession)
    own = docs.select(_doc(F.col("doc_id")).alias("d"), _tag(F.col("text")).alias("tag"))
    known = cut(own.select("*", _order(F.col("tag")).alias("g")))
    firsts = known.groupBy("tag").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("tag", "first")
    copies = cut(known.join(firsts, "tag").where("d <> first").select("d", "g").distinct())
    found = later_copies(line_ids(docs, long_words, without=copies), min_lines).select("d", "g", "runs", "longest", F.lit(False).alias("is_copy"))
    found = found.union(copies.select("d", "g", F.lit(None).cast(found.schema["runs"].dataType), F.lit(None).cast("long"), F.lit(True)))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), F.col("text").cast("string").alias("text"), _doc(F.col("doc_id")).alias("d"), _order(_tag(F.col("text"))).alias("g"))
    joined = rows.join(found, ["d", "g"], "left").select("doc", "text", "runs", "longest", F.coalesce("is_copy", F.lit(False)).alias("is_copy"))
    return joined.mapInArrow(_kept(min_lines, long_words), f"doc {rows.schema['doc'].dataType.simpleString()}, longest_match long, n_lines long, n_removed long, n_runs long, kept_text string")


def deduplicated_documents(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """``docs`` with later copies deleted from text, and n_chars (if there is one) of what is left.

    Documents of which no line with a word is left, though there was one, are dropped.
    """
    kept = remove_repeated_runs(docs, min_lines, long_words).where((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
    columns = []
    for name, kind in docs.dtypes:
        if name == "text":
            columns.append(F.col("kept_text").alias("text"))
        elif name == "n_chars":
            columns.append(F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kind)).otherwise(F.col("doc.n_chars")).alias("n_chars"))
        else:
            columns.append(F.col("doc")[name].alias(name))
    return kept.select(*columns)
