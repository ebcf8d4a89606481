"""Token counts of whole texts; huge documents are counted in overlapping chunks that are spliced.

The tokenizer is byte-level BPE behind a splitting rule that scans from left to right: what it does from a split on
depends only on the text to the right of it, and no token crosses a split. So

* a text may be cut before any single space that stands between two characters that aren't white space (the rule
  always splits there, whatever surrounds them); the pieces are encoded by the library once each per task and summed.
* a document longer than ``chunk`` characters is dealt out as chunk rows, each with ``overlap`` characters of its right
  neighbour. Both neighbours encode the overlap, with offsets. A *proven* boundary is a split that both report, far
  enough from the ends of the overlap that neither end can have changed it: the left chunk saw all that the rule looks
  at to its right, and the right chunk, from there on, scans what a scan of the whole document would. The left
  chunk's tokens count up to the first proven boundary, the right chunk's from it on. Where an overlap has no proven
  boundary (a run of letters without end), that document is done again with overlaps four times as wide, up to the
  whole of it.

Defined results: a null text is empty and has no tokens; each input row gives one row, also for repeated rows and null
or repeated doc_id; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archweave.lineage import cut
from archweave.ship import ship_package

CHUNK, OVERLAP = 1 << 16, 1 << 9
#: Pieces whose counts a worker keeps.
_MEMO = 400_000
#: Characters that a split must keep from the end of an overlap: longer than any special string and the rule's lookahead.
_MARGIN = 32
_LOOSE = re.compile(r"\s\s|^\s|\s$|[^\S ]")
_CUT = re.compile(r"(?<=\S)(?= \S)")

_tokenizers: dict[str, object] = {}
_memos: dict[str, dict[str, int]] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _tokenizers[path] = loaded
    return _tokenizers[path]


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """Of each text as the library counts it whole."""
    memo = _memos.setdefault(path, {})
    # Split at every space; where white space meets white space, put the text together and cut it by the rule.
    split = [_CUT.split(t) if _LOOSE.search(t) else _spaced(t) for t in texts]
    if len(memo) > _MEMO:
        memo.clear()
    new = list({p for pieces in split for p in pieces if p not in memo})
    for at in range(0, len(new), 4096):
        some = new[at : at + 4096]
        for piece, e in zip(some, _tokenizer(path).encode_batch_fast(some, add_special_tokens=False), strict=True):
            memo[piece] = len(e.ids)
    return [sum(map(memo.__getitem__, pieces)) for pieces in split]


def _spaced(text: str) -> list[str]:
    """Cut before every space of a text whose only white space is single spaces inside it."""
    first, *rest = text.split(" ")
    return [first, *(" " + w for w in rest)] if first else []


def _splits(path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets at which the rule splits, and the tokens before each; the end of the text last."""
    e = _tokenizer(path).encode(text, add_special_tokens=False)
    if not len(e):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    word = np.array([-1 if w is None else w for w in e.word_ids])
    first = np.flatnonzero((np.diff(word, prepend=-2) != 0) | (word == -1))
    offsets = np.array(e.offsets)  # the library makes the list anew each time it is asked for
    # Offsets leave leading white space out of a token if the library trims them: begin where the token before ends.
    start = np.minimum(offsets[first, 0], np.concatenate(([0], offsets[first[1:] - 1, 1])))
    return np.append(start, len(text)), np.append(first, len(e))


def _chunks(chunk: int, overlap: int):
    """Chunk rows of documents: row, part, parts, text, where the next chunk begins in it."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                step = chunk if overlap < len(text) else len(text)
                parts = max(1, -(-len(text) // step)) if step else 1
                for part in range(parts):
                    piece = text[part * step : (part + 1) * step + (overlap if part < parts - 1 else 0)]
                    yield pa.record_batch([[row], [part], [parts], [piece], [min(step, len(piece))]], names=["row", "part", "parts", "text", "step"])

    return f


def _ends(path: str, overlap: int):
    """Per chunk: the splits in the overlap with its left and with its right neighbour, and the tokens before them."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("total", "left_at", "left_n", "right_at", "right_n")}
            for part, parts, text, step in zip(*(batch.column(c).to_pylist() for c in ("part", "parts", "text", "step")), strict=True):
                at, n = _splits(path, text)
                out["total"].append(int(n[-1]))
                left = (at >= _MARGIN) & (at <= overlap - _MARGIN) & (part > 0)
                right = (at >= step + _MARGIN) & (at <= step + overlap - _MARGIN) & (part < parts - 1)
                out["left_at"].append(at[left])
                out["left_n"].append(n[left])
                out["right_at"].append(at[right] - step)
                out["right_n"].append(n[right])
            columns = [pa.array(out["total"], pa.int64()), *(pa.array(out[c], pa.list_(pa.int64())) for c in ("left_at", "left_n", "right_at", "right_n"))]
            yield pa.record_batch([batch.column("row"), batch.column("part"), batch.column("parts"), *columns], names=["row", "part", "parts", "total", "left_at", "left_n", "right_at", "right_n"])

    return f


def _spliced(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of documents (row, text); n_tokens is null where some overlap has no proven boundary."""
    parts = huge.mapInArrow(_chunks(chunk, overlap), "row long, part long, parts long, text string, step long")
    parts = parts.repartition(F.col("row"), F.col("part"))
    ends = parts.mapInArrow(_ends(path, overlap), "row long, part long, parts long, total long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>")
    # Each overlap once: what its two chunks say of it, matched on the split's place.
    said = F.array(
        F.struct((F.col("part") - 1).alias("seam"), F.lit(1).alias("side"), F.col("left_at").alias("at"), F.col("left_n").alias("n")),
        F.struct(F.col("part").alias("seam"), F.lit(0).alias("side"), F.col("right_at").alias("at"), F.col("right_n").alias("n")),
    )
    seams = ends.select("row", "parts", F.explode(said).alias("s")).select("row", "parts", "s.*").where((F.col("seam") >= 0) & (F.col("seam") < F.col("parts") - 1))
    seams = seams.select("row", "seam", "side", F.explode(F.arrays_zip("at", "n")).alias("x")).select("row", "seam", "side", "x.at", "x.n")
    common = seams.groupBy("row", "seam", "at").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("to"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("skip")).where("`to` is not null and skip is not null")
    # The left chunk stops after `to` tokens, the right one skips `skip`.
    best = common.groupBy("row", "seam").agg(F.min_by(F.struct("to", "skip"), "at").alias("b"))
    inner = best.groupBy("row").agg(F.sum(F.col("b.to") - F.col("b.skip")).alias("kept"), F.count("*").alias("seams"))
    whole = ends.groupBy("row").agg(F.max("parts").alias("parts"), F.sum(F.when(F.col("part") == F.col("parts") - 1, F.col("total")).otherwise(0)).alias("last"))
    return whole.join(inner, "row", "left").select("row", F.when(F.coalesce("seams", F.lit(0)) == F.col("parts") - 1, F.col("last") + F.coalesce("kept", F.lit(0))).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row; tokenizer: path of a ``tokenizers`` file that all executors can read."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count for at in range(0, batch.num_rows, 256) for count in count_tokens(tokenizer, batch.column("text").slice(at, 256).to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    is_huge = F.length("text") > chunk
    short = texts.where(~is_huge).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(small, "doc_id long, n_bytes long, n_tokens long")
    # Rows are told apart by a number that a retry gives again only once it is written.
    huge = cut(texts.where(is_huge).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    left, counts = huge.select("row", "text"), None
    while True:
        found = cut(_spliced(left, tokenizer, chunk, overlap))
        done = found.where("n_tokens is not null")
        counts = done if counts is None else counts.union(done)
        if found.where("n_tokens is null").isEmpty():
            break
        overlap *= 4
        chunk = max(chunk, overlap)
        left = left.join(found.where("n_tokens is null").select("row"), "row", "left_semi")
    return short.union(huge.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "row").select("doc_id", "n_bytes", "n_tokens"))
