from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from archweave.llm.warc import read_warc, record_table, records, write_warc


def brute(rows):
    body = [(p, (h or "").encode()) for p, _, h in rows]
    largest: dict[bytes, int] = {}
    for p, b in body:
        if p is not None:
            largest[b] = max(largest.get(b, p), p)
    out = []
    for p, b in body:
        revisit = len(b) >= 1000 and b in largest and p != largest[b]
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", largest[b] if revisit else None))
    return sorted(out, key=repr)


def pages():
    rnd = random.Random(2)
    bodies = ["<p>é\r\n\r\nWARC/1.1\r\n</p>" * n for n in (0, 1, 20, 100, 5000)] + ["x" * 999, "x" * 1000, "y" * 2500]
    rows = [(i, rnd.choice(["http://a/é b\r\nX: y", None, "http://b"]), rnd.choice(bodies)) for i in range(60)]
    return rows + [(100, "u", None), (None, "u", bodies[4]), (59, "u", bodies[4]), (59, "u", bodies[4]), (None, "u", "n" * 3000), (None, "u", "n" * 3000)]


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, piece string")
    found = records(df)
    archives = write_warc(found, chunk=700)
    chunks = read_warc(archives, chunk=512).cache()
    assert sorted(map(tuple, record_table(chunks).collect()), key=repr) == brute(rows)
    assert archives.agg(F.sum("n_records")).first()[0] == len(rows)
    assert chunks.agg(F.max(F.length("piece"))).first()[0] == 512
    whole = chunks.where("record_type = 'response'").groupBy("path", "record_no").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "piece"))).alias("c"), F.max("payload_digest").alias("d"))
    for r in whole.collect():
        assert hashlib.sha1(b"".join(bytes(x.piece) for x in r.c)).hexdigest() == r.d


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert record_table(read_warc(write_warc(records(df)))).collect() == []
