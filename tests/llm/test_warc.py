"""Archives: contract against plain rules, files against an independent reader, segments, framing and damage."""

import base64
import gzip
import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postura.llm import warc as W
from postura.llm.files import new_folder

SF = "/root/testdata/sf0.01"


def plain(rows, least=0):
    """The contract by loops: (page, bytes, digest, type, refers) per row."""
    groups = defaultdict(list)
    for page, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        best = max(groups[data], key=lambda p: (p is not None, p))
        again = len(data) >= least and page != best
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", best if again else None))
    return sorted(out, key=repr)


def got(df):
    rows = df.collect()
    assert all(r.status == "ok" for r in rows)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)


def records_of(path):
    """Another reader: whole file, header lines by regular expression."""
    data = gzip.open(path.removeprefix("file:")).read()
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(re.findall(rb"(?m)^([A-Za-z0-9-]+): (.*?)\r?$", head))
        n = int(fields[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n:n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        data = rest[n + 4:]
    return out


def odd_pages(spark, rng=None):
    rng = rng or random.Random(5)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("aé😀\r\n<>0;") for _ in range(rng.choice([0, 1, 9, 300, 5000])))) for i in range(60)]
    rows += [(100 + i, "http://h/copy", "same page") for i in range(200)] + [(400 + i, None, None) for i in range(5)]
    rows += [(None, "http://h/none", "only nulls"), (None, None, "only nulls"), (None, "a\r\nb c", "same page")]
    rows += [(500, "http://h/twice", "twice"), (500, "http://h/twice", "twice"), (1, "http://h/1", "again")]
    rows += [(600, "http://h/long", "long é " * 200_000)]
    df = spark.createDataFrame([(*r, "x", 7, 8) for r in rows], "page_id long, url string, html string, payload string, digest int, sha int")
    return rows, df.repartition(5)


@pytest.mark.parametrize(("segment", "file_bytes"), [(W.SEGMENT, W.FILE_BYTES), (700, 20_000), (50, 170)])
def test_odd_pages(spark, segment, file_bytes):
    rows, df = odd_pages(spark)
    if segment == 50:
        rows = [r for r in rows if r[0] != 600]
        df = df.where("page_id is null or page_id <> 600")
    manifest = W.write(df, new_folder(spark), segment=segment, file_bytes=file_bytes)
    assert got(W.digest(manifest)) == plain([(p, h) for p, _, h in rows])
    back = W.read(manifest).collect()
    assert sorted(((r.page_id, r.payload.decode()) for r in back), key=repr) == sorted(((p, h or "") for p, _, h in rows), key=repr)
    assert {r.url for r in back} == {u if u is None else W.address(u) for _, u, _ in rows}
    seen = [x for r in manifest.collect() for x in records_of(r.path)]
    kinds = [f[b"WARC-Type"] for f, _ in seen]
    assert len({f[b"WARC-Record-ID"] for f, _ in seen}) == len(seen)
    assert all(f[b"WARC-Block-Digest"].decode() == f"sha1:{W.sha1(b)}" for f, b in seen)
    assert kinds.count(b"response") + kinds.count(b"revisit") == len(rows) and max(len(b) for _, b in seen) <= max(segment, 120)
    assert manifest.agg(F.sum("records")).first()[0] == len(seen) - kinds.count(b"warcinfo")
    if segment < W.SEGMENT:
        assert b"continuation" in kinds


def test_least_length(spark):
    rows, df = odd_pages(spark)
    assert got(W.digest(W.write(df, new_folder(spark), least=7))) == plain([(p, h) for p, _, h in rows], 7)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    from postura.llm.queries import QUERIES

    assert got(QUERIES["op11_warc"](spark, SF)) == plain([(r.page_id, r.html) for r in df.collect()])


def test_empty_table(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet").where("false")
    manifest = W.write(df, new_folder(spark))
    assert manifest.count() == 0 and W.read(manifest).count() == 0


def test_segments_out_of_order_missing_and_wrong(spark):
    block = W.HTTP + W.chunked(b"x" * 1000, 64)
    cut = [block[i:i + 300] for i in range(0, len(block), 300)]
    total = len(block)

    def parts(origin, numbers, total=total, blocks=None):
        return [(origin, n, total if n == len(cut) else None, (blocks or {}).get(n, cut[n - 1]), "response" if n == 1 else "continuation",
                 f"{origin}/{n}", 9 if n == 1 else None, "u" if n == 1 else None, W.sha1(b"x" * 1000) if n == 1 else None) for n in numbers]
    n = len(cut)
    rows = parts("shuffled", [n, *range(1, n)]) + parts("twice", [*range(1, n + 1), 2]) + parts("gap", [1, *range(3, n + 1)])
    rows += parts("no end", range(1, n)) + parts("no start", range(2, n + 1)) + parts("length", range(1, n + 1), total + 1)
    rows += parts("conflict", range(1, n + 1)) + parts("conflict", [2], blocks={2: b"?" * 300})
    rows += parts("framing", range(1, n + 1), blocks={1: cut[0].replace(b"\r\n40\r\n", b"\r\n4g\r\n")})
    rows += parts("digest", range(1, n + 1), blocks={1: cut[0].replace(b"xxxx", b"xxxy", 1)})
    df = spark.createDataFrame(rows, "origin string, segment int, total long, block binary, record_type string, record_id string, "
                                     "page_id long, url string, digest string").repartition(4)
    out = {r.record_id: r for r in W.reassemble(df).collect()}
    assert {k: r.status for k, r in out.items()} == {
        "shuffled": "ok", "twice": "ok", "gap": W.GAP, "no end": W.GAP, "no start": W.GAP, "length": W.LENGTH, "conflict": W.CONFLICT,
        "framing": W.FRAMING, "digest": W.DIGEST}
    assert out["shuffled"].payload == b"x" * 1000 and out["shuffled"].page_id == 9


@pytest.mark.parametrize(("framed", "body"), [
    (b"0\r\n\r\n", b""), (b"3\r\nabc\r\n0\r\n\r\n", b"abc"), (b"A;x=\"1\"\r\n0123456789\r\n1\r\n\r\r\n0\r\nTrailer: 1\r\n\r\n", b"0123456789\r"),
    (b"2\r\n\r\n\r\n0\r\n\r\n", b"\r\n"), (b"", None), (b"3\r\nab\r\n0\r\n\r\n", None), (b"3\r\nabc\r\n", None), (b"-1\r\n\r\n0\r\n\r\n", None),
    (b"0\r\n\r\nmore", None), (b"ff\r\nabc\r\n0\r\n\r\n", None), (b"0\r\n", None)])
def test_framing(framed, body):
    if body is None:
        with pytest.raises(ValueError):
            W.unchunked(framed)
    else:
        assert W.unchunked(framed) == body
        assert W.unchunked(W.chunked(body, 4)) == body


def test_revisit_without_response_and_foreign_records(spark):
    folder = new_folder(spark)
    path = folder.removeprefix("file:") + "/a.warc.gz"
    import os

    os.makedirs(os.path.dirname(path))
    with open(path, "wb") as f:
        for kind, extra, block in (("request", "", b"GET"), ("revisit", "WARC-Payload-Digest: sha1:NONE\r\n", b""),
                                   ("response", "", b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\nplain body")):
            head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <{kind}>\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
            f.write(gzip.compress(head.encode() + block + b"\r\n\r\n"))
    manifest = spark.createDataFrame([(folder + "/a.warc.gz", 3, 3)], W.MANIFEST)
    out = {r.record_type: r for r in W.read(manifest).collect()}
    assert set(out) == {"revisit", "response"} and out["revisit"].status == W.ORPHAN
    assert out["response"].payload == b"plain body" and out["response"].page_id is None
