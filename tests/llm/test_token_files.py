"""Token files: exact round trip, damaged frames, and readers that decompress only what is asked for."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from postura.llm import token_files as TF

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    rows = [(rng.randrange(-5, 10 ** 12), " ".join(rng.choice(["Alpha", "beta,", "gamma."]) for _ in range(rng.choice([0, 3, 50, 9000]))))
            for _ in range(150)]
    return rows + [(7, None), (8, ""), (9, "same"), (9, "same"), (None, "x y"), (None, None)]


def want(docs):
    tok = Tokenizer.from_file(PATH)
    rows = [(d, tok.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in docs]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.asarray(r[1], "<u2").tobytes()))
    out, at = [], 0
    for d, ids in rows:
        out.append((d, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("file_text", [1 << 30, 20_000])
def test_round_trip(spark, docs, tmp_path, file_text):
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in docs], "doc_id long, text string, part string, ids int").repartition(3)
    manifest = TF.write(df, str(tmp_path / "t"), PATH, file_text=file_text)
    got = sorted((tuple(r) for r in TF.digest(manifest).collect()), key=lambda r: r[1])
    assert got == want(docs)
    assert (manifest.count() > 3) == (file_text == 20_000)
    asked = [d for d, _ in docs if d][:5] + [9, 12345]
    found = TF.lookup(manifest, spark.createDataFrame([(d,) for d in asked] + [(None,)], "doc_id long")).collect()
    whole = {(r.doc_id, bytes(r.ids)) for r in TF.read(manifest).collect()}
    assert {(r.doc_id, bytes(r.ids)) for r in found} == {w for w in whole if w[0] in asked}
    assert sum(r.doc_id == 9 for r in found) == 2


def test_frames_seek_and_checksum(tmp_path):
    path = str(tmp_path / "one.zst")
    w = TF.Writer(path, 2)
    ids = {d: np.arange(d, d + 40_000, dtype="<u2") for d in range(0, 60, 2)}
    for d, v in ids.items():
        w.add(d, v.tobytes())
    w.close()
    r = TF.Reader(path)
    assert len(r.table) > 5
    assert np.array_equal(r.find(44)[0], ids[44]) and r.decompressed == 1 and r.find(45) == []
    data = open(path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(v.tobytes() for v in ids.values())
    at = int(r.offsets[3]) + 40
    open(path, "wb").write(data[:at] + bytes([data[at] ^ 255]) + data[at + 1:])
    bad = TF.Reader(path)
    assert np.array_equal(bad.find(0)[0], ids[0])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad.frame(3)


def test_empty_table(spark, tmp_path):
    manifest = TF.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), PATH)
    assert manifest.count() == 0 and TF.digest(manifest).collect() == []
