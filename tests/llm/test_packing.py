"""Packing and its tokenizer memo, held against the tokenizer library and the rules of a packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from postura.llm import packing
from postura.llm.tokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a  b", " a", "a ", "a\n b", "a \nb", "x y z", "<|endoftext|> a", "hé llo's don't", "a\tb c", "日本 語 😀 x",
       "e ́f", "A B", "ſ K İ x", "word, word. Word", "it's, they're", "\n", "Straße café,, x1 2y", "a\x1c b", "a\u2028b c", "\x85 a",
       "shed&&& end.\nHahaed dogs' a'\nb", "x\r\ny \t z", "tail\n", "\nhead", "a\n\nb c\n d", None]


@pytest.mark.parametrize(("path", "lead", "lower"), [(BYTE, " ", False), (WORD, "", True)])
def test_memo_equals_library(path, lead, lower):
    rng = random.Random(1)
    texts = ODD + [" ".join("".join(rng.choice("aeioubcdéß,.'1\n&!|_") for _ in range(rng.randint(1, 9))) for _ in range(40))
                   for _ in range(200)]
    e = Encoder(path, lead, lower)
    want = [x.ids for x in e.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # empty memo, then full memo
        assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == want


def check(rows, want, capacity=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for doc, ids in want.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            part = np.asarray(ids[at:at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    padding = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and all(r.sequence_length == at for r in seq)
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0


def test_every_id_once_and_no_padding(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["alpha", "Beta,", "gamma"]) for _ in range(rng.choice([0, 1, 7, 300, 5000])))
             for i in range(120)} | {900: None, 901: ""}
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts.items()], "doc_id long, text string, start string, id string")
    e = Encoder(BYTE, " ", False)
    want = {i: e.tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    check(packing.pack(df.repartition(3), BYTE).collect(), want)


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), BYTE).collect() == []
    rows = packing.pack(spark.createDataFrame([(1, "a b")] * 3 + [(None, "c")], schema).coalesce(1), BYTE).collect()
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in rows if r.start == 0) == [(-1, 2), (1, 3), (1, 3), (1, 3)]


def test_lowest_cost_first_and_windows():
    ids = {n: bytes(4 * n) for n in (5, 4, 3, 2, 1)}
    bins, left = packing.assign([packing.Piece(n, 0, n, memoryview(b)) for n, b in ids.items()], [8, 7], 1.0, 0.1)
    assert [[p.doc for p in b] for b in bins] == [[5, 2, 1], [4, 3]] and not left
    groups = list(packing.pack_partition([(i, bytes(40)) for i in range(50)], 16, 1.0, 0.1, window=100))
    lengths = [sum(map(len, b)) for g in groups for b in g]
    assert sum(lengths) == 500 and set(lengths[:-1]) == {16} and lengths[-1] == 4
