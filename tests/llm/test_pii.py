"""Spans of personal data against a plain left-to-right search."""

import hashlib
import random
import re

from postura.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if holds(kind, m[0])]
    return out


CASES = [None, "", "a@b.co", "x a@b@c.d y", "a@b.c_d@e.f.g.", "é😀 jo.98@mail5.example.com ï", "1.2.3.4.5.6.7.8", "999.1.1.1 0.0.0.0 000255.1.2.3",
         "4539 1488 0343 6467 and 4539-1488-0343-6467, 4539148803436468", "+1 (017) 555-7713 rest", "+1 (((((( x +44 20 7946 0958.",
         "1 2 3 4 5 6 7 8 9 0 1 2 3", "12" * 5000, "1 " * 30000, "a." * 30000 + "@b.c", "a@" + "b." * 20000 + "c", "+" * 500 + "1 23456789",
         "0" * 20 + "1.2.3.4", "a@b..c a@-.- .@a.b", "\n4111111111111111\n", "1.2.3.256 1.2.3", "%@%.com x%@x.y"]


def test_base_spans(spark):
    rng = random.Random(5)
    texts = CASES + ["".join(rng.choice(["1", "23", ".", "-", " ", "+1", "@", "a", "b_", "(", "é", "😀", "4111 1111 1111 1111", "\n"])
                             for _ in range(rng.randint(1, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans int, kind string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        r = got[i]
        base = [s for s in r.spans.split(",") if s and s.split(":")[0] in PLAIN]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert base == [s for s in joined.split(",") if s], t
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in want) for k in PLAIN]


def test_added_kinds_and_context(spark):
    texts = ["pay DE89 3704 0044 0532 0130 00 now", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 01", "ssn 123-45-6789",
             "order 123-45-6789", "phone: +1 (017) 555-7713", "+1 (017) 555-7713"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [[(s.kind, s.value, round(s.score, 2)) for s in r.spans] for r in pii.find(df).orderBy("doc_id").collect()]
    assert got[0] == [("iban", "DE89 3704 0044 0532 0130 00", 0.9)]
    assert got[1] == [("iban", "GB82WEST12345698765432", 0.9)]
    assert not [s for s in got[2] if s[0] == "iban"]
    assert got[3] == [("ssn", "123-45-6789", 0.7)] and got[4] == []
    assert got[5][0][2] > got[6][0][2]
    assert pii.find(df.where("false")).collect() == []
    assert len(pii.digest(df.union(df)).collect()) == 2 * len(texts)


def test_account_numbers_before_capitals_and_digits(spark):
    de, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    tails = [" The bank", ", BIC COBADEFFXXX, ok", " BIC COBADEFFXXX, ok", " I will", " A man", " 2024", " 1 2 3", "", ".", " DE", "\nNext"]
    texts = [(f"é😀 {v}{t}", [v]) for v in (de, spaced, "GB82 WEST 1234 5698 7654 32", "NO9386011117947") for t in tails]
    texts += [(f"{de} {spaced} GB82WEST12345698765432 X", [de, spaced, "GB82WEST12345698765432"]), (f"XY12 3456 7890 1234 {de} A", [de]),
              (f"{de}A", []), (f"{de}b c", []), ("DE89 3704 0044 0532 0130 0", [])]
    # a country without a known length: mod 97 chooses the end
    for check in range(2, 99):
        if int("123456789012ZZ".replace("Z", "35") + f"{check:02}") % 97 == 1:
            texts.append((f"ZZ{check:02} 1234 5678 9012 Then", [f"ZZ{check:02} 1234 5678 9012"]))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    for r in pii.find(df, kinds=("iban",)).collect():
        text, want = texts[r.doc_id]
        assert [s.value for s in r.spans] == want, text
        assert all(text[s.start:s.end] == s.value for s in r.spans)
    assert len(texts) >= 50
