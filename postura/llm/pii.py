"""Personal data in whole texts, with SQL functions only.

Regular expressions propose spans per kind; checksums and ranges confirm them (Luhn for cards, mod 97 for bank account
numbers, octets for addresses); words near a span raise or lower its score, and a kind may ask for a least score.
Base kinds (email, ip, card, phone) are kept at every score, so the context can only mark them; the added kinds (iban,
ssn) need their checksum or a telling word.

Positions come from the pieces between the matches: a text cut at a pattern and the list of its matches alternate, so
running lengths give starts and ends in code points, in one pass per kind. Every pattern is possessive or bounded
and starts only where a run starts, so time is linear in the text also for very long runs of digits or letters.

Defined cases: null is an empty text; kinds are searched on their own, so spans of two kinds may overlap; a match that fails
its check is dropped without a retry inside it, but for account numbers, which end where their country's length and mod 97 say; repeated rows are reported each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postura.llm.common import column, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
#: Patterns of the kinds. A group repeats possessively, which Java runs without recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",  # the head; _ibans finds the end
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Signs of an account number by country; of other countries every length from 15 to 34 is tried.
IBAN = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for c in countries.split()}
#: A text without this character (class) has no span of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Words near a span that speak for it. Fixed values.
CONTEXT = {
    "email": "mail|e-mail|email|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|telefon",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
#: Words near a span that speak against it. Fixed values.
AGAINST = "order|invoice|version|isbn|example|test|serial|ticket"
#: Score of a confirmed span without context, and the least score of a kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
LEAST = {"email": 0.0, "ip": 0.0, "card": 0.0, "phone": 0.0, "iban": 0.5, "ssn": 0.5}
#: Characters on either side in which context words count.
NEAR = 40
MATCH = "struct<start:int,end:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """Remainder of an account number: four signs go to the end, letters count as 10 to 35, digits in groups of seven."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    signs = F.split(turned, "")
    numbers = F.array_join(F.transform(signs, lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    groups = F.regexp_extract_all(numbers, F.lit("[0-9]{1,7}"), F.lit(0))
    step = lambda rest, g: F.concat(rest.cast("string"), g).cast("long") % 97
    return F.aggregate(groups, F.lit(0).cast("long"), step)


def _confirmed(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)(?:\.|$)){4}$") & ~value.rlike(r"\.$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern in a text that is not null, in order: array of (start, end, value)."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(f"array<{MATCH}>")

    def step(state, pair):
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    # the last gap has no match behind it
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("gap"), values.alias("value"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda s: s["found"])


def _ibans(text: Column) -> Column:
    """Account numbers, in order and apart: from each head on, the longest possible run of signs that mod 97 confirms."""
    known = F.create_map(*[F.lit(x) for pair in IBAN.items() for x in pair])

    def whole(head):
        run = F.regexp_extract(F.substring(text, head["start"] + 1, F.lit(2 * 34)), r"^[A-Z0-9](?:\x20?[A-Z0-9])*+", 0)
        signs = F.regexp_extract_all(run, F.lit(r"\x20?[A-Z0-9]"), F.lit(0))
        length = F.try_element_at(known, F.substring(head["value"], 1, 2))
        lengths = F.when(length.isNotNull(), F.array(length)).otherwise(F.sequence(F.lit(34), F.lit(15), F.lit(-1)))
        values = F.transform(F.filter(lengths, lambda n: n <= F.size(signs)), lambda n: F.array_join(F.slice(signs, 1, n), ""))
        ends = lambda v: ~F.substring(text, head["start"] + F.length(v) + 1, F.lit(1)).rlike("[A-Za-z0-9]")
        value = F.get(F.filter(values, lambda v: ends(v) & (_mod97(v) == 1)), 0)
        return F.struct(head["start"].alias("start"), (head["start"] + F.length(value)).alias("end"), value.alias("value"))

    found = F.filter(F.transform(matches(text, PATTERNS["iban"]), whole), lambda m: m["value"].isNotNull())
    apart = lambda kept, m: F.when(m["start"] < F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0)), kept).otherwise(
        F.concat(kept, F.array(m)))
    return F.aggregate(found, F.array().cast(f"array<{MATCH}>"), apart)


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind, in order, before any check but that of account numbers."""
    possible = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(PATTERNS[kind] if kind == "iban" else "[0-9]")
    found = _ibans(text) if kind == "iban" else matches(text, PATTERNS[kind])
    return F.when(possible, found).otherwise(F.array().cast(f"array<{MATCH}>"))


def _score(text: Column, kind: str, span: Column) -> Column:
    """The prior, raised by a word for it and lowered by a word against it on either side."""
    before = F.substring(text, F.greatest(span["start"] - NEAR, F.lit(0)) + 1, F.least(span["start"], F.lit(NEAR)))
    around = F.concat(before, F.lit(" "), F.substring(text, span["end"] + 1, F.lit(NEAR)))
    pro, con = (around.rlike(rf"(?i)(?<![a-z])(?:{words})(?![a-z])") for words in (CONTEXT[kind], AGAINST))
    score = F.lit(PRIOR[kind]) + F.when(pro, 0.3).otherwise(0.0) - F.when(con, 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array of (kind, start, end, value, score), in order."""
    held = F.filter(_matches(text, kind), lambda m: _confirmed(kind, m["value"]))
    scored = F.transform(held, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                                                  m["value"].alias("value"), _score(text, kind, m).alias("score")))
    return F.filter(scored, lambda m: m["score"] >= LEAST[kind])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = BASE + ADDED) -> DataFrame:
    """Per row: ``doc_id`` and ``spans``, an array by kind as listed, then start."""
    text = column("text")
    found = df.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    found = found.select("doc_id", *[spans_of(text, k).alias(k) for k in kinds])
    return found.select("doc_id", F.concat(*[F.col(k) for k in kinds]).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans per row: what the registered query returns."""
    found = find(df, id_col, text_col)
    spans = F.col("spans")
    counts = [_count(spans, k).alias(f"n_{k}") for k in BASE]
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
