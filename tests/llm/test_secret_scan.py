"""Secret scan: planted secrets against look-alikes, held-out accuracy, odd input."""

import random
import re

from pyspark.sql import functions as F

from postura.llm import secret_scan as S


def texts(rng, n):
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    key = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    out = []
    for i in range(n):
        words = " ".join(rng.choice(["account", "manager", "user", "internationalisation", "é😀", "counterrevolutionaries"]) for _ in range(12))
        kind = i % 4
        if kind == 0:
            value = rng.choice([hexa(40), "a7" + key(30), "9Q" + key(22)])
            out.append((f'{words} {rng.choice(["token", "api_key", "secret"])} = "{value}" {words}', value))
        elif kind == 1:
            out.append((f"{words} userAccountManagerInternationalisation {words}", None))
        elif kind == 2:
            out.append((f"{words} {'1234567890' * 2}{i} end", None))
        else:
            out.append((words, None))
    return out


def test_found_and_left_alone(spark):
    rng = random.Random(14)
    data = texts(rng, 400)
    rows = [(i, t, "src/a.py", "x") for i, (t, _) in enumerate(data)] + [(None, None, None, "x"), (900, "", None, "x"), (900, "", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, value string").repartition(3)
    got = {(r.doc_id, r.n_secrets, r.secrets) for r in S.report(df).collect()}
    for i, (t, value) in enumerate(data):
        at = t.index(value) if value else 0
        want = (i, 1, f"{at}:{at + len(value)}") if value else (i, 0, "")
        assert want in got
    assert (None, 0, "") in got and (900, 0, "") in got
    assert S.report(df).count() == len(rows)
    counted = {r.doc_id: r.n_candidates for r in S.report(df).collect()}
    for i, (t, _) in enumerate(data):
        assert counted[i] == len(re.findall(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t))


def test_held_out_findings(spark):
    df = spark.createDataFrame([(i, t, "p") for i, (t, _) in enumerate(texts(random.Random(15), 600))], "doc_id long, text string, source string")
    found = S.with_words(S.candidates(df), S.dictionary(df))
    labelled = S.rule_labels(found)
    forest = S.train(labelled.where("id % 3 <> 0"))
    judged = S.score(labelled.where("id % 3 = 0"), forest)
    n, right = judged.agg(F.count("*"), F.sum(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("int"))).first()
    assert n > 100 and right / n > 0.99


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "x " + "a1" * 20, None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in S.report(df).collect()] == [(1, 1, 1, "2:42")]
    assert S.report(df.where("false")).collect() == []


def test_short_and_key_value_forms(spark):
    rng = random.Random(16)
    run = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k - 2)) + "a7"
    forms = ['password: "{}"', "api_key={}", "GITHUB_TOKEN={}", '{{"secret": "{}"}}', "passwd = '{}'", "SERVICE_WITH_LONG_NAME_SECRET={}"]
    planted = [(forms[i % 6], ["hunter2xyz99", "x7", run(8), run(16), "ghp_" + run(36), "AKIA" + run(16), run(42) + "=="][i % 7]) for i in range(210)]
    rows = [(i, "some words é😀 " + form.format(value) + " and more words") for i, (form, value) in enumerate(planted)]
    look = ["keep it secret: nobody knows", "userAccountManagerInternationalisation here", "12345678901234567890 end", "password is long"]
    rows += [(1000 + i, look[i % 4]) for i in range(120)]
    df = spark.createDataFrame([(i, t, "src") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r for r in S.report(df).collect()}
    for i, (_, value) in enumerate(planted):
        at = rows[i][1].rindex(value)
        assert got[i].secrets == f"{at}:{at + len(value)}", rows[i][1]
    assert not any(got[i].n_secrets for i in range(1000, 1120))
    found = {r.value: r for r in S.candidates(df).collect()}
    assert all(found[v].named == found[v].assigned == 1 for _, v in planted)


def test_digests_and_uuids_are_learnt(spark):
    rng = random.Random(17)
    hexa = lambda k: "a7" + "".join(rng.choice("0123456789abcdef") for _ in range(k - 2))
    uuid = lambda: "-".join(hexa(k) for k in (8, 4, 4, 4, 12))
    forms = [lambda: (f'token = "{hexa(40)}"', 1), lambda: (f"api_key={hexa(32)}", 1), lambda: (f"sha256: {hexa(64)}", 0),
             lambda: (f"commit {hexa(40)} merged", 0), lambda: (f"see {uuid()} there", 0), lambda: (f"in src/module2/handlers3/main/index{rng.randint(1, 99)} now", 0)]
    data = [forms[i % 6]() for i in range(360)]
    df = spark.createDataFrame([(i, f"some words {t} and more", "p") for i, (t, _) in enumerate(data)], "doc_id long, text string, source string")
    found = S.with_words(S.candidates(df), S.dictionary(df))
    labelled = S.rule_labels(found)
    assert labelled.where("label = 0 AND mixed").count() >= 200
    # the forest learns from other rows than it is asked about
    forest = S.train(labelled.where("id % 12 < 6"))
    judged = {r.id: r.score >= S.THRESHOLD for r in S.score(found.where("id % 12 >= 6"), forest).collect()}
    assert len(judged) == 180 and all(judged[i] == bool(data[i][1]) for i in judged)
