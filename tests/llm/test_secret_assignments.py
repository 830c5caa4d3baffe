"""Secrets in unquoted assignments and query strings, against the values they were made from."""

import hashlib
import random
import string

import pytest

from tracewell.llm import secrets


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.labelled_findings(spark))


def values(n: int, short: bool) -> list[str]:
    rng, plain = random.Random(11), string.ascii_letters + string.digits
    if short:
        return ["".join(rng.choices(plain, k=rng.randint(7, 13))) + str(i % 10) for i in range(n)]
    kinds = [
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([32, 40, 64]))), lambda: "".join(rng.choices(plain, k=rng.randint(20, 44))) + "7",
        lambda: "".join(rng.choices(plain + "+/", k=42)) + "4=", lambda: "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=15)) + "3",
    ]
    return [kinds[i % 4]() for i in range(n)]


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("form", ["we set {n}={v} there", "see https://host.org/a/b?page=2&{n}={v}&x=1 now", "PORT=80\n{n}={v}\nHOST=a\n", "we set {n} = {v} there", 'é {n}="{v}" there'])
def test_assigned_values_are_found_whole(spark, model, form, short):
    names = ["token", "API_KEY", "password", "AWS_S3_V2_SECRET_ACCESS_KEY", "client_secret", "PRODUCTION_DATABASE_SERVICE_PASSWORD"]
    of = values(120, short)
    texts = [form.format(n=names[i // 4 % len(names)], v=v) for i, v in enumerate(of)]
    got = {(r.doc_id, r.start, r.candidate) for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", model).collect()}
    want = {(i, texts[i].index(v), v) for i, v in enumerate(of)}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 3


def test_assigned_values_that_are_no_secrets(spark, model):
    made = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]
    texts = [t for v in made for t in (f"see https://host.org/a?commit={v}&x=1", f"checksum={v}\nnext", f"https://host.org/a?id={v[:8]}-{v[8:12]}-{v[12:16]}-{v[16:20]}-{v[20:32]} b")]
    texts += ["author: 2019-11-26", "token = getToken2(x)", "password=", "a=b==c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert secrets.scan(df, "doc_id", "text", model).count() <= 0.03 * len(texts)


def test_padding_only_ends_a_candidate(spark):
    df = spark.createDataFrame([(0, "x=" + "aB3d" * 6 + "== " + "c4" * 12 + "=" + "d5" * 12)], "doc_id long, text string")
    got = sorted(r.candidate for r in secrets.candidates(df, "doc_id", "text").collect())
    assert got == ["aB3d" * 6 + "==", "c4" * 12, "d5" * 12]
