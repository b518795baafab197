"""How many planted secrets the Markov models find, and how many ordinary names they take for one."""

import base64
import random
import string
import uuid

import pytest
from pyspark.sql import functions as F

from tallowick.llm import secret_scan

# None of these is among the words that the models are trained on.
OTHER = "river planet guitar window orange session token password mountain velvet thunder cabinet horizon puzzle whisper lantern meadow falcon copper winter summer castle bridge garden silver marble rocket pepper basket velocity gravity spectrum molecule quantum boundary threshold variance matrix vector tensor gradient recursion iterator socket daemon mutex semaphore checksum keyring vault rotation".split()


def planted():
    rng = random.Random(77)
    words = lambda n: [rng.choice(OTHER) for _ in range(n)]
    drawn = lambda alphabet, low, high: "".join(rng.choice(alphabet) for _ in range(rng.randrange(low, high)))
    both, day = string.ascii_letters + string.digits, lambda: f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
    kinds = {
        "hex": lambda: drawn("0123456789abcdef", 20, 32), "upper hex": lambda: drawn("0123456789ABCDEF", 20, 41), "base64": lambda: base64.b64encode(rng.randbytes(rng.randrange(15, 40))).decode(),
        "url base64": lambda: base64.urlsafe_b64encode(rng.randbytes(24)).decode(), "alnum": lambda: drawn(both, 20, 41), "small alnum": lambda: drawn(string.ascii_lowercase + string.digits, 20, 41), "capital alnum": lambda: drawn(string.ascii_uppercase + string.digits, 20, 41),
    }
    names = {
        "constant": lambda: "_".join(words(3)).upper(), "snake": lambda: "_".join(words(3)), "camel": lambda: (lambda w: w[0] + "".join(x.title() for x in w[1:]))(words(3)), "pascal": lambda: "".join(x.title() for x in words(3)),
        "dated slug": lambda: day() + "-" + "-".join(words(3)), "slug": lambda: "-".join(words(4)) + f"-{rng.randrange(999)}", "path": lambda: "/".join(words(4)), "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))), "number": lambda: drawn(string.digits, 16, 30),
        "text in base64": lambda: base64.b64encode(" ".join(words(4)).encode()).decode(),
    }
    long = lambda make: next(x for x in iter(make, None) if len(x) >= secret_scan.LEAST)
    return [(k, s, long(make)) for s, group in ((1, kinds), (0, names)) for k, make in group.items() for _ in range(100)]


@pytest.fixture(scope="module")
def rates(spark):
    rng = random.Random(78)
    prose = [" ".join(rng.choice(["the", "of", "and"]) + rng.choice([" hation", " erening", " Thonre", " ouauil", " enarion"]) + rng.choice(["tio", "ere", "inda", "esh"]) for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(len(prose))], "doc_id long, quality int")
    cases = planted()
    texts = spark.createDataFrame([(i, f"see {t} here") for i, (_, _, t) in enumerate(cases)], "doc_id long, text string")
    # What the patterns find is no work of the models.
    hits = {r.id for r in secret_scan.scan(texts, secret_scan.labelled_samples(docs, labels)).filter(F.size("spans") > 0).collect()}
    out = {}
    for i, (kind, secret, _) in enumerate(cases):
        out.setdefault((secret, kind), []).append(i in hits)
    return {k: sum(v) for k, v in out.items()}


def test_planted_secrets_are_found(rates):
    assert all(n >= 95 for (secret, _), n in rates.items() if secret), rates


def test_ordinary_names_are_left_alone(rates):
    assert all(n <= 2 for (secret, _), n in rates.items() if not secret), rates
