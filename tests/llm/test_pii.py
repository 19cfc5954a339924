"""Surrogates against a slow version in plain Python, and what they must keep apart and together."""

import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from logframe.llm import pii
from tests.llm.conftest import clashing

SCRIPTS = [("Cyrillic", "cyrillic"), ("Greek", "greek")]
TITLES = f"{pii.MALE_TITLES}|{pii.FEMALE_TITLES}|{pii.OTHER_TITLES}"


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def number(*parts):
    return int(sha(*parts)[:15], 16)


def script(word):
    return next((name for p, name in SCRIPTS if regex.search(rf"\p{{{p}}}", word)), "latin")


def slow_digits(text, *salt):
    def turned(part, *key):
        if len(part) < 2:
            return str((int(part) + number(*key)) % 10) if part else ""
        a, b = part[: len(part) // 2], part[len(part) // 2 :]
        for i in range(1, pii.ROUNDS + 1):
            a, b = b, str((int(a) + number(*key, i, b) % 10**10) % 10 ** len(a)).zfill(len(a))
        return a + b

    return turned(text[:18], *salt) + turned(text[18:], *salt, text[:18])


def slow_word(stem, syllables):
    h, letters = sha(pii.KEY, "word", stem), pii.LETTERS[script(stem)]
    at = [int(h[4 * i : 4 * i + 4], 16) % 80 for i in range(syllables)]
    return "".join(letters[k // 5] + letters[16 + k % 5] for k in at)


def luhn(digits):
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country, rest):
    return 98 - int("".join(str(int(c, 36)) for c in regex.sub("[^A-Z0-9]", "", rest + country + "00"))) % 97


def slow_surrogate(e, syllables):
    """Of an e-mail address, a number or an address of the Internet: all that the tables hold."""
    fill = lambda shape, digits, it=None: "".join(next(it) if c.isdigit() else c for it in [iter(digits)] for c in shape)
    if "@" in e:
        local, top = e.rsplit(".", 1)
        piece = lambda m: slow_word(m[0].lower(), syllables) if m[0][0].isalpha() else slow_digits(m[0], pii.KEY, "email")

        def cased(m):
            word = piece(m)
            return word.upper() if regex.fullmatch(r"\p{Lu}{2,}", m[0]) else word.capitalize() if m[0][0].isupper() else word

        return regex.sub(r"\p{L}[\p{L}\p{M}]*|[0-9]+", cased, local) + "." + top
    if regex.fullmatch(r"(?:[0-9]+\.){3}[0-9]+", e):
        p = [int(x) for x in e.split(".")]
        a, b = p[0] * 256 + p[1], p[2] * 256 + p[3]
        for i in range(1, pii.ROUNDS + 1):
            a, b = b, a ^ (number(pii.KEY, "ip", i, b) % 65536)
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    digits = regex.sub("[^0-9]", "", e)
    if regex.match("[A-Z]{2}[0-9]{2}", e):
        new = fill(e[4:], slow_digits(regex.sub("[^0-9]", "", e[4:]), pii.KEY, "iban"))
        check = (iban_check(e[:2], new) + int(e[2:4]) - iban_check(e[:2], e[4:])) % 100
        return f"{e[:2]}{check:02}{new}"
    if regex.match("[0-9]{3}-[0-9]{2}-", e):
        return fill(e, slow_digits(digits, pii.KEY, "ssn"))
    if e[0].isdigit() and len(digits) >= 15:
        body = slow_digits(digits[:-1], pii.KEY, "card")
        return fill(e, body + str((luhn(body) + int(digits[-1]) - luhn(digits[:-1])) % 10))
    prefix = regex.match(f"(?:{pii.COUNTRY_CODE})?", e)[0]
    return prefix + fill(e[len(prefix) :], slow_digits(regex.sub("[^0-9]", "", e[len(prefix) :]), pii.KEY, "phone"))


def test_documents_by_a_slow_version(spark, documents):
    got = pii.surrogates(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(got) == len(texts)
    syllables = pii.enough_syllables(pii.distinct_words(documents))
    pattern, seen = regex.compile(pii.ENTITY), 0
    for r in got:
        found = [m[0] for m in pattern.finditer(texts[r.doc_id] or "")]
        seen += len(found)
        assert r.n_entities == len(found)
        assert r.text == pattern.sub(lambda m: slow_surrogate(m[0], syllables), texts[r.doc_id])
    assert seen > 20


def replaced(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace_entities(df, **more).orderBy("doc_id").collect()]


def test_one_surname_one_surrogate(spark):
    rng = random.Random(5)
    made = {"".join(rng.choice("bdfgklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))).capitalize() + rng.choice("xqw") for _ in range(9000)}
    surnames = sorted(made)[:8000]
    given = [f"Gy{c}" for c in "abcdefgh"]
    texts = [f"Mr. {s}" for s in surnames] + [f"Mr. {given[i % 8]} {s}" for i, s in enumerate(surnames)]
    got = replaced(spark, texts)
    alone, whole = [t.split()[-1] for t in got[: len(surnames)]], [t.split() for t in got[len(surnames) :]]
    assert [w[-1] for w in whole] == alone  # one surrogate for a surname
    assert len(set(alone)) == len(surnames) and not set(alone) & set(surnames)  # none is shared, none is real
    assert len({w[1] for w in whole}) == 8 and all(w[1].endswith("n") for w in whole)


def test_forms(spark):
    texts = [
        "Mr. John Smith met Mrs Smith (john.smith42@mail2.example.com).", "Dr. Anna Maria Weber, Mr Jean-Luc Picard", "Mr. O'Brien's dog saw Jean Picard", "Господин Иванов и Госпожа Иванова",
        "Κύριος Παπαδόπουλος, Kyrios Παπαδόπουλος", "Herr von der Leyen", "+4915112345678 +49 151 12345 678", "John Smith", "иван.петров@почта.рф", "Mr. J. R. Smith", "It was fine. May I?", "Frau Dr. Weber",
    ]
    got = replaced(spark, texts)
    words = [regex.findall(r"\p{L}+", t) for t in got]
    assert words[0][2] == words[0][5] == words[7][1] == words[9][3] and words[0][7] == words[0][2].lower()  # Smith everywhere
    assert got[0].startswith("Mr. ") and got[0].endswith(".com).") and words[0][1].endswith("n")
    assert words[1][1].endswith("na") and words[1][2].endswith("na") and words[1][3] == words[11][2] and words[1][5].endswith("n") and "-" in got[1]
    assert words[1][7] == words[2][-1] and got[2].startswith("Mr. O'") and "'s dog saw" in got[2]
    assert words[3][1] + "а" == words[3][4] and script(words[3][1]) == "cyrillic"
    assert words[4][1] == words[4][3] and script(words[4][1]) == "greek"
    assert got[5].startswith("Herr von der ") and "Leyen" not in got[5]
    assert got[6].split()[0].startswith("+49") and got[6].split(" ", 1)[1].replace(" ", "") == got[6].split()[0]
    assert script(got[8]) == "cyrillic" and got[8].endswith(".рф") and got[9].startswith("Mr. J. R. ")
    assert got[10] == texts[10]


def test_numbers(spark):
    cards, ibans = ["4111 1111 1111 1111", "4111111111111111", "378282246310005"], ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "FR1420041010050500013M02606"]
    got = replaced(spark, [*cards, *ibans, "AT10 THAT WITH FROM THIS", "10.0.0.1 999.1.1.1", "123-45-6789 (555) 555-0100"])
    assert got[0].replace(" ", "") == got[1] and all(luhn(g[:-1]) == int(g[-1]) for g in (got[1], got[2])) and [len(g) for g in got[:3]] == [19, 16, 15]
    assert got[3].replace(" ", "") == got[4] and all(iban_check(g[:2], g[4:]) == int(g[2:4]) for g in (got[4], got[5])) and "M" in got[5]
    assert got[6] == "AT10 THAT WITH FROM THIS" and got[7].endswith(" 999.1.1.1") and not got[7].startswith("10.")
    assert regex.fullmatch(r"\d{3}-\d\d-\d{4} \(\d{3}\) \d{3}-\d{4}", got[8])


@pytest.mark.parametrize("n", [1, 2, 3])
def test_digits_are_permuted(spark, n):
    rows = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
    got = {r[0] for r in rows.select(pii.permuted_digits(F.col("d"), F.lit("k"))).collect()}
    assert len(got) == 10**n and all(len(g) == n for g in got)


def test_syllables_grow_until_nothing_collides(spark, monkeypatch):
    words = spark.range(3000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("stem"))
    assert pii.enough_syllables(words) == 5
    monkeypatch.setattr(pii, "SLACK", 1e-9)
    grown = pii.enough_syllables(words)
    made = words.select(pii.syllable_word(F.col("stem"), grown).alias("m"))
    assert grown >= 4 and made.distinct().count() == 3000
    assert pii.enough_syllables(words.limit(0)) == pii.LEAST
    taken = made.withColumnRenamed("m", "stem").limit(1).union(words)
    assert pii.enough_syllables(taken) > grown - 1


def test_awkward_tables(spark, odd, empty):
    marks = "abc x@y.org a"
    got = replaced(spark, [marks, None, "", "x@y.org " * 3])
    assert got[0].startswith("abc ") and got[0].endswith(".org a") and got[1:3] == [None, ""] and len(set(got[3].split())) == 1
    for df in (odd, clashing(odd), odd.withColumn("__done0", F.lit(1)).withColumn("n_entities", F.lit("own"))):
        out = pii.replace_entities(df)
        assert [c for c in df.columns if c != "n_entities"] == out.columns[:-1] and out.columns[-1] == "n_entities"
        assert sorted(map(str, out.select("text").collect())) == sorted(map(str, df.select("text").collect()))
    assert pii.surrogates(empty).collect() == []
    again = replaced(spark, ["Mr. Smith a@b.org"], key="other", syllables=4)
    assert again == replaced(spark, ["Mr. Smith a@b.org"], key="other", syllables=4) != replaced(spark, ["Mr. Smith a@b.org"], syllables=4)
