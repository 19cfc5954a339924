"""PII surrogates. DataFrame functions only.

Detected entities (e-mail addresses, phone, card, bank and social security numbers, IPv4
addresses, and names after a title or beginning with a common given name) are replaced by
keyed surrogates of the same type:

* numbers keep their separators, length and country code. Their digits go through a keyed
  Feistel permutation of all digit strings of that length, so different numbers stay
  different. A card number keeps whether its check digit is right, a bank number too, and
  its letters;
* IPv4 addresses go through a permutation of the 32-bit numbers;
* words, in names and in e-mail addresses, become keyed syllable words of their script
  (Latin, Cyrillic, Greek), the same everywhere: ``Smith`` in ``Mr. Smith``, in ``Anna
  Smith`` and in ``smith@example.com`` is one word. Hyphens, apostrophes, initials,
  particles and titles stay. A given name ends as the gender of its title (or of the name
  itself) asks; a Cyrillic surname keeps its gender form and shares its stem with the other;
* e-mail addresses keep their separators and top level; their digits are permuted.

Distinctness: permutations cannot collide. Words are drawn from ``syllables`` syllables;
how many follows from the number of distinct words of the corpus, and a check over all of
them adds syllables until no two words share a surrogate and no surrogate is a word of
the corpus. So no text is joined with anything, and no single word is ever keyed apart.
Words that differ in case only are one word. A permuted number may be another's number.

Not found: names without title whose given name is not listed, scripts without capitals,
more than four words of a name, numbers in other formats than those of ``PATTERNS`` (of
phones: without a leading + or brackets only the form 555-123-4567), domains of more than
127 labels as a whole. Texts and tokens may have any length.

A null text stays null. Empty texts, and texts without entities, stay as they are.
Repeated rows give repeated results; an empty table gives an empty result; other columns
are kept and may have any name but ``n_entities``, which is replaced.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logframe.llm.common import durable, let

KEY = "logframe"
ROUNDS = 8
#: Syllables of a surrogate word, at least and at most; SLACK times the squared number of words must fit.
LEAST, MOST, SLACK = 3, 16, 64
# fixed values: titles, common given names, particles, letters of the syllables, endings by script
MALE_TITLES = "Mr|Sir|Lord|Herr|Señor|Monsieur|Signor|Господин|Κύριος|Κύριε|Kyrios"
FEMALE_TITLES = "Mrs|Ms|Miss|Madam|Lady|Frau|Fräulein|Señora|Señorita|Madame|Mademoiselle|Signora|Госпожа|Κυρία|Kyria"
OTHER_TITLES = "Dr|Prof|Professor|Доктор|Профессор|Δρ|Καθηγητής"
MALE_NAMES = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Christopher|Daniel|Matthew|Anthony|Steven|Paul|Andrew|Kevin|Brian|George|Peter|Hans|Klaus|Jürgen|Wolfgang"
    "|Stefan|Jean|Pierre|Michel|François|Philippe|José|Juan|Carlos|Luis|Miguel|Antonio|Иван|Сергей|Александр|Дмитрий|Андрей|Николай|Γιώργος|Νίκος|Δημήτρης"
)
FEMALE_NAMES = (
    "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Margaret|Lisa|Emily|Michelle|Laura|Anna|Julia|Maria|María|Ursula|Monika|Petra|Sabine|Claudia|Marie"
    "|Sophie|Isabelle|Nathalie|Catherine|Carmen|Ana|Lucía|Isabel|Анна|Мария|Елена|Ольга|Наталья|Татьяна|Ελένη|Κατερίνα"
)
PARTICLES = "van|von|der|den|de|del|della|di|da|la|le|du|dos|bin|ibn|al|el|ter|ten|zu|zur"
#: Sixteen consonants and five vowels.
LETTERS = {"cyrillic": "бвгджзклмнпрстфхаеиоу", "greek": "βγδζθκλμνξπρστφχαειου", "latin": "bdfghjklmnprstvzaeiou"}
ENDINGS = {"cyrillic": {"male": "н", "female": "на", "other": "ль"}, "greek": {"male": "ς", "female": "να", "other": "ν"}, "latin": {"male": "n", "female": "na", "other": "l"}}
COUNTRY_CODE = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# A group that is repeated is possessive or bounded (a domain has 127 labels at most): one that may give back is walked
# by recursion, and a long text would overflow the stack.
_CAPITAL = r"\p{Lu}[\p{L}\p{M}]*+(?:['’\-]\p{L}[\p{L}\p{M}]*+)*+"
_NEXT = rf"(?:\p{{Lu}}\. ?){{0,2}}(?:(?:{PARTICLES}) ){{0,3}}{_CAPITAL}"
_BEFORE = r"(?<![\p{L}\p{M}\p{N}'’\-])(?=\p{Lu})"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++){0,126}\.\p{L}{2,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:[A-Z ]*[0-9]){10})(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{4}(?:[0-9]{12}|(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})|3[47][0-9]{2}(?:[0-9]{11}| [0-9]{6} [0-9]{5}|-[0-9]{6}-[0-9]{5}))(?![A-Za-z0-9])",
    "phone": r"(?:(?<![A-Za-z0-9])\+[0-9]{1,3}[ .\-]?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])|(?<![A-Za-z0-9])\+[0-9]{1,3}(?:[ .\-][0-9]{2,8}){2,4}(?![0-9])"
    r"|(?<![A-Za-z0-9])\+[0-9]{7,15}(?![0-9])|(?<![A-Za-z0-9+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![A-Za-z0-9\-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9\-]))",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "name": rf"{_BEFORE}(?:(?:(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.? ){{1,9}}{_NEXT}(?: {_NEXT}){{0,3}}|(?:{MALE_NAMES}|{FEMALE_NAMES})(?: {_NEXT}){{1,3}})",
}
# end of fixed values
#: Every pattern begins at a letter, digit or sign behind none of letters and digits; told once, other places cost little.
ENTITY = r"(?<![\p{L}\p{M}\p{N}])(?=[\p{L}\p{N}._%+\-(])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Private characters around entities; those of a text are spelled with the third while entities are marked.
OPEN, CLOSE, SPELL = "\ue000", "\ue001", "\ue002"


def kind_of(entity: Column) -> Column:
    """The type of a detected entity, by what tells the patterns apart."""
    digits = F.length(F.regexp_replace(entity, "[^0-9]", ""))
    return (
        F.when(entity.contains("@"), "email").when(entity.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban").when(entity.rlike(r"^\p{L}"), "name")
        .when(entity.rlike(r"^(?:[0-9]+\.){3}[0-9]+$"), "ip").when(entity.rlike("^[0-9]{3}-[0-9]{2}-"), "ssn")
        .when(entity.rlike("^[0-9]") & (digits >= 15), "card").otherwise("phone")
    )


def _number(seed: Column) -> Column:
    """A number of 60 bits from the hash of ``seed``."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long")


def permuted_digits(digits: Column, salt: Column) -> Column:
    """A keyed permutation of the digit strings of the length of ``digits``.

    Up to 18 digits go through Feistel rounds over two halves; those behind them, keyed by the first 18, through rounds of their own.
    """

    def turn(state: Column, i: Column, key: Column) -> Column:
        size = F.length(state["a"])
        total = F.concat(F.lit("0"), state["a"]).cast("long") + _number(F.concat_ws("|", key, i.cast("string"), state["b"])) % F.lit(10**10)
        made = F.right(F.lpad(total.cast("string"), 20, "0"), size)
        return F.struct(state["b"].alias("a"), F.when(size > 0, made).otherwise("").alias("b"))

    def whole(part: Column) -> Column:
        text, key = part["text"], part["key"]
        half = F.floor(F.length(text) / 2).cast("int")
        start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b"))
        done = lambda s: F.concat(s["a"], s["b"])
        rounds = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, i: turn(s, i, key), done)
        one = ((F.concat(F.lit("0"), text).cast("int") + _number(key)) % 10).cast("string")
        return F.when(F.length(text) > 1, rounds).when(F.length(text) == 1, one).otherwise("")

    head, tail = F.substring(digits, 1, 18), F.substr(digits, F.lit(19))
    part = lambda text, key: F.struct(text.alias("text"), key.alias("key"))
    return F.array_join(F.transform(F.array(part(head, salt), part(tail, F.concat_ws("|", salt, head))), whole), "")


def _luhn(digits: Column) -> Column:
    """The check digit that belongs behind ``digits``."""
    chars = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(chars, lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: x - F.when(x > 9, 9).otherwise(0)))
    return (10 - F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10) % 10


def _iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of a bank number, as a number from 2 to 98."""
    chars = F.regexp_extract_all(F.concat(rest, country, F.lit("00")), F.lit("[A-Z0-9]"), F.lit(0))
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return 98 - F.aggregate(chars, F.lit(0), lambda s, c: (s * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97)


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""

    def put(state: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        out = F.concat(state["out"], F.when(is_digit, F.substr(digits, state["k"] + 1, F.lit(1))).otherwise(c))
        return F.struct(out.alias("out"), (state["k"] + is_digit.cast("int")).alias("k"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    return F.aggregate(F.regexp_extract_all(shape, F.lit("(?s)."), F.lit(0)), start, put, lambda s: s["out"])


def _like_number(entity: Column, kind: Column, key: str) -> Column:
    """Cards, bank, phone and social security numbers."""
    prefix = F.when(kind == "iban", F.substring(entity, 1, 4)).when(kind == "phone", F.regexp_extract(entity, f"^{COUNTRY_CODE}", 0)).otherwise("")

    def made(x: Column) -> Column:
        body = F.when(kind == "card", F.substr(x["digits"], F.lit(1), F.length(x["digits"]) - 1)).otherwise(x["digits"])
        new = permuted_digits(body, F.concat_ws("|", F.lit(key), kind))
        last = F.right(x["digits"], F.lit(1)).cast("int")
        checked = let(F.struct(body.alias("old"), new.alias("new")), lambda b: F.concat(b["new"], F.when(kind == "card", ((_luhn(b["new"]) + last - _luhn(b["old"]) + 10) % 10).cast("string")).otherwise("")))
        filled = refill(x["rest"], checked)

        def banked(f: Column) -> Column:
            country, check = F.substring(x["prefix"], 1, 2), F.substring(x["prefix"], 3, 2).cast("int")
            return F.concat(country, F.lpad(((_iban_check(country, f) + check - _iban_check(country, x["rest"]) + 100) % 100).cast("string"), 2, "0"), f)

        return F.when(kind == "iban", let(filled, banked)).otherwise(F.concat(x["prefix"], filled))

    rest = lambda p: F.substr(entity, F.length(p) + 1)
    split = let(prefix, lambda p: F.struct(p.alias("prefix"), rest(p).alias("rest"), F.regexp_replace(rest(p), "[^0-9]", "").alias("digits")))
    return let(split, made)


def _like_ip(entity: Column, key: str) -> Column:
    def turn(state: Column, i: Column) -> Column:
        mask = _number(F.concat_ws("|", F.lit(key), F.lit("ip"), i.cast("string"), state["b"].cast("string"))) % 65536
        return F.struct(state["b"].alias("a"), state["a"].bitwiseXOR(mask).alias("b"))

    parts = F.transform(F.regexp_extract_all(entity, F.lit("[0-9]+"), F.lit(0)), lambda p: p.cast("long"))
    start = let(parts, lambda p: F.struct((p[0] * 256 + p[1]).alias("a"), (p[2] * 256 + p[3]).alias("b")))
    octets = lambda s: F.concat_ws(".", *[x.cast("string") for h in "ab" for x in (F.shiftright(s[h], 8), s[h].bitwiseAND(255))])
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, octets)


def _script(word: Column, values: dict) -> Column:
    """The value of the word's script; Latin for any other."""
    return F.when(word.rlike(r"\p{IsCyrillic}"), values["cyrillic"]).when(word.rlike(r"\p{IsGreek}"), values["greek"]).otherwise(values["latin"])


def syllable_word(stem: Column, syllables: int, key: str = KEY) -> Column:
    """The keyed word of a stem, in the stem's script."""

    def made(x: Column) -> Column:
        at = lambda i: F.conv(F.substr(x["hash"], i * 4 - 3, F.lit(4)), 16, 10).cast("int") % 80
        two = lambda k: F.concat(F.substr(x["letters"], F.floor(k / 5).cast("int") + 1, F.lit(1)), F.substr(x["letters"], k % 5 + 17, F.lit(1)))
        return F.array_join(F.transform(F.transform(F.sequence(F.lit(1), F.lit(syllables)), at), two), "")

    return let(F.struct(F.sha2(F.concat_ws("|", F.lit(key), F.lit("word"), stem), 256).alias("hash"), _script(stem, LETTERS).alias("letters")), made)


_FEMININE = r"(?:[оеё]в|[иы]н)а$"
_MASCULINE = r"(?:[оеё]в|[иы]н)$"


def _stem(p: Column) -> Column:
    """What a word is keyed by: lower case; a Cyrillic surname's masculine form."""
    low = F.lower(p["text"])
    return F.when((p["role"] == "surname") & low.rlike(_FEMININE), F.substr(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def pieces(entity: Column, kind: Column) -> Column:
    """array<struct<text, role>> that make up a name or e-mail address: role given, surname, address, digits or none."""
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"\p{L}[\p{L}\p{M}]*+|[0-9]++|[^\p{L}0-9]++"), F.lit(0))
    piece = lambda text, role: F.struct(text.alias("text"), role.alias("role"))
    none = F.lit("none")

    def named(role: str):
        # initials, particles and the letter before an apostrophe stay
        return lambda t: piece(t, F.when(t.rlike(r"^\p{Lu}\p{L}"), F.lit(role)).otherwise(none))

    addressed = lambda t: piece(t, F.when(t.rlike(r"^\p{L}"), F.lit("address")).when(t.rlike("^[0-9]"), F.lit("digits")).otherwise(none))
    title = F.regexp_extract(entity, rf"^(?:(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.? ){{0,9}}", 0)
    top = F.regexp_extract(entity, r"\.\p{L}+$", 0)
    name = let(title, lambda t: let(F.regexp_extract(F.substr(entity, F.length(t) + 1), "^(?:.* )?", 0), lambda given: F.concat(
        F.array(piece(t, none)), F.transform(runs(given), named("given")),
        F.transform(runs(F.substr(entity, F.length(t) + F.length(given) + 1)), named("surname")))))
    email = let(top, lambda t: F.concat(F.transform(runs(F.substr(entity, F.lit(1), F.length(entity) - F.length(t))), addressed), F.array(piece(t, none))))
    return F.when(kind == "email", email).when(kind == "name", name).otherwise(F.array().cast("array<struct<text:string,role:string>>"))


def _gender(entity: Column) -> Column:
    title = lambda titles: rf"^(?:(?:{OTHER_TITLES})\.? )?(?:{titles})\b"
    given = lambda names: rf"^(?:(?:{OTHER_TITLES})\.? ){{0,9}}(?:{names}) "
    return F.when(entity.rlike(title(MALE_TITLES)) | entity.rlike(given(MALE_NAMES)), "male").when(entity.rlike(title(FEMALE_TITLES)) | entity.rlike(given(FEMALE_NAMES)), "female").otherwise("other")


def _like_words(entity: Column, kind: Column, syllables: int, key: str) -> Column:
    def made(gender: Column) -> Column:
        endings = lambda word: _script(word, {s: F.when(gender == "male", e["male"]).when(gender == "female", e["female"]).otherwise(e["other"]) for s, e in ENDINGS.items()})

        def shaped(p: Column) -> Column:
            low = F.lower(p["text"])
            form = F.when(p["role"] == "given", endings(low)).when((p["role"] == "surname") & low.rlike(_FEMININE), "ва").when((p["role"] == "surname") & low.rlike(_MASCULINE), "в").otherwise("")
            word = F.concat(syllable_word(_stem(p), syllables, key), form)
            cased = F.when(p["text"].rlike(r"^\p{Lu}{2,}$"), F.upper(word)).when(p["text"].rlike(r"^\p{Lu}"), F.initcap(word)).otherwise(word)
            return F.when(p["role"] == "none", p["text"]).when(p["role"] == "digits", permuted_digits(p["text"], F.lit(f"{key}|email"))).otherwise(cased)

        return F.array_join(F.transform(pieces(entity, kind), shaped), "")

    return let(_gender(entity), made)


def surrogate(entity: Column, syllables: int, key: str = KEY) -> Column:
    """The replacement of an entity; null for a would-be bank number that is none."""
    plain_iban = entity.rlike("^[A-Z]{2}[0-9]{2}(?:[A-Z]{4})?[0-9]{10,24}$")
    rest = F.substr(entity, F.lit(5))
    real_iban = plain_iban | (_iban_check(F.substring(entity, 1, 2), rest) == F.substring(entity, 3, 2).cast("int"))
    return let(kind_of(entity), lambda kind: F.when(kind.isin("email", "name"), _like_words(entity, kind, syllables, key)).when(kind == "ip", _like_ip(entity, key))
               .when(kind != "iban", _like_number(entity, kind, key)).when(real_iban, _like_number(entity, kind, key)))


def _by_pattern(text: Column, apply) -> Column:
    """``apply`` of the whole pattern, or of that of names where a text has no digit and no at sign: then nothing else is found."""
    return F.when(text.rlike("[0-9@]"), apply(ENTITY)).otherwise(apply(PATTERNS["name"]))


def entities_of(text: Column) -> Column:
    """Detected entities in order."""
    return _by_pattern(text, lambda p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)))


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(stem), each once: the words that names and e-mail addresses of the corpus are made of."""
    worded = F.filter(entities_of(F.col(text)), lambda e: e.rlike(r"@|^\p{L}") & ~e.rlike("^[A-Z]{2}[0-9]{2}"))
    entities = docs.select(F.explode(F.array_distinct(worded)).alias("entity"))
    stems = entities.select(F.explode(pieces(F.col("entity"), kind_of(F.col("entity")))).alias("p")).filter("p.role not in ('none', 'digits')")
    return stems.select(_stem(F.col("p")).alias("stem")).distinct()


def enough_syllables(words: DataFrame, key: str = KEY) -> int:
    """The number of syllables at which the surrogates of all words differ from each other and from every word."""
    words = durable(words)
    n = words.count()
    syllables = next((s for s in range(LEAST, MOST) if 80**s >= SLACK * n * n), MOST)
    while syllables < MOST and n:
        made = words.select(syllable_word(F.col("stem"), syllables, key).alias("made"))
        shared = made.groupBy("made").count().filter("count > 1")
        if shared.isEmpty() and made.join(words, F.col("made") == F.col("stem"), "left_semi").isEmpty():
            break
        syllables += 1
    return syllables


def replace_entities(docs: DataFrame, key: str = KEY, text: str = "text", syllables: int | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``; a column of that name is replaced.

    Give ``syllables`` to use the words of an earlier run; else they follow from the corpus.
    Texts are read twice, once for the words and once to be rewritten where they are.
    """
    docs = docs.drop("n_entities")
    syllables = syllables or enough_syllables(distinct_words(docs, text), key)
    c, codes = F.col(text), [(SPELL, f"{SPELL}a"), (OPEN, f"{SPELL}b"), (CLOSE, f"{SPELL}c")]

    def spelled(t: Column, pairs: list[tuple[str, str]]) -> Column:
        for old, new in pairs:
            t = F.replace(t, F.lit(old), F.lit(new))
        return t

    def woven(m: Column) -> Column:
        # every second part is an entity
        entry = lambda p, made: let(made, lambda s: F.struct(F.coalesce(s, p).alias("text"), s.isNotNull().cast("int").alias("n")))
        parts = F.transform(F.split(m, f"[{OPEN}{CLOSE}]", -1), lambda p, i: entry(p, F.when(i % 2 == 1, surrogate(p, syllables, key))))
        return let(parts, lambda b: done(F.array_join(F.transform(b, lambda x: x["text"]), ""), F.aggregate(b, F.lit(0), lambda s, x: s + x["n"])))

    done = lambda out, n: F.struct(out.alias("text"), n.cast("long").alias("n"))
    odd = c.rlike(f"[{OPEN}-{SPELL}]")
    marked = let(F.when(odd, spelled(c, codes)).otherwise(c), lambda t: _by_pattern(t, lambda p: F.regexp_replace(t, p, f"{OPEN}$0{CLOSE}")))
    made = let(marked, lambda m: F.when(m.contains(OPEN), woven(m)).otherwise(done(m, F.lit(0))))
    own = next(f"__done{i}" for i in count() if f"__done{i}" not in docs.columns)
    rows = docs.withColumn(own, F.when(c.isNull(), done(F.lit(None).cast("string"), F.lit(0))).otherwise(made))
    out = F.when(odd, spelled(F.col(f"{own}.text"), [(new, old) for old, new in reversed(codes)])).otherwise(F.col(f"{own}.text"))
    kept = [out.alias(text) if name == text else F.col(f"`{name}`") for name in docs.columns]
    return rows.select(*kept, F.col(f"{own}.n").alias("n_entities"))


def surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_entities, text."""
    return replace_entities(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key).select("doc_id", "n_entities", "text")
