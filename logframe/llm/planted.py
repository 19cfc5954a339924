"""Labelled findings for the secret scan: true secrets and look-alikes planted into corpus texts.

A finding is labelled by what was planted, never by how it looks: a secret is drawn at
random from an alphabet in one of the forms below and stands where such a value stands
(assigned to a name, in a header, in an address); a decoy is a value that is public,
derived, a placeholder or plain text, some of them under the same names. The words around
a finding are those of the document it is planted in.
"""

from __future__ import annotations

import random
import string
import uuid

_HEX, _ALNUM = "0123456789abcdef", string.ascii_letters + string.digits
_URL_SAFE, _BASE64, _MARKS = _ALNUM + "-_", _ALNUM + "+/", "!@#$%^&*.-_"
# fixed values: names that values are assigned to, and plain words
SECRET_NAMES = (
    "token secret password passwd pwd api_key apikey API_KEY access_key SECRET_KEY aws_secret_access_key client_secret auth_token AUTH_TOKEN TOKEN db_password DB_PASS"
    " private_key bearer_token session_secret webhook_secret credential accessToken apiKey clientSecret refresh_token smtp_pass encryption_key signing_key"
).split()
PUBLIC_NAMES = (
    "sha256 md5 checksum digest commit rev revision etag integrity uuid guid id request_id trace_id version build hash fingerprint color date file path url title name user"
    " email host port size count author status type key_id token_count token_type password_hint secret_santa max_tokens passphrase_help public_key"
).split()
PLACEHOLDERS = "changeme your_api_key_here <password> none null true false required optional xxxxxxxx ${TOKEN} {{secret}} os.environ[TOKEN] example REPLACE_ME ******** redacted TODO undefined".split()
WORDS = "account after again before between change client common control design during entry first garden house image letter market method mother number office paper people place point public report result school second service simple station story street summer system table thing travel value village water weather winter world writer".split()
# end of fixed values
#: How a value is written behind its name.
_ASSIGNED = ('{n} = "{v}"', "{n}: {v}", "{n}={v}", '"{n}": "{v}"', "{n} = '{v}'", "export {n}={v}", "{n} => '{v}'")


def _draw(rng: random.Random, alphabet: str, low: int, high: int | None = None) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high or low)))


def _word(rng: random.Random) -> str:
    return rng.choice(WORDS)


def _password(rng: random.Random) -> str:
    base = _word(rng) if rng.random() < 0.4 else _draw(rng, string.ascii_lowercase, 5, 9)
    return (base.capitalize() if rng.random() < 0.5 else base) + _draw(rng, string.digits, 1, 4) + _draw(rng, _MARKS, 1, 2)


_TOKENS = (
    lambda r: _draw(r, _HEX, 32), lambda r: _draw(r, _HEX, 40), lambda r: _draw(r, _HEX, 64), lambda r: _draw(r, _HEX.upper(), 40), lambda r: _draw(r, _ALNUM, 16, 48), lambda r: _draw(r, _BASE64, 40) + "=" * r.randint(0, 2),
    lambda r: _draw(r, _URL_SAFE, 24, 64), _password, _password, lambda r: ".".join(_draw(r, string.ascii_lowercase + string.digits, 3, 8) for _ in range(3)),
)
_FREE = (
    lambda r: "AKIA" + _draw(r, string.ascii_uppercase + string.digits, 16), lambda r: "ghp_" + _draw(r, _ALNUM, 36), lambda r: "sk_live_" + _draw(r, _ALNUM, 24), lambda r: "AIza" + _draw(r, _URL_SAFE, 35),
    lambda r: "xoxb-" + _draw(r, string.digits, 11) + "-" + _draw(r, _ALNUM, 24), lambda r: f"eyJ{_draw(r, _URL_SAFE, 20, 40)}.eyJ{_draw(r, _URL_SAFE, 30, 80)}.{_draw(r, _URL_SAFE, 43)}",
    lambda r: f"-----BEGIN {r.choice(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n" + "\n".join(_draw(r, _BASE64, 64) for _ in range(r.randint(2, 6))) + "\n-----END PRIVATE KEY-----",
)


def _secret(rng: random.Random) -> tuple[str, str]:
    """(text, value inside it) of a true secret."""
    at = rng.random()
    if at < 0.6:
        v = rng.choice(_TOKENS)(rng)
        form, n = rng.choice(_ASSIGNED), rng.choice(SECRET_NAMES)
        return form.format(n=n, v=v), v
    if at < 0.8:
        v = rng.choice(_FREE)(rng)
        return (v if rng.random() < 0.5 or "\n" in v else rng.choice(_ASSIGNED).format(n=rng.choice([*SECRET_NAMES, "value", "x", "key"]), v=v)), v
    v = rng.choice((_TOKENS[4], _TOKENS[6], _password))(rng).replace("@", "x")
    if at < 0.9:
        return f"{rng.choice(['postgres', 'https', 'redis', 'amqp'])}://{_word(rng)}:{v}@{_word(rng)}.example.com/{_word(rng)}", v
    v = rng.choice(_TOKENS[:7])(rng)
    return f"Authorization: Bearer {v}", v


def _decoy(rng: random.Random) -> tuple[str, str]:
    """(text, value inside it) of what is no secret."""
    at, form = rng.random(), rng.choice(_ASSIGNED)
    if at < 0.35:  # random values under public names
        v = rng.choice((*_TOKENS[:4], lambda r: str(uuid.UUID(int=r.getrandbits(128), version=4)), lambda r: "sha256-" + _draw(r, _BASE64, 43) + "="))(rng)
        n = rng.choice("sha256 md5 checksum digest commit rev revision etag integrity uuid guid id request_id trace_id build hash fingerprint public_key".split())
        return form.format(n=n, v=v), v
    if at < 0.5:
        v = rng.choice((lambda r: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}", lambda r: _word(r), lambda r: str(r.randint(1, 10**9)), lambda r: f"2{_draw(r, string.digits, 3)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", lambda r: f"#{_draw(r, _HEX, 6)}", lambda r: f"/{_word(r)}/{_word(r)}.txt"))(rng)
        return form.format(n=rng.choice(PUBLIC_NAMES), v=v), v
    if at < 0.7:  # secret names without a secret
        v = rng.choice((lambda r: r.choice(PLACEHOLDERS), lambda r: _word(r), lambda r: f"{_word(r)}-{_word(r)}", lambda r: "".join(_word(r).capitalize() for _ in range(3))))(rng)
        return form.format(n=rng.choice(SECRET_NAMES), v=v), v
    v = rng.choice((
        lambda r: str(uuid.UUID(int=r.getrandbits(128), version=4)), lambda r: f"{_word(r)}_{_word(r)}_{_word(r)}_{r.randint(1, 99)}", lambda r: "".join(_word(r).capitalize() for _ in range(3)) + str(r.randint(1, 99)),
        lambda r: _draw(r, string.digits, 16, 24), lambda r: f"/usr/lib/{_word(r)}/{_word(r)}-{r.randint(1, 9)}.{r.randint(1, 9)}", lambda r: f"{_word(r)}-{_word(r)}-{_word(r)}-20{_draw(r, string.digits, 2)}", lambda r: _word(r)[0] * 20 + "1",
    ))(rng)
    return v, v


def plant(rng: random.Random, text: str) -> tuple[str, int, int, int]:
    """(text with a finding, begin and end of its value, label); both classes are equally likely."""
    label = rng.randint(0, 1)
    written, value = (_secret if label else _decoy)(rng)
    at = rng.randint(0, len(text))
    at = text.find(" ", at) + 1 or len(text)
    left, right = text[:at], text[at:]
    if left and not left[-1].isspace():
        left += " "
    begin = len(left) + written.rindex(value)
    return f"{left}{written}{rng.choice([' ', chr(10), ', ', '. ']) if rng.random() < 0.9 else ' '}{right}", begin, begin + len(value), label
