"""PII in long texts: no text ends the job, time stays linear; finds and pseudonyms against a plain version."""

import datetime
import hashlib
import re
import time

import pytest

pytest.importorskip("siglake.llm.registry")
from siglake.llm.pii import pseudonymize  # noqa: E402

TEXTS = {
    "labels": "a@" + "b." * 100_000 + "com",
    "letters": "x" * 1_000_000,
    "digits": "7" * 1_000_000,
    "at signs": "a@" * 500_000,
    "dots": "a." * 500_000 + "@",
    "capitals": "DE89" * 250_000,
    "groups": "1234 " * 200_000,
    "plus": "+49 30 " * 140_000,
}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_long(spark, name):
    began = time.time()
    text = TEXTS[name] + " bob@mail.example.com 2004-02-29"
    out = pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), key="k").first()
    assert out.n_email >= 1 and out.n_date == 1 and "bob@" not in out.text and "2004-02-29" not in out.text
    assert time.time() - began < 20


def keyed(key, what):
    return int(hashlib.sha256(f"{key}:{what}".encode()).hexdigest()[:15], 16)


def feistel(key, kind, left, right, m, n):
    for i in range(1, 9):
        if i % 2:
            left = (left + keyed(key, f"{kind}:{m}:{n}:{i}:{right}") % m) % m
        else:
            right = (right + keyed(key, f"{kind}:{m}:{n}:{i}:{left}") % n) % n
    return left, right


def permuted(key, kind, d):
    u = len(d) // 2
    left, right = feistel(key, kind, int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u))
    return f"{left:0{u}d}{right:0{len(d) - u}d}"


def refill(m, digits):
    digits = iter(digits)
    return re.sub("[0-9]", lambda _: next(digits), m)


def luhn(d, doubled):
    return sum(2 * int(c) - 9 * (int(c) > 4) if i % 2 == doubled else int(c) for i, c in enumerate(reversed(d)))


def plain(key, text):
    """Cards, social security numbers, phones with a country code, dates and IPs one by one; the texts hold no others."""

    def card(m):
        d = re.sub("[^0-9]", "", m[0])
        if luhn(d, 1) % 10:
            return m[0]
        b = permuted(key, "card", d[:-1])
        return refill(m[0], b + str(-luhn(b, 0) % 10))

    def ssn(m):
        d = m[0].replace("-", "")
        return m[0] if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else refill(m[0], permuted(key, "ssn", d))

    def phone(m):
        d, c = re.sub("[^0-9]", "", m[0]), len(m[1])
        return refill(m[0], d[:c] + permuted(key, "phone", d[c:]))

    def date(m):
        try:
            t = (datetime.date(int(m[1]), int(m[3]), int(m[4])) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return m[0]
        start = t // 146097 * 146097
        left, right = feistel(key, "date", (t - start) // 5411, (t - start) % 5411, 27, 5411)
        return (datetime.date(1900, 1, 1) + datetime.timedelta(start + left * 5411 + right)).strftime(f"%Y{m[2]}%m{m[2]}%d")

    def ip(m):
        o = [int(x) for x in m[0].split(".")]
        if max(o) > 255:
            return m[0]
        left, right = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255}"

    def email(m):
        local, domain = m[0].lower().rsplit("@", 1)[0], m[0].rsplit("@", 1)[1].lower()
        return f"u{hashlib.sha256(f'{key}:12:{local}'.encode()).hexdigest()[:12]}@d{hashlib.sha256(f'{key}:8:{domain}'.encode()).hexdigest()[:8]}.invalid"

    for pattern, f in ((r"\b[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}\b|(?<![+0-9])[0-9]{16}\b", card), (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", ssn), (r"\+(49|1|353)[0-9]{10,11}\b", phone), (r"\b([0-9]{4})([-/])([0-9]{2})\2([0-9]{2})\b", date), (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", ip), (r"[a-z]+@[A-Za-z.]+[a-z]", email)):
        text = re.sub(pattern, f, text)
    return text


ODD = [
    "card 4539 5787 6362 1486, 4539578763621486; not 4539578763621487",
    "ssn 123-45-6789 000-45-6789 912-45-6789",
    "call +4930123456789 or +17435553824 or +35312345678901",
    "on 2024/01/05, 2024-01-05, 2001-02-29, 1899-12-31 and 2024/13/05",
    "ip 10.0.0.30 10.0.0.300 255.255.255.255",
    "mail bob@mail.Example.com twice bob@mail.Example.com",
    "", "nothing here", "\n\t",
]


def test_against_plain_version(spark):
    rows = spark.createDataFrame([*enumerate(ODD), (99, None), (0, ODD[0])], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in pseudonymize(rows, key="k").collect()]
    assert sorted(got, key=repr) == sorted([(k, plain("k", t)) for k, t in enumerate(ODD)] + [(99, None), (0, plain("k", ODD[0]))], key=repr)
