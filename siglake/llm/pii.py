"""PII: format-preserving pseudonyms by keyed Feistel permutations.

Card numbers (Luhn), IBANs (mod 97), social security numbers, phone numbers,
IPv4 addresses and dates are found, validated and permuted within their format:
the digits of a value (and the letters of an IBAN) are the two halves of an alternating Feistel network with
modular addition, eight rounds of keyed SHA-256, so the mapping is one-to-one,
check digits are computed anew, and separators stay. A date is a day of its
400-year cycle, counted from 1900-01-01, 27 x 5411 days, which are the two halves. An IP
address is two halves of 16 bits. Equal values get equal pseudonyms in every
document, whatever separators they are written with. The local part and domain
of an e-mail address, which are no numbers, get keyed digests.

Values that fail validation stay as they are. Everything happens within a row,
nothing is shuffled. The key is a parameter; whoever holds it can invert the
permutations.

Edge cases. Null text stays null, empty text empty, both with no finds. Long
texts are searched whole, in time linear in their length; of an address whose
local part is longer than 64 characters, the last 64 are replaced, and one with
over 100 labels is none. Where kinds overlap, the earlier start counts, of equal
starts the earlier kind. Repeated documents: a row each. Empty table: no rows. Extra columns pass
through, but for the names the operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import forgetful_parser

ROUNDS = 8
#: countries by the characters after an IBAN's check digits; of others, IBANs of digits or without spaces are found
IBANS = {
    11: "NO", 12: "BE", 14: "DK|FI|FK|FO|GL|NL|SD", 15: "MK|SI", 16: "AT|BA|EE|KZ|LT|LU|MN|XK", 17: "CH|HR|LI|LV", 18: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    19: "AE|GI|IL|IQ|OM|SO|TL", 20: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 21: "AO|CV|GW|LY|MZ|PT|ST", 22: "DZ|IR|IS|TR",
    23: "BI|CF|CG|CM|DJ|FR|GA|GQ|GR|IT|KM|MC|MG|MR|SM|TD", 24: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG",
    25: "BR|EG|PS|QA|UA", 26: "JO|KW|MU|YE", 27: "MT|SC", 28: "LC", 29: "RU",
}
IBAN = "|".join(f"(?:{c})[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{n // 4}}}" + (f" ?[0-9A-Z]{{{n % 4}}}" if n % 4 else "") for n, c in IBANS.items())
#: Country codes of one and two digits; all others have three.
CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: kind: pattern, tried in this order at each place. Every repetition has a bound, and those of groups a small one, so that a place costs a bounded number of steps and the matcher's stack stays low in any text
PATTERNS = {
    "email": r"[A-Za-z0-9\u0080-￿][A-Za-z0-9._%+\u0080-￿-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,100}[A-Za-z]{2,63}",
    "iban": rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN}|[A-Z]{{2}}[0-9]{{2}}[0-9A-Z]{{11,30}}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]{{4}}){{2,7}}(?: ?[0-9]{{1,3}})?)(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9A-Za-z/])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
QUOTED = "'" + ANY.replace("\\", "\\\\").replace("'", "\\'") + "'"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def keyed(key: str, what: str) -> str:
    """SQL: 60 keyed bits as a bigint."""
    return f"cast(conv(substr(sha2(concat('{key}', ':', {what}), 256), 1, 15), 16, 10) as bigint)"


def feistel(key: str, kind: str, left: str, right: str, m: str, n: str) -> str:
    """SQL: struct (l, r), the permutation of left below m and right below n."""
    mod = lambda half, size, other: f"pmod(a.{half} + pmod({keyed(key, f"concat_ws(':', '{kind}', a.m, a.n, i, a.{other})")}, a.{size}), a.{size})"
    return (
        f"aggregate(sequence(1, {ROUNDS}), struct(cast({left} as bigint) as l, cast({right} as bigint) as r, cast({m} as bigint) as m, cast({n} as bigint) as n),"
        f" (a, i) -> CASE WHEN i % 2 = 1 THEN struct({mod('l', 'm', 'r')} as l, a.r as r, a.m as m, a.n as n) ELSE struct(a.l as l, {mod('r', 'n', 'l')} as r, a.m as m, a.n as n) END)"
    )


def permuted_digits(key: str, kind: str, d: str) -> str:
    """SQL: a digit string of the same length, by the permutation of its halves. d is a lambda's variable or a column."""
    u = f"(length({d}) div 2)"
    v = f"(length({d}) - {u})"
    power = lambda n: f"cast(concat('1', repeat('0', {n})) as bigint)"
    half = feistel(key, kind, f"substr({d}, 1, {u})", f"substr({d}, {u} + 1)", power(u), power(v))
    return with_(half, "f", lambda f: f"concat(lpad(cast({f}.l as string), {u}, '0'), lpad(cast({f}.r as string), {v}, '0'))")


def with_(value: str, name: str, body) -> str:
    """SQL: body over value, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def luhn_sum(d: str, doubled: int) -> str:
    """SQL: the Luhn sum of digits, those at an odd distance (doubled 1) or even distance (0) from the right end doubled."""
    return f"aggregate(transform(reverse(split({d}, '')), (c, i) -> CASE WHEN i % 2 = {doubled} THEN 2 * cast(c as int) - CASE WHEN cast(c as int) > 4 THEN 9 ELSE 0 END ELSE cast(c as int) END), 0, (a, x) -> a + x)"


def refill(m: str, new: str) -> str:
    """SQL: m with its digits replaced, in order, by those of new."""
    return f"array_join(transform(sequence(1, length({m})), j -> CASE WHEN substr({m}, j, 1) rlike '[0-9]' THEN substr({new}, length({digits(f'substr({m}, 1, j)')}), 1) ELSE substr({m}, j, 1) END), '')"


def _card(key: str) -> str:
    body = lambda d: f"CASE WHEN length({d}) between 13 and 19 and {luhn_sum(d, 1)} % 10 = 0 and {d} rlike '[1-9]' THEN " + with_(permuted_digits(key, "card", f"substr({d}, 1, length({d}) - 1)"), "b", lambda b: refill("m", f"concat({b}, cast(pmod(-{luhn_sum(b, 0)}, 10) as string))")) + " END"
    return with_(digits("m"), "d", body)


def permuted_letters(key: str, kind: str, x: str) -> str:
    """SQL: a string of as many letters A-Z, each piece of up to 12 by the permutation of its halves."""
    number = lambda t: f"CASE WHEN {t} = '' THEN 0L ELSE aggregate(split({t}, ''), 0L, (a, c) -> a * 26 + ascii(c) - 65) END"
    power = lambda n: f"cast(pow(26, {n}) as bigint)"
    letters = lambda v, n: f"CASE WHEN {n} = 0 THEN '' ELSE array_join(transform(sequence(1, {n}), j -> char(65 + pmod({v} div {power(f'({n} - j)')}, 26L))), '') END"

    def piece(p):
        u, v = f"((length({p}) + 1) div 2)", f"(length({p}) div 2)"
        half = feistel(key, kind, number(f"substr({p}, 1, {u})"), number(f"substr({p}, {u} + 1)"), power(u), power(v))
        return with_(half, "f", lambda f: f"concat({letters(f'{f}.l', u)}, {letters(f'{f}.r', v)})")

    return f"array_join(transform(filter(array(substr({x}, 1, 12), substr({x}, 13, 12), substr({x}, 25)), p -> p <> ''), p -> {piece('p')}), '')"


def _iban(key: str) -> str:
    # letters count as 10 to 35; x is the account part, the country and the check digits
    mod97 = lambda x: f"aggregate(split({x}, ''), 0, (a, c) -> CASE WHEN c < 'A' THEN (a * 10 + cast(c as int)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"
    count = lambda x, j, kind: f"length(regexp_replace(substr({x}, 1, {j}), '[^{kind}]', ''))"
    d, t = digits("substr(w, 5)"), "regexp_replace(substr(w, 5), '[^A-Z]', '')"
    new_d = with_(d, "d", lambda d: f"CASE WHEN length({d}) > 1 THEN {permuted_digits(key, 'iban', d)} WHEN {d} = '' THEN '' ELSE cast(pmod(cast({d} as bigint) + {keyed(key, "'iban:1'")}, 10) as string) END")
    new = f"transform(array(struct({new_d} as d, {permuted_letters(key, 'iban-letters', t)} as t)), n -> array_join(transform(sequence(5, length(w)), j -> CASE WHEN substr(w, j, 1) < 'A' THEN substr(n.d, {count('substr(w, 5)', 'j - 4', '0-9')}, 1) ELSE substr(n.t, {count('substr(w, 5)', 'j - 4', 'A-Z')}, 1) END), ''))"
    check = f"lpad(cast(98 - {mod97("concat(b, substr(w, 1, 2), '00')")} as string), 2, '0')"
    spaced = lambda x: f"array_join(transform(sequence(1, length(m)), j -> CASE WHEN substr(m, j, 1) = ' ' THEN ' ' ELSE substr({x}, {count('m', 'j', '0-9A-Z')}, 1) END), '')"
    out = f"get(transform({new}, b -> {with_(f"concat(substr(w, 1, 2), {check}, b)", 'y', spaced)}), 0)"
    return with_("replace(m, ' ', '')", "w", lambda w: f"CASE WHEN length(w) between 15 and 34 and {mod97('concat(substr(w, 5), substr(w, 1, 4))')} = 1 THEN {out} END")


def _phone(key: str) -> str:
    # the country code stays: the digits before the first separator of a number with a plus, or those that can be no other code
    code = f"CASE WHEN m not like '+%' THEN 0 WHEN m rlike '^[+][0-9]{{1,3}}[^0-9]' THEN length(regexp_extract(m, '^[+]([0-9]+)', 1)) ELSE length(regexp_extract(m, '^[+]((?:{CODES})|[0-9]{{3}})', 1)) END"
    body = lambda d: with_(code, "c", lambda c: f"CASE WHEN length({d}) between 7 and 15 THEN " + with_(permuted_digits(key, "phone", f"substr({d}, {c} + 1)"), "b", lambda b: refill("m", f"concat(substr({d}, 1, {c}), {b})")) + " END")
    return with_(digits("m"), "d", body)


def _ssn(key: str) -> str:
    body = lambda d: f"CASE WHEN substr({d}, 1, 3) not in ('000', '666') and substr({d}, 1, 1) <> '9' and substr({d}, 4, 2) <> '00' and substr({d}, 6) <> '0000' THEN " + with_(permuted_digits(key, "ssn", d), "b", lambda b: refill("m", b)) + " END"
    return with_(digits("m"), "d", body)


def _ip(key: str) -> str:
    octet = lambda i: f"cast(get(o, {i}) as int)"
    half = feistel(key, "ip", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536")
    out = with_(half, "f", lambda f: f"concat_ws('.', {f}.l div 256, {f}.l % 256, {f}.r div 256, {f}.r % 256)")
    return with_("split(m, '[.]')", "o", lambda o: f"CASE WHEN forall({o}, x -> cast(x as int) <= 255) THEN {out} END")


def _date(key: str) -> str:
    day = "CASE WHEN m rlike '^[0-9]{4}' THEN try_to_date(translate(m, '/', '-'), 'yyyy-MM-dd') ELSE coalesce(try_to_date(translate(m, '/', '.'), 'dd.MM.yyyy'), try_to_date(translate(m, '/', '.'), 'MM.dd.yyyy')) END"
    form = "CASE WHEN m rlike '^[0-9]{4}' THEN translate(date_format(n, 'yyyy-MM-dd'), '-', substr(m, 5, 1)) WHEN try_to_date(translate(m, '/', '.'), 'dd.MM.yyyy') is null THEN date_format(n, concat('MM', substr(m, 3, 1), 'dd', substr(m, 6, 1), 'yyyy')) ELSE date_format(n, concat('dd', substr(m, 3, 1), 'MM', substr(m, 6, 1), 'yyyy')) END"
    # first day, and the two factors of the number of days, of the cycle that holds day t; the calendar's ends have shorter ones
    cycle = lambda t: f"CASE WHEN {t} < -584388 THEN struct(-693595L as s, 7L as m, 15601L as n) WHEN {t} >= 2921940 THEN struct(2921940L as s, 92L as m, 397L as n) ELSE struct(146097L * cast(floor({t} / 146097) as bigint) as s, 27L as m, 5411L as n) END"
    moved = lambda t: with_(cycle(t), "y", lambda y: with_(feistel(key, "date", f"({t} - {y}.s) div {y}.n", f"({t} - {y}.s) % {y}.n", f"{y}.m", f"{y}.n"), "f", lambda f: with_(f"date_add(date'1900-01-01', cast({y}.s + {f}.l * {y}.n + {f}.r as int))", "n", lambda n: form)))
    return with_(f"datediff({day}, date'1900-01-01')", "t", lambda t: f"CASE WHEN {t} is not null THEN {moved(t)} END")


def _email(key: str) -> str:
    mask = lambda part, n: f"substr(sha2(concat('{key}', ':{n}:', {part}), 256), 1, {n})"
    return f"concat('u', {mask("lower(substring_index(m, '@', 1))", 12)}, '@d', {mask("lower(substring_index(m, '@', -1))", 8)}, '.invalid')"


def pseudonymize(documents: DataFrame, *, key: str) -> DataFrame:
    """documents with text pseudonymized, and the number of replaced values of each kind."""
    if "'" in key or "\\" in key:
        raise ValueError("the key must not hold quotes or backslashes")
    rules = {"email": _email, "iban": _iban, "phone": _phone, "card": _card, "ip": _ip, "ssn": _ssn, "date": _date}
    quoted = {k: "'^(?:" + p.replace("\\", "\\\\") + ")$'" for k, p in PATTERNS.items()}
    # a struct whose text is null failed validation; the next kind may still take the match
    new = "get(filter(array(" + ", ".join(f"CASE WHEN m rlike {quoted[k]} THEN named_struct('k', '{k}', 't', {rules[k](key)}) END" for k in KINDS) + "), y -> y.t is not null), 0)"
    plain = [c for c in documents.columns if c not in {f"n_{k}" for k in KINDS}]
    text = F.expr(f"CASE WHEN size(_found) > 0 THEN array_join(transform(split(text, {QUOTED}, -1), (g, i) -> concat(g, coalesce(get(_new, i).t, get(_found, i), ''))), '') ELSE text END")
    counts = [F.expr(f"cast(coalesce(size(filter(_new, y -> y.k = '{k}')), 0) as bigint)").alias(f"n_{k}") for k in KINDS]
    with forgetful_parser(documents.sparkSession):
        d = documents.select(*plain, F.expr(f"CASE WHEN text rlike '[0-9@]' THEN regexp_extract_all(text, {QUOTED}, 0) END").alias("_found"))
        d = d.select("*", F.expr(f"CASE WHEN size(_found) > 0 THEN transform(_found, m -> {new}) END").alias("_new"))
        return d.select(*[text.alias("text") if c == "text" else c for c in plain], *counts)
