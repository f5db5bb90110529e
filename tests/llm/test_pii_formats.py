"""IBANs of all countries and dates of all years in op9_pii."""

import datetime
import re

import pytest

pytest.importorskip("siglake.llm")
from siglake.llm.pii import pseudonymize  # noqa: E402


def valid(iban):
    w = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in w[4:] + w[:4])) % 97 == 1


def hidden(spark, texts):
    rows = pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").orderBy("doc_id").collect()
    return [(r.text, r.n_iban, r.n_date) for r in rows]


def test_ibans_with_letters_and_short_ones(spark):
    ibans = ["GB29 NWBK 6016 1331 9268 19", "NL91ABNA0417164300", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"]
    assert all(map(valid, ibans))
    for iban, (text, n, _) in zip(ibans, hidden(spark, [f"pay {x} EUR 4111 soon" for x in ibans])):
        new = re.fullmatch("pay (.*) EUR 4111 soon", text)[1]
        shape = lambda x: re.sub("[A-Z]", "A", re.sub("[0-9]", "0", x))
        assert n == 1 and new != iban and valid(new) and shape(new) == shape(iban) and new[:2] == iban[:2]
    assert hidden(spark, ["GB28 NWBK 6016 1331 9268 19"])[0][:2] == ("GB28 NWBK 6016 1331 9268 19", 0)


def test_dates_of_every_cycle(spark):
    days = ["0001-01-01", "0299-12-31", "0300-01-01", "1066-10-14", "1899-12-31", "1900-01-01", "2299-12-31", "2300-01-01", "9899-12-31", "9900-01-01", "9999-12-31"]
    got = hidden(spark, days)
    assert all(n == 1 and datetime.date.fromisoformat(t) for t, _, n in got)
    assert len({t for t, _, _ in got}) == len(days) and [t for t, _, _ in got] != days
