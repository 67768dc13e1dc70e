"""Forms of phone numbers, cards, dates, domains and secrets that real texts have."""

import re

import pytest

from trajq.llm.pii import pseudonymise

PHONES = ["(555) 123-4567", "555-123-4567", "555.123.4567", "+1 555 123 4567", "+49 30 1234567", "+44 20 7946 0958", "+15551234567", "+1 (017) 555-7713", "020 7946 0958", "0163 296 0001", "01632 960001", "1-800-555-0199", "1.800.555.0199"]
CARDS = ["3782 822463 10005", "3782-822463-10005", "4539 5787 6362 1486", "4539.5787.6362.1486"]
DATES = ["12/25/2024", "25/12/2024", "02/29/2024"]
LEFT = ["10-20-30", "3782 822463 10006", "13/32/2024", "1234567890", "section 555-123-45678", "+12 34", "at 12:30:45", "1:2:3:4::5:6:7:8", "std::vector and abc::def", "00:1A:2B:3C:4D:5E", "3.1.4.1 section", "bearer of internationalisation", "31 February 1999", "May 2024", "in March 15 of them", "sk-learn-is-a-library"]
LONG = "aB3-" * 500
SECRETS = ["eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N", "abc/def+ghi/jkl+mno/pqr==", LONG, "short.ab/cdefghijklmnop"]


def run(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    return pseudonymise(rows, "k").orderBy("doc_id").collect()


@pytest.mark.parametrize("kind,values", [("phone", PHONES), ("card", CARDS), ("date", DATES)])
def test_numbers_are_replaced_in_their_form(spark, kind, values):
    for before, r in zip(values, run(spark, [f"at {v}, then" for v in values])):
        assert r[f"n_{kind}"] == 1 and before not in r.text
        assert re.sub(r"\d", "0", r.text) == re.sub(r"\d", "0", f"at {before}, then")


def test_other_numbers_stay(spark):
    assert [r.text for r in run(spark, LEFT)] == LEFT


def test_domains_beyond_ascii(spark):
    for r in run(spark, ["an jörg@müller.de, ja", "to ivan@пример.рф now"]):
        assert r.n_email == 1 and "@example.invalid" in r.text and "müller" not in r.text and "пример" not in r.text


def test_secrets_are_replaced_to_their_end(spark):
    for before, r in zip(SECRETS, run(spark, [f'token="{s}" end' for s in SECRETS])):
        after = re.fullmatch(r'token="(.*)" end', r.text)[1]
        assert r.n_secret == 1 and len(after) == len(before)
        assert not {before[i : i + 8] for i in range(len(before) - 7)} & {after[i : i + 8] for i in range(len(after) - 7)}


def test_neighbours_of_a_phone(spark):
    card, link = run(spark, ["+1 555 123 4567 4539578763621486", 'token=abcdefghij.klmnop/qrs. token=abcdefghij.klmnop/qrs'])
    assert (card.n_phone, card.n_card) == (1, 1) and "4539578763621486" not in card.text
    a, b = link.text.split(". ")
    assert a == b and link.n_secret == 2


NAMED = ["3 March 1999", "March 3, 1999", "Mar 3, 1999", "3. März 1999", "3 mars 1999", "3 de marzo de 1999"]
MONTHS = {
    "3 March 1999": "January February March April May June July August September October November December",
    "March 3, 1999": "January February March April May June July August September October November December",
    "Mar 3, 1999": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
    "3. März 1999": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "3 mars 1999": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "3 de marzo de 1999": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}


def test_one_day_in_all_forms_with_names_becomes_one_other_day(spark):
    days = set()
    for before, r in zip(NAMED, run(spark, [f"born {v}." for v in NAMED])):
        assert r.n_date == 1 and before not in r.text
        names = MONTHS[before].split()
        word = next(w for w in re.findall(r"[^\W\d]{3,}", r.text) if w in names)
        day, year = re.findall(r"\d+", r.text)
        days.add((int(year), names.index(word) + 1, int(day)))
        assert re.sub(r"\d+", "0", r.text.replace(word, "M")) == re.sub(r"\d+", "0", f"born {before}.".replace(names[2], "M"))
    (iso,) = run(spark, ["1999-03-03"])
    assert {f"{y}-{m:02d}-{d:02d}" for y, m, d in days} == {iso.text}


def test_addresses_of_eight_groups(spark):
    same = ["2001:db8::ff00:42:8329", "2001:0DB8:0:0:0:ff00:0042:8329", "2001:db8::ff00:42:832a"]
    a, b, c = run(spark, [f"from {v}, then" for v in same])
    assert a.n_ip == b.n_ip == c.n_ip == 1 and a.text == b.text != c.text
    assert re.fullmatch(r"from (?:[0-9a-f]{4}:){7}[0-9a-f]{4}, then", a.text)


def test_single_digits_and_apostrophes(spark):
    short, mail, quoted = run(spark, ["on 1/2/1999 it", "ask o'neil@ex.co.uk now", "ask 'neil@ex.co.uk' now"])
    assert short.n_date == 1 and re.fullmatch(r"on \d{1,2}/\d{1,2}/\d{4} it", short.text) and "1/2/1999" not in short.text
    assert re.fullmatch(r"ask u[0-9a-f]{12}@example\.invalid now", mail.text)
    assert re.fullmatch(r"ask 'u[0-9a-f]{12}@example\.invalid' now", quoted.text)


def test_keys_by_their_heads(spark):
    for head, value in (("Bearer ", "eyJhbGciOiJIUzI1NiJ9.abc"), ("ghp_", "a1B2" * 9), ("xoxb-", "123456789012-abcdef"), ("sk_live_", "a1B2" * 5)):
        (r,) = run(spark, [f"use {head}{value} here"])
        assert r.n_secret == 1 and re.fullmatch(rf"use {head}[0-9a-f]{{{len(value)}}} here", r.text)
