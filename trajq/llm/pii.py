"""Format-preserving pseudonyms for personal data, with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms that are looked for, tried in this order. All are bounded or possessive, so that a search
# takes time in proportion to the text.
NAMED = r"(?i:token|secret|api[_-]?key|password)[ ]{0,3}[=:][ ]{0,3}[\"']?"
BEARER = r"(?<![\p{L}0-9])(?i:bearer)[ ]{1,3}(?=[A-Za-z_.+/=~\-]{0,99}[0-9])"
KEY_HEADS = r"(?:gh[opsur]_|github_pat_|glpat-|xox[abprs]-|[sr]k_(?:live|test)_|sk-)"
SECRET = (
    rf"{NAMED}[0-9A-Za-z_.+/=~\-]{{16,}}+|(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![0-9A-Za-z])"
    rf"|{BEARER}[0-9A-Za-z_.+/=~\-]{{16,}}+"
    rf"|(?<![0-9A-Za-z]){KEY_HEADS}(?=[A-Za-z_\-]{{0,99}}[0-9])[0-9A-Za-z_\-]{{16,}}+"
)
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
IBAN = rf"(?<![0-9A-Za-z])(?:{'|'.join(IBAN_COUNTRIES)})\d{{2}}(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?(?![0-9A-Za-z])"
EMAIL = r"(?<![\p{L}0-9._%+\-])[\p{L}0-9._%+\-][\p{L}0-9._%+\-'\u2019]{0,63}+@[\p{L}\p{M}0-9\-]{1,63}(?:\.[\p{L}\p{M}0-9\-]{1,63}){1,8}"
TRUNK = r"0\d{2}[ \-]\d{4}[ \-]\d{4}|0\d{3}[ \-]\d{3}[ \-]\d{4}|0\d{4}[ \-]\d{6}|1-\d{3}-\d{3}-\d{4}|1\.\d{3}\.\d{3}\.\d{4}|1 \d{3} \d{3} \d{4}"
PHONE = (
    r"\+\d{1,3}[ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)"
    r"|(?<![\d+])\+\d{1,3}(?:[ .\-]?(?!\d{4}-\d{2}-\d{2}(?!\d))\(?\d\)?){6,13}(?!\d)"
    r"|(?<![\p{L}\d.\-+(/])\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}(?![\d\-/]|\.\d)"
    r"|(?<![\p{L}\d.\-+(/])\d{3}([ .\-])\d{3}\1\d{4}(?![\d\-/]|\.\d)"
    rf"|(?<![\p{{L}}\d.\-+(/])(?<!\d )(?:{TRUNK})(?![\d\-/]|\.\d| \d)"
)
CARD = r"(?<!\d)(?:\d{4}([ .\-])\d{4}\2\d{4}\2\d{4}|\d{4}([ \-])\d{6}\3\d{5}|\d{13,19}+)(?!\d)"
SSN = r"(?<![\p{L}\d.\-+(/])\d{3}-\d{2}-\d{4}(?![\d\-/]|\.\d)"
IPV4 = r"(?<![\d.])(?<!\b(?i:version|release|section|chapter|v)[ ]{0,2})(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d|[ ]{1,2}(?i:version|release|section|chapter)\b)"
IPV6 = (
    r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?=[A-Fa-f:]{0,34}[0-9])(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}"
    r"|(?=[A-Fa-f:]{0,34}[0-9])[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){2,6})(?![0-9A-Za-z:])"
)
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "en3": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
MONTH = "(?:" + "|".join(sorted({m for names in MONTHS.values() for m in names}, key=lambda m: (-len(m), m))) + ")"
NAMED_DATE = rf"\d{{1,2}}\.?(?: de)? {MONTH}(?: de)? (?:19|20)\d{{2}}|{MONTH} \d{{1,2}}, (?:19|20)\d{{2}}"
DATE = (
    r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d\-/]|\.\d)"
    rf"|(?<![\p{{L}}\d.\-/])(?:{NAMED_DATE})(?![\d\-/]|\.\d)"
)
ANY = "|".join((SECRET, EMAIL, IBAN, PHONE, CARD, SSN, IPV4, IPV6, DATE))
KINDS = ("secret", "email", "phone", "card", "ip", "date", "iban", "ssn")
#: Dates from 1900-01-01 to 2099-12-31 are permuted among themselves, by number of the day.
FIRST_DAY, N_DAYS = "1900-01-01", 73049
ROUNDS = 10


def _digest(key: str, tweak: str, *values: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), *[v.cast("string") for v in values]), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of Z_a x Z_b as a struct (l, r): rounds add a keyed digest of one half to the other."""

    def noise(half: Column, i: Column) -> Column:
        return F.conv(F.substring(_digest(key, tweak, i, half), 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s["l"] + F.pmod(noise(s["r"], i), a), a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(noise(s["l"], i), b), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A string of 2 to 36 digits, permuted among the strings of its length."""
    n = F.char_length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), (k + 1).cast("int"), "0").cast("long")
    mixed = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n), power(half), power(n - half), key, tweak)
    return _let(mixed, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), n - half, "0")))


def refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by those of `digits`."""
    chars = F.split(form, "")
    place = lambda i: F.char_length(F.regexp_replace(F.substring(form, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit."""
    n = F.char_length(digits)

    def term(c: Column, i: Column) -> Column:
        doubled = c.cast("int") * 2
        return F.when((n - i) % 2 == 1, c.cast("int")).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), term), F.lit(0), lambda s, x: s + x)


def _card(match: Column, key: str) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    body = permute_digits(F.substring(digits, F.lit(1), F.char_length(digits) - 1), key, "card")
    checked = _let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
    return refill(match, checked)


def _phone(match: Column, key: str) -> Column:
    head = F.regexp_extract(match, rf"^(?:\+\d{{1,3}}(?=[ .(\-])|\+\d|(?=(?:{TRUNK})$)[01])?[ .\-]?", 0)
    rest = F.substring(match, F.char_length(head) + 1, F.char_length(match))
    return F.concat(head, refill(rest, permute_digits(F.regexp_replace(rest, "[^0-9]", ""), key, "phone")))


def _mod97(chars: Column) -> Column:
    """The remainder of digits and capitals by 97, a letter standing for two digits (A is 10)."""
    step = lambda x, c: F.when(c.rlike("[0-9]"), (x * 10 + c.cast("int")) % 97).otherwise((x * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(chars, ""), lambda c: c != ""), F.lit(0), step)


def _iban_body(match: Column) -> Column:
    return F.substring(F.replace(match, F.lit(" ")), F.lit(5), F.char_length(match))


def _iban(match: Column, key: str) -> Column:
    """The digits of the account are permuted among themselves; country and letters stay; the check digits are new."""
    country, digits = F.substring(match, 1, 2), permute_digits(F.regexp_replace(_iban_body(match), "[^0-9]", ""), key, "iban")
    check = lambda d: F.lpad((98 - _mod97(F.concat(refill(_iban_body(match), d), country, F.lit("00")))).cast("string"), 2, "0")
    return _let(digits, lambda d: refill(match, F.concat(check(d), d)))


def _ssn(match: Column, key: str) -> Column:
    """Among the 898 areas (1 to 899 but for 666), 99 groups and 9999 serial numbers that exist."""
    area, group, serial = (F.substring(match, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    mixed = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    parts = lambda s: ((s["l"] + F.when(s["l"] >= 665, 2).otherwise(1), 3), (F.floor(s["r"] / 9999) + 1, 2), (s["r"] % 9999 + 1, 4))
    return _let(mixed, lambda s: F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts(s)]))


def _ip(match: Column, key: str) -> Column:
    octet = lambda i: F.element_at(F.split(match, r"\."), i).cast("long")
    mixed = feistel(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536), key, "ip")
    return _let(mixed, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))


def _ip6(match: Column, key: str) -> Column:
    """A Feistel network over the two halves of the 128 bits; the result is written in eight groups."""
    some = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = some(F.substring_index(match, "::", 1)), F.when(match.contains("::"), some(F.substring_index(match, "::", -1))).otherwise(F.array().cast("array<string>"))
    groups = F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)
    nibbles = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    word = lambda x: F.conv(x, 16, -10).cast("long")
    noise = lambda half, i: word(F.substring(_digest(key, "ip6", i, half), 1, 16))

    def turn(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(noise(s["r"], i)).alias("r"))

    start = F.struct(word(F.substring(nibbles, 1, 16)).alias("l"), word(F.substring(nibbles, 17, 16)).alias("r"))
    mixed = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return _let(mixed, lambda s: F.regexp_replace(F.lower(F.concat(*[F.lpad(F.hex(s[h]), 16, "0") for h in ("l", "r")])), "(.{4})(?!$)", "$1:"))


def _is_ip6(match: Column) -> Column:
    n = F.size(F.filter(F.split(match, ":"), lambda g: g != ""))
    return F.when(match.contains("::"), n <= 7).otherwise(n == 8)


def _month_name(match: Column) -> Column:
    return F.regexp_extract(match, MONTH, 0)


def _languages(match: Column) -> list[tuple[Column, list[str]]]:
    """(condition, month names): names that languages share are German after a full stop, else English."""
    return [(F.array_contains(F.lit(MONTHS[x]), _month_name(match)) & c, MONTHS[x]) for x, c in (("de", match.contains(". ")), *((x, F.lit(True)) for x in MONTHS))]


def _named_date(match: Column) -> Column:
    """The date of a form with a month's name; null for other forms."""
    day, year = F.regexp_extract(match, r"(?<!\d)\d{1,2}(?!\d)", 0), F.regexp_extract(match, r"\d{4}", 0)
    month = F.coalesce(*[F.when(c, F.array_position(F.lit(names), _month_name(match))) for c, names in _languages(match)])
    return F.when(match.rlike(r"\p{L}"), F.concat_ws("-", year, month.cast("string"), day).try_cast("date"))


def _name_date(match: Column, date: Column) -> Column:
    """The date in the form of the match."""
    name = F.coalesce(*[F.when(c, F.element_at(F.lit(names), F.month(date))) for c, names in _languages(match)])
    day, year = F.dayofmonth(date).cast("string"), F.year(date).cast("string")
    form = F.regexp_replace(F.regexp_replace(match, MONTH, "M"), r"\d{4}", "Y")
    form = F.regexp_replace(form, r"\d{1,2}", "D")
    return F.replace(F.replace(F.replace(form, F.lit("Y"), year), F.lit("D"), day), F.lit("M"), name)


def _as_date(match: Column) -> Column:
    """Day first; with slashes, month first if day first is no date."""
    day_first = F.regexp_replace(match, r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$", "$3-$2-$1").try_cast("date")
    return F.coalesce(day_first, F.regexp_replace(match, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2").try_cast("date"), _named_date(match))


def _date(match: Column, key: str) -> Column:
    """Within 270 x 271 numbers, 121 more than there are days; a result beyond the days is permuted again.
    So is one with a day up to 12 of a month-first date, as it would read as another day-first date."""
    month_first = match.contains("/") & (F.regexp_extract(match, r"/(\d{1,2})/", 1).try_cast("int") > 12)
    form = lambda x, d, m: F.when(match.rlike(r"^\d\d/\d\d/"), F.date_format(x, f"{d}{d}/{m}{m}/yyyy")).otherwise(F.date_format(x, f"{d}/{m}/yyyy"))
    date_of = lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))
    day = F.datediff(_as_date(match), F.lit(FIRST_DAY).cast("date")).cast("long")
    again = lambda x: _let(feistel(F.floor(x / 271), x % 271, F.lit(270), F.lit(271), key, "date"), lambda s: s["l"] * 271 + s["r"])
    mixed = F.aggregate(F.sequence(F.lit(0), F.lit(47)), F.struct(day.alias("x"), F.lit(True).alias("go")), lambda s, i: _let(F.when(s["go"], again(s["x"])).otherwise(s["x"]), lambda y: F.struct(y.alias("x"), ((y >= N_DAYS) | (month_first & (F.dayofmonth(date_of(y)) <= 12))).alias("go"))))
    out = date_of(mixed["x"])
    numbers = F.when(match.contains("-"), F.date_format(out, "yyyy-MM-dd")).when(month_first, form(out, "M", "d")).when(match.contains("/"), form(out, "d", "M"))
    return numbers.when(match.rlike(r"\p{L}"), _name_date(match, out)).otherwise(F.date_format(out, "dd.MM.yyyy"))


def _email(match: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(_digest(key, "email", F.lower(match)), 1, 12), F.lit("@example.invalid"))


def _secret(match: Column, key: str) -> Column:
    head = F.regexp_extract(match, rf"^(?:{NAMED}|(?i:bearer)[ ]{{1,3}}|{KEY_HEADS}|AKIA|ASIA)", 0)
    tail = F.regexp_extract(match, r"\.*$", 0)  # the end of a sentence, not of the value
    value = F.substring(match, F.char_length(head) + 1, F.char_length(match) - F.char_length(head) - F.char_length(tail))
    digest = _digest(key, "secret", value)
    fresh = F.substring(F.repeat(digest, F.ceil(F.char_length(value) / 64).cast("int")), F.lit(1), F.char_length(value))
    return F.concat(head, F.when(value == F.upper(value), F.upper(fresh)).otherwise(fresh), tail)


def _judge(match: Column, key: str) -> Column:
    """(kind, new) of a match; kind is null and new the match itself if its value is not valid."""
    whole = lambda p: match.rlike(f"^(?:{p})$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    day = F.datediff(_as_date(match), F.lit(FIRST_DAY).cast("date"))
    made = lambda kind, new: F.struct(F.lit(kind).alias("kind"), new.alias("new"))
    octets = F.forall(F.split(match, r"\."), lambda o: o.cast("int") < 256)
    return (
        F.when(whole(rf"{NAMED}.*|(?i:bearer) .*|{KEY_HEADS}[0-9A-Za-z_\-]*|(?:AKIA|ASIA)[0-9A-Z]{{16}}"), made("secret", _secret(match, key)))
        .when(match.contains("@"), made("email", _email(match, key)))
        .when(match.contains(":"), F.when(_is_ip6(match), made("ip", _ip6(match, key))))
        .when(whole(r"[A-Z]{2}\d{2}[0-9A-Z ]+"), F.when((_mod97(F.concat(_iban_body(match), F.substring(match, 1, 4))) == 1) & (F.char_length(digits) >= 4), made("iban", _iban(match, key))))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), F.when(~whole(r"(?:000|666|9\d\d)-.*|.*-00-.*|.*-0000"), made("ssn", _ssn(match, key))))
        .when(whole(rf"\+.*|\(\d{{3}}\).*|\d{{3}}[ .\-]\d{{3}}[ .\-]\d{{4}}|{TRUNK}"), F.when(F.char_length(digits).between(8, 16), made("phone", _phone(match, key))).when(~match.startswith("+"), made("phone", _phone(match, key))))
        .when(whole(r"\d{13,19}|\d{4}[ .\-]\d{4}[ .\-]\d{4}[ .\-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}"), F.when(F.pmod(_luhn_sum(digits), F.lit(10)) == 0, made("card", _card(match, key))))
        .when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"), F.when(octets, made("ip", _ip(match, key))))
        .when((day >= 0) & (day < N_DAYS), made("date", _date(match, key)))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with text_col's personal data replaced, and added columns n_secret, n_email, n_phone, n_card, n_ip, n_date, n_iban, n_ssn.

    Card numbers (13 to 19 digits that pass the Luhn test), phone numbers, IP addresses, calendar dates, IBANs (that
    pass the mod-97 test, in one piece or in groups of four) and US social security numbers (3-2-4, of ranges in use) are
    permuted by a keyed Feistel network within their format: the pseudonym is a valid value of the same form, distinct
    values stay distinct and equal values equal in every document. E-mail addresses and secrets become keyed digests.
    Numbers that fail validation are left as they are. Phones are +, a country code and 8 to 16 digits in all in groups,
    3-3-4 digits with separators or parentheses, also after 1 and a separator, or 0 and ten more in groups of 3-4-4, 4-3-4 or
    5-6; cards are unseparated, 4-4-4-4 or 4-6-5. Dates are ISO, dd.mm.yyyy, with slashes (day first, else month first; if a
    day or month has one digit, neither gets a leading zero) or with an English (also of three letters), German, French or Spanish
    month name: 3 March 1999, 3. März 1999, 3 de marzo de 1999, March 3, 1999. IPv6 addresses have eight groups, or three to
    seven and one :: between groups; the pseudonym has eight. Secrets have 16 characters or more and stand after one of the
    four words, after bearer (with a digit), or start like the keys of KEY_HEADS, AKIA or ASIA. Not covered: national
    numbers in other groupings or without separators, cards in other groupings, dates with ordinals (3rd), two-digit years
    or years outside 1900 to 2099, IPv6 with :: at an end, shorter secrets, insurance numbers. Four numbers with dots right after
    version, release, section, chapter or v, or right before one of the first four, are no address; elsewhere they are taken for one. A null text stays null with zero counts; existing columns of the
    added names are replaced; repeated rows each get a row. The key shows in query plans: pass one made for the job.
    """
    counts = [f"n_{k}" for k in KINDS]
    text = F.col(text_col).cast("string")
    found = F.when(text.rlike("[0-9@]|(?i:token|secret|key|password)|AKIA|ASIA"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    hits = docs.drop(*counts).withColumn("__found", found)
    hits = hits.withColumn("__hits", F.transform("__found", lambda m: F.struct(m.alias("old"), _judge(m, key).alias("judged"))))
    parts = F.split(text, ANY, -1)
    filled = F.zip_with(parts, "__hits", lambda p, h: F.concat(p, F.coalesce(h["judged"]["new"], h["old"], F.lit(""))))
    kinds = lambda kind: F.coalesce(F.size(F.filter("__hits", lambda h: h["judged"]["kind"] == kind)), F.lit(0)).cast("long")
    out = hits.withColumns({text_col: F.when(F.size("__found") > 0, F.array_join(filled, "")).otherwise(F.col(text_col))} | {c: kinds(k) for c, k in zip(counts, KINDS)})
    return out.drop("__found", "__hits")
