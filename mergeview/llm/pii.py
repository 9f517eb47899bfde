"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

Every valid match is replaced by a keyed permutation of itself within its format, so that equal values
get equal pseudonyms in all documents and the text keeps its shape:

* payment cards of 13-19 digits with a right Luhn sum: issuer digit and grouping stay, the check digit is right again;
* IBANs with a right check (modulo 97): country, length, grouping and the places of letters stay, the check digits are right again;
* phone numbers: country code and grouping stay, area and exchange codes that begin with 2-9 still do; other international
  numbers of 8-15 digits after a +: the first group (the first two digits of an ungrouped number) and the grouping stay;
* US social security numbers, IPv4 addresses (each number up to 255), IPv6 addresses (hexadecimal digits) and dates of 1700-2099
  (1999-12-31, 31.12.1999, 12/31/1999 and 31/12/1999 where that is the only reading);
* e-mail addresses: the part before the @ keeps its pattern of letters (each in its script) and digits;
* access keys, hexadecimal tokens (lower-case, upper-case or mixed) and passwords keep length and alphabet.

The permutation is a Feistel network of ROUNDS rounds over two halves with SHA-256 of key, kind, round
and other half as round function.  Numbers that fail validation stay.  All of it is Spark expressions.
Null text stays null, text without a match is returned as it is, texts of any length are looked at as a whole;
columns other than the text are kept, whatever their names, and repeated rows give repeated results.  A name for
the column of findings that the table has already is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DAY_ZERO, DAYS_HIGH, DAYS_LOW = "1700-01-01", 189, 773  # 400 years are 146,097 = 189 * 773 days

_start, _end = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+",
    "password": r"(?<=(?i:password)[\"']?[ \t]{0,8}[=:][ \t]{0,8}[\"']?)[^\s\"'<>]{4,}+",
    "access": _start + r"AKIA[0-9A-Z]{16}" + _end,
    "hex": _start + r"[0-9A-Fa-f]{32,128}+" + _end,
    "phone": r"(?<![0-9A-Za-z.\-])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{3}\) ?|[0-9]{3}[.\- ])|\([0-9]{3}\) ?|[2-9][0-9]{2}[.\- ](?=[2-9]))[0-9]{3}[.\- ][0-9]{4}(?![0-9A-Za-z]|[.\-][0-9])",
    "intl": r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}+(?:[ .\-/]?+\(?+[0-9]{1,12}+\)?+){1,5}+(?![0-9A-Za-z])",
    "iban": _start + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+| [A-Z0-9]{4}(?: [0-9][0-9A-Z]{3}){1,6}+(?: [0-9][0-9A-Z]{0,2})?+)" + _end,
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f]{0,3}[0-9])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}:(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": _start + r"(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}(?: [0-9]{1,3})?|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})" + _end,
    "ssn": r"(?<![0-9A-Za-z]|[0-9]\-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "date": r"(?<![0-9A-Za-z]|[0-9][.\-/])(?:(?:1[789]|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:1[789]|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:1[789]|20)[0-9]{2})(?![0-9A-Za-z]|[.\-/][0-9])",
    "ip": r"(?<![0-9A-Za-z]|[0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
}
ANY = "|".join(PATTERNS.values())
MAY = "[0-9@]|(?i:password)|AKIA|[A-Fa-f]{32}"  # no match of ANY is without

UPPER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters outside a-z that are permuted among themselves: Latin with accents, Greek, Cyrillic, Hebrew.
LETTERS = ["".join(map(chr, range(a, b + 1))) for a, b in ((0xC0, 0xD6), (0xE0, 0xF6), (0x3B1, 0x3C9), (0x410, 0x42F), (0x430, 0x44F), (0x5D0, 0x5EA))]
#: Kinds of hexadecimal tokens and their alphabets, from narrow to wide.
HEX = {"hex": "0123456789abcdef", "hex-upper": "0123456789ABCDEF", "hex-mixed": "0123456789abcdefABCDEF"}


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digest(key: str, kind: Column, i: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), other.cast("string")), 256)


def _added(text: Column, digest: Column, kind: Column, left: bool) -> Column:
    """Add the digest's bytes to the characters of a half, each within its alphabet: hexadecimal digits or
    capitals and digits where the kind says so, else 0-9, a-z or A-Z; others stay.  The first digits of a
    phone number's area and exchange codes, both in the left half, stay in 2-9 or in 0-1."""

    def in_alphabet(c: Column, b: Column, alphabet: str) -> Column:
        return F.substr(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + b, F.lit(len(alphabet))) + 1, F.lit(1))

    def shifted(j: Column) -> Column:
        c, b = F.substr(text, j, F.lit(1)), F.conv(F.substr(digest, 2 * F.pmod(j - 1, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        first = F.when(code.between(48, 57), 48).when(code.between(97, 122), 97).when(code.between(65, 90), 65)
        other = F.when(code < 128, c)
        for alphabet in LETTERS:
            other = other.when(F.instr(F.lit(alphabet), c) > 0, in_alphabet(c, b, alphabet))
        plain = F.when(first.isNull(), other.otherwise(c)).otherwise(F.char(first + F.pmod(code - first + b, F.when(first == 48, 10).otherwise(26))))
        out = F.when(kind == "access", in_alphabet(c, b, UPPER)).when(kind == "ipv6", F.when(c.rlike("[A-F]"), in_alphabet(c, b, "ABCDEF")).when(c.rlike("[a-f]"), in_alphabet(c, b, "abcdef")).otherwise(in_alphabet(c, b, "0123456789")))
        for name, alphabet in HEX.items():
            out = out.when(kind == name, in_alphabet(c, b, alphabet))
        if left:
            out = out.when((kind == "phone") & j.isin(1, 4), F.when(code < 50, F.char(48 + F.pmod(code - 48 + b, F.lit(2)))).otherwise(F.char(50 + F.pmod(code - 50 + b, F.lit(8)))))
        return out.otherwise(plain)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), shifted), "")).otherwise(F.lit(""))


def permuted_text(text: Column, key: str, kind: Column) -> Column:
    """Permutation of texts of the same length and pattern."""
    cut = F.floor(F.length(text) / 2).cast("int")
    state = F.struct(F.substr(text, F.lit(1), cut).alias("x"), F.substr(text, cut + 1, F.length(text)).alias("y"))

    def step(s: Column, i: Column) -> Column:
        left = let(_digest(key, kind, i, s["y"]), lambda d: F.struct(_added(s["x"], d, kind, True).alias("x"), s["y"].alias("y")))
        right = let(_digest(key, kind, i, s["x"]), lambda d: F.struct(s["x"].alias("x"), _added(s["y"], d, kind, False).alias("y")))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step, lambda s: F.concat(s["x"], s["y"]))


def permuted_number(value: Column, high: Column, low: Column, key: str, kind: Column) -> Column:
    """Permutation of 0 .. high * low - 1."""
    state = F.struct(F.floor(value / low).cast("long").alias("x"), F.pmod(value, low).cast("long").alias("y"))
    word = lambda digest: F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["x"] + word(_digest(key, kind, i, s["y"])), high).cast("long").alias("x"), s["y"].alias("y"))
        right = F.struct(s["x"].alias("x"), F.pmod(s["y"] + word(_digest(key, kind, i, s["x"])), low).cast("long").alias("y"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step, lambda s: s["x"] * low + s["y"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def mod97(text: Column) -> Column:
    """The remainder of a number whose letters stand for 10 to 35."""

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(text, i, F.lit(1)))
        return F.pmod(F.when(c < 58, rest * 10 + (c - 48)).otherwise(rest * 100 + (c - 55)), F.lit(97)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number with its check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def regrouped(digits: Column, pattern: Column, other: str = "[^0-9]") -> Column:
    """pattern with its digits, or what doesn't match `other`, replaced by these."""

    def put(j: Column) -> Column:
        c = F.substr(pattern, j, F.lit(1))
        return F.when(~c.rlike(other), F.substr(digits, F.length(F.regexp_replace(F.substr(pattern, F.lit(1), j), other, "")), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(pattern)), put), "")


def kind_of(m: Column) -> Column:
    """Which of the patterns matched; a match's own text tells them apart without its surroundings."""
    shape = F.when(m.contains("@"), "email").when(m.rlike("^AKIA[0-9A-Z]{16}$"), "access")
    for name, alphabet in HEX.items():
        shape = shape.when(m.rlike(f"^[{alphabet}]{{32,128}}$"), name)
    shape = shape.when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip").when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    shape = shape.when(m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})$"), "date")
    shape = shape.when(m.rlike(r"^(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.\- ])[0-9]{3}[.\- ][0-9]{4}$"), "phone")
    shape = shape.when(m.rlike(r"^[0-9](?:[ \-]?[0-9]){12,18}$"), "card").when(m.rlike(r"^\+[0-9][0-9 .\-/()]*$"), "intl")
    shape = shape.when(m.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,}$"), "iban").when(m.rlike("^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*[0-9A-Fa-f]$"), "ipv6")
    return shape.otherwise("password")


def _changed_text(m: Column, digits: Column, kind: Column, key: str) -> Column:
    """All kinds but ip and date.  What is permuted is the core; the rest of the match is kept or follows from it."""
    n = F.length(digits)
    core = F.when(kind == "email", F.substring_index(m, "@", 1)).when(kind == "access", F.substr(m, F.lit(5), F.lit(16)))
    core = core.when(kind == "card", F.substr(digits, F.lit(2), n - 2)).when(kind == "phone", F.substr(digits, n - 9, F.lit(10))).when(kind == "ssn", digits)
    # the first group stays; without groups, two digits
    rest = F.when(m.rlike(r"^\+[0-9]{1,3}[ .\-/(]"), n - F.length(F.regexp_extract(m, "^.([0-9]+)", 1))).otherwise(n - 2)
    core = core.when(kind == "intl", F.substr(digits, n - rest + 1, rest)).when(kind == "iban", F.substr(F.replace(m, F.lit(" ")), F.lit(5), F.length(m)))
    core = core.when(kind == "ipv6", F.replace(m, F.lit(":"))).otherwise(m)

    def iban(new: Column) -> Column:
        country = F.substr(m, F.lit(1), F.lit(2))
        return F.concat(country, F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)

    def with_check(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

    def whole(new: Column) -> Column:
        number = F.when(kind == "card", let(F.concat(F.substr(digits, F.lit(1), F.lit(1)), new), with_check)).when(kind == "phone", F.concat(F.substr(digits, F.lit(1), n - 10), new)).otherwise(new)
        number = F.when(kind == "intl", F.concat(F.substr(digits, F.lit(1), n - rest), new)).otherwise(number)
        out = F.when(kind.isin("card", "phone", "ssn", "intl"), let(number, lambda d: regrouped(d, m)))
        out = out.when(kind == "iban", let(iban(new), lambda d: regrouped(d, m, " "))).when(kind == "ipv6", regrouped(new, m, ":"))
        return out.when(kind == "email", F.concat(new, F.lit("@"), F.substring_index(m, "@", -1))).when(kind == "access", F.concat(F.lit("AKIA"), new)).otherwise(new)

    return let(let(core, lambda c: permuted_text(c, key, kind)), whole)


#: Ways to write a date; a date of the last two kinds is read in the first way that makes it one.
DATES = (("-", "yyyy-MM-dd"), (".", "dd.MM.yyyy"), ("/", "MM/dd/yyyy"), ("/", "dd/MM/yyyy"))


def _changed_number(m: Column, kind: Column, key: str) -> Column:
    """ip and date; null if the match is no valid one."""
    octets = F.transform(F.split(m, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("long"))
    address = let(octets, lambda o: F.when(~F.exists(o, lambda x: x > 255), F.aggregate(o, F.lit(0).cast("long"), lambda v, x: v * 256 + x)))
    forms = F.array(*(F.when(m.contains(mark) & F.try_to_timestamp(m, F.lit(form)).isNotNull(), F.struct(F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(DAY_ZERO)).cast("long").alias("value"), F.lit(form).alias("form"))) for mark, form in DATES))
    of = F.when(kind == "ip", F.struct(address.alias("value"), F.lit("").alias("form"))).when(kind == "date", F.try_element_at(F.filter(forms, lambda x: x.isNotNull()), F.lit(1)))
    high, low = F.when(kind == "ip", 1 << 16).otherwise(DAYS_HIGH), F.when(kind == "ip", 1 << 16).otherwise(DAYS_LOW)

    def written(o: Column, v: Column) -> Column:
        day = F.date_add(F.lit(DAY_ZERO).cast("date"), v.cast("int"))
        out = F.when(kind == "ip", F.concat_ws(".", *(F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))))
        for _, form in DATES:
            out = out.when(o["form"] == form, F.date_format(day, form))
        return out

    return let(of, lambda o: F.when(o["value"].isNotNull(), let(permuted_number(o["value"], high, low, key, kind), lambda v: written(o, v))))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The match's pseudonym, or the match itself if it isn't valid."""

    def valid(digits: Column) -> Column:
        fine = F.when(kind == "card", luhn_sum(digits) % 10 == 0).when(kind == "ssn", ~m.rlike("^(?:000|666|9)|-00-|-0000$"))
        fine = fine.when(kind == "intl", F.length(digits).between(8, 15)).when(kind == "iban", let(F.replace(m, F.lit(" ")), lambda x: F.length(x).between(15, 34) & (mod97(F.concat(F.substr(x, F.lit(5), F.length(x)), F.substr(x, F.lit(1), F.lit(4)))) == 1))).otherwise(F.lit(True))
        return F.when(fine, _changed_text(m, digits, kind, key)).otherwise(m)

    return F.when(kind.isin("ip", "date"), F.coalesce(_changed_number(m, kind, key), m)).otherwise(let(_digits(m), valid))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """docs with its text pseudonymised; found_col, if given, gets an array of (kind, value's pseudonym) for each replacement.

    Who knows the key can invert the pseudonyms, so it is asked for and there is no default.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    if found_col in docs.columns:
        raise ValueError(f"the table has a column {found_col}")
    text = F.col(f"`{text_col}`")
    found = F.when(text.rlike(MAY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    names = [c for c in docs.columns]
    temp = "_matches"
    while temp in names:
        temp += "_"
    some = docs.withColumn(temp, F.when(F.size(found) > 0, found))
    changed = F.transform(F.col(temp), lambda m: let(kind_of(m), lambda k: F.struct(k.alias("kind"), m.alias("was"), pseudonym(m, k, key).alias("is"))))
    some = some.withColumn(temp, changed)
    gaps = F.split(text, ANY, -1)
    new = F.array_join(F.zip_with(gaps, F.col(temp), lambda g, m: F.concat(g, F.coalesce(m["is"], F.lit("")))), "")
    columns = [F.when(F.col(temp).isNotNull(), new).otherwise(text).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in names]
    if found_col:
        real = F.filter(F.col(temp), lambda m: m["was"] != m["is"])
        columns.append(F.coalesce(F.transform(real, lambda m: F.struct(m["kind"].alias("kind"), m["is"].alias("pseudonym"))), F.array().cast("array<struct<kind:string,pseudonym:string>>")).alias(found_col))
    return some.select(*columns)
