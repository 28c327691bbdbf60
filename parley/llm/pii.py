r"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Found values keep their shape: each character is permuted within its own alphabet (digits, lower or upper case letters,
Latin-1 letters), separators stay. The permutation is a keyed Feistel network over the two halves of the string, so
equal values stay equal in every document and different values stay different. Values with a validity rule are mapped
onto valid values only:

* card numbers (Luhn): all digits but the last are permuted, the check digit is recomputed; invalid numbers stay;
* IPv4 addresses (octets up to 255): the eight hexadecimal digits are permuted;
* US social security numbers: area, group and serial are permuted within their valid ranges by a network of mixed radix;
* dates from 1900 to 2099 (``yyyy-MM-dd``, ``dd/MM/yyyy``, ``d/M/yyyy``, ``d.M.yyyy``, each with one or two digits): the
  day's number is permuted within these two centuries; a date with slashes whose second number is over 12 is read month
  first, and its month and day of the month (up to 28) are permuted among such dates, of later days the year;
* phone numbers keep the country code (``+`` and 8 to 15 digits with or without separators) or are national
  (``(ddd) ddd-dddd``, ``ddd-ddd-dddd``); their digits alone are permuted, so one number has one pseudonym in all spellings;
* mail addresses keep the top-level domain, letters of other scripts move within their script's block (``SCRIPTS``; those
  of scripts that are not listed stay); domains of any number of dots are permuted up to
  their last label that begins with two letters; hexadecimal secrets of 32 to 64 digits stay hexadecimal.

Other formats of numbers, names and postal addresses stay. The key is the caller's: who knows it can take the pseudonyms
back. It comes to the rows as the result of a subquery over a one-row table, so no plan or event log shows it.

Defined cases: null texts stay null, empty ones empty; texts of any length are treated whole; other columns are kept,
whatever their names, null ids too; repeated rows are treated alike; an empty table stays empty.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_SETTING = "spark.parley.pseudonym.key"

ROUNDS = 8
# What the characters of found values are permuted within.
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LATIN_LOWER = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
LATIN_UPPER = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
PLAIN = (DIGITS, LOWER, UPPER, LATIN_LOWER, LATIN_UPPER)
# First and last code point of the blocks of letters of other scripts (of Latin with marks, Greek, Cyrillic,
# Hebrew, Arabic, Devanagari, Thai, Kana, Han and Hangul).
SCRIPTS = [
    (0x0100, 0x017F), (0x0391, 0x03A1), (0x03A3, 0x03A9), (0x03AC, 0x03CE), (0x0400, 0x040F), (0x0410, 0x042F), (0x0430, 0x044F), (0x0450, 0x045F), (0x05D0, 0x05EA), (0x0621, 0x063A),
    (0x0641, 0x064A), (0x0904, 0x0939), (0x0E01, 0x0E30), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
]
# Country codes of telephone numbers; all that do not begin like these have three digits.
COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
HEX_LOWER = ("0123456789abcdef",)
HEX_UPPER = ("0123456789ABCDEF",)

# The formats looked for.
LONG_MAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++){127,}+"
MAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]+){0,126}\.\p{L}{2,}"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
PHONE = (
    r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){1,4}(?![\d\-])"
    r"|(?<![\w+(])(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?![\d\-])"
)
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
DATE = r"(?<![\d/.\-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/\-]|\.\d)"
CARD = r"(?<![\d.])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})(?!\d)"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
FIRST_DAY, CENTURIES = "1900-01-01", (17, 4297)  # 73,049 days
LATE_DAYS, YEARS, LEAP_YEARS = (2400, 16), (20, 10), (7, 7)  # days 13 to 28 of each month, and the years
SSN_RADIX = (898 * 99, 9999)
# The card number comes first: its separators are the first groups. All but mail addresses begin with few characters.
NUMBERS = r"(?=[0-9+(A-Fa-f])(?:" + "|".join((CARD, SECRET, IPV4, PHONE, SSN, DATE)) + ")"
ANY = f"{NUMBERS}|{LONG_MAIL}|{MAIL}"
#: Every format but a mail address has two digits in a row or with a dot between, or is hexadecimal; this test is cheap.
MAYBE = r"[0-9]\.?[0-9]|[A-F]{32}|[a-f]{32}"


def key_of(spark: SparkSession) -> str:
    """The key that the session names; else one that lives as long as the application, so nobody can take it back."""
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        named = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, named)
    return named


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


Key = str | Column


def _for(key: Key, kind: str) -> Column:
    """The key of one kind of value."""
    return F.concat(F.lit(key), F.lit(f"|{kind}"))


def _stream(key: Key, label: Column, seed: Column) -> Column:
    """64 hexadecimal digits that depend on the key, the round and the other half."""
    return F.sha2(F.concat(F.lit(key), F.lit("|"), label.cast("string"), F.lit("|"), seed), 256)


def _in_script(c: Column, by: Column) -> Column:
    """A letter moved within its script's block; any other character as it is."""
    point = F.ascii(c)
    blocks = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b - a + 1).alias("size")) for a, b in SCRIPTS))
    own = F.filter(blocks, lambda b: (point >= b["first"]) & (point < b["first"] + b["size"]))
    moved = F.transform(own, lambda b: b["first"] + F.pmod(point - b["first"] + by * 83, b["size"]))
    return F.when(F.size(own) > 0, F.decode(F.unhex(F.lpad(F.hex(moved[0]), 4, "0")), "UTF-16BE")).otherwise(c)


def _shifted(half: Column, stream: Column, alphabets: tuple[str, ...], sign: int) -> Column:
    """Each character moved within its alphabet by the stream's bytes, which repeat after 32 characters."""

    letters = F.lit("".join(alphabets))
    # Of each letter's alphabet, where it starts and how many letters it has.
    starts = F.expr(f"array({', '.join(str(len(''.join(alphabets[:k]))) for k, a in enumerate(alphabets) for _ in a)})")
    sizes = F.expr(f"array({', '.join(str(len(a)) for a in alphabets for _ in a)})")

    def moved_by(stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            at, by = F.instr(letters, c), F.conv(stream.substr(i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
            start = F.get(starts, at - 1)
            known = F.when(at > 0, letters.substr(start + F.pmod(at - 1 - start + by * sign, F.get(sizes, at - 1)) + 1, F.lit(1)))
            return known.when(F.ascii(c) > 255, _in_script(c, by * sign)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    return _let(stream, moved_by)


def permute_text(value: Column, key: Key, alphabets: tuple[str, ...] = PLAIN, inverse: bool = False) -> Column:
    """A keyed bijection of strings onto strings of the same shape. Values of one character are only shifted by the key."""
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if inverse else 1

    def step(acc: Column, r: Column) -> Column:
        even = F.pmod(r, F.lit(2)) == 0
        return F.when(even, F.struct(_shifted(acc["a"], _stream(key, r, acc["b"]), alphabets, sign).alias("a"), acc["b"].alias("b"))).otherwise(
            F.struct(acc["a"].alias("a"), _shifted(acc["b"], _stream(key, r, acc["a"]), alphabets, sign).alias("b"))
        )

    def permuted(value: Column) -> Column:
        cut = F.floor(F.length(value) / 2).cast("int")
        start = F.struct(value.substr(F.lit(1), cut).alias("a"), value.substr(cut + 1, F.length(value)).alias("b"))
        return F.aggregate(F.reverse(rounds) if inverse else rounds, start, step, lambda acc: F.concat(acc["a"], acc["b"]))

    return _let(value, permuted)


def permute_index(value: Column, radix: tuple[int, int], key: Key) -> Column:
    """A keyed permutation of ``0 .. a * b - 1``."""
    a, b = radix
    start = F.struct(F.pmod(value, F.lit(a)).cast("bigint").alias("a"), F.floor(value / a).cast("bigint").alias("b"))

    def step(acc: Column, r: Column) -> Column:
        even = F.pmod(r, F.lit(2)) == 0
        noise = lambda half: F.conv(_stream(key, r, half.cast("string")).substr(1, 12), 16, 10).cast("bigint")
        return F.struct(
            F.when(even, F.pmod(acc["a"] + noise(acc["b"]), F.lit(a))).otherwise(acc["a"]).cast("bigint").alias("a"),
            F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + noise(acc["a"]), F.lit(b))).cast("bigint").alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc["b"] * a + acc["a"])


def _refill(shape: Column, digits: Column) -> Column:
    """``digits`` in the places that ``shape`` has for digits."""
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        own = c.rlike("[0-9]")
        return F.struct(
            F.concat(acc["out"], F.when(own, digits.substr(acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(own, acc["at"] + 1).otherwise(acc["at"]).alias("at"),
        )

    return F.aggregate(F.split(shape, ""), zero, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _card(value: Column, key: Key) -> Column:
    def made(plain: Column) -> Column:
        body = permute_text(plain.substr(F.lit(1), F.length(plain) - 1), _for(key, "card"))
        full = _let(body, lambda b: F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(b, d.cast("string"))), _luhn)[0])
        return F.when(_luhn(plain), _refill(value, full)).otherwise(value)

    return _let(_digits(value), made)


def _ipv4(value: Column, key: Key) -> Column:
    parts = F.split(value, r"\.")
    packed = F.array_join(F.transform(parts, lambda p: F.lpad(F.lower(F.hex(p.cast("int").cast("bigint"))), 2, "0")), "")
    moved = permute_text(packed, _for(key, "ipv4"), HEX_LOWER)
    shown = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(moved.substr(k * 2 + 1, F.lit(2)), 16, 10)), ".")
    return F.when(F.forall(parts, lambda p: p.cast("int") <= 255), shown).otherwise(value)


def _ssn(value: Column, key: Key) -> Column:
    area, group, serial = (value.substr(a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    moved = permute_index((rank * 99 + group - 1).cast("bigint") + (serial - 1).cast("bigint") * SSN_RADIX[0], SSN_RADIX, _for(key, "ssn"))
    head, tail = F.pmod(moved, F.lit(SSN_RADIX[0])), F.floor(moved / SSN_RADIX[0])
    new_rank = F.floor(head / 99)
    new_area = new_rank + 1 + F.when(new_rank >= 665, 1).otherwise(0)
    shown = F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((F.pmod(head, F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((tail + 1).cast("string"), 4, "0"))
    return F.when(valid, shown).otherwise(value)


def _day_first(value: Column, day: Column, key: Key) -> Column:
    """The date permuted among all days, written as ``value`` is: order, separator, and two digits if it has them."""
    index = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), permute_index(index.cast("bigint"), CENTURIES, _for(key, "date")).cast("int"))
    dots, full = value.contains("."), F.length(value) == 10

    def shown(day: Column) -> Column:
        wide = F.when(dots, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
        short = F.when(dots, F.date_format(day, "d.M.yyyy")).otherwise(F.date_format(day, "d/M/yyyy"))
        return F.when(value.substr(5, 1) == "-", F.date_format(day, "yyyy-MM-dd")).when(full, wide).otherwise(short)

    return F.when(index.between(0, CENTURIES[0] * CENTURIES[1] - 1), _let(moved, shown)).otherwise(value)


def _month_first(value: Column, day: Column, key: Key) -> Column:
    """A date that can only be read month first, permuted among those."""
    year, month, of_month = F.year(day), F.month(day), F.dayofmonth(day)
    index = (year - 1900) * 12 + month - 1 + (of_month - 13) * LATE_DAYS[0]
    moved = permute_index(index.cast("bigint"), LATE_DAYS, _for(key, "month first"))
    usual = _let(moved, lambda m: F.make_date(1900 + F.floor(F.pmod(m, F.lit(LATE_DAYS[0])) / 12).cast("int"), (F.pmod(F.pmod(m, F.lit(LATE_DAYS[0])), F.lit(12)) + 1).cast("int"), (13 + F.floor(m / LATE_DAYS[0])).cast("int")))
    leap = F.make_date((1904 + 4 * permute_index(((year - 1904) / 4).cast("bigint"), LEAP_YEARS, _for(key, "leap"))).cast("int"), month, of_month)
    late = F.make_date((1900 + permute_index((year - 1900).cast("bigint"), YEARS, _for(key, "year"))).cast("int"), month, of_month)
    new = F.when(of_month <= 28, usual).when(month == 2, leap).otherwise(late)
    shown = _let(new, lambda d: F.when(F.length(value) == 10, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "M/d/yyyy")))
    return F.when(year.between(1900, 2099), shown).otherwise(value)


def _date(value: Column, key: Key) -> Column:
    parts = F.split(value, "[./-]")
    iso = value.substr(5, 1) == "-"
    day = F.try_to_date(F.when(iso, value).otherwise(F.concat_ws("-", parts[2], F.lpad(parts[1], 2, "0"), F.lpad(parts[0], 2, "0"))), "yyyy-MM-dd")
    other = F.when(value.contains("/"), F.try_to_date(F.concat_ws("-", parts[2], F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0")), "yyyy-MM-dd"))
    return F.when(day.isNotNull(), _let(day, lambda d: _day_first(value, d, key))).when(other.isNotNull(), _let(other, lambda d: _month_first(value, d, key))).otherwise(value)


def _phone(value: Column, key: Key) -> Column:
    def made(digits: Column) -> Column:
        head = F.when(value.startswith("+"), F.regexp_extract(digits, COUNTRY, 0)).otherwise("")
        moved = F.concat(head, permute_text(digits.substr(F.length(head) + 1, F.length(digits)), _for(key, "phone")))
        return F.when(F.length(digits).between(8, 15), _refill(value, moved)).otherwise(value)

    return _let(_digits(value), made)


def _mail(value: Column, key: Key) -> Column:
    """An address up to its last label that begins with two letters; what follows that is none of it."""

    def made(own: Column) -> Column:
        tld = F.regexp_extract(own, r"\.\p{L}+$", 0)
        moved = _let(tld, lambda t: F.concat(permute_text(own.substr(F.lit(1), F.length(own) - F.length(t)), _for(key, "mail")), t))
        return F.when(own == "", value).otherwise(F.concat(moved, value.substr(F.length(own) + 1, F.length(value))))

    return _let(F.regexp_extract(value, r"(?s)^.*\.\p{L}{2,}", 0), made)


def pseudonym(value: Column, key: Key) -> Column:
    """The pseudonym of one found value; values that turn out not to be valid stay."""
    return (
        F.when(value.contains("@"), _mail(value, key))
        .when(value.rlike(f"^(?:{SSN})$"), _ssn(value, key))
        .when(value.rlike(r"^\+|^\(|^\d{3}-\d{3}-"), _phone(value, key))
        .when(value.rlike(f"^(?:{DATE})$"), _date(value, key))
        .when(value.rlike(f"^(?:{IPV4})$"), _ipv4(value, key))
        .when(value.rlike(r"^[0-9a-f]{32,64}$"), permute_text(value, _for(key, "secret"), HEX_LOWER))
        .when(value.rlike(r"^[0-9A-F]{32,64}$"), permute_text(value, _for(key, "secret"), HEX_UPPER))
        .otherwise(_card(value, key))
    )


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with the found values of ``text_col`` replaced; every other column as it was."""
    own = "key"
    while own.lower() in (c.lower() for c in df.columns):
        own += "_"
    # A literal would stand in every plan.
    keyed = df.withColumn(own, df.sparkSession.createDataFrame([(key,)], "k string").scalar())
    text, secret = keyed[f"`{text_col}`"], keyed[f"`{own}`"]
    mail = text.contains("@")
    between = F.when(mail, F.split(text, ANY, -1)).otherwise(F.split(text, NUMBERS, -1))
    found = F.when(mail, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)))
    # split() gives one piece more than there are matches.
    woven = F.zip_with(between, found, lambda piece, hit: F.concat(piece, F.when(hit.isNull(), "").otherwise(pseudonym(hit, secret))))
    some = F.when(mail, text.rlike(ANY)).otherwise(text.rlike(MAYBE) & text.rlike(NUMBERS))
    return keyed.withColumn(text_col, F.when(some, F.array_join(woven, "")).otherwise(text)).select(*(F.col(f"`{c}`") for c in df.columns))
