"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel networks.

One pass finds e-mail addresses, IPv4 addresses, dates, social security numbers, North American phone
numbers and payment cards in whole texts. Each find is validated (octets, calendar, number ranges,
Luhn). A valid one is split into two halves of mixed-radix digits, and eight rounds add keyed hashes
of one half to the other, digit by digit modulo the radix: a permutation of the valid values of the
format. Separators, length and letter case stay; a card keeps a right check digit, a date stays a
date. Networks run on the bare value, so a value gets the same pseudonym in every document and
notation. Only DataFrame functions are used.

Null texts stay null with zero counts; empty and find-free texts come back as they are. Texts are read whole,
whatever their length: every repetition in the patterns is bounded, by the longest forms that are valid (names
of 64, labels of 63 characters, 127 labels), so no text exhausts the stack or takes more than linear time. Finds that do
not validate stay, uncounted. Dates outside 1000-01-01 to 2998-09-10 do not validate; of 03/04/2020 the first
number is the day if it can be, and dates stay in their notation. Repeated rows get equal results.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "date", "ssn", "phone", "card")
_FREE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
PATTERN = "|".join(
    (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}+(?![A-Za-z])",
        r"(?<![0-9A-Za-z.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9A-Za-z]|\.\d)",
        _FREE + r"\d{4}-\d{2}-\d{2}(?![0-9A-Za-z-])",
        _FREE + r"\d{2}([/.])\d{2}\1\d{4}" + _END,
        r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])",
        r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + _END,
        _FREE + r"\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}" + _END,
        _FREE + r"\d{13,19}" + _END,
    )
)
ROUNDS = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    """A keyed permutation of mixed-radix digit arrays; a digit of radix 1 stays."""
    return let(F.struct(values.alias("v"), radices.alias("r")), lambda x: _feistel(x["v"], x["r"], key, kind))


def _feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    n, half = F.size(radices), (F.size(radices) / 2).cast("int")

    def step(state: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(state, half + 1, n - half)).otherwise(F.slice(state, F.lit(1), half)).cast("array<string>")

        def moved(word: Column) -> Column:
            def digit(v: Column, i: Column) -> Column:
                add = F.conv(F.substring(F.sha2(F.concat(word, i.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long")
                return F.when((i < half) == left, ((v + add) % F.get(radices, i)).cast("int")).otherwise(v)

            return F.transform(state, digit)

        return let(F.concat_ws("|", F.lit(key), F.lit(kind), n, r, F.array_join(other, ","), F.lit("")), moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, step)


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))


def _digits(text: Column) -> Column:
    return F.transform(_chars(text), lambda c: c.cast("int"))


def _refilled(text: Column, digits: Column) -> Column:
    """The digits of ``text`` replaced in order, everything else in place."""

    def filled(new: Column) -> Column:
        def at(i: Column) -> Column:
            c = F.substr(text, i, F.lit(1))
            before = F.length(F.regexp_replace(F.substr(text, F.lit(1), i), "[^0-9]", ""))
            return F.when(c.rlike("[0-9]"), F.substr(new, before, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), at), "")

    return let(digits, filled)


def _joined(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), "")


def _repeat(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), n.cast("int"))


def _email(m: Column, key: str) -> Column:
    return let(_chars(F.substring_index(m, "@", 1)), lambda chars: _email_of(m, chars, key))


def _email_of(m: Column, chars: Column, key: str) -> Column:

    def radix(c: Column) -> Column:
        return F.when(c.rlike("[A-Za-z]"), 26).when(c.rlike("[0-9]"), 10).otherwise(1)

    def base(c: Column) -> Column:
        return F.when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(48)

    values = F.transform(chars, lambda c: F.when(radix(c) > 1, F.ascii(c) - base(c)).otherwise(0).cast("int"))
    new = feistel(values, F.transform(chars, radix), key, "email")
    letters = F.zip_with(chars, new, lambda c, v: F.when(radix(c) > 1, F.char(base(c) + v)).otherwise(c))
    return F.concat(F.array_join(letters, ""), F.lit("@"), F.substring_index(m, "@", -1))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    new = F.array_join(feistel(octets, _repeat(256, F.lit(4)), key, "ip").cast("array<string>"), ".")
    return F.when(F.forall(octets, lambda x: x < 256), new)


_DAYS, _FIRST = (1000, 730), "1000-01-01"


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    year = F.when(iso, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4)).cast("int")
    one = F.when(iso, F.substring(m, 9, 2)).otherwise(F.substring(m, 1, 2)).cast("int")
    two = F.when(iso, F.substring(m, 6, 2)).otherwise(F.substring(m, 4, 2)).cast("int")
    day_first = F.try_to_date(F.format_string("%04d-%02d-%02d", year, two, one), "yyyy-MM-dd")
    month_first = F.when(~iso, F.try_to_date(F.format_string("%04d-%02d-%02d", year, one, two), "yyyy-MM-dd"))
    number = F.datediff(F.coalesce(day_first, month_first), F.lit(_FIRST).cast("date"))
    return let(F.struct(number.alias("n"), day_first.isNotNull().alias("d")), lambda x: _date_of(m, x["n"], iso, x["d"], key))


def _date_of(m: Column, number: Column, iso: Column, day_first: Column, key: str) -> Column:
    parts = F.array((number / _DAYS[1]).cast("int"), (number % _DAYS[1]).cast("int"))
    new = feistel(parts, F.array(*map(F.lit, _DAYS)), key, "date")
    moved = let(new, lambda x: F.date_add(F.lit(_FIRST).cast("date"), F.get(x, F.lit(0)) * _DAYS[1] + F.get(x, F.lit(1))))
    return F.when((number >= 0) & (number < _DAYS[0] * _DAYS[1]), let(moved, lambda d: _date_text(m, d, iso, day_first)))


def _date_text(m: Column, moved: Column, iso: Column, day_first: Column) -> Column:
    text = F.when(iso, F.date_format(moved, "yyyy-MM-dd")).when(day_first, F.date_format(moved, "dd-MM-yyyy")).otherwise(F.date_format(moved, "MM-dd-yyyy"))
    return F.when(iso, text).otherwise(F.replace(text, F.lit("-"), F.substring(m, 3, 1)))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    new = feistel(F.array(place, group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")

    def text(x: Column) -> Column:
        back = F.when(F.get(x, F.lit(0)) >= 665, F.get(x, F.lit(0)) + 2).otherwise(F.get(x, F.lit(0)) + 1)
        return F.format_string("%03d-%02d-%04d", back, F.get(x, F.lit(1)) + 1, F.get(x, F.lit(2)) + 1)

    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, let(new, text))


def _phone(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    values = F.transform(_digits(F.right(digits, F.lit(10))), lambda v, i: F.when(i.isin(0, 3), v - 2).otherwise(v))
    radices = F.array(*(F.lit(8 if i in (0, 3) else 10) for i in range(10)))
    new = F.transform(feistel(values, radices, key, "phone"), lambda v, i: F.when(i.isin(0, 3), v + 2).otherwise(v))
    whole = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), _joined(new))
    return F.when(F.forall(values, lambda v: v >= 0), _refilled(m, whole))


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = _digits(F.substr(digits, F.lit(1), F.length(digits) - 1))
    new = feistel(body, _repeat(10, F.size(body)), key, "card")

    def luhn(v: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)).otherwise(v)

    def whole(x: Column) -> Column:
        total = F.aggregate(F.transform(F.reverse(x), luhn), F.lit(0), lambda a, v: (a + v).cast("int"))
        return F.concat(_joined(x), ((10 - total % 10) % 10).cast("string"))

    return F.when(F.call_function("luhn_check", digits), _refilled(m, let(new, whole)))


_MADE = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _kind(m: Column) -> Column:
    kind = F.when(m.contains("@"), "email").when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
    kind = kind.when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4})$"), "date").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    return kind.when(m.rlike(r"^(\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{13,19})$"), "card").otherwise("phone")


def pseudonyms(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_email, n_ip, n_date, n_ssn, n_phone, n_card): whole texts with pseudonyms in place."""

    def replaced(m: Column) -> Column:
        def made(kind: Column) -> Column:
            out = F.lit(None).cast("string")
            for name, make in _MADE.items():
                out = F.when(kind == name, make(m, key)).otherwise(out)
            return let(out, lambda x: F.struct(F.coalesce(x, m).alias("to"), F.when(x.isNotNull(), kind).alias("kind")))

        return let(_kind(m), made)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_found", found).withColumn("_new", F.transform("_found", replaced))
    parts = F.split("text", PATTERN, -1)
    text = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("_new"), i)["to"], F.lit("")))), "")
    text = F.when(F.size("_new") > 0, text).otherwise(F.col("text"))
    counts = [F.coalesce(_count(kind), F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", text.alias("text"), *counts)


def _count(kind: str) -> Column:
    return F.size(F.filter(F.col("_new"), lambda x: x["kind"] == kind))
