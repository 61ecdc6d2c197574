"""Format-preserving pseudonyms for personal data, in Spark expressions only.

Card numbers, telephone numbers, social security numbers, IPv4 addresses,
dates and e-mail addresses are found by one pattern and validated (check
digit, ranges, calendar). A valid value is mapped to another of its format by
a Feistel network whose round function is a keyed hash: digits are permuted
among the numbers that validate, a date among the days of 1800 to 2199, the
letters and digits of an e-mail's local part class by class. The same value
gives the same pseudonym in every document, whatever its separators, and two
values never share one. A telephone number goes by its digits: one and ten
digits with a valid area and office are North American, however they are set
apart. A date keeps its order of day and month: with slashes, one whose first
number is above 12 is mapped among its like.

Defined cases: a null text stays null with no finds; a candidate that does
not validate stays as it is; a value that touches letters or digits is part
of a longer word and stays; rows are independent, so ties and repeats need no
rule; an empty table gives an empty result; all other columns are kept, those
named like the operator's own are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "card", "phone", "ssn", "ip", "date")

_CARD = r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}"
_NANP = r"(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}"
_WORLD = r"\+[1-9]\d{0,3}(?:[ .-]?\(?\d{1,5}\)?){1,6}"
_SSN = r"\d{3}-\d{2}-\d{4}"
_IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
# A host name has 253 characters at most, so 127 labels of 63.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,63}"
#: What every candidate has, cheaply found: an at sign, or seven characters of a number.
HINT = r"@|[0-9][0-9 ()./+-]{5,}[0-9]"
CANDIDATE = rf"{_EMAIL}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:{_IP}(?!\.?\d)|{_DATE}|{_SSN}(?!-\d)|{_CARD}|{_NANP}|{_WORLD})(?![A-Za-z0-9])"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prf(key: str, kind: str, i: Column, value: Column) -> Column:
    """A keyed hash as 60 bits."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string"), F.lit(key)), 256)
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("bigint")


def permuted(x: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """The image of ``x``, in [0, a * b), under a keyed permutation of that range."""
    a, b = (F.lit(v).cast("bigint") if isinstance(v, int) else v.cast("bigint") for v in (a, b))
    start = F.struct(F.call_function("div", x, b).alias("l"), F.pmod(x, b).alias("r"))

    def step(h: Column, i: Column) -> Column:
        even = F.struct(F.pmod(h["l"] + F.pmod(_prf(key, kind, i, h["r"]), a), a).alias("l"), h["r"].alias("r"))
        odd = F.struct(h["l"].alias("l"), F.pmod(h["r"] + F.pmod(_prf(key, kind, i, h["l"]), b), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda h: h["l"] * b + h["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _placed(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in order."""

    def char(i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        return F.when((c >= "0") & (c <= "9"), F.substr(digits, F.length(_digits(F.substr(m, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), char), "")


def _power(n: Column) -> Column:
    """10 to a power of 0 to 18, exactly."""
    return F.element_at(F.array(*(F.lit(10**k).cast("bigint") for k in range(19))), n + 1)


def _padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def _luhn_sum(payload: Column) -> Column:
    """The sum of a payload's digits, every other one doubled from the right."""

    def digit(i: Column) -> Column:
        d = F.substr(payload, F.length(payload) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(payload) - 1), digit), F.lit(0), lambda s, d: s + d)


def _check_digit(payload: Column) -> Column:
    return F.pmod(F.lit(10) - F.pmod(_luhn_sum(payload), F.lit(10)), F.lit(10))


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    n = F.length(payload)
    low = F.floor(n / 2).cast("int")
    new = _padded(permuted(payload.cast("bigint"), _power(n - low), _power(low), key, "card"), n)
    valid = (_check_digit(payload) == F.substr(digits, F.length(digits), F.lit(1)).cast("int")) & F.length(digits).between(13, 19) & ~digits.rlike("^0+$")
    made = _let(new, lambda p: _let(F.concat(p, _check_digit(p).cast("string")), lambda d: _placed(m, d)))
    return F.when(valid, made)


def _nanp(m: Column, key: str) -> Column:
    digits = F.right(_digits(m), F.lit(10))
    area, office, line = (F.substring(digits, at, n).cast("bigint") for at, n in ((1, 3), (4, 3), (7, 4)))
    start = ((area - 200) * 800 + office - 200) * 10_000 + line

    def shown(x: Column) -> Column:
        line, rest = F.pmod(x, F.lit(10_000)), F.call_function("div", x, F.lit(10_000))
        return F.concat(_padded(F.call_function("div", rest, F.lit(800)) + 200, 3), _padded(F.pmod(rest, F.lit(800)) + 200, 3), _padded(line, 4))

    code = F.substr(_digits(m), F.lit(1), F.length(_digits(m)) - 10)
    return _let(permuted(start, 80_000, 80_000, key, "nanp"), lambda x: _let(F.concat(code, shown(x)), lambda d: _placed(m, d)))


def _world(m: Column, key: str) -> Column:
    digits = _digits(m)
    tail = F.substr(digits, F.lit(3), F.length(digits))
    n = F.length(tail)
    low = F.floor(n / 2).cast("int")
    new = F.concat(F.substring(digits, 1, 2), _padded(permuted(tail.cast("bigint"), _power(n - low), _power(low), key, "world"), n))
    return F.when(F.length(digits).between(8, 15), _let(new, lambda d: _placed(m, d)))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("bigint") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)

    def shown(x: Column) -> Column:
        rest = F.call_function("div", x, F.lit(9999))
        place = F.call_function("div", rest, F.lit(99))
        area = place + F.when(place >= 665, 2).otherwise(1)
        return F.concat_ws("-", _padded(area, 3), _padded(F.pmod(rest, F.lit(99)) + 1, 2), _padded(F.pmod(x, F.lit(9999)) + 1, 4))

    return F.when(valid, _let(permuted((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn"), shown))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("bigint"))
    x = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s * 256 + p)
    new = permuted(x, 65_536, 65_536, key, "ip")
    octets = _let(new, lambda v: F.concat_ws(".", *(F.pmod(F.shiftright(v, n), F.lit(256)).cast("string") for n in (24, 16, 8, 0))))
    return F.when(F.forall(parts, lambda p: p <= 255), octets)


#: Days of the 400 years from here, a whole calendar cycle: 189 * 773.
_FIRST, _LAST = "1800-01-01", "2199-12-31"


def _day(d: Column, key: str, late: bool = False) -> Column:
    """The permuted date; with ``late`` among the days after a month's 12th."""
    x = F.datediff(d, F.lit(_FIRST).cast("date")).cast("bigint")

    def once(v: Column) -> Column:
        return permuted(v, 189, 773, key, "date")

    def date(v: Column) -> Column:
        return F.date_add(F.lit(_FIRST).cast("date"), v.cast("int"))

    if late:  # again until it is one of them
        x = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(x), lambda v, _: F.when(F.dayofmonth(date(v)) > 12, v).otherwise(once(v)))  # stops changing once it is
    else:
        x = once(x)
    return F.when(d.between(F.lit(_FIRST).cast("date"), F.lit(_LAST).cast("date")), date(x))


def _date(m: Column, key: str) -> Column:
    def parsed(y: Column, month: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    p = F.split(m, "[-/.]")
    wide = F.least(F.length(F.get(p, F.lit(0))), F.length(F.get(p, F.lit(1)))) > 1

    def shown(order: tuple[str, str], sep: str, d: Column) -> Column:
        return _let(d, lambda v: F.when(v.isNotNull(), F.concat_ws(sep, *(F.when(wide, F.date_format(v, x * 2)).otherwise(F.date_format(v, x)) for x in order), F.date_format(v, "yyyy"))))

    iso = F.date_format(_day(parsed(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))), key), "yyyy-MM-dd")
    month_first = parsed(F.get(p, F.lit(2)), F.get(p, F.lit(0)), F.get(p, F.lit(1)))
    day_first = parsed(F.get(p, F.lit(2)), F.get(p, F.lit(1)), F.get(p, F.lit(0)))
    slashed = F.when(F.get(p, F.lit(0)).cast("int") <= 12, shown(("M", "d"), "/", _day(month_first, key))).otherwise(shown(("d", "M"), "/", _day(day_first, key, late=True)))
    dotted = shown(("d", "M"), ".", _day(day_first, key))
    valid = F.coalesce(month_first, day_first).isNotNull()
    return F.when(m.rlike("^.{4}-"), iso).when(F.contains(m, F.lit("/")), F.when(valid, slashed)).otherwise(F.when(day_first.isNotNull(), dotted))


def _shifted(text: Column, hashed: Column) -> Column:
    """Letters and digits moved within their class by the bytes of a hash."""

    def char(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        by = F.conv(F.substr(hashed, F.pmod(i - 1, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def within(first: str, n: int) -> Column:
            return F.char(F.lit(ord(first)) + F.pmod(F.ascii(c) - ord(first) + by, F.lit(n)))

        return F.when(c.rlike("[0-9]"), within("0", 10)).when(c.rlike("[a-z]"), within("a", 26)).when(c.rlike("[A-Z]"), within("A", 26)).otherwise(c)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), char), ""))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    half = F.floor(F.length(local) / 2).cast("int")

    def hashed(i: Column, other: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other, F.lit(key)), 256)

    def step(h: Column, i: Column) -> Column:
        even = _let(hashed(i, h["r"]), lambda x: F.struct(_shifted(h["l"], x).alias("l"), h["r"].alias("r")))
        odd = _let(hashed(i, h["l"]), lambda x: F.struct(h["l"].alias("l"), _shifted(h["r"], x).alias("r")))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1, F.length(local)).alias("r"))
    new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda h: F.concat(h["l"], h["r"]))
    return F.concat(new, F.substr(m, F.length(local) + 1, F.length(m)))


def _item(m: Column, key: str) -> Column:
    """The kind of a candidate and its pseudonym, both null if it does not validate."""

    def of(kind: str, new: Column) -> Column:
        return _let(new, lambda x: F.struct(F.when(x.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(x, m).alias("text")))

    return (
        F.when(F.contains(m, F.lit("@")), of("email", _email(m, key)))
        .when(m.rlike(f"^(?:{_IP})$"), of("ip", _ip(m, key)))
        .when(m.rlike(f"^(?:{_DATE})$"), of("date", _date(m, key)))
        .when(m.rlike(f"^(?:{_SSN})$"), of("ssn", _ssn(m, key)))
        .when(m.rlike(f"^(?:{_CARD})$"), of("card", _card(m, key)))
        .when(m.rlike(f"^(?:{_NANP})$") | _digits(m).rlike("^1[2-9][0-9]{2}[2-9][0-9]{6}$"), of("phone", _nanp(m, key)))
        .otherwise(of("phone", _world(m, key)))
    )


def _scanned(docs: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """``docs`` with two columns of what was found and what stands for it, and the new text."""
    text = F.col("text").cast("string")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    rows = docs.withColumn("__pii_found", found)
    rows = rows.withColumn("__pii_items", F.when(F.size("__pii_found") > 0, F.transform("__pii_found", lambda m: _item(m, key))))
    between = F.split(text, CANDIDATE, -1)
    new = F.array_join(F.zip_with(between, F.concat(F.transform("__pii_items", lambda x: x["text"]), F.array(F.lit(""))), lambda s, x: F.concat(s, x)), "")
    return rows, F.when(F.col("__pii_items").isNull(), text).otherwise(new).alias("text")


def redact(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced, and n_chars, if there, brought up to date."""
    rows, text = _scanned(docs, key)
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced, and n_email ... n_date."""
    own = [f"n_{k}" for k in KINDS]
    rows, text = _scanned(docs, key)

    def count(kind: str) -> Column:
        n = F.size(F.filter("__pii_items", lambda x: F.coalesce(x["kind"] == kind, F.lit(False))))
        return F.when(F.col("__pii_items").isNull(), F.lit(0)).otherwise(n).cast("bigint").alias(f"n_{kind}")

    return rows.select(*(text if c == "text" else c for c in docs.columns if c not in own), *map(count, KINDS))
