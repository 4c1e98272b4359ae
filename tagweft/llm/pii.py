r"""PII: format-preserving pseudonyms from a keyed Feistel network, in DataFrame operations only.

Found and validated: e-mail addresses, telephone numbers (North American, and
international ones with a plus sign), payment card numbers (13-19 digits whose
Luhn sum holds), United States social security numbers, IPv4 addresses, and dates
(yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy, and dd/mm/yyyy where only that reading is a
date; years 1800 to 2199). What fails validation stays as it is.

Each value is a row of digits in mixed radices, which a Feistel network of
``ROUNDS`` rounds permutes: in turn, each half gets keyed hashes of the other added,
place by place, modulo the radix. So a value maps to one of its own format, one to
one, and equal values map to equal ones in all documents, however their separators
differ. A card number gets its check digit anew; a date is a day of a 400-year cycle
(189 * 773 days); an address keeps its domain; a number keeps its separators and
its plus sign and country code.

Null text stays null and counts no values; an empty text stays empty, an empty table
gives an empty one. Rows are handled one by one, without a shuffle, so repeated rows and
ids, null ids, and other columns of any name are of no account; only the text and the
count are replaced. Texts of any length are searched as a whole, in the memory of a few
copies of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import private

ROUNDS = 8
MARK, ESCAPE = "\x01", "\x02"

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z])"
ISO = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
DOTTED = r"(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\d)"
SLASHED = r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\d+])(?:(?:\+?1[ .\-]?)?\(\d{3}\) ?\d{3}[ .\-]\d{4}|(?:\+?1[ .\-])?\d{3}[.\-]\d{3}[.\-]\d{4}|\+1[ .\-]?\d{3}[ .\-]?\d{3}[ .\-]?\d{4}|\+[2-9]\d{7,14}|\+[2-9]\d{0,2}(?:[ .\-]\d{2,8}){2,4})(?!\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}(?:[ \-]\d{1,3})?|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)"
ANY = "|".join([EMAIL, ISO, DOTTED, SLASHED, IPV4, SSN, PHONE, CARD])


def network(values: Column, radices: Column, key: str, kind: str) -> Column:
    """The values (array of bigint) permuted within their radices."""
    n = F.size(values)
    cut = F.floor(n / 2).cast("int")

    def half(x: Column, left: bool) -> Column:
        return F.slice(x, F.lit(1), cut) if left else F.slice(x, cut + 1, n - cut)

    def added(own: Column, other: Column, radix: Column, turn: Column) -> Column:
        seen = F.array_join(F.transform(other, lambda x: x.cast("string")), ",")

        def stream(i: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), i.cast("string"), seen), 256)
            return F.conv(F.substring(digest, 1, 10), 16, 10).cast("bigint")

        return F.transform(own, lambda x, i: F.pmod(x + stream(i), F.get(radix, i)))

    def step(now: Column, turn: Column) -> Column:
        left, right = now["l"], now["r"]
        even = turn % 2 == 0
        return F.struct(
            F.when(even, added(left, right, half(radices, True), turn)).otherwise(left).alias("l"),
            F.when(even, right).otherwise(added(right, left, half(radices, False), turn)).alias("r"),
        )

    turns = F.array(*[F.lit(i) for i in range(ROUNDS)])
    start = F.struct(half(values, True).alias("l"), half(values, False).alias("r"))
    return F.aggregate(turns, start, step, lambda x: F.concat(x["l"], x["r"]))


def _longs(*items: Column) -> Column:
    return F.array(*[i.cast("bigint") for i in items])


def digits(text: Column, key: str, kind: str) -> Column:
    """A string of digits of the same length."""
    values = F.transform(F.split(text, ""), lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")))
    radices = F.transform(values, lambda _: F.lit(10).cast("bigint"))
    return F.array_join(F.transform(network(values, radices, key, kind), lambda x: x.cast("string")), "")


def letters(text: Column, key: str, kind: str) -> Column:
    """Lower-case letters, upper-case letters and digits within their kind, other characters as they are."""
    chars = F.split(text, "")

    def first(c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65)

    values = F.transform(chars, lambda c: F.coalesce(F.ascii(c) - first(c), F.lit(0)).cast("bigint"))
    radices = F.transform(chars, lambda c: F.when(first(c) == 48, 10).when(first(c).isNotNull(), 26).otherwise(1).cast("bigint"))
    new = network(values, radices, key, kind)
    return F.array_join(F.transform(chars, lambda c, i: F.when(first(c).isNull(), c).otherwise(F.char(F.get(new, i) + first(c)))), "")


def refilled(shape: Column, new: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of ``new``."""
    chars = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(now: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(now["out"], F.when(digit, F.substring(new, now["at"], F.lit(1))).otherwise(c)).alias("out"),
            (now["at"] + F.when(digit, 1).otherwise(0)).alias("at"),
        )

    return F.aggregate(chars, start, step, lambda x: x["out"])


def luhn_sum(number: Column) -> Column:
    """The Luhn sum of a string of digits."""

    def worth(c: Column, i: Column) -> Column:
        d = F.coalesce(c.cast("int"), F.lit(0))
        twice = 2 * d
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), worth), F.lit(0), lambda a, b: a + b)


def _card(value: Column, key: str) -> Column:
    only = F.regexp_replace(value, "[^0-9]", "")
    body = digits(F.substring(only, F.lit(1), F.length(only) - 1), key, "card")
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(only) % 10 == 0, refilled(value, F.concat(body, check.cast("string")))).otherwise(value)


def _phone(value: Column, key: str) -> Column:
    """The last ten digits change, or of an international number all after its first two."""
    only = F.regexp_replace(value, "[^0-9]", "")
    american = value.rlike(r"^(\+?1[ .\-]?)?\(|^(\+?1[ .\-])?\d{3}[.\-]|^\+1")
    keep = F.when(american, F.length(only) - 10).otherwise(F.lit(2))
    new = F.concat(F.substring(only, F.lit(1), keep), digits(F.substring(only, keep + 1, F.length(only) - keep), key, "phone"))
    return F.when((F.length(only) >= 8) & (F.length(only) <= 15), refilled(value, new)).otherwise(value)


def _ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("bigint"))
    valid = F.forall(parts, lambda x: x <= 255)
    radices = F.transform(parts, lambda _: F.lit(256).cast("bigint"))
    new = F.array_join(F.transform(network(parts, radices, key, "ip"), lambda x: x.cast("string")), ".")
    return F.when(valid, new).otherwise(value)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area < 666, area - 1).otherwise(area - 2)
    new = network(_longs(place, group - 1, serial - 1), _longs(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
    back = F.get(new, F.lit(0)) + 1
    back = F.when(back < 666, back).otherwise(back + 1)
    text = F.format_string("%03d-%02d-%04d", back, F.get(new, F.lit(1)) + 1, F.get(new, F.lit(2)) + 1)
    return F.when(valid, text).otherwise(value)


def _day(date: Column, key: str) -> Column:
    """A day of 1800-2199 for another; 400 years are 189 * 773 days."""
    first = F.to_date(F.lit("1800-01-01"))
    day = F.datediff(date, first).cast("bigint")
    new = network(_longs(F.floor(day / 773), day % 773), _longs(F.lit(189), F.lit(773)), key, "date")
    return F.date_add(first, (F.get(new, F.lit(0)) * 773 + F.get(new, F.lit(1))).cast("int"))


def _date(value: Column, key: str) -> Column:
    out = value
    for shape, pattern in (("dd/MM/yyyy", r"^../../....$"), ("MM/dd/yyyy", r"^../../....$"), ("dd.MM.yyyy", r"^..\...\.....$"), ("yyyy-MM-dd", r"^....-..-..$")):
        at = {f: shape.index(f) + 1 for f in ("yyyy", "MM", "dd")}
        date = F.try_to_date(F.concat_ws("-", F.substring(value, at["yyyy"], 4), F.substring(value, at["MM"], 2), F.substring(value, at["dd"], 2)), "yyyy-MM-dd")
        year = F.year(date)
        out = F.when(value.rlike(pattern) & date.isNotNull() & (year >= 1800) & (year <= 2199), F.date_format(_day(date, key), shape)).otherwise(out)
    return out


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; itself if it is not valid."""

    def whole(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    at = F.instr(value, "@")
    email = F.concat(letters(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.length(value)))
    return (
        F.when(at > 0, email)
        .when(whole(f"{ISO}|{DOTTED}|{SLASHED}"), _date(value, key))
        .when(whole(IPV4), _ip(value, key))
        .when(whole(SSN), _ssn(value, key))
        .when(whole(PHONE), _phone(value, key))
        .otherwise(_card(value, key))
    )


def pseudonymised(documents: DataFrame, key: str, text: str = "text", count: str = "n_pseudonyms") -> DataFrame:
    """``documents`` with the values in ``text`` replaced, and the number of changed values as ``count``.

    Texts without a digit or ``@`` hold none and are passed by. Marks around values
    are two control characters; where a text has them itself, they are escaped.
    """
    own = F.col(text)
    safe = F.replace(F.replace(own, F.lit(ESCAPE), F.lit(ESCAPE + "\x03")), F.lit(MARK), F.lit(ESCAPE + "\x04"))
    pieces = F.when(own.rlike("[0-9@]"), F.split(F.regexp_replace(safe, ANY, f"{MARK}$0{MARK}"), MARK, -1))
    found, new = private(documents, "pieces", "new")
    marked = documents.withColumn(found, pieces)
    made = F.transform(F.col(found), lambda p, i: F.when(i % 2 == 1, pseudonym(p, key)).otherwise(p))
    done = marked.withColumn(new, F.when(F.size(found) > 1, made))
    back = F.replace(F.replace(F.array_join(new, ""), F.lit(ESCAPE + "\x04"), F.lit(MARK)), F.lit(ESCAPE + "\x03"), F.lit(ESCAPE))
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda differs: differs))
    return done.withColumns({text: F.when(F.col(new).isNotNull(), back).otherwise(own), count: F.when(F.col(new).isNotNull(), changed).otherwise(0).cast("long")}).drop(found, new)
