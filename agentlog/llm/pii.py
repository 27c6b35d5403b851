"""Personal data under format-preserving pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.llm.common import fresh, own_name

ROUNDS = 8
# Kinds of values by form. What a form finds is then validated; the first kind that fits wins.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,252}[A-Za-z0-9])?",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "phone": r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]\)?){6,13}(?![0-9])"
    r"|(?<![0-9(-])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?!-?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(FORMS.values())
CYCLE = 146_097  # days in 400 years: the calendar repeats after them
HALVES = (189, 773)  # whose product they are


def _numbers(text: Column) -> Column:
    """The decimal digits of a text."""
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.try_cast("bigint"))


def feistel(values: Column, sizes: Column, key: str, kind: str) -> Column:
    """A keyed permutation of arrays whose i-th number is below sizes[i]: by turns each half is shifted, number by
    number, by amounts that a SHA-256 of the key and the other half gives."""
    half = F.floor(F.size(values) / 2).cast("int")

    def one(now: Column, turn: Column) -> Column:
        first = turn % 2 == 0
        other = F.when(first, F.slice(now, half + 1, F.size(now))).otherwise(F.slice(now, F.lit(1), half))

        def shifted(x: Column, i: Column) -> Column:
            seen = F.concat_ws("|", F.lit(key), F.lit(kind), turn, i, F.array_join(other.cast("array<string>"), ","))
            shift = F.conv(F.substring(F.sha2(seen, 256), 1, 12), 16, 10).cast("bigint")
            return F.when((i < half) == first, F.pmod(x + shift, F.get(sizes, i))).otherwise(x)

        return F.transform(now, shifted)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, one)


def _tens(values: Column) -> Column:
    return F.transform(values, lambda _: F.lit(10).cast("bigint"))


def _refilled(text: Column, digits: Column, skip: Column | int = 0) -> Column:
    """The text with its digits, after the first ``skip`` of them, replaced by ``digits`` in order."""
    start = F.struct(F.lit("").alias("out"), (-F.lit(skip)).cast("int").alias("at"))

    def one(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        new = F.when(is_digit & (acc["at"] >= 0), F.get(digits, acc["at"]).cast("string")).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["at"] + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(text, ""), start, one, lambda acc: acc["out"])


def _letters(text: Column, key: str) -> Column:
    """Letters and digits of a short text permuted among their own kind: a-z, A-Z, 0-9. Other characters stay."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))

    def base(c: Column) -> Column:
        return F.when(c.between(48, 57), 48).when(c.between(65, 90), 65).when(c.between(97, 122), 97).otherwise(c)

    values = F.transform(codes, lambda c: (c - base(c)).cast("bigint"))
    sizes = F.transform(codes, lambda c: F.when(base(c) == 48, 10).when(base(c) == c, F.when(c.isin(65, 97), 26).otherwise(1)).otherwise(26).cast("bigint"))
    new = feistel(values, sizes, key, "email")
    return F.array_join(F.zip_with(new, codes, lambda v, c: F.char(base(c) + v)), "")


def luhn_sum(digits: Column) -> Column:
    """The sum that is a multiple of ten for valid card numbers: every second digit from the right counts double."""
    places = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda a, d: a + d)


def _card(text: Column, key: str) -> tuple[Column, Column]:
    """Valid by its check digit. The first digit, which names the network, stays, and the check digit is set anew."""
    digits = _numbers(text)
    n = F.size(digits)
    body = F.slice(digits, F.lit(2), n - 2)
    body = F.concat(F.slice(digits, 1, 1), feistel(body, _tens(body), key, "card"))
    check = F.pmod(-luhn_sum(F.concat(body, F.array(F.lit(0).cast("bigint")))), F.lit(10))
    return luhn_sum(digits) % 10 == 0, _refilled(text, F.concat(body, F.array(check)))


def _phone(text: Column, key: str) -> tuple[Column, Column]:
    """8 to 15 digits with a plus, 10 without. The first digit behind a plus stays."""
    plus = text.startswith("+").cast("int")
    digits = _numbers(text)
    body = F.slice(digits, plus + 1, F.size(digits))
    valid = F.when(plus == 1, F.size(digits).between(8, 15)).otherwise(F.size(digits) == 10)
    return valid, _refilled(text, feistel(body, _tens(body), key, "phone"), plus)


def _ipv4(text: Column, key: str) -> tuple[Column, Column]:
    """Four numbers up to 255 without leading zeros."""
    parts = F.split(text, r"\.")
    values = F.transform(parts, lambda p: p.try_cast("bigint"))
    new = feistel(values, F.transform(values, lambda _: F.lit(256).cast("bigint")), key, "ipv4")
    valid = F.forall(parts, lambda p: (p.try_cast("int") <= 255) & ~p.rlike("^0[0-9]"))
    return valid, F.array_join(new.cast("array<string>"), ".")


def _ssn(text: Column, key: str) -> tuple[Column, Column]:
    """Area 001 to 899 without 666, group from 01, serial number from 0001."""
    area, group, serial = (F.get(F.split(text, "-"), F.lit(i)).try_cast("bigint") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    new = feistel(values, F.array(*[F.lit(n).cast("bigint") for n in (898, 99, 9999)]), key, "ssn")
    area = new[0] + F.when(new[0] >= 665, 2).otherwise(1)
    return valid, F.format_string("%03d-%02d-%04d", area, new[1] + 1, new[2] + 1)


def _date(text: Column, key: str) -> tuple[Column, Column]:
    """A day of the calendar, moved within its 400 years. With slashes the month comes first unless only the second
    number can be one; with points the day does."""
    first, second = F.substring(text, 1, 2).try_cast("int"), F.substring(text, 4, 2).try_cast("int")
    day_first = ((first > 12) & (second <= 12)) | text.contains(".")
    plain = F.translate(text, ".", "/")
    day = F.coalesce(F.try_to_date(plain, "yyyy-MM-dd"), F.when(day_first, F.try_to_date(plain, "dd/MM/yyyy")).otherwise(F.try_to_date(plain, "MM/dd/yyyy")))
    number = F.datediff(day, F.lit("0001-01-01").cast("date")).cast("bigint")
    era, inside = F.floor(number / CYCLE), F.pmod(number, F.lit(CYCLE))
    values = F.array(F.floor(inside / HALVES[1]).cast("bigint"), F.pmod(inside, F.lit(HALVES[1])))
    new = feistel(values, F.array(*[F.lit(n).cast("bigint") for n in HALVES]), key, "date")
    moved = F.date_add(F.lit("0001-01-01").cast("date"), (era * CYCLE + new[0] * HALVES[1] + new[1]).cast("int"))
    y, m, d = F.date_format(moved, "yyyy"), F.date_format(moved, "MM"), F.date_format(moved, "dd")
    out = F.when(text.contains("-"), F.concat_ws("-", y, m, d))
    out = out.when(text.contains("."), F.concat_ws(".", d, m, y))
    out = out.when(day_first, F.concat_ws("/", d, m, y)).otherwise(F.concat_ws("/", m, d, y))
    return day.isNotNull() & (F.year(day) > 0), out


def _email(text: Column, key: str) -> tuple[Column, Column]:
    """A name of up to 64 characters at a domain with a point. The domain stays."""
    name, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    valid = domain.rlike(r"^[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$") & name.rlike("[A-Za-z0-9]")
    return valid, F.concat_ws("@", _letters(name, key), domain)


KINDS = {"email": _email, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _judged(value: Column, key: str) -> Column:
    """struct(kind, new): the kind of a found value and its pseudonym; NULL kind and itself when it isn't valid."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), value.alias("new"))
    for kind, rule in reversed(KINDS.items()):
        valid, new = rule(value, key)
        fits = value.rlike(f"^(?:{FORMS[kind]})$") & F.coalesce(valid, F.lit(False))
        out = F.when(fits, F.struct(F.lit(kind).alias("kind"), new.alias("new"))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "pii") -> DataFrame:
    """The documents with personal data in the text replaced, and ``found``, a list of (kind, new) in order of place.

    E-mail addresses, IPv4 addresses, dates, social security numbers, phone and card numbers that are valid get a
    pseudonym of the same form and validity. Within a kind it is a permutation that depends on the key alone: equal
    values have equal pseudonyms in all documents, different ones have different ones, and whoever has the key can
    undo it. All else in a text stays as it is. A value may rarely be its own pseudonym.

    NULL texts stay NULL and texts without such values as they are, with an empty list. An existing column named
    ``found`` is replaced. Rows are independent: there is no shuffle and equal rows give equal rows.
    """
    hits, gaps = fresh(docs, "_hits"), fresh(docs, "_gaps")
    kept = [c for c in docs.columns if c.lower() != found.lower()]
    text = own_name(docs, text)
    t = F.col(text)
    none = F.array().cast("array<string>")
    marked = docs.select(*kept, F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1))).otherwise(none).alias(hits))
    some = F.size(F.coalesce(hits, none)) > 0
    judged = marked.withColumn(found, F.transform(F.coalesce(F.col(hits), none), lambda v: _judged(v, key)))
    judged = judged.withColumn(gaps, F.when(some, F.split(t, ANY, -1)))
    new = F.transform(F.col(found), lambda f: f["new"])
    pieces = F.zip_with(F.col(gaps), F.concat(new, F.array(F.lit(""))), lambda g, n: F.concat(g, n))
    joined = F.array_join(pieces, "")
    replaced = F.when(some, joined).otherwise(t)
    valid = F.filter(F.col(found), lambda f: f["kind"].isNotNull())
    return judged.select(*[replaced.alias(c) if c == text else F.col(c) for c in kept], valid.alias(found))
