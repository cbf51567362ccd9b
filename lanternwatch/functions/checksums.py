"""Checksum and format checks of identifiers as Column expressions, none of them a UDF."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _values(c: Column) -> Column:
    """Digits of a string as integers; null for anything else."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: x.try_cast("int"))


def weighted_sum(c: Column, weights: Sequence[int]) -> Column:
    """Sum of the leading digits times the weights."""
    w = F.array(*[F.lit(x) for x in weights])
    terms = F.zip_with(F.slice(_values(c), 1, len(weights)), w, lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0), lambda acc, x: acc + x)


def _digit(c: Column, at: int) -> Column:
    return F.substring(c, at, 1).try_cast("int")


def luhn(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def verhoeff(c: Column) -> Column:
    """Check of the dihedral group of order 10: digits are permuted by their place and multiplied in the group."""
    step = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    power = [list(range(10))]
    for _ in range(7):
        power.append([step[x] for x in power[-1]])

    def product(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5

    table = lambda rows: F.array(*[F.lit(x) for row in rows for x in row])
    p, d = table(power), table([[product(a, b) for b in range(10)] for a in range(10)])
    values = _values(F.reverse(c))
    placed = F.transform(values, lambda x, i: F.element_at(p, (i % 8) * 10 + x + 1))
    return F.aggregate(placed, F.lit(0), lambda acc, x: F.element_at(d, acc * 10 + x + 1)) == 0


def _mod97(c: Column) -> Column:
    moved = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))
    letters = F.transform(F.filter(F.split(moved, ""), lambda x: x != ""), lambda x: F.when(x.rlike("[A-Z]"), F.ascii(x) - 55).otherwise(x.try_cast("int")))
    return F.aggregate(letters, F.lit(0), lambda acc, x: F.when(x > 9, (acc * 100 + x) % 97).otherwise((acc * 10 + x) % 97))


def _cpf(d: Column) -> Column:
    r1, r2 = weighted_sum(d, range(10, 1, -1)) * 10 % 11, weighted_sum(d, range(11, 1, -1)) * 10 % 11
    return d.rlike("^[0-9]{11}$") & ~d.rlike(r"^([0-9])\1{10}$") & (r1 % 10 == _digit(d, 10)) & (r2 % 10 == _digit(d, 11))


def _cnpj(d: Column) -> Column:
    tail = [9, 8, 7, 6, 5, 4, 3, 2]
    check = lambda r: F.when(r < 2, 0).otherwise(11 - r)
    r1, r2 = weighted_sum(d, [5, 4, 3, 2, *tail]) % 11, weighted_sum(d, [6, 5, 4, 3, 2, *tail]) % 11
    return d.rlike("^[0-9]{14}$") & ~d.rlike(r"^([0-9])\1{13}$") & (check(r1) == _digit(d, 13)) & (check(r2) == _digit(d, 14))


def _nric(c: Column) -> Column:
    up = F.upper(F.trim(c))
    total = weighted_sum(F.substring(up, 2, 7), [2, 7, 6, 5, 4, 3, 2]) + F.when(F.substring(up, 1, 1).isin("T", "G"), 4).otherwise(0)
    letters = F.when(F.substring(up, 1, 1).isin("S", "T"), F.lit("JZIHGFEDCBA")).otherwise(F.lit("XWUTRQPNMLK"))
    return up.rlike("^[STFG][0-9]{7}[A-Z]$") & (F.substr(letters, total % 11 + 1, F.lit(1)) == F.substring(up, 9, 1))


def _tfn(d: Column) -> Column:
    w8, w9 = weighted_sum(d, [10, 7, 8, 4, 6, 3, 5, 1]), weighted_sum(d, [1, 4, 3, 7, 5, 8, 6, 9, 10])
    return ((F.length(d) == 8) & (w8 % 11 == 0)) | ((F.length(d) == 9) & (w9 % 11 == 0))


def _nhs(d: Column) -> Column:
    check = (11 - weighted_sum(d, range(10, 1, -1)) % 11) % 11
    return (F.length(d) == 10) & (check != 10) & (check == _digit(d, 10))


def _aba(d: Column) -> Column:
    return (F.length(d) == 9) & (weighted_sum(d, [3, 7, 1, 3, 7, 1, 3, 7, 1]) % 10 == 0)


def _ssn(c: Column) -> Column:
    area, group, serial = F.substring(c, 1, 3), F.substring(c, 5, 2), F.substring(c, 8, 4)
    return c.rlike(r"^[0-9]{3}[-\s][0-9]{2}[-\s][0-9]{4}$") & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")


# Prefixes of employer numbers that are in use.
EIN_PREFIXES = (*range(1, 7), *range(10, 17), *range(20, 28), *range(30, 49), *range(50, 69), *range(71, 78), *range(80, 89), *range(90, 96), 98, 99)


def _ipv6(c: Column) -> Column:
    """One to eight groups of at most four hex digits, one double colon at most."""
    groups = F.filter(F.split(c, ":"), lambda x: x != "")
    double = F.regexp_count(c, F.lit("::"))
    return c.contains(":") & (double <= 1) & F.forall(groups, lambda x: x.rlike("^[0-9A-Fa-f]{1,4}$")) & F.size(groups).between(1, 8)


def _nonspace(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s-]", "")


def _iban(c: Column) -> Column:
    clean = F.upper(F.regexp_replace(c, r"\s", ""))
    return clean.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (_mod97(clean) == 1)


def _bank(c: Column) -> Column:
    """Account numbers need 7 digits; the routing checksum only adds to the validators."""
    return F.length(F.regexp_extract(c, r"[0-9]{7,17}", 0)) >= 7


#: Check of each kind: string column to boolean column. ``CREDIT_CARD`` needs 12 digits; ``SIN`` is plain Luhn over 9.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "CREDIT_CARD": lambda c: _nonspace(c).rlike("^[0-9]{12,}$") & luhn(_nonspace(c)),
    "AADHAAR": lambda c: F.regexp_replace(c, r"\s", "").rlike("^[0-9]{12}$") & verhoeff(F.regexp_replace(c, r"\s", "")),
    "ABA": lambda c: _aba(digits(c)),
    "BANK_ACCOUNT_US": _bank,
    "IBAN": _iban,
    "NHS": lambda c: _nhs(digits(c)),
    "PAN": lambda c: c.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"),
    "SSN": _ssn,
    "CPF": lambda c: _cpf(digits(c)),
    "CNPJ": lambda c: _cnpj(digits(c)),
    "SIN": lambda c: (F.length(digits(c)) == 9) & luhn(digits(c)),
    "NRIC": _nric,
    "TFN": lambda c: _tfn(digits(c)),
    "EIN": lambda c: F.trim(c).rlike("^[0-9]{2}-?[0-9]{7}$") & F.substring(F.trim(c), 1, 2).isin(*[f"{p:02d}" for p in EIN_PREFIXES]),
    "SWIFT_BIC": lambda c: F.upper(F.trim(c)).rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"),
    "BITCOIN_ADDR": lambda c: c.rlike("^[13][a-km-zA-HJ-NP-Z1-9]{25,34}$") | c.rlike("(?i)^bc1[a-z0-9]{8,87}$"),
    "ETHEREUM_ADDR": lambda c: c.rlike("^0x[0-9a-fA-F]{40}$"),
    "IPV6": _ipv6,
    "IMEI": lambda c: (F.length(digits(c)) == 15) & luhn(digits(c)),
    "MAC_ADDR": lambda c: c.rlike("^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"),
}


def valid(kind: str, c: Column) -> Column:
    """False, never null, for null input."""
    return F.coalesce(CHECKS[kind](c), F.lit(False))
