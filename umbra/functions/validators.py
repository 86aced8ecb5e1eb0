"""Checksums and structure tests of identifiers, on text columns with their blanks and separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The country codes that a BIC or a creditor identifier may name (EU, EEA, CH, GB, US).
COUNTRIES = [
    "AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HR", "HU", "IE", "IT",
    "LT", "LU", "LV", "MT", "NL", "PL", "PT", "RO", "SE", "SI", "SK",
    "IS", "LI", "NO",
    "CH", "GB", "US",
]


def known_country(code: Column) -> Column:
    return code.isin(COUNTRIES)


def compact(text: Column) -> Column:
    """Upper case without white space of any kind."""
    return F.upper(F.regexp_replace(text, r"(?U)\s", ""))


def mod97(text: Column) -> Column:
    """Whether a compact text, its first four characters last and A to Z as 10 to 35, leaves 1 modulo 97."""
    turned = F.concat(F.substring(text, 5, 100), F.substring(text, 1, 4))
    step = lambda rest, c: F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: step(rest, c).cast("int"))
    return text.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]+$") & (F.when(text.rlike("^[0-9A-Z]+$"), rest) == 1)


def iban(text: Column) -> Column:
    whole = compact(text)
    return F.length(whole).between(15, 34) & mod97(whole)


def creditor_id(text: Column) -> Column:
    whole = compact(text)
    short = F.concat(F.substring(whole, 1, 4), F.substring(whole, 8, 100))
    return whole.rlike(r"^[\x00-\x7F]*$") & F.length(whole).between(8, 35) & known_country(F.substring(whole, 1, 2)) & mod97(short)


def bic(text: Column) -> Column:
    whole = compact(text)
    return whole.rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$") & known_country(F.substring(whole, 5, 2))


def luhn(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return (F.length(digits) >= 2) & F.call_function("luhn_check", digits)


VALIDATORS = {"iban": iban, "creditor_id": creditor_id, "bic": bic, "luhn": luhn}
