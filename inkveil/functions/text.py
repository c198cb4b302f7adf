"""Scalar string functions as Spark columns; all but ``nfc`` stay in the JVM."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import lexicon as L
from inkveil.functions.patterns import SPACE, expand

_wide = [chr(c) for c in range(L.FULLWIDTH_FIRST, L.FULLWIDTH_LAST + 1)]
_narrow = [chr(c - L.FULLWIDTH_SHIFT) for c in range(L.FULLWIDTH_FIRST, L.FULLWIDTH_LAST + 1)]
#: ``translate`` deletes the characters of the source that have no partner, so zero-width ones come last.
TRANSLATE_FROM = "".join([*L.DOUBLE_QUOTES, *L.SINGLE_QUOTES, *L.HYPHENS, L.IDEOGRAPHIC_SPACE, *_wide, *L.ZERO_WIDTH])
TRANSLATE_TO = "".join(['"' * len(L.DOUBLE_QUOTES), "'" * len(L.SINGLE_QUOTES), "-" * len(L.HYPHENS), " ", *_narrow])


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, also where body names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(text: Column | str) -> Column:
    """Text for matching: quotes, hyphens and full-width forms to ASCII, zero-width characters out."""
    return F.translate(col(text), TRANSLATE_FROM, TRANSLATE_TO)


def original_offsets(text: Column | str) -> Column:
    """For each character of the normalised text its place in the original, and the end."""
    t = col(text)
    # only zero-width characters move places
    moved = t.rlike("[" + "".join(f"\\x{{{ord(c):X}}}" for c in L.ZERO_WIDTH) + "]")
    keep = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c, i: F.when(F.lit(L.ZERO_WIDTH).contains(c), F.lit(None).cast("int")).otherwise(i))
    return F.when(moved, F.array_append(F.array_compact(keep), F.length(t))).otherwise(F.sequence(F.lit(0), F.length(t)))


def original_slice(text: Column, offsets: Column, start: Column, end: Column) -> Column:
    """The original characters behind normalised places start..end."""
    a, z = F.element_at(offsets, start + 1), F.element_at(offsets, end + 1)
    return F.substring(text, a + 1, z - a)


def nfc(text: Column | str) -> Column:
    """Canonical composition, which Spark has no function for, then :func:`normalize`."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return normalize(compose(col(text)))


def _count_of(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def detect_language(text: Column | str) -> Column:
    """ko, en or mixed by the share of Hangul syllables among them and ASCII letters."""
    hangul, latin = _count_of(col(text), "가-힣"), _count_of(col(text), "A-Za-z")
    share = hangul / F.nullif(hangul + latin, F.lit(0))
    # letters are counted only where there is a syllable
    counted = F.when(share > 0.6, "ko").when(share >= 0.2, "mixed").otherwise("en")
    return F.when(col(text).rlike("[가-힣]"), counted).otherwise("en")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """The checksum of card numbers; a sum of zero does not pass."""
    d = F.transform(F.filter(F.split(F.reverse(digits(text)), ""), lambda c: c != ""), lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(d, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return (total > 0) & (total % 10 == 0)


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """A real day of the years 1900 to 2100."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    real = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & text.try_cast("date").isNotNull()
    return F.coalesce(real & year.try_cast("int").between(1900, 2100), F.lit(False))


NUMERIC_DATE = r"([0-9]{4})[.\-/]([0-9]{1,2})[.\-/]([0-9]{1,2})"
KOREAN_DATE = expand(r"([0-9]{4})년\s*([0-9]{1,2})월\s*([0-9]{1,2})일")
MONTH_FIRST = expand(r"([A-Z][a-z]+)\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})")
DAY_FIRST = expand(r"([0-9]{1,2})\s+([A-Z][a-z]+)\.?\s+([0-9]{4})")


def _part(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(text, pattern, k)


def _date_of(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 0) != ""
    return F.when(found, valid_date(*(_part(text, pattern, k) for k in (1, 2, 3))))


def valid_numeric_date(text: Column) -> Column:
    return F.coalesce(_date_of(text, NUMERIC_DATE), _date_of(text, KOREAN_DATE), F.lit(False))


def month_number(name: Column) -> Column:
    known = {m: k for k, m in enumerate(L.MONTHS, 1)} | L.MONTH_SHORT
    table = F.create_map(*[x for m, k in known.items() for x in (F.lit(m), F.lit(str(k)))])
    return F.element_at(table, name)


def valid_english_date(text: Column) -> Column:
    first = F.when(F.regexp_extract(text, MONTH_FIRST, 0) != "", F.coalesce(valid_date(_part(text, MONTH_FIRST, 3), month_number(_part(text, MONTH_FIRST, 1)), _part(text, MONTH_FIRST, 2)), F.lit(False)))
    second = F.when(F.regexp_extract(text, DAY_FIRST, 0) != "", F.coalesce(valid_date(_part(text, DAY_FIRST, 3), month_number(_part(text, DAY_FIRST, 2)), _part(text, DAY_FIRST, 1)), F.lit(False)))
    return F.coalesce(first, second, F.lit(False))


def won_in_range(text: Column) -> Column:
    n = digits(text).try_cast("double")
    return F.coalesce((n > 0) & (n <= 999_999_999_999_999), F.lit(False))


def percentage_in_range(text: Column) -> Column:
    n = F.regexp_extract(text, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
    return F.coalesce(n.between(0, 10_000), F.lit(False))


def title_case(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def trim(text: Column) -> Column:
    """Without white space at both ends, of the wide definition."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def count_words(text: Column | str) -> Column:
    return F.size(F.filter(F.split(col(text), f"[{SPACE}]+"), lambda w: w != ""))


def count_occurrences(text: Column, literal: Column) -> Column:
    """Literal occurrences from the left that do not overlap."""
    n = (F.length(text) - F.length(F.replace(text, literal, F.lit("")))) / F.length(literal)
    return F.when(F.length(literal) == 0, 0).otherwise(n).cast("int")


def quoted(literal: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def count_bounded(text: Column, literal: Column) -> Column:
    """Occurrences whose edges do not cut a run of ``[A-Za-z0-9_]``."""
    word = "[A-Za-z0-9_]"
    before = F.when(F.substring(literal, 1, 1).rlike(word), f"(?<!{word})").otherwise("")
    after = F.when(F.substring(literal, -1, 1).rlike(word), f"(?!{word})").otherwise("")
    found = F.size(F.regexp_extract_all(text, F.concat(before, quoted(literal), after), F.lit(0)))
    # a pattern of a row is compiled for each row, so only where there is something to count
    return F.when(F.length(literal) == 0, 0).when(text.contains(literal), found).otherwise(F.when(text.isNotNull() & literal.isNotNull(), 0))


def stable_hash(text: Column | str) -> Column:
    """FNV-1a over the UTF-8 bytes, 32 bits, as eight hexadecimal digits."""
    code = F.hex(F.encode(col(text), "UTF-8"))
    n = F.length(code) / 2
    octets = F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: F.conv(F.substring(code, k * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    value = F.aggregate(octets, F.lit(0x811C9DC5).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def target_id(namespace: str | Column, text: Column | str) -> Column:
    head = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.concat(head, F.lit(":"), stable_hash(text))


def encode_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def encode_xml_attribute(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def is_stop_phrase(phrase: Column) -> Column:
    forms = "|".join(L.STOP_FORMS)
    return phrase.isin(*L.STOP_WORDS) | phrase.rlike(rf"^(?:{forms})\z")


def is_defined_term(phrase: Column) -> Column:
    return phrase.isin(*L.DEFINED_ROLES) | F.regexp_replace(phrase, "^(?:the |The )", "").isin(*L.DEFINED_ROLES)


def is_role(text: Column) -> Column:
    """A blacklisted role, in either language."""
    return F.lower(text).isin(*L.ROLES_EN) | text.isin(*L.ROLES_KO)


def is_role_like(text: Column) -> Column:
    """Blank, a role, or nothing but roles and articles."""
    t = trim(text)
    words = F.filter(F.split(F.lower(t), f"[{SPACE}]+"), lambda w: (w != "") & ~w.isin(*L.ARTICLES_EN))
    return (t == "") | is_role(t) | ((F.size(words) > 0) & F.forall(words, lambda w: w.isin(*L.ROLES_EN)))


def sha256_hex(data: Column, first: int | None = None, upper: bool = False) -> Column:
    out = F.sha2(data, 256)
    out = out if first is None else F.substring(out, 1, first)
    return F.upper(out) if upper else out


def all_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


