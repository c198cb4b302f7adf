"""DuckDB SQL that says the same as the engine, by other means.

DuckDB's expressions have no look-around, so matches are found by a recursive query that
scans on from the end of the last match, with one character before it.
"""

from __future__ import annotations

from inkveil.functions import lexicon as L
from inkveil.functions.patterns import SPACE, expand
from inkveil.functions.text import DAY_FIRST, KOREAN_DATE, MONTH_FIRST, NUMERIC_DATE, TRANSLATE_FROM, TRANSLATE_TO
from inkveil.rules.registry import Rule


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"translate({x}, {lit(TRANSLATE_FROM)}, {lit(TRANSLATE_TO)})"


def count_of(x: str, kept: str) -> str:
    return f"length(regexp_replace({x}, '[^{kept}]', '', 'g'))"


def language(x: str) -> str:
    ko, en = count_of(x, "가-힣"), count_of(x, "A-Za-z")
    return f"CASE WHEN {ko} + {en} = 0 THEN 'en' WHEN {ko} > 0.6 * ({ko} + {en}) THEN 'ko' WHEN {ko} < 0.2 * ({ko} + {en}) THEN 'en' ELSE 'mixed' END"


def in_list(x: str, words) -> str:
    return f"{x} IN ({', '.join(map(lit, words))})"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^[{SPACE}]+|[{SPACE}]+$')}, '', 'g')"


def scan(source: str, core: str, before: str = "", after: str = "", label: str = "", until: str = "") -> str:
    """doc_id, lang, text, norm, place, hit: matches in ``source`` (doc_id, lang, text, norm)."""
    tail = f"(?:{expand(until)})" if until else rf"(?:\z|[^{after}])" if after else ""
    if label:
        lead, more, back = f"(.*?{expand(label)})", f"(.*?{expand(label)})", 0
    elif before:
        lead, more, back = f"(|.*?[^{before}])", f"(.*?[^{before}])", 1
    else:
        lead, more, back = "(.*?)", "(.*?)", 0
    first, then = (lit(f"(?s)^{x}({expand_core(core)}){tail}") for x in (lead, more))
    step = f"cur + length(x.pre) - {back} + length(x.m)" if back else "cur + length(x.pre) + length(x.m)"
    return f"""(WITH RECURSIVE scan(doc_id, lang, text, norm, cur, x) AS (
 SELECT doc_id, lang, text, norm, 1::BIGINT, regexp_extract(norm, {first}, ['pre', 'm']) FROM ({source}) s0
 UNION ALL SELECT doc_id, lang, text, norm, nxt, regexp_extract(substr(norm, nxt - {back}), {then}, ['pre', 'm']) FROM
  (SELECT doc_id, lang, text, norm, x, CASE WHEN cur = 1 THEN cur + length(x.pre) + length(x.m) ELSE {step} END AS nxt FROM scan WHERE x.m <> '') n WHERE nxt <= length(norm))
SELECT doc_id, lang, text, norm, CASE WHEN cur = 1 THEN cur + length(x.pre) ELSE cur - {back} + length(x.pre) END AS place, x.m AS hit FROM scan WHERE x.m <> '')"""


def expand_core(core: str) -> str:
    """A core inside ``(?s)``: its own dots are explicit classes already."""
    return expand(core)


def luhn(x: str) -> str:
    d = f"list_reverse(list_transform(string_split(regexp_replace({x}, '[^0-9]', '', 'g'), ''), lambda c: c::INT))"
    s = f"list_sum(list_transform({d}, lambda c, i: CASE WHEN i % 2 = 1 THEN c WHEN c * 2 > 9 THEN c * 2 - 9 ELSE c * 2 END))"
    return f"({s} > 0 AND {s} % 10 = 0)"


def _date(y: str, m: str, d: str) -> str:
    return f"coalesce(try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) IS NOT NULL AND {y}::INT BETWEEN 1900 AND 2100, false)"


def numeric_date(x: str) -> str:
    def one(p: str) -> str:
        return _date(*(f"regexp_extract({x}, {lit(p)}, {k})" for k in (1, 2, 3)))

    return f"CASE WHEN regexp_matches({x}, {lit(NUMERIC_DATE)}) THEN {one(NUMERIC_DATE)} WHEN regexp_matches({x}, {lit(KOREAN_DATE)}) THEN {one(KOREAN_DATE)} ELSE false END"


def english_date(x: str) -> str:
    known = {m: k for k, m in enumerate(L.MONTHS, 1)} | L.MONTH_SHORT

    def month(g: str) -> str:
        return "CASE " + g + " " + " ".join(f"WHEN {lit(m)} THEN '{k}'" for m, k in known.items()) + " END"

    a = [f"regexp_extract({x}, {lit(MONTH_FIRST)}, {k})" for k in (1, 2, 3)]
    b = [f"regexp_extract({x}, {lit(DAY_FIRST)}, {k})" for k in (1, 2, 3)]
    return f"CASE WHEN regexp_matches({x}, {lit(MONTH_FIRST)}) THEN {_date(a[2], month(a[0]), a[1])} WHEN regexp_matches({x}, {lit(DAY_FIRST)}) THEN {_date(b[2], month(b[1]), b[0])} ELSE false END"


def won(x: str) -> str:
    n = f"try_cast(regexp_replace({x}, '[^0-9]', '', 'g') AS DOUBLE)"
    return f"coalesce({n} > 0 AND {n} <= 999999999999999, false)"


def percentage(x: str) -> str:
    return f"coalesce(try_cast(regexp_extract({x}, '[0-9]+(?:\\.[0-9]+)?') AS DOUBLE) BETWEEN 0 AND 10000, false)"


CHECKS = {"luhn": luhn, "valid_numeric_date": numeric_date, "valid_english_date": english_date, "won_in_range": won, "percentage_in_range": percentage}


def prepared(corpus: str) -> str:
    """doc_id, lang, text, norm of a corpus with doc_id and text."""
    return f"SELECT doc_id, {language('text')} AS lang, text, {norm('text')} AS norm FROM ({corpus}) p0"


def rule_matches(rule: Rule, corpus: str, every_language: bool = False) -> str:
    """doc_id, place, text (original), norm_text; originals are right where lengths are kept."""
    source = prepared(corpus)
    if "universal" not in rule.languages and not every_language:
        source = f"SELECT * FROM ({source}) p1 WHERE lang = 'mixed' OR {in_list('lang', rule.languages)}"
    # a value that may be anything starts where the shortest label ends
    label = rule.label.replace("]?", "]??").replace(" ?", " ??") if rule.id == "legal.legal-context" else rule.label
    found = scan(source, rule.core, rule.before, rule.after, label, rule.until)
    check = f" WHERE {CHECKS[rule.check.__name__]('hit')}" if rule.check else ""
    return f"SELECT doc_id, place, substr(text, place, length(hit)) AS text, hit AS norm_text FROM {found} f{check}"


def pairs(x: str, pattern: str, groups: int) -> str:
    """list of structs with the groups g1, g2 of each match."""
    lists = ", ".join(f"regexp_extract_all({x}, {lit(pattern)}, {k + 1})" for k in range(groups))
    return f"list_zip({lists})"
