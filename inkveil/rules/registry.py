"""The rules of detection: patterns with guards, levels, languages and checks.

Patterns, levels and languages are fixed values.  A rule says which characters may
not stand before or after a match (``before``, ``after``), or which label must stand
before it (``label``); the guards become look-arounds in Java and other forms where
an engine has none.  ``hint`` is text without which the rule cannot match: a cheap
test that comes first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.functions.patterns import expand

CONSERVATIVE, STANDARD, PARANOID = LEVELS = ("conservative", "standard", "paranoid")
ALL, UPPER, LAST = LEVELS, LEVELS[1:], LEVELS[2:]
KO, EN, ANY = ("ko",), ("en",), ("universal",)
CATEGORIES = ("identifiers", "financial", "temporal", "entities", "structural", "legal", "heuristics")


@dataclass(frozen=True)
class Rule:
    id: str
    core: str
    levels: tuple[str, ...]
    languages: tuple[str, ...]
    description: str
    before: str = ""
    after: str = ""
    label: str = ""
    until: str = ""
    check: Callable[[Column], Column] | None = None
    hint: str = ""
    #: Texts of which a match has at least one: the same test where no single text will do.
    hints: tuple[str, ...] = ()
    #: Of a rule with a label: what ``core`` starts with and what ``label`` ends with (if not with GAP).  These short
    #: tests follow from both and come first, since the look-behind tries each of its lengths at every place.
    starts: str = ""
    ends: str = ""

    @property
    def category(self) -> str:
        return self.id.split(".", 1)[0]

    @property
    def subcategory(self) -> str:
        return self.id.split(".", 1)[1]

    @property
    def pattern(self) -> str:
        """The pattern for Spark."""
        head = f"(?<={expand(self.label)})" if self.label else ""
        core = expand(self.core)
        if self.before:
            core = led(self.before, core) if LEAD.match(core) else (f"(?={expand(self.starts)})" if self.starts else "") + f"(?<![{self.before}])" + core
        if self.label:
            # words before a gap end with one of these, and so may the gap
            ends = self.ends or "[\\s:：" + "".join(sorted({w[-1] for w in self.label.removesuffix(GAP)[3:-1].split("|")})) + "]"
            head = f"(?={expand(self.starts)})(?<={expand(ends)}){head}"
        tail = f"(?={expand(self.until)})" if self.until else f"(?![{self.after}])" if self.after else ""
        return head + core + tail


#: One character at the start of a pattern: a class or a digit, and how often.
LEAD = re.compile(r"(\\d|\[[^\]]*\])(\+|\{\d+(?:,\d*)?\})?(?![?+*{])")


def led(before: str, pattern: str) -> str:
    """A pattern that no character of ``before`` may stand before, with the first character tested first.

    A look-behind is costly where it comes first, since it is then tried at every place.
    """
    m = LEAD.match(pattern)
    first, times, rest = m[1], m[2] or "", pattern[m.end() :]
    if times == "+":
        more = first + "*"
    elif times:
        least, comma, most = re.fullmatch(r"\{(\d+)(,?)(\d*)\}", times).groups()
        more = f"{first}{{{int(least) - 1}{comma}{int(most) - 1 if most else ''}}}"
    else:
        more = ""
    return f"{first}(?<![{before}]{first}){more}{rest}"


# -- parts of patterns (fixed values) --
GROUPED = r"(?:\d{1,3}(?:,\d{3})+|\d+)"
CENTS = r"(?:\.\d{1,2})?"
YEAR = r"(?:19|20)\d{2}"
MONTH, DAY = r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])"
KO_DATE = rf"{YEAR}년\s*{MONTH}월\s*{DAY}일"
SHORT_DATE = rf"{YEAR}[.\-/]{MONTH}[.\-/]{DAY}"
MONTH_WORD = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan\.?|Feb\.?|Mar\.?|Apr\.?|Jun\.?|Jul\.?|Aug\.?|Sept?\.?|Oct\.?|Nov\.?|Dec\.?)"
TOKEN = r"(?:[A-Za-z0-9][A-Za-z0-9&.\-]*|[가-힣][가-힣A-Za-z0-9]*)"
CAP = r"[A-Z][A-Za-z0-9&\-]*(?:\s+[A-Z][A-Za-z0-9&\-]*){0,3}"
PERSON = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"
#: Blanks that a label may have on each side of its colon (Java needs a bound).
GAP = r"\s{0,8}[:：]?\s{0,8}"

PHONE = r"[+\d(][+\d .()\-]{6,24}"
PHONE_END = r"\z|\n|;|[^\d+ .()\-]"

RULES: tuple[Rule, ...] = (
    Rule("identifiers.korean-rrn", r"\d{6}-[1-8]\d{6}", ALL, KO, "Resident registration number", r"\d", r"\d", hint="-"),
    Rule("identifiers.korean-brn", r"\d{3}-\d{2}-\d{5}", ALL, KO, "Business registration number", r"\d", r"\d", hint="-"),
    Rule("identifiers.us-ein", r"\d{2}-\d{7}", ALL, EN, "US employer number", r"\d", r"\d", hint="-"),
    Rule("identifiers.phone-kr", r"01[016-9]-?\d{3,4}-?\d{4}", ALL, KO, "Korean mobile number", r"\d", r"\d", hint="01"),
    Rule("identifiers.phone-intl", r"\+\d{1,3}(?:[\s-]\d{1,4}){2,4}", ALL, ANY, "Phone number with country code", r"A-Za-z0-9_+", r"\d", hint="+"),
    Rule("identifiers.email", r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,}", ALL, ANY, "Mail address", "A-Za-z0-9_", "A-Za-z0-9_", hint="@"),
    Rule("identifiers.account-kr", r"\d{3,6}-\d{2,3}-\d{4,7}", ALL, KO, "Korean bank account", r"\d", r"\d", hint="-"),
    Rule("identifiers.credit-card", r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}", ALL, ANY, "Card number with checksum", r"\d-", r"\d-", check=T.luhn),
    Rule("identifiers.phone-kr-landline", r"(?:02|0[3-6]\d|070|060|050|080)-?\d{3,4}-?\d{4}", UPPER, KO, "Korean landline, internet and toll-free numbers", r"\d", r"\d", hint="0", starts="0"),
    Rule("financial.won-amount", rf"{GROUPED}(?:\.\d+)?\s*원", ALL, KO, "Amount in won", r"\d.", check=T.won_in_range, hint="원", starts=r"\d"),
    Rule("financial.won-unit", r"\d+(?:,\d{3})*(?:\.\d+)?\s*(?:천만|천억|천|만|억|조)\s*원", UPPER, KO, "Amount in won with a unit", r"\d", hint="원"),
    Rule("financial.won-formal", rf"(?:₩\s*|KRW\s+){GROUPED}(?:\.\d+)?", ALL, ANY, "Won sign or code and an amount", "A-Za-z", hints=("₩", "KRW"), starts="[₩K]"),
    Rule("financial.usd-symbol", rf"\$\s*{GROUPED}{CENTS}", ALL, ANY, "Dollar sign and an amount", r"A-Za-z\d", hint="$"),
    Rule("financial.usd-code", rf"(?:USD\s+|US\$\s*){GROUPED}{CENTS}", ALL, ANY, "Dollar code and an amount", "A-Za-z", hint="US", starts="U"),
    Rule("financial.foreign-symbol", rf"[€£¥]\s*{GROUPED}{CENTS}", UPPER, ANY, "Other currency signs", r"A-Za-z\d", hints=("€", "£", "¥")),
    Rule("financial.foreign-code", rf"(?:EUR|GBP|JPY|CNY|CHF|AUD|CAD|HKD|SGD)\s+{GROUPED}{CENTS}", UPPER, ANY, "Other currency codes", "A-Za-z", starts="[EGJCAHS]"),
    Rule("financial.percentage", r"\d+(?:\.\d+)?\s*(?:%|퍼센트|프로)", UPPER, ANY, "Percentage", r"\d", check=T.percentage_in_range, hints=("%", "퍼센트", "프로")),
    Rule("financial.fraction-ko", r"\d+\s*분의\s*\d+", LAST, KO, "Fraction in words", r"\d", r"\d", hint="분의"),
    Rule("financial.amount-context-ko", rf"{GROUPED}(?:\.\d+)?(?:\s*(?:원|만원|억원|천원))?", UPPER, KO, "Amount after a label", label=rf"(?:금액|총액|보증금|매매대금|계약금|잔금|지급액|수수료|단가|대금){GAP}", starts=r"\d"),
    Rule("temporal.date-ko-full", KO_DATE, ALL, KO, "Date in Korean words", r"\d", check=T.valid_numeric_date, hint="년", starts="[12]"),
    Rule("temporal.date-ko-short", SHORT_DATE, UPPER, KO, "Short date", r"\d", r"\d", check=T.valid_numeric_date, starts="[12]", hints=("19", "20")),
    Rule("temporal.date-ko-range", rf"{KO_DATE}\s*(?:부터|~|-)\s*{KO_DATE}(?:\s*까지)?", UPPER, KO, "Range of dates", hint="년"),
    Rule("temporal.date-iso", rf"{YEAR}-(?:1[0-2]|0[1-9])-(?:3[01]|[12]\d|0[1-9])(?:T(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)?)?", ALL, ANY, "ISO date or time", r"\d", r"\d", check=T.valid_numeric_date, starts="[12]", hints=("19", "20")),
    Rule("temporal.date-en", rf"(?:{DAY}\s+{MONTH_WORD}|{MONTH_WORD}\s+{DAY}(?:st|nd|rd|th)?,?)\s+{YEAR}", UPPER, EN, "Date in English words", r"A-Za-z\d", r"\d", check=T.valid_english_date, starts=r"[JFMASOND\d]", hints=("19", "20")),
    Rule("temporal.duration-ko", r"\d+\s*(?:년간|개월|달|주간|주|일간|시간)", UPPER, KO, "Duration in Korean", r"\d"),
    Rule("temporal.duration-en", r"\d+\s+(?i:years?|months?|weeks?|days?|hours?)", UPPER, EN, "Duration in English", r"\d", "A-Za-z0-9_"),
    Rule("temporal.date-context-ko", rf"(?:{KO_DATE}|{SHORT_DATE})", ALL, KO, "Date after a label", label=rf"(?:계약일|체결일|시행일|효력발생일|만료일|종료일|발행일|작성일|기준일){GAP}", check=T.valid_numeric_date, starts=r"[12]"),
    Rule("entities.ko-corp-prefix", rf"주식회사\s+{TOKEN}", UPPER, KO, "Company form before a name", "가-힣A-Za-z", hint="주식회사", starts="주"),
    Rule("entities.ko-corp-suffix", rf"{TOKEN}\s+주식회사", UPPER, KO, "Company form after a name", "가-힣A-Za-z", "가-힣A-Za-z", hint="주식회사", starts="[A-Za-z0-9가-힣]"),
    Rule("entities.ko-corp-abbrev", rf"(?:\(주\)|㈜)\s*{TOKEN}", UPPER, KO, "Short company form and a name", hints=("(주)", "㈜")),
    Rule("entities.ko-legal-other", rf"(?:유한회사|유한책임회사|합자회사|합명회사|사단법인|재단법인|협동조합)\s+{TOKEN}", UPPER, KO, "Other legal forms", "가-힣A-Za-z", starts="[유합사재협]"),
    Rule("entities.ko-title-name", r"(?:대표이사|부사장|본부장|대표|부장|차장|과장|팀장|실장|사장|전무|상무|이사|감사|대리|주임)\s+[가-힣]{2,4}", LAST, KO, "Title and name", "가-힣A-Za-z", "가-힣", starts="[대부본차과팀실사전상이감주]"),
    Rule("entities.ko-honorific", r"[가-힣]{2,4}\s*(?:사장님|선생님|교수님|대표님|이사님|귀하|님|씨)", LAST, KO, "Name and honorific", "가-힣", "가-힣"),
    Rule("entities.en-corp-suffix", rf"{CAP}\s+(?:Corporation|Incorporated|Limited|Company|Corp\.?|Inc\.?|LLC\.?|Ltd\.?|Co\.?)", UPPER, EN, "English company", "A-Za-z", "A-Za-z"),
    Rule("entities.en-legal-form", rf"{CAP}\s+(?:GmbH|AG|S\.p\.A\.|S\.r\.l\.|S\.A\.S|S\.A\.|SARL|SAS|PLC|LLP|Pty\s+Ltd|Pty|NV|BV|AB|OY|KG|OHG)", UPPER, EN, "International legal forms", "A-Za-z", "A-Za-z"),
    Rule("entities.en-title-person", rf"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Rev|Sir)\.?\s+{PERSON}", LAST, EN, "Personal title and name", "A-Za-z", "A-Za-z", starts="[MDPRS]"),
    Rule("entities.en-exec-title", rf"(?:Vice\s+President|CEO|CFO|COO|CTO|CIO|CMO|CHRO|President|Chairman|Chairwoman|Director|Founder|Partner|Secretary|Treasurer)\s+{PERSON}", LAST, EN, "Executive title and name", "A-Za-z", "A-Za-z", starts="[VCPDFST]"),
    Rule("entities.ko-identity-context", r"(?:[A-Za-z][A-Za-z0-9&.\-]*|[가-힣]{2,6})", UPPER, KO, "Name after a label", label=rf"(?:대표자|성명|이름|법인명|회사명|상호|소속|직함|직위){GAP}", starts=r"[A-Za-z가-힣]"),
    Rule("entities.en-identity-context", r"[A-Z][A-Za-z.\-]*(?:\s+[A-Z][A-Za-z.\-]*){0,3}", UPPER, EN, "Name after a label", label=r"(?:Full\s{1,8}Name|Company\s{1,8}Name|Name|Company|Representative|Contact|Signatory|Client|Counterparty)\s{0,8}:\s{0,8}", starts=r"[A-Z]", ends=r":\s{0,8}", hint=":"),
    Rule("entities.ko-address-context", r"[^\s:：].{4,99}?", UPPER, KO, "Address after a label", label=rf"(?:주소|소재지|거주지|본점\s{{0,8}}주소|본사\s{{0,8}}주소|지점\s{{0,8}}주소|사업장\s{{0,8}}주소|연락지|주민등록지|등록기준지){GAP}", until=r"\z|\n|;", starts=r"[^\s:：]"),
    Rule("entities.en-address-context", r"[0-9A-Z][^\n;]{4,99}?", UPPER, EN, "Address after a label", label=r"(?:Registered Address|Mailing Address|Street Address|Business Address|Residence|Domicile|Location|Address): ?", until=r"\z|\n|;", starts=r"[0-9A-Z]", ends=r": ?", hint=":"),
    Rule("entities.ko-phone-context", PHONE, UPPER, KO, "Phone after a label", label=rf"(?:전화번호|전화|연락처|휴대전화|휴대폰|핸드폰|팩스번호|팩스|Fax|Tel){GAP}", until=PHONE_END, starts=r"[+\d(]"),
    Rule("entities.en-phone-context", PHONE, UPPER, EN, "Phone after a label", label=r"(?:Phone Number|Telephone|Phone|Mobile|Cell|Tel|Fax) {0,8}: {0,8}", until=PHONE_END, starts=r"[+\d(]", ends=r": {0,8}", hint=":"),
    Rule("legal.ko-case-number", rf"{YEAR}[가-힣]{{1,3}}\d{{1,6}}", UPPER, KO, "Court case number", r"\d", r"\d", starts="[12]"),
    Rule("legal.legal-context", r"[^\n;,]{3,60}", UPPER, ("ko", "en"), "Value after a case label", label=r"(?:사건번호[:：] ?|사건[:：] ?|Case No\.[:：]? ?|Case No[:：] ?|Docket No\.[:：]? ?|Docket No[:：] ?)", until=r"\z|\n|[;,]", starts=r"[^\n;,]", ends=r"[:：.] ?", hints=("사건", "Case No", "Docket No")),
)
BY_ID = {r.id: r for r in RULES}
#: The identifiers that earlier versions knew, by kind, without level or language.
LEGACY = ("korean-rrn", "korean-brn", "us-ein", "phone-kr", "phone-intl", "email", "account-kr", "credit-card")


def check_registry(rules: Sequence[Rule]) -> None:
    """Unique ids with a known category, and no empty field; raises otherwise."""
    seen: set[str] = set()
    for r in rules:
        if r.id in seen:
            raise ValueError(f"rule {r.id} is registered twice")
        seen.add(r.id)
        if not re.fullmatch(r"[a-z]+\.[a-z0-9-]+", r.id) or r.category not in CATEGORIES:
            raise ValueError(f"rule id {r.id} is malformed")
        if not r.levels or not set(r.levels) <= set(LEVELS):
            raise ValueError(f"rule {r.id} has no valid level")
        if not r.languages or not r.description or not r.core:
            raise ValueError(f"rule {r.id} lacks languages, a description or a pattern")


check_registry(RULES)


def at_level(rules: Sequence[Rule], level: str) -> list[tuple[int, Rule]]:
    """(place in the registry, rule) of those that a level has; settled when the plan is built."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    return [(k, r) for k, r in enumerate(rules) if level in r.levels]


def speaks(languages: Sequence[str], language: Column) -> Column:
    """Whether a rule of these languages applies to a text of a language."""
    if "universal" in languages:
        return F.lit(True)
    return (language == "mixed") | language.isin(*languages)
