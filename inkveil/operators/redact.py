"""Redaction of literals, in plain text and in marked-up parts."""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import lexicon as L
from inkveil.functions import text as T
from inkveil.operators.targets import longest_first

PLACEHOLDER = "[REDACTED]"


def alternation(literals: Column) -> Column:
    """One pattern of all literals, longest first; null where there is none."""
    quoted = F.transform(longest_first(literals), lambda x: F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, "|"))


def _replacement(placeholder: str) -> Column:
    return F.lit(re.sub(r"([\\$])", r"\\\1", placeholder))


def redact_text(text: Column, literals: Column, placeholder: str = PLACEHOLDER) -> Column:
    """Leftmost, longest at each start, without overlaps; literal, not normalised."""
    return F.coalesce(F.regexp_replace(text, alternation(literals), _replacement(placeholder)), text)


def find_matches(text: Column, literals: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, alternation(literals), F.lit(0)), F.array().cast("array<string>"))


def redact_sequentially(text: Column, literals: Column, placeholder: str = PLACEHOLDER) -> Column:
    """Literal after literal, longest first; a later one may meet an inserted placeholder."""
    return F.aggregate(longest_first(literals), text, lambda s, x: F.replace(s, x, F.lit(placeholder)))


def scope_plan(requested: DataFrame, targets: DataFrame, scopes: DataFrame) -> DataFrame:
    """doc_id, scope_path, literals: what is redacted where.

    ``requested``: doc_id, literals.  All literals hold everywhere if a document has no
    structured target, one without scopes, or a literal that no target covers; else
    each scope has those of its targets, and scopes without any are not listed.
    """
    by_doc = targets.groupBy("doc_id").agg(F.bool_or(F.size("scopes") == 0).alias("open"), F.flatten(F.collect_list("redaction_literals")).alias("covered"))
    known = requested.join(by_doc, "doc_id", "left")
    missing = F.size(F.array_except(F.filter("literals", lambda x: x != ""), F.coalesce("covered", F.array().cast("array<string>")))) > 0
    known = known.withColumn("full", F.col("open").isNull() | F.col("open") | missing)
    # a row for each document, of a size that Spark takes from that of files: not to be handed out through the driver
    everywhere = scopes.join(known.filter("full").select("doc_id", "literals").hint("merge"), "doc_id").select("doc_id", "scope_path", longest_first(F.col("literals")).alias("literals"))
    placed = targets.join(known.filter("not full").select("doc_id"), "doc_id", "left_semi")
    placed = placed.select("doc_id", F.explode("scopes").alias("s"), "redaction_literals").groupBy("doc_id", F.col("s.path").alias("scope_path"))
    return everywhere.unionByName(placed.agg(longest_first(F.flatten(F.collect_list("redaction_literals"))).alias("literals")))


# -- marked-up parts: tag forms are fixed values of the format ------------------------------


def flatten_track_changes(xml: Column) -> Column:
    """Deletions go, insertions are unwrapped."""
    for pattern, to in ((r"<w:del\b[^>]*/>", ""), (r"(?s)<w:del\b[^>]*>.*?</w:del>", ""), (r"<w:ins\b[^>]*/>", ""), (r"(?s)<w:ins\b[^>]*>(.*?)</w:ins>", "$1")):
        xml = F.regexp_replace(xml, pattern, to)
    return xml


def has_track_changes(xml: Column) -> Column:
    return xml.rlike(r"<w:(?:ins|del)\b")


COMMENT_MARKS = r"<w:comment(?:RangeStart|RangeEnd|Reference)\b"


def strip_comment_references(xml: Column) -> Column:
    return F.regexp_replace(xml, COMMENT_MARKS + r"[^>]*/>", "")


def has_comment_references(xml: Column) -> Column:
    return xml.rlike(COMMENT_MARKS)


_RUN = r"(?s)<w:r(?:\s[^>]*)?>(?:(?!</w:r>).)*?"
FIELD_STEPS = (
    ("<w:fldChar", _RUN + r"<w:fldChar[^>]*/>(?:(?!</w:r>).)*?</w:r>", ""),
    ("<w:instrText", _RUN + r"<w:instrText(?:\s[^>]*)?(?:/>|>.*?</w:instrText>)(?:(?!</w:r>).)*?</w:r>", ""),
    ("<w:fldSimple", r"(?s)<w:fldSimple(?:\s[^>]*)?>(.*?)</w:fldSimple>", "$1"),
    ("<w:fldSimple", r"<w:fldSimple[^>]*/>", ""),
    ("<w:hyperlink", r"(?s)<w:hyperlink(?:\s[^>]*)?>(.*?)</w:hyperlink>", "$1"),
    ("<w:hyperlink", r"<w:hyperlink[^>]*/>", ""),
)


def flatten_fields(xml: Column) -> Column:
    """Field codes go, simple fields and links are unwrapped."""
    for hint, pattern, to in FIELD_STEPS:
        # each step names its text three times; worked out once, or six steps would do the first one's work 64 times
        xml = T.let(xml, lambda x: F.when(x.contains(hint), F.regexp_replace(x, pattern, to)).otherwise(x))  # noqa: B023  (called at once)
    return xml


def scrub_metadata(xml: Column, fields: tuple[str, ...] = L.METADATA_FIELDS) -> Column:
    """Empties the named elements, with or without a prefix."""
    prefix = "(?:[a-zA-Z][a-zA-Z0-9]*:)?"
    for f in fields:
        xml = F.regexp_replace(xml, rf"(<{prefix}{f}\b[^>]*>)([^<]*)(</{prefix}{f}>)", "$1$3")
    return xml


def remove_custom_override(xml: Column) -> Column:
    return F.regexp_replace(xml, r"""\s*<Override\b[^>]*PartName=["']/docProps/custom\.xml["'][^>]*/>""", "")


def strip_external_urls(rels: Column) -> Column:
    """Targets that are web addresses become empty."""
    for quote in ('"', "'"):
        rels = F.regexp_replace(rels, rf"(<Relationship\b[^>]*\bTarget=){quote}https?://[^{quote}]*{quote}", f"$1{quote}{quote}")
    return rels


# -- rewriting of runs ------------------------------------------------------------------

_ENTITY = re.compile(r"&(?:(amp|lt|gt|quot|apos)|#([0-9]+)|#x([0-9a-fA-F]+));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
RUN_TAG = re.compile(r"<w:r(?:\s[^>]*)?(?:/>|>(.*?)</w:r>)", re.S)
TEXT_TAG = re.compile(r"<w:t(?:\s[^>]*)?(?:/>|>(.*?)</w:t>)", re.S)
PARAGRAPH_TAG = re.compile(r"<w:p(?!P|r)(?:\s[^>]*)?(?:/>|>.*?</w:p>)", re.S)
INSTRUCTION = re.compile(r"(<w:instrText(?:\s[^>]*)?>)(.*?)(</w:instrText>)", re.S)
SIMPLE_FIELD = re.compile(r'(<w:fldSimple\s[^>]*?w:instr=")([^"]*)("[^>]*>)')


def decode_entities(s: str) -> str:
    """One pass over named and numeric entities."""
    if "&" not in s:
        return s

    def one(m: re.Match) -> str:
        if m[1]:
            return _NAMED[m[1]]
        code = int(m[2]) if m[2] else int(m[3], 16)
        return chr(code) if code <= 0x10FFFF else m[0]

    return _ENTITY.sub(one, s)


def decode_repeatedly(s: str) -> str:
    """Entity after entity, ampersands before numbers: decodes twice what is encoded twice."""
    for name in ("quot", "apos", "lt", "gt", "amp"):
        s = s.replace(f"&{name};", _NAMED[name])
    s = re.sub(r"&#x([0-9a-fA-F]+);", lambda m: chr(int(m[1], 16)), s)
    return re.sub(r"&#([0-9]+);", lambda m: chr(int(m[1])), s)


def _encode(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def run_texts(paragraph: str) -> list[str]:
    """The decoded text of each run."""
    return ["".join(decode_entities(t[1] or "") for t in TEXT_TAG.finditer(r[0])) for r in RUN_TAG.finditer(paragraph)]


def _one_of(literals) -> re.Pattern | None:
    """A pattern of any of the literals, the longest that fits first."""
    ranked = sorted({x for x in literals if x}, key=lambda x: (-len(x), x))
    return re.compile("|".join(map(re.escape, ranked))) if ranked else None


class Matcher:
    """Rewrites the runs of marked-up parts so that the literals are gone."""

    def __init__(self, literals, placeholder: str = PLACEHOLDER):
        wanted = {x for x in literals if x}
        self.placeholder = placeholder
        self.pattern = _one_of(wanted)
        self.in_attribute = _one_of(wanted | {x.replace('"', "&quot;") for x in wanted})

    def paragraph(self, xml: str) -> str:
        """The first character of a match becomes the placeholder, its others nothing, each in its own run."""
        runs = run_texts(xml)
        becomes = list("".join(runs))
        spans = [m.span() for m in self.pattern.finditer("".join(becomes))]
        if not spans:
            return xml
        for a, z in spans:
            becomes[a:z] = [self.placeholder, *[""] * (z - a - 1)]
        edges = [0, *itertools.accumulate(map(len, runs))]
        texts = iter(["".join(becomes[a:z]) for a, z in itertools.pairwise(edges)])
        return RUN_TAG.sub(lambda r: self._run(r[0], next(texts)), xml)

    def _run(self, run: str, text: str) -> str:
        """A run with its text in the first text element, or in a new one at its end."""
        if "</w:r>" not in run:
            return run
        element = f'<w:t xml:space="preserve">{_encode(text)}</w:t>' if text else "<w:t/>"
        elements = itertools.chain([element], itertools.repeat("<w:t/>"))
        filled, there = TEXT_TAG.subn(lambda _: next(elements), run)
        return filled if there or not text else run.replace("</w:r>", element + "</w:r>", 1)

    def instructions(self, xml: str) -> str:
        """Literals in field codes, which stand as text or, with quotes encoded, as an attribute."""
        for place, pattern in ((INSTRUCTION, self.pattern), (SIMPLE_FIELD, self.in_attribute)):
            xml = place.sub(lambda m, pattern=pattern: m[1] + pattern.sub(lambda _: self.placeholder, m[2]) + m[3], xml)
        return xml

    def scope(self, xml: str) -> str:
        if self.pattern is None:
            return xml
        return self.instructions(PARAGRAPH_TAG.sub(lambda p: p[0] if p[0].endswith("/>") else self.paragraph(p[0]), xml))


def redact_scope_xml(xml: Column, literals: Column, placeholder: str = PLACEHOLDER) -> Column:
    """Run-level redaction of a part, which no built-in function can do."""

    @F.pandas_udf("string")
    def run(parts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else Matcher([] if w is None else list(w), placeholder).scope(x) for x, w in zip(parts, wanted)], dtype=object)

    return run(xml, literals)


RELATIONSHIP = re.compile(r'(<Relationship\b[^>]*\bTarget=")([^"]*)(")')


def repair_rels(rels: Column, literals: Column, placeholder: str = PLACEHOLDER) -> Column:
    """Literals in decoded, double-quoted targets are replaced; then web addresses are emptied."""

    @F.pandas_udf("string")
    def run(parts: pd.Series, wanted: pd.Series) -> pd.Series:
        def one(xml: str | None, literals) -> str | None:
            pattern = None if xml is None or literals is None else _one_of(literals)
            if pattern is None:
                return xml

            def target(m: re.Match) -> str:
                said = decode_repeatedly(m[2])
                return m[1] + _encode(pattern.sub(lambda _: placeholder, said)).replace('"', "&quot;") + m[3] if pattern.search(said) else m[0]

            return RELATIONSHIP.sub(target, xml)

        return pd.Series(list(map(one, parts, wanted)), dtype=object)

    return strip_external_urls(run(rels, literals))


def decode_xml(text: Column, repeatedly: bool = False) -> Column:
    """Entities in text: in the JVM where all are named, by Python else."""
    work = decode_repeatedly if repeatedly else decode_entities

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else work(x))

    named = text
    for name in ("quot", "apos", "lt", "gt", "amp"):  # the ampersand last, so that nothing is decoded twice
        named = F.replace(named, F.lit(f"&{name};"), F.lit(_NAMED[name]))
    plain = F.when(text.contains("&"), named).otherwise(text)
    numbered = text.contains("&#") | (text.contains("&amp;#") if repeatedly else F.lit(False))
    # Python is handed what it decodes; else it would get every text
    return F.when(numbered, run(F.when(numbered, text))).otherwise(plain)
