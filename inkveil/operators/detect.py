"""Detection as narrow transforms: a row in, its findings as arrays, no shuffle.

``analyze_text`` adds to every row ``norm``, ``language``, ``definitions`` and
``candidates``; ``candidates`` and ``definitions`` explode them.  Rules of a level
are chosen when the plan is built, rules of a language row by row.  Order within
the arrays is the order of phases, rules and matches; ``ord`` carries it on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import lexicon as L
from inkveil.functions import text as T
from inkveil.functions.patterns import SPACE, expand
from inkveil.rules.registry import BY_ID, LEGACY, RULES, STANDARD, Rule, at_level, led, speaks

FINDING = "struct<text:string,rule_id:string,confidence:double,norm_text:string>"
DEFINITION = "struct<label:string,referent:string,source:string>"


def _array(items: list[Column], kind: str) -> Column:
    return F.concat(*items) if items else F.array().cast(f"array<{kind}>")


def mark_for(norm: Column) -> Column:
    """What can stand between matches and the rest of a text: more of a character in a row than the text has of it."""
    return F.concat(F.lit("\ufffe"), F.repeat(F.lit("\uffff"), F.length(norm) - F.length(F.replace(norm, F.lit("\uffff"), F.lit(""))) + 1))


def in_turn(norm: Column, pattern: str, mark: Column) -> Column:
    """array<string>: what is before the first match, the match, what is before the next, and so on to the end.

    A pattern is compiled once in a replacement, but for every row in a split.
    """
    return F.split(F.regexp_replace(norm, F.lit(pattern), F.concat(mark, F.lit("$0"), mark)), mark, -1)


def placed(parts: Column) -> Column:
    """array<struct<m, at>> of pieces and matches in turn."""
    at = lambda p, k: F.aggregate(F.slice(p, F.lit(1), k), F.lit(0), lambda s, x: s + F.length(x))
    one = lambda p, i: F.struct(p[2 * i - 1].alias("m"), at(p, 2 * i - 1).alias("at"))
    some = lambda p: F.transform(F.sequence(F.lit(1), F.floor(F.size(p) / 2).cast("int")), lambda i: one(p, i))
    return T.let(parts, lambda p: F.when(F.size(p) > 1, some(p)).otherwise(F.when(p.isNotNull(), F.array().cast("array<struct<m:string,at:int>>"))))


def located(norm: Column, pattern: str) -> Column:
    """array<struct<m, at>>: matches with their places."""
    return T.let(mark_for(norm), lambda mark: placed(in_turn(norm, pattern, mark)))


def literal_places(text: Column, literal: Column) -> Column:
    """Where a literal starts, overlaps included."""
    # a look-ahead matches before each; what stands between the marks then gives the places
    parts = lambda mark: F.split(F.regexp_replace(text, F.concat(F.lit("(?="), T.quoted(literal), F.lit(")")), mark), mark, -1)
    starts = lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: F.aggregate(F.slice(p, F.lit(1), i + 1), F.lit(0), lambda s, y: s + F.length(y)))
    found = T.let(T.let(mark_for(text), parts), starts)
    return F.when(text.contains(literal) & (literal != ""), found).otherwise(F.array().cast("array<int>"))


def matches(text: Column, norm: Column, offsets: Column, pattern: str, group: int = 0, inner: int = 0) -> Column:
    """array<struct<norm_text, text>>: matches of a pattern with the original characters.

    Where normalisation changed nothing, a match is its own original; elsewhere places
    are worked out.  ``inner`` characters are left off at both ends of the original.
    """
    plain = F.transform(F.regexp_extract_all(norm, F.lit(pattern), F.lit(group)), lambda m: F.struct(m.alias("norm_text"), m.alias("text")))

    def recover(x: Column) -> Column:
        m = F.substring(x["m"], inner + 1, F.length(x["m"]) - 2 * inner) if inner else x["m"]
        return F.struct(m.alias("norm_text"), T.original_slice(text, offsets, x["at"] + inner, x["at"] + F.length(x["m"]) - inner).alias("text"))

    return F.when(norm == text, plain).otherwise(F.transform(located(norm, pattern), recover))


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found_by(rule: Rule, spoken: bool) -> str:
    """SQL of struct<id, found>: the matches of a rule, or pieces and matches in turn where normalisation changed the text.

    It reads the columns norm, same, mark and language.  As SQL, a plan of all rules is built in fewer calls to the JVM.
    """
    hints = (rule.hint, *rule.hints) if rule.hint else rule.hints
    when = [f"(language = 'mixed' OR language IN ({', '.join(map(_text, rule.languages))}))"] if spoken and "universal" not in rule.languages else []
    when += ["(" + " OR ".join(f"contains(norm, {_text(h)})" for h in hints) + ")"] if hints else []
    p = _text(rule.pattern)
    search = f"CASE WHEN same THEN regexp_extract_all(norm, {p}, 0) ELSE split(regexp_replace(norm, {p}, concat(mark, '$0', mark)), mark, -1) END"
    return f"named_struct('id', {_text(rule.id)}, 'found', CASE WHEN {' AND '.join(when) or 'true'} THEN {search} ELSE CAST(array() AS ARRAY<STRING>) END)"


def findings_of(rules: Sequence[Rule], text: Column, spoken: bool = True) -> Column:
    """array of findings of the rules, in rule order; of columns norm, offsets, same, mark and language (if ``spoken``).

    Patterns are constants of the plan, so each is compiled once; places and original
    characters are worked out for rules that found something in a text that normalisation changed.
    """
    if not rules:
        return F.array().cast(f"array<{FINDING}>")
    same, offsets = F.col("same"), F.col("offsets")
    table = F.expr(f"array({', '.join(_found_by(r, spoken) for r in rules)})")
    finding = lambda r, original, m: F.struct(original.alias("text"), r["id"].alias("rule_id"), F.lit(1.0).alias("confidence"), m.alias("norm_text"))
    original = lambda x: T.original_slice(text, offsets, x["at"], x["at"] + F.length(x["m"]))

    def of(r: Column) -> Column:
        recovered = F.transform(placed(r["found"]), lambda x: finding(r, original(x), x["m"]))
        return F.when(same, F.transform(r["found"], lambda m: finding(r, m, m))).otherwise(recovered)

    passes = lambda x: T.all_of([(x["rule_id"] != r.id) | r.check(x["norm_text"]) for r in rules if r.check is not None])
    every = F.flatten(F.transform(F.filter(table, lambda r: F.size(r["found"]) > F.when(same, 0).otherwise(1)), of))
    return F.filter(every, passes) if any(r.check is not None for r in rules) else every


def regex_phase(text: Column, level: str = STANDARD, rules: Sequence[Rule] = RULES) -> Column:
    """array of findings of all rules of a level, in rule order."""
    return findings_of([r for _, r in at_level(rules, level)], text)


def _prepared(df: DataFrame, text: Column, **more: Callable[[Column], Column]) -> DataFrame:
    """With columns norm, same, offsets and mark (where normalisation changed the text), and more of the normalised text."""
    norm = F.col("norm")
    same = norm == text
    columns = {"same": same, "offsets": F.when(~same, T.original_offsets(text)), "mark": F.when(~same, mark_for(norm))}
    return df.withColumn("norm", T.normalize(text)).withColumns(columns | {name: f(norm) for name, f in more.items()})


# -- structural definitions -------------------------------------------------------------
# Patterns and scan limits of this part are fixed values.

EN_MEANS = expand(r'"([^"]+)"\s+(?:means|shall\s+mean)\s+([^.;]+)')
EN_HEREINAFTER = expand(r'hereinafter(?:\s+referred\s+to)?\s+as\s+"([^"]+)"')
KO_MEANS = expand(r'"([^"]+)"(?:이라|란)\s*함은\s*([^.。\n]+)')
KO_HEREINAFTER = expand(r'이하\s*"([^"]+)"(?:라\s*(?:한다|칭한다))?')
EN_TITLE = expand(r"(?<![A-Za-z])([A-Z][A-Z\s\-]{3,60}?(?:AGREEMENT|CONTRACT|MOU))(?![A-Za-z])")
KO_TITLE = r"(?<![가-힣])([가-힣][가-힣A-Za-z0-9]{1,30}?(?:계약서|합의서|각서|협정서))(?![가-힣])"
EN_PARTY = expand(r"""([A-Z][A-Za-z0-9&.\-]*(?:\s+[A-Z][A-Za-z0-9&.\-]*){0,4})[^.()]{0,200}?\(\s*hereinafter(?:\s+referred\s+to)?\s+as\s+['"]([^'"]+)['"]\s*\)""")
#: Follows from EN_PARTY: after all the capitalised words at a place, the next bracket opens the definition and no full stop comes before it.
EN_PARTY_SOON = expand(r"(?=[A-Z][A-Za-z0-9&.\-]*+(?:\s++[A-Z][A-Za-z0-9&.\-]*+){0,4}+[^.()]*+\(\s*hereinafter)")
KO_PARTY = expand(r"""([가-힣A-Za-z0-9][가-힣A-Za-z0-9\s]{0,30}?주식회사)\s*\(\s*이하\s*['"]?([가-힣A-Za-z0-9]+)['"]?(?:(?:라|이)\s*함)?\s*\)""")
EN_WHEREAS = expand(r"WHEREAS\s*,\s*([A-Z][A-Za-z0-9&.\-]*(?:\s+[A-Z][A-Za-z0-9&.\-]*){0,4})")
KO_PREAMBLE = expand(r"(?:전문|배경)(?s:.{0,500}?)([가-힣][가-힣A-Za-z0-9]*\s*주식회사)").replace("[^\\n\\r\\x{2028}\\x{2029}]{0,500}?", ".{0,500}?")
EN_NAME = expand(r"Name\s*:\s*([A-Z][A-Za-z.\-]+(?:\s+[A-Z][A-Za-z.\-]+){0,2})")
EN_SIGN_TITLE = expand(r"Title\s*:\s*([A-Z][A-Za-z\s.\-]{2,40})")
KO_SIGN_TITLE = expand(r"(?<![가-힣A-Za-z])(대표이사|대표|부사장|사장|이사|본부장|팀장)\s+([가-힣]{2,4})(?![가-힣])")
KO_NAME = expand(r"이름\s*:\s*([가-힣]{2,4})(?![가-힣])")
HEAD_TITLE, HEAD_PARTIES, HEAD_RECITALS, SIGN_LEAST, REFERENT_LENGTH = 500, 2000, 5000, 200, 200


def _define(label: Column, referent: Column, source: str) -> Column:
    return F.struct(label.alias("label"), referent.alias("referent"), F.lit(source).alias("source"))


def _both(text: Column, pattern: str, make: Callable[[Column], Column], *hints: str) -> Column:
    """Definitions of each match of a pattern of two groups that looks at nothing around a match, by one search.

    Such a pattern finds the same groups in a match alone.  Texts without a hint have no match.
    """
    parts = lambda m: F.struct(*(F.regexp_extract(m, pattern, k + 1).alias(str(k)) for k in range(2)))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: T.let(parts(m), make))
    return F.when(T.all_of([text.contains(h) for h in hints]), found).otherwise(F.when(text.isNotNull(), F.array().cast(f"array<{DEFINITION}>")))


def _each(text: Column, pattern: str, make: Callable[[Column], Column], groups: int = 1) -> Column:
    """Definitions of each match; struct fields ``0`` and ``1`` hold the groups."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)).alias(str(k)) for k in range(groups)]
    return F.transform(F.arrays_zip(*parts), make)


def _referent(x: Column) -> Column:
    return T.trim(F.substring(F.regexp_extract(x, r"^[^.;。、\n]*", 0), 1, REFERENT_LENGTH))


def definition_section(norm: Column) -> Column:
    return F.concat(
        _both(norm, EN_MEANS, lambda x: _define(x["0"], _referent(x["1"]), "definition-section"), "mean"),
        _each(norm, EN_HEREINAFTER, lambda x: _define(x["0"], F.lit(""), "definition-section")),
        _both(norm, KO_MEANS, lambda x: _define(x["0"], _referent(x["1"]), "definition-section"), "함은"),
        _each(norm, KO_HEREINAFTER, lambda x: _define(x["0"], F.lit(""), "definition-section")),
    )


def party_declaration(norm: Column) -> Column:
    head = F.substring(norm, 1, HEAD_PARTIES)
    return F.concat(
        _both(head, EN_PARTY_SOON + EN_PARTY, lambda x: _define(x["1"], T.trim(x["0"]), "party-declaration"), "hereinafter"),
        _both(head, KO_PARTY, lambda x: _define(T.trim(x["1"]), T.trim(x["0"]), "party-declaration"), "주식회사", "이하"),
    )


def recitals(norm: Column) -> Column:
    head = F.substring(norm, 1, HEAD_RECITALS)
    return F.concat(*(_each(head, p, lambda x: _define(F.lit(""), T.trim(x["0"]), "recitals")) for p in (EN_WHEREAS, KO_PREAMBLE)))


def signature_block(norm: Column) -> Column:
    tail = F.substring(norm, F.floor(F.length(norm) * (1 - 0.2)).cast("int") + 1, F.length(norm))
    source = "party-declaration"
    found = F.concat(
        _each(tail, EN_NAME, lambda x: _define(F.lit("Signatory"), T.trim(x["0"]), source)),
        _each(tail, EN_SIGN_TITLE, lambda x: _define(F.lit("Title"), T.trim(x["0"]), source)),
        _each(tail, KO_SIGN_TITLE, lambda x: _define(x["0"], x["1"], source), 2),
        _each(tail, KO_NAME, lambda x: _define(F.lit("이름"), x["0"], source)),
    )
    return F.when(F.length(norm) >= SIGN_LEAST, found).otherwise(F.array().cast(f"array<{DEFINITION}>"))


def header_block(norm: Column) -> Column:
    head = F.substring(norm, 1, HEAD_TITLE)
    titles = F.array(*(F.regexp_extract(head, p, 1) for p in (EN_TITLE, KO_TITLE)))
    return F.transform(F.filter(titles, lambda t: t != ""), lambda t: _define(F.lit("document-title"), T.trim(t), "definition-section"))


PARSERS: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("structural.definition-section", definition_section),
    ("structural.party-declaration", party_declaration),
    ("structural.recitals", recitals),
    ("structural.signature-block", signature_block),
    ("structural.header-block", header_block),
)


def structural_phase(norm: Column, parsers: Sequence[tuple[str, Callable[[Column], Column]]] = PARSERS) -> Column:
    return _array([p(norm) for _, p in parsers], DEFINITION)


# -- heuristics ------------------------------------------------------------------------

CLUSTER = led("A-Za-z", expand(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4}(?![A-Za-z])"))
QUOTED = r"""["']([^"']{2,50})["']"""
EN_TOKEN = led("A-Za-z", expand(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}(?![A-Za-z])"))
KO_TOKEN = led("가-힣", r"[가-힣]{2,6}(?![가-힣])")
LEAST_REPEATS = 3


class Context:
    """What heuristics see of a row: its texts, definitions and earlier findings."""

    def __init__(self, text: Column, norm: Column, offsets: Column, definitions: Column, priors: Column):
        self.text, self.norm, self.offsets, self.priors = text, norm, offsets, priors
        self.known = F.array_distinct(F.concat(F.transform(definitions, lambda d: d["label"]), F.transform(priors, lambda p: p["text"])))

    def unknown(self, found: Column, name: str, ok: Callable[[Column], Column]) -> Column:
        """Of found structs those whose name is new and passes a test."""
        return T.let(self.known, lambda known: F.filter(found, lambda x: ~F.array_contains(known, x[name]) & ok(x[name])))


def _found(x: Column, norm: Column, rule: str, confidence: Column | float) -> Column:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(x.alias("text"), F.lit(f"heuristics.{rule}").alias("rule_id"), c.cast("double").alias("confidence"), norm.alias("norm_text"))


def capitalization_cluster(c: Context) -> Column:
    roles = lambda m: F.exists(F.split(F.lower(m), f"[{SPACE}]+"), lambda w: w.isin(*L.ROLES_EN))
    ok = c.unknown(matches(c.text, c.norm, c.offsets, CLUSTER), "norm_text", lambda m: ~roles(m))
    return F.transform(ok, lambda x: _found(x["text"], x["norm_text"], "capitalization-cluster", 0.7))


def quoted_term(c: Context) -> Column:
    found = matches(c.text, c.norm, c.offsets, QUOTED, group=1, inner=1)
    ok = c.unknown(found, "norm_text", lambda m: ~T.is_role(m))
    return F.transform(ok, lambda x: _found(x["text"], x["norm_text"], "quoted-term", 0.6))


def repeatability(c: Context) -> Column:
    tokens = F.concat(matches(c.text, c.norm, c.offsets, EN_TOKEN), matches(c.text, c.norm, c.offsets, KO_TOKEN))

    def frequent(tokens: Column) -> Column:
        """The first token of each name that is there often enough, in order."""
        placed = F.transform(tokens, lambda t, i: F.struct(t["norm_text"].alias("n"), i.alias("i"), t["text"].alias("t")))

        def firsts(ranked: Column) -> Column:
            # sorted, a name starts where another ends, and is frequent if it is there some places on
            starts = lambda x, i: (i == 0) | (F.get(ranked, i - 1)["n"] != x["n"])
            many = lambda x, i: F.coalesce(F.get(ranked, i + (LEAST_REPEATS - 1))["n"] == x["n"], F.lit(False))
            kept = F.filter(ranked, lambda x, i: many(x, i) & F.coalesce(starts(x, i), F.lit(True)))
            return F.array_sort(F.transform(kept, lambda x: F.struct(x["i"].alias("i"), x["n"].alias("norm_text"), x["t"].alias("text"))))

        return T.let(F.array_sort(placed), firsts)

    ok = c.unknown(T.let(tokens, frequent), "norm_text", lambda n: ~T.is_role(n))
    return F.transform(ok, lambda x: _found(x["text"], x["norm_text"], "repeatability", 0.5))


def _domain_name(domain: Column) -> Column:
    parts = F.split(domain, r"\.")
    top = F.aggregate(F.reverse(parts), F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), lambda s, p: F.struct((s["n"] + F.when(s["open"] & p.isin(*L.TOP_DOMAINS), 1).otherwise(0)).alias("n"), (s["open"] & p.isin(*L.TOP_DOMAINS)).alias("open")))["n"]
    kept = F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.size(parts) - top))
    words = F.transform(F.split(F.array_join(kept, " "), r"[-.]"), T.title_case)
    return T.trim(F.array_join(words, " "))


def email_domain_inference(c: Context) -> Column:
    mails = F.filter(c.priors, lambda p: p["rule_id"].startswith("identifiers.email") & p["text"].contains("@") & F.substring_index(p["text"], "@", -1).contains("."))
    named = F.transform(mails, lambda p: F.struct(_domain_name(F.substring(p["text"], F.locate("@", p["text"]) + 1, F.length(p["text"]))).alias("name"), F.lower(F.substring_index(p["text"], "@", 1)).alias("box")))
    ok = c.unknown(named, "name", lambda n: (F.length(n) >= 2) & ~F.lower(n).isin(*L.ROLES_EN))

    def once(ok: Column) -> Column:
        names = F.transform(ok, lambda x: x["name"])

        def make(n: Column) -> Column:
            box = F.element_at(F.filter(ok, lambda x: x["name"] == n), 1)["box"]
            at = F.position(n, c.norm) - 1
            shown = F.when((at < 0) | (c.norm == c.text), n).otherwise(T.original_slice(c.text, c.offsets, at, at + F.length(n)))
            return _found(shown, n, "email-domain-inference", F.when(box.isin(*L.OFFICE_MAILBOXES), 0.8).otherwise(0.6))

        return F.transform(F.array_distinct(names), make)

    return T.let(ok, once)


#: (id, languages, levels, function), in the order in which they run; none sees another's findings.
HEURISTICS: tuple[tuple[str, tuple[str, ...], tuple[str, ...], Callable[[Context], Column]], ...] = (
    ("heuristics.capitalization-cluster", ("en",), ("standard", "paranoid"), capitalization_cluster),
    ("heuristics.quoted-term", ("ko", "en"), ("standard", "paranoid"), quoted_term),
    ("heuristics.repeatability", ("ko", "en"), ("paranoid",), repeatability),
    ("heuristics.email-domain-inference", ("universal",), ("paranoid",), email_domain_inference),
)


def heuristic_phase(context: Context, language: Column, level: str = STANDARD, heuristics: Sequence = HEURISTICS) -> Column:
    runs = [F.when(speaks(langs, language), f(context)).otherwise(F.array().cast(f"array<{FINDING}>")) for _, langs, levels, f in heuristics if level in levels]
    return _array(runs, FINDING)


# -- entry points ------------------------------------------------------------------------


def analyze_text(df: DataFrame, level: str = STANDARD, language: str | None = None, text_col: str = "text", rules: Sequence[Rule] = RULES, parsers: Sequence = PARSERS, heuristics: Sequence = HEURISTICS, language_of: str = "raw") -> DataFrame:
    """Adds norm, offsets, language, definitions and candidates to every row.

    The language is that of the raw text, or with ``language_of="normalized"`` that
    of the normalised one; ``language`` overrides both.  Null texts count as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.col("norm")
    spoken = lambda n: F.lit(language) if language else T.detect_language(text if language_of == "raw" else n)
    df = _prepared(df, text, language=spoken, definitions=lambda n: structural_phase(n, parsers))
    df = df.withColumn("regex_candidates", regex_phase(text, level, rules))
    seen = Context(text, norm, F.col("offsets"), F.col("definitions"), F.col("regex_candidates"))
    found = F.concat("regex_candidates", heuristic_phase(seen, F.col("language"), level, heuristics))
    return df.withColumn("candidates", found).drop("regex_candidates", "offsets", "same", "mark")


def candidates(analyzed: DataFrame, *keys: str) -> DataFrame:
    """One row a finding: keys, language, ord, text, rule_id, confidence."""
    # outer, since else a filter on the size is pushed down and repeats the whole detection in the plan
    rows = analyzed.select(*keys, "language", F.posexplode_outer("candidates").alias("ord", "c")).filter("ord is not null")
    return rows.select(*keys, "language", "ord", "c.text", "c.rule_id", "c.confidence")


def definitions(analyzed: DataFrame, *keys: str) -> DataFrame:
    rows = analyzed.select(*keys, F.posexplode_outer("definitions").alias("ord", "d")).filter("ord is not null")
    return rows.select(*keys, "ord", "d.label", "d.referent", "d.source")


def detect_all(df: DataFrame, *keys: str, level: str = STANDARD, language: str | None = None, text_col: str = "text") -> DataFrame:
    return candidates(analyze_text(df, level, language, text_col), *keys)


def detect_legacy(df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
    """The eight identifier kinds of all texts, kind by kind: keys, ord, kind, original, normalized."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = _prepared(df, text)
    found = findings_of([BY_ID[f"identifiers.{s}"] for s in LEGACY], text, spoken=False)
    rows = df.select(*keys, F.posexplode(found).alias("ord", "c"))
    kind = F.create_map(*[x for s in LEGACY for x in (F.lit(f"identifiers.{s}"), F.lit(L.KIND_OF[s]))])
    return rows.select(*keys, "ord", F.element_at(kind, F.col("c.rule_id")).alias("kind"), F.col("c.text").alias("original"), F.col("c.norm_text").alias("normalized"))


# -- keyword suggestions -----------------------------------------------------------------

TITLE_WORDS = expand(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?![A-Za-z0-9_])")
PREFIXED = expand(r"(?i:Project|프로젝트|브랜드|제품|코드명|모델(?:명)?)\s+\S+")
VERSIONED = expand(r"\S+\s+(?:\d+\.\d+|(?i:v)\d+|(?i:alpha|beta|rc))(?![A-Za-z0-9_])")
SUGGEST_QUOTED = r"""["'「『]([^"'」』]{2,30})["'」』]"""


def suggest_keywords(text: Column, least: int = 5, least_quoted: int = 3, exclude: Sequence[str] = ()) -> Column:
    """Frequent titles, product names, versions and quoted words of a raw text."""
    keep = lambda k: (F.length(k) >= 2) & ~k.isin(*exclude, "") & ~T.is_stop_phrase(k)
    ruled = F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (TITLE_WORDS, PREFIXED, VERSIONED))))
    often = F.filter(ruled, lambda k: keep(k) & (T.count_occurrences(text, k) >= least))
    quoted = F.regexp_extract_all(text, F.lit(SUGGEST_QUOTED), F.lit(1))
    said = T.let(quoted, lambda quoted: F.filter(F.array_distinct(quoted), lambda k: keep(k) & (F.size(F.filter(quoted, lambda q: q == k)) >= least_quoted)))
    return F.array_distinct(F.concat(often, said))
