"""Variants of seed names, found through definitions and shorter forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import lexicon as L
from inkveil.functions import text as T
from inkveil.functions.patterns import SPACE, expand
from inkveil.operators.detect import located

#: Clause forms of raw text (fixed values).
EN_CLAUSE = expand(r'["“”]([^"“”]+?)["“”]\s+(?:shall\s+)?mean(?:s)?\s+([^.,;]+)')
KO_CLAUSE = expand(r'["“”]([^"“”]+?)["“”]\s*(?:이라\s*함은|이란|란)\s+([^.,;을를]+?)(?:을|를|[.,;])')
CLAUSES = ((EN_CLAUSE, "english-means"), (KO_CLAUSE, "korean-이라-함은"))


def definition_clauses(text: Column) -> Column:
    """array<struct<literal, defined, source>> in document order."""

    def of(pattern: str, source: str) -> Column:
        return F.transform(located(text, pattern), lambda x: F.struct(x["at"].alias("at"), T.trim(F.regexp_extract(x["m"], pattern, 2)).alias("literal"), T.trim(F.regexp_extract(x["m"], pattern, 1)).alias("defined"), F.lit(source).alias("source")))

    some = F.when(text.rlike("mean|함은|란"), F.concat(*(of(p, s) for p, s in CLAUSES)))
    found = F.array_sort(F.coalesce(some, F.when(text.isNotNull(), F.array().cast("array<struct<at:int,literal:string,defined:string,source:string>>"))), lambda a, b: a["at"] - b["at"])
    kept = F.filter(found, lambda c: (c["literal"] != "") & (c["defined"] != ""))
    return F.transform(kept, lambda c: F.struct(c["literal"].alias("literal"), c["defined"].alias("defined"), c["source"].alias("source")))


def substring_variants(seed: Column, text: Column) -> Column:
    """Prefixes that stand alone, then the first word with company endings."""
    def of(tokens: Column) -> Column:
        n = F.size(tokens)
        joined = lambda k: F.array_join(F.slice(tokens, F.lit(1), k), " ")
        alone = lambda k: T.count_bounded(text, joined(k)) > T.count_bounded(text, joined(k + 1))
        lengths = F.filter(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda k: (joined(k) != seed) & alone(k))
        endings = F.transform(F.array(*map(F.lit, L.COMPANY_ENDINGS)), lambda e: F.concat(tokens[0], F.lit(" "), e))
        named = F.filter(endings, lambda c: (c != seed) & (T.count_bounded(text, c) > 0))
        return F.when((n >= 2) & text.contains(tokens[0]), F.array_distinct(F.concat(F.transform(lengths, joined), named))).otherwise(F.array().cast("array<string>"))

    return T.let(F.filter(F.split(seed, f"[{SPACE}]+"), lambda t: t != ""), of)


def propagate(seed: Column, text: Column, clauses: Column) -> Column:
    """array<struct<text, kind, count>>: the seed's literal and defined forms, literals first."""
    entry = lambda t, k: F.struct(t.alias("text"), k.alias("kind"))
    literal, defined = F.lit("literal"), F.lit("defined")
    kind = lambda v: F.when((v != seed) & T.is_defined_term(v), defined).otherwise(literal)
    linked = F.filter(clauses, lambda c: c["literal"] == seed)
    forced = lambda t: entry(t, F.when(t == seed, literal).otherwise(defined))
    named = F.flatten(F.transform(linked, lambda c: F.array(forced(c["defined"]), forced(F.concat(F.lit("the "), c["defined"])), forced(F.concat(F.lit("The "), c["defined"])))))
    every = F.array_distinct(F.concat(F.array(entry(seed, literal)), F.transform(substring_variants(seed, text), lambda v: entry(v, kind(v))), named))
    counted = F.filter(F.transform(every, lambda e: F.struct(e["text"].alias("text"), e["kind"].alias("kind"), T.count_bounded(text, e["text"]).alias("count"))), lambda e: e["count"] > 0)
    return T.let(counted, lambda c: F.concat(F.filter(c, lambda e: e["kind"] == "literal"), F.filter(c, lambda e: e["kind"] == "defined")))


def redaction_targets(groups: Column, include_defined: Column) -> Column:
    """Literal forms and the defined ones opted into, distinct, longest first, else in order."""
    kept = F.filter(groups, lambda e: (e["kind"] == "literal") | F.array_contains(include_defined, e["text"]))
    texts = F.array_distinct(F.transform(kept, lambda e: e["text"]))
    ranked = F.array_sort(F.transform(texts, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.transform(ranked, lambda r: r["t"])
