"""The registered queries of the text engine, and SQL that says the same."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import lexicon as L
from inkveil.functions import text as T
from inkveil.operators import detect as D
from inkveil.operators import policy, propagate, session
from inkveil.operators import redact as R
from inkveil.operators import targets as G
from inkveil.operators import verify as V
from inkveil.plans import oracle as O
from inkveil.plans.fixtures import CONTRACTS, NOISY, contracts, dealt, noisy, table
from inkveil.rules.registry import BY_ID, LEGACY, RULES, Rule
from inkveil.sources import docx
from inkveil.sources.shared import shared_path, written
from inkveil.streaming import detect as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "redact_documents_whole"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


DOCUMENTS = "SELECT doc_id, text FROM documents"
#: What every second turn says besides, so that there is something to find.
SAID = "concat(text, CASE WHEN turn % 2 = 0 THEN concat(' (mail u', conv_id, '@acme.co.kr, paid $', turn, '.50 and 5%)') ELSE '' END)"
TURNS = f"SELECT conv_id * 1000 + turn AS doc_id, {SAID} AS text FROM conversations"
PAGES = "SELECT page_id AS doc_id, html AS text FROM pages"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# -- text functions -----------------------------------------------------------------------


@query("text_normalize", f"SELECT doc_id, sha256({O.norm('text')}) AS norm_sha256, length({O.norm('text')}) AS n FROM ({NOISY}) t")
def text_normalize(spark, sf_dir):
    return noisy(spark, sf_dir).select("doc_id", F.sha2(T.normalize("text").cast("binary"), 256).alias("norm_sha256"), F.length(T.normalize("text")).cast("long").alias("n"))


@query("text_offsets", f"""SELECT doc_id, list_sum(list_filter(list_transform(string_split(text, ''), lambda c, i: CASE WHEN contains({O.lit(L.ZERO_WIDTH)}, c) THEN NULL ELSE i - 1 END), lambda x: x IS NOT NULL))::BIGINT + length(text) AS total
FROM ({NOISY}) t""")
def text_offsets(spark, sf_dir):
    total = F.aggregate(T.original_offsets("text"), F.lit(0).cast("long"), lambda s, x: s + x)
    return noisy(spark, sf_dir).select("doc_id", total.alias("total"))


@query("text_nfc", f"SELECT doc_id, sha256({O.norm('nfc_normalize(text)')}) AS norm_sha256 FROM documents")
def text_nfc(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(T.nfc("text").cast("binary"), 256).alias("norm_sha256"))


@query("text_language", f"SELECT doc_id, {O.language('text')} AS language FROM ({CONTRACTS} UNION ALL SELECT doc_id * -1 - 1, lang, text FROM documents) t")
def text_language(spark, sf_dir):
    both = contracts(spark, sf_dir).unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") * -1 - 1).alias("doc_id"), "lang", "text"))
    return both.select("doc_id", T.detect_language("text").alias("language"))


@query("text_words", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s\\x0B\\x{A0}\\x{3000}]+'), lambda w: w <> ''))::BIGINT AS words FROM documents")
def text_words(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.count_words("text").cast("long").alias("words"))


@query("text_literal_count", "SELECT doc_id, item_id, ((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text))::BIGINT AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def text_literal_count(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("literal"))
    # the list of literals is small by nature; documents are never paired with each other
    hits = documents(spark, sf_dir).join(items, F.col("text").contains(F.col("literal")))
    return hits.select("doc_id", "item_id", T.count_occurrences(F.col("text"), F.col("literal")).cast("long").alias("n"))


@query("text_bounded_count", f"SELECT doc_id, 'Acme' AS needle, count(hit)::BIGINT AS n FROM ({CONTRACTS}) c LEFT JOIN (SELECT doc_id AS d, hit FROM {O.scan(O.prepared(CONTRACTS), 'Acme', 'A-Za-z0-9_', 'A-Za-z0-9_')}) s ON s.d = doc_id GROUP BY doc_id")
def text_bounded_count(spark, sf_dir):
    return contracts(spark, sf_dir).select("doc_id", F.lit("Acme").alias("needle"), T.count_bounded(F.col("text"), F.lit("Acme")).cast("long").alias("n"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query("text_target_id", f"SELECT c_custkey, 'auto:' || lpad(lower(to_hex({_FNV.format(x='c_name')})), 8, '0') AS id FROM customer")
def text_target_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.target_id("auto", "c_name").alias("id"))


@query("text_sha256", "SELECT doc_id, sha256(text) AS hash, upper(substr(sha256(text), 1, 8)) AS short FROM documents")
def text_sha256(spark, sf_dir):
    data = F.col("text").cast("binary")
    return documents(spark, sf_dir).select("doc_id", T.sha256_hex(data).alias("hash"), T.sha256_hex(data, 8, upper=True).alias("short"))


@query("text_xml", "SELECT doc_id, sha256(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS encoded, sha256(text) AS decoded FROM documents")
def text_xml(spark, sf_dir):
    encoded = documents(spark, sf_dir).select("doc_id", T.encode_xml(F.col("text")).alias("x"))
    return encoded.select("doc_id", F.sha2(F.col("x").cast("binary"), 256).alias("encoded"), F.sha2(R.decode_xml(F.col("x")).cast("binary"), 256).alias("decoded"))


_WORDS = "SELECT doc_id, w AS word FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) x"


@query("text_vocabulary_roles", f"""SELECT word, count(*) AS n, {O.in_list('word', L.STOP_WORDS)} OR regexp_full_match(word, {O.lit('|'.join(L.STOP_FORMS))}) AS stop,
{O.in_list('word', L.DEFINED_ROLES)} AS defined, {O.in_list('lower(word)', L.ROLES_EN)} OR {O.in_list('word', L.ROLES_KO)} AS role FROM ({_WORDS}) t GROUP BY word""")
def text_vocabulary_roles(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    w = F.col("word")
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", T.is_stop_phrase(w).alias("stop"), T.is_defined_term(w).alias("defined"), T.is_role(w).alias("role"))


# -- one query a rule -----------------------------------------------------------------------


def _rule_query(rule: Rule) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = D.analyze_text(contracts(spark, sf_dir), rule.levels[-1], rules=(rule,), parsers=(), heuristics=())
        return D.candidates(found, "doc_id").groupBy("doc_id", "text").agg(F.count("*").alias("n"))

    return run


for _r in RULES:
    query("rule_" + _r.id.replace(".", "_").replace("-", "_"), f"SELECT doc_id, text, count(*) AS n FROM ({O.rule_matches(_r, CONTRACTS)}) m GROUP BY doc_id, text")(_rule_query(_r))

_UNIVERSAL = [r for r in RULES if "universal" in r.languages]


def _found(rules, corpus: str) -> str:
    """doc_id, ord, text, rule_id of several rules, in rule order."""
    parts = [f"SELECT doc_id, {k} AS r, place, text, '{x.id}' AS rule_id FROM ({O.rule_matches(x, corpus)}) m{k}" for k, x in enumerate(rules)]
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r, place) - 1 AS ord, text, rule_id FROM ({' UNION ALL '.join(parts)}) u"


def _detected(df: DataFrame, whole: bool = False) -> DataFrame:
    """Detection by what the SQL has, the universal rules; or by all rules, parsers and heuristics."""
    return D.analyze_text(df, "paranoid") if whole else D.analyze_text(df, "paranoid", rules=_UNIVERSAL, parsers=(), heuristics=())


def _corpus_query(load: Query, whole: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _detected(dealt(load(spark, sf_dir), "doc_id"), whole)
        return D.candidates(found, "doc_id").groupBy("doc_id", "rule_id", "text").agg(F.count("*").alias("n"))

    return run


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.expr(SAID).alias("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


for _name, _load, _sql in (("documents", documents, DOCUMENTS), ("pages", pages, PAGES), ("conversations", turns, TURNS)):
    query(f"detect_{_name}", f"SELECT doc_id, rule_id, text, count(*) AS n FROM ({_found(_UNIVERSAL, _sql)}) f GROUP BY doc_id, rule_id, text")(_corpus_query(_load))
    query(f"detect_{_name}_whole")(_corpus_query(_load, whole=True))


@query("detect_legacy", "SELECT doc_id, kind, original, normalized, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{L.KIND_OF[s]}' AS kind, text AS original, norm_text AS normalized FROM ({O.rule_matches(BY_ID['identifiers.' + s], CONTRACTS, True)}) m" for s in LEGACY) + ") u GROUP BY ALL")
def detect_legacy(spark, sf_dir):
    return D.detect_legacy(contracts(spark, sf_dir), "doc_id").groupBy("doc_id", "kind", "original", "normalized").agg(F.count("*").alias("n"))


# -- structure and heuristics ------------------------------------------------------------------

_EN_HEAD = f"substr(norm, 1, {D.HEAD_PARTIES})"


def _defs(x: str, pattern: str, label: str, referent: str, source: str, groups: int = 1, where: str = "true") -> str:
    return f"SELECT doc_id, {label} AS label, {referent} AS referent, '{source}' AS source FROM (SELECT doc_id, unnest({O.pairs(x, pattern, groups)}) AS g FROM ({O.prepared(CONTRACTS)}) c WHERE {where}) d"


_REF = "regexp_extract(g[2], '^[^.;。、\\n]*')"
_TAIL = "substr(norm, floor(length(norm) * (1 - 0.2))::BIGINT + 1)"
_PARSER_SQL = {
    "definition_section": " UNION ALL ".join((
        _defs("norm", D.EN_MEANS, "g[1]", O.trim(f"substr({_REF}, 1, {D.REFERENT_LENGTH})"), "definition-section", 2), _defs("norm", D.EN_HEREINAFTER, "g[1]", "''", "definition-section"),
        _defs("norm", D.KO_MEANS, "g[1]", O.trim(f"substr({_REF}, 1, {D.REFERENT_LENGTH})"), "definition-section", 2), _defs("norm", D.KO_HEREINAFTER, "g[1]", "''", "definition-section"),
    )),
    "party_declaration": " UNION ALL ".join((_defs(_EN_HEAD, D.EN_PARTY, "g[2]", O.trim("g[1]"), "party-declaration", 2), _defs(_EN_HEAD, D.KO_PARTY, O.trim("g[2]"), O.trim("g[1]"), "party-declaration", 2))),
    "recitals": " UNION ALL ".join(_defs(f"substr(norm, 1, {D.HEAD_RECITALS})", p, "''", O.trim("g[1]"), "recitals") for p in (D.EN_WHEREAS, D.KO_PREAMBLE)),
    "signature_block": " UNION ALL ".join((
        _defs(_TAIL, D.EN_NAME, "'Signatory'", O.trim("g[1]"), "party-declaration", 1, f"length(norm) >= {D.SIGN_LEAST}"), _defs(_TAIL, D.EN_SIGN_TITLE, "'Title'", O.trim("g[1]"), "party-declaration", 1, f"length(norm) >= {D.SIGN_LEAST}"),
        _defs(_TAIL, r"(?:^|[^가-힣A-Za-z])(대표이사|대표|부사장|사장|이사|본부장|팀장)" + O.expand(r"\s+") + r"([가-힣]{2,4})(?:\z|[^가-힣])", "g[1]", "g[2]", "party-declaration", 2, f"length(norm) >= {D.SIGN_LEAST}"),
        _defs(_TAIL, O.expand(r"이름\s*:\s*([가-힣]{2,4})(?:\z|[^가-힣])"), "'이름'", "g[1]", "party-declaration", 1, f"length(norm) >= {D.SIGN_LEAST}"),
    )),
    "header_block": " UNION ALL ".join(
        f"SELECT doc_id, 'document-title' AS label, {O.trim('t')} AS referent, 'definition-section' AS source FROM (SELECT doc_id, regexp_extract(substr(norm, 1, {D.HEAD_TITLE}), {O.lit(p)}, 1) AS t FROM ({O.prepared(CONTRACTS)}) c) h WHERE t <> ''"
        for p in (O.expand(r"(?:^|[^A-Za-z])([A-Z][A-Z\s\-]{3,60}?(?:AGREEMENT|CONTRACT|MOU))(?:\z|[^A-Za-z])"), r"(?:^|[^가-힣])([가-힣][가-힣A-Za-z0-9]{1,30}?(?:계약서|합의서|각서|협정서))(?:\z|[^가-힣])")
    ),
}


def _parser_query(parser) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = D.analyze_text(contracts(spark, sf_dir), rules=(), heuristics=(), parsers=(parser,))
        return D.definitions(found, "doc_id").drop("ord")

    return run


for _id, _f in D.PARSERS:
    _short = _id.split(".")[1].replace("-", "_")
    query(f"structural_{_short}", _PARSER_SQL[_short])(_parser_query((_id, _f)))

_HEURISTIC = {h[0]: h for h in D.HEURISTICS}


def _heuristic(name: str, load: Query, rules=()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = D.analyze_text(load(spark, sf_dir), "paranoid", rules=rules, parsers=(), heuristics=(_HEURISTIC[f"heuristics.{name}"],))
        rows = D.candidates(found, "doc_id").filter(F.col("rule_id").startswith("heuristics."))
        return rows.groupBy("doc_id", "text", "confidence").agg(F.count("*").alias("n"))

    return run


_LATIN = f"SELECT * FROM ({O.prepared(DOCUMENTS)}) l WHERE lang IN ('en', 'mixed')"
_CLUSTER = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4}"
query("heuristic_capitalization_cluster", f"""SELECT doc_id, substr(text, place, length(hit)) AS text, 0.7::DOUBLE AS confidence, count(*) AS n FROM {O.scan(_LATIN, _CLUSTER, 'A-Za-z', 'A-Za-z')} s
WHERE len(list_filter(regexp_split_to_array(lower(hit), '[\\s]+'), lambda w: {O.in_list('w', L.ROLES_EN)})) = 0 GROUP BY ALL""")(_heuristic("capitalization-cluster", documents))
query("heuristic_quoted_term", f"""SELECT doc_id, q AS text, 0.6::DOUBLE AS confidence, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(norm, {O.lit(D.QUOTED)}, 1)) AS q FROM ({O.prepared(DOCUMENTS)}) p) u
WHERE NOT ({O.in_list('lower(q)', L.ROLES_EN)}) AND NOT ({O.in_list('q', L.ROLES_KO)}) GROUP BY ALL""")(_heuristic("quoted-term", documents))
query("heuristic_repeatability", f"""SELECT doc_id, hit AS text, 0.5::DOUBLE AS confidence, 1::BIGINT AS n FROM {O.scan(O.prepared(DOCUMENTS), r'[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}', 'A-Za-z', 'A-Za-z')} s
WHERE NOT ({O.in_list('lower(hit)', L.ROLES_EN)}) GROUP BY doc_id, hit HAVING count(*) >= {D.LEAST_REPEATS}""")(_heuristic("repeatability", documents))
query("heuristic_email_domain_inference", """SELECT 2 * c_custkey AS doc_id, 'Acme' || CASE WHEN c_custkey % 3 = 0 THEN '–' ELSE ' ' END || c_custkey AS text, CASE WHEN c_custkey % 3 = 0 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence, 1::BIGINT AS n FROM customer""")(_heuristic("email-domain-inference", contracts, rules=(BY_ID["identifiers.email"],)))


@query("suggest_keywords")
def suggest_keywords(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(D.suggest_keywords(F.col("text"))).alias("keyword"))


# -- folding and targets --------------------------------------------------------------------------

_FOLD_RULES = [BY_ID[f"identifiers.{x}"] for x in ("phone-intl", "email", "credit-card")] + [BY_ID[f"financial.{x}"] for x in ("won-formal", "usd-symbol", "usd-code", "percentage")] + [BY_ID["temporal.date-iso"]]


_SCOPE = ("doc_id", "scope_ord", "scope_kind", "scope_path")


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, which are the scopes of conversations, and contracts."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("scope_ord"), F.col("role").alias("scope_kind"), F.concat(F.lit("turn/"), F.col("turn").cast("string")).alias("scope_path"), "text")
    more = contracts(spark, sf_dir).select("doc_id", (F.lit(1000) + F.col("doc_id") % 2).alias("scope_ord"), F.col("lang").alias("scope_kind"), F.lit("contract").alias("scope_path"), "text")
    return dealt(rows, "doc_id", "scope_ord").unionByName(more)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of some rules, those that the SQL of the folds has."""
    found = D.analyze_text(scoped(spark, sf_dir), "paranoid", rules=_FOLD_RULES, parsers=(), heuristics=())
    # several folds read these; detection runs once
    return written(D.candidates(found, *_SCOPE), "fold-findings")


def whole_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings of all rules and heuristics, and definitions of all parsers, in the same rows."""
    found = written(D.analyze_text(scoped(spark, sf_dir), "paranoid").select(*_SCOPE, "language", "candidates", "definitions"), "whole-findings")
    return D.candidates(found, *_SCOPE), D.definitions(found, *_SCOPE)


_SCOPED = f"SELECT conv_id * 10000 + turn AS doc_id, text FROM conversations UNION ALL SELECT -1 - doc_id, text FROM ({CONTRACTS}) k"
_FINDINGS = f"""SELECT CASE WHEN doc_id < 0 THEN -1 - doc_id ELSE doc_id // 10000 END AS doc_id, CASE WHEN doc_id < 0 THEN 1000 + (-1 - doc_id) % 2 ELSE doc_id % 10000 END AS scope_ord, ord, text, rule_id FROM ({_found(_FOLD_RULES, _SCOPED)}) f"""
_KIND = "CASE rule_id " + " ".join(f"WHEN 'identifiers.{s}' THEN '{k}'" for s, k in L.KIND_OF.items()) + " END"


@query("fold_identifiers", f"SELECT doc_id, text, arg_min({_KIND}, scope_ord * 100000 + ord) AS kind, count(*) AS count, count(DISTINCT scope_ord)::BIGINT AS scopes FROM ({_FINDINGS}) f WHERE rule_id LIKE 'identifiers.%' GROUP BY doc_id, text")
def fold_identifiers(spark, sf_dir):
    return G.fold_identifiers(findings(spark, sf_dir)).select("doc_id", "text", "kind", "count", F.size("scopes").cast("long").alias("scopes"))


@query("fold_others", f"SELECT doc_id, text, arg_min(rule_id, scope_ord * 100000 + ord) AS rule_id, split_part(arg_min(rule_id, scope_ord * 100000 + ord), '.', 1) AS category, count(*) AS count FROM ({_FINDINGS}) f WHERE rule_id NOT LIKE 'identifiers.%' GROUP BY doc_id, text")
def fold_others(spark, sf_dir):
    return G.fold_others(findings(spark, sf_dir)).select("doc_id", "text", "rule_id", "category", "count")


_TARGETS = f"""SELECT doc_id, text, 'auto:' || lpad(lower(to_hex({_FNV.format(x='text')})), 8, '0') AS id, count(*)::BIGINT AS occurrences, CASE min(s) WHEN 2 THEN 'pii' WHEN 3 THEN 'financial' ELSE 'temporal' END AS review_section, true AS default_selected
FROM (SELECT doc_id, text, CASE WHEN rule_id LIKE 'identifiers.%' THEN 2 WHEN min(split_part(rule_id, '.', 1)) = 'financial' THEN 3 ELSE 4 END AS s, rule_id LIKE 'identifiers.%' AS pii FROM ({_FINDINGS}) f GROUP BY doc_id, text, rule_id LIKE 'identifiers.%') o GROUP BY doc_id, text"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    return G.selection_targets(G.occurrences(G.fold_identifiers(found), G.fold_others(found)))


@query("selection_targets", _TARGETS)
def selection_targets(spark, sf_dir):
    return targets(spark, sf_dir).select("doc_id", "text", "id", F.col("count").alias("occurrences"), "review_section", "default_selected")


@query("selection_panel", f"SELECT doc_id, review_section, count(*) AS targets, count(*) AS selected FROM ({_TARGETS}) t GROUP BY doc_id, review_section")
def selection_panel(spark, sf_dir):
    return G.panel(targets(spark, sf_dir)).select("doc_id", "review_section", "targets", "selected")


#: Words of which each two have the same 32-bit hash (fixed values).
_ALIKE = ("costarring", "liquid", "declinate", "macallums")
_COLLIDING = f"SELECT doc_id, id, text FROM ({_TARGETS}) t UNION ALL SELECT c_custkey, 'auto:' || lpad(lower(to_hex({_FNV.format(x='w')})), 8, '0'), w FROM (SELECT c_custkey, unnest([c_name, {', '.join(map(O.lit, _ALIKE))}]) AS w FROM customer WHERE c_custkey % 3 = 0) w"


def _colliding(spark: SparkSession, found: DataFrame, sf_dir: str) -> DataFrame:
    """Targets, and words with like hashes for every third customer."""
    words = F.explode(F.array("c_name", *map(F.lit, _ALIKE)))
    made = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("doc_id"), words.alias("text"))
    return found.select("doc_id", "id", "text").unionByName(made.select("doc_id", T.target_id("auto", "text").alias("id"), "text"))


@query("selection_collisions", f"SELECT doc_id, id, count(DISTINCT text) AS texts FROM ({_COLLIDING}) t GROUP BY doc_id, id HAVING count(DISTINCT text) > 1")
def selection_collisions(spark, sf_dir):
    return G.id_collisions(_colliding(spark, targets(spark, sf_dir), sf_dir))


@query("selection_resolved", f"SELECT doc_id, id, text AS display_text, [text] AS redaction_literals FROM ({_TARGETS}) t")
def selection_resolved(spark, sf_dir):
    return G.resolve_defaults(targets(spark, sf_dir)).select("doc_id", "id", "display_text", "redaction_literals")


@query("all_targets", f"SELECT doc_id, list(text ORDER BY length(text) DESC, o) AS targets FROM (SELECT doc_id, text, min(scope_ord * 100000 + ord) AS o FROM ({_FINDINGS}) f GROUP BY doc_id, text) t GROUP BY doc_id")
def all_targets(spark, sf_dir):
    none = spark.createDataFrame([], "doc_id long, scope_ord long, ord int, referent string, source string")
    return G.all_targets(findings(spark, sf_dir), none)


def whole_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, defined = whole_findings(spark, sf_dir)
    return G.selection_targets(G.occurrences(G.fold_identifiers(found), G.fold_others(found, defined)))


@query("all_targets_whole")
def all_targets_whole(spark, sf_dir):
    return G.all_targets(*whole_findings(spark, sf_dir))


@query("fold_identifiers_whole")
def fold_identifiers_whole(spark, sf_dir):
    return G.fold_identifiers(whole_findings(spark, sf_dir)[0]).select("doc_id", "text", "kind", "count", F.size("scopes").cast("long").alias("scopes"))


@query("fold_others_whole")
def fold_others_whole(spark, sf_dir):
    return G.fold_others(*whole_findings(spark, sf_dir)).select("doc_id", "text", "rule_id", "category", "count")


@query("selection_targets_whole")
def selection_targets_whole(spark, sf_dir):
    return whole_targets(spark, sf_dir).select("doc_id", "text", "id", F.col("count").alias("occurrences"), "review_section", "default_selected")


@query("selection_panel_whole")
def selection_panel_whole(spark, sf_dir):
    return G.panel(whole_targets(spark, sf_dir)).select("doc_id", "review_section", "targets", "selected")


@query("selection_collisions_whole")
def selection_collisions_whole(spark, sf_dir):
    return G.id_collisions(_colliding(spark, whole_targets(spark, sf_dir), sf_dir))


@query("selection_resolved_whole")
def selection_resolved_whole(spark, sf_dir):
    return G.resolve_defaults(whole_targets(spark, sf_dir)).select("doc_id", "id", "display_text", "redaction_literals")


@query("manual_targets")
def manual_targets(spark, sf_dir):
    found = whole_targets(spark, sf_dir)
    corpus = noisy(spark, sf_dir)
    return G.add_manual(found, corpus.select("doc_id", "text"), corpus.select("doc_id", F.lit("Main Street").alias("text")))


@query("level_coverage", f"""SELECT rule_id, count(*) AS paranoid, count(*) FILTER ({O.in_list('rule_id', [r.id for r in RULES if 'standard' in r.levels])}) AS standard, count(*) FILTER ({O.in_list('rule_id', [r.id for r in RULES if 'conservative' in r.levels])}) AS conservative
FROM ({_found(RULES, CONTRACTS)}) f GROUP BY rule_id""")
def level_coverage(spark, sf_dir):
    rows = D.candidates(D.analyze_text(contracts(spark, sf_dir), "paranoid", heuristics=(), parsers=()), "doc_id")
    at = lambda level: F.count_if(F.col("rule_id").isin(*[r.id for r in RULES if level in r.levels]))
    return rows.groupBy("rule_id").agg(F.count("*").alias("paranoid"), at("standard").alias("standard"), at("conservative").alias("conservative"))


# -- propagation ----------------------------------------------------------------------------------


def _clause_sql(pattern: str, source: str) -> str:
    lists = f"list_zip(regexp_extract_all(text, {O.lit(pattern)}, 1), regexp_extract_all(text, {O.lit(pattern)}, 2))"
    return f"SELECT doc_id, {O.trim('g[2]')} AS literal, {O.trim('g[1]')} AS defined, '{source}' AS source FROM (SELECT doc_id, unnest({lists}) AS g FROM ({CONTRACTS}) c) u"


@query("definition_clauses", " UNION ALL ".join(_clause_sql(p, s) for p, s in propagate.CLAUSES))
def definition_clauses(spark, sf_dir):
    rows = contracts(spark, sf_dir).select("doc_id", F.explode(propagate.definition_clauses(F.col("text"))).alias("c"))
    return rows.select("doc_id", "c.literal", "c.defined", "c.source")


#: The forms of a name that the English contracts have; every third of them has the whole name.
_FORMS = "SELECT 2 * c_custkey AS doc_id, unnest(CASE WHEN c_custkey % 3 = 0 THEN [['Acme Holdings Corp', '1'], ['Acme', '3'], ['Acme Corp', '1']] ELSE [['Acme', '3'], ['Acme Corp', '1']] END) AS f, generate_subscripts(CASE WHEN c_custkey % 3 = 0 THEN [1, 2, 3] ELSE [1, 2] END, 1) - 1 AS ord FROM customer"


@query("propagate_variants", f"SELECT doc_id, ord, f[1] AS text, 'literal' AS kind, f[2]::INT AS count FROM ({_FORMS}) f")
def propagate_variants(spark, sf_dir):
    text = F.col("text")
    groups = propagate.propagate(F.lit("Acme Holdings Corp"), text, propagate.definition_clauses(text))
    rows = contracts(spark, sf_dir).select("doc_id", F.posexplode(groups).alias("ord", "v"))
    return rows.select("doc_id", "ord", "v.text", "v.kind", "v.count")


@query("propagated_targets", f"SELECT c.doc_id, coalesce(list(f[1] ORDER BY length(f[1]) DESC) FILTER (f IS NOT NULL), []) AS targets FROM ({CONTRACTS}) c LEFT JOIN ({_FORMS}) f ON f.doc_id = c.doc_id GROUP BY c.doc_id")
def propagated_targets(spark, sf_dir):
    text = F.col("text")
    groups = propagate.propagate(F.lit("Acme Holdings Corp"), text, propagate.definition_clauses(text))
    return contracts(spark, sf_dir).select("doc_id", propagate.redaction_targets(groups, F.array(F.lit("Buyer"))).alias("targets"))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two names that share forms, and a value that the English contracts define."""
    k = F.floor(F.col("doc_id") / 2)
    seeds = F.array(F.lit("Acme Holdings Corp"), F.lit("Acme Corp"), F.concat((1 + k % 30).cast("string"), F.lit(" Days")))
    return contracts(spark, sf_dir).select("doc_id", F.posexplode(seeds).alias("seed_ord", "seed"))


def _collected(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = contracts(spark, sf_dir).select("doc_id", "text")
    return session.collect_candidates(session.variant_groups(rows, _seeds(spark, sf_dir)), kind).filter(~F.col("text").rlike("^[0-9]")).select("doc_id", "text", "seed", "count")


@query("collect_literal_candidates", f"SELECT doc_id, f[1] AS text, 'Acme Holdings Corp' AS seed, f[2]::INT AS count FROM ({_FORMS}) f")
def collect_literal_candidates(spark, sf_dir):
    return _collected(spark, sf_dir, "literal")


@query("collect_defined_candidates", "SELECT 2 * c_custkey AS doc_id, 'Term' AS text, (1 + c_custkey % 30) || ' Days' AS seed, 1 AS count FROM customer")
def collect_defined_candidates(spark, sf_dir):
    return _collected(spark, sf_dir, "defined")


# -- review sessions --------------------------------------------------------------------------------


def _scoped_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts in two scopes: the body, and a header that repeats the first line."""
    rows = contracts(spark, sf_dir)
    body = rows.select("doc_id", F.lit(0).alias("scope_ord"), F.lit("body").alias("scope_kind"), F.lit("word/document.xml").alias("scope_path"), "text")
    return body.unionByName(rows.select("doc_id", F.lit(1).alias("scope_ord"), F.lit("header").alias("scope_kind"), F.lit("word/header1.xml").alias("scope_path"), F.substring_index("text", "\n", 1).alias("text")))


_ADDED = (("other", " Main Street "), ("legal", "Gamma Works"), ("other", "Gamma Works"), ("unknown", "nothing"), ("other", "  "))


def _additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lawful texts for every contract, one of them in two categories, of which the last is not selected."""
    entries = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(t).alias("text"), F.lit((c, t) != ("other", "Gamma Works")).alias("default_selected")) for c, t in _ADDED))
    return contracts(spark, sf_dir).select("doc_id", F.explode(entries).alias("e")).select("doc_id", "e.*")


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[session.Analysis, DataFrame]:
    found = session.analyze(_scoped_contracts(spark, sf_dir), _seeds(spark, sf_dir))
    return session.merge_additions(found, G.default_selections(found.targets), _additions(spark, sf_dir))


def _state(found: session.Analysis, chosen: DataFrame, *texts: str) -> DataFrame:
    rows = found.targets.filter(F.col("text").isin(*texts)).join(chosen.withColumn("on", F.lit(True)), ["doc_id", "id"], "left")
    return rows.select("doc_id", "text", "namespace", F.array_join("source_kinds", "+").alias("source_kinds"), "review_section", F.coalesce("on", F.lit(False)).alias("selected"))


_EN = "doc_id % 2 = 0"


@query("session_additions", f"""SELECT doc_id, 'Main Street' AS text, 'manual' AS namespace, 'manual' AS source_kinds, 'other' AS review_section, true AS selected FROM ({CONTRACTS}) a
UNION ALL SELECT doc_id, 'Gamma Works', CASE WHEN {_EN} THEN 'auto' ELSE 'manual' END, CASE WHEN {_EN} THEN 'nonPii+manual' ELSE 'manual' END, CASE WHEN {_EN} THEN 'heuristics' ELSE 'legal' END, false FROM ({CONTRACTS}) b""")
def session_additions(spark, sf_dir):
    return _state(*_reviewed(spark, sf_dir), "Main Street", "Gamma Works")


@query("session_removals", f"SELECT doc_id, 'Gamma Works' AS text, 'auto' AS namespace, 'nonPii' AS source_kinds, 'heuristics' AS review_section, false AS selected FROM ({CONTRACTS}) a WHERE {_EN}")
def session_removals(spark, sf_dir):
    """Gamma Works is selected again by hand, then both additions are taken back."""
    found, chosen = _reviewed(spark, sf_dir)
    flipped = session.toggle(chosen, found.targets.filter("text = 'Gamma Works'").select("doc_id", "id"))
    gone = contracts(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit("Main Street"), F.lit("Gamma Works"))).alias("text"))
    return _state(*session.remove_additions(found, flipped, gone), "Main Street", "Gamma Works")


@query("session_policies", f"""SELECT doc_id, e[1] AS category, e[2] AS text, e[3] = 'y' AS default_selected FROM (SELECT doc_id, unnest([['other', 'Main Street', 'y'], ['legal', 'Gamma Works', 'n'], ['other', 'Gamma Works', 'n']]) AS e FROM ({CONTRACTS}) a) b""")
def session_policies(spark, sf_dir):
    """Additions as they are now, through a policy file and back."""
    found, chosen = _reviewed(spark, sf_dir)
    files = session.export_policies(found, chosen, _additions(spark, sf_dir), "2024-01-01T00:00:00Z")
    return session.import_policies(files)[0]


@query("session_targets", f"""SELECT doc_id, 'Acme' AS text, 'literal' AS source_kinds, 'literals' AS review_section, true AS selected FROM ({CONTRACTS}) a WHERE {_EN}
UNION ALL SELECT doc_id, 'Term', 'literal', 'defined', false FROM ({CONTRACTS}) b WHERE {_EN}""")
def session_targets(spark, sf_dir):
    """What the seeds add to the targets of a whole analysis."""
    found = session.analyze(_scoped_contracts(spark, sf_dir), _seeds(spark, sf_dir))
    return _state(found, G.default_selections(found.targets), "Acme", "Term", "Buyer").select("doc_id", "text", "source_kinds", "review_section", "selected")


@query("session_redaction")
def session_redaction(spark, sf_dir):
    """Packages read, analysed, redacted by the default selection and verified."""
    made = session.analyze_packages(packages(spark, sf_dir), _seeds(spark, sf_dir))
    report = session.apply_redaction(made, G.default_selections(made.analysis.targets))[1]
    return report.join(made.snapshot.stats, "doc_id").select("doc_id", "scope_count", "words_before", "words_after", "survived", "is_clean", "repaired", "outcome")


# -- redaction and verification ------------------------------------------------------------------------

_LITERALS = f"SELECT doc_id, list(DISTINCT text) AS literals, string_agg(DISTINCT regexp_escape(text), '|' ORDER BY length(regexp_escape(text)) DESC, regexp_escape(text)) AS pattern FROM ({_found(_UNIVERSAL, DOCUMENTS)}) f GROUP BY doc_id"
_REDACTED = f"SELECT d.doc_id, d.text AS text_before, coalesce(literals, []) AS literals, coalesce(regexp_replace(d.text, pattern, '[REDACTED]', 'g'), d.text) AS redacted FROM documents d LEFT JOIN ({_LITERALS}) l USING (doc_id)"


def redacted(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Documents with what the universal rules or the whole detection find, and without it; one narrow stage."""
    found = _detected(dealt(documents(spark, sf_dir), "doc_id"), whole)
    texts, referents = F.transform("candidates", lambda c: c["text"]), F.transform("definitions", lambda d: d["referent"])
    literals = F.filter(F.array_distinct(F.concat(texts, referents)), lambda t: t != "")
    return found.select("doc_id", "text", literals.alias("literals")).withColumn("redacted", R.redact_text(F.col("text"), F.col("literals")))


_PLACED = "((length({x}) - length(replace({x}, '[REDACTED]', ''))) / 10)::BIGINT"


@query("redact_documents", f"SELECT doc_id, sha256(redacted) AS redacted_sha256, {_PLACED.format(x='redacted')} AS placeholders, len(list_filter(literals, lambda t: contains(redacted, t)))::BIGINT AS survivors FROM ({_REDACTED}) r")
def redact_documents(spark, sf_dir, whole=False):
    left = F.size(F.filter("literals", lambda t: F.col("redacted").contains(t))).cast("long")
    placed = T.count_occurrences(F.col("redacted"), F.lit(R.PLACEHOLDER)).cast("long")
    return redacted(spark, sf_dir, whole).select("doc_id", F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"), placed.alias("placeholders"), left.alias("survivors"))


@query("redact_documents_whole")
def redact_documents_whole(spark, sf_dir):
    return redact_documents(spark, sf_dir, whole=True)


@query("word_count_sanity", f"""SELECT doc_id, before, after, CASE WHEN before = 0 OR after >= before THEN 0 ELSE floor((before - after) / before * 100 + 0.5)::INT END AS dropped, CASE WHEN before = 0 OR after >= before THEN true ELSE floor((before - after) / before * 100 + 0.5) <= 30 END AS sane
FROM (SELECT doc_id, len(regexp_extract_all(text_before, '[^\\s\\x0B\\x{{A0}}\\x{{3000}}]+'))::BIGINT AS before, len(regexp_extract_all(redacted, '[^\\s\\x0B\\x{{A0}}\\x{{3000}}]+'))::BIGINT AS after FROM ({_REDACTED}) r) w""")
def word_count_sanity(spark, sf_dir, whole=False):
    counts = redacted(spark, sf_dir, whole).select("doc_id", T.count_words("text").cast("long").alias("before"), T.count_words("redacted").cast("long").alias("after"))
    lost = V.dropped_percent(F.col("before"), F.col("after"))
    return counts.select("*", lost.alias("dropped"), V.sane(F.col("before"), F.col("after")).alias("sane"))


@query("word_count_sanity_whole")
def word_count_sanity_whole(spark, sf_dir):
    return word_count_sanity(spark, sf_dir, whole=True)


def _surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts as a body, their first line as a field, and a link as a relationship."""
    rows = contracts(spark, sf_dir)
    body = rows.select("doc_id", F.lit("text").alias("surface"), F.lit("body").alias("scope_kind"), F.lit("word/document.xml").alias("scope_path"), "text")
    field = rows.select("doc_id", F.lit("field").alias("surface"), F.lit("header").alias("scope_kind"), F.lit("word/header1.xml").alias("scope_path"), F.substring_index("text", "\n", 1).alias("text"))
    links = rows.filter("lang = 'en'").select("doc_id", F.lit("rels").alias("surface"), F.lit("rels").alias("scope_kind"), F.lit("word/_rels/document.xml.rels").alias("scope_path"), F.concat(F.lit("https://acme-"), F.col("doc_id").cast("string"), F.lit(".example/Buyer")).alias("text"))
    return body.unionByName(field).unionByName(links)


_SURFACES = f"""SELECT doc_id, 'text' AS surface, 'body' AS scope_kind, 'word/document.xml' AS scope_path, text FROM ({CONTRACTS}) a
UNION ALL SELECT doc_id, 'field', 'header', 'word/header1.xml', split_part(text, chr(10), 1) FROM ({CONTRACTS}) b
UNION ALL SELECT doc_id, 'rels', 'rels', 'word/_rels/document.xml.rels', 'https://acme-' || doc_id || '.example/Buyer' FROM ({CONTRACTS}) c WHERE lang = 'en'"""
_WANTED = ("Buyer", "SUPPLY AGREEMENT", "한빛상사")


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_strings(contracts(spark, sf_dir).select("doc_id", F.array(*map(F.lit, _WANTED)).alias("targets")))


_HITS = f"SELECT s.doc_id, w.t AS text, scope_kind, scope_path, surface, ((length(s.text) - length(replace(s.text, w.t, ''))) / length(w.t))::BIGINT AS n FROM ({_SURFACES}) s JOIN (SELECT unnest([{', '.join(map(O.lit, _WANTED))}]) AS t) w ON contains(s.text, w.t)"


@query("verify_survivors", f"SELECT doc_id, text, scope_path, surface, n AS count FROM ({_HITS}) h UNION ALL SELECT doc_id, text, scope_path, surface, 1 FROM ({_SURFACES}) s WHERE surface = 'rels'")
def verify_survivors(spark, sf_dir):
    return V.survivors(_surfaces(spark, sf_dir), _wanted(spark, sf_dir)).select("doc_id", "text", "scope_path", "surface", F.col("count").cast("long").alias("count"))


@query("verify_summary", f"""SELECT s.doc_id, (SELECT count(*) FROM ({_HITS}) h WHERE h.doc_id = s.doc_id) + count(*) FILTER (surface = 'rels') AS survived, count(DISTINCT scope_path) AS scopes_checked, {len(_WANTED)}::BIGINT AS strings_tested, false AS is_clean FROM ({_SURFACES}) s GROUP BY s.doc_id""")
def verify_summary(spark, sf_dir):
    return V.verify(_surfaces(spark, sf_dir), _wanted(spark, sf_dir)).select("doc_id", "survived", "scopes_checked", "strings_tested", "is_clean")


@query("preflight_summary", f"""SELECT doc_id, list_sort(list(DISTINCT scope_path)) AS touched_scope_paths, bool_or(scope_kind <> 'body') AS touched_non_body_scope, bool_or(surface = 'field') AS touched_field_surface, bool_or(surface = 'rels') AS touched_rels_surface, 0 AS expanded_literal_count FROM ({_HITS}) h GROUP BY doc_id""")
def preflight_summary(spark, sf_dir):
    return V.preflight(_surfaces(spark, sf_dir), _wanted(spark, sf_dir))[2]


@query("preflight_repairs", f"SELECT doc_id, scope_path AS path, list(DISTINCT text) AS literals FROM ({_HITS}) h WHERE surface = 'rels' GROUP BY doc_id, scope_path")
def preflight_repairs(spark, sf_dir):
    return V.preflight(_surfaces(spark, sf_dir), _wanted(spark, sf_dir))[1]


@query("repair_summary", f"""SELECT doc_id, list_sort(list(DISTINCT scope_path)) AS touched_scope_paths, bool_or(scope_kind <> 'body') AS touched_non_body_scope, bool_or(surface IN ('field', 'rels')) AS touched_field_or_rels_surface, count(*) AS initial_survivors FROM ({_HITS}) h GROUP BY doc_id""")
def repair_summary(spark, sf_dir):
    t = _wanted(spark, sf_dir)
    left = V.survivors(_surfaces(spark, sf_dir), t).filter(~F.col("target_id").startswith(V.EXTERNAL_URL))
    return V.repair_plan(t, left, check=False)[2]


@query("outcome", """SELECT c_custkey, CASE WHEN k % 5 = 0 THEN 'downloadRisk' WHEN k % 3 = 0 OR k % 7 = 0 THEN 'downloadWarning' WHEN k % 2 = 0 THEN 'downloadRepaired' ELSE 'downloadReady' END AS outcome,
CASE WHEN k % 5 = 0 THEN [] ELSE list_filter([CASE WHEN k % 3 = 0 THEN 'wordCount' END, CASE WHEN k % 7 = 0 THEN 'preflightTouchedNonBodyScopes' END], lambda x: x IS NOT NULL) END AS reasons,
k % 5 <> 0 OR k % 2 = 0 AS download, 'file.' || k || '.redacted.docx' AS name FROM (SELECT c_custkey, c_custkey AS k FROM customer) c""")
def outcome(spark, sf_dir):
    k = F.col("c_custkey")
    clean, sane, repaired = k % 5 != 0, k % 3 != 0, k % 2 == 0
    reasons = V.warning_reasons(clean, sane, k % 7 == 0, F.lit(False), repaired, F.lit(1), F.lit(False), F.lit(False))
    rows = table(spark, sf_dir, "customer").select("c_custkey", reasons.alias("reasons"))
    kind = F.when(clean, "strictClean").otherwise("risk")
    name = V.redacted_filename(F.concat(F.lit("file."), k.cast("string"), F.lit(".docx")))
    return rows.select("c_custkey", V.classify(clean, F.col("reasons"), sane, repaired).alias("outcome"), "reasons", V.can_download(kind, repaired).alias("download"), name.alias("name"))


@query("redact_xml_steps", r"""SELECT page_id, sha256(regexp_replace(regexp_replace(html, '(?s)<w:del\b[^>]*>.*?</w:del>', '', 'g'), '(?s)<w:ins\b[^>]*>(.*?)</w:ins>', '\1', 'g')) AS flat FROM (SELECT page_id, '<w:ins id="1">' || html || '</w:ins><w:del>' || url || '</w:del>' AS html FROM pages) p""")
def redact_xml_steps(spark, sf_dir):
    xml = F.concat(F.lit('<w:ins id="1">'), "html", F.lit("</w:ins><w:del>"), "url", F.lit("</w:del>"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(R.flatten_track_changes(xml).cast("binary"), 256).alias("flat"))


_MARKED = "'Acme Holdings|Acme|Buyer'"


@query("preview_segments", f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS ord, CASE WHEN p % 2 = 0 THEN 'text' ELSE 'mark' END AS type, s AS text,
CASE WHEN p % 2 = 1 THEN CASE s WHEN 'Acme Holdings' THEN 'auto:0' WHEN 'Acme' THEN 'auto:1' ELSE 'auto:3' END END AS id, CASE WHEN p % 2 = 1 THEN s = 'Acme Holdings' END AS selected
FROM (SELECT doc_id, 2 * unnest(range(len(l))) AS p, unnest(l) AS s FROM (SELECT doc_id, string_split_regex(text, {_MARKED}) AS l FROM ({CONTRACTS}) a) x
UNION ALL SELECT doc_id, 2 * unnest(range(len(l))) + 1, unnest(l) FROM (SELECT doc_id, regexp_extract_all(text, {_MARKED}) AS l FROM ({CONTRACTS}) b) y) z WHERE s <> ''""")
def preview_segments(spark, sf_dir):
    marks = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(f"auto:{k}").alias("id"), F.lit(k % 2 == 0).alias("selected")) for k, t in enumerate(("Acme Holdings", "Acme", "Holdings Corp", "Buyer"))))
    rows = contracts(spark, sf_dir).select("doc_id", F.posexplode(V.preview_segments(F.col("text"), marks)).alias("ord", "s"))
    return rows.select("doc_id", "ord", "s.*")


# -- policies, scopes, packages, streams -----------------------------------------------------------


@query("policy_entries", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Unsupported policy category.' ELSE '' END AS error, CASE WHEN c_custkey % 4 <> 0 THEN 2 ELSE 0 END AS entries, c_custkey % 4 <> 0 AND c_custkey % 2 = 1 AS first_selected FROM customer""")
def policy_entries(spark, sf_dir):
    k = F.col("c_custkey")
    entry = lambda t, c, s: F.struct(F.lit(t).alias("text"), c.alias("category"), s.alias("defaultSelected"))
    kind = F.when(k % 4 == 0, "unknown").otherwise("legal")
    made_ = F.struct(F.lit(1).alias("schemaVersion"), F.lit("2024-01-01T00:00:00Z").alias("createdAt"), F.lit(" policy ").alias("name"), F.array(entry(" a ", kind, k % 2 == 0), entry("b", F.lit("other"), F.lit(True)), entry("a", kind, k % 2 == 1)).alias("entries"))
    out = policy.read(table(spark, sf_dir, "customer").select("c_custkey", F.to_json(made_).alias("json")))
    return out.select("c_custkey", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.size("entries"), F.lit(0)).alias("entries"), F.coalesce(F.col("entries")[0]["defaultSelected"], F.lit(False)).alias("first_selected"))


@query("scopes_conversations", f"SELECT conv_id, turn, {O.language('text')} AS language, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS scope_ord FROM conversations")
def scopes_conversations(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", T.detect_language("text").alias("language"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("scope_ord"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small package for each contract: a body in split runs, a header, a comment, links, properties."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.sax.saxutils import escape

        for pdf in it:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                runs = lambda p: escape("\0".join(p[k : k + 7] for k in range(0, len(p), 7))).replace("\0", '</w:t></w:r><w:r><w:t xml:space="preserve">')
                paragraph = lambda p: f'<w:p><w:r><w:t xml:space="preserve">{runs(p)}</w:t></w:r></w:p>' if p else "<w:p></w:p>"
                body = "".join(map(paragraph, text.split("\n"))) + "<w:p/><w:ins w:id='1'><w:p><w:r><w:t>Buyer &amp; Co</w:t></w:r></w:p></w:ins><w:del w:id='2'><w:r><w:delText>old</w:delText></w:r></w:del>"
                parts = {
                    "[Content_Types].xml": '<Types><Override PartName="/docProps/custom.xml"/></Types>', "_rels/.rels": "<Relationships/>",
                    "word/_rels/document.xml.rels": f'<Relationships><Relationship Id="1" Target="https://acme-{doc_id}.example/"/><Relationship Id="2" Target="Buyer.xml"/></Relationships>',
                    "word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>", "word/header2.xml": paragraph("Buyer header"), "word/header1.xml": paragraph(text.split("\n")[0]),
                    "word/comments.xml": paragraph("Buyer comment"), "docProps/core.xml": "<cp:coreProperties><dc:creator>Jane Doe</dc:creator></cp:coreProperties>", "docProps/custom.xml": "<Properties/>",
                }
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    for path, content in parts.items():
                        z.writestr(path, content)
                out.append((doc_id, data.getvalue() if doc_id % 10 else b"no package"))
            yield pd.DataFrame(out, columns=["doc_id", "content"])

    return contracts(spark, sf_dir).select("doc_id", "text").mapInPandas(run, "doc_id long, content binary")


@query("docx_validate", f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'CorruptDocxError' END AS error FROM ({CONTRACTS}) c")
def docx_validate(spark, sf_dir):
    return docx.validate(docx.unzip(packages(spark, sf_dir), contents=("[Content_Types].xml",)))


@query("docx_text", f"""SELECT doc_id, p[1] AS scope_path, p[2]::INT AS scope_ord, sha256(p[3]) AS text_sha256 FROM (SELECT doc_id, unnest([['word/document.xml', '0', text || chr(10) || chr(10) || 'Buyer & Co'], ['word/comments.xml', '1', 'Buyer comment'], ['word/header1.xml', '2', split_part(text, chr(10), 1)], ['word/header2.xml', '3', 'Buyer header']]) AS p FROM ({CONTRACTS}) c WHERE doc_id % 10 <> 0) u""")
def docx_text(spark, sf_dir):
    texts = docx.scopes(docx.unzip(packages(spark, sf_dir)).filter("error is null"), texts=True)
    return texts.select("doc_id", "scope_path", "scope_ord", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("docx_guided_redaction")
def docx_guided_redaction(spark, sf_dir):
    entries = written(docx.unzip(packages(spark, sf_dir)).filter("error is null"), "entries")
    wanted = _wanted(spark, sf_dir).join(entries.select("doc_id").distinct(), "doc_id", "left_semi")
    return docx.guided_redaction(entries, wanted)[1]


@query("docx_sha256")
def docx_sha256(spark, sf_dir):
    entries = written(docx.unzip(packages(spark, sf_dir)).filter("error is null"), "entries")
    wanted = written(_wanted(spark, sf_dir).join(entries.select("doc_id").distinct(), "doc_id", "left_semi"), "targets")
    return docx.zip_packages(docx.redacted_entries(entries, wanted)).select("doc_id", "sha256")


@query("stream_detect", f"SELECT conv_id, turn, rule_id, text, count(*) AS n FROM (SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, rule_id, text FROM ({_found(_UNIVERSAL, TURNS)}) f) u GROUP BY ALL")
def stream_detect(spark, sf_dir, whole=False):
    schema = table(spark, sf_dir, "conversations").schema
    stream = S.stream_table(spark, f"{sf_dir}/conversations.parque[t]", schema).withColumn("text", F.expr(SAID))
    found = D.candidates(_detected(stream, whole), "conv_id", "turn")
    out = shared_path(spark, "stream-out")
    S.run_to(found, out, shared_path(spark, "stream-state"))
    return spark.read.schema(found.schema).parquet(out).groupBy("conv_id", "turn", "rule_id", "text").agg(F.count("*").alias("n"))


@query("stream_detect_whole")
def stream_detect_whole(spark, sf_dir):
    return stream_detect(spark, sf_dir, whole=True)
