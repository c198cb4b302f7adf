"""Folding of findings to selection targets, and their selection.

Inputs carry ``doc_id``, ``scope_ord``, ``scope_kind`` and ``scope_path``; every
group is one document's, so a document is the unit of skew and partial aggregation
meets it before the shuffle.  First-wins fields are taken by ``min_by`` over an
explicit order, never by row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.functions import lexicon as L
from inkveil.functions import text as T
from inkveil.operators.detect import literal_places

#: Review sections by priority (fixed values).
SECTIONS = ("literals", "defined", "pii", "financial", "temporal", "entities", "legal", "heuristics", "other")
SECTION_OF = {"financial": "financial", "temporal": "temporal", "entities": "entities", "structural": "entities", "legal": "legal", "heuristics": "heuristics"}
#: Labels of identifier kinds (fixed values).
KIND_LABELS = {
    "rrn": "resident registration number · KR", "brn": "business registration number · KR", "ein": "US EIN", "phone-kr": "phone · KR",
    "phone-kr-landline": "phone · KR landline", "phone-intl": "phone · intl", "email": "email", "account-kr": "bank account · KR", "card": "credit card",
}


def mapped(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def kind_of(rule_id: Column) -> Column:
    return mapped(F.substring_index(rule_id, ".", -1), L.KIND_OF)


def kind_label(kind: Column) -> Column:
    return mapped(kind, KIND_LABELS)


def review_section(category: Column) -> Column:
    return mapped(category, SECTION_OF)


def priority(section: Column) -> Column:
    return mapped(section, {s: str(k) for k, s in enumerate(SECTIONS)}).cast("int")


def _order(phase: int = 0) -> Column:
    return F.struct(F.lit(phase).alias("phase"), "scope_ord", "ord")


def _scopes() -> Column:
    firsts = F.array_sort(F.collect_set(F.struct("scope_ord", "scope_kind", "scope_path")))
    return F.transform(firsts, lambda s: F.struct(s["scope_kind"].alias("kind"), s["scope_path"].alias("path")))


def fold_identifiers(findings: DataFrame) -> DataFrame:
    """doc_id, text, kind of the first finding, count over all rules' findings, scopes, first."""
    rows = findings.filter(F.col("rule_id").startswith("identifiers.")).withColumn("o", _order())
    return rows.groupBy("doc_id", "text").agg(kind_of(F.min_by("rule_id", "o")).alias("kind"), F.count("*").alias("count"), _scopes().alias("scopes"), F.min("o").alias("first"))


def fold_others(findings: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """The same for other findings; referents of definitions come after all findings."""
    rows = findings.filter(~F.col("rule_id").startswith("identifiers."))
    rows = rows.select("doc_id", "scope_ord", "scope_kind", "scope_path", "text", "rule_id", "confidence", _order(0).alias("o"))
    if definitions is not None:
        named = definitions.filter(F.col("referent") != "")
        rows = rows.unionByName(named.select("doc_id", "scope_ord", "scope_kind", "scope_path", F.col("referent").alias("text"), F.concat(F.lit("structural."), "source").alias("rule_id"), F.lit(1.0).alias("confidence"), _order(1).alias("o")))
    out = rows.groupBy("doc_id", "text").agg(F.min_by("rule_id", "o").alias("rule_id"), F.min_by("confidence", "o").alias("confidence"), F.count("*").alias("count"), _scopes().alias("scopes"), F.min("o").alias("first"))
    return out.withColumn("category", F.substring_index("rule_id", ".", 1))


def longest_first(literals: Column) -> Column:
    """Distinct non-empty literals, longest first, then in dictionary order."""
    compare = lambda a, b: (
        F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1)
        .when(F.collate(a, "UNICODE") < F.collate(b, "UNICODE"), -1).when(F.collate(a, "UNICODE") > F.collate(b, "UNICODE"), 1).otherwise(0)
    )
    return F.array_sort(F.array_distinct(F.filter(literals, lambda x: x != "")), compare)


def all_targets(findings: DataFrame, definitions: DataFrame) -> DataFrame:
    """doc_id, targets: distinct texts and referents, longest first, else in order of appearance."""
    rows = findings.select("doc_id", "text", _order(0).alias("o"))
    rows = rows.unionByName(definitions.filter(F.col("referent") != "").select("doc_id", F.col("referent").alias("text"), _order(1).alias("o")))
    firsts = rows.groupBy("doc_id", "text").agg(F.min("o").alias("o"))
    entry = F.struct((-F.length("text")).alias("n"), F.col("o"), F.col("text"))
    return firsts.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("t")).select("doc_id", F.col("t.text").alias("targets"))


def occurrences(identifiers: DataFrame, others: DataFrame, defined_terms: list[str] | None = None) -> DataFrame:
    """Occurrences that selection targets are built of; role words and defined terms are left out."""
    scope = lambda f: F.when(F.size("scopes") > 0, F.col("scopes")[0][f])
    shape = ["doc_id", "text", "source_kind", "rule_id", "confidence", "review_section", "default_selected", "scope_kind", "scope_path", "o"]
    pii = identifiers.select(
        "doc_id", "text", F.lit("pii").alias("source_kind"), F.concat(F.lit("identifiers."), "kind").alias("rule_id"), F.lit(None).cast("double").alias("confidence"),
        F.lit("pii").alias("review_section"), F.lit(True).alias("default_selected"), scope("kind").alias("scope_kind"), scope("path").alias("scope_path"), F.struct(F.lit(0).alias("k"), "first").alias("o"),
    )
    rest = others.filter(~T.is_role_like(F.col("text")))
    if defined_terms:
        rest = rest.filter(~F.col("text").isin(*defined_terms))
    rest = rest.select(
        "doc_id", "text", F.lit("nonPii").alias("source_kind"), "rule_id", "confidence", review_section(F.col("category")).alias("review_section"),
        ((F.col("category") != "legal") & (F.col("confidence") == 1.0)).alias("default_selected"), scope("kind").alias("scope_kind"), scope("path").alias("scope_path"), F.struct(F.lit(1).alias("k"), "first").alias("o"),
    )
    return pii.select(*shape).unionByName(rest.select(*shape))


def selection_targets(rows: DataFrame) -> DataFrame:
    """One row a target: id, text, kinds, scopes, section of highest priority, default, count."""
    named = rows.withColumn("namespace", F.when(F.col("source_kind") == "manual", "manual").otherwise("auto"))
    distinct = lambda x: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("o", x.alias("v")))), lambda s: s["v"]))
    out = named.groupBy("doc_id", "namespace", "text").agg(
        F.count("*").alias("count"), distinct(F.col("source_kind")).alias("source_kinds"),
        F.array_compact(distinct(F.when(F.col("scope_path").isNotNull(), F.struct(F.col("scope_kind").alias("kind"), F.col("scope_path").alias("path"))))).alias("scopes"),
        F.min_by("review_section", priority(F.col("review_section"))).alias("review_section"), F.bool_or("default_selected").alias("default_selected"),
        F.min("confidence").alias("confidence"), F.min("o").alias("o"),
    )
    out = out.withColumn("id", T.target_id(F.col("namespace"), "text")).withColumn("normalized_text", T.normalize("text"))
    return out.withColumn("literals", F.filter(F.array("text"), lambda t: t != ""))


def id_collisions(targets: DataFrame) -> DataFrame:
    """Ids that stand for more than one text of a document; to be empty."""
    return targets.groupBy("doc_id", "id").agg(F.count_distinct("text").alias("texts")).filter("texts > 1")


def assert_no_collisions(targets: DataFrame) -> None:
    found = id_collisions(targets).take(1)
    if found:
        raise ValueError(f"selection target id collision: {found[0]['id']}")


def default_selections(targets: DataFrame) -> DataFrame:
    return targets.filter("default_selected").select("doc_id", "id", "o")


def unknown_selections(targets: DataFrame, selections: DataFrame) -> DataFrame:
    return selections.join(targets, ["doc_id", "id"], "left_anti")


def resolve(targets: DataFrame, selections: DataFrame, check: bool = True) -> DataFrame:
    """doc_id, id, display_text, redaction and verification literals, scopes."""
    if check:
        unknown = unknown_selections(targets, selections).take(1)
        if unknown:
            raise ValueError(f"unknown selection target id: {unknown[0]['id']}")
    return _resolved(targets.join(selections.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi"))


def _resolved(chosen: DataFrame) -> DataFrame:
    literals = longest_first(F.col("literals"))
    return chosen.select("doc_id", "id", F.col("text").alias("display_text"), literals.alias("redaction_literals"), literals.alias("verification_literals"), "scopes")


def resolve_defaults(targets: DataFrame) -> DataFrame:
    """``resolve`` with ``default_selections``: an id is chosen where any target that has it is; targets are worked out once."""
    on = F.bool_or("default_selected").over(Window.partitionBy("doc_id", "id"))
    return _resolved(targets.withColumn("on", on).filter("on"))


def resolve_strings(texts: DataFrame) -> DataFrame:
    """doc_id, targets (array) to resolved targets without scopes."""
    rows = texts.select("doc_id", F.explode(longest_first(F.col("targets"))).alias("t"))
    one = F.array("t")
    return rows.select("doc_id", T.target_id("auto", "t").alias("id"), F.col("t").alias("display_text"), one.alias("redaction_literals"), one.alias("verification_literals"), F.array().cast("array<struct<kind:string,path:string>>").alias("scopes"))


def original_variants(text: Column, needle: Column) -> Column:
    """Distinct original forms of a text whose normal form is the needle's; overlaps count."""

    def forms(v: Column) -> Column:
        # normalised once, and places are worked out only where normalisation changed the text
        recovered = lambda offsets: F.transform(literal_places(v["norm"], v["n"]), lambda k: T.original_slice(text, offsets, k, k + F.length(v["n"])))
        found = F.when(v["norm"] == text, F.array(v["n"])).otherwise(F.array_distinct(T.let(T.original_offsets(text), recovered)))
        return F.when(v["norm"].contains(v["n"]) & (v["n"] != ""), found).otherwise(F.array().cast("array<string>"))

    return T.let(F.struct(T.normalize(text).alias("norm"), T.normalize(needle).alias("n")), forms)


def add_manual(targets: DataFrame, corpus: DataFrame, additions: DataFrame) -> DataFrame:
    """Adds texts by hand (doc_id, text): merged into the automatic target of the text, else new.

    ``corpus`` has (doc_id, text); literals are all original forms found in it.
    """
    wanted = additions.select("doc_id", T.trim(F.col("text")).alias("text")).filter(F.length("text").between(1, 200)).distinct()
    forms = wanted.join(corpus.select("doc_id", F.col("text").alias("corpus")), "doc_id", "left")
    forms = forms.groupBy("doc_id", "text").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce(original_variants(F.col("corpus"), F.col("text")), F.array().cast("array<string>"))))).alias("forms"))
    forms = forms.withColumn("forms", longest_first(F.concat(F.array("text"), "forms")))
    # one full join, so that targets are worked out once
    joined = targets.withColumn("known", F.lit(True)).join(forms, ["doc_id", "text"], "full")
    added, known = F.col("forms").isNotNull(), F.col("known").isNotNull()
    fresh = {
        "namespace": F.lit("manual"), "source_kinds": F.array(F.lit("manual")), "review_section": F.lit("other"), "default_selected": F.lit(True), "id": T.target_id("manual", "text"),
        "normalized_text": T.normalize("text"), "literals": F.col("forms"), "count": F.lit(1).cast("long"),
    }
    merged = {"literals": F.when(added, longest_first(F.concat("literals", "forms"))).otherwise(F.col("literals")), "default_selected": F.col("default_selected") | added}
    columns = ["doc_id", "text", *(c for c in targets.columns if c not in ("doc_id", "text"))]
    return joined.select(*(F.when(known, merged.get(c, F.col(c))).otherwise(fresh[c]).alias(c) if c in fresh else F.col(c) for c in columns))


def panel(targets: DataFrame) -> DataFrame:
    """Sections of a review panel: number of targets, of selected ones, least confidence."""
    rows = targets.groupBy("doc_id", "review_section").agg(F.count("*").alias("targets"), F.count_if("default_selected").alias("selected"), F.min("confidence").alias("least_confidence"))
    return rows.withColumn("priority", priority(F.col("review_section")))
