"""A review session over many documents: analysis, selections, additions by hand, policies, redaction.

All state is tables keyed by ``doc_id``; an operation takes tables and returns new ones,
so a session can be kept, compared and taken up again.  ``seeds`` are rows (doc_id,
seed_ord, seed); ``additions`` are rows (doc_id, category, text, default_selected);
``selections`` are rows (doc_id, id).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.operators import detect, policy, propagate
from inkveil.operators import targets as G
from inkveil.rules.registry import STANDARD
from inkveil.sources import docx
from inkveil.sources.shared import written

KEYS = ("doc_id", "scope_ord", "scope_kind", "scope_path")
#: Lengths that a text added by hand may have (fixed values).
SHORTEST, LONGEST = 1, 200


@dataclasses.dataclass(frozen=True)
class Analysis:
    """literals, defined: doc_id, text, seed, count, id; identifiers, others: folds; targets; corpus: doc_id, text."""

    corpus: DataFrame
    literals: DataFrame
    defined: DataFrame
    identifiers: DataFrame
    others: DataFrame
    targets: DataFrame


@dataclasses.dataclass(frozen=True)
class Snapshot:
    """What is read of packages once: entries, stats (size_bytes, scope_count), texts, surfaces."""

    entries: DataFrame
    stats: DataFrame
    texts: DataFrame
    surfaces: DataFrame


@dataclasses.dataclass(frozen=True)
class Session:
    snapshot: Snapshot
    analysis: Analysis


def corpus_of(texts: DataFrame) -> DataFrame:
    """doc_id, text: the texts of a document's scopes in reading order, joined by newlines."""
    ordered = F.array_sort(F.collect_list(F.struct("scope_ord", "scope_path", F.coalesce("text", F.lit("")).alias("text"))))
    return texts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("text"))


def variant_groups(corpus: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc_id, seed_ord, seed, ord, text, kind, count: the forms of every seed of a document."""
    text = F.col("corpus")
    # clauses once a document, whatever its seeds
    known = corpus.withColumnRenamed("text", "corpus").withColumn("clauses", propagate.definition_clauses(text))
    groups = propagate.propagate(F.col("seed"), text, F.col("clauses"))
    rows = seeds.join(known, "doc_id").select("doc_id", "seed_ord", "seed", F.posexplode(groups).alias("ord", "e"))
    return rows.select("doc_id", "seed_ord", "seed", "ord", "e.*")


def collect_candidates(groups: DataFrame, kind: str) -> DataFrame:
    """doc_id, text, seed, count, id, first: the forms of a kind; the first seed that has a text keeps it."""
    place = F.struct("seed_ord", "ord")
    rows = groups.filter(F.col("kind") == kind).groupBy("doc_id", "text")
    out = rows.agg(F.min_by("seed", place).alias("seed"), F.min_by("count", place).alias("count"), F.min(place).alias("first"))
    return out.withColumn("id", T.target_id("auto", "text"))


def _named_occurrences(candidates: DataFrame, section: str, k: int) -> DataFrame:
    none = F.lit(None).cast("string")
    order = F.struct(F.lit(k).alias("k"), F.struct(F.lit(0).alias("phase"), F.col("first.seed_ord").cast("long").alias("scope_ord"), F.col("first.ord").alias("ord")).alias("first"))
    return candidates.select(
        "doc_id", "text", F.lit("literal").alias("source_kind"), none.alias("rule_id"), F.lit(None).cast("double").alias("confidence"), F.lit(section).alias("review_section"),
        F.lit(section == "literals").alias("default_selected"), none.alias("scope_kind"), none.alias("scope_path"), order.alias("o"),
    )


def analyze(texts: DataFrame, seeds: DataFrame | None = None, level: str = STANDARD) -> Analysis:
    """The whole analysis of scopes (doc_id, scope_ord, scope_kind, scope_path, text)."""
    texts = texts.withColumn("scope_ord", F.col("scope_ord").cast("long"))
    found = written(detect.analyze_text(texts, level).select(*KEYS, "language", "candidates", "definitions"), "findings")
    rows, definitions = detect.candidates(found, *KEYS), detect.definitions(found, *KEYS)
    identifiers, others = G.fold_identifiers(rows), G.fold_others(rows, definitions)
    corpus = corpus_of(texts)
    if seeds is None:
        kind = texts.schema["doc_id"].dataType.simpleString()
        seeds = texts.sparkSession.createDataFrame([], f"doc_id {kind}, seed_ord int, seed string")
    groups = written(variant_groups(corpus, seeds), "variants")
    literals, defined = collect_candidates(groups, "literal"), collect_candidates(groups, "defined")
    others = others.join(defined.select("doc_id", "text"), ["doc_id", "text"], "left_anti").filter(~T.is_role_like(F.col("text")))
    occurrences = _named_occurrences(literals, "literals", -2).unionByName(_named_occurrences(defined, "defined", -1)).unionByName(G.occurrences(identifiers, others))
    return Analysis(corpus, literals, defined, identifiers, others, written(G.selection_targets(occurrences), "targets"))


def snapshot(packages: DataFrame) -> Snapshot:
    """Reads packages (doc_id, content) once; those that are no valid package have no rows."""
    entries = written(docx.unzip(packages), "entries")
    valid = docx.validate(entries).filter("error is null").select("doc_id")
    entries = written(entries.join(valid, "doc_id", "left_semi"), "valid-entries")
    parts = docx.scopes(entries)
    texts = written(docx.scope_texts(parts).select(*KEYS, "text"), "scope-texts")
    sizes = packages.select("doc_id", F.octet_length("content").cast("long").alias("size_bytes"))
    counts = texts.groupBy("doc_id").agg(F.count("*").alias("scope_count"))
    return Snapshot(entries, sizes.join(counts, "doc_id"), texts, written(docx.surfaces(entries), "surfaces"))


def attach(base: Snapshot, analysis: Analysis) -> Session:
    return Session(base, analysis)


def replace(session: Session, analysis: Analysis) -> Session:
    """The same snapshot, which is not read again, with another analysis."""
    return dataclasses.replace(session, analysis=analysis)


def analyze_packages(packages: DataFrame, seeds: DataFrame | None = None, level: str = STANDARD) -> Session:
    base = snapshot(packages)
    return attach(base, analyze(base.texts, seeds, level))


# -- selections and additions by hand ------------------------------------------------------------


def toggle(selections: DataFrame, flipped: DataFrame) -> DataFrame:
    """Selections (doc_id, id) with those of ``flipped`` turned over."""
    flips = flipped.groupBy("doc_id", "id").agg((F.count("*") % 2 == 1).alias("odd")).filter("odd").select("doc_id", "id")
    return selections.select("doc_id", "id").join(flips, ["doc_id", "id"], "left_anti").unionByName(flips.join(selections, ["doc_id", "id"], "left_anti"))


def clean_additions(additions: DataFrame) -> DataFrame:
    """Additions with trimmed texts of a lawful length and a known category, each once."""
    text = T.trim(F.col("text"))
    rows = additions.select("doc_id", "category", text.alias("text"), F.coalesce("default_selected", F.lit(True)).alias("default_selected"))
    rows = rows.filter(F.length("text").between(SHORTEST, LONGEST) & F.col("category").isin(*policy.CATEGORIES))
    return rows.groupBy("doc_id", "category", "text").agg(F.bool_and("default_selected").alias("default_selected"))


def merge_additions(analysis: Analysis, selections: DataFrame, additions: DataFrame) -> tuple[Analysis, DataFrame]:
    """(analysis, selections) after additions by hand.

    A text that an automatic target has joins it, which then counts as added by hand too;
    any other becomes a target of its own, with all original forms of the text in the
    corpus, in the section of its first category.  The last category decides whether it
    is selected.
    """
    rank = F.array_position(F.array(*map(F.lit, policy.CATEGORIES)), F.col("category"))
    wanted = clean_additions(additions).groupBy("doc_id", "text").agg(F.min_by("category", rank).alias("category"), F.max_by("default_selected", rank).alias("on"))
    targets = analysis.targets
    auto = targets.filter("namespace = 'auto'").select("doc_id", "text", "id")
    named = written(wanted.join(auto, ["doc_id", "text"], "left").withColumn("fresh", F.col("id").isNull()), "additions")
    ids = named.select("doc_id", F.when(F.col("fresh"), T.target_id("manual", "text")).otherwise(F.col("id")).alias("id"), "on")
    joined = targets.join(named.filter("not fresh").select("doc_id", "id", F.lit(True).alias("hit")), ["doc_id", "id"], "left")
    kinds = F.when(F.col("hit"), F.array_distinct(F.array_append("source_kinds", F.lit("manual")))).otherwise(F.col("source_kinds"))
    joined = joined.withColumn("source_kinds", kinds).drop("hit").select(*targets.columns)
    forms = named.filter("fresh").join(analysis.corpus.withColumnRenamed("text", "corpus"), "doc_id", "left")
    literals = G.longest_first(F.concat(F.array("text"), F.coalesce(G.original_variants(F.col("corpus"), F.col("text")), F.array().cast("array<string>"))))
    made = forms.select(
        "doc_id", F.lit("manual").alias("namespace"), "text", F.lit(1).cast("long").alias("count"), F.array(F.lit("manual")).alias("source_kinds"), F.col("category").alias("review_section"),
        F.lit(True).alias("default_selected"), T.target_id("manual", "text").alias("id"), T.normalize("text").alias("normalized_text"), literals.alias("literals"),
    )
    known = targets.filter("namespace = 'manual'").select("doc_id", "id")
    merged = joined.unionByName(made.join(known, ["doc_id", "id"], "left_anti"), allowMissingColumns=True)
    chosen = selections.select("doc_id", "id").join(ids, ["doc_id", "id"], "left_anti").unionByName(ids.filter("on").select("doc_id", "id")).distinct()
    return dataclasses.replace(analysis, targets=merged), chosen


def remove_additions(analysis: Analysis, selections: DataFrame, removed: DataFrame) -> tuple[Analysis, DataFrame]:
    """(analysis, selections) without additions (doc_id, text).

    An automatic target loses the mark of the hand, and stays selected only if it is so by
    default; a target made by hand goes.
    """
    gone = removed.select("doc_id", "text", F.lit(True).alias("gone")).distinct()
    marked = analysis.targets.join(gone, ["doc_id", "text"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    by_hand = F.col("gone") & F.array_contains("source_kinds", "manual")
    marked = marked.withColumn("by_hand", by_hand)
    kept = marked.filter("not (by_hand and namespace = 'manual')")
    kinds = F.when(F.col("by_hand"), F.array_remove("source_kinds", "manual")).otherwise(F.col("source_kinds"))
    out = kept.withColumn("source_kinds", kinds).select(*analysis.targets.columns)
    dropped = marked.filter("by_hand and (namespace = 'manual' or not default_selected)").select("doc_id", "id")
    return dataclasses.replace(analysis, targets=out), selections.select("doc_id", "id").join(dropped, ["doc_id", "id"], "left_anti")


def export_policies(analysis: Analysis, selections: DataFrame, additions: DataFrame, created_at: str, name: str = "Document redaction policy") -> DataFrame:
    """doc_id, json: each document's additions as a policy; what is a target is selected as it is now."""
    rows = clean_additions(additions)
    state = analysis.targets.select("doc_id", "text", "namespace", "id").join(selections.withColumn("on", F.lit(True)), ["doc_id", "id"], "left")
    state = state.groupBy("doc_id", "text").agg(F.min_by(F.coalesce("on", F.lit(False)), "namespace").alias("now"))  # 'auto' before 'manual'
    rank = F.array_position(F.array(*map(F.lit, policy.CATEGORIES)), F.col("category"))
    rows = rows.join(state, ["doc_id", "text"], "left").withColumn("r", rank)
    entry = F.struct(F.col("text"), F.col("category"), F.coalesce("now", "default_selected").alias("defaultSelected"))
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("r", F.col("text").alias("t"), entry.alias("e")))).alias("l"))
    made = F.struct(F.lit(policy.SCHEMA_VERSION).alias("schemaVersion"), F.lit(created_at).alias("createdAt"), F.lit(name).alias("name"), F.transform("l", lambda x: x["e"]).alias("entries"))
    return listed.select("doc_id", F.to_json(made, {"pretty": "true"}).alias("json"))


def import_policies(policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(additions, errors) of policies (doc_id, json): a policy with a fault adds nothing."""
    read = policy.read(policies)
    rows = read.filter("error is null").select("doc_id", F.explode("entries").alias("e"))
    return rows.select("doc_id", "e.category", "e.text", F.col("e.defaultSelected").alias("default_selected")), read.filter("error is not null").select("doc_id", "error")


def apply_redaction(session: Session, selections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, report) of the redaction of what is selected, always from the original entries."""
    return docx.guided_redaction(session.snapshot.entries, G.resolve(session.analysis.targets, selections))
