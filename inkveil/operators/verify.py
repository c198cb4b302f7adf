"""Verification of redacted surfaces, preflight, repair plans and outcomes.

Surfaces are one long table: doc_id, surface (text, field, rels), scope_kind,
scope_path, text.  Literals of a document come as an array on the document's row, so
surfaces meet them by an equi-join on doc_id and no pair table is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.operators.detect import literal_places as _places
from inkveil.operators.targets import longest_first

EXTERNAL_URL = "security:external-url"
DROP_THRESHOLD = 30
SURVIVOR = "doc_id target_id text matched_literal scope_kind scope_path surface count".split()


def literal_entries(targets: DataFrame) -> DataFrame:
    """doc_id, literal, the targets that have it."""
    rows = targets.select("doc_id", "id", "display_text", F.explode(F.array_distinct(F.filter("verification_literals", lambda x: x != ""))).alias("literal"))
    return rows.groupBy("doc_id", "literal").agg(F.collect_set(F.struct("id", "display_text")).alias("targets"))


def _by_document(targets: DataFrame) -> DataFrame:
    """doc_id, entries: array<struct<id, text, literal, ord>> of all targets' literals."""
    rows = targets.select("doc_id", "id", "display_text", F.posexplode(F.array_distinct(F.filter("verification_literals", lambda x: x != ""))).alias("ord", "literal"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "ord", F.col("display_text").alias("text"), "literal"))).alias("entries"))


def survivors(surfaces: DataFrame, targets: DataFrame) -> DataFrame:
    """Literals that are still there, one row a (target, scope, surface).

    ``matched_literal`` is the first that differs from the displayed text.  External
    web addresses in relationship targets always survive.
    """
    joined = surfaces.join(_by_document(targets), "doc_id")
    hits = F.filter(F.transform("entries", lambda e: F.struct(e["id"].alias("id"), e["ord"].alias("ord"), e["text"].alias("text"), e["literal"].alias("literal"), T.count_occurrences(F.col("text"), e["literal"]).alias("n"))), lambda h: h["n"] > 0)
    rows = joined.withColumn("h", F.explode(F.filter(hits, lambda h: h["n"] > 0))).select("doc_id", F.col("h.id").alias("target_id"), F.col("h.text").alias("text"), F.col("h.literal").alias("literal"), F.col("h.ord").alias("ord"), F.col("h.n").alias("n"), "scope_kind", "scope_path", "surface")
    urls = surfaces.filter((F.col("surface") == "rels") & F.col("text").rlike("^https?://"))
    urls = urls.select("doc_id", F.concat(F.lit(EXTERNAL_URL + ":"), "text").alias("target_id"), "text", F.col("text").alias("literal"), F.lit(0).alias("ord"), F.lit(1).alias("n"), "scope_kind", "scope_path", "surface")
    other = F.when(F.col("literal") != F.col("text"), F.col("literal"))
    out = rows.unionByName(urls).groupBy("doc_id", "target_id", "scope_path", "surface")
    out = out.agg(F.first("text").alias("text"), F.min_by(other, F.when(other.isNotNull(), F.col("ord"))).alias("matched_literal"), F.first("scope_kind").alias("scope_kind"), F.sum("n").alias("count"))
    return out.select(*SURVIVOR)


def verify(surfaces: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, is_clean, survived, scopes_checked (scopes and relationship parts), strings_tested (literals)."""
    left = survivors(surfaces, targets).groupBy("doc_id").agg(F.count("*").alias("survived"))
    checked = surfaces.groupBy("doc_id").agg(F.count_distinct("scope_path").alias("scopes_checked"))
    tested = literal_entries(targets).groupBy("doc_id").agg(F.count("*").alias("strings_tested"))
    out = checked.join(left, "doc_id", "left").join(tested, "doc_id", "left").fillna(0, ["survived", "strings_tested"])
    return out.withColumn("is_clean", F.col("survived") == 0)


# -- word counts ---------------------------------------------------------------------------


def word_counts(scopes: DataFrame, name: str = "words") -> DataFrame:
    return scopes.groupBy("doc_id").agg(F.sum(T.count_words(F.coalesce("text", F.lit("")))).alias(name))


def dropped_percent(before: Column, after: Column) -> Column:
    """Per cent of words lost, half rounded up, not under 0."""
    share = F.floor((before - after) / F.nullif(before, F.lit(0)) * 100 + 0.5)
    return F.when((before == 0) | (after >= before), 0).otherwise(share).cast("int")


def sane(before: Column, after: Column, threshold: int = DROP_THRESHOLD) -> Column:
    return dropped_percent(before, after) <= threshold


# -- preflight and repair --------------------------------------------------------------------


def preflight(surfaces: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets with added literals and scopes, relationship repairs, a summary a document).

    A literal found on a surface joins its target's literals; the surface's scope joins
    the target's scopes, but for relationship parts, which get repairs.
    """
    joined = surfaces.join(_by_document(targets), "doc_id")
    hit = joined.withColumn("e", F.explode(F.filter("entries", lambda e: F.col("text").contains(e["literal"]))))
    hit = hit.select("doc_id", F.col("e.id").alias("id"), F.col("e.literal").alias("literal"), "scope_kind", "scope_path", "surface")
    scope = F.struct(F.col("scope_kind").alias("kind"), F.col("scope_path").alias("path"))
    extra = hit.groupBy("doc_id", "id").agg(F.collect_set("literal").alias("more"), F.collect_set(F.when(F.col("surface") != "rels", scope)).alias("places"))
    grown = targets.join(extra, ["doc_id", "id"], "left")
    literals = longest_first(F.concat("redaction_literals", F.coalesce("more", F.array().cast("array<string>"))))
    places = F.array_sort(F.coalesce("places", F.array().cast("array<struct<kind:string,path:string>>")))
    fresh = F.filter(places, lambda p: ~F.exists("scopes", lambda s: s["path"] == p["path"]))
    grown = grown.withColumn("merged", literals).withColumn("gained", F.greatest(F.lit(0), F.size("merged") - F.size("redaction_literals")))
    out = grown.select("doc_id", "id", "display_text", F.col("merged").alias("redaction_literals"), F.col("merged").alias("verification_literals"), F.concat("scopes", fresh).alias("scopes"), "gained")
    repairs = hit.filter("surface = 'rels'").groupBy("doc_id", F.col("scope_path").alias("path")).agg(longest_first(F.collect_set("literal")).alias("literals"))
    summary = hit.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("scope_path")).alias("touched_scope_paths"), F.bool_or((F.col("scope_kind") != "body") | (F.col("surface") == "rels")).alias("touched_non_body_scope"),
        F.bool_or(F.col("surface") == "field").alias("touched_field_surface"), F.bool_or(F.col("surface") == "rels").alias("touched_rels_surface"),
    )
    gained = out.groupBy("doc_id").agg(F.sum("gained").cast("int").alias("expanded_literal_count"))
    # a row for each document on both sides, dealt out alike: nothing to hand out through the driver
    summary = gained.join(summary.hint("merge"), "doc_id", "left")
    idle = {"touched_scope_paths": F.array().cast("array<string>"), "touched_non_body_scope": F.lit(False), "touched_field_surface": F.lit(False), "touched_rels_surface": F.lit(False)}
    summary = summary.select("doc_id", *(F.coalesce(c, d).alias(c) for c, d in idle.items()), "expanded_literal_count")
    return out.drop("gained"), repairs, summary


def unknown_survivors(targets: DataFrame, survived: DataFrame) -> DataFrame:
    return survived.join(targets.select("doc_id", F.col("id").alias("target_id")), ["doc_id", "target_id"], "left_anti")


def repair_plan(targets: DataFrame, survived: DataFrame, check: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, relationship repairs, a summary a document) for a second pass.

    A survivor that is no target cannot be repaired and is an error.
    """
    if check:
        unknown = unknown_survivors(targets, survived).take(1)
        if unknown:
            raise ValueError(f"unknown survived target id: {unknown[0]['target_id']}")
    left = survived.withColumn("literal", F.coalesce("matched_literal", "text")).withColumnRenamed("target_id", "id")
    scope = F.struct(F.col("scope_kind").alias("kind"), F.col("scope_path").alias("path"))
    extra = left.groupBy("doc_id", "id").agg(F.collect_set("literal").alias("more"), F.collect_set(F.when(F.col("surface") != "rels", scope)).alias("places"))
    grown = targets.join(extra, ["doc_id", "id"], "left")
    literals = F.when(F.col("more").isNull(), F.col("redaction_literals")).otherwise(longest_first(F.concat("redaction_literals", "more")))
    fresh = F.filter(F.array_sort(F.coalesce("places", F.array().cast("array<struct<kind:string,path:string>>"))), lambda p: ~F.exists("scopes", lambda s: s["path"] == p["path"]))
    out = grown.select("doc_id", "id", "display_text", literals.alias("redaction_literals"), literals.alias("verification_literals"), F.concat("scopes", fresh).alias("scopes"))
    repairs = left.filter("surface = 'rels'").groupBy("doc_id", F.col("scope_path").alias("path")).agg(longest_first(F.collect_set("literal")).alias("literals"))
    summary = left.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("scope_path")).alias("touched_scope_paths"), F.bool_or(F.col("scope_kind") != "body").alias("touched_non_body_scope"),
        F.bool_or(F.col("surface").isin("field", "rels")).alias("touched_field_or_rels_surface"), F.count("*").alias("initial_survivors"),
    )
    return out, repairs, summary


# -- outcome -----------------------------------------------------------------------------------


def warning_reasons(clean: Column, is_sane: Column, non_body: Column, field_or_rels: Column, repaired: Column, repaired_scopes: Column, repaired_non_body: Column, repaired_field_or_rels: Column) -> Column:
    """Reasons in a fixed order; none while something survives."""
    reasons = F.array_compact(
        F.array(
            F.when(~is_sane, "wordCount"), F.when(non_body, "preflightTouchedNonBodyScopes"), F.when(field_or_rels, "preflightTouchedFieldOrRelsSurface"),
            F.when(repaired & (repaired_scopes > 1), "repairTouchedMultipleScopes"), F.when(repaired & repaired_non_body, "repairTouchedNonBodyScopes"),
            F.when(repaired & repaired_field_or_rels, "repairTouchedFieldOrRelsSurface"),
        )
    )
    return F.when(clean, reasons).otherwise(F.array().cast("array<string>"))


def classify(clean: Column, warnings: Column, is_sane: Column, repaired: Column) -> Column:
    return F.when(~clean, "downloadRisk").when((F.size(warnings) > 0) | ~is_sane, "downloadWarning").when(repaired, "downloadRepaired").otherwise("downloadReady")


def residual_risk(survived: Column) -> Column:
    return F.struct((survived > 0).alias("has_residual_survivors"), survived.alias("survivor_count"), (survived > 0).alias("requires_acknowledgement"))


def can_download(kind: Column, acknowledged: Column) -> Column:
    return F.when(kind.isin("strictClean", "warning"), True).otherwise(acknowledged)


def redacted_filename(name: Column, unverified: bool = False) -> Column:
    """The marker goes before the last dot, or at the end."""
    mark = ".UNVERIFIED.redacted" if unverified else ".redacted"
    return F.when(name.contains("."), F.regexp_replace(name, r"^(?s)(.*)(\.[^.]*)\z", f"$1{mark}$2")).otherwise(F.concat(name, F.lit(mark)))


# -- preview -----------------------------------------------------------------------------------


SPAN = "array<struct<start:int,size:int,ord:int,end:int,id:string,selected:boolean>>"


def _span(start: Column, end: Column, m: Column) -> Column:
    """Sorts by start, then the longest first, then order."""
    return F.struct(start.alias("start"), (start - end).alias("size"), m["ord"].alias("ord"), end.alias("end"), m["id"].alias("id"), m["selected"].alias("selected"))


def _apart(spans: Column) -> Column:
    """Of sorted spans those that start where the last kept one has ended."""
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPAN), lambda acc, s: F.when(s["start"] >= last(acc), F.array_append(acc, s)).otherwise(acc))


def _found_marks(text: Column, marks: Column) -> Column:
    """Spans of the marks' texts; marks without any are looked for in the normalised text."""
    raw = F.flatten(F.transform(marks, lambda m: F.transform(_places(text, m["text"]), lambda k: _span(k, k + F.length(m["text"]), m))))

    def with_normalised(first: Column) -> Column:
        seen = F.transform(first, lambda s: s["id"])
        rest = F.filter(marks, lambda m: ~F.array_contains(seen, m["id"]))

        def spans(n: Column) -> Column:
            at = lambda k: F.element_at(n["offsets"], k + 1)
            of = lambda m: F.transform(_places(n["norm"], T.normalize(m["text"])), lambda k: _span(at(k), at(k + F.length(T.normalize(m["text"]))), m))
            return F.flatten(F.transform(rest, of))

        more = T.let(F.struct(T.normalize(text).alias("norm"), T.original_offsets(text).alias("offsets")), spans)
        return F.when(F.size(rest) == 0, first).otherwise(_apart(F.concat(first, more)))

    return T.let(_apart(raw), with_normalised)


def preview_marks(text: Column, marks: Column) -> Column:
    """array<struct<start, end, id, selected>> that do not overlap.

    ``marks``: array<struct<text, id, selected>>.  All occurrences, also overlapping
    ones, are laid out by start, then longest, then order, and the first that fits
    stays; a mark of which none stays is looked for in the normalised text.  Selected
    marks are laid out first, and others stay where they meet none of them.
    """
    numbered = F.transform(F.coalesce(marks, F.array().cast("array<struct<text:string,id:string,selected:boolean>>")), lambda m, i: F.struct(m["text"].alias("text"), m["id"].alias("id"), m["selected"].alias("selected"), i.alias("ord")))
    chosen, others = _found_marks(text, F.filter(numbered, lambda m: m["selected"])), _found_marks(text, F.filter(numbered, lambda m: ~m["selected"]))
    meets = lambda s, c: F.exists(c, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
    both = T.let(F.struct(chosen.alias("c"), others.alias("o")), lambda v: F.array_sort(F.concat(v["c"], F.filter(v["o"], lambda s: ~meets(s, v["c"])))))
    return F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["id"].alias("id"), s["selected"].alias("selected")))


def preview_segments(text: Column, marks: Column) -> Column:
    """array<struct<type, text, id, selected>>: text and marks in turn, covering the paragraph."""
    found = preview_marks(text, marks)
    start = {"at": "int", "out": "array<struct<type:string,text:string,id:string,selected:boolean>>"}
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(start["out"]).alias("out"))
    piece = lambda kind, a, z, i, s: F.struct(F.lit(kind).alias("type"), F.substring(text, a + 1, z - a).alias("text"), i.alias("id"), s.alias("selected"))
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    plain = lambda a, z: F.when(z > a, F.array(piece("text", a, z, none, no))).otherwise(F.array().cast(start["out"]))
    step = lambda acc, m: F.struct(m["end"].alias("at"), F.concat(acc["out"], plain(acc["at"], m["start"]), F.array(piece("mark", m["start"], m["end"], m["id"], m["selected"]))).alias("out"))
    return F.aggregate(found, zero, step, lambda acc: F.concat(acc["out"], plain(acc["at"], F.length(text))))
