"""Word-processing packages as tables: entries, scopes, paragraphs, surfaces, and back.

Packages come as rows (doc_id, content).  Unzipping and zipping are the only Python
steps; what is wrong with a package is a column, not an exception, so one bad file does
not stop a corpus.  ``entries`` has doc_id, path, content (binary) and error.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.functions import lexicon as L
from inkveil.operators import redact as R
from inkveil.operators import verify as V
from inkveil.sources.shared import written

MOST_INPUT, MOST_ENTRY = 50 << 20, 20 << 20
#: Bytes of entries that unzipping holds before it hands them on.
MOST_BATCH = 8 << 20
#: Documents of which each machine gets a list, rather than that entries meet them by a shuffle.
MOST_LISTED = 100_000
#: The earliest date a ZIP entry can have, for output that does not depend on the clock.
ENTRY_DATE = (1980, 1, 1, 0, 0, 0)
PARAGRAPH = r"(?s)<w:p(?!P|r)(?:\s[^>]*)?(?:/>|>.*?</w:p>)"
RUN = r"(?s)<w:r(?:\s[^>]*)?(?:/>|>(.*?)</w:r>)"
RUN_TEXT = r"(?s)<w:t(?:\s[^>]*)?(?:/>|>(.*?)</w:t>)"


def by_document(df: DataFrame, name: str) -> DataFrame:
    """A table with rows for each document, written, that is never handed out through the driver.

    Spark goes by the size of the files, and rows that are alike take next to nothing there: those of
    27,000 documents are 0.3 MB written and 17 MB handed out.
    """
    return written(df, name).hint("merge")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and content of all files under a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")


def unzip(packages: DataFrame, contents: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, path, content, error: one row an entry, or one row with the error of the file.

    Every entry is read and tested; ``contents`` names those whose content is wanted, if not all are.
    """
    kind = packages.schema["doc_id"].dataType.simpleString()

    columns = ["doc_id", "path", "content", "error"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ready, held = [], 0
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                rows = []
                if content is None or not 0 < len(content) <= MOST_INPUT:
                    rows.append((doc_id, None, None, "FileTooLargeError"))
                else:
                    try:
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            for e in z.infolist():
                                if not e.is_dir():
                                    # the limit is in characters of text; none is longer than its bytes
                                    big = e.file_size > 4 * MOST_ENTRY
                                    data = None if big else z.read(e)
                                    big = big or (len(data) > MOST_ENTRY and len(data.decode("utf-8", "replace")) > MOST_ENTRY)
                                    shown = not big and (contents is None or e.filename in contents)
                                    rows.append((doc_id, e.filename, data if shown else None, "EntryTooLargeError" if big else None))
                    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, ValueError):
                        rows = [(doc_id, None, None, "CorruptDocxError")]
                # many small packages make one batch; a large one goes at once
                ready += rows
                held += sum(len(r[2] or b"") for r in rows)
                if held > MOST_BATCH:
                    yield pd.DataFrame(ready, columns=columns)
                    ready, held = [], 0
            if ready:
                yield pd.DataFrame(ready, columns=columns)

    return packages.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, path string, content binary, error string")


def validate(entries: DataFrame) -> DataFrame:
    """doc_id, error: the first of the package's faults, in a fixed order, or null."""
    has = lambda c: F.bool_or(c)
    path, types = F.col("path"), F.col("path") == "[Content_Types].xml"
    macro = (types & F.col("content").cast("string").rlike("(?i)macroEnabled|vbaProject")) | path.rlike(r"(?i)(^|/)(vbaProject\.bin|vbaData\.xml)$")
    by = entries.groupBy("doc_id").agg(
        F.min(F.when(path.isNull(), F.col("error"))).alias("file"), has(path.isin("EncryptionInfo", "EncryptedPackage")).alias("locked"), has(types).alias("typed"),
        has(macro).alias("macro"), has(path == "word/document.xml").alias("main"), has(path.isin("_rels/.rels", "word/_rels/document.xml.rels")).alias("rels"),
    )
    error = (
        F.when(F.col("file").isNotNull(), F.col("file")).when(F.col("locked"), "encrypted or password-protected files are not supported")
        .when(~F.col("typed"), 'missing "[Content_Types].xml"').when(F.col("macro"), "macros or VBA parts are not supported")
        .when(~F.col("main"), 'missing "word/document.xml"').when(~F.col("rels"), "missing package relationships")
    )
    return by.select("doc_id", error.alias("error"))


def scope_kind(path: Column) -> Column:
    kind = F.when(path.rlike(r"^word/header[0-9]*\.xml\z"), "header").when(path.rlike(r"^word/footer[0-9]*\.xml\z"), "footer")
    for k, p in L.FIXED_SCOPES:
        kind = kind.when(path == p, k)
    return kind


def scopes(entries: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, scope_kind, scope_path, scope_ord, xml: text-bearing parts in reading order.

    With ``texts`` the last column is the text instead, which is made before parts of a
    package meet: texts are much shorter than their mark-up.
    """
    rows = entries.withColumn("scope_kind", scope_kind(F.col("path"))).filter("scope_kind is not null")
    rows = rows.select("doc_id", "scope_kind", "path", F.col("content").cast("string").alias("xml"))
    last = "xml"
    if texts:
        rows, last = scope_texts(rows), "text"
    rank = F.array_position(F.array(*map(F.lit, ("body", "footnotes", "endnotes", "comments", "header", "footer"))), F.col("scope_kind"))
    number = F.coalesce(F.regexp_extract("path", r"([0-9]+)\.xml$", 1).try_cast("long"), F.lit(0))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, number, "path")) - 1
    return rows.select("doc_id", "scope_kind", F.col("path").alias("scope_path"), order.alias("scope_ord"), last)


def scopes_of_kind(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.filter(F.col("scope_kind").isin(*kinds))


def run_texts(paragraph: Column) -> Column:
    """Texts of a paragraph's runs, entities as they stand."""
    return F.transform(F.regexp_extract_all(paragraph, F.lit(RUN), F.lit(0)), lambda r: F.array_join(F.regexp_extract_all(r, F.lit(RUN_TEXT), F.lit(1)), ""))


#: Between paragraphs and runs while entities are decoded in one go; XML allows neither.
_PARA, _RUN_END = "\x1e", "\x1f"


def paragraphs(xml: Column) -> Column:
    """array<string>: the text of each paragraph; empty ones count."""
    raw = F.transform(F.regexp_extract_all(xml, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.array_join(run_texts(p), ""))
    whole = R.decode_xml(F.array_join(raw, _PARA))
    return F.when(F.size(raw) == 0, F.array().cast("array<string>")).otherwise(F.split(whole, _PARA))


def coalesced(paragraph: Column) -> Column:
    """struct<text, runs: array<struct<index, start, length>>> of a paragraph."""
    runs = F.split(R.decode_xml(F.array_join(run_texts(paragraph), _RUN_END)), _RUN_END)
    runs = F.when(paragraph.rlike(RUN), runs).otherwise(F.array().cast("array<string>"))
    start = lambda i: F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda s, r: s + F.length(r))
    return F.struct(F.array_join(runs, "").alias("text"), F.transform(runs, lambda r, i: F.struct(i.alias("index"), start(i).alias("start"), F.length(r).alias("length"))).alias("runs"))


def scope_texts(rows: DataFrame) -> DataFrame:
    """Scopes with ``text``, their paragraphs joined by newlines."""
    raw = F.transform(F.regexp_extract_all("xml", F.lit(PARAGRAPH), F.lit(0)), lambda p: F.array_join(run_texts(p), ""))
    # a column of its own, since decoding names its text many times
    rows = rows.withColumn("text", F.array_join(raw, _PARA))
    return rows.withColumn("text", F.replace(R.decode_xml(F.col("text")), F.lit(_PARA), F.lit("\n")))


def rendered(rows: DataFrame) -> DataFrame:
    """doc_id, scope_path, para_idx, text."""
    return rows.select("doc_id", "scope_path", "scope_ord", F.posexplode(paragraphs(F.col("xml"))).alias("para_idx", "text"))


def instructions(xml: Column) -> Column:
    """Field codes of a part: instruction texts, then those of simple fields, decoded."""
    return F.concat(F.regexp_extract_all(xml, F.lit(r"(?s)<w:instrText(?:\s[^>]*)?>(.*?)</w:instrText>"), F.lit(1)), F.regexp_extract_all(xml, F.lit(r'<w:fldSimple\b[^>]*\bw:instr="([^"]*)"'), F.lit(1)))


def relationship_targets(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"""<Relationship\b[^>]*\bTarget=["']([^"']*)["']"""), F.lit(1))


def rels_parts(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("path").endswith(".rels")).select("doc_id", "path", F.col("content").cast("string").alias("xml"))


def surfaces(entries: DataFrame) -> DataFrame:
    """doc_id, surface, scope_kind, scope_path, text: all that is verified."""
    parts = scopes(entries)
    texts = scopes(entries, texts=True).select("doc_id", F.lit("text").alias("surface"), "scope_kind", "scope_path", "text")
    codes = parts.select("doc_id", F.lit("field").alias("surface"), "scope_kind", "scope_path", F.explode(instructions(F.col("xml"))).alias("text"))
    links = rels_parts(entries).select("doc_id", F.lit("rels").alias("surface"), F.lit("rels").alias("scope_kind"), F.col("path").alias("scope_path"), F.explode(relationship_targets(F.col("xml"))).alias("text"))
    decoded = codes.unionByName(links).withColumn("text", R.decode_xml(F.col("text"), repeatedly=True))
    return texts.unionByName(decoded)


def rewrite(entries: DataFrame, plan: DataFrame, repairs: DataFrame | None = None, placeholder: str = R.PLACEHOLDER) -> DataFrame:
    """Entries after redaction.

    ``plan``: doc_id, scope_path, literals.  Relationship parts are repaired first; text
    parts lose tracked changes, comment marks and field codes and are then redacted run by
    run; comment parts go; properties are emptied.
    """
    path, text = F.col("path"), F.col("content").cast("string")
    kept = entries.filter(~path.isin(*L.COMMENT_PARTS, L.CUSTOM_PROPERTIES))
    marked = kept.withColumn("scope_kind", scope_kind(path)).join(plan.withColumnRenamed("scope_path", "path").hint("merge"), ["doc_id", "path"], "left")
    if repairs is not None:
        marked = marked.join(repairs.withColumnRenamed("literals", "repairs"), ["doc_id", "path"], "left")
    else:
        marked = marked.withColumn("repairs", F.lit(None).cast("array<string>"))
    flat = R.flatten_fields(R.strip_comment_references(R.flatten_track_changes(text)))
    none = F.array().cast("array<string>")
    body, rels, meta = F.col("scope_kind").isNotNull(), path.endswith(".rels"), path.isin(*L.METADATA_PARTS)
    # one pass over the entries; Python is handed the parts that it rewrites
    new = (
        F.when(body, R.redact_scope_xml(F.when(body, flat), F.when(body, F.coalesce("literals", none)), placeholder))
        .when(rels, R.repair_rels(F.when(rels, text), F.when(rels, F.coalesce("repairs", none)), placeholder))
        .when(meta, R.scrub_metadata(text)).when(path == "[Content_Types].xml", R.remove_custom_override(text))
    )
    changed = body | rels | meta | (path == "[Content_Types].xml")
    return marked.select("doc_id", "path", F.when(changed, new.cast("binary")).otherwise(F.col("content")).alias("content"), F.lit(None).cast("string").alias("error"))


def zip_packages(entries: DataFrame) -> DataFrame:
    """doc_id, content, sha256: packages whose bytes depend on their entries alone."""
    kind = entries.schema["doc_id"].dataType.simpleString()

    def packed(parts: list[tuple[str, bytes]]) -> bytes:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            for path, content in sorted(parts, key=lambda e: (e[0] != "[Content_Types].xml", e[0])):
                z.writestr(zipfile.ZipInfo(path, ENTRY_DATE), content, zipfile.ZIP_DEFLATED, 6)
        return data.getvalue()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, parts = None, []
        for pdf in it:
            done = []
            for doc_id, path, content in zip(pdf["doc_id"].tolist(), pdf["path"], pdf["content"]):
                if parts and doc_id != doc:
                    done.append((doc, packed(parts)))
                    parts = []
                doc = doc_id
                parts.append((path, content))
            yield pd.DataFrame(done, columns=["doc_id", "content"])
        if parts:
            yield pd.DataFrame([(doc, packed(parts))], columns=["doc_id", "content"])

    # entries of a package follow each other; small packages share a batch, which a group of its own for each does not
    rows = entries.select("doc_id", "path", "content").repartition("doc_id").sortWithinPartitions("doc_id")
    out = rows.mapInPandas(run, f"doc_id {kind}, content binary")
    return out.withColumn("sha256", F.sha2("content", 256))


def redacted_entries(entries: DataFrame, targets: DataFrame, repairs: DataFrame | None = None, placeholder: str = R.PLACEHOLDER) -> DataFrame:
    """Entries after redaction by the targets' literals, without a report."""
    parts = entries.select("doc_id", F.col("path").alias("scope_path")).filter(scope_kind(F.col("scope_path")).isNotNull())
    literals = targets.groupBy("doc_id").agg(F.flatten(F.collect_list("redaction_literals")).alias("literals"))
    return rewrite(entries, R.scope_plan(literals, targets, parts), repairs, placeholder)


def finalize(entries: DataFrame, targets: DataFrame, repairs: DataFrame | None = None, placeholder: str = R.PLACEHOLDER) -> tuple[DataFrame, DataFrame]:
    """(entries after redaction, a report a document: words before and after, survivors, outcome fields)."""
    after = by_document(redacted_entries(entries, targets, repairs, placeholder), "redacted")
    seen = by_document(surfaces(after), "surfaces")
    before = V.word_counts(scopes(entries, texts=True), "words_before")
    words = V.word_counts(scopes(after, texts=True), "words_after")
    report = before.join(words, "doc_id").join(V.verify(seen, targets).hint("merge"), "doc_id")
    lost = V.dropped_percent(F.col("words_before"), F.col("words_after"))
    report = report.withColumn("dropped_percent", lost).withColumn("sane", F.col("dropped_percent") <= V.DROP_THRESHOLD)
    return after, report


def guided_redaction(entries: DataFrame, targets: DataFrame, placeholder: str = R.PLACEHOLDER) -> tuple[DataFrame, DataFrame]:
    """Preflight, a first pass, one repair pass for documents that are not clean, and the outcome.

    The first pass is the boundary of an action, since the second works on its survivors;
    the repair pass starts from the original entries of the dirty documents alone.
    """
    grown, repairs, summary = V.preflight(by_document(surfaces(entries), "surfaces"), by_document(targets, "targets"))
    grown, repairs, summary = by_document(grown, "grown"), by_document(repairs, "repairs"), by_document(summary, "summary")
    first, report = finalize(entries, grown, repairs, placeholder)
    report = written(report, "report")
    dirty = report.filter("not is_clean").select("doc_id")
    n, report = dirty.count(), report.hint("merge")
    dirty = dirty.hint("broadcast" if n <= MOST_LISTED else "merge")
    mine = lambda df: df.join(dirty, "doc_id", "left_semi").hint("merge")
    if n:
        left = V.survivors(surfaces(mine(first)), mine(grown))
        left = by_document(left.filter(~F.col("target_id").startswith(V.EXTERNAL_URL)), "survivors")
        again, more, fixed = (by_document(x, "repair") for x in V.repair_plan(mine(grown), left, check=False))
        second, report2 = finalize(mine(entries), again, more, placeholder)
        out = first.join(dirty, "doc_id", "left_anti").unionByName(second)
        both = report.join(dirty, "doc_id", "left_anti").withColumn("repaired", F.lit(False)).unionByName(report2.withColumn("repaired", F.lit(True)))
    else:
        kind = entries.schema["doc_id"].dataType.simpleString()
        fixed = entries.sparkSession.createDataFrame([], f"doc_id {kind}, touched_scope_paths array<string>, touched_non_body_scope boolean, touched_field_or_rels_surface boolean")
        out, both = first, report.withColumn("repaired", F.lit(False))
    both = both.join(summary, "doc_id", "left").join(fixed.select("doc_id", F.size("touched_scope_paths").alias("r_scopes"), F.col("touched_non_body_scope").alias("r_non_body"), F.col("touched_field_or_rels_surface").alias("r_field")), "doc_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = V.warning_reasons(F.col("is_clean"), F.col("sane"), yes("touched_non_body_scope"), yes("touched_field_surface") | yes("touched_rels_surface"), F.col("repaired"), F.coalesce("r_scopes", F.lit(0)), yes("r_non_body"), yes("r_field"))
    both = both.withColumn("warning_reasons", reasons)
    outcome = V.classify(F.col("is_clean"), F.col("warning_reasons"), F.col("sane"), F.col("repaired"))
    return out, both.withColumn("outcome", outcome).withColumn("residual_risk", V.residual_risk(F.col("survived"))).drop("r_scopes", "r_non_body", "r_field")
