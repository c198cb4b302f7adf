"""Review sessions: selections, additions by hand, policies, and redaction end to end."""

from collections import Counter

from pyspark.sql import functions as F

from inkveil.operators import session
from inkveil.operators import targets as G
from inkveil.operators import verify as V

SCOPES = "doc_id long, scope_ord int, scope_kind string, scope_path string, text string"
TEXT = 'Acme Corp and Acme met; "Buyer" means Acme Corp, as said. Write to a\u200bb@c.com today. Main\u200b Street 1.'


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_additions_toggles_and_removals(spark):
    texts = spark.createDataFrame([(1, 0, "body", "b", TEXT), (1, 1, "header", "h", None)], SCOPES)
    seeds = spark.createDataFrame([(1, 0, "Acme Corp"), (1, 1, "Acme")], "doc_id long, seed_ord int, seed string")
    found = session.analyze(texts, seeds)
    assert rows(found.literals, "text", "seed") == [("Acme", "Acme Corp"), ("Acme Corp", "Acme Corp")]
    assert rows(found.defined, "text", "seed") == [("Buyer", "Acme Corp")]
    sections = {r["text"]: (r["review_section"], r["default_selected"]) for r in found.targets.collect()}
    assert sections["Acme Corp"] == ("literals", True) and sections["Buyer"] == ("defined", False) and sections["a\u200bb@c.com"] == ("pii", True)
    chosen = G.default_selections(found.targets)
    more = spark.createDataFrame([(1, "other", "  Main Street ", True), (1, "legal", "Buyer", True), (1, "other", "x" * 201, True), (1, "other", " ", True)], "doc_id long, category string, text string, default_selected boolean")
    merged, now = session.merge_additions(found, chosen, more)
    by = {r["text"]: r for r in merged.targets.collect()}
    assert by["Main Street"]["source_kinds"] == ["manual"] and by["Main Street"]["literals"] == ["Main\u200b Street", "Main Street"]
    assert by["Buyer"]["source_kinds"] == ["literal", "manual"] and len(by) == len(sections) + 1
    assert {by["Buyer"]["id"], by["Main Street"]["id"]} <= {r["id"] for r in now.collect()}
    again, same = session.merge_additions(merged, now, more)
    assert Counter(rows(again.targets, "id")) == Counter(rows(merged.targets, "id")) and rows(same, "id") == rows(now, "id")
    gone, left = session.remove_additions(merged, now, more.select("doc_id", F.trim("text").alias("text")))
    assert rows(gone.targets, "id") == rows(found.targets, "id") and rows(left, "id") == rows(chosen, "id")
    flip = merged.targets.filter("text = 'Buyer'").select("doc_id", "id")
    assert by["Buyer"]["id"] not in {r["id"] for r in session.toggle(now, flip).collect()}
    assert rows(session.toggle(now, flip.unionByName(flip)), "id") == rows(now, "id")
    files = session.export_policies(merged, session.toggle(now, flip), more, "2024-01-01T00:00:00Z")
    back, errors = session.import_policies(files.unionByName(spark.createDataFrame([(2, "{")], "doc_id long, json string")))
    assert rows(back, "category", "text", "default_selected") == [("legal", "Buyer", False), ("other", "Main Street", True)]
    assert rows(errors, "doc_id", "error") == [(2, "Policy file is not valid JSON.")]


def test_packages_are_redacted_from_the_original(spark, tmp_path):
    import io
    import zipfile

    def package(text):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr("_rels/.rels", "<Relationships/>")
            z.writestr("word/document.xml", f"<w:document><w:body><w:p><w:r><w:t>{text[:7]}</w:t></w:r><w:r><w:t>{text[7:]}</w:t></w:r></w:p></w:body></w:document>")
        return data.getvalue()

    made = spark.createDataFrame([(1, package("Mail bob@acme.com and Acme Corp today, friends of the long text")), (2, b"nothing")], "doc_id long, content binary")
    found = session.analyze_packages(made, spark.createDataFrame([(1, 0, "Acme Corp")], "doc_id long, seed_ord int, seed string"))
    assert rows(found.snapshot.stats, "doc_id", "scope_count") == [(1, 1)]
    chosen = G.default_selections(found.analysis.targets)
    out, report = session.apply_redaction(found, chosen)
    r = report.first()
    assert (r["doc_id"], r["is_clean"], r["survived"], r["outcome"]) == (1, True, 0, "downloadReady")
    xml = out.filter("path = 'word/document.xml'").first()["content"].decode()
    assert "bob@" not in xml and "Acme" not in xml and "[REDACTED]" in xml
    none, _ = session.apply_redaction(session.replace(found, found.analysis), chosen.limit(0))
    assert "Acme" in none.filter("path = 'word/document.xml'").first()["content"].decode()


def test_preview_marks_fall_back_to_the_normalised_text(spark):
    def segments(text, marks):
        made = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(t).alias("id"), F.lit(s).alias("selected")) for t, s in marks))
        return [(s["type"], s["text"], s["id"]) for s in spark.createDataFrame([(text,)], "t string").select(V.preview_segments(F.col("t"), made)).first()[0]]

    assert segments("a\u200bb c", [("ab", True)]) == [("mark", "a\u200bb", "ab"), ("text", " c", None)]
    # a raw mark that is left keeps its normalised forms away
    assert segments("ab a\u200bb", [("ab", True)]) == [("mark", "ab", "ab"), ("text", " a\u200bb", None)]
    # one that stands in a longer one is looked for elsewhere
    assert segments("xab a\u200bb", [("xab", True), ("ab", True)]) == [("mark", "xab", "xab"), ("text", " ", None), ("mark", "a\u200bb", "ab")]
    # an unselected mark that meets a selected one goes, but holds off those that it met first
    assert segments("abcdef", [("ab", True), ("bcd", False), ("def", False)]) == [("mark", "ab", "ab"), ("text", "cdef", None)]
    assert segments("", [("ab", True)]) == []
