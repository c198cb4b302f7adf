"""Scalar functions, rules, detection and redaction on small inputs."""

from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.operators import detect as D
from inkveil.operators import policy, propagate
from inkveil.operators import redact as R
from inkveil.operators import targets as G
from inkveil.operators import verify as V
from inkveil.rules.registry import RULES, check_registry

ZW = "​"


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(column).collect()]


def test_normalize_and_offsets(spark):
    assert values(spark, T.normalize("t"), ["“a”–１" + ZW, "", None]) == ['"a"-1', "", None]
    assert values(spark, T.original_offsets("t"), [f"a{ZW}b"]) == [[0, 2, 3]]


def test_language(spark):
    assert values(spark, T.detect_language("t"), ["계약서", "contract", "계약 ab", "123", ""]) == ["ko", "en", "mixed", "en", "en"]


def test_luhn_dates_and_amounts(spark):
    assert values(spark, T.luhn(F.col("t")), ["4111 1111 1111 1111", "4111 1111 1111 1112", "0000"]) == [True, False, False]
    assert values(spark, T.valid_numeric_date(F.col("t")), ["2024-02-29", "2023-02-29", "1899-01-01", "2024년 3월 15일"]) == [True, False, False, True]
    assert values(spark, T.valid_english_date(F.col("t")), ["Sept. 30, 2024", "31 April 2024", "4 July 1976"]) == [True, False, True]
    assert values(spark, T.won_in_range(F.col("t")), ["1.5원", "0원", "원"]) == [True, False, False]


def test_counts_and_hash(spark):
    assert values(spark, T.count_bounded(F.col("t"), F.lit("ABC")), ["ABC ABC123 xABC ABC는 ABC"]) == [3]
    assert values(spark, T.count_occurrences(F.col("t"), F.lit("aa")), ["aaaa", "a", ""]) == [2, 0, 0]
    assert values(spark, T.stable_hash("t"), ["", "a"]) == ["811c9dc5", "e40c292c"]
    assert values(spark, T.is_role_like(F.col("t")), ["the Buyer", "갑", " ", "Acme", "the"]) == [True, True, True, False, False]


def test_registry_has_all_rules():
    check_registry(RULES)
    assert len(RULES) == 45


def test_every_rule_finds_its_sample(spark):
    from inkveil.plans.fixtures import contracts

    found = D.analyze_text(contracts(spark, "/root/testdata/sf0.001"), "paranoid", heuristics=(), parsers=())
    seen = {r[0] for r in D.candidates(found, "doc_id").select("rule_id").distinct().collect()}
    assert seen == {r.id for r in RULES}


def test_originals_are_recovered_through_zero_width(spark):
    df = spark.createDataFrame([(1, f"mail a{ZW}b@c.com “Zed{ZW} Name” x")], "doc_id int, text string")
    got = {(r["rule_id"], r["text"]) for r in D.detect_all(df, "doc_id", level="paranoid").collect()}
    assert ("identifiers.email", f"a{ZW}b@c.com") in got
    assert ("heuristics.quoted-term", f"Zed{ZW} Name") in got


def test_heuristics_respect_definitions_and_roles(spark):
    text = '"Blue Fox" means the thing. Blue Fox and Buyer Group and Red Hen met.'
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [r["text"] for r in D.detect_all(df, "doc_id", level="standard").collect()]
    assert got == ["Red Hen"]


def test_propagation(spark):
    text = 'Acme Holdings Corp signed. Acme paid. "Buyer" means Acme Holdings Corp. The Buyer left.'
    groups = propagate.propagate(F.lit("Acme Holdings Corp"), F.col("t"), propagate.definition_clauses(F.col("t")))
    got = [(e["text"], e["kind"], e["count"]) for e in values(spark, groups, [text])[0]]
    assert got == [("Acme Holdings Corp", "literal", 2), ("Acme", "literal", 3), ("Buyer", "defined", 2), ("The Buyer", "defined", 1)]


def test_redaction_is_longest_first_clean_and_idempotent(spark):
    literals = F.array(*map(F.lit, ["Acme", "Acme Corp", "a$b", r"x\Ey", ""]))
    once = R.redact_text(F.col("t"), literals)
    got = values(spark, once, [r"Acme Corp and Acme, a$b x\Ey", "none", None])
    assert got == ["[REDACTED] and [REDACTED], [REDACTED] [REDACTED]", "none", None]
    assert values(spark, R.redact_text(once, literals), ["Acme Corp"]) == ["[REDACTED]"]


def test_runs_are_rewritten_across_boundaries():
    m = R.Matcher(["Acme Corp"])
    xml = "<w:p><w:r><w:t>Ac</w:t></w:r><w:r><w:t>me</w:t></w:r><w:r><w:t xml:space='preserve'> Corp &amp; Co</w:t></w:r></w:p>"
    out = m.scope(xml)
    assert R.run_texts(out) == ["[REDACTED]", "", " & Co"]
    assert m.scope(out) == out


def test_longest_first_and_targets(spark):
    df = spark.createDataFrame([(["b", "aa", "", "b", "a"],)], "t array<string>")
    assert df.select(G.longest_first(F.col("t"))).first()[0] == ["aa", "a", "b"]


def test_outcomes(spark):
    yes, no = F.lit(True), F.lit(False)
    empty = F.array().cast("array<string>")
    row = spark.range(1).select(V.classify(no, empty, yes, no), V.classify(yes, F.array(F.lit("x")), yes, no), V.classify(yes, empty, yes, yes), V.classify(yes, empty, yes, no)).first()
    assert list(row) == ["downloadRisk", "downloadWarning", "downloadRepaired", "downloadReady"]
    assert values(spark, V.redacted_filename(F.col("t")), ["a.b.docx", "plain"]) == ["a.b.redacted.docx", "plain.redacted"]
    assert spark.range(1).select(V.dropped_percent(F.lit(200), F.lit(139)), V.dropped_percent(F.lit(0), F.lit(5))).first()[:] == (31, 0)


def test_preview_segments_cover_the_text(spark):
    marks = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(t).alias("id"), F.lit(s).alias("selected")) for t, s in (("Acme", True), ("Acme Corp", False))))
    got = values(spark, V.preview_segments(F.col("t"), marks), ["An Acme Corp x", ""])
    assert [(s["type"], s["text"]) for s in got[0]] == [("text", "An "), ("mark", "Acme"), ("text", " Corp x")]
    assert got[1] == []


def test_policy(spark):
    good = policy.serialize({"schemaVersion": 1, "createdAt": "2024-01-01T00:00:00Z", "name": "p", "entries": [{"text": " a ", "category": "legal", "defaultSelected": True}]})
    bad = ["{", "[]", good.replace('"schemaVersion": 1', '"schemaVersion": 2'), good.replace("legal", "other2")]
    assert values(spark, policy.error(F.col("t")), [good, *bad]) == [None, "Policy file is not valid JSON.", "Policy file must be a JSON object.", "Unsupported policy schema version.", "Unsupported policy category."]
    assert values(spark, policy.entries(F.col("t")), [good])[0][0]["text"] == "a"


def test_targets_of_the_whole_detection(spark):
    from inkveil.plans.queries import QUERIES

    texts = {r["text"] for r in QUERIES["manual_targets"](spark, "/root/testdata/sf0.001").filter("doc_id in (2, 3)").collect()}
    assert {"Gamma Works", "01-0000013", "000001-2234567", "김철수", "Main Street"} <= texts
    listed = {r["doc_id"]: r["targets"] for r in QUERIES["all_targets_whole"](spark, "/root/testdata/sf0.001").filter("doc_id in (2, 3)").collect()}
    assert "Gamma Works" in listed[2] and [len(t) for t in listed[2]] == sorted(map(len, listed[2]), reverse=True)


def test_redaction_by_the_whole_detection(spark, tmp_path):
    from inkveil.plans.queries import redacted

    texts = ["Company Name: Delta Works; EIN 12-3456789 of Mr. John Smith; Phone: 555 0100 99; signed May 4, 2020.", "대표자: 김철수, 주민번호 900101-1234567, 전화: 02-1234-5678"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = " ".join(r["redacted"] for r in redacted(spark, str(tmp_path), whole=True).collect())
    assert not [x for x in ("Delta Works", "12-3456789", "John Smith", "555 0100", "May 4", "김철수", "900101", "1234-5678") if x in got]
