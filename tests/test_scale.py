"""What keeps the text queries fast on large tables, and that it changes no result."""

from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.operators import detect as D
from inkveil.plans.fixtures import contracts
from inkveil.rules.registry import BY_ID, RULES, expand
from inkveil.sources import docx

ODD = [
    "Name: Alice Brown\nCompany  Name :Delta; Name:　　Bob", "Name:" + " " * 9 + "Alice", "Name Alice: Bob", "Tel: +1 (555) 010-99;", "Phone Number : 5550100 99", "주소서울시 강남구 1번지", "본점  주소:  서울시 강남구;",
    "주소 : : 서울시 강남구 역삼동\n", "전화: 02-1234-5678, Fax02-123-4567", "성명김철수 이름: Kim", "금액1,000원 총액: 5", "계약일2024.1.2 만료일: 2024년 3월 4일", "Case No.24-cv-1, Case No: 7abc; 사건: 가나다라", "Address: 12 Main St\nLocation:Paris 4", "",
]


def test_label_rules_test_characters_before_the_look_behind(spark):
    """F7, F8, F9: a look-behind of many lengths is tried at few places, with the same matches."""
    df = spark.createDataFrame([(x,) for x in ODD], "t string")
    for r in RULES:
        if r.label:
            plain = f"(?<={expand(r.label)}){expand(r.core)}" + (f"(?={expand(r.until)})" if r.until else "")
            assert r.pattern.startswith("(?=") and r.pattern.endswith(plain)
            both = df.select(F.regexp_extract_all("t", F.lit(r.pattern), F.lit(0)), F.regexp_extract_all("t", F.lit(plain), F.lit(0))).collect()
            assert all(a == b for a, b in both) and any(a for a, _ in both), r.id


def test_texts_are_dealt_out_before_they_are_made(spark):
    """One file of customers is not one task."""
    assert contracts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_offsets_and_language_in_short(spark):
    texts = ["", "a–b：c", "a​b", "\U0001f600x﻿y", "가 abc", "가나다 a"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in df.select(T.original_offsets("t")).collect()] == [[0], [0, 1, 2, 3, 4, 5], [0, 2, 3], [0, 1, 3, 4], [0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 4, 5]]
    assert [r[0] for r in df.select(T.detect_language("t")).collect()] == ["en", "en", "en", "en", "mixed", "ko"]


def test_party_declarations_by_one_search(spark):
    """the same groups as two searches without tests before them."""
    assert D.EN_PARTY_SOON.startswith("(?=")
    texts = [
        'Acme Holdings Corp. (hereinafter referred to as "Buyer") and Beta GmbH, a firm ( hereinafter as \'Seller\' )', 'A. B. Acme x. y (hereinafter as "B")', 'A B C D E F G (hereinafter as "H") (x) Zed (hereinafter as "Z")',
        'One (two) Three & Four-Co. of Paris (hereinafter as "P")', "X " * 120 + '(hereinafter as "Q")', '한빛 상사 주식회사 (이하 "갑") 및 가온주식회사(이하 을이 함)', "",
    ]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    slow = F.concat(D._each(F.col("t"), D.EN_PARTY, lambda x: D._define(x["1"], T.trim(x["0"]), "party-declaration"), 2), D._each(F.col("t"), D.KO_PARTY, lambda x: D._define(T.trim(x["1"]), T.trim(x["0"]), "party-declaration"), 2))
    rows = df.select(D.party_declaration(F.col("t")), slow).collect()
    assert all(a == b for a, b in rows) and sum(len(a) for a, _ in rows) >= 7
    assert BY_ID["entities.en-identity-context"].ends


def test_package_texts_before_parts_meet_and_contents_on_demand(spark):
    """the same texts as from numbered parts; every entry is tested, wanted contents alone are handed on."""
    import io
    import zipfile

    from inkveil.sources import docx

    data = io.BytesIO()
    body = "<w:p><w:r><w:t>a &#65;&amp;amp;</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p/>"
    with zipfile.ZipFile(data, "w") as z:
        for path, xml in (("[Content_Types].xml", "<Types/>"), ("word/document.xml", body), ("word/header1.xml", "")):
            z.writestr(path, xml)
    rows = spark.createDataFrame([(1, bytearray(data.getvalue())), (2, bytearray(b"x")), (3, None)], "doc_id long, content binary")
    some = {(r["doc_id"], r["path"]): (r["content"], r["error"]) for r in docx.unzip(rows, contents=("[Content_Types].xml",)).collect()}
    assert some == {(1, "[Content_Types].xml"): (bytearray(b"<Types/>"), None), (1, "word/document.xml"): (None, None), (1, "word/header1.xml"): (None, None), (2, None): (None, "CorruptDocxError"), (3, None): (None, "FileTooLargeError")}
    entries = docx.unzip(rows).filter("error is null")
    got = {(r["scope_path"], r["scope_ord"], r["text"]) for r in docx.scopes(entries, texts=True).collect()}
    assert got == {("word/document.xml", 0, "a A&amp;b\n"), ("word/header1.xml", 1, "")}
    assert got == {(r["scope_path"], r["scope_ord"], r["text"]) for r in docx.scope_texts(docx.scopes(entries)).select("scope_path", "scope_ord", "text").collect()}


def test_first_characters_before_look_behinds_and_hints(spark):
    """no rule, and no heuristic, starts with a look-behind but those of one rare character; matches and places are as before."""
    plain = lambda r: f"(?<![{r.before}]){expand(r.core)}" + (f"(?={expand(r.until)})" if r.until else f"(?![{r.after}])" if r.after else "")
    rules = [r for r in RULES if r.before]
    assert sum(r.pattern.startswith("(?<!") for r in rules) == 3 and not D.CLUSTER.startswith("(?") and not D.KO_TOKEN.startswith("(?")
    mark = "\ufffe\uffff"
    odd = [*ODD, "x12-3456789, 12-3456789 9123456-1234567 123456-1234567", "aUSD 5 USD 1,000.25 US$7;€5 £ 6x¥7", "5 May 2024 Sept. 3rd, 2024 aMay 1, 2024", f"{mark}2024-01-02{mark}\uffff 1.5% \uffff\ufffe", "Mr. John Smith, Dr Who AcmeMr. Ed"]
    odd += [r[0] for r in contracts(spark, "/root/testdata/sf0.001").filter("doc_id < 40").select("text").collect()]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "k int, t string")
    norm = T.normalize("t")
    old, new = (df.select(F.array(*(F.regexp_extract_all(norm, F.lit(p(r)), F.lit(0)) for r in rules))).collect() for p in (plain, lambda r: r.pattern))
    assert old == new and all(any(row[0][k] for row in new) for k, r in enumerate(rules) if r.id != "legal.legal-context")
    for r in RULES:
        hints = (r.hint, *r.hints) if r.hint else r.hints
        if hints:
            got = df.select(norm.alias("n"), F.regexp_extract_all(norm, F.lit(r.pattern), F.lit(0)).alias("f")).filter("size(f) > 0").collect()
            assert got and all(any(h in row["n"] for h in hints) for row in got), r.id
    pattern = BY_ID["temporal.date-iso"].pattern
    at = {(row["k"], x["m"], x["at"]) for row in df.select("k", D.located(norm, pattern).alias("p")).collect() for x in row["p"]}
    said = dict(df.select("k", norm).collect())
    assert (len(ODD) + 3, "2024-01-02", 2) in at and all(said[k][a : a + len(m)] == m for k, m, a in at)


def test_texts_of_one_file_are_dealt_out(spark):
    """documents of one file are not one task."""
    from inkveil.plans import queries

    rows = queries.documents(spark, "/root/testdata/sf0.001").coalesce(1)
    assert queries.dealt(rows, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_clauses_once_a_document(spark):
    """clauses are worked out before a document meets its seeds."""
    from inkveil.operators import session

    corpus = spark.createDataFrame([(1, 'Acme Holdings Corp; "Fee" means Acme Corp.')], "doc_id long, text string")
    seeds = spark.createDataFrame([(1, 0, "Acme Corp"), (1, 1, "Acme Holdings Corp")], "doc_id long, seed_ord int, seed string")
    got = session.variant_groups(corpus, seeds)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "korean-" not in plan[: plan.index("Join")] and "korean-" in plan
    assert {(r["seed_ord"], r["text"], r["kind"]) for r in got.collect()} >= {(0, "Acme Corp", "literal"), (0, "Fee", "defined"), (1, "Acme", "literal")}


def test_places_by_one_search(spark):
    """places of a literal, overlaps included, also beside the characters that mark them."""
    from inkveil.operators import verify as V

    rows = [("aaaa", "aa", [0, 1, 2]), ("￾￿ab￾￿￿ab", "ab", [2, 7]), ("\U0001f600x\U0001f600x", "x", [1, 3]), ("a.b\\Ea.b", "a.b", [0, 5]), ("x\\E", "\\E", [1]), ("abc", "", []), ("abc", "d", [])]
    df = spark.createDataFrame(rows, "t string, x string, want array<int>")
    plan = df.select(V._places(F.col("t"), F.col("x")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in plan.collect())
    assert "substring" not in plan._jdf.queryExecution().analyzed().toString()


def test_defaults_resolved_without_a_join(spark):
    """the same rows as by a join with the default selections, also where texts share an id."""
    from inkveil.operators import targets as G

    rows = [(1, "auto:1", "a", True, ["a"]), (1, "auto:1", "b", False, ["b", "bb"]), (1, "auto:2", "c", False, ["c"]), (2, "auto:2", "c", True, ["c"]), (3, "auto:3", "d", None, ["d"])]
    t = spark.createDataFrame(rows, "doc_id long, id string, text string, default_selected boolean, literals array<string>").withColumn("scopes", F.array().cast("array<struct<kind:string,path:string>>")).withColumn("o", F.lit(0))
    got, want = G.resolve_defaults(t), G.resolve(t, G.default_selections(t))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_packages_are_rewritten_in_one_pass(spark):
    """F13 F16: a plan reads the entries once, and each field step names the text before it once."""
    from inkveil.operators import redact as R

    entries = spark.createDataFrame([(1, "word/document.xml", b"<w:p><w:r><w:t>Buyer</w:t></w:r></w:p>", None), (1, "word/_rels/document.xml.rels", b"<Relationship Target=\"Buyer.xml\"/>", None), (1, "docProps/core.xml", b"<dc:creator>X</dc:creator>", None), (1, "a.bin", b"\xff\xfe", None)], "doc_id long, path string, content binary, error string")
    plan = spark.createDataFrame([(1, "word/document.xml", ["Buyer"])], "doc_id long, scope_path string, literals array<string>")
    out = docx.rewrite(entries, plan)
    got = {r["path"]: bytes(r["content"]) for r in out.collect()}
    assert got == {"word/document.xml": b'<w:p><w:r><w:t xml:space="preserve">[REDACTED]</w:t></w:r></w:p>', "word/_rels/document.xml.rels": b'<Relationship Target="Buyer.xml"/>', "docProps/core.xml": b"<dc:creator></dc:creator>", "a.bin": b"\xff\xfe"}
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
    steps = entries.select(R.flatten_fields(F.col("path")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert steps.count("path#") < 10
    many = entries.withColumn("doc_id", F.explode(F.sequence(F.lit(1), F.lit(300)))).repartition(7)
    zipped = docx.zip_packages(many)
    assert zipped.count() == 300 and zipped.select("sha256").distinct().count() == 1


def test_texts_by_hand_meet_targets_once(spark):
    """forms of a text by one search of a text normalised once, and targets that are worked out once."""
    from inkveil.operators import targets as G

    rows = [("a–b x a-b a\u200b-b", "a-b", ["a–b", "a-b", "a\u200b-b"]), ("aaaa", "aa", ["aa"]), ("a\u200ba\u200ba", "aa", ["a\u200ba\u200b", "a\u200ba"]), ("ab", "c", []), ("ab", "", []), (None, "a", [])]
    df = spark.createDataFrame(rows, "t string, n string, want array<string>")
    forms = df.select(G.original_variants(F.col("t"), F.col("n")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in forms.collect())
    assert forms._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 2
    kind = "doc_id long, text string, namespace string, source_kinds array<string>, review_section string, default_selected boolean, id string, normalized_text string, literals array<string>, count long, confidence double"
    known = [(1, "Acme", "auto", ["pii"], "pii", False, "auto:1", "Acme", ["Acme"], 2, None), (None, "Q", "auto", ["pii"], "pii", False, "auto:3", "Q", ["Q"], 1, 1.0), (3, "Z", "auto", ["pii"], "pii", False, "auto:4", "Z", ["Z"], 1, 0.5)]
    corpus = spark.createDataFrame([(1, "Ac\u200bme, new n\u200bew"), (2, None)], "doc_id long, text string")
    added = spark.createDataFrame([(1, " Acme "), (1, "new"), (1, "new "), (2, "x"), (2, " "), (None, "Q")], "doc_id long, text string")
    out = G.add_manual(spark.createDataFrame(known, kind).filter("id <> 'marked'"), corpus, added)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("marked") == 1
    got = sorted(out.select(F.coalesce("doc_id", F.lit(0)), "text", "namespace", "default_selected", F.array_join("literals", "|"), "count").collect())
    assert got == [
        (0, "Q", "auto", False, "Q", 1), (0, "Q", "manual", True, "Q", 1), (1, "Acme", "auto", True, "Ac\u200bme|Acme", 2),
        (1, "new", "manual", True, "n\u200bew|new", 1), (2, "x", "manual", True, "x", 1), (3, "Z", "auto", False, "Z", 1),
    ]


def test_tables_of_documents_are_not_handed_out(spark):
    """a table with rows for each document takes little as a file and much as a broadcast; only a short list of documents is one."""
    from inkveil.operators import targets as G

    paths = (("word/document.xml", "<w:p><w:r><w:t>Mail the Buyer of the long text today</w:t></w:r></w:p>"), ("word/_rels/document.xml.rels", "<Relationships><Relationship Id='1' Target='Buyer.xml'/></Relationships>"))
    # the second one's single-quoted target is not rewritten, so its document stays dirty
    entries = docx.written(spark.createDataFrame([(k, p, bytearray(x.encode()), None) for k in (1, 2) for p, x in paths[:k]], "doc_id long, path string, content binary, error string"), "entries")
    wanted = G.resolve_strings(entries.select("doc_id").distinct().withColumn("targets", F.array(F.lit("Buyer"))))
    ran = []
    plain = docx.written
    try:
        docx.written = lambda df, name: [plain(df, name), ran.append((name, df._jdf.queryExecution().executedPlan().toString()))][0]
        clean = sorted((r["doc_id"], r["is_clean"], r["repaired"], r["outcome"]) for r in docx.guided_redaction(entries.filter("doc_id = 1"), wanted.filter("doc_id = 1"))[1].collect())
        assert clean == [(1, True, False, "downloadReady")]
        assert {n for n, _ in ran} == {"surfaces", "targets", "grown", "repairs", "summary", "redacted", "report"}
        assert not [n for n, plan in ran if "BroadcastHashJoin" in plan]
        out, report = docx.guided_redaction(entries, wanted)
    finally:
        docx.written = plain
    assert sorted((r["doc_id"], r["is_clean"], r["repaired"], r["outcome"]) for r in report.collect()) == [(1, True, False, "downloadReady"), (2, False, True, "downloadRisk")]
    assert out.count() == 3
