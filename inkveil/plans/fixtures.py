"""Texts made of table rows, by one SQL expression that Spark and DuckDB read alike.

All numbers come from keys by arithmetic.  ``contracts`` has one English and one Korean
contract for each customer; every third has typographic dashes and full-width colons, and
every fifth zero-width spaces are left to ``noisy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _pad(x: str, n: int) -> str:
    return f"lpad({_s(x)}, {n}, '0')"


K = "c_custkey"
Y, M, D = f"(1990 + {K} % 40)", f"(1 + {K} % 12)", f"(1 + {K} % 31)"
ISO = f"concat({_s(Y)}, '-', {_pad(M, 2)}, '-', {_pad(D, 2)})"
MONTH_NAME = f"CASE {K} % 4 WHEN 0 THEN 'January' WHEN 1 THEN 'Feb.' WHEN 2 THEN 'Sept' ELSE 'May' END"
THOUSANDS = f"concat({_s(f'1 + {K} % 900')}, ',', {_pad(f'{K} * 7 % 1000', 3)})"
#: Every second one fails the checksum.
CARD = f"concat('4111 1111 1111 11', CASE {K} % 2 WHEN 0 THEN '11' ELSE {_pad(f'{K} % 100', 2)} END)"
NAME = f"concat('Acme ', CASE {K} % 3 WHEN 0 THEN 'Holdings' WHEN 1 THEN 'Trading' ELSE 'North Star' END)"

ENGLISH = [
    "'SUPPLY AGREEMENT'", "'\n\nThis agreement is made by '", NAME, "' Corp. (hereinafter referred to as \"Buyer\") and Beta '", "CASE c_custkey % 2 WHEN 0 THEN 'GmbH' ELSE 'Limited' END",
    "'; seller.\nWHEREAS, Gamma Works wants parts; \"Fee\" means '", _s(f"{K} % 100"), "'.5% of $'", THOUSANDS, "'.25; \"Term\" shall mean '", _s(f"1 + {K} % 30"), "' Days;\nalso USD '", THOUSANDS, "' or EUR '", _s(f"{K} * 3"),
    "' or \N{EURO SIGN}'", _s(K), "' or KRW '", THOUSANDS, "';\nsigned on '", ISO, "' and '", MONTH_NAME, "' '", _s(D), "', '", _s(Y), "', received '", ISO, "'T10:30Z by Mr. John Smith and CEO Jane Doe;\nmail '",
    "CASE c_custkey % 3 WHEN 0 THEN 'legal' ELSE 'bob' END", "'@acme-'", _s(K), "'.co.kr, phone +82 10 '", _pad(f"{K} % 10000", 4), "' 5678, EIN '", _pad(f"{K} % 100", 2), "'-'", _pad(f"{K} * 13 % 10000000", 7),
    "', card '", CARD, "', code \"Project Blue\";\nCase No.: 24-cv-'", _s(K), "'; Phone: +1 555 '", _pad(f"{K} % 10000", 4), "' 99;\nMailing Address: '", _s(K), "' Main Street Springfield\nCompany Name: Delta Works\nThe Buyer pays. Acme pays, Acme Corp pays.\nName: Alice Brown; Title: Head of Sales;'",
]
KOREAN = [
    "'물품공급계약서\n매수인 한빛상사 주식회사 (이하 \"갑\"), 계약일: '", _s(Y), "'년 '", _s(M), "'월 '", _s(D), "'일, 만료일: '", _s(Y), "'.'", _s(M), "'.'", _s(D), "', 기간 '", _s(Y), "'년 1월 2일부터 '", _s(f"{Y} + 1"), "'년 1월 2일까지, '", _s(f"1 + {K} % 36"), "'개월;\n금액: '", THOUSANDS, "'원, 총 '", _s(f"1 + {K} % 9"),
    "'억원의 3분의 '", _s(f"1 + {K} % 3"), "';\n대표자: 김철수, 주민번호 '", _pad(f"{K} % 1000000", 6), "'-'", _s(f"1 + {K} % 9"), "'234567, 사업자 '", _pad(f"{K} % 1000", 3), "'-45-'", _pad(f"{K} % 100000", 5), "', 계좌 '", _pad(f"{K} % 10000", 4), "'-12-'", _pad(f"{K} % 1000000", 6), "', 휴대폰 번호 010-'", _pad(f"{K} % 10000", 4),
    "'-5678, 전화: 02-'", _pad(f"{K} % 10000", 4), "'-1234;\n주소: 서울시 강남구 테헤란로 '", _s(K), "'번지\n주식회사 가온 및 (주)나래, 재단법인 다솜; 대표이사 홍길동, 이영희 선생님, 사건번호: '", _s(Y), "'가합'", _s(K), "';\n\"물품\"이란 함은 부품을 말한다. \"을\"이라 함은 매도인을 뜻한다.\n이름: 박민수 확인'",
]


def _text(parts: list[str]) -> str:
    plain = f"concat({', '.join(parts)})"
    return f"CASE WHEN {K} % 3 = 0 THEN translate({plain}, '-:', '–：') ELSE {plain} END"


#: doc_id, lang, text
CONTRACTS = f"""SELECT {K} * 2 AS doc_id, 'en' AS lang, {_text(ENGLISH)} AS text FROM customer
UNION ALL SELECT {K} * 2 + 1 AS doc_id, 'ko' AS lang, {_text(KOREAN)} AS text FROM customer"""

#: The same with a zero-width space after every full stop and comma of every fifth customer's.
NOISY = f"SELECT doc_id, lang, CASE WHEN doc_id % 10 < 2 THEN replace(replace(text, '.', concat('.', '​')), ',', concat('​', ',')) ELSE text END AS text FROM ({CONTRACTS}) AS c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by their keys in as many tasks as there are cores or parts.

    A file, or one group of its rows, is one task's; and a task of the whole detection costs a second or two by itself.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()), *keys)


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture's SQL over this directory's customers."""
    # Spark's literals read a backslash as an escape; the expressions have none
    # a text is long and its key short: keys are dealt out before texts are made
    keys = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=keys)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, CONTRACTS)


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, NOISY)
