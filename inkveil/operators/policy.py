"""Selection policies as JSON: checked on reading, canonical on writing."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import text as T

#: Limits of the format (fixed values).
SCHEMA_VERSION, MOST_CHARS, MOST_ENTRIES, MOST_TEXT, MOST_NAME = 1, 256 * 1024, 500, 200, 120
CATEGORIES = ("literals", "financial", "temporal", "entities", "legal", "other")
SHAPE = "struct<schemaVersion:double,createdAt:string,name:string,entries:array<struct<text:string,category:string,defaultSelected:boolean>>>"
ENTRY = "array<struct<text:string,category:string,defaultSelected:boolean>>"


def parse(source: Column) -> Column:
    return F.from_json(source, SHAPE, {"mode": "PERMISSIVE"})


def error(source: Column) -> Column:
    """The first thing that is wrong with a policy file; null if nothing is."""
    p = parse(source)
    text = lambda e: F.length(T.trim(e["text"]))
    bad = lambda test: F.exists(p["entries"], lambda e: F.coalesce(test(e), F.lit(True)))
    return (
        F.when(F.length(source) > MOST_CHARS, "Policy file is too large.")
        .when(~F.coalesce(F.try_parse_json(source).isNotNull(), F.lit(False)), "Policy file is not valid JSON.")
        .when(F.coalesce(F.schema_of_variant(F.try_parse_json(source)), F.lit("")).startswith("OBJECT") == F.lit(False), "Policy file must be a JSON object.")
        .when(~F.coalesce(p["schemaVersion"] == SCHEMA_VERSION, F.lit(False)), "Unsupported policy schema version.")
        .when(F.try_to_timestamp(p["createdAt"]).isNull(), "Policy createdAt must be an ISO date string.")
        .when(~F.coalesce(F.length(T.trim(p["name"])).between(1, MOST_NAME), F.lit(False)), "Policy name must be 1-120 characters.")
        .when(p["entries"].isNull(), "Policy entries must be an array.")
        .when(F.size(p["entries"]) > MOST_ENTRIES, "Policy has too many entries.")
        .when(bad(lambda e: ~text(e).between(1, MOST_TEXT)), "Policy entry text must be 1-200 characters.")
        .when(bad(lambda e: ~e["category"].isin(*CATEGORIES)), "Unsupported policy category.")
        .when(bad(lambda e: e["defaultSelected"].isNull()), "Policy entry defaultSelected must be boolean.")
    )


def entries(source: Column) -> Column:
    """Entries of a valid policy; of one (category, text) the last value at the first place."""
    e = F.transform(parse(source)["entries"], lambda x: F.struct(T.trim(x["text"]).alias("text"), x["category"].alias("category"), x["defaultSelected"].alias("defaultSelected")))
    same = lambda x, y: (x["text"] == y["text"]) & (x["category"] == y["category"])
    firsts = F.filter(e, lambda x, i: ~F.exists(F.slice(e, F.lit(1), i), lambda y: same(x, y)))
    return F.transform(firsts, lambda x: F.element_at(F.filter(e, lambda y: same(x, y)), -1))


def read(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Adds ``error`` and, where there is none, ``name``, ``created_at`` and ``entries``."""
    source = F.col(json_col)
    out = df.withColumn("error", error(source))
    ok = F.col("error").isNull()
    p = parse(source)
    return out.withColumn("name", F.when(ok, T.trim(p["name"]))).withColumn("created_at", F.when(ok, p["createdAt"])).withColumn("entries", F.when(ok, entries(source)))


def serialize(policy: dict) -> str:
    """Pretty JSON with a final newline; raises on what :func:`error` would name."""
    found: dict[tuple[str, str], dict] = {}
    if policy.get("schemaVersion") != SCHEMA_VERSION:
        raise ValueError("Unsupported policy schema version.")
    name = policy.get("name", "").strip()
    if not 1 <= len(name) <= MOST_NAME:
        raise ValueError("Policy name must be 1-120 characters.")
    rows: Iterable[dict] = policy.get("entries", [])
    if len(list(rows)) > MOST_ENTRIES:
        raise ValueError("Policy has too many entries.")
    for e in rows:
        text = e["text"].strip()
        if not 1 <= len(text) <= MOST_TEXT:
            raise ValueError("Policy entry text must be 1-200 characters.")
        if e["category"] not in CATEGORIES:
            raise ValueError(f"Unsupported policy category: {e['category']}")
        if not isinstance(e["defaultSelected"], bool):
            raise ValueError("Policy entry defaultSelected must be boolean.")
        found[e["category"], text] = {"text": text, "category": e["category"], "defaultSelected": e["defaultSelected"]}
    out = {"schemaVersion": SCHEMA_VERSION, "createdAt": policy["createdAt"], "name": name, "entries": list(found.values())}
    return json.dumps(out, indent=2, ensure_ascii=False) + "\n"


def create(rows: Iterable[dict], created_at: str, name: str = "Document redaction policy") -> dict:
    return json.loads(serialize({"schemaVersion": SCHEMA_VERSION, "createdAt": created_at, "name": name, "entries": list(rows)}))
