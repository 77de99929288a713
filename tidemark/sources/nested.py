"""Links in JSON of any shape: a walk level by level over variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import ENDINGS, absolute
from tidemark.plans.store import kept

#: Names of fields that hold an address, and those of a title in the order they are looked at.
ADDRESSES = ("link", "url", "fileurl", "filepath")
TITLES = ("Title", "title", "Name", "name", "FileName", "Description", "Desc")


def _is(kind: str) -> Column:
    return F.schema_of_variant("value").startswith(kind)


def json_links(payloads: DataFrame) -> DataFrame:
    """(doc, path, title, url): every object of a payload (doc, payload, base) that has an address, wherever it lies.

    An object's address is the first of its strings, by field name, that holds a slash and ends like a document or is named like an address; its
    title the first field of TITLES that says something, else empty. `path` names the fields and places that lead to the object. Payloads that are no JSON give
    nothing. Each level of nesting is one pass over what lies deeper, so depth is not bounded; a level is written once.
    """
    c = F.col
    level = payloads.select("doc", "base", F.lit("$").alias("path"), F.try_parse_json("payload").alias("v")).where("v is not null")
    found = None
    while True:
        fields = kept(level.lateralJoin(level.sparkSession.tvf.variant_explode(c("v").outer())).select("doc", "base", "path", "pos", "key", "value"), "fields")
        if fields.isEmpty():
            break
        text = F.when(_is("STRING"), F.try_variant_get("value", "$", "string"))
        low = F.lower(text)
        ends = F.regexp_extract(low, r"^[^?]*", 0).rlike("(" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")$")
        address = c("key").isNotNull() & F.contains(text, F.lit("/")) & (ends | F.lower("key").isin(*ADDRESSES))
        said = F.coalesce(text, F.to_json("value"))
        title = [F.max(F.when((c("key") == t) & ~said.isin("", "0", "false", "null", "[]", "{}"), said)).alias(f"t{i}") for i, t in enumerate(TITLES)]
        here = fields.where("key is not null").groupBy("doc", "base", "path").agg(F.min_by(F.when(address, text), F.when(address, c("key"))).alias("url"), *title).where("url is not null")
        here = here.select("doc", "path", F.coalesce(*[f"t{i}" for i in range(len(TITLES))], F.lit("")).alias("title"), absolute(c("url"), c("base")).alias("url"))
        found = here if found is None else found.unionByName(here)
        step = F.when(c("key").isNotNull(), F.concat(F.lit("."), c("key"))).otherwise(F.concat(F.lit("["), c("pos").cast("string"), F.lit("]")))
        level = fields.where(_is("OBJECT") | _is("ARRAY")).select("doc", "base", F.concat("path", step).alias("path"), c("value").alias("v"))
    return found if found is not None else payloads.select("doc", F.lit("$").alias("path"), F.lit("").alias("title"), F.col("base").alias("url")).where("false")
