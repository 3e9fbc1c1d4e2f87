"""Repairs of the dictionary: responses rebuilt, missing rows added, keyed patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import jsons
from folioscope.operators.model import next_ids
from folioscope.operators.quality import is_empty

PARTS = {"shades_of_meaning": jsons.SHADES, "hadith_examples": jsons.QUOTES, "classical_sources": jsons.QUOTES, "idioms_customs": jsons.QUOTES, "word_by_word_shades": jsons.SHADES}


def built_response() -> Column:
    """A JSON object of the meaning and five lists; empty or invalid lists are []."""
    lists = [jsons.array_or_empty(F.col(c), schema).alias(c) for c, schema in PARTS.items()]
    return F.to_json(F.struct(F.coalesce("general_meaning", F.lit("")).alias("general_meaning"), *lists), {"ignoreNullFields": "false"})


def has_data() -> Column:
    out = ~is_empty(F.col("general_meaning"))
    for c, schema in PARTS.items():
        out = out | (F.size(jsons.array_or_empty(F.col(c), schema)) > 0)
    return out


def backfill(meanings: DataFrame) -> DataFrame:
    """Responses rebuilt where empty or invalid and there is data; ``outcome`` is valid, updated or skipped."""
    needs = is_empty(F.col("full_response")) | (jsons.kind(F.col("full_response")) == "invalid")
    outcome = F.when(~needs, "valid").when(has_data(), "updated").otherwise("skipped")
    return meanings.withColumn("outcome", outcome).withColumn("full_response", F.when(F.col("outcome") == "updated", built_response()).otherwise(F.col("full_response")))


def counters(backfilled: DataFrame) -> DataFrame:
    return backfilled.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("updated", "skipped", "valid")])


def add_missing(meanings: DataFrame, new_rows: DataFrame, key: str = "root", constants: dict[str, str] | None = None) -> DataFrame:
    """Rows whose key isn't there yet, with ids after the largest in order of the key, appended."""
    fresh = new_rows.join(meanings.select(key), key, "left_anti")
    fresh = fresh.withColumns({c: F.lit(v) for c, v in (constants or {}).items()}) if constants else fresh
    numbered = next_ids(fresh.drop("id"), meanings, "id", key).withColumn("id", F.col("id").cast(meanings.schema["id"].dataType))
    return meanings.unionByName(numbered, allowMissingColumns=True)


def patch(rows: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Patched values where all keys match and the patch has one; Spark broadcasts the patches where it sees that they are few."""
    values = [c for c in patches.columns if c not in keys]
    fixed = patches.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_hit"))
    joined = rows.join(fixed, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns], F.coalesce("_hit", F.lit(False)).alias("patched"))


def patch_and_rebuild(meanings: DataFrame, patches: DataFrame, keys: tuple[str, ...] = ("id", "root")) -> DataFrame:
    """Patched rows get a new response."""
    done = patch(meanings, patches, list(keys))
    return done.withColumn("full_response", F.when(F.col("patched"), built_response()).otherwise(F.col("full_response")))


def anything(patched: DataFrame) -> bool:
    """Whether there is something to write."""
    return patched.filter("patched").limit(1).count() > 0


def run(meanings: DataFrame, new_rows: DataFrame, backfill_responses: bool = False, insert_missing: bool = False) -> DataFrame:
    """One or both repairs, the missing rows first."""
    out = add_missing(meanings, new_rows) if insert_missing else meanings
    return backfill(out).drop("outcome") if backfill_responses else out
