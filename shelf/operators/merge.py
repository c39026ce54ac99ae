"""Favourites: validation, last-write-wins merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions.text import blank

# --- favourites documents ---------------------------------------------------------


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _is_finite(value: Column) -> Column:
    number = F.schema_of_variant(value).rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)")
    size = F.abs(F.try_variant_get(value, "$", "double"))
    return number & F.coalesce(size < F.lit(float("inf")), F.lit(False))


def _units(text: Column) -> Column:
    """Length in 16-bit units, of which characters beyond the first plane have two."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def _is_json(body: Column) -> Column:
    """One value and nothing behind it: it has to be one element of a list and one member
    of an object alike."""
    one = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    member = F.get_json_object(F.concat(F.lit('{"d":'), body, F.lit(',"e":0}')), "$.e") == "0"
    return F.coalesce(one & member, F.lit(False))


def reject_reason(code: Column, body: Column, max_chars: int = V.MAX_BODY_CHARS) -> Column:
    """Why a favourites document is refused; NULL if it is good.  ``max_chars`` counts
    16-bit units, as the service that stores the documents does.

    Of a repeated key the last value counts, for which the session's parser of variants
    is told to keep it."""
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    doc = F.try_parse_json(blank(body))
    items = F.try_variant_get(doc, "$.items", "map<string,variant>")
    graves = F.try_variant_get(doc, "$.tombstones", "variant")
    grave_values = F.map_values(F.try_variant_get(doc, "$.tombstones", "map<string,variant>"))
    good = F.forall(F.map_values(items), _is_object) & (
        graves.isNull() | (_is_object(graves) & F.forall(grave_values, _is_finite)))
    return (
        F.when(~F.coalesce(code.rlike(V.CODE_PATTERN), F.lit(False)), "bad_code")
        .when(_units(blank(body)) > max_chars, "too_large")
        .when(doc.isNull() | ~_is_json(blank(body)), "bad_json")
        .when(~F.coalesce(good, F.lit(False)), "bad_shape")
    )


def favourite_changes(docs: DataFrame) -> DataFrame:
    """Documents (code, items, tombstones) as a change log, one row per key and fact."""
    kept = docs.select("code", F.explode("items").alias("key", "value")).select(
        "code", "key", F.get_json_object("value", "$.ts").cast("double").alias("ts"),
        F.lit(False).alias("deleted"), "value")
    gone = docs.select("code", F.explode("tombstones").alias("key", "ts")).select(
        "code", "key", "ts", F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("value"))
    return kept.unionByName(gone)


def last_write(changes: DataFrame, keys: Sequence[str], order: Sequence[str],
               deleted: str = "deleted") -> DataFrame:
    """Latest change per key, keys whose latest change is a deletion left out.

    ``order`` ranks changes; put ``deleted`` into it to settle ties for deletion.
    """
    rest = [c for c in changes.columns if c not in keys]
    latest = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return latest.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).where(~F.col(deleted))


def micros(ts: Column | str) -> Column:
    """Microseconds of a time without zone, the same in every session zone."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts)
    return F.unix_micros(local.cast("timestamp"))
