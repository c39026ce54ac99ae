"""Shop configuration, snapshots, diary and favourites as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf import schemas
from shelf.functions.localised import localised
from shelf.functions.text import blank, filled, unnest


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of shops.  A file that is no list fails while reading."""
    return parse_config(spark.read.option("wholetext", True).text(path))


def parse_config(documents: DataFrame) -> DataFrame:
    """Shops of JSON lists held in ``value``."""
    checked = documents.select(
        F.when(F.ltrim("value").startswith("["), F.col("value"))
        .otherwise(F.raise_error(F.lit("the shop list has to be a JSON list"))).alias("value"))
    rows = checked.select(F.inline(F.from_json(
        "value", "array<struct<" + _with_colons(schemas.CONFIG) + ">>")))
    return shops(rows)


def _with_colons(ddl: str) -> str:
    """Top-level 'name TYPE' pairs as 'name: TYPE'."""
    depth, out, name = 0, [], True
    for char in ddl:
        depth += (char == "<") - (char == ">")
        if char == " " and depth == 0 and name and out and out[-1] not in ", ":
            out.append(":")
            name = False
        if char == "," and depth == 0:
            name = True
        out.append(char)
    return "".join(out)


def shops(config: DataFrame) -> DataFrame:
    """Defaults and trims; ``listing_url`` is the override or the address."""
    trimmed = {c: filled(F.trim(F.col(c))) for c in (
        "url", "collection_url_override", "shopify_collection_handle", "price_variant_filter")}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("force_html_listing", "force_woo_api")}
    return config.withColumns(trimmed | flags).select(
        F.coalesce("name", F.lit("Unknown")).alias("roaster"),
        F.coalesce("collection_url_override", "url").alias("listing_url"),
        "shopify_collection_handle", "price_variant_filter", "force_html_listing", "force_woo_api",
        F.col("field_rules.skip_sources").alias("skip_sources"),
        F.col("field_rules.tag_aliases").alias("tag_aliases"))


def error_item(error: Column, source_url: Column | None = None,
               product_url: Column | None = None, roaster: str = "roaster") -> list[Column]:
    """The columns of an error record."""
    given = {"roaster": F.col(roaster), "status": F.lit("error"), "error": error,
             "source_url": source_url, "product_url": product_url}
    return [
        (blank(given[c]) if given.get(c) is not None else F.lit("")).alias(c)
        for c in schemas.ITEM_COLUMNS
    ]


def shops_without_address(config: DataFrame) -> DataFrame:
    return config.where("listing_url IS NULL").select(*error_item(F.lit("missing_url")))


def read_snapshots(spark: SparkSession, glob: str) -> DataFrame:
    """Snapshot files as rows: file name, position, item members.

    Files are ordered by name, which carries their time.  An unreadable file
    gives one row without an item.
    """
    raw = spark.read.schema(schemas.SNAPSHOT).option("multiLine", True).json(glob)
    rows = raw.select(
        F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("snapshot"),
        "generated_at", F.posexplode_outer("items").alias("ord", "item"))
    return rows.select("snapshot", "generated_at", "ord", "item.*")


def written_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots in the folders that ``files.write_snapshot`` makes.  A filter on
    ``snapshot`` reads only the folders it names."""
    return spark.read.option("basePath", f"{folder}/items").parquet(f"{folder}/items").withColumns(
        {c: F.col(c).cast("string") for c in ("snapshot", "bucket")})


def read_diary(spark: SparkSession, path: str) -> DataFrame:
    """Entries with their order in the file; a localised value may be a plain string."""
    return diary_entries(spark.read.option("wholetext", True).text(path))


_LOCALISED = ("bean_name", "roaster", "story", "summary")


def diary_entries(documents: DataFrame) -> DataFrame:
    """``value`` holds whole diary documents, entries in a list.  Bilingual members
    are read as VARIANT, whose kind says which form of them it is."""
    loose = schemas.DIARY_ENTRY.replace("MAP<STRING, STRING>", "VARIANT")
    parsed = F.from_json("value", f"struct<entries: array<struct<{_with_colons(loose)}>>>")
    rows = unnest(documents, parsed["entries"], "ord", "e").select("ord", "e.*")
    rows = rows.withColumns({c: localised(F.col(c)) for c in _LOCALISED})
    return rows.withColumns({
        "tags": F.transform("tags", localised),
        "flavours": F.transform("flavours", lambda f: F.struct(
            f.icon.alias("icon"), localised(f.label).alias("label"))),
        "brew": F.struct(localised(F.col("brew.method")).alias("method")),
        "details": F.when(F.col("details").isNotNull(), F.struct(
            F.col("details.producer").alias("producer"), F.col("details.farm").alias("farm"),
            localised(F.col("details.region")).alias("region"),
            F.col("details.altitude").alias("altitude"),
            localised(F.col("details.varietal")).alias("varietal"),
            localised(F.col("details.process")).alias("process"),
            localised(F.col("details.notes")).alias("notes"),
            F.col("details.flag").alias("flag"), F.col("details.map_url").alias("map_url"))),
    })


def favourites(docs: DataFrame, code: str = "code", body: str = "body") -> DataFrame:
    """Favourites documents as maps; a missing document is an empty one."""
    parsed = F.from_json(body, "struct<" + _with_colons(schemas.FAVOURITES) + ">")
    none = F.create_map().cast("map<string,string>")
    return docs.select(code, parsed.alias("d")).select(
        code,
        F.coalesce("d.items", none).alias("items"),
        F.coalesce("d.tombstones", none.cast("map<string,double>")).alias("tombstones"),
        F.coalesce("d.updated_at", F.lit(0)).cast("long").alias("updated_at"))
