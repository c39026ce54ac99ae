"""Level-by-level expansion over captured documents."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.functions.text import squeeze, strip_tags, unescape_all, unnest
from shelf.functions.urls import same_site, site_root, url_path
from shelf.session import new_folder, written


class Bucketed:
    """Tables whose rows lie in files by the hash of a column, so that they join on it
    where they lie.  Their names are dropped at the end; files stay for what reads them."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.folder = new_folder(spark, "bucketed")
        self.names: dict[str, str] = {}

    def append(self, df: DataFrame, name: str, by: str) -> DataFrame:
        own = self.names.setdefault(name, f"{name}_{uuid.uuid4().hex}")
        df.write.mode("append").bucketBy(self.buckets, by).sortBy(by).option("path", f"{self.folder}/{name}").saveAsTable(own)
        return self.spark.table(own)

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *_) -> None:
        for own in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {own}")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reached from the seeds with their depth.  Goes on until nothing new is
    found, or for ``max_depth`` levels, so cycles end.

    Edges are dealt out once, by their source, and nodes by themselves as they are found.
    A level joins its frontier to the edges, and what that gives to all nodes seen, where they
    lie; only the nodes that the level finds are moved.  Of the nodes seen, a filter on
    the depth reads the files of one level.
    """
    spark = edges.sparkSession
    with Bucketed(spark, int(spark.conf.get("spark.sql.shuffle.partitions"))) as tables:
        links = tables.append(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"), "edges", "src")
        first = seeds.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0))
        seen = tables.append(first, "seen", "node")
        for depth in itertools.count(1):
            if max_depth is not None and depth > max_depth:
                break
            level = tables.append(found_from(links, seen, depth), "seen", "node")
            if level.where(F.col("depth") == depth).isEmpty():
                break
            seen = level
        return spark.read.schema(seen.schema).parquet(f"{tables.folder}/seen")


def found_from(links: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """The nodes behind the frontier, the level before ``depth``, that were not seen."""
    frontier = seen.where(F.col("depth") == depth - 1).select(F.col("node").alias("src"))
    found = frontier.join(links, "src").select(F.col("dst").alias("node")).distinct()
    return found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))


def sitemap_locs(body):
    """Addresses in ``<loc>`` elements, in document order, cleaned as any text is.
    Bodies with an entity other than that of the ampersand go through Arrow."""
    raw = F.regexp_extract_all(body, F.lit("(?is)<loc>(.*?)</loc>"), F.lit(1))
    rare = unescape_all(F.when(F.exists(raw, lambda u: u.rlike("&(?!amp;)[#A-Za-z]")), raw))
    plain = F.transform(raw, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.transform(F.coalesce(rare, plain), lambda u: squeeze(strip_tags(u)))


def robots_sitemaps(body):
    """``Sitemap:`` lines of a robots file."""
    lines = F.split(body, r"\r\n|\r|\n")
    found = F.transform(lines, lambda x: F.regexp_extract(x, r"(?i)^\s*Sitemap:\s*(\S+)\s*$", 1))
    return F.filter(found, lambda u: u != "")


def robots_seeds(robots: DataFrame, after: int = len(V.SITEMAP_FILES)) -> DataFrame:
    """Seeds for ``expand_sitemaps`` from captured robots files (site, listing_url,
    http_status, body): the files they name, in order, behind the usual places."""
    named = unnest(
        robots.where("http_status = 200"), robots_sitemaps(F.col("body")), "pos", "url", "site", "listing_url")
    return named.groupBy("site", "listing_url", "url").agg((F.min("pos") + after).alias("ord"))


def usual_seeds(sites: DataFrame) -> DataFrame:
    """Seeds for ``expand_sitemaps``: the places where a site (site, listing_url) has its
    sitemaps if it says nothing."""
    root = site_root(F.col("listing_url"))
    places = F.array(*[F.concat(root, F.lit(f"/{name}")) for name in V.SITEMAP_FILES])
    return sites.select("site", "listing_url", F.posexplode(places).alias("ord", "url"))


def is_sitemap(url):
    low = F.lower(url)
    return low.endswith(".xml") | F.contains(low, F.lit("sitemap"))


def is_site_product(site_url, url):
    """Same site, no feed, and a path that products live under."""
    path = F.lower(url_path(url))
    marked = F.lit(False)
    for marker in V.SITEMAP_PATHS:
        marked = marked | F.contains(path, F.lit(marker))
    return same_site(site_url, url) & ~F.contains(path, F.lit("/feed")) & marked


def expand_sitemaps(docs: DataFrame, seeds: DataFrame,
                    max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first pass from sitemap files to product addresses.

    ``docs``: url, http_status, body.  ``seeds``: site, listing_url, url, ord.
    Returns (products: site, url, ord) and (errors: site, ord, error).
    Neither documents nor the files seen are handed to all executors, as the driver would
    have to hold them all.  A site's files are numbered in the order they are found; all of them are opened,
    or with ``max_files`` at most so many.
    """
    order = Window.partitionBy("site").orderBy("ord", "pos")
    seen = written(
        seeds.groupBy("site", "listing_url", "url").agg(F.min("ord").alias("ord"))
        .withColumn("pos", F.lit(0))
        .withColumn("ord", F.row_number().over(order) - 1).drop("pos"), "files")
    level = seen
    products, errors = None, None
    while True:
        opened = level if max_files is None else level.where(F.col("ord") < max_files)
        pages = opened.join(docs.hint("merge"), "url", "left").withColumn(
            "locs", F.when(F.col("http_status") == 200, sitemap_locs(F.col("body"))))
        bad = pages.where(F.coalesce(F.size("locs"), F.lit(0)) <= 0).select(
            "site", "ord",
            F.when(F.col("http_status").isNull(), F.concat(F.lit("sitemap_error:"), "url"))
            .when(F.col("http_status") != 200,
                  F.concat(F.lit("sitemap_http_"), F.col("http_status").cast("string"), F.lit(":"), "url"))
            .otherwise(F.concat(F.lit("sitemap_no_locs:"), "url")).alias("error"))
        locs = written(
            unnest(pages, "locs", "pos", "loc", "site", "listing_url", "ord"), "locs")
        listed = locs.where(~is_sitemap(F.col("loc")) & is_site_product(F.col("listing_url"), F.col("loc")))
        listed = listed.select("site", F.col("loc").alias("url"), "ord", "pos")
        products = listed if products is None else products.unionByName(listed)
        errors = bad if errors is None else errors.unionByName(bad)
        files = (
            locs.where(is_sitemap(F.col("loc")))
            .groupBy("site", "listing_url", F.col("loc").alias("url"))
            .agg(F.min(F.struct("ord", "pos")).alias("at"))
            .select("site", "listing_url", "url", "at.ord", "at.pos")
            .join(seen.select("site", "url").hint("merge"), ["site", "url"], "left_anti"))
        known = seen.groupBy("site").agg(F.max("ord").alias("last"))
        files = files.withColumn("place", F.row_number().over(order))
        if max_files is not None:
            files = files.where(F.col("place") <= max_files)
        level = written(
            files.join(known, "site")
            .select("site", "listing_url", "url", (F.col("last") + F.col("place")).alias("ord")), "files")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    first = products.groupBy("site", "url").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return first.select("site", "url", "at.ord", "at.pos"), errors
