"""The catalog: brand, category, model and product, its search, statistics and upsert with change capture."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.change import is_meaningful_change
from ..functions.text import derive_sku, slug, taxonomy, truncate_value


def snowflake(products: DataFrame, models: DataFrame, categories: DataFrame, brands: DataFrame) -> DataFrame:
    """Products with their model, category and brand. The dimensions are joined first: they are the small side."""
    dims = models.join(categories, "category_id").join(brands, "brand_id")
    return products.join(dims, "model_id")


def search_products(
    catalog: DataFrame, query: str | None = None, brand: str | None = None, category: str | None = None, model: str | None = None,
    limit: int = 50, text_columns: tuple[str, ...] = ("title", "description", "sku"),
) -> DataFrame:
    if query:
        hits = [F.col(c).ilike(f"%{query}%") for c in text_columns if c in catalog.columns]
        catalog = catalog.where(reduce(Column.__or__, hits))
    for column, wanted in (("brand_slug", brand), ("category_slug", category), ("model_slug", model)):
        if wanted:
            catalog = catalog.where(F.col(column) == wanted)
    return catalog.orderBy(F.desc("updated_at"), "sku").limit(limit)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. An aggregate, not a window: hot keys are combined before they move."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, "_first.*")


def upsert_dimension(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], as_of: Column) -> DataFrame:
    """`stored` (keys, name, url, updated_at) after `incoming` (keys, name, url, + order): the first value of a batch wins,
    new keys are added, and name and url of known ones overwritten when different."""
    new = first_wins(incoming.select(*keys, "name", "url", *order), keys, order).select(*keys, F.col("name").alias("new_name"), F.col("url").alias("new_url"))
    both = stored.join(new, keys, "full_outer")
    here = F.col("new_name").isNotNull() | F.col("new_url").isNotNull()
    changed = here & ~(F.col("name").eqNullSafe(F.col("new_name")) & F.col("url").eqNullSafe(F.col("new_url")))
    return both.select(
        *keys,
        F.when(here, F.col("new_name")).otherwise(F.col("name")).alias("name"),
        F.when(here, F.col("new_url")).otherwise(F.col("url")).alias("url"),
        F.when(changed, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )


@dataclass(frozen=True)
class ItemBatch:
    brands: DataFrame
    categories: DataFrame
    models: DataFrame
    products: DataFrame


def item_batch(items: DataFrame, order: list[str], path: str | None = None) -> ItemBatch:
    """Collected items (url, sku, title, description, price, stock_status, category_path, label, brand + order) as what the
    dimension and product upserts take. Ids are hashes of natural keys, so they need no lookup; of items with the same
    derived sku the first counts; with a new folder `path` these are written there, and items are read once for all four."""
    first = first_wins(items.withColumn("sku", derive_sku(F.col("sku"), F.col("url"))), ["sku"], order)
    if path:
        first.write.parquet(path)
        first = first.sparkSession.read.schema(first.schema).parquet(path)
    # names and slugs are worked out for the rows that count, not for every item
    rows = first.withColumn("_t", taxonomy(F.col("category_path"), F.col("label"), F.col("brand")))
    rows = rows.withColumns({f"{k}_slug": slug(F.col(f"_t.{k}")) for k in ("brand", "category", "model")})
    levels = {"brand": ["brand_slug"], "category": ["brand_slug", "category_slug"], "model": ["brand_slug", "category_slug", "model_slug"]}
    rows = rows.withColumns({f"{k}_id": F.xxhash64(*slugs) for k, slugs in levels.items()})

    def dimension(name: str, parent: list[str]) -> DataFrame:
        named = rows.select(*parent, F.col(f"{name}_slug").alias("slug"), F.col(f"_t.{name}").alias("name"), F.concat(F.lit("/"), F.array_join(F.array(*levels[name]), "/")).alias("url"), *order)
        return first_wins(named, [*parent, "slug"], order)

    products = rows.select("sku", F.col("url").alias("product_url"), "model_id", "title", "description", "price", "stock_status", *order)
    return ItemBatch(dimension("brand", []), dimension("category", ["brand_id"]), dimension("model", ["category_id"]), products)


@dataclass(frozen=True)
class Upsert:
    products: DataFrame
    prices: DataFrame
    changes: DataFrame
    baselines: DataFrame
    rejected: DataFrame
    summary: DataFrame


STORED_PRODUCTS = "sku string, product_url string, model_id long, title string, description string, price double, stock_status string, created_at timestamp_ntz, updated_at timestamp_ntz"
PRODUCT_ATTRIBUTES = ["title", "description", "price", "stock_status"]


def upsert_products(stored: DataFrame, incoming: DataFrame, as_of: Column, order: list[str] | None = None, owners: DataFrame | None = None) -> Upsert:
    """A batch of products by sku against the stored ones.

    stored, incoming: sku, product_url, model_id, title, description, price, stock_status; stored also created_at and
    updated_at, incoming the `order` columns. All six results come from one join of the two on sku. Of repeated skus in
    a batch the first counts; a new sku whose product_url another sku has is rejected. An existing product keeps its model
    and URL. Prices are logged when they differ and are not null, stock when it differs beyond case and space and is not
    blank, descriptions when they differ and are not blank. `stored` may be the part of the catalog that has the batch's skus,
    if `owners` (product_url) then names the URLs taken by any.
    """
    order = order or ["ordinal"]
    batch = first_wins(incoming, ["sku"], order)
    attributes = F.struct("product_url", "model_id", *PRODUCT_ATTRIBUTES)
    old = stored.select("sku", attributes.alias("old"), "created_at", "updated_at")
    named = [c for c in ("brand", "category", "model") if c in incoming.columns]  # told in the summary only
    both = old.join(batch.select("sku", attributes.alias("new"), *order, *named), "sku", "full_outer")
    fresh = both.where("old is null")
    urls = (stored if owners is None else owners).select(F.col("product_url").alias("url"))
    taken = fresh.join(urls, F.col("new.product_url") == F.col("url"), "left_semi").select("sku")
    repeated = fresh.groupBy(F.col("new.product_url").alias("url")).agg(F.min_by("sku", F.struct(*order, "sku")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = fresh.join(repeated, F.col("new.product_url") == F.col("url")).where("sku <> first").select("sku")
    rejected = taken.union(later).distinct()
    both = both.join(rejected, "sku", "left_anti")

    is_new, seen = F.col("old").isNull(), F.col("new").isNotNull()
    value = lambda c: F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    products = both.select(
        "sku", F.coalesce("old.product_url", "new.product_url").alias("product_url"), F.coalesce("old.model_id", "new.model_id").alias("model_id"),
        *[value(c) for c in PRODUCT_ATTRIBUTES],
        F.when(is_new, as_of).otherwise(F.col("created_at")).alias("created_at"), F.when(seen, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    touched = both.where(seen)
    priced = touched.where(F.col("new.price").isNotNull() & (is_new | ~F.col("new.price").eqNullSafe(F.col("old.price"))))
    prices = priced.select("sku", F.col("new.price").alias("price"), F.col("new.stock_status").alias("stock_status"), as_of.alias("recorded_at"))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    events = [
        ("new", is_new, F.lit(None).cast("string"), F.coalesce(F.nullif(F.col("new.title"), F.lit("")), F.col("sku"))),
        ("stock", ~is_new & (text("new.stock_status") != "") & (F.lower(text("old.stock_status")) != F.lower(text("new.stock_status"))),
         F.coalesce("old.stock_status", F.lit("")), F.col("new.stock_status")),
        ("description", ~is_new & (text("new.description") != "") & (text("old.description") != text("new.description")),
         F.coalesce("old.description", F.lit("")), F.col("new.description")),
    ]
    candidates = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("change_type"), o.alias("old_value"), n.alias("new_value"))) for k, c, o, n in events]), lambda x: x.isNotNull())
    logged = touched.select("sku", F.explode(candidates).alias("e")).select("sku", "e.*")
    logged = logged.where(is_meaningful_change(F.col("change_type"), F.col("old_value"), F.col("new_value")))
    changes = logged.select("sku", "change_type", truncate_value(F.col("old_value")).alias("old_value"), truncate_value(F.col("new_value")).alias("new_value"), as_of.alias("changed_at"))
    baselines = touched.where(is_new).select("sku", as_of.alias("captured_at"), F.struct(*[F.col(f"new.{c}") for c in ("title", "description", "price", "stock_status", "model_id")]).alias("snapshot"))
    summary = touched.agg(
        F.count("*").alias("saved"), F.count_if(is_new).alias("new"), F.count_if(~is_new).alias("updated"),
        F.countDistinct("new.model_id").alias("models"), F.max_by("sku", F.struct(*order)).alias("last_sku"),
        *[F.countDistinct(c).alias(f"distinct_{c}") for c in named], *[F.max_by(c, F.struct(*order)).alias(f"last_{c}") for c in named],
    ).crossJoin(rejected.agg(F.count("*").alias("errors")))
    return Upsert(products, prices, changes, baselines, rejected, summary)
