"""Price comparison against an outside sheet, by keys of falling strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_of_normal_title, let, normal_title


def lookup_keys(title: Column, site: Column, url: Column) -> Column:
    """array<struct(priority, key)>: url, site and title, title, site and model, normal title, model. Empty parts give no key."""
    t, s, u = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (title, site, url))
    named = F.struct(t.alias("t"), s.alias("s"), u.alias("u"), normal_title(title).alias("norm"))
    return let(named, lambda x: let(key_of_normal_title(x["norm"]), lambda model: _keys(x["t"], x["s"], x["u"], x["norm"], model)))


def _keys(t: Column, s: Column, u: Column, norm: Column, model: Column) -> Column:
    parts = [
        (F.lit("url:"), u, u), (F.concat(F.lit("site:"), s, F.lit(":")), t, F.least(s, t)), (F.lit("title:"), t, t),
        (F.concat(F.lit("site-model:"), s, F.lit(":")), model, F.least(s, model)), (F.lit("norm:"), norm, norm), (F.lit("model:"), model, model),
    ]
    keys = [F.when(needed != "", F.struct(F.lit(i).alias("priority"), F.concat(prefix, value).alias("key"))) for i, (prefix, value, needed) in enumerate(parts)]
    return F.filter(F.array(*keys), lambda x: x.isNotNull())


def price_list(sheet: DataFrame) -> DataFrame:
    """(key, price): what each key of the sheet (title, site, url, price, ordinal) says; the last row wins."""
    keyed = sheet.where("price is not null").select("ordinal", "price", F.explode(lookup_keys(F.col("title"), F.col("site"), F.col("url"))).alias("k"))
    return keyed.groupBy("k.key").agg(F.max_by("price", "ordinal").alias("cmp_price"))


def with_compare_price(rows: DataFrame, sheet: DataFrame) -> DataFrame:
    """`rows` (title, site, url) with `cmp_price`: the first key that the sheet has.

    Keys are made once per distinct title, site and URL; the six lookups are one equi-join on the key, whose hits are
    reduced by priority, and one join brings the price back to the rows.
    """
    said = {f"_{c}": F.coalesce(c, F.lit("")) for c in ("title", "site", "url")}
    rows = rows.withColumns(said)
    asked = rows.select(*said).distinct()
    keyed = asked.select(*said, F.explode(lookup_keys(F.col("_title"), F.col("_site"), F.col("_url"))).alias("k")).select(*said, "k.priority", "k.key")
    best = keyed.join(price_list(sheet), "key").groupBy(*said).agg(F.min_by("cmp_price", "priority").alias("cmp_price"))
    return rows.join(best, list(said), "left").drop(*said)
