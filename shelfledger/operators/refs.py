"""Dimension tables: codes in place of references, hierarchies, nested lists.

Dimension joins carry no broadcast hint: Spark broadcasts a side whose measured
size is below the threshold and shuffles the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TRADE_CATEGORIES, Settings
from ..sources.readers import Tables, cut_lineage
from .relational import hierarchy_root, latest_per_key


def decode(df: DataFrame, ref: str, dim: DataFrame, *columns: str, drop: bool = True,
           key: str = "ref", **renamed: str) -> DataFrame:
    """Left join a dimension on its reference; ``new=old`` renames a column."""
    d = dim.select(F.col(key).alias("_ref"), *columns,
                   *[F.col(old).alias(new) for new, old in renamed.items()])
    return df.join(d, df[ref] == d["_ref"], "left").drop("_ref", *([ref] if drop else []))


def ref_items(t: Tables) -> DataFrame:
    items = t["item_dim"]
    df = decode(items, "parent_ref", items, parent_item_id="item_id")
    df = decode(df, "price_group_ref", t["price_group_dim"], "price_group")
    df = decode(df, "group_ref", t["group_dim"], "group_id")
    df = decode(df, "unit_ref", t["unit_dim"], "width", "height", "depth", "weight", "volume")
    return df.select("item_id", "item_name", "price_group", "group_id", "pack_qty", "is_tva",
                     "item_marked", "parent_item_id", "width", "height", "depth", "weight",
                     "volume")


def item_root(t: Tables, materialize: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Item id and its topmost ancestor (``main_parent``)."""
    items = t["item_dim"]
    nodes = decode(items.select("item_id", "parent_ref"), "parent_ref", items,
                   parent_item_id="item_id")
    return hierarchy_root(nodes, "item_id", "parent_item_id", "main_parent", materialize).select(
        "item_id", "main_parent")


def ref_category(t: Tables, cfg: Settings) -> DataFrame:
    name = F.col("category_name")
    for code, new in cfg.category_names.items():
        name = F.when(F.col("category_id") == code, new).otherwise(name)
    return t["category_dim"].select("category_id", name.alias("category_name"), "is_marked")


def ref_group(t: Tables) -> DataFrame:
    groups = t["group_dim"]
    df = decode(groups, "parent_ref", groups, parent_group="group_id")
    df = decode(df, "category_ref", t["category_dim"], "category_id", "category_name")
    return df.select("group_marked", "group_id", "group_name", "parent_group",
                     "category_name", "category_id")


def ref_subdiv(t: Tables) -> DataFrame:
    subdivs = t["subdiv_dim"]
    df = decode(subdivs, "parent_ref", subdivs, parent="subdiv_id")
    return decode(df, "store_ref", t["store_dim"], "store_id").select(
        "subdiv_id", "subdiv_name", "parent", "store_id", "marked")


def ref_store(t: Tables) -> DataFrame:
    stores = t["store_dim"]
    address = t["address_dim"].filter(~F.col("marked") & F.col("is_main")).select(
        "owner_ref", "locality_ref", "region_ref", "lat", "long")
    address = decode(address, "locality_ref", t["locality_dim"], "locality_id")
    address = decode(address, "region_ref", t["region_dim"], "region_id")
    df = decode(stores, "distribution_ref", stores, distribution_store="store_id")
    df = decode(df, "parent_ref", stores, parent_id="store_id")
    df = decode(df, "subdiv_ref", t["subdiv_dim"], "subdiv_id")
    df = decode(df, "ref", address, "locality_id", "region_id", "lat", "long", key="owner_ref")
    return df.select("store_id", "parent_id", "marked", "distribution_store", "subdiv_id",
                     "locality_id", "region_id", "lat", "long", "store_name", "store_location")


def ref_area(t: Tables, cfg: Settings) -> DataFrame:
    df = t.unshift(t["area_register"].filter("active"), "date")
    df = decode(df, "subdiv_ref", t["subdiv_dim"], "subdiv_id")
    df = decode(df, "type_ref", t["area_type"], "enum_order")
    kind = F.lit(None).cast("string")
    for i, name in enumerate(cfg.area_types):
        kind = F.when(F.col("enum_order") == i, name).otherwise(kind)
    return df.select("date", "subdiv_id", kind.alias("type_area"), "area_value")


def ref_expense(t: Tables) -> DataFrame:
    items = t["expense_item"]
    return decode(items, "parent_ref", items, exp_items_parent="name").select(
        F.col("id").alias("exp_items_id"), F.col("name").alias("exp_items_name"),
        "exp_items_parent", F.col("marked").alias("exp_items_marked")).distinct()


def ref_route(t: Tables) -> DataFrame:
    """Routes with their regions as one array of structs; unknown regions stay in it as NULL."""
    routes = t["route_dim"]
    regions = decode(t["route_region"], "region_ref", t["region_dim"], "region_id")
    nested = regions.groupBy("route_ref").agg(
        F.array_sort(F.collect_set(F.struct("region_id"))).alias("regions"))
    df = decode(routes, "parent_ref", routes, route_parent="route_id")
    df = decode(df, "subdiv_ref", t["subdiv_dim"], "subdiv_id")
    none = F.array(F.struct(F.lit(None).cast("string").alias("region_id")))
    df = decode(df, "ref", nested, "regions", key="route_ref")
    return df.select("route_id", "route", "route_parent", "subdiv_id", "route_marked",
                     F.coalesce("regions", none).alias("regions"))


def ref_vehicle(t: Tables) -> DataFrame:
    df = decode(t["vehicle_dim"], "subdiv_ref", t["subdiv_dim"], "subdiv_id")
    return decode(df, "store_ref", t["store_dim"], "store_id").select(
        "auto_id", "auto_name", "marked", "subdiv_id", "store_id", "is_cargo",
        "load_capacity", "volume", "tank")


def subdiv_category(t: Tables, cfg: Settings) -> DataFrame:
    """Class of each unmarked subdivision out of the entity-attribute-value rows."""
    kinds = t["property_kind"].filter(F.col("code") == cfg.subdiv_property)
    values = (t["property_value"].join(
        kinds.select(F.col("ref").alias("property_ref")), "property_ref", "left_semi"))
    values = decode(values, "value_ref", t["property_name"], "name")
    return (t["subdiv_dim"].filter(~F.col("marked"))
            .join(values, F.col("ref") == F.col("object_ref"))
            .select("subdiv_id", F.col("name").alias("subdiv_category")))


def trade_stores(t: Tables, cfg: Settings) -> DataFrame:
    """Main warehouse of each trading subdivision except wholesale supermarkets."""
    kept = subdiv_category(t, cfg).filter(
        F.coalesce(F.col("subdiv_category") != cfg.supermarket_b2b, F.lit(True)))
    return kept.select("subdiv_id").join(
        ref_subdiv(t).select("subdiv_id", "store_id"), "subdiv_id", "left")


def satellite_stores(t: Tables, cfg: Settings) -> DataFrame:
    """Warehouses served by the satellite warehouse."""
    stores = t["store_dim"]
    df = decode(stores, "distribution_ref", stores, distribution_store="store_id")
    return df.filter((F.col("distribution_store") == cfg.satellite_store) & ~F.col("marked")
                     & (F.col("store_id") != cfg.satellite_store)).select("store_id", "store_name")


def shop_areas(areas: DataFrame) -> DataFrame:
    """Areas at each subdivision's latest date, one column per kind."""
    latest = latest_per_key(areas, ["subdiv_id"], "date")
    kinds = ("total_area", "trade_area", "b2b_area")
    wide = latest.groupBy("subdiv_id").pivot("type_area", list(kinds)).agg(F.max("area_value"))
    return wide.fillna(0.0, subset=list(kinds)).select(
        "subdiv_id", "total_area", "trade_area",
        (F.col("total_area") - F.col("b2b_area")).alias("effective_area"))


def store_class(subdivs: DataFrame, areas: DataFrame, categories: DataFrame,
                cfg: Settings) -> DataFrame:
    """Size class of each subdivision from its latest trade area and its type."""
    low, high = cfg.class_bounds
    trade = latest_per_key(areas, ["subdiv_id"], "date").filter(
        F.col("type_area") == "trade_area").select("subdiv_id", "area_value")
    area = F.col("area_value")
    mini, midi, maxi, largest = TRADE_CATEGORIES
    label = (F.when((area > high) & (F.col("subdiv_category") == cfg.supermarket_b2c), largest)
             .when(area >= high, maxi).when(area > low, midi).when(area <= low, mini))
    order = F.array_position(F.array(*map(F.lit, TRADE_CATEGORIES)), F.col("trade_category"))
    return (subdivs.select("subdiv_id").distinct()
            .join(trade, "subdiv_id", "left").join(categories, "subdiv_id", "left")
            .withColumn("trade_category", label)
            .withColumn("category_order", order.cast("int")))
