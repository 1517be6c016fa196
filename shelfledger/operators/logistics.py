"""Stock motion shares, warehouse cost, truck cost per kilometre, transport cost."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.periods import minutes_between, month_floor
from ..functions.semantics import (bankers_round, in_local, not_in_local, r_sum,
                                   safe_div, sorted_texts)
from ..sources.readers import Tables
from .expenses import fuel_months, maintenance_mean
from .refs import decode, ref_route, ref_subdiv, ref_vehicle
from .relational import join_hot, join_null_safe, latest_per_key, pick_other_row, share_of, union_by_name

# ---- stock motion ---------------------------------------------------------------------------


def _wanted_stores(t: Tables, stores: DataFrame) -> DataFrame:
    return (t["store_dim"].join(stores.select("store_id").distinct(), "store_id", "left_semi")
            .select(F.col("ref").alias("store_ref"), "store_id"))


def _trade_movement(t: Tables, stores: DataFrame, start: date, finish: date, non_trade: DataFrame) -> DataFrame:
    """Movements of the given warehouses; non-trade items go by reference, an unknown item stays."""
    left_out = t["item_dim"].join(non_trade.select("item_id"), "item_id", "left_semi").select(
        F.col("ref").alias("item_ref"))
    return (t.register("stock_movement", "date_movement", start, finish, ["active"])
            .join(_wanted_stores(t, stores), "store_ref").join(left_out, "item_ref", "left_anti"))


def documents(t: Tables) -> DataFrame:
    """What a recorder reference may point to, one row per reference: sale, transfer or check report.

    Buyers and receivers are decoded here, on the documents, so movements need only this
    one table. Should one reference stand in two tables of documents, its row holds both.
    """
    sale = decode(t.unshift(t["sale_doc"], "sale_doc_date").select(
        "ref", F.col("sale_doc_nmbr").alias("nmbr_sale_doc"), F.col("sale_doc_date").alias("date_sale_doc"), "subdiv_ref"),
        "subdiv_ref", t["subdiv_dim"], "subdiv_id")
    moved = decode(t.unshift(t["transfer_out"], "date").select(
        "ref", F.col("nmbr").alias("nmbr_moving_out"), F.col("date").alias("date_moving_out"), "receiver_store_ref"),
        "receiver_store_ref", t["store_dim"], store_receiver="store_id")
    checks = t.unshift(t["check_report"], "date").select(
        "ref", "nmbr_checks_report", F.col("date").alias("date_checks_report"))
    df = union_by_name(sale, moved, checks)
    return df.groupBy("ref").agg(*[F.first(c, ignorenulls=True).alias(c) for c in df.columns if c != "ref"])


def stock_motion(t: Tables, stores: DataFrame, start: date, finish: date,
                 non_trade: DataFrame) -> DataFrame:
    """Listing of the movements of the given warehouses with the document each one came from."""
    df = decode(_trade_movement(t, stores, start, finish, non_trade), "item_ref", t["item_dim"], "item_id")
    df = df.select("date_movement", "store_id", "type_motion", "recorder_ref", "item_id", "item_motion_qty")
    df = join_hot(df, documents(t).withColumnRenamed("ref", "recorder_ref"), "recorder_ref")
    return df.select("date_movement", "store_id", "type_motion", "nmbr_sale_doc", "date_sale_doc",
                     "subdiv_id", "nmbr_moving_out", "date_moving_out", "store_receiver",
                     "nmbr_checks_report", "date_checks_report", "item_id", "item_motion_qty")


def motion_units(t: Tables, stores: DataFrame, start: date, finish: date,
                 non_trade: DataFrame) -> DataFrame:
    """Units per warehouse, direction, kind of document, buyer and receiver.

    Movements shrink to one row per warehouse, direction and recorder before they meet
    the documents. A group with an unknown quantity has unknown units.
    """
    raw = (_trade_movement(t, stores, start, finish, non_trade)
           .groupBy("store_id", "type_motion", "recorder_ref")
           .agg(F.sum("item_motion_qty").alias("u"), F.count("item_motion_qty").alias("known"),
                F.count(F.lit(1)).alias("n")))
    kinds = [F.col(c).isNotNull().alias(k) for k, c in (("by_sale", "nmbr_sale_doc"), ("by_transfer", "nmbr_moving_out"), ("by_check", "nmbr_checks_report"))]
    docs = documents(t).select(F.col("ref").alias("recorder_ref"), "subdiv_id", "store_receiver", *kinds)
    df = raw.join(docs, "recorder_ref", "left").fillna(False, ["by_sale", "by_transfer", "by_check"])
    sums = [F.sum(c).alias(c) for c in ("u", "known", "n")]
    return (df.groupBy("store_id", "type_motion", "subdiv_id", "store_receiver", "by_sale", "by_transfer", "by_check")
            .agg(*sums).withColumn("units", F.when(F.col("known") == F.col("n"), F.col("u"))).drop("u", "known", "n"))


def _store_subdiv(t: Tables) -> DataFrame:
    return decode(t["store_dim"].select("store_id", "subdiv_ref"), "subdiv_ref", t["subdiv_dim"],
                  store_subdiv="subdiv_id")


def shipment_share(units: DataFrame, stores: DataFrame, t: Tables) -> DataFrame:
    """Retail and service share of the units each trading store sends out."""
    out = units.filter((F.col("type_motion") == 1) & (F.col("by_sale") | F.col("by_check"))).join(
        stores.select("store_id").distinct(), "store_id", "left_semi")
    kind = F.when(F.col("by_sale"), "service").otherwise("retail")
    main = ref_subdiv(t).select("subdiv_id", F.col("store_id").alias("subdiv_store"))
    units = (out.withColumn("type_subdiv", kind).join(main, "subdiv_id", "left")
             .filter(F.col("subdiv_id").isNull() | (F.col("store_id") == F.col("subdiv_store")))
             .drop("subdiv_id").join(_store_subdiv(t), "store_id", "left")
             .groupBy(F.col("store_subdiv").alias("subdiv_id"), "type_subdiv")
             .agg(r_sum(F.col("units")).alias("total_type_units")))
    return share_of(units, ["subdiv_id"], "total_type_units", "avr_subdiv_share", 3).drop(
        "total_type_units")


def _warehouse_out(units: DataFrame, store_id: str) -> DataFrame:
    """What a distribution warehouse sent out by transfer or sale document."""
    return units.filter((F.col("store_id") == store_id) & (F.col("type_motion") == 1)
                        & (F.col("by_transfer") | F.col("by_sale")))


def satellite_share(units: DataFrame, t: Tables, satellites: DataFrame, cfg: Settings) -> DataFrame:
    """Share of each retail receiver in the satellite warehouse's outflow."""
    pre = _warehouse_out(units, cfg.satellite_store)
    stores = satellites.select("store_id").distinct()
    subdivs = (ref_subdiv(t).filter(~F.col("marked")).join(stores, "store_id", "left_semi")
               .select("subdiv_id", F.lit(True).alias("ok_subdiv")).distinct())
    known = stores.select(F.col("store_id").alias("store_receiver"), F.lit(True).alias("ok_store"))
    df = (pre.join(subdivs, "subdiv_id", "left").join(known, "store_receiver", "left")
          .filter((F.col("subdiv_id").isNull() | F.col("ok_subdiv"))
                  & (F.col("store_receiver").isNull() | F.col("ok_store"))))
    df = df.join(_store_subdiv(t).withColumnRenamed("store_id", "store_receiver"),
                 "store_receiver", "left")
    sums = df.groupBy(
        F.coalesce("subdiv_id", "store_subdiv").alias("receiver"),
        F.when(F.col("subdiv_id").isNotNull(), "service").otherwise("retail").alias("type")
    ).agg(r_sum(F.col("units")).alias("total_units"))
    return (share_of(sums, [], "total_units", "satellite_subdiv_share", 3)
            .filter(F.col("type") == "retail")
            .select(F.col("receiver").alias("subdiv_id"), "satellite_subdiv_share"))


def main_share(units: DataFrame, t: Tables, satellite: DataFrame, super_share: DataFrame,
               trade: DataFrame, cfg: Settings) -> DataFrame:
    """Main warehouse share per store, the satellite's part spread over its stores."""
    pre = _warehouse_out(units, cfg.main_store)
    df = pre.join(_store_subdiv(t).withColumnRenamed("store_id", "store_receiver"),
                  "store_receiver", "left")
    to = F.col("store_subdiv")
    for store, subdiv in cfg.accumulator_subdivs.items():
        to = F.when(F.col("store_receiver") == store, subdiv).otherwise(to)
    df = df.withColumn("receiver", F.coalesce(F.col("subdiv_id"), to)).withColumn(
        "type", F.when(F.col("subdiv_id").isNotNull(), "service").otherwise("retail"))
    wanted = trade.select(F.col("subdiv_id").alias("receiver"), F.lit(True).alias("_trade")).distinct()
    sums = (df.join(wanted, "receiver", "left")
            .filter(F.col("_trade") | (F.col("receiver") == cfg.satellite_subdiv))
            .groupBy("receiver", "type").agg(r_sum(F.col("units")).alias("total_units")))
    share = (share_of(sums, [], "total_units", "subdiv_share", 3).filter(F.col("type") == "retail")
             .select(F.col("receiver").alias("subdiv_id"), "subdiv_share"))
    share = pick_other_row(share, F.col("subdiv_id") == cfg.satellite_subdiv, "subdiv_share", "_sat")
    spread = F.when(F.col("satellite_subdiv_share").isNotNull(),
                    F.col("subdiv_share") + F.col("satellite_subdiv_share") * F.col("_sat")
                    ).otherwise(F.col("subdiv_share"))
    return (share.join(satellite, "subdiv_id", "left").withColumn("subdiv_share", spread)
            .filter(F.col("subdiv_id") != cfg.satellite_subdiv)
            .join(super_share, "subdiv_id", "left")
            .select("subdiv_id",
                    (F.col("subdiv_share") * F.coalesce("avr_subdiv_share", F.lit(1.0))).alias("avr_share")))


def warehouse_cost(costs: DataFrame, driver_pay: DataFrame, main: DataFrame, satellite: DataFrame,
                   cfg: Settings) -> DataFrame:
    """Cost of the two warehouses spread over the stores, the satellite's drivers left out."""
    parts = ("avr_total_exp_sum", "avr_salary_sum", "avr_rent_sum", "utilities_exp_sum")
    whole = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in parts), F.lit(0.0))
    total = lambda subdiv: F.coalesce(
        F.sum(F.when(F.col("subdiv_id") == subdiv, whole)), F.lit(0.0))
    sums = costs.agg(total(cfg.main_store_subdiv).alias("_main"),
                     total(cfg.satellite_subdiv).alias("_sat"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (main.join(satellite, "subdiv_id", "left")
            .crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(driver_pay))  # one row each
            .select("subdiv_id",
                    (zero(F.col("avr_share") * F.col("_main"))
                     + zero(F.col("satellite_subdiv_share") * (F.col("_sat") - F.col("driver_pay")))
                     ).alias("distr_stores_cost")))


# ---- delivery -------------------------------------------------------------------------------


def _trips(t: Tables, start: date, finish: date) -> DataFrame:
    """Posted trips by departure with their codes."""
    df = t.unshift(t.register("trip", "time_depart", start, finish, ["posted"]),
                   "date_delivery", "time_return").withColumnRenamed("ref", "trip_ref").drop("posted")
    df = decode(df, "store_ref", t["store_dim"], "store_id", "store_name")
    df = decode(df, "direction_ref", t["direction_dim"], "direction")
    df = decode(df, "route_ref", t["route_dim"], "route_id", "route")
    return decode(df, "vehicle_ref", t["vehicle_dim"], vehicle_id="auto_id", vehicle_name="auto_name")


def _people(t: Tables, trips: DataFrame) -> DataFrame:
    for role in ("forwarder", "driver"):
        p = decode(t[f"trip_{role}"], "individ_ref", t["individual_dim"], **{role: "individ_id"})
        trips = trips.join(p.select("trip_ref", role), "trip_ref", "left")
    return trips


def _with_stops(t: Tables, trips: DataFrame, start: date, finish: date) -> DataFrame:
    """Trips with the orders they carry.

    The trips meet their orders first: their window then cuts the lines of all trips, which
    the orders, joined by a key of another table, could do only after a shuffle.
    """
    orders = t.register("delivery_order", "date_deliv_order", start - timedelta(weeks=2), finish,
                        ["posted"])
    df = decode(trips.join(t["trip_order"], "trip_ref", "left"), "order_ref", orders,
                "nmbr_deliv_order", "date_deliv_order", drop=False)
    notes = t.unshift(t["luggage_note"], "date")
    return decode(df, "order_ref", notes, nmbr_luggage="nmbr", date_luggage="date")


def delivery_rows(t: Tables, start: date, finish: date) -> DataFrame:
    """Trips with drivers, forwarders and the orders carried."""
    return _with_stops(t, _people(t, _trips(t, start, finish)), start, finish).drop("trip_ref")


def delivery_clean(rows: DataFrame, cfg: Settings) -> DataFrame:
    """Delivered trips with readable speedometers, the return time repaired.

    A return in an earlier year is moved by whole years, unless its year is that of a
    time never set; a return on an earlier day of the month is moved by the difference
    of the day numbers.
    """
    dep, ret = F.col("time_depart"), F.col("time_return")
    years = F.make_ym_interval(F.year(dep) - F.year(ret), F.lit(0))
    days = F.make_dt_interval(F.dayofmonth(dep) - F.dayofmonth(ret))
    fixed = (F.when((F.year(ret) > cfg.last_unset_year) & (F.year(ret) < F.year(dep)), ret + years)
             .when(F.dayofmonth(ret) < F.dayofmonth(dep), ret + days).otherwise(ret))
    if "is_not_delivered" in rows.columns:
        rows = rows.filter(~F.col("is_not_delivered"))
    return (rows.filter(F.col("vehicle_name").isNotNull() & (F.col("speedo_finish") > 0))
            .withColumn("time_return", fixed)
            .withColumn("distance", F.col("speedo_finish") - F.col("speedo_start"))
            .withColumn("date", month_floor(F.col("date_delivery")))
            .withColumn("duration", bankers_round(minutes_between(dep, F.col("time_return")), 1)))


def delivery_crews(t: Tables, start: date, finish: date, cfg: Settings) -> DataFrame:
    """Cleaned trips with their people but without the orders.

    Crew cost does not depend on the orders, so the product of people and orders
    that ``delivery_rows`` lists is not formed; the trip must have a delivered one.
    """
    delivered = t["trip_order"].filter(~F.col("is_not_delivered")).select("trip_ref")
    trips = _trips(t, start, finish).join(delivered, "trip_ref", "left_semi")
    return delivery_clean(_people(t, trips), cfg).drop("trip_ref")


def delivery_stops(t: Tables, start: date, finish: date, cfg: Settings) -> DataFrame:
    """Cleaned trips with their orders but without the people."""
    return delivery_clean(_with_stops(t, _trips(t, start, finish), start, finish), cfg)


def delivery_orders(t: Tables, start: date, finish: date) -> DataFrame:
    """Delivery orders with stores, address region and base document."""
    low = start - timedelta(days=30)
    stores = t["store_dim"]
    df = t.register("delivery_order", "date_deliv_order", start, finish, ["posted"])
    df = decode(df, "store_ref", stores, "store_id", "store_name")
    df = decode(df, "recipient_ref", stores, drop=False, recipient_store="store_id")
    df = decode(df, "recipient_ref", t["partner_dim"], "customer_id")
    df = decode(df, "intermediate_ref", stores, intermediate_store="store_name")
    address = decode(t["address_dim"].select("ref", "deliv_address_id", "region_ref"), "region_ref",
                     t["region_dim"], address_region="region_id")
    df = decode(df, "address_ref", address, "deliv_address_id", "address_region")
    sale = decode(t.register("sale_doc", "sale_doc_date", low, finish), "subdiv_ref",
                  t["subdiv_dim"], "subdiv_id")
    df = decode(df, "base_doc_ref", sale, "subdiv_id", drop=False, nmbr_sale_doc="sale_doc_nmbr",
                date_sale_doc="sale_doc_date")
    df = decode(df, "base_doc_ref", t.register("transfer_out", "date", low, finish),
                nmbr_moving_out="nmbr", date_moving_out="date")
    return df.select("nmbr_deliv_order", "date_deliv_order", "deliv_address_id", "address_region",
                     "store_id", "store_name", "intermediate_store", "weight", "nmbr_sale_doc",
                     "date_sale_doc", "customer_id", "subdiv_id", "nmbr_moving_out",
                     "date_moving_out", "recipient_store")


def crew_cost(crews: DataFrame, salary: DataFrame, t: Tables, cfg: Settings) -> DataFrame:
    """Drivers' and forwarders' pay per cargo vehicle and month, by share of trip time."""
    trips = (crews.filter((F.col("distance") > 0)
                          & (F.to_date("time_return") > F.lit(cfg.min_return_date)))
             .select("nmbr_delivery", "date", "forwarder", "driver", "vehicle_id", "vehicle_name",
                     "direction", "route_id", "duration", "distance").distinct()
             .withColumn("duration", F.when(F.col("duration") < 0, F.lit(1.0)).otherwise(F.col("duration"))))
    drivers = trips.select(F.col("driver").alias("forwarder")).distinct()
    cols = ["date", "vehicle_id", "duration"]
    second = trips.filter(F.col("forwarder").isNotNull()).join(drivers, "forwarder", "left_anti")
    staff = (trips.select("driver", *cols).withColumnRenamed("driver", "person")
             .unionByName(second.select(F.col("forwarder").alias("person"), *cols)))
    hours = staff.groupBy("date", "person", "vehicle_id").agg(
        r_sum(F.col("duration")).alias("total_duration"))
    pay = salary.select(F.col("individ_id").alias("person"), "date", "position_id", "total_salary")
    paid = join_null_safe(hours, pay, ["date", "person"]).filter(
        F.col("position_id").isin(list(cfg.driver_positions)))
    # A person's month holds one row per vehicle driven and pay row: a bounded group.
    w = W.partitionBy("date", "person")
    whole = F.when(F.count("total_duration").over(w) == F.count(F.lit(1)).over(w),
                   F.sum("total_duration").over(w))
    part = bankers_round(safe_div(F.col("total_duration"), whole) * F.col("total_salary"))
    trucks = ref_vehicle(t).filter("is_cargo").filter(
        not_in_local(F.col("auto_id"), cfg.excluded_vehicles)).select(
        F.col("auto_id").alias("vehicle_id"), "subdiv_id")
    return (paid.withColumn("person_exp", part).groupBy("date", "vehicle_id")
            .agg(r_sum(F.col("person_exp")).alias("person_exp")).join(trucks, "vehicle_id"))


def truck_cost_km(crews: DataFrame, crew: DataFrame, exp: DataFrame, finish: date,
                  cfg: Settings) -> DataFrame:
    """Crew pay, fuel and upkeep over the kilometres driven, per vehicle and month."""
    km = (crews.select("nmbr_delivery", "date_delivery", "date", "vehicle_id", "distance").distinct()
          .groupBy("date", "vehicle_id").agg(F.coalesce(F.sum("distance"), F.lit(0.0)).alias("km")))
    df = (crew.join(km, ["date", "vehicle_id"], "left")
          .join(fuel_months(exp, finish, cfg), ["date", "subdiv_id"], "left")
          .join(maintenance_mean(exp), "subdiv_id", "left"))
    cost = F.col("person_exp") + F.col("fuel_sum") + F.col("avr_maintenance_sum")
    return df.select("date", "vehicle_id", bankers_round(safe_div(cost, F.col("km")), 3).alias("cost_1km"))


def trade_deliveries(stops: DataFrame, orders: DataFrame, t: Tables, trucks: DataFrame,
                     recipients: DataFrame, cfg: Settings) -> DataFrame:
    """Orders carried by cargo vehicles to trading stores within the route's regions."""
    sources = decode(t["store_dim"].select("distribution_ref"), "distribution_ref", t["store_dim"],
                     delivery_store="store_id").filter(F.col("delivery_store").isNotNull()).distinct()
    df = (stops.filter(not_in_local(F.col("direction"), cfg.excluded_directions)
                       & not_in_local(F.col("route_id"), cfg.excluded_routes)
                       & F.col("nmbr_deliv_order").isNotNull() & ~F.col("to_intermediate")
                       & (F.col("speedo_finish") > 0) & (F.col("speedo_finish") > F.col("speedo_start")))
          .join(trucks.select("vehicle_id").distinct(), "vehicle_id", "left_semi")
          .select("date_delivery", "nmbr_delivery", "nmbr_deliv_order", "date_deliv_order",
                  "vehicle_id", "route_id", F.col("store_id").alias("delivery_store"))
          .join(orders.select("nmbr_deliv_order", "date_deliv_order", "address_region",
                              "recipient_store"), ["nmbr_deliv_order", "date_deliv_order"], "left")
          .join(recipients.select(F.col("store_id").alias("recipient_store")).distinct(),
                "recipient_store", "left_semi")
          .join(ref_route(t).select("route_id", "route_parent", "regions"), "route_id", "left")
          .join(sources.withColumn("_dist", F.lit(True)), "delivery_store", "left"))
    extra = F.lit(False)
    for store, recipient in cfg.extra_delivery:
        extra = extra | ((F.col("delivery_store") == store) & (F.col("recipient_store") == recipient))
    inside = F.exists("regions", lambda r: r["region_id"].eqNullSafe(F.col("address_region")))
    return df.filter((F.coalesce("_dist", F.lit(False)) | extra) & inside).drop("_dist", "regions")


def stop_list(deliveries: DataFrame, satellites: DataFrame, cfg: Settings) -> DataFrame:
    """One row per trip and stop, with the trip's stops as one sorted text.

    Stores behind the satellite warehouse count as one stop at it. The set per
    trip holds distinct stores, so it is bounded by the number of stores.
    """
    sat = satellites.select(F.col("store_id").alias("recipient_store"), F.lit(True).alias("_sat")).distinct()
    via = (F.col("delivery_store") == cfg.main_store) & F.col("_sat")
    df = deliveries.join(sat, "recipient_store", "left").withColumn(
        "recipient_store", F.when(via, cfg.satellite_store).otherwise(F.col("recipient_store")))
    for store, recipient in cfg.excluded_delivery:
        df = df.filter(~((F.col("delivery_store") == store) & (F.col("recipient_store") == recipient)))
    trip = ["nmbr_delivery", "date_delivery", "route_parent", "delivery_store", "vehicle_id"]
    return (df.groupBy(*trip).agg(sorted_texts(F.col("recipient_store")).alias("_stops"))
            .withColumn("store_list", F.array_join("_stops", ", "))
            .select(*trip, F.explode("_stops").alias("recipient_store"), "store_list"))


def stop_explode(tours: DataFrame) -> DataFrame:
    """Delimited stop texts back to one row per stop with its position."""
    return tours.select(*tours.columns, F.posexplode(F.split("store_list", ", ")).alias("pos", "stop"))


def leg_allocate(legs: DataFrame, key: Sequence[str] = ("trip_key",)) -> DataFrame:
    """Tour length given to its stops by min(distance from start, distance to end).

    The last leg leads back and has no stop. A tour has as many legs as it has distinct
    stops, so one window per tour holds a bounded group.
    """
    whole = W.partitionBy(*key)
    run = whole.orderBy("leg_no").rowsBetween(W.unboundedPreceding, 0)
    weight = F.least(F.col("_to"), F.col("_total") - F.col("_to"))
    stops = (legs.withColumns({"_to": F.sum("distance").over(run), "_total": F.sum("distance").over(whole),
                               "_last": F.max("leg_no").over(whole)})
             .withColumn("_w", F.when(F.col("leg_no") < F.col("_last"), weight))
             .withColumn("_sum_w", F.sum("_w").over(whole)).filter(F.col("leg_no") < F.col("_last")))
    part = safe_div(F.col("_w"), F.col("_sum_w")) * F.col("_total")
    return stops.select(*key, F.col("end").alias("pos"), bankers_round(part, 1).alias("distance"))


def tour_key(delivery_store: str = "delivery_store", store_list: str = "store_list"):
    return F.concat_ws("|", delivery_store, store_list)


def transport_store(stops: DataFrame, legs: DataFrame, cost_km: DataFrame, satellite: DataFrame,
                    t: Tables, cfg: Settings) -> DataFrame:
    """Mean monthly transport cost per warehouse's subdivision.

    ``legs`` holds the tours by ``trip_key`` = delivery store and stop list.
    """
    alloc = leg_allocate(legs).groupBy("trip_key", F.col("pos").alias("recipient_store")).agg(
        F.min("distance").alias("distance"))
    half = in_local(F.col("route_parent"), cfg.half_distance_routes)
    monthly = (stops.withColumn("trip_key", tour_key())
               .join(alloc, ["trip_key", "recipient_store"], "left")
               .withColumn("date", month_floor(F.col("date_delivery")))
               .withColumn("distance", F.when(half, F.col("distance") / 2).otherwise(F.col("distance")))
               .groupBy("date", "vehicle_id", "recipient_store")
               .agg(r_sum(F.col("distance")).alias("store_distance"))
               .join(cost_km, ["date", "vehicle_id"], "left")
               .groupBy("date", "recipient_store")
               .agg(r_sum(F.col("store_distance") * F.col("cost_1km")).alias("total_cost")))
    store = (monthly.groupBy("recipient_store").agg(F.avg("total_cost").alias("avr_transport_cost"))
             .join(_store_subdiv(t).select(F.col("store_id").alias("recipient_store"),
                                           F.col("store_subdiv").alias("subdiv_id")),
                   "recipient_store", "left"))
    extra = t["store_dim"].sparkSession.range(1).select(
        F.lit(cfg.extra_transport_subdiv).alias("subdiv_id"),
        F.lit(0.0).alias("avr_transport_cost"))
    df = union_by_name(store, extra)
    df = pick_other_row(df, F.col("subdiv_id") == cfg.satellite_subdiv, "avr_transport_cost", "_sat")
    df = df.join(satellite, "subdiv_id", "left")
    cost = F.when(F.col("satellite_subdiv_share").isNull(), bankers_round(F.col("avr_transport_cost"))
                  ).otherwise(bankers_round(F.col("_sat") * F.col("satellite_subdiv_share")
                                            + F.col("avr_transport_cost")))
    return df.filter(F.col("subdiv_id") != cfg.satellite_subdiv).select(
        "subdiv_id", cost.alias("avr_transport_cost"))


def schedule_latest(t: Tables) -> DataFrame:
    """Latest delivery schedule of each pair of warehouses."""
    df = t.unshift(t["delivery_schedule"], "date")
    df = decode(df, "recipient_ref", t["store_dim"], recipient_store="store_id")
    df = decode(df, "distribution_ref", t["store_dim"], distribution_store="store_id")
    days = [f"day_{i}" for i in range(1, 8)]
    return latest_per_key(df, ["recipient_store", "distribution_store"], "date").select(
        "date", "recipient_store", "distribution_store", *days)
