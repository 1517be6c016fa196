import random
from datetime import datetime

from pyspark.sql import functions as F

from registry.driver_tables import tour_legs
from shelfledger.config import Settings
from shelfledger.operators import logistics as L
from shelfledger.operators import refs
from shelfledger.sources.readers import FrameTables

from .conftest import rows


def allocate(distances):
    """Stop lengths of one tour, written leg by leg."""
    total, stops = sum(distances), distances[:-1]
    weights = [min(sum(distances[:i + 1]), sum(distances[i + 1:])) for i in range(len(stops))]
    return [w / sum(weights) * total if sum(weights) else None for w in weights]


def test_leg_allocate_against_rows(spark):
    rnd = random.Random(8)
    tours = {t: [float(rnd.randrange(1, 50)) for _ in range(n)] for t, n in (("a", 2), ("b", 5), ("c", 12), ("hot", 90))}
    data = [(t, i, f"{t}{i}", d) for t, ds in tours.items() for i, d in enumerate(ds, 1)]
    legs = spark.createDataFrame(data, "trip_key string, leg_no int, end string, distance double")
    got = {r.pos: r.distance for r in L.leg_allocate(legs).collect()}
    assert len(got) == sum(len(d) - 1 for d in tours.values())
    for t, ds in tours.items():
        for i, w in enumerate(allocate(ds), 1):
            assert abs(got[f"{t}{i}"] - w) <= 0.0501
        assert abs(sum(got[f"{t}{i}"] for i in range(1, len(ds))) - sum(ds)) <= 0.06 * len(ds)


def trip(ret, dep=datetime(2024, 5, 10, 8), finish=150.0, vehicle="v"):
    return (dep, ret, vehicle, 100.0, finish, datetime(2024, 5, 10), False)


TRIP = ("time_depart timestamp_ntz, time_return timestamp_ntz, vehicle_name string, speedo_start double, "
        "speedo_finish double, date_delivery timestamp_ntz, is_not_delivered boolean")


def test_delivery_clean_repairs_return(spark):
    data = [trip(datetime(2024, 5, 10, 12)), trip(datetime(2023, 5, 10, 12)), trip(datetime(2024, 5, 8, 12)),
            # a return in the next month on an earlier day number is moved as well
            trip(datetime(2024, 6, 2, 8)), trip(datetime(2024, 5, 10, 7)),
            trip(datetime(2024, 5, 10, 12), finish=0.0), trip(datetime(2024, 5, 10, 12), vehicle=None)]
    got = L.delivery_clean(spark.createDataFrame(data, TRIP), Settings()).collect()
    assert sorted(r.duration for r in got) == [-60.0, 240.0, 240.0, 240.0, 31 * 24 * 60.0]
    assert {r.distance for r in got} == {50.0}


def test_return_time_never_set_keeps_its_year(spark):
    data = [trip(datetime(1, 1, 2), dep=datetime(2023, 5, 1, 8)), trip(datetime(22, 5, 1, 9), dep=datetime(23, 5, 1, 8))]
    got = sorted(L.delivery_clean(spark.createDataFrame(data, TRIP), Settings()).collect(), key=lambda r: r.duration)
    assert got[0].time_return == datetime(1, 1, 2) and got[1].duration == 60.0


def test_undelivered_rows_are_left_out(spark):
    data = [trip(datetime(2024, 5, 10, 12))[:-1] + (flag,) for flag in (True, False, None)]
    assert L.delivery_clean(spark.createDataFrame(data, TRIP), Settings()).count() == 1


def test_unknown_region_matches_unknown_only(spark):
    t = FrameTables({
        "route_dim": spark.createDataFrame([(1, "r1", "a", None, None, False), (2, "r2", "b", 1, None, False)],
                                           "ref int, route_id string, route string, parent_ref int, subdiv_ref int, route_marked boolean"),
        "route_region": spark.createDataFrame([(1, 5), (1, None)], "route_ref int, region_ref int"),
        "region_dim": spark.createDataFrame([(5, "g5")], "ref int, region_id string"),
        "subdiv_dim": spark.createDataFrame([(1, "s")], "ref int, subdiv_id string")})
    routes = refs.ref_route(t)
    ask = spark.createDataFrame([("r1", "g5"), ("r1", None), ("r1", "g6"), ("r2", None), ("r2", "g5")], "route_id string, g string")
    hit = ask.join(routes, "route_id").filter(F.exists("regions", lambda r: r["region_id"].eqNullSafe(F.col("g"))))
    assert rows(hit.select("route_id", "g")) == [("r1", None), ("r1", "g5"), ("r2", None)]


def test_crew_share_sums_to_pay_and_drivers_do_not_forward(spark):
    ts = datetime(2024, 5, 10, 12)
    crews = spark.createDataFrame(
        [("t1", None, "f1", "d1", "v1", "V", "x", "r", 60.0, 5.0, ts), ("t2", None, "d1", "d2", "v2", "V", "x", "r", 30.0, 5.0, ts),
         ("t3", None, None, "d1", "v2", "V", "x", "r", -5.0, 5.0, ts), ("t4", None, None, "d1", "v2", "V", "x", "r", 39.0, 5.0, ts),
         ("t5", None, None, "d1", "v2", "V", "x", "r", 99.0, 0.0, ts)],
        "nmbr_delivery string, date date, forwarder string, driver string, vehicle_id string, vehicle_name string, "
        "direction string, route_id string, duration double, distance double, time_return timestamp_ntz")
    salary = spark.createDataFrame([("d1", None, "000000041", 100.0), ("d2", None, "000000039", 10.0), ("f1", None, "000000041", 7.0)],
                                   "individ_id string, date date, position_id string, total_salary double")
    t = FrameTables({
        "vehicle_dim": spark.createDataFrame([(f"v{i}", f"n{i}", False, 1, 1, True, 1.0, 1.0, 1.0) for i in (1, 2)],
                                             "auto_id string, auto_name string, marked boolean, subdiv_ref int, store_ref int, is_cargo boolean, load_capacity double, volume double, tank double"),
        "subdiv_dim": spark.createDataFrame([(1, "s")], "ref int, subdiv_id string"),
        "store_dim": spark.createDataFrame([(1, "w")], "ref int, store_id string")})
    got = {r.vehicle_id: r.person_exp for r in L.crew_cost(crews, salary, t, Settings()).collect()}
    # d1 drove 60 of 100 minutes on v1 (the negative trip counts 1), forwarding on v2 is not counted
    assert got == {"v1": 60.0 + 7.0, "v2": 40.0 + 10.0}


def test_stop_list_routes_satellite_stores_over_it(spark):
    cfg = Settings()
    d = spark.createDataFrame(
        [("1", None, "p", cfg.main_store, "v", "A"), ("1", None, "p", cfg.main_store, "v", "B"), ("1", None, "p", cfg.main_store, "v", "C"),
         ("2", None, "p", cfg.main_store, "v", "000001110"), ("2", None, "p", "w", "v", "A")],
        "nmbr_delivery string, date_delivery date, route_parent string, delivery_store string, vehicle_id string, recipient_store string")
    sat = spark.createDataFrame([("A",), ("B",)], "store_id string")
    got = L.stop_list(d, sat, cfg).select("nmbr_delivery", "recipient_store", "store_list")
    assert rows(got) == [("1", cfg.satellite_store, f"{cfg.satellite_store}, C"), ("1", "C", f"{cfg.satellite_store}, C"), ("2", "A", "A")]


def test_tour_legs_return_to_start(spark):
    legs = tour_legs(spark.createDataFrame([("1", "2, 3")], "delivery_store string, store_list string"))
    assert [(r.leg_no, r.end) for r in legs.orderBy("leg_no").collect()] == [(1, "2"), (2, "3"), (3, "1")]
