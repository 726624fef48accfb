"""The correlation queries return whole matrices, of which STA2 and PLT7 are one cell."""

from kerbline.plans.registry import QUERIES


def test_whole_matrices(spark, small_sf):
    whole = QUERIES["STA2M"](spark, small_sf).collect()
    assert len(whole) == 16 and all(r["rho"] == 1 for r in whole if r["row"] == r["col"])
    cell = {(r["row"], r["col"]): r["rho"] for r in whole}
    assert all(cell[a, b] == cell[b, a] for a, b in cell)
    assert cell["speed", "time"] == QUERIES["STA2"](spark, small_sf).collect()[0]["rho"]
    by = QUERIES["PLT7M"](spark, small_sf).collect()
    one = {r["continent"]: r["rho"] for r in QUERIES["PLT7"](spark, small_sf).collect()}
    assert len(by) == 25 * len(one)
    assert {r["continent"]: r["rho"] for r in by if (r["row"], r["col"]) == ("gini", "traffic_index")} == one
