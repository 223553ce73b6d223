"""Places of few names: what a name's places say of an area, without pairs of them."""

import duckdb

from lodestrata.plans import places
from tests.growth import made


def test_places_of_one_name_do_not_meet(spark, tmp_path):
    n, con = 3000, duckdb.connect()
    con.sql(f"CREATE TABLE customer AS SELECT c AS c_custkey, c % 4 AS c_nationkey, c * 7.5::DOUBLE AS c_acctbal FROM range({n}) t(c) UNION ALL SELECT 18, 2, 1.0")
    con.sql(f"CREATE TABLE part AS SELECT p AS p_partkey, ['blue ring', 'old rod'][1 + p % 2] AS p_name FROM range({n}) t(p) UNION ALL SELECT 40, 'old rod' UNION ALL SELECT 51, 'far stone'")
    con.sql("CREATE TABLE nation AS SELECT k AS n_nationkey, ['FRANCE', 'UNITED STATES', 'PERU', 'CHINA'][1 + k] AS n_name FROM range(4) t(k)")
    for t in ("customer", "part", "nation"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = []
    rows = made(spark, lambda: got.extend(places.area_relations(spark, str(tmp_path)).collect()))
    assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT place_id, label, level, relation FROM ({places.ORACLES['area_relations']})").fetchall())
    assert {"city", "contains_city", "unresolved", "elsewhere"} <= {r.relation for r in got}
    assert n < rows < 200 * n, rows
