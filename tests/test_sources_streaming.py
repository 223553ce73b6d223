import json
import zipfile

from lodestrata.sources import catalogues
from lodestrata.streaming import events


def tsv(path, rows):
    path.write_text("# comment\n\n" + "\n".join("\t".join(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_gazetteer(spark, tmp_path):
    place = ["1", "Ostra", "Ostra", "Óstra,Oster", "1.5", "2.5", "P", "PPL", "XA", "", "07", "", "", "", "5000", "", "", "Etc/UTC", ""]
    other = place.copy()
    other[0], other[8], other[14] = "2", "XB", ""
    p = catalogues.places(spark, tsv(tmp_path / "p.tsv", [place, other]))
    c = catalogues.countries(spark, tsv(tmp_path / "c.tsv", [["XA", "XAA", "", "", "Xaland", *[""] * 10, "en-GB,fr,en,haw", ""]]))
    rows = {r.place_id: r for r in p.collect()}
    assert rows["1"].alternates == ["Óstra", "Oster"] and rows["1"].population == 5000 and rows["2"].population is None and rows["1"].admin2 is None
    assert c.collect()[0].languages == ["en", "fr"]
    assert [r.place_id for r in catalogues.known_places(p, c).collect()] == ["1"]
    assert [(r.country, r.skipped) for r in catalogues.skipped_places(p, c).collect()] == [("XB", 1)]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.write(tmp_path / "p.tsv", "places.txt")
    assert sorted(map(str, catalogues.places(spark, str(tmp_path / "p.zip")).collect())) == sorted(map(str, p.collect()))
    (a,) = catalogues.admin1(spark, tsv(tmp_path / "a.tsv", [["XA.07", "North"]])).collect()
    assert (a.country, a.code, a.name) == ("XA", "07", "North")


def test_statistics(spark, tmp_path):
    value = lambda year, shown, **x: {"IndicatorCode": "I", "SpatialDim": "XAA", "TimeDim": year, "Dim1": "BTSX", "Value": shown} | x
    (tmp_path / "o.json").write_text(json.dumps({"value": [value(2020, "12.5 [3-4]"), value(2021, "No data"), value(None, "1"), value(2019, "7", Dim2Type="AGEGROUP", Dim2="18+")]}))
    rows = {r.year: r for r in catalogues.odata_values(spark, str(tmp_path / "o.json")).collect()}
    assert rows[2020].value == "12.5" and rows[2021].value == "" and rows[2019].age == "18+" and len(rows) == 3
    (tmp_path / "w.json").write_text(json.dumps([{"page": 1}, [{"indicator": {"id": "P"}, "countryiso3code": "XAA", "date": d, "value": v} for d, v in (("2020", 5), ("2021", None), ("2019Q1", 3), ("2018", 4))]]))
    w = catalogues.paged_values(spark, str(tmp_path / "w.json"))
    assert sorted(r.year for r in w.collect()) == [2018, 2020]
    assert [(r.year, int(r.value)) for r in catalogues.latest_record(w).collect()] == [(2020, 5)]
    assert catalogues.latest_record(w.union(w)).count() == 0


def run(query, tmp_path, name):
    stream = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    stream.awaitTermination(120)


def test_streams(spark, tmp_path):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [("u1", f"e{i % 7}", f"2024-01-01 0{i % 9}:00:00") for i in range(20)] + [("u2", "e0", "2024-01-01 00:30:00")]
    df = spark.createDataFrame(rows, "run string, id string, at string").selectExpr("run", "id", "CAST(at AS timestamp) AS at")
    for part in range(2):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(events.gapfree_sequences(stream, "run", "id", "at"), tmp_path, "seqs")
    got = spark.table("seqs").collect()
    assert sorted(r.seq for r in got if r.run == "u1") == list(range(1, 8)) and [r.seq for r in got if r.run == "u2"] == [1]
    run(events.windowed_counts(stream, "at", "run", "1 hour", "0 minutes"), tmp_path, "counts")
    first = {(r.start.hour, r.run): r.n for r in spark.table("counts").collect()}
    assert first and all(n % 1 == 0 for n in first.values())
    run(events.first_flights(stream, "at", ["id"], "1 day"), tmp_path, "flights")
    assert spark.table("flights").count() == 7
    spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_no_id_is_numbered_twice_however_many(spark, tmp_path):
    """More ids of one run than an earlier bound of 100,000, all sent again later."""
    df = spark.range(120_000).selectExpr("'r' AS run", "concat('e', id) AS id", "timestamp'2024-01-01' AS at")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(events.gapfree_sequences(stream, "run", "id", "at"), tmp_path, "many")
    got = spark.table("many").selectExpr("count(*)", "count(DISTINCT id)", "min(seq)", "max(seq)").first()
    assert tuple(got) == (120_000, 120_000, 1, 120_000)
