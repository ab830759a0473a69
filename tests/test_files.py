"""Text sources and sinks."""

import pytest

from pathloom.plans import studies
from pathloom.sources import files


def test_positional_files(spark, tmp_path):
    (tmp_path / "x").write_text("1\t2.5\n3\tNA\n")
    (tmp_path / "c").write_text("s1\t0\ns2\t1\n")
    (tmp_path / "r").write_text("g1\ng2\n")
    got = sorted(map(tuple, files.read_experiment(spark, *(str(tmp_path / n) for n in "xcr")).collect()))
    assert got == [("g1", "s1", 0, 1.0), ("g1", "s2", 1, 2.5), ("g2", "s1", 0, 3.0), ("g2", "s2", 1, None)]


def test_series(spark, tmp_path):
    text = ['!Series_title\t"t"', '!Sample_title\t"a case"\t"control b"', '!Sample_source\t"x"\t"y"', "!series_matrix_table_begin", '"ID_REF"\t"S1"\t"S2"', '"p1"\t1.5\t300', '"p2"\t4\t8', '"p3"\t2\t', "!series_matrix_table_end"]
    (tmp_path / "m").write_text("\n".join(text) + "\n")
    values, samples = files.read_series(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, values.collect()), key=str) == [("p1", "S1", 1.5), ("p1", "S2", 300.0), ("p2", "S1", 4.0), ("p2", "S2", 8.0), ("p3", "S1", 2.0), ("p3", "S2", None)]
    assert ("title", "S1", "a case") in [tuple(r) for r in samples.collect()]
    probes = spark.createDataFrame([("p1", "7"), ("p2", "7"), ("p3", "8 /// 9"), ("p4", "")], "probe string, gene string")
    names = spark.createDataFrame([("7", "G")], "id string, name string")
    got = {r["sample"]: r for r in files.assembled(values, samples, "title", "CASE", probes, names, log=False).collect()}
    assert (got["S1"]["gene"], got["S1"]["grp"], got["S1"]["value"]) == ("G", 1, 2.75) and got["S2"]["grp"] == 0
    logged = {r["sample"]: r["value"] for r in files.assembled(values, samples, "title", "case", probes, names).collect()}
    assert logged["S2"] == pytest.approx(7.2668, abs=1e-3)
    assert files.collapsed(values, probes, "first").where("sample = 'S1'").first()["value"] == 1.5
    wide = files.widened(files.collapsed(values, probes))
    assert wide.columns == ["sample", "7"] and wide.count() == 2


def test_tables_and_platforms(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    files.write_table(df.coalesce(1), str(tmp_path / "t"))
    files.write_table(df.coalesce(1), str(tmp_path / "c"), ",", True)
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "t"), schema="k string, v double", header=False).collect())) == [("a", 1.5), ("b", None)]
    assert files.read_table(spark, str(tmp_path / "c"), ",").columns == ["k", "v"]
    both = files.stacked([df, spark.createDataFrame([("c", 2)], "k string, w int")])
    assert both.columns == ["k", "v", "w"] and both.count() == 3
    assert [r["row"] for r in files.positioned(df.repartition(2), ["k"]).orderBy("k").collect()] == [0, 1]


def test_columns_without_variance_get_their_raw_values(spark):
    raw = spark.createDataFrame([(1, "a", 5.0), (2, "a", 6.0), (1, "b", 1.0), (2, "b", 2.0)], "obs long, var string, value double")
    changed = spark.createDataFrame([(1, "a", 0.0), (2, "a", 0.0), (1, "b", 9.0), (2, "b", 8.0)], "obs long, var string, value double")
    assert sorted(map(tuple, studies.backfilled(raw, changed).collect())) == [(1, "a", 5.0), (1, "b", 9.0), (2, "a", 6.0), (2, "b", 8.0)]
