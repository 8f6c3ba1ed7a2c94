"""Readers of files whose headers differ from file to file."""

import pytest

from pulseframe.sources import headers, readers
from tests.test_micro import DAY


def put(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_csv", ".csv")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


def test_signals_of_mixed_headers(spark, tmp_path):
    root = put(
        tmp_path, hp1__hp1_hr_csv="time,data_type,value\n2024-01-01 00:00:01,hr,61\n", hp2__hp2_hr_csv="data_type,bpm,datetime_local\nhr,62,2024-01-01 00:00:02.5-10:00\n",
        hp3__hp3_hr_csv='﻿"time",note,quality,"value"\n2024-01-01 00:00:03,"a, b",9,63\n\n2024-01-01 00:00:04,c,9,x\n', hp4__hp4_hr_csv="time,value\n", hp5__hp5_hr_csv="",
        hp6__hp6_hr_csv="datetime_local,id,text,rate,rate2\n2024-01-01 00:00:06,5,t,,1\n2024-01-01 00:00:07,5,t,67,2\n", hp7__hp7_hr_csv="when,value\n2024-01-01 00:00:07,1\n", hp8__hp8_hr_csv="time,datetime_local,value\n,2024-01-01 00:00:08,1\n",
    )
    rows = sorted((r["user_id"], r["data_type"], r["value"], r["t"] % DAY) for r in readers.read_signals(spark, root).collect())
    assert rows == [(1, "hr", 61.0, 1_000_000), (2, "hr", 62.0, 2_000_000), (3, None, 63.0, 3_000_000), (6, None, 67.0, 7_000_000)]


def test_self_reports_of_mixed_headers(spark, tmp_path):
    root = put(
        tmp_path, a_csv="id,substance_fruit_label,user_id,hawaii_createdat_time\n1,melon,4,2024-01-01 00:00:01\n2,kiwi,4,2024-01-01 00:00:02\n",
        b_csv="hawaii_use_time,user_id,substance_fruit_label,hawaii_createdat_time\n2024-01-01 00:00:05.7,9,melon,2024-01-01 00:00:03\nbad,9,melon,2024-01-01 00:00:04\n", c_csv="", d_csv="other\n1\n",
    )
    found = lambda scenario: [(r["user_id"], r["t"] % DAY // 1_000_000) for r in readers.read_self_reports(spark, root, "melon", scenario).collect()]
    assert found("Crave") == [(4, 1), (9, 3), (9, 4)] and found("Use") == [(9, 5)] and found("None") == [(4, 1), (4, 2), (9, 3), (9, 4)]
    assert readers.read_self_reports(spark, str(tmp_path / "absent"), "melon", "Use").count() == 0
    (tmp_path / "empty").mkdir()
    assert readers.read_self_reports(spark, str(tmp_path / "empty"), "melon", "Use").count() == 0


def test_both_summary_headers(spark, tmp_path):
    root = put(
        tmp_path, hp20__BP_spike__comparison_summary_csv="Pipeline,Best_Threshold,Accuracy (Mean ± STD),AUC_Train,AUC_Val,AUC_Mean ± STD\nGlobal SSL,0.5,0.8 ± 0.1,0.91,0.8,0.701 ± 0.050\n,0.5,x,0.1,0.1,0.1 ± 0.1\n",
        hp21__melon_Use__comparison_summary_csv="AUC_STD,AUC_Mean,Pipeline,AUC_Train\n0.2,0.7,Global SSL,\n", hp22__BP_spike__comparison_summary_csv="Pipeline,ROC AUC\nx,0.66\n", hp23__BP_spike__comparison_summary_csv="no,such\n1,2\n", hp23__BP_spike__other_csv="Pipeline\ny\n",
    )
    got = {r["uid"]: (r["substance"], r["task"], r["pipeline"], r["auc_train"], r["auc_mean"], r["auc_std"], r["auc_text"]) for r in readers.read_summaries(spark, root).collect()}
    assert got == {"hp20": ("BP", "spike", "Global_SSL", 0.91, None, None, "0.701 ± 0.050"), "hp21": ("melon", "Use", "Global_SSL", None, 0.7, 0.2, None), "hp22": ("BP", "spike", "x", None, None, None, "0.66")}
    tree = {r["uid"]: r for r in readers.read_result_tree(spark, root).where("Pipeline <> ''").collect()}
    assert tree["hp21"]["AUC_Mean"] == "0.7" and tree["hp21"]["AUC_Mean ± STD"] is None and tree["hp20"]["AUC_Mean"] is None


def test_many_lines_and_splits(spark, tmp_path):
    """Files cut into many splits still have one header each."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    put(tmp_path, a_csv="x,y\n" + "".join(f"{i},a\n" for i in range(3000)), b_csv="y,x\n" + "".join(f"b,{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        table = headers.read_by_header(spark, str(tmp_path))
        assert sorted(table.names) == ["x", "y"]
        got = sorted((r["y"], int(r["x"])) for r in table.named("x", "y").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(k, i) for k in "ab" for i in range(3000)]


def test_files_without_headers_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(headers, "MOST_HEADERS", 2)
    root = put(tmp_path, a_csv="1,2\n", b_csv="3,4\n", c_csv="5,6\n")
    with pytest.raises(ValueError, match="headers"):
        headers.read_by_header(spark, root)
