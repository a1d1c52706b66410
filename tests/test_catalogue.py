"""The file catalogue: headers of many files, read on the executors."""

import logging

from pairwise.sources import catalogue, listing, predictions, runs


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def test_ten_thousand_tiny_files(spark, tmp_path, monkeypatch):
    for k in range(10_000):
        put(tmp_path / "run" / f"type{k % 7}" / f"{'_' * (k % 11 == 0)}m{k}_prediction.csv", f"protein_id,c{k % 3}\n")
    monkeypatch.setattr(listing, "header_cells", None)  # no file is opened on the driver
    monkeypatch.setattr(catalogue, "header_cells", None)
    found = catalogue.discovered_files(spark, str(tmp_path / "run"), "_prediction.csv")
    assert found.rdd.getNumPartitions() == 50
    rows = found.collect()
    assert len(rows) == 10_000 and not any(r.error for r in rows)
    assert {tuple(r.header) for r in rows} == {("protein_id", f"c{k}") for k in range(3)}
    assert sum(r.name.startswith("_") for r in rows) == 910


def test_odd_files(spark, tmp_path, caplog):
    run = tmp_path / "run 1%"
    put(run / "a" / "x_prediction.csv", '﻿\r\n\n"protein_id","a ""b"", c"\r\nP,1\n')
    put(run / "a" / "empty_prediction.csv", "")
    put(run / "a" / "blank_prediction.csv", "\n \r\n")
    put(run / "a" / "long_prediction.csv", "x" * 100_000 + ",y")
    put(run / "a" / "deeper" / "z_prediction.csv", "protein_id\n")
    put(run / ".b" / "z_prediction.csv", "protein_id\n")
    put(run / "top_prediction.csv", "protein_id\n")
    (run / "a" / "broken_prediction.csv").write_bytes(b"\xff\xfe,\n")
    rows = {r.model_name: r for r in runs.discovered_models(spark, str(run)).collect()}
    assert rows["x"].header == ["protein_id", 'a "b", c'] and rows["x"].model_dir == "a"
    assert rows["empty"].header == rows["blank"].header == []
    assert [len(c) for c in rows["long"].header] == [100_000, 1]
    assert rows["broken"].header is None and "UnicodeDecodeError" in rows["broken"].error
    assert set(rows) == {"x", "empty", "blank", "long", "broken"}
    with caplog.at_level(logging.WARNING):
        frames = predictions.read_raw_models(spark, str(run))
    assert len(frames) == 2 and caplog.text.count("skipped") == 3


def test_hidden_files_are_cut_into_ranges(spark, tmp_path, monkeypatch):
    lines = [f"P{k},{'é' * (k % 9)},{k}" for k in range(300)]
    path = tmp_path / "run" / "t" / "_m_prediction.csv"
    put(path, "﻿protein_id,compound_id,prediction\r\n" + "\r\n".join(lines[:150]) + "\n\n" + "\n".join(lines[150:]))
    size = path.stat().st_size
    for step in (1, 7, 100, 10_000):
        found = [x for a in range(0, size, step) for x in catalogue.lines_of_range(str(path), a, min(a + step, size))]
        assert [x.decode() for x in found] == lines
    monkeypatch.setattr(catalogue, "RANGE", 500)
    (frame,) = predictions.read_raw_models(spark, str(tmp_path / "run"))
    assert sorted((r.protein_id, r.compound_id or "", r.prediction) for r in frame.collect()) == sorted(
        tuple(x.split(",")) for x in lines
    )
