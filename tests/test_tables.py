from __future__ import annotations

import json

import pytest

from keyweave.operators import composite
from keyweave.plans.service import Service
from keyweave.sources.fixtures import find_case, list_cases
from keyweave.sources.table import JoinTable, csv_lines, write_csv


def cells(t: JoinTable) -> list[list[str]]:
    return [r["_cells"] for r in t.df.orderBy("_rid").collect()]


def test_csv_rules(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('\n Title ,x,Title\n"Doe, J" , b\n\na,b,c,d\n"open, quote,1\nsay ""hi"",2,3\n')
    t = JoinTable.from_csv(spark, str(f), ["Title"])
    assert t.names == ["Title", "x", "Title"] and t.keys == [0, 2]
    assert cells(t) == [["Doe, J", "b", ""], ["a", "b", "c"], ["open, quote,1", "", ""], ["say hi", "2", "3"]]
    (tmp_path / "b.csv").write_text("\n  \n")
    with pytest.raises(ValueError, match="empty"):
        JoinTable.from_csv(spark, str(tmp_path / "b.csv"))


def test_rows_and_names(spark):
    t = JoinTable.from_rows(spark, ["a", "b", "a"], [["1", "2", "3"]], ["a"])
    assert t.positions(["a", "a", "b"]) == [0, 2, 1] and t.position("a") == 0
    with pytest.raises(ValueError):
        JoinTable.from_rows(spark, ["a"], [["1", "2"]])
    with pytest.raises(ValueError):
        JoinTable(t.df, [])


def test_csv_of_several_files(spark, tmp_path):
    """Every file may begin with the header; a row that only looks like it stays."""
    for k, rows in enumerate((["a,b", "1,x", "a,b"], ["a,b", "2,y"], ["3,z"])):
        (tmp_path / f"p{k}.csv").write_text("\n".join(rows) + "\n")
    t = JoinTable.from_csv(spark, str(tmp_path))
    assert t.names == ["a", "b"] and sorted(tuple(r["_cells"]) for r in t.df.collect()) == [("1", "x"), ("2", "y"), ("3", "z"), ("a", "b")]


def test_csv_sink(spark, tmp_path):
    s = JoinTable.from_rows(spark, ["a", "b,c"], [["x", 'q"r'], ["y", "l\nm"]])
    pairs = spark.createDataFrame([(0, 0), (1, 1)], "src_rid long, tgt_rid long")
    header, lines = csv_lines(pairs, s, s)
    assert header == 'a,"b,c",a,"b,c"'
    assert sorted(r[0] for r in lines.collect()) == ['x,"q""r",x,"q""r"', 'y,"l\nm",y,"l\nm"']
    write_csv(pairs.limit(1), s, s, str(tmp_path / "out"))
    assert any(p.read_text().splitlines()[0] == header for p in (tmp_path / "out").glob("*.csv"))


def test_composite_keys(spark):
    rows = [["Barack Obama (Democratic)", "47"], ["George W. Bush (Republican)", "49"], ["Bill Clinton (Democratic)", "55"], ["Ronald Reagan (Republican)", "53"]]
    t = composite.split_keys(JoinTable.from_rows(spark, ["Person", "Approval"], rows, ["Person"]))
    assert t.width == 4 and cells(t)[0] == [*rows[0], "Barack Obama", "Democratic"] and t.keys == [0, 2, 3]
    plain = JoinTable.from_rows(spark, ["P"], [["a"], ["b"], ["c (x)"], ["d"]], ["P"])
    assert composite.split_keys(plain) is plain


def test_service(spark, tmp_path):
    root = tmp_path / "cases" / "codes"
    root.mkdir(parents=True)
    (tmp_path / "s.csv").write_text("first,last\n" + "".join(f"ann{c},smith{c}\n" for c in "abcdefgh"))
    (tmp_path / "t.csv").write_text("login\n" + "".join(f"smith{c}-ann{c}\n" for c in "abcdefgh"))
    (tmp_path / "g.csv").write_text("source-first,source-last,target-login\n" + "".join(f"ann{c},smith{c},smith{c}-ann{c}\n" for c in "abcdefgh"))
    case = {"pair_id": "codes", "source": {"file": "s.csv", "key_columns": ["first", "last"]}, "target": {"file": "t.csv", "key_columns": ["login"]}, "ground_truth": {"file": "g.csv", "format": "row_values", "source_key_columns": ["first", "last"], "target_key_columns": ["login"]}}
    (root / "fixture.json").write_text(json.dumps(case))
    roots = [str(tmp_path / "cases")]
    assert [c.pair_id for c in list_cases(roots, str(tmp_path))] == ["codes"]
    with pytest.raises(FileNotFoundError):
        find_case(roots, str(tmp_path), "none")
    service = Service(spark, roots, str(tmp_path), store=f"file://{tmp_path}/store")
    assert service.cases()[0]["source"] == {"rows": 8, "columns": 2}
    run = service.run("codes", "AJ-E")
    assert run.summary["precision"] == run.summary["recall"] == 1.0 and run.csv.startswith("first,last,login\n")
    assert run.trace["learning"]["steps"][-1]["so_far"].startswith("smith")
    job = service.submit("codes", "FJ-C")
    service.jobs[job][1].result()
    assert service.job_status(job) == {"status": "done", "result": job}
    assert [r["method"] for r in service.results().collect()] == ["FJ-C", "AJ-E"]
    again = Service(spark, roots, str(tmp_path), store=f"file://{tmp_path}/store")
    assert again.result(run.seq).csv == run.csv and again.result(run.seq).summary == run.summary and again.system_info()["heap_max"] > 0
    service.clear()
    assert not Service(spark, roots, str(tmp_path), store=f"file://{tmp_path}/store").runs
    assert service.results().count() == 0 and "timeout" in service.system_info()
