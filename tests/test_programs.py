from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from keyweave.functions import strings as S
from keyweave.functions.strings import Casing
from keyweave.plans.program import Constant, Program, split_split_substr, split_substr, substr

ROW = ("Obama, Barack(1961-)", "47.0")


@pytest.mark.parametrize(
    ("value", "start", "length", "out"),
    [(" Barack", 1, -1, "Barack"), ("Barack", -3, -1, "ack"), ("abc", 10, -1, ""), ("abc", -10, 2, "ab"), ("abc", 1, 0, ""), ("", 0, -1, "")],
)
def test_substring(value, start, length, out):
    assert S.py_substring(value, start, length) == out


def test_split_keeps_empty_parts(spark):
    df = spark.createDataFrame([("a,b,",), ("",), ("[UBAX01] AXUG",)], "v string")
    assert [r[0] for r in df.select(S.split(F.col("v"), ",")).collect()] == [["a", "b", ""], [""], ["[UBAX01] AXUG"]]
    assert df.select(S.split(F.col("v"), "] ")).collect()[2][0] == ["[UBAX01", "AXUG"]
    with pytest.raises(ValueError):
        S.split(F.col("v"), "")


def test_operators_on_a_row(spark):
    assert split_substr(0, ",", 0, 0).apply(ROW) == "Obama"
    assert split_split_substr(0, "(", 0, ",", 1, 1).apply(ROW) == "Barack"
    assert substr(7, 0).apply(ROW) is None
    assert S.py_cased("george w. bush", Casing.TITLE) == "George W. Bush"
    odd = "\u2003".join(["ab\tcd", "ef\u00a0gh", "ij\x1ckl"])
    assert S.py_cased(odd, Casing.TITLE) == "Ab\tCd\u2003Ef\u00a0gh\u2003Ij\x1cKl"
    assert spark.createDataFrame([(odd,)], "v string").select(S.cased(F.col("v"), Casing.TITLE)).first()[0] == S.py_cased(odd, Casing.TITLE)


def test_program_text_and_json():
    p = Program((Constant("x"), split_split_substr(0, "(", 0, ",", 1, 1, -1, Casing.UPPER)))
    assert Program.from_json(p.to_json()) == p and p.complexity == 2 and p.columns == {0}
    assert Program().apply(ROW) == "" and str(Program()) == "<identity>" and Program().constant


def test_columns_and_python_agree(spark):
    rng = random.Random(7)
    text = lambda: "".join(rng.choice("aB ,(.\\$-é\t1") for _ in range(rng.randrange(12)))
    rows = [(i, [text() for _ in range(3)]) for i in range(200)]

    def op():
        start, length, casing = rng.randrange(-5, 8), rng.choice([-1, 0, 1, 3]), rng.choice(list(Casing))
        seps = rng.sample([",", "(", ".", "\\", "$", " ", ", "], 2)
        return rng.choice([Constant(text()), substr(rng.randrange(4), start, length, casing), split_substr(rng.randrange(3), seps[0], rng.randrange(-2, 3), start, length, casing), split_split_substr(rng.randrange(3), seps[0], rng.randrange(2), seps[1], rng.randrange(2), start, length, casing)])

    programs = [Program(tuple(op() for _ in range(rng.randrange(4)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "_rid long, _cells array<string>")
    got = {r["_rid"]: r for r in df.select("_rid", *[p.to_column().alias(f"p{i}") for i, p in enumerate(programs)]).collect()}
    for rid, cells in rows:
        for i, p in enumerate(programs):
            assert got[rid][f"p{i}"] == p.apply(cells), (cells, str(p))
