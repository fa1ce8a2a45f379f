from __future__ import annotations

from itertools import permutations

import pytest

from ballast import merge_incumbent, solution_report, write_report
from ballast.operators.incumbent import is_halted

SOLUTIONS = "key BIGINT, tie_id BIGINT, status STRING, objective BIGINT"

CASES = {
    "status order": ([("infeasible", None), ("feasible", 5), ("optimal", 9)], "max", ("optimal", 9)),
    "least": ([("infeasible", None), ("feasible", 5), ("optimal", 9)], "min", ("feasible", 5)),
    "error wins": ([("error", None), ("optimal", 2)], "max", ("error", None)),
    "unbounded wins": ([("feasible", 8), ("unbounded", None), ("feasible", 9)], "max", ("unbounded", None)),
    "nothing found": ([("infeasible", None), ("infeasible", 7)], "max", ("infeasible", None)),
}


def test_best_of_each_key_in_any_order(spark):
    rows, expected, key = [], {}, 0
    for sense in ("max", "min"):
        for solutions, wanted, winner in CASES.values():
            if wanted == sense:
                for order in permutations(enumerate(solutions)):
                    rows += [(key, tie, *solution, sense) for tie, solution in order]
                    expected[key] = winner
                    key += 1
    table = spark.createDataFrame(rows, SOLUTIONS + ", sense STRING")
    for sense in ("max", "min"):
        for r in merge_incumbent(table.where(f"sense = '{sense}'"), "key", sense).collect():
            assert (r.status, r.objective) == expected[r.key]
            assert r.halted == (r.status in ("error", "unbounded"))


def test_ties_go_to_the_lowest(spark):
    rows = [(1, 7, "feasible", 5), (1, 3, "optimal", 5), (1, 4, "feasible", 5)]
    assert merge_incumbent(spark.createDataFrame(rows, SOLUTIONS), "key").first().tie_id == 3


def test_halt_flag(spark):
    calm = spark.createDataFrame([(1, 1, "feasible", 1)], SOLUTIONS)
    assert not is_halted(calm).first().halted
    assert not is_halted(calm.where("false")).first().halted
    assert is_halted(calm.unionByName(spark.createDataFrame([(2, 1, "unbounded", None)], SOLUTIONS))).first().halted


def test_unknown_sense_is_refused(spark):
    with pytest.raises(ValueError):
        merge_incumbent(spark.createDataFrame([(1, 1, "feasible", 1)], SOLUTIONS), "key", "most")


def test_report_and_its_file(spark, tmp_path):
    best = [(1, "feasible", 5), (2, "feasible", 6), (3, "infeasible", None), (4, "error", None), (5, "unbounded", None)]
    incumbent = spark.createDataFrame(best, "instance_id BIGINT, status STRING, objective BIGINT")
    open_counts = spark.createDataFrame([(2, 3)], "instance_id BIGINT, n_open BIGINT")
    report = solution_report(incumbent, open_counts)
    path = str(tmp_path / "report")
    write_report(report, path)
    found = {r.instance_id: (r.status, r.objective, r.n_open) for r in spark.read.parquet(path).collect()}
    assert found == {
        1: ("optimal", 5, 0),
        2: ("feasible", 6, 3),
        3: ("infeasible", None, 0),
        4: ("error", None, 0),
        5: ("unbounded", None, 0),
    }
