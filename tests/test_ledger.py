"""Model answers that survive a stopped run."""

import os

import pytest

from colscope.operators import ledger
from colscope.plans import flows

SCHEMA = "id long, prompt string"


def counting_model(folder, die=None):
    """Writes a file per call; ends its worker at the prompt ``die`` while the trap is set."""
    def model(prompt):
        name = "none" if prompt is None else f"p{prompt}"
        with open(f"{folder}/{name}", "a") as calls:
            calls.write("x")
        if prompt == die and os.path.exists(f"{folder}.trap"):
            os._exit(1)
        if prompt == "bad" and not os.path.exists(f"{folder}.mended"):
            raise RuntimeError("down")
        return {"content": f"<{prompt}>", "tokens": 2, "model": "m"}
    return model


def calls(folder):
    return {f: os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)}


def test_lost_worker_repeats_one_commit(spark, tmp_path):
    folder, kept = str(tmp_path / "calls"), str(tmp_path / "ledger")
    os.mkdir(folder)
    open(f"{folder}.trap", "w").close()
    df = spark.createDataFrame([(i, str(i)) for i in range(400)], SCHEMA)
    model = counting_model(folder, die="7")
    with pytest.raises(Exception):
        ledger.answer_once(df, model, kept, unit=10, units=4)
    done = {r.raw_response for r in spark.read.parquet(kept).collect()}
    os.remove(f"{folder}.trap")
    got = ledger.answer_once(df, model, kept, unit=10, units=4).collect()
    assert len(got) == 400 and all(r.raw_response == f"<{r.id}>" and r.status == "success" for r in got)
    again = {name for name, n in calls(folder).items() if n > 1}
    assert len(calls(folder)) == 400 and not {f"p{x.strip('<>')}" for x in done} & again and len(again) <= 80
    before = calls(folder)
    assert ledger.answer_once(df, model, kept, unit=10, units=4).count() == 400 and calls(folder) == before


def test_equal_prompts_are_one_call_and_failures_are_asked_again(spark, tmp_path):
    folder, kept = str(tmp_path / "calls"), str(tmp_path / "ledger")
    os.mkdir(folder)
    rows = [(i, "same") for i in range(300)] + [(300, "bad"), (301, None), (302, ""), (302, ""), (None, "x" * 200_000 + "!")]
    rows = [(i, p if p is None or len(p) < 100 else "long") for i, p in rows]
    df, model = spark.createDataFrame(rows, SCHEMA), counting_model(folder)
    got = ledger.answer_once(df, model, kept, retries=2).collect()
    assert len(got) == len(rows) and calls(folder) == {"psame": 1, "pbad": 2, "none": 1, "p": 1, "plong": 1}
    assert {r.status for r in got if r.prompt == "bad"} == {"failed"}
    ledger.answer_once(df, model, kept, retries=2, retry_failed=False).collect()
    assert calls(folder)["pbad"] == 2
    open(f"{folder}.mended", "w").close()
    got = ledger.answer_once(df, model, kept, retries=2).collect()
    assert len(got) == len(rows) and {r.status for r in got} == {"success"} and calls(folder)["pbad"] == 3
    other = ledger.answer_once(df, model, kept, stage="other").collect()
    assert len(other) == len(rows) and calls(folder)["psame"] == 2 and {r.stage for r in other} == {"other"}
    assert ledger.answer_once(df.where("false"), model, kept).count() == 0


def test_stage_with_a_ledger(spark, tmp_path):
    df = spark.createDataFrame([(1, "q1", "c"), (2, "q2", "c")], "test_case_id long, query string, cols string")
    model = lambda prompt: {"content": '{"code": "1"}', "tokens": 1, "model": "m"}
    plain = flows.run_stage(df, "code_generation", model)
    kept = flows.run_stage(df, "code_generation", model, ledger=str(tmp_path / "ledger"))
    assert set(kept.columns) == set(plain.columns)
    shown = ["test_case_id", "prompt", "stage", "raw_response", "valid", "data"]
    assert sorted(map(tuple, kept.select(shown).collect())) == sorted(map(tuple, plain.select(shown).collect()))
