import os
import uuid

import pytest
from frames import by
from pyspark import TaskContext
from pyspark.sql import functions as F

from moundworks.operators import generation
from moundworks.operators.generation import Manners, Overloaded
from moundworks.sources import store


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def sleep(self, seconds):
        self.slept.append(round(seconds, 6))
        self.now += seconds

    def manners(self, **how):
        return Manners(sleep=self.sleep, clock=lambda: self.now, **how)


def test_growing_waits_and_giving_up():
    clock, calls = Clock(), []

    def busy(prompts):
        calls.append(list(prompts))
        raise Overloaded

    assert generation.ask(busy, ["a", "b"], clock.manners()) == [(None, generation.GAVE_UP, 3)] * 2
    assert calls == [["a", "b"]] * 3 and clock.slept == [5.0, 10.0]

    def better(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise Overloaded
        return prompts.str.upper()

    calls.clear()
    assert generation.ask(better, ["a"], clock.manners()) == [("A", None, 3)]


def test_one_bad_prompt_costs_no_other_its_answer():
    def writer(prompts):
        if (prompts == "b").any():
            raise ValueError("no text for b")
        return prompts.str.upper()

    got = generation.ask(writer, ["a", None, "b", "c"], Clock().manners())
    assert got == [("A", None, 2), (None, None, 0), (None, "ValueError: no text for b", 2), ("C", None, 2)]
    short = generation.ask(lambda prompts: ["x"], ["a", "b"], Clock().manners())
    assert [t for t, _, _ in short] == ["x", "x"]


def test_texts_of_no_use_are_asked_for_again():
    calls = []

    def writer(prompts):
        calls.append(list(prompts))
        return ['{"n": 1}' if p == "a" or p == "b" and len(calls) == 2 else "prose" for p in prompts]

    got = generation.ask(writer, ["a", "b", "c"], Clock().manners(useful=generation.is_json_object))
    assert got == [('{"n": 1}', None, 1), ('{"n": 1}', None, 2), ("prose", None, 3)]
    assert calls == [["a", "b", "c"], ["b", "c"], ["c"]]


def test_pacing():
    clock = Clock()
    manners = clock.manners(per_second=2.0)
    bucket = generation.TokenBucket(manners)
    for _ in range(10):
        generation.ask(lambda prompts: prompts, ["a"], manners, bucket)
    assert clock.now == pytest.approx(4.0)  # two at once, then two a second
    free = Clock()
    generation.ask(lambda prompts: prompts, ["a"] * 50, free.manners())
    assert free.slept == []


def asked(folder):
    return sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder))


def counting(folder, fails=None):
    """A writer that leaves a file for each prompt it is asked."""
    def writer(prompts):
        for p in prompts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(p)
            if p == fails:
                raise ValueError("refused")
        return prompts.str.upper()
    return writer


def test_slot_without_a_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, prompt string")
    got = by(generation.generate(df, lambda prompts: prompts.str.upper()), "n")
    assert [got[n].response for n in (1, 2, 3)] == ["A", "B", None]
    plain = df.withColumn("template", F.lit('{"headline": "h"}'))
    assert generation.generate(plain).first().response == '{"headline": "h"}'


def test_a_prompt_is_asked_once_over_rows_and_calls(spark, tmp_path):
    path, folder = store.scratch_path(spark, "answers"), str(tmp_path)
    df = spark.createDataFrame([(k, f"p{k % 5}") for k in range(50)] + [(50, None)], "n int, prompt string")
    got = by(generation.generate_once(df, counting(folder), path), "n")
    assert [got[k].response for k in range(50)] == [f"P{k % 5}" for k in range(50)] and got[50].response is None
    more = df.union(spark.createDataFrame([(51, "q")], "n int, prompt string"))
    got = by(generation.generate_once(more, counting(folder), path), "n")
    assert got[51].response == "Q" and got[7].response == "P2" and len(got) == 52
    assert asked(folder) == ["p0", "p1", "p2", "p3", "p4", "q"]
    assert generation.generate_once(df.limit(0), counting(folder), path).count() == 0


def test_errors_are_kept_and_asked_again(spark, tmp_path):
    path, folder = store.scratch_path(spark, "answers"), str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, prompt string").coalesce(1)
    got = by(generation.generate_once(df, counting(folder, fails="b"), path), "n")
    assert got[1].response == "A" and got[2].response is None and got[2].response_error == "ValueError: refused"
    asked_before = len(asked(folder))
    still = by(generation.generate_once(df, counting(folder), path, again=False), "n")
    assert still[2].response_error == "ValueError: refused" and len(asked(folder)) == asked_before
    got = by(generation.generate_once(df, counting(folder), path), "n")
    assert got[2].response == "B" and got[2].response_error is None and asked(folder)[asked_before:] == ["b"]


def test_a_repeated_task_and_a_stopped_job_ask_nothing_twice(spark, tmp_path):
    path, folder = store.scratch_path(spark, "answers"), str(tmp_path)
    df = spark.createDataFrame([(k, f"p{k}") for k in range(20)], "n int, prompt string").coalesce(1)
    plain = counting(folder)

    def dies(prompts):
        if len(os.listdir(folder)) >= 12:
            os._exit(1)  # the worker is gone, as with a lost executor
        return plain(prompts)

    with pytest.raises(Exception, match="crash|exit|SparkException|Job aborted|EOF"):
        generation.generate_once(df, dies, path, manners=Manners(batch=4))
    assert len(asked(folder)) == 12
    got = generation.generate_once(df, plain, path, manners=Manners(batch=4)).collect()
    assert sorted(r.response for r in got) == sorted(f"P{k}" for k in range(20))
    assert asked(folder) == sorted(f"p{k}" for k in range(20))


def test_an_earlier_attempt_is_read_and_a_cut_line_left_out(tmp_path):
    fs, root = store.open_folder(f"file://{tmp_path}")
    (tmp_path / "x.json").write_text('{"prompt_digest": "d", "response": "A", "error": null, "tries": 1}\n{"prompt_di')
    assert generation._told(fs, root) == {"d": {"prompt_digest": "d", "response": "A", "error": None, "tries": 1}}
    assert TaskContext.get() is None
