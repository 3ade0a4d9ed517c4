"""The batch job: steps once, restarts, failures that stay where they are."""

from __future__ import annotations

import pytest

from trendspan.operators import job
from trendspan.operators import ranking as rk


def report(df):
    return {r.step: (r.status, r.rows) for r in df.collect()}


def test_a_job_goes_on_where_it_broke_off(spark, tmp_path):
    ran, broken = [], {"snapshot": True, "videos": True}

    def step(name, n, required=True, needs=()):
        def work(s, tables):
            ran.append(name)
            if broken.get(name):
                raise ValueError(f"{name} broke")
            return s.range(n) if not needs else tables[needs[0]].limit(n)

        return job.Step(name, work, needs, required)

    steps = [step("first", 2), step("videos", 3, False), step("shown", 1, False, ("videos",)), step("snapshot", 4), step("retention", 1, False, ("snapshot",))]
    with pytest.raises(job.JobFailed, match="snapshot broke"):
        job.run(spark, str(tmp_path), "day", steps)
    assert ran == ["first", "videos", "snapshot"]
    broken["snapshot"] = False
    assert report(job.run(spark, str(tmp_path), "day", steps)) == {"first": ("reused", 2), "videos": ("failed", None), "shown": ("skipped", None), "snapshot": ("done", 4), "retention": ("done", 1)}
    broken["videos"] = False
    ran.clear()
    assert report(job.run(spark, str(tmp_path), "day", steps)) == {"first": ("reused", 2), "videos": ("done", 3), "shown": ("done", 1), "snapshot": ("reused", 4), "retention": ("reused", 1)}
    assert ran == ["videos", "shown"]
    assert report(job.run(spark, str(tmp_path), "next day", steps))["first"] == ("done", 2)


def test_the_first_entry_of_a_step_stays(spark, tmp_path):
    ledger = job.Ledger(spark, str(tmp_path), "r")
    ledger.commit("s", {"rows": 1})
    ledger.commit("s", {"rows": 2})
    assert ledger.entry("s") == {"rows": 1} and ledger.entry("t") is None


def test_replay(spark):
    axes = ("recency", "frequency", "authority", "velocity", "engagement")
    weights = dict.fromkeys(axes, 0.2)
    rows = [("a", 1.0, 1, *[1.0] * 5), ("b", 0.5, 2, *[0.2] * 5), ("c", 0.4, 3, *[0.4] * 5)]
    df = spark.createDataFrame(rows, "keyword_id string, total double, rank int, " + ", ".join(f"{a} double" for a in axes))
    assert tuple(rk.replay(df, weights).first()) == (3, 2, 1, "b,c")


def test_valid_ids(spark):
    rows = [("r", k, i) for k, i in enumerate([" b ", "a", "b", "no space in", "", None, *(f"x{n}" for n in range(30))])]
    got = rk.valid_ids(spark.createDataFrame(rows, "request string, at int, id string"), ["request"], "at").orderBy("place").collect()
    assert [r.id for r in got] == ["b", "a", *(f"x{n}" for n in range(18))]
