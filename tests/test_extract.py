import threading
import time

from siftwell.operators import extract as E


def test_chain_over_sentences(spark):
    rows = [
        (1, "Stars form early (Smith et al. 2010; Lee and Wu, 1999a) in discs."), (2, "No citation stands here."), (3, "fragment without end"), (4, None), (5, ""),
        (6, "One (Müller 2001) and two (Kim 2002)."),
    ]
    d = spark.createDataFrame(rows, "id int, sentence string").selectExpr("*", "'old' AS trace", "'old' AS valid")
    got = {r["id"]: r for r in E.chain(d, E.citation_steps()).collect()}
    assert got[1]["substrings"] == ["(Smith et al. 2010; Lee and Wu, 1999a)"] and got[1]["masked"] == "Stars form early [REF] in discs."
    assert [tuple(c) for c in got[1]["citations"]] == [("Smith et al.", "2010"), ("Lee and Wu", "1999a")]
    assert got[2]["valid"] and got[2]["substrings"] == [] and got[2]["citations"] is None and got[2]["masked"] is None
    assert [got[i]["valid"] for i in (3, 4, 5)] == [False, False, False]
    assert got[3]["trace"] == ["valid: ok", "substrings: skipped", "citations: skipped", "masked: skipped"]
    assert got[6]["masked"] == "One [REF] and two [REF]." and len(got) == 6


def test_slow_and_failing_calls_leave_null(spark):
    def make():
        def call(state):
            if state["id"] % 5 == 1:
                time.sleep(30)
            if state["id"] % 5 == 2:
                raise RuntimeError("model is gone")
            return {"twice": state["id"] * 2, "of": state["xs"]}

        return call

    d = spark.range(20).selectExpr("CAST(id AS int) AS id", "array(1, CAST(id AS int)) AS xs").coalesce(1)
    began = time.time()
    rows = {r["id"]: r for r in E.structured(d, make, "answer", "struct<twice:int,of:array<int>>", timeout=0.5, concurrency=4).collect()}
    assert time.time() - began < 25
    for i, r in rows.items():
        if i % 5 in (1, 2):
            assert r["answer"] is None and r["trace"] == ["answer: timeout" if i % 5 == 1 else "answer: error: RuntimeError"]
        else:
            assert (r["answer"]["twice"], r["answer"]["of"]) == (2 * i, [1, i]) and r["trace"] == ["answer: ok"]
    assert len(rows) == 20


def test_calls_run_side_by_side_but_not_more(spark):
    def make():
        lock, state = threading.Lock(), {"now": 0, "most": 0}

        def call(row):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.05)
            with lock:
                state["now"] -= 1
                return state["most"]

        return call

    d = spark.range(40).coalesce(1)
    most = max(r["m"] for r in E.structured(d, make, "m", "int", concurrency=5).collect())
    assert 2 <= most <= 5
    assert E.structured(d.filter("false"), make, "m", "int").count() == 0


def test_masking():
    assert E.masked("a (B 1) c", [" (B 1) "]) == "a[REF]c" and E.masked("a (B 1)", [" (B 1) "]) == "a [REF]" and E.masked("a B c B", ["B"]) == "a [REF] c [REF]" and E.masked("a", ["", "zz"]) == "a"


def test_threads_are_not_made_for_each_call(monkeypatch):
    """Calls run in the threads that hold the rows; a late one costs one thread more, and its row goes on."""
    started = []
    start = threading.Thread.start
    monkeypatch.setattr(threading.Thread, "start", lambda self: (started.append(self), start(self))[1])
    slow = threading.Event()
    steps = [E.Step("a", lambda: lambda s: slow.wait(20) if s["id"] == 7 else s["id"], "int"), E.Step("b", lambda: lambda s: (s["a"] or 0) + 1, "int")]
    rows = E._Rows(steps, 0.5, 4)
    for _ in range(3):
        done = rows([{"id": i} for i in range(500)] if not started else [{"id": i} for i in range(100, 300)])
    assert len(started) <= 3 * 4 + 1 and [d["b"] for d in done] == list(range(101, 301))
    late = E._Rows(steps, 0.3, 2)([{"id": 6}, {"id": 7}, {"id": 8}])
    assert [(d["a"], d["b"], d["trace"]) for d in late] == [(6, 7, ["a: ok", "b: ok"]), (None, 1, ["a: timeout", "b: ok"]), (8, 9, ["a: ok", "b: ok"])]
    slow.set()


def test_long_lines_are_judged_in_linear_time():
    valid = E.citation_steps()[0].make()
    began = time.time()
    assert not valid({"sentence": "word. " * 20_000 + "end"}) and valid({"sentence": "word " * 20_000 + "end?\n "})
    assert time.time() - began < 5
    assert [valid({"sentence": s}) for s in ("a.", ".a", "1.", "A 1 ! \n", "é.", None, "", ".", "a.\nb")] == [True, False, False, True, False, False, False, False, False]
