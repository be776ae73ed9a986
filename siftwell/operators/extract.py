"""Calls of a model, row by row: structured answers with a deadline, and chains of calls with conditions between them.

A call is any function of a row that returns plain values; a model client, or an offline rule. The calls of a task run
side by side, `concurrency` rows at a time. A call that fails, or has no answer by its deadline, leaves null and says so; the row goes on.
"""

from __future__ import annotations

import re
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A row, with the answers of the steps before under their names.
State = dict[str, object]
#: Calls past their deadline that may still run in a task: further ones are not begun.
ABANDONED = 64


@dataclass(frozen=True)
class Step:
    """One call. make builds the function in each task (a client is not shipped); kind is a DDL type; rows that `when` refuses skip it."""

    name: str
    make: Callable[[], Callable[[State], object]]
    kind: str
    when: Callable[[State], bool] = lambda state: True


def _plain(value: object) -> object:
    """Rows, arrays and frames' values as lists and dictionaries."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list | tuple) else value


class _Rows:
    """Runs the steps of rows in `concurrency` threads, which make the calls themselves and only note when each began. The task's own thread
    watches the deadlines. A thread cannot be ended from outside: one that is late is left to itself and counted, and its row goes on in another."""

    def __init__(self, steps: list[Step], timeout: float, concurrency: int):
        self.steps, self.made = steps, [s.make() for s in steps]
        self.timeout, self.concurrency, self.late = timeout, concurrency, 0
        self.changed = threading.Condition()

    def __call__(self, states: list[State]) -> list[State]:
        """Each state with its answers and the trace."""
        self.todo = deque((state | {"trace": []}, 0) for state in states)
        self.done: list[State] = [work[0] for work in self.todo]
        self.left, self.problem = len(self.todo), None
        self.begun: dict[threading.Thread, tuple[float, State, int]] = {}
        with self.changed:
            for _ in range(min(self.concurrency, self.left)):
                self._start()
            while self.left and self.problem is None:
                now = time.monotonic()
                for thread, (since, state, at) in list(self.begun.items()):
                    if now - since >= self.timeout:
                        del self.begun[thread]
                        self.late += 1
                        self._answer(state, at, "timeout", None)
                        self.todo.appendleft((state, at + 1))
                        self._start()
                first = min((since for since, _, _ in self.begun.values()), default=now)
                self.changed.wait(max(first + self.timeout - now, 0.001))
        if self.problem is not None:
            raise self.problem
        return self.done

    def _start(self) -> None:
        threading.Thread(target=self._work, args=(self.begun,), daemon=True).start()

    def _answer(self, state: State, at: int, said: str, answer: object) -> None:
        state[self.steps[at].name] = answer
        state["trace"].append(f"{self.steps[at].name}: {said}")

    def _work(self, begun: dict) -> None:
        me = threading.current_thread()
        while True:
            with self.changed:
                if begun is not self.begun or not self.todo or self.problem is not None:
                    return
                state, at = self.todo.popleft()
            try:
                for i in range(at, len(self.steps)):
                    if not self._step(me, begun, state, i):
                        return
            except BaseException as problem:
                with self.changed:
                    self.problem = problem
                    self.changed.notify()
                return
            with self.changed:
                self.left -= 1
                if not self.left:
                    self.changed.notify()

    def _step(self, me: threading.Thread, begun: dict, state: State, at: int) -> bool:
        """Whether the row is still this thread's."""
        if not self.steps[at].when({n: v for n, v in state.items() if n != "trace"}):
            self._answer(state, at, "skipped", None)
            return True
        with self.changed:
            if self.late >= ABANDONED:
                self._answer(state, at, "timeout", None)
                return True
            begun[me] = (time.monotonic(), state, at)
        try:
            said, answer = "ok", _plain(self.made[at]({n: v for n, v in state.items() if n != "trace"}))
        except Exception as problem:
            said, answer = f"error: {type(problem).__name__}", None
        with self.changed:
            if begun.pop(me, None) is None:
                self.late -= 1
                return False
        self._answer(state, at, said, answer)
        return True


def chain(df: DataFrame, steps: list[Step], timeout: float = 300.0, concurrency: int = 8) -> DataFrame:
    """df with a column for each step, null where it was skipped, failed or late, and trace: what became of each ("name: ok", "name: skipped",
    "name: timeout", "name: error: ..."). Steps run one after another on a row; each sees the answers of those before. Columns with
    the name of a step or of trace are replaced."""
    base = df.drop("trace", *[s.name for s in steps])
    added = T.StructType.fromDDL(", ".join([f"`{s.name}` {s.kind}" for s in steps] + ["trace array<string>"]))
    names = base.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows(steps, timeout, concurrency)
        for frame in frames:
            values = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
            done = rows([{n: _plain(v) for n, v in zip(names, row, strict=True)} for row in values])
            yield frame.assign(**{f.name: pd.Series([d[f.name] for d in done], index=frame.index, dtype=object) for f in added.fields})

    return base.mapInPandas(run, T.StructType([*base.schema.fields, *added.fields]))


def structured(df: DataFrame, make: Callable[[], Callable[[State], object]], name: str, kind: str, timeout: float = 300.0, concurrency: int = 8) -> DataFrame:
    """df with the answer of one call in the column name."""
    return chain(df, [Step(name, make, kind)], timeout, concurrency)


# The extraction of citations as a chain. Each step takes any function in the place of the offline rule.

#: Offline rules: a parenthesis that holds a year, and a name with the year behind it.
PARENTHESES, AUTHOR_YEAR = r"\([^()]*\d{4}[a-z]?[^()]*\)", r"([A-Z][^\d;()]*?),? (\d{4}[a-z]?)"
CITATIONS = "array<struct<author:string,year:string>>"


def _rule(pattern: str) -> Callable[[], Callable[[State], object]]:
    return lambda: lambda state: [m[0] for m in re.finditer(pattern, state["sentence"])]


def is_sentence(text: str | None) -> bool:
    """Whether a letter stands somewhere before a last sign that ends a sentence. Looked at from the end: a pattern that tries every letter as
    the first one takes the square of a long line's length."""
    text = (text or "").rstrip()
    return text.endswith((".", "?", "!")) and re.search("[A-Za-z]", text[:-1]) is not None


def masked(sentence: str, substrings: list[str]) -> str:
    """The sentence with each substring replaced by [REF]: as it stands, else without the spaces around it."""
    for s in substrings:
        if s and (s in sentence or s.strip() in sentence):
            sentence = sentence.replace(s if s in sentence else s.strip() or s, "[REF]")
    return sentence


def citation_steps(
    valid: Callable[[], Callable[[State], bool]] | None = None,
    substrings: Callable[[], Callable[[State], list]] | None = None,
    pairs: Callable[[], Callable[[State], list]] | None = None,
) -> list[Step]:
    """Steps over a column sentence: valid, then, for valid ones, the citing substrings, and where there are any the (author, year) pairs and
    the masked sentence."""
    return [
        Step("valid", valid or (lambda: lambda s: is_sentence(s["sentence"])), "boolean"),
        Step("substrings", substrings or _rule(PARENTHESES), "array<string>", lambda s: s["valid"] is True),
        Step("citations", pairs or (lambda: lambda s: [{"author": a.strip(), "year": y} for x in s["substrings"] for a, y in re.findall(AUTHOR_YEAR, x)]), CITATIONS, lambda s: bool(s["substrings"])),
        Step("masked", lambda: lambda s: masked(s["sentence"], s["substrings"]), "string", lambda s: bool(s["substrings"])),
    ]
