"""Calls to a text provider: what follows a failure, and several calls in flight per task.

A rule says what a failed call is followed by: which model and attempt, after how long, or nothing. The window keeps a
bounded number of calls running; a prompt that has to wait stands in a heap of retry times and holds no other one.
"""

from __future__ import annotations

import heapq
import re
import time
from collections import deque
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait as wait_for
from dataclasses import dataclass, field
from typing import Protocol

from adlumen.functions import errors


class TextProvider(Protocol):
    """What a provider offers; it is sent to the tasks, so it must be picklable, and is called from several threads."""

    def generate(self, prompt: str, model: str) -> str:
        """The text for a prompt, or an exception whose message says what went wrong."""


@dataclass(frozen=True)
class Step:
    """The next call for a prompt: number of the model, attempt with it (from 0) and seconds to wait before."""

    model: int
    attempt: int
    delay: float = 0.0


Rule = Callable[[Step, str, int, int], Step | None]
Answer = tuple[str | None, str | None, int, str | None]


def retry_rule(failed: Step, error: str, n_models: int, attempts: int) -> Step | None:
    """Quota errors move on to the next model at once, transient ones wait 2, 4, 8, ... seconds, others are tried again at once."""
    message = error.lower()
    if re.search(errors.QUOTA, message):
        follows, delay = Step(failed.model + 1, 0), 0.0
    else:
        delay = errors.FIRST_WAIT * 2.0 ** failed.attempt if re.search(errors.TRANSIENT, message) else 0.0
        last = failed.attempt + 1 == attempts
        follows = Step(failed.model + 1, 0) if last else Step(failed.model, failed.attempt + 1)
    return Step(follows.model, follows.attempt, delay) if follows.model < n_models else None


def rewrite_rule(failed: Step, error: str, n_models: int, attempts: int) -> Step | None:
    """One call per model, and only quota errors move on to the next model."""
    more = failed.model + 1 < n_models and re.search(errors.REWRITE_QUOTA, error.lower())
    return Step(failed.model + 1, 0) if more else None


@dataclass
class _Prompt:
    """A prompt on its way: texts known per model, the call that is due, and the calls made."""

    place: int
    text: str
    stored: dict[str, str]
    step: Step = Step(0, 0)
    calls: int = 0


@dataclass
class CallWindow:
    """Calls for the prompts of a task, ``in_flight`` at most at a time and at most ``per_second`` started in a second.

    ``clock`` and ``sleep`` can be replaced; sleeping is only done while no call runs and none is due.
    """

    provider: TextProvider
    models: Sequence[str]
    attempts: int = 2
    rule: Rule = retry_rule
    in_flight: int = 4
    per_second: float | None = None
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _next_start: float = field(default=float("-inf"), init=False)

    def answers(self, prompts: Iterable[tuple[str, dict[str, str]]]) -> list[Answer]:
        """``(text, model, calls, error)`` of each prompt, in their order; the last error where every call failed.

        ``prompts`` has the text and what is stored of it per model; a stored text counts as a call and is not asked for.
        """
        waiting = [_Prompt(i, text, stored) for i, (text, stored) in enumerate(prompts)]
        out: list[Answer] = [(None, None, 0, "no model")] * len(waiting)
        ready, later, running = deque(waiting if self.models else ()), [], {}
        with ThreadPoolExecutor(max(1, self.in_flight)) as pool:
            while ready or later or running:
                now = self.clock()
                while later and later[0][0] <= now:
                    ready.append(heapq.heappop(later)[2])
                while ready and len(running) < self.in_flight and now >= self._next_start:
                    prompt = ready.popleft()
                    running[pool.submit(self._call, prompt)] = prompt
                    self._next_start = now + 1 / self.per_second if self.per_second else now
                self._pass_time(ready, later, running, now)
                for done in [f for f in running if f.done()]:
                    self._settle(running.pop(done), done, out, later)
        return out

    def _call(self, prompt: _Prompt) -> str:
        model = self.models[prompt.step.model]
        return prompt.stored[model] if model in prompt.stored else self.provider.generate(prompt.text, model)

    def _pass_time(self, ready: deque, later: list, running: dict, now: float) -> None:
        """Until a call ends, a retry is due or the rate allows the next start, whichever comes first."""
        times = [later[0][0]] if later else []
        if ready and len(running) < self.in_flight:
            times.append(self._next_start)
        due = min(times) - now if times else None
        if running:
            wait_for(running, timeout=due, return_when=FIRST_COMPLETED)
        elif due is not None and due > 0:
            self.sleep(due)
            if self.clock() < now + due:  # a clock that stands still while sleeping
                self._next_start = min(self._next_start, now)
                if later and not ready:
                    ready.append(heapq.heappop(later)[2])

    def _settle(self, prompt: _Prompt, done: Future, out: list[Answer], later: list) -> None:
        prompt.calls += 1
        model = self.models[prompt.step.model]
        failure = done.exception()
        if failure is None:
            out[prompt.place] = done.result().strip(), model, prompt.calls, None
            return
        if not isinstance(failure, Exception):  # an interrupt is no answer of the provider
            raise failure
        error = str(failure)
        follows = self.rule(prompt.step, error, len(self.models), self.attempts)
        if follows is None:
            out[prompt.place] = None, None, prompt.calls, error
            return
        prompt.step = follows
        heapq.heappush(later, (self.clock() + follows.delay, prompt.place, prompt))
