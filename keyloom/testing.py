"""Faults for tests: a Store calls its hook at named points of a commit, a checkpoint and a vacuum."""

from __future__ import annotations

import os
import random
import time
from collections import Counter
from collections.abc import Callable

Action = Callable[[], object]


def raises(error: Callable[[], BaseException] = lambda: OSError("injected")) -> Action:
    def act():
        raise error()

    return act


def sleeps(seconds: float) -> Action:
    return lambda: time.sleep(seconds)


def exits(code: int = 1) -> Action:
    """Ends the process at once, as a crash would: nothing is flushed or released."""
    return lambda: os._exit(code)


class Faults:
    """Acts at chosen points and counts hits. arm(point, action, after=n): from the n-th next hit on,
    with the probability given; an action is any call: raises(), sleeps(), exits() or one's own."""

    def __init__(self, seed: int = 0):
        self.hits, self.armed, self.random = Counter(), {}, random.Random(seed)

    def arm(self, point: str, action: Action, after: int = 1, probability: float = 1.0) -> None:
        self.armed[point] = [after, probability, action]

    def fail(self, point: str, after: int = 1, error: Callable[[], BaseException] = lambda: OSError("injected")) -> None:
        self.arm(point, raises(error), after)

    def fail_sometimes(self, point: str, probability: float, error: Callable[[], BaseException] = lambda: OSError("injected")) -> None:
        self.arm(point, raises(error), 1, probability)

    def disable(self, *points: str) -> None:
        for p in points or list(self.armed):
            self.armed.pop(p, None)

    def reset(self) -> None:
        self.disable()
        self.hits.clear()

    def list(self) -> list[str]:
        return sorted(self.armed)

    def select(self, points: list[str]) -> str:
        """One of the points, by the seed."""
        return self.random.choice(points)

    def __call__(self, point: str) -> None:
        self.hits[point] += 1
        if point in self.armed:
            self.armed[point][0] -= 1
            left, probability, action = self.armed[point]
            if left <= 0 and self.random.random() < probability:
                action()


_REGISTRY: dict[str, Faults] = {}


def faults(name: str, seed: int = 0) -> Faults:
    """The faults registered under a name, so that several stores of a test share them."""
    return _REGISTRY.setdefault(name, Faults(seed))
