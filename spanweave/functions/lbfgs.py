"""Limited-memory quasi-Newton minimisation for small dense problems (a model of one group, or on the driver)."""

from __future__ import annotations

from collections.abc import Callable, Generator, Hashable

import numpy as np

Valued = tuple[float, np.ndarray]


def minimize(fun: Callable[[np.ndarray], Valued], start: np.ndarray, rounds: int = 100, memory: int = 8, tolerance: float = 1e-6) -> np.ndarray:
    """A point where ``fun``, which gives value and gradient, is least. The search direction comes from the last
    ``memory`` steps; steps are halved until they lower the value enough."""
    return minimize_together(lambda at: {0: fun(at[0])}, {0: start}, rounds, memory, tolerance)[0]


def minimize_together(fun: Callable[[dict], dict], starts: dict[Hashable, np.ndarray], rounds: int = 100, memory: int = 8, tolerance: float = 1e-6) -> dict[Hashable, np.ndarray]:
    """Several problems by name, each as ``minimize`` solves it. ``fun`` gets the points of all that go on and gives
    their values and gradients, so that one pass over the data serves them all."""
    runs = {k: _search(x, rounds, memory, tolerance) for k, x in starts.items()}
    at, found = {k: next(run) for k, run in runs.items()}, {}
    while at:
        got, asked = fun(at), {}
        for k in at:
            try:
                asked[k] = runs[k].send(got[k])
            except StopIteration as end:
                found[k] = end.value
        at = asked
    return found


def _search(start: np.ndarray, rounds: int, memory: int, tolerance: float) -> Generator[np.ndarray, Valued, np.ndarray]:
    """Yields points, is sent value and gradient of each, and returns the least."""
    x = np.asarray(start, float).copy()
    value, grad = yield x
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.linalg.norm(grad) <= tolerance * max(1.0, np.linalg.norm(x)):
            break
        direction, kept = -grad, []
        for s, y, rho in reversed(steps):
            kept.append(rho * (s @ direction))
            direction = direction - kept[-1] * y
        if steps:
            s, y, _ = steps[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction / max(1.0, np.linalg.norm(grad))
        for (s, y, rho), a in zip(steps, reversed(kept), strict=True):
            direction = direction + (a - rho * (y @ direction)) * s
        slope = grad @ direction
        if slope >= 0:
            direction, slope, steps = -grad, -(grad @ grad), []
        rate = 1.0
        for _ in range(40):
            new = x + rate * direction
            new_value, new_grad = yield new
            if np.isfinite(new_value) and new_value <= value + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            steps = [*steps[-(memory - 1) :], (s, y, 1 / (s @ y))] if memory > 1 else [(s, y, 1 / (s @ y))]
        done = value - new_value <= 1e-10 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x
