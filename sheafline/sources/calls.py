"""Calls to a service from within tasks: many at a time, up to a limit, retried after a while, results in order."""

from __future__ import annotations

import asyncio
import inspect
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush
from itertools import count
from queue import Empty, SimpleQueue
from threading import Thread
from typing import Any

#: What a call may fail by and be tried again: transport, timeouts, and replies that are not as expected.
FAILURES = (OSError, TimeoutError, asyncio.TimeoutError, KeyError, IndexError, TypeError, ValueError)


@dataclass(frozen=True)
class Policy:
    """How a task calls: requests in flight, tries for each, seconds before the next try (doubled each time) and seconds
    after which a try is given up (None: never)."""

    in_flight: int = 8
    tries: int = 2
    delay: float = 0.5
    timeout: float | None = 120.0


@dataclass(frozen=True)
class Outcome:
    """The last reply that came, and what became of the call: an accepted value, or None with what went wrong."""

    value: Any
    replies: list
    calls: int
    latency_ms: int
    errors: list[str]


async def _tried(send: Callable[[Any], Any], payload: Any, accept: Callable[[Any], Any], policy: Policy, gate: asyncio.Semaphore) -> Outcome:
    errors, replies, began = [], [], time.perf_counter()
    for k in range(policy.tries):
        if k and policy.delay:
            await asyncio.sleep(policy.delay * 2 ** (k - 1))
        try:
            async with gate:  # a call that waits for its next try is not in flight
                reply = await asyncio.wait_for(send(payload), policy.timeout)
            replies.append(reply)
            return Outcome(accept(reply), replies, k + 1, round((time.perf_counter() - began) * 1000), [])
        except FAILURES as e:
            errors.append(f"{type(e).__name__}: {e}")
    return Outcome(None, replies, policy.tries, round((time.perf_counter() - began) * 1000), errors)


def in_order(payloads: Iterable[tuple[Any, Any]], post: Callable[[Any], Any], accept: Callable[[Any, Any], Any], policy: Policy = Policy()) -> Iterator[tuple[Any, Outcome]]:
    """(item, outcome) for each (item, payload), in their order. `post` may be a coroutine function or a plain one, which
    then runs in as many threads as there are requests in flight (and `accept` with it). At most policy.in_flight requests
    are open, and at most four times as many items are held, so that a slow call does not stop those behind it; payloads are
    taken as needed."""
    return (_by_loop if inspect.iscoroutinefunction(post) else _by_threads)(payloads, post, accept, policy)


def _by_loop(payloads, post, accept, policy: Policy) -> Iterator[tuple[Any, Outcome]]:
    """in_order for coroutine functions."""
    loop, gate, waiting = asyncio.new_event_loop(), asyncio.Semaphore(policy.in_flight), deque()

    def first():
        item, task = waiting.popleft()
        return item, loop.run_until_complete(task)

    try:
        for item, payload in payloads:
            waiting.append((item, loop.create_task(_tried(post, payload, lambda reply, item=item: accept(item, reply), policy, gate))))
            if len(waiting) >= 4 * policy.in_flight:
                yield first()
        while waiting:
            yield first()
    finally:
        for _, task in waiting:
            task.cancel()
        if waiting:
            loop.run_until_complete(asyncio.gather(*(t for _, t in waiting), return_exceptions=True))
        loop.close()


@dataclass(slots=True)
class _Call:
    """A call by threads: its try (from 0), when the call began and when its try did (None: not yet), and what came of it."""

    item: Any
    payload: Any
    began: float
    k: int = 0
    since: float | None = None
    errors: list[str] = field(default_factory=list)
    replies: list = field(default_factory=list)
    outcome: Outcome | None = None
    fault: BaseException | None = None


def _by_threads(payloads, post, accept, policy: Policy) -> Iterator[tuple[Any, Outcome]]:
    """in_order for plain functions, at a tenth of the time an event loop takes for a call. Threads take tries from one queue
    and put what came of them into another; all else is done here, where the calls are waited for. A try given up goes on in
    its thread, which takes no other before it ends, so that no more requests are open than allowed."""
    todo, ended, later, number = SimpleQueue(), SimpleQueue(), [], count()
    waiting: deque[_Call] = deque()
    threads: list[Thread] = []

    def work():
        while (job := todo.get()) is not None:
            call, k = job
            call.since = time.perf_counter()
            replies, value, error = [], None, None
            try:
                replies.append(post(call.payload))
                value = accept(call.item, replies[0])
            except BaseException as e:  # raised again where the call is waited for
                error = e
            ended.put((call, k, replies, value, error))

    def outcome(call: _Call, value, errors: list[str]) -> Outcome:
        return Outcome(value, call.replies, min(call.k + 1, policy.tries), round((time.perf_counter() - call.began) * 1000), errors)

    def failed(call: _Call, error: BaseException) -> None:
        call.errors.append(f"{type(error).__name__}: {error}")
        call.k, call.since = call.k + 1, None
        if call.k >= policy.tries:
            call.outcome = outcome(call, None, call.errors)
        elif policy.delay:
            heappush(later, (time.perf_counter() + policy.delay * 2 ** (call.k - 1), next(number), call))
        else:
            todo.put((call, call.k))

    def settle(call: _Call, k: int, replies: list, value, error: BaseException | None) -> None:
        if call.k != k:
            return  # given up before it ended
        call.replies += replies
        if error is None:
            call.outcome = outcome(call, value, [])
        elif isinstance(error, FAILURES):
            failed(call, error)
        else:
            call.fault = error

    def turn() -> None:
        """Waits until a try ends, is to begin again or has taken too long."""
        now, wait = time.perf_counter(), policy.timeout
        while later and later[0][0] <= now:
            _, _, call = heappop(later)
            todo.put((call, call.k))
        if policy.timeout is not None:
            for call in waiting:
                if call.since is not None and call.outcome is None and call.fault is None:
                    if (left := call.since + policy.timeout - now) <= 0:
                        failed(call, TimeoutError())
                        return
                    wait = min(wait, left)
        if later:
            wait = later[0][0] - now if wait is None else min(wait, later[0][0] - now)
        try:
            settle(*ended.get(timeout=wait))
            while True:
                settle(*ended.get_nowait())
        except Empty:
            pass

    def first() -> tuple[Any, Outcome]:
        call = waiting[0]
        while call.outcome is None:
            if call.fault is not None:
                raise call.fault
            turn()
        return waiting.popleft().item, call.outcome

    try:
        for item, payload in payloads:
            waiting.append(_Call(item, payload, time.perf_counter()))
            todo.put((waiting[-1], 0))
            if len(threads) < policy.in_flight:
                threads.append(Thread(target=work, daemon=True))
                threads[-1].start()
            if len(waiting) >= 4 * policy.in_flight:
                yield first()
        while waiting:
            yield first()
    finally:
        try:
            while True:
                todo.get_nowait()
        except Empty:
            pass
        for _ in threads:
            todo.put(None)
        for t in threads:
            t.join()
