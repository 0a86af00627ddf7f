"""The rules of fetching politely, apart from any network: when to try again, how long to wait, what to accept.

Requests go out one at a time, outside the engine; what they bring is a table (url, html) or binary files.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

RETRYABLE = frozenset({408, 425, 429, 500, 502, 503, 504})
LONGEST, FIRST = 30.0, 1.5


def wait_before_retry(attempt: int, retry_after: str | None = None) -> float:
    """Seconds: what the server asks for, else doubling from FIRST up to LONGEST."""
    try:
        asked = float(retry_after or 0)
    except ValueError:
        asked = 0.0
    return asked if 0 < asked < float("inf") else min(LONGEST, FIRST * 2**attempt)


@dataclass
class Gate:
    """Lets one request pass each `delay` seconds."""

    delay: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    free_at: float = 0.0

    def __call__(self) -> None:
        now = self.clock()
        wait = max(0.0, self.free_at - now)
        self.free_at = max(now, self.free_at) + self.delay
        if wait:
            self.sleep(wait)


def polite(request: Callable[[], tuple[int, dict[str, str], bytes]], gate: Gate, retries: int, expect: str | None = None, most_bytes: int | None = None) -> dict:
    """{status, body, bytes, content_type, failed}: request() until it succeeds, at most retries times more.

    Over most_bytes, declared or actual, the body is dropped and failed is "too-large".
    """
    last = ""
    for attempt in range(retries + 1):
        gate()
        try:
            status, headers, body = request()
        except OSError as e:
            last = str(e)
            if attempt < retries:
                gate.sleep(wait_before_retry(attempt))
            continue
        headers = {k.lower(): v for k, v in headers.items()}
        if status in RETRYABLE:
            last = f"HTTP {status}"
            if attempt < retries:
                gate.sleep(wait_before_retry(attempt, headers.get("retry-after")))
            continue
        kind = headers.get("content-type", "")
        row = {"status": status, "body": None, "bytes": len(body), "content_type": kind, "failed": None}
        if not 200 <= status < 300:
            return row | {"failed": f"HTTP {status}"}
        if expect and expect not in kind:
            return row | {"failed": f"expected {expect}, got {kind!r}"}
        declared = headers.get("content-length", "")
        size = max(int(declared) if declared.isdigit() else 0, len(body))
        return row | ({"bytes": size, "failed": "too-large"} if most_bytes is not None and size > most_bytes else {"body": body})
    return {"status": None, "body": None, "bytes": 0, "content_type": "", "failed": f"gave up after {retries + 1} attempts: {last}"}
