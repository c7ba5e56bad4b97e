"""Retries with exponential backoff, for readers that fetch."""

from __future__ import annotations

import random
import time
from collections.abc import Callable


class RetryExhausted(Exception):
    def __init__(self, attempts: int, last_error: Exception):
        super().__init__(f"{attempts} attempts failed: {last_error}")
        self.attempts, self.last_error = attempts, last_error


class FetchError(Exception):
    """A failed request: its status (None: no answer came) and what the server asked to wait."""

    def __init__(self, status: int | None, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def is_retryable(error: Exception) -> bool:
    """No answer, too many requests and server errors may pass; other refusals don't."""
    return isinstance(error, OSError) or (isinstance(error, FetchError) and (error.status is None or error.status == 429 or error.status >= 500))


def with_retry(call: Callable, retryable=is_retryable, attempts: int = 5, base: float = 1.0, longest: float = 60.0, jitter: float = 0.1, sleep=time.sleep):
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if not retryable(e):
                raise
            if n == attempts:
                raise RetryExhausted(n, e) from e
            wait = getattr(e, "retry_after", None)
            sleep(min(base * 2 ** (n - 1), longest) * (1 + random.random() * jitter) if wait is None else wait)
