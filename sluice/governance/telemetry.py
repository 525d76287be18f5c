"""Spans of tool and model calls, kept in a bounded buffer: what doesn't fit is counted, never waited for."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Telemetry:
    """``most`` spans wait for an exporter; while they do, new ones are dropped and ``dropped`` goes up. Statements, questions
    and rows are no attributes: a span says how a call went, not what was in it."""

    most: int = 1000
    spans: deque[dict] = field(default_factory=deque)
    dropped: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock)

    @contextmanager
    def span(self, kind: str, trace: str = "", **attributes) -> Iterator[dict]:
        """A span of what runs inside; what is set in the yielded dict becomes attributes. An exception is marked and goes on."""
        own = dict(attributes)
        began = time.monotonic()
        try:
            yield own
        except BaseException as e:
            own["error.type"] = type(e).__name__
            raise
        finally:
            self._keep({"kind": kind, "trace": trace, "duration_ms": round((time.monotonic() - began) * 1000, 3), "attributes": own})

    def model(self, provider: Callable[[str], str], name: str, trace: str = "") -> Callable[[str], str]:
        """A provider of answers whose calls are spans, with the model's name and the sizes of prompt and answer."""

        def answer(prompt: str) -> str:
            with self.span("model", trace, **{"model.name": name, "prompt.chars": len(prompt)}) as own:
                found = provider(prompt)
                own["answer.chars"] = len(found)
                return found

        return answer

    def _keep(self, span: dict) -> None:
        with self.lock:
            if len(self.spans) >= self.most:
                self.dropped += 1
            else:
                self.spans.append(span)

    def drain(self) -> tuple[list[dict], int]:
        """The spans that wait and how many were dropped since the last call."""
        with self.lock:
            out, lost = list(self.spans), self.dropped
            self.spans.clear()
            self.dropped = 0
            return out, lost
