"""The interface to a language model: messages in, text out, with retries. The transport is the caller's; none is built in."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

#: Status codes that are worth another try.
RETRIED = {429, 500, 502, 503, 504}


class TransportError(Exception):
    """A request failed; `status` is None where there was no answer at all."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Message:
    role: str
    content: str


@dataclass
class ChatClient:
    """transport: a dict with messages and options to the answer's text; raises TransportError."""

    transport: Callable[[dict], str]
    model: str = "default"
    tries: int = 3
    wait: Callable[[float], None] = time.sleep

    def chat(self, messages: list[Message], **options) -> str:
        body = {"model": self.model, "messages": [{"role": m.role, "content": m.content} for m in messages], **options}
        for n in range(self.tries):
            try:
                return self.transport(body)
            except TransportError as e:
                if n + 1 == self.tries or (e.status is not None and e.status not in RETRIED):
                    raise
                self.wait(2.0**n)
        raise ValueError("tries must be positive")

    def complete(self, prompt: str, system: str | None = None, **options) -> str:
        return self.chat([*([Message("system", system)] if system else []), Message("user", prompt)], **options)

    def filter_relevance(self, query: str, chunks: list[str], threshold: float = 0.5) -> list[tuple[int, str, float]]:
        """(index, chunk, score) of the chunks that the model scores at the threshold or above; all at 0.5 if it can't be asked.

        For a handful of chunks of one question on the driver; tables of scores go through operators.search.relevance_filter.
        """
        if not chunks:
            return []
        parts = [c[:500] + "..." if len(c) > 500 else c for c in chunks]
        prompt = json.dumps({"query": query, "threshold": threshold, "chunks": parts})
        try:
            found = json.loads(self.complete(prompt, 'Score each chunk\'s relevance to the query from 0 to 1. Answer with JSON: [{"index": 0, "score": 0.5}]', temperature=0.0))
            return [(x["index"], chunks[x["index"]], float(x["score"])) for x in found if x["score"] >= threshold and 0 <= x["index"] < len(chunks)]
        except (TransportError, ValueError, KeyError, TypeError):
            return [(i, c, 0.5) for i, c in enumerate(chunks)]
