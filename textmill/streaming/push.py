"""Delivery by push: pages go out in order, at least once; what the receiver confirms is acknowledged and evicted."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.error import HTTPError
from urllib.request import Request, urlopen

log = logging.getLogger(__name__)

MOST_RETRY_AFTER_S, SNIPPET_BYTES = 3600.0, 300

#: Sends a body; gives the status, the Retry-After header or "", and the reply's body. Raises OSError if it can't.
Transport = Callable[[bytes], tuple[int, str, bytes]]


#: Bytes of a reply that are read.
REPLY_BYTES = 64 << 10


def http_transport(url: str, api_key: str = "", timeout_s: float = 10.0) -> Transport:
    """Posts a page as JSON, with the key as a bearer token. Replies of any status are replies; OSError means none came."""

    def send(body: bytes) -> tuple[int, str, bytes]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
        try:
            with urlopen(Request(url, body, headers, method="POST"), timeout=timeout_s) as reply:
                return reply.status, reply.headers.get("Retry-After") or "", reply.read(REPLY_BYTES)
        except HTTPError as e:
            with e:
                return e.code, e.headers.get("Retry-After") or "", e.read(REPLY_BYTES)

    return send


class DeliveryFailure(Exception):
    def __init__(self, kind: str, detail: str = "", retry_after: float = 0.0, our_fault: bool = False):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind, self.detail, self.retry_after, self.our_fault = kind, detail, retry_after, our_fault


@dataclass(frozen=True)
class Page:
    """chunks: records as dicts with seq, oldest first."""

    epoch: str
    chunks: list[dict]
    pending: int = 0
    more: bool = False

    @property
    def last_seq(self) -> int:
        return self.chunks[-1]["seq"] if self.chunks else 0

    def body(self) -> bytes:
        page = {"epoch": self.epoch, "chunks": self.chunks, "last_seq": self.last_seq, "pending": self.pending, "more": self.more}
        return json.dumps(page, separators=(",", ":"), ensure_ascii=False, default=str).encode()

    def half(self) -> Page:
        return Page(self.epoch, self.chunks[: len(self.chunks) // 2], self.pending, True)


def retry_after_seconds(header: str, now: datetime | None = None) -> float:
    """Seconds or an HTTP date, an hour at most; 0 for anything else."""
    header = header.strip()
    try:
        wait = float(int(header))
    except ValueError:
        try:
            when = parsedate_to_datetime(header)
        except (ValueError, TypeError):
            return 0.0
        when = when if when.tzinfo else when.replace(tzinfo=UTC)
        wait = (when - (now or datetime.now(UTC))).total_seconds()
    return min(wait, MOST_RETRY_AFTER_S) if wait > 0 else 0.0


def fitted(page: Page, most_bytes: int) -> tuple[bytes, Page]:
    """The page, halved until it fits. A single chunk that doesn't fit is an error, never dropped."""
    body = page.body()
    while most_bytes > 0 and len(body) > most_bytes:
        if len(page.chunks) == 1:
            raise DeliveryFailure("a chunk is too large to send", f"seq {page.last_seq}: {len(body)} bytes, limit {most_bytes}", our_fault=True)
        page = page.half()
        body = page.body()
    return body, page


def deliver(page: Page, send: Transport, most_bytes: int = 0) -> int:
    """The highest number that the receiver took over. Only a 200 for this epoch that covers the first chunk counts."""
    body, page = fitted(page, most_bytes)
    try:
        status, retry, raw = send(body)
    except OSError as e:
        raise DeliveryFailure("the receiver can't be reached", str(e)) from e
    said = raw[:SNIPPET_BYTES].decode("utf-8", "replace")
    if status == 400:
        raise DeliveryFailure("the receiver calls the batch malformed (400)", said, our_fault=True)
    if status != 200:
        raise DeliveryFailure(f"the receiver replied {status}", said, retry_after_seconds(retry))
    try:
        reply = json.loads(raw)
        up_to = reply["accepted_up_to_seq"]
    except (ValueError, KeyError, TypeError):
        up_to = None
    if not isinstance(up_to, int):
        raise DeliveryFailure("a 200 without accepted_up_to_seq", said)
    if reply.get("epoch") != page.epoch:
        raise DeliveryFailure("a reply for another epoch", f"sent {page.epoch}, got {reply.get('epoch')}")
    if up_to < page.chunks[0]["seq"]:
        raise DeliveryFailure("nothing of the batch was accepted", f"accepted_up_to_seq {up_to}, first {page.chunks[0]['seq']}")
    return min(up_to, page.last_seq)


@dataclass
class Pusher:
    """drain(n) gives the oldest unacknowledged page; ack(epoch, up_to) moves the cursor and evicts."""

    drain: Callable[[int], Page]
    ack: Callable[[str, int], object]
    send: Transport
    batch: int = 256
    interval_s: float = 1.0
    most_backoff_s: float = 30.0
    most_bytes: int = 8 << 20
    _backoff: float = field(default=0.0, init=False)
    _failing: str = field(default="", init=False)

    def step(self) -> float:
        """One delivery; how long to wait before the next one (0: at once)."""
        page = self.drain(self.batch)
        if not page.chunks:
            return self.interval_s
        try:
            up_to = deliver(page, self.send, self.most_bytes)
        except DeliveryFailure as e:
            if e.kind != self._failing:  # only the start and a change of a failure are worth a line
                log.warning("push failed, chunks are kept: %s", e)
            self._failing = e.kind
            self._backoff = min(self.most_backoff_s, self._backoff * 2 or self.interval_s)
            return e.retry_after or (self.most_backoff_s if e.our_fault else self._backoff)
        if self._failing:
            log.info("push works again")
        self._failing, self._backoff = "", 0.0
        self.ack(page.epoch, up_to)
        return 0.0

    def empty(self, sleep: Callable[[float], None], most_steps: int | None = None) -> bool:
        """Delivers until nothing is left, waiting as step() says after failures; whether all went out."""
        steps = 0
        while most_steps is None or steps < most_steps:
            wait = self.step()
            if not wait:
                continue
            if not self._failing:
                return True
            steps += 1
            sleep(wait)
        return False

    def run(self, sleep: Callable[[float], None], stop: Callable[[], bool]) -> None:
        while not stop():
            if wait := self.step():
                sleep(wait)
