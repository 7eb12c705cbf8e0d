import json
import logging
from datetime import UTC, datetime

import pytest

from textmill.streaming.push import DeliveryFailure, Page, Pusher, deliver, fitted, retry_after_seconds


class Log:
    def __init__(self, n, size=1):
        self.chunks, self.acked, self.epoch = [{"seq": k, "text": "x" * size} for k in range(1, n + 1)], 0, "e"

    def drain(self, n):
        left = [c for c in self.chunks if c["seq"] > self.acked]
        return Page(self.epoch, left[:n], len(left), len(left) > n)

    def ack(self, epoch, up_to):
        assert epoch == self.epoch
        self.acked = up_to


class Receiver:
    def __init__(self, *replies):
        self.replies, self.pages, self.sizes = list(replies), [], []

    def __call__(self, body):
        page = json.loads(body)
        self.pages.append([c["seq"] for c in page["chunks"]])
        self.sizes.append(len(body))
        reply = self.replies.pop(0) if self.replies else None
        if isinstance(reply, Exception):
            raise reply
        if reply is None:
            return 200, "", json.dumps({"epoch": page["epoch"], "accepted_up_to_seq": page["last_seq"]}).encode()
        return reply


def pusher(log, receiver, **options):
    return Pusher(log.drain, log.ack, receiver, **{"batch": 4, "interval_s": 1.0, "most_backoff_s": 30.0} | options)


def ok(up_to, epoch="e"):
    return 200, "", json.dumps({"epoch": epoch, "accepted_up_to_seq": up_to}).encode()


def test_pages_in_order():
    log, r = Log(10), Receiver()
    p = pusher(log, r)
    assert [p.step() for _ in range(4)] == [0, 0, 0, 1.0]
    assert r.pages == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10]] and log.acked == 10


def test_partial_acceptance():
    log, r = Log(4), Receiver(ok(2))
    p = pusher(log, r)
    p.step()
    p.step()
    assert r.pages == [[1, 2, 3, 4], [3, 4]]


def test_acceptance_is_clamped():
    assert deliver(Page("e", [{"seq": 3}]), lambda b: ok(99)) == 3


@pytest.mark.parametrize(
    "reply",
    [(500, "", b""), (204, "", b""), (202, "", b"{}"), (200, "", b""), (200, "", b"{}"), ok(4, "old"), ok(0), (200, "", b'{"epoch":"e","accepted_up_to_seq":null}'), OSError("down")],
)
def test_nothing_is_lost(reply):
    log = Log(4)
    p = pusher(log, Receiver(reply))
    assert p.step() == 1.0 and log.acked == 0
    p.step()
    assert log.acked == 4


def test_waits():
    p = pusher(Log(1), Receiver((503, "7", b""), (500, "", b""), (500, "", b""), (400, "", b"bad"), (500, "", b"")))
    assert [p.step() for _ in range(5)] == [7.0, 2.0, 4.0, 30.0, 16.0]


def test_one_line_per_failure(caplog):
    with caplog.at_level(logging.INFO):
        p = pusher(Log(1), Receiver(*[(400, "", b"bad")] * 3))
        for _ in range(4):
            p.step()
    assert len(caplog.records) == 2


def test_batches_fit():
    log, r = Log(16, 400), Receiver()
    p = pusher(log, r, batch=16, most_bytes=2000)
    while log.acked < 16:
        p.step()
    assert max(r.sizes) <= 2000
    with pytest.raises(DeliveryFailure) as e:
        fitted(Log(1, 4000).drain(1), 2000)
    assert e.value.our_fault


@pytest.mark.parametrize(("header", "want"), [("", 0), ("5", 5), ("0", 0), ("-3", 0), ("junk", 0), ("99999", 3600)])
def test_retry_after(header, want):
    assert retry_after_seconds(header) == want


def test_retry_after_date():
    now = datetime(2026, 1, 1, tzinfo=UTC)
    assert retry_after_seconds("Thu, 01 Jan 2026 00:00:30 GMT", now) == 30


def test_run_stops():
    log, waits = Log(3), []
    pusher(log, Receiver()).run(waits.append, lambda: bool(waits))
    assert log.acked == 3 and waits == [1.0]


def test_http_transport_sends_the_key_and_reads_every_status():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from textmill.streaming.push import http_transport

    seen = []

    class Receiver(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers["Authorization"], self.headers["Content-Type"], self.rfile.read(int(self.headers["Content-Length"]))))
            status = 503 if len(seen) == 1 else 200
            self.send_response(status)
            if status == 503:
                self.send_header("Retry-After", "2")
            self.end_headers()
            self.wfile.write(b"said")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    send = http_transport(f"http://127.0.0.1:{server.server_port}/x", "key", 5)
    assert send(b"{}") == (503, "2", b"said") and send(b"[]") == (200, "", b"said")
    assert seen == [("Bearer key", "application/json", b"{}"), ("Bearer key", "application/json", b"[]")]
    server.shutdown()
    server.server_close()
    try:
        send(b"{}")
    except OSError:
        return
    raise AssertionError("a receiver that is gone can't reply")
