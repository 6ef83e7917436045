"""Live frames over HTTP: publish, snapshot, and updates as server-sent events.

The server holds the latest frame of each key in memory, all of them unless a
viewer's window is given a size, past which the oldest places go first; the
table of all frames is kept by ``live.state_stream``.
"""

from __future__ import annotations

import argparse
import json
import threading
from collections import OrderedDict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from massflow.streaming.live import KEY

class Window:
    """Latest frames by key, in the order of their first arrival."""

    def __init__(self, most: int | None = None):
        self.most, self.arrival, self.changed = most, 0, threading.Condition()
        self.frames: OrderedDict[tuple, dict] = OrderedDict()

    def publish(self, frame: dict) -> int:
        if not isinstance(frame, dict) or any(k not in frame for k in KEY):
            raise ValueError(f"a frame has {', '.join(KEY)}")
        with self.changed:
            self.arrival += 1
            self.frames[tuple(json.dumps(frame[k], sort_keys=True) for k in KEY)] = {**frame, "arrival": self.arrival}
            while self.most is not None and len(self.frames) > self.most:
                self.frames.popitem(last=False)
            self.changed.notify_all()
            return self.arrival

    def since(self, arrival: int, wait: float = 0.0) -> list[dict]:
        """Frames that came after arrival, in their places; waits for one if there is none."""
        with self.changed:
            if wait and self.arrival <= arrival:
                self.changed.wait(wait)
            return [f for f in self.frames.values() if f["arrival"] > arrival]


def handler(window: Window) -> type[BaseHTTPRequestHandler]:
    class Frames(BaseHTTPRequestHandler):
        def _say(self, code: int, value: object) -> None:
            body = json.dumps(value).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self) -> None:
            try:
                frame = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                self._say(200, {"arrival": window.publish(frame)})
            except ValueError as e:
                self._say(400, {"error": str(e)})

        def do_GET(self) -> None:
            if self.path == "/frames":
                self._say(200, window.since(0))
            elif self.path == "/events":
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                seen = int(self.headers.get("Last-Event-ID") or 0)
                try:
                    while not self.server.closing:
                        for f in sorted(window.since(seen, 0.5), key=lambda f: f["arrival"]):
                            seen = f["arrival"]
                            self.wfile.write(f"id: {seen}\ndata: {json.dumps(f)}\n\n".encode())
                        self.wfile.flush()
                except (BrokenPipeError, ConnectionResetError):
                    pass  # the viewer left
            else:
                self._say(404, {"error": "no such page"})

        def log_message(self, *args) -> None:
            pass

    return Frames


def serve(port: int = 0, most: int | None = None) -> tuple[ThreadingHTTPServer, Window]:
    """A running server on this machine (port 0: any free one) and its window; ``close`` stops it."""
    window = Window(most)
    server = ThreadingHTTPServer(("127.0.0.1", port), handler(window))
    server.daemon_threads, server.closing = True, False
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, window


def close(server: ThreadingHTTPServer) -> None:
    server.closing = True
    server.shutdown()
    server.server_close()


def main() -> None:
    args = argparse.ArgumentParser(description="serve live frames")
    args.add_argument("--port", type=int, default=8765)
    server, _ = serve(args.parse_args().port)
    print(f"http://127.0.0.1:{server.server_port}/frames")
    try:
        threading.Event().wait()
    except KeyboardInterrupt:
        close(server)


if __name__ == "__main__":
    main()
