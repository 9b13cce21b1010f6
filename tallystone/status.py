"""The status file of a run, and a thread that keeps it fresh."""

from __future__ import annotations

import os
import socket
import threading
import time
from dataclasses import dataclass, field

from .sources.sinks import write_json

FILE = "scan_status.json"
#: The phases of a run, and the names under which the file tells its times and state.
PHASES = ("scan", "report", "detail", "treemap", "sync", "done", "error")
KEYS = {
    "running": "running", "phase": "stage", "begin": "started_at", "phase_begin": "phase_started_at", "in_phase": "phase_elapsed_sec",
    "in_all": "total_elapsed_sec", "now": "updated_at", "end": "finished_at", "process": "pid", "machine": "host", "said": "message", "failure": "error",
}


@dataclass
class Progress:
    """Where a run stands. Times are whole seconds; a clock that goes back counts as standing still."""

    phase: str = "scan"
    begin: float = field(default_factory=time.time)
    phase_begin: float = 0.0
    said: str = ""
    failure: str = ""

    def __post_init__(self) -> None:
        self.phase_begin = self.phase_begin or self.begin

    @property
    def running(self) -> bool:
        return self.phase not in ("done", "error")

    def enter(self, phase: str, said: str = "") -> None:
        if phase not in PHASES:
            raise ValueError(f"no phase {phase}")
        self.phase, self.phase_begin, self.said = phase, time.time(), said

    def document(self, now: float | None = None) -> dict:
        clock = {name: int(value) for name, value in (("now", now or time.time()), ("begin", self.begin), ("phase_begin", self.phase_begin))}
        since = {"in_all": "begin", "in_phase": "phase_begin"}
        state = clock | {name: max(0, clock["now"] - clock[first]) for name, first in since.items()}
        state |= {"running": self.running, "phase": self.phase, "said": self.said, "failure": self.failure}
        state |= {"end": 0 if self.running else clock["now"], "process": os.getpid(), "machine": socket.gethostname()}
        return {told: state[name] for name, told in KEYS.items()}


class Heartbeat:
    """Writes the status every few seconds: ``with Heartbeat(folder) as h: h.phase("scan")``."""

    def __init__(self, folder: str, every: float = 5.0):
        self.path, self.every = os.path.join(folder, FILE), every
        self.progress, self.over, self.lock = Progress(), threading.Event(), threading.Lock()
        self.thread = threading.Thread(target=self.beat, daemon=True)

    def write(self) -> None:
        with self.lock:
            write_json(self.progress.document(), self.path)

    def beat(self) -> None:
        while not self.over.wait(self.every):
            self.write()

    def phase(self, stage: str, said: str = "") -> None:
        self.progress.enter(stage, said)
        self.write()

    def __enter__(self) -> Heartbeat:
        self.phase(self.progress.phase)
        self.thread.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.over.set()
        self.thread.join()
        self.progress.failure = str(error or kind.__name__) if kind else ""
        self.phase("error" if kind else "done")
