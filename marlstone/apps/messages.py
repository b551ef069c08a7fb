"""Structured messages about runs, independent of how they are delivered."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

from ..plans.spec import RequestError
from .workers import WORKERS, WorkerResult

# Block types with the fields that each must and may have.
BLOCKS = {"text": ({"text"}, set()), "image": ({"source"}, {"alt"}), "special": ({"channel", "format", "payload"}, set())}
CHANNELS: dict[str, Callable[[Message], None]] = {}


@dataclass
class Message:
    """A title and blocks: text, image, or special for one channel."""

    title: str
    blocks: list[dict]
    metadata: dict[str, Any] = field(default_factory=dict)
    message_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    schema_version: int = 1

    def __post_init__(self):
        if not self.title or not self.blocks or self.schema_version != 1 or not re.fullmatch(r"[a-zA-Z0-9-]+", self.message_id):
            raise RequestError("a message needs a title, blocks, version 1 and a plain id")
        for b in self.blocks:
            must, may = BLOCKS.get(b.get("type"), (None, None))
            if must is None or not must <= set(b) - {"type"} <= must | may:
                raise RequestError(f"no valid block: {b!r}")
            if any(not isinstance(b[k], str) or not b[k] for k in must - {"payload"}):
                raise RequestError(f"empty text in block {b!r}")
            if b["type"] == "special" and (not isinstance(b["payload"], dict) or not all(re.fullmatch(r"[a-z][a-z0-9-]*", b[k]) for k in ("channel", "format"))):
                raise RequestError(f"no valid special block: {b!r}")

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Message:
        try:
            return cls(**json.loads(text))
        except (TypeError, ValueError) as e:
            raise RequestError(f"no valid message: {e}") from None


def write_message(path: str, message: Message) -> None:
    """The file is whole or not there."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(message.to_json())
    os.replace(f.name, path)


def read_message(path: str) -> Message:
    with open(path, encoding="utf-8-sig") as f:
        return Message.from_json(f.read())


def channel(name: str):
    """Registers a function as the way to deliver by `name`."""

    def enter(f: Callable[[Message], None]):
        CHANNELS[name] = f
        return f

    return enter


@channel("console")
def console(message: Message) -> None:
    print(message.title)
    for b in message.blocks:
        if b["type"] == "text":
            print(b["text"])
        elif b["type"] == "image":
            print(f"[image: {b.get('alt') or b['source']}]")
        elif b["channel"] == "console":
            print(json.dumps(b["payload"], ensure_ascii=False))


def send_message(message: Message, by: str) -> dict:
    """Delivers; the result tells how it went."""
    if by not in CHANNELS:
        raise RequestError(f"no channel {by!r}; there are {sorted(CHANNELS)}")
    try:
        CHANNELS[by](message)
        return {"message_id": message.message_id, "channel": by, "status": "SUCCESS", "error": None}
    except Exception as e:  # whatever a channel raises is its result
        return {"message_id": message.message_id, "channel": by, "status": "FAILURE", "error": f"{type(e).__name__}: {e}"}


def worker_name(name: str) -> str:
    """A worker's name without a stock- in front."""
    short = name.removeprefix("stock-")
    if short not in WORKERS:
        raise RequestError(f"no worker {name!r}")
    return short


def run_message(results: Iterable[WorkerResult], selected: Iterable[str], job_id: str) -> Message:
    """What the selected workers of a job did: SUCCESS if all did well, FAILURE if none did, else PARTIAL; a worker without a result is missing."""
    names = [worker_name(n) for n in selected]
    got = {r.worker: r for r in results if r.job_id == job_id}
    good = [n for n in names if n in got and got[n].status == "success"]
    missing = [n for n in names if n not in got]
    status = "SUCCESS" if len(good) == len(names) else "PARTIAL" if good else "FAILURE"
    lines = [f"{n}: {got[n].status if n in got else 'missing'}" + (f" ({got[n].error['message']})" if n in got and got[n].error else "") for n in names]
    meta = {"status": status, "job_id": job_id, "selected_workers": names, "succeeded_workers": good, "missing_workers": missing, "failed_workers": [n for n in names if n in got and n not in good], "rows_written": sum(int(r.metrics.get("rows_written", 0)) for r in got.values())}
    return Message(f"Ingestion {status}", [{"type": "text", "text": "\n".join(lines) or "no worker"}], meta)
