"""Leases: at most one holder of a name at a time, until it lets go or its time is over."""

from __future__ import annotations

import json
import time
import uuid

import pyarrow.fs as pafs

HELD = "LEASE"


class Lease:
    """The right to run a job below a folder, taken by one rename that only succeeds where no lease stands.

    A folder that cannot be renamed onto another full one is the lock. A lease over its time is moved aside, which
    only one of several contenders can do, and then taken like a free one. A holder asks ``mine`` before
    each step that others must not repeat.
    """

    def __init__(self, root: str, name: str, seconds: float, clock=time.time):
        self.fs, path = pafs.FileSystem.from_uri(root)
        self.folder, self.seconds, self.clock = f"{path}/leases/{name}", seconds, clock
        self.token = uuid.uuid4().hex

    def _holder(self, folder: str) -> dict | None:
        path = f"{folder}/owner.json"
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            return None
        try:
            with self.fs.open_input_stream(path) as f:
                return json.loads(f.read())
        except FileNotFoundError:  # moved aside meanwhile
            return None

    def mine(self) -> bool:
        held = self._holder(f"{self.folder}/{HELD}")
        return held is not None and held["token"] == self.token and held["until"] > self.clock()

    def take(self) -> bool:
        """Whether the lease is ours now."""
        self.fs.create_dir(self.folder)
        slot = f"{self.folder}/{HELD}"
        held = self._holder(slot)
        if held and held["until"] <= self.clock():
            aside = f"{self.folder}/expired-{uuid.uuid4().hex}"
            try:
                self.fs.move(slot, aside)
            except OSError:
                return False
            moved = self._holder(aside)
            if moved and moved["token"] != held["token"]:
                # Someone else had taken the expired one over already: theirs goes back.
                self._claim(aside)
                return False
            self.fs.delete_dir(aside)
        own = f"{self.folder}/claim-{self.token}"
        self.fs.create_dir(own)
        with self.fs.open_output_stream(f"{own}/owner.json") as f:
            f.write(json.dumps({"token": self.token, "until": self.clock() + self.seconds}).encode())
        if not self._claim(own):
            self.fs.delete_dir(own)
        return self.mine()

    def _claim(self, own: str) -> bool:
        try:
            self.fs.move(own, f"{self.folder}/{HELD}")
            return True
        except OSError:
            return False

    def release(self) -> None:
        """Let go, if the lease is still ours."""
        held = self._holder(f"{self.folder}/{HELD}")
        if held and held["token"] == self.token:
            aside = f"{self.folder}/released-{self.token}"
            self.fs.move(f"{self.folder}/{HELD}", aside)
            self.fs.delete_dir(aside)
