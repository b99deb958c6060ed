"""State machines of the streaming operators; each has a batch twin."""

from __future__ import annotations

import math
from typing import Any

from ..operators.feedback import MISS_TTL, OUTCOME_TTL
from ..operators.playlists import MAX_ITEMS, MAX_LISTS
from ..operators.usage import MIN_SECONDS
from .ordered import Row, State

SECOND = 1_000_000
#: Kind of the row that ends the input of a key.
END = "end of input"


class Untimed:
    """Base of machines that do not react to silence."""

    def expire(self, state: State, watermark: int) -> list[tuple]:
        return []

    def wake_at(self, state: State) -> int | None:
        return None


SEGMENT_OUTPUT = (
    "videoKey string, videoUrl string, songTitle string, trackName string, artistName string, "
    "filterMode string, seconds bigint, startedAt bigint, endedAt bigint"
)
_META = ("songTitle", "trackName", "artistName")


class SegmentMachine:
    """One open segment per user; see the batch twin for the rules.

    Rows carry ``kind, url, url_key, path, mode, song, song_key``; ``url_key`` is the video key
    and ``path`` the place of the URL, ``song_key`` the video key of the song's URL, all
    computed before the machine by Column functions.
    """

    def __init__(self, silence_seconds: float | None = None):
        self.silence = None if silence_seconds is None else int(silence_seconds * SECOND)

    def wake_at(self, state: State) -> int | None:
        if self.silence is None or not state.get("open"):
            return None
        return state["last"] + self.silence

    def expire(self, state: State, watermark: int) -> list[tuple]:
        segment = state.get("open")
        return self._close(state, segment["beat"]) if segment else []

    def _close(self, state: State, end: int) -> list[tuple]:
        segment, state["open"] = state.get("open"), None
        if not segment or segment["key"] is None:
            return []
        seconds = math.floor((end - segment["start"]) / SECOND + 0.5)
        if seconds < MIN_SECONDS:
            return []
        meta = (segment["meta"].get(n) for n in _META)
        return [(segment["key"], segment["url"], *meta, segment["mode"], seconds, segment["start"], end)]

    def _open(self, state: State, ts: int, key: str | None, meta: Row | None, url: str | None = None) -> None:
        known = state.get("known") or {}
        if meta is None:
            meta = known if key is not None and known.get("videoKey") == key else {}
        tab = state.get("tab") or {}
        state["open"] = {
            "key": key, "url": url or tab.get("url"), "mode": state.get("mode"), "start": ts, "beat": ts,
            "meta": {n: meta.get(n) for n in _META if meta.get(n)},
        }

    def step(self, state: State, row: Row) -> list[tuple]:
        ts, kind, segment, out = row["ts"], row["kind"], state.get("open"), []
        song = row.get("song") or {}
        here = {"url": row.get("url"), "key": row.get("url_key"), "path": row.get("path")}
        state["last"] = ts
        if kind == "start":
            out = self._close(state, ts)
            state["tab"] = here
            state["mode"] = row.get("mode") or state.get("mode")
            self._open(state, ts, here["key"], None)
        elif kind in ("stop", "close"):
            out = self._close(state, ts)
        elif kind == END:  # nothing follows: what is open ends at its last beat
            out = self.expire(state, ts)
            state.clear()
        elif kind == "mode":
            state["mode"] = row.get("mode") or state.get("mode")
            if segment:
                out = self._close(state, ts)
                self._open(state, ts, (state.get("tab") or {}).get("key"), segment["meta"])
        elif kind == "navigate" and segment:
            if here["path"] is None or here["path"] != (state.get("tab") or {}).get("path"):
                out = self._close(state, ts)
            else:
                state["tab"] = here
                if here["key"] is not None and here["key"] != segment["key"]:
                    out = self._close(state, ts)
                    self._open(state, ts, here["key"], None)
        elif kind == "song":
            told = song.get("videoKey")
            if told is not None:
                state["known"] = song
            if segment and told is not None and told != segment["key"]:
                out = self._close(state, ts)
                url = song.get("videoUrl") or None
                key = row.get("song_key") if url else (state.get("tab") or {}).get("key")
                self._open(state, ts, key, song, url)
            elif segment:
                segment["meta"].update({n: song[n] for n in _META if song.get(n)})
                segment["url"] = song.get("videoUrl") or segment["url"]
        elif kind == "beat" and segment:
            segment["beat"] = ts
        return out


class ChangeMachine(Untimed):
    """Rows whose ``value`` differs from the row before."""

    def step(self, state: State, row: Row) -> list[tuple]:
        if "last" in state and state["last"] == row["value"]:
            return []
        state["last"] = row["value"]
        return [(row["ts"], row["value"])]


class CaptionMachine(Untimed):
    """Non-empty captions that differ from the one before, shown 0.3 s earlier."""

    def step(self, state: State, row: Row) -> list[tuple]:
        if not row["text"] or row["text"] == state.get("last"):
            return []
        state["last"] = row["text"]
        return [(max(row["time"] - 0.3, 0.0), row["text"])]


class GenerationMachine(Untimed):
    """T5: results not older than the newest generation seen so far."""

    def step(self, state: State, row: Row) -> list[tuple]:
        state["top"] = max(state.get("top", row["generation"]), row["generation"])
        return [(row["ts"], row["generation"], row["value"])] if row["generation"] == state["top"] else []


class PauseMachine(Untimed):
    """Paused when the position has not changed for more than ``stall_ms``."""

    def __init__(self, stall_ms: int = 1600):
        self.stall = stall_ms * 1000

    def step(self, state: State, row: Row) -> list[tuple]:
        if "at" not in state or row["position"] != state["position"]:
            state.update(position=row["position"], at=row["ts"])
        return [(row["ts"], row["position"], row["ts"] - state["at"] > self.stall)]


class OutcomeMachine:
    """Requests not held back by an outcome or miss still in force.

    Rows are outcomes (``reason``) or requests (``reason`` null). ``miss`` holds back
    for 10 minutes and ``refresh`` clears a miss. What has expired is forgotten as event time
    passes it, so its key leaves the store (the store's own time to live runs on the clock of the
    machine, which a replay does not follow).
    """

    def wake_at(self, state: State) -> int | None:
        held = state.get("until")
        return None if held is None or held == "ever" else held

    def expire(self, state: State, watermark: int) -> list[tuple]:
        held = self.wake_at(state)
        if held is not None and held <= watermark:
            del state["until"]
        return []

    def step(self, state: State, row: Row) -> list[tuple]:
        reason, ts = row["reason"], row["ts"]
        if reason is None:
            held = state.get("until")
            return [(ts,)] if held is None or held != "ever" and held <= ts else []
        if reason == "refresh":
            state.pop("until", None)
        elif reason == "miss":
            state["until"] = ts + MISS_TTL * SECOND
        elif reason in OUTCOME_TTL:
            ttl = OUTCOME_TTL[reason]
            state["until"] = "ever" if ttl is None else ts + ttl * SECOND
        return []


class QueueMachine(Untimed):
    """Songs waiting in a room after each event; nothing after its end."""

    def step(self, state: State, row: Row) -> list[tuple]:
        if state.get("ended"):
            return []
        songs = state.setdefault("songs", [])
        if row["kind"] == "add":
            songs.append(row["song"])
        elif row["kind"] == "next" and songs:
            songs.pop(0)
        elif row["kind"] == "end":
            songs.clear()
            state["ended"] = True
        return [(row["ts"], len(songs), songs[0] if songs else None)]


class PlaylistMachine(Untimed):
    """M1, M2: one outcome per mutation; the state is the user's lists, bounded by caps."""

    def __init__(self, max_lists: int = MAX_LISTS, max_items: int = MAX_ITEMS):
        self.max_lists, self.max_items = max_lists, max_items

    def step(self, state: State, row: Row) -> list[tuple]:
        lists: dict[str, Any] = state.setdefault("lists", {})
        action, lid = row["action"], row["list_id"]
        items = lists.get(lid)
        ok, why = items is not None, "no_list"
        if action == "create":
            ok = len(lists) < self.max_lists
            why = "ok" if ok else "too_many"
            if ok:
                lists[lid], state["default"] = [], lid
        elif action == "pick":
            state["default"] = lid
            return []
        elif ok and action == "add":
            full = len(items) >= self.max_items
            why = "full" if full else "duplicate" if row["video_key"] in items else "added"
            ok = why == "added"
            if ok:
                items.append(row["video_key"])
        elif ok and action == "remove":
            why = "removed"
            lists[lid] = [k for k in items if k != row["video_key"]]
        elif ok and action == "delete":
            why = "ok"
            del lists[lid]
        elif ok:
            why = "ok"
        default = state.get("default")
        if default not in lists:
            default = state["default"] = next(iter(lists), None)
        return [(row["ts"], action, ok, why, default)]
