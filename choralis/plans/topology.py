"""How many rooms (hash partitions) and serving groups a catalogue of a given size gets."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

# Fixed values.
ROOM_BYTES = 72 * 1024 * 1024
TEXT_SHARE = 0.94
ROOMS_PER_AGGREGATOR = 72
SUPERS = 10
MAX_ROOMS = 65535
INDEX_ENTRIES_PER_PART = 8388608
PART_ROLL_BYTES = 18 * 1024 * 1024
PART_WARN_BYTES = 20 * 1024 * 1024


@dataclass(frozen=True)
class Topology:
    rooms: int
    aggregators: int
    rooms_per_aggregator: int = ROOMS_PER_AGGREGATOR
    supers: int = SUPERS

    def to_json(self, **more: int) -> str:
        return json.dumps(asdict(self) | more)

    def rooms_of(self, aggregator: int) -> range:
        """Rooms that the aggregator owns; empty beyond the last room."""
        low = aggregator * self.rooms_per_aggregator
        return range(min(low, self.rooms), min(low + self.rooms_per_aggregator, self.rooms))


def _up(n: int, step: int) -> int:
    return -(-n // step) * step


def plan_topology(source_bytes: int) -> Topology:
    """Rooms are rounded up to hundreds, aggregators to sixes."""
    rooms = _up(max(1, int(source_bytes * TEXT_SHARE) // ROOM_BYTES), 100)
    if rooms > MAX_ROOMS:
        raise ValueError(f"{rooms} rooms don't fit a 16-bit room number ({MAX_ROOMS})")
    return Topology(rooms, _up(max(6, -(-rooms // ROOMS_PER_AGGREGATOR)), 6))


def index_parts(max_id: int) -> int:
    return -(-(max_id + 1) // INDEX_ENTRIES_PER_PART)
