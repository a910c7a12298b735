"""Settings of an engine."""

from __future__ import annotations

from dataclasses import dataclass, field

from shardloom.errors import InvalidArgument
from shardloom.functions.placement import CACHE_PARTITIONS


@dataclass(frozen=True)
class EngineConfig:
    """What the operators take as parameters, in one place; values are checked when it is made."""

    root: str
    nodes: tuple[str, ...] = field(default_factory=tuple)
    cache_partitions: int = CACHE_PARTITIONS
    backups: int = 1
    quorum_nodes: int | None = None
    heartbeat_timeout_s: float = 15.0
    settle: str = "10 seconds"
    lock_wait_s: float = 30.0

    def __post_init__(self) -> None:
        if not self.root:
            raise InvalidArgument("root is missing")
        if self.cache_partitions <= 0 or self.backups < 0 or self.heartbeat_timeout_s <= 0:
            raise InvalidArgument("partitions and timeout must be above 0, backups not negative")

    @classmethod
    def from_dict(cls, values: dict) -> EngineConfig:
        """From parsed JSON or YAML; unknown names are an invalid argument."""
        unknown = set(values) - set(cls.__dataclass_fields__)
        if unknown:
            raise InvalidArgument(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if k == "nodes" else v for k, v in values.items()})
