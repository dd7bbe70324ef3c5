"""What a collection asks of an index, and the index that has nothing to skip."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any, Protocol


class VectorIndex(Protocol):
    """Tells which cells of the stored rows a search reads; the rows themselves are always scored exactly."""

    kind: str
    is_exact: bool

    def ways(self, query: Sequence[float], n_probe: int | None = None, min_candidates: int = 0) -> list[list[int] | None]:
        """What to read, in turn, until there are enough rows: cells, or None for everything, which is the last."""
        ...

    def stats(self) -> dict[str, Any]: ...


@dataclass(frozen=True)
class Flat:
    """Reads everything."""

    kind: str = "flat"
    is_exact: bool = True

    def ways(self, query: Sequence[float], n_probe: int | None = None, min_candidates: int = 0) -> list[list[int] | None]:
        return [None]

    def stats(self) -> dict[str, Any]:
        return {"kind": self.kind}
