"""Named queries of one group with their SQL statements."""

from __future__ import annotations

from bindings.ctes import sql


class Group:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = sql(oracle)
            return fn

        return add
