"""A small registry: name, query function and the DuckDB SQL for the same result."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Registry:
    queries: dict = field(default_factory=dict)
    oracles: dict = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep
