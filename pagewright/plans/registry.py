"""Queries by name, each with the SQL that gives the same rows, or with none."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.run: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, run, sql: str | None) -> None:
        if name in self.run:
            raise ValueError(f"{name} is there already")
        self.run[name] = run
        if sql:
            self.sql[name] = sql

    def query(self, name: str, sql: str | None):
        def keep(run):
            self.add(name, run, sql)
            return run

        return keep
