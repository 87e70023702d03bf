"""Registry of uploaded sources: each id names the lazily planned tables of one file."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame


class UploadRegistry:
    """file id -> named DataFrames. Plans only: no rows are held on the driver."""

    def __init__(self) -> None:
        self._tables: dict[str, dict[str, DataFrame]] = {}
        self.active: str | None = None

    @staticmethod
    def id_of(path: str) -> str:
        return hashlib.sha256(path.encode()).hexdigest()[:32]

    def add(self, path: str, **tables: DataFrame) -> str:
        file_id = self.id_of(path)
        self._tables[file_id] = {"path": path, **tables}
        return file_id

    def put(self, file_id: str, **tables: DataFrame) -> None:
        self.get(file_id).update(tables)
        self.active = file_id

    def get(self, file_id: str) -> dict:
        if file_id not in self._tables:
            raise KeyError(f"unknown file id: {file_id}")
        return self._tables[file_id]

    def columns(self, file_id: str, name: str = "parsed") -> list[str]:
        return sorted(self.get(file_id)[name].columns)
