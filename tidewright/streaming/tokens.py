"""Resume positions in files for logs that have no checkpoint of their own: one file, and the ten before it.

A file holds {"_data": text}; an empty text is no position. Saving keeps older files as `.1` to `.10`. Loading falls back to
the newest readable one of them and puts it in place; without any, replication starts from scratch.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tidewright.sources import files

BACKUPS = 10
#: How some writers print a nested position; what it holds is the position.
PRINTED = "map[_data:"


def normalised(token) -> str:
    """The text of a position in any of the shapes in which it is handed over."""
    while isinstance(token, dict):
        token = token.get("_data", "")
    text = "" if token is None else token.decode() if isinstance(token, bytes) else str(token)
    if text.startswith(PRINTED) and text.endswith("]") and len(text) > len(PRINTED) + 1:
        text = text[len(PRINTED) : -1]
    return text


def parse(content: str) -> str | None:
    """The position in a file's content; None where it says that there is none. ValueError if it is something else."""
    value = json.loads(content)
    if not isinstance(value, dict) or not isinstance(value.get("_data", ""), str):
        raise ValueError("not a resume position")
    return normalised(value) or None


class TokenFile:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _backup(self, i: int) -> str:
        return f"{self.path}.{i}"

    def save(self, token) -> None:
        """Put a position in place, after what was there has become the first backup."""
        if files.exists(self.spark, self.path):
            for i in range(BACKUPS - 1, 0, -1):
                if files.exists(self.spark, self._backup(i)):
                    files.rename(self.spark, self._backup(i), self._backup(i + 1))
            files.copy(self.spark, self.path, self._backup(1))
        files.write_text(self.spark, self.path, json.dumps({"_data": normalised(token)}, indent=2))

    def load(self) -> str | None:
        """The position; an absent file is created empty, an unreadable one replaced by the newest good backup."""
        if not files.exists(self.spark, self.path):
            files.write_text(self.spark, self.path, json.dumps({"_data": ""}, indent=2))
            return None
        try:
            return parse(files.read_text(self.spark, self.path))
        except ValueError:
            for i in range(1, BACKUPS + 1):
                if not files.exists(self.spark, self._backup(i)):
                    continue
                try:
                    token = parse(files.read_text(self.spark, self._backup(i)))
                except ValueError:
                    continue
                files.copy(self.spark, self._backup(i), self.path)
                return token
            return None

    def delete(self) -> None:
        for path in (self.path, *map(self._backup, range(1, BACKUPS + 1))):
            if files.exists(self.spark, path):
                files.delete(self.spark, path)
