"""The one error of the query surface."""

from __future__ import annotations


class GraphQueryError(Exception):
    """A refused request: a stable code, a message and details."""

    def __init__(self, code: str, message: str = "", **details):
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.details = code, details
