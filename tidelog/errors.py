"""The engine's error: a stable code, a message, optional details, and whether a retry can help."""

from __future__ import annotations


class TidelogError(Exception):
    def __init__(self, code: str, message: str, details: str | None = None, retryable: bool = False):
        super().__init__(f"{code}: {message}" + (f" ({details})" if details else ""))
        self.code, self.message, self.details, self.retryable = code, message, details, retryable

    def as_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "details": self.details, "retryable": self.retryable}
