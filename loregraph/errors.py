"""Errors with a code and a severity, how they are shown, and what may help."""

from __future__ import annotations

from collections.abc import Iterable

SEVERITIES = ("fatal", "error", "warning")
HINTS = {
    "parse": "The file may have a syntax error: see whether it compiles.",
    "history": "See whether the folder is a repository and the log was written with the format that is read.",
    "model": "The text model may be out of reach or over its limit: see its key, then try again.",
    "config": "See whether the settings file has all its fields, each of the right type.",
    "missing": "See whether the path is right and may be read.",
}


class LoreError(Exception):
    """An error of this library: ``code`` is a key of HINTS, ``path`` what it is about."""

    def __init__(self, message: str, code: str = "", severity: str = "error", path: str | None = None) -> None:
        if severity not in SEVERITIES:
            raise ValueError(f"no severity {severity!r}")
        super().__init__(message)
        self.code, self.severity, self.path = code, severity, path

    @property
    def hint(self) -> str:
        return hint(self.code)


def hint(code: str) -> str:
    return HINTS.get(code, "The message has what is known.")


def severity_of(error: BaseException) -> str:
    """That of an error of this library; any other is an ``error``."""
    return error.severity if isinstance(error, LoreError) else "error"


def show(error: BaseException) -> str:
    """One line with the severity, what it is about and the message, and a second one with a hint where there is one."""
    where = f" [{error.path}]" if isinstance(error, LoreError) and error.path else ""
    first = f"{severity_of(error).capitalize()}{where}: {error}"
    return f"{first}\n  Hint: {error.hint}" if isinstance(error, LoreError) and error.code in HINTS else first


def by_severity(errors: Iterable[BaseException]) -> dict[str, list[BaseException]]:
    """All severities, each with its errors in their order."""
    out: dict[str, list[BaseException]] = {s: [] for s in SEVERITIES}
    for e in errors:
        out[severity_of(e)].append(e)
    return out
