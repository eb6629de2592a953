"""Errors of the engine; each names the place in the text."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, message: str, pos: tuple[int, int] | None = None) -> None:
        super().__init__(f"{pos[0]}:{pos[1]}: {message}" if pos else message)
        self.pos = pos


class LexError(EngineError):
    pass


class ParseError(EngineError):
    pass


class SemanticError(EngineError):
    pass


class NotSupported(EngineError):
    pass
