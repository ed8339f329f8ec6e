"""Language servers that a store knows: a small JSON file beside it.

Registrations are normalised before they are kept: an id without white space,
a language in lower case, a command, and extensions in lower case without their
dot, each once. The file is replaced by a rename.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path, PurePosixPath

from orrery.functions.scalars import ASCII_LOWER
from orrery.schema import InvalidRequest


@dataclass(frozen=True)
class Registration:
    id: str
    language: str
    command: str
    arguments: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    initialization_options: object = None

    def prepared(self) -> Registration:
        """Normalised, or InvalidRequest if it can't be launched."""
        name = self.id.strip()
        language, command = self.language.strip().translate(ASCII_LOWER), self.command.strip()
        extensions = sorted({e.strip().lstrip(".").translate(ASCII_LOWER) for e in self.extensions} - {""})
        for problem, found in (
            ("id must be a non-empty token", name and not any(c.isspace() for c in name)),
            ("language is required", language),
            ("command is required", command),
            ("at least one file extension is required", extensions),
        ):
            if not found:
                raise InvalidRequest(problem)
        return replace(self, id=name, language=language, command=command, extensions=extensions)

    def serves(self, path: str) -> bool:
        """Whether the path has one of the extensions."""
        return PurePosixPath(path).suffix[1:].translate(ASCII_LOWER) in self.extensions


class Registry:
    """The registrations beside a store's folder, by id."""

    def __init__(self, store: str):
        at = Path(store.removeprefix("file://"))
        self.path = at.with_name(at.name + ".lsp.json")
        try:
            known = json.loads(self.path.read_text())["registrations"] if self.path.is_file() else []
            self.known = {k["id"]: Registration(**k) for k in known}
        except (ValueError, KeyError, TypeError) as e:
            raise InvalidRequest(f"parse lsp registry: {e}") from e

    def registrations(self) -> list[dict]:
        return [asdict(self.known[k]) for k in sorted(self.known)]

    def upsert(self, registration: Registration) -> Registration:
        """Keep a registration in place of one with its id."""
        kept = registration.prepared()
        self.known[kept.id] = kept
        self._save()
        return kept

    def remove(self, name: str) -> bool:
        """Whether there was one of that id."""
        found = self.known.pop(name, None) is not None
        if found:
            self._save()
        return found

    def _save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        draft = self.path.with_suffix(".json.tmp")
        draft.write_text(json.dumps({"registrations": self.registrations()}, indent=2))
        os.replace(draft, self.path)
