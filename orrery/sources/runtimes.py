"""Where optional external programs are, and whether they run.

An environment variable that names a program decides alone. Otherwise a folder
beside the engine, the managed folder's bin, the managed folder and PATH are
tried in that order; the first that answers its version probe is taken.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path

PROBE_SECONDS = 5
MANAGED = "ORRERY_RUNTIME_DIR"


@dataclass(frozen=True)
class Runtime:
    id: str
    executable: str
    override: str
    version_arguments: tuple[str, ...] = ("--version",)
    tested_versions: tuple[str, ...] = ()
    optional: bool = True
    capabilities: tuple[str, ...] = ()


RUNTIMES = (
    Runtime("lizard", "lizard", "ORRERY_LIZARD", tested_versions=("1.23.0",), capabilities=("symbols", "metrics")),
    Runtime("rust-analyzer", "rust-analyzer", "ORRERY_RUST_ANALYZER", capabilities=("references", "calls")),
)


@dataclass(frozen=True)
class Status:
    spec: Runtime
    available: bool
    executable: str
    source: str | None = None
    version: str | None = None
    detail: str | None = None


def probe(spec: Runtime, executable: str, source: str, seconds: float = PROBE_SECONDS) -> Status:
    """Run a candidate's version command; its first line that is not blank."""
    try:
        done = subprocess.run([executable, *spec.version_arguments], capture_output=True, timeout=seconds)
    except subprocess.TimeoutExpired:
        return Status(spec, False, executable, source, detail=f"{executable} version probe timed out after {seconds} seconds")
    except OSError as e:
        return Status(spec, False, executable, source, detail=f"{executable}: {e.strerror}")
    if done.returncode:
        return Status(spec, False, executable, source, detail=f"{executable} exited with {done.returncode}")
    said = (done.stdout or done.stderr).decode(errors="replace").splitlines()
    return Status(spec, True, executable, source, next((x.strip() for x in said if x.strip()), None))


@dataclass(frozen=True)
class Resolver:
    """engine and managed: folders, or None."""

    engine: Path | None = None
    managed: Path | None = None
    environment: Mapping[str, str] = field(default_factory=lambda: os.environ)

    def _candidates(self, spec: Runtime) -> Iterator[tuple[str, str]]:
        if self.engine:
            yield str(self.engine / spec.executable), "engine_sibling"
        if managed := self.managed or (Path(p) if (p := self.environment.get(MANAGED)) else None):
            yield str(managed / "bin" / spec.executable), "managed_directory"
            yield str(managed / spec.executable), "managed_directory"
        yield spec.executable, "path"

    def resolve(self, spec: Runtime) -> Status:
        if named := self.environment.get(spec.override):
            return probe(spec, named, "environment")
        failures = []
        for executable, source in dict(self._candidates(spec)).items():
            found = probe(spec, executable, source)
            if found.available:
                return found
            failures.append(found.detail)
        return Status(spec, False, spec.executable, detail="; ".join(failures))

    def inventory(self, specs: Iterable[Runtime] = RUNTIMES) -> dict:
        return {"schema_version": 1, "runtime_directory_environment": MANAGED, "runtimes": [asdict(self.resolve(s)) for s in specs]}
