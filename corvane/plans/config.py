"""Settings of jobs: files that extend one another, environment variables, hashes."""

from __future__ import annotations

import hashlib
import json
import os
import string
from collections.abc import Callable, Iterable, Iterator, Mapping
from pathlib import Path


class Reference(string.Template):
    """${NAME} or ${NAME:-default}; a dollar sign before anything else stands for itself."""

    pattern = r"\$\{(?P<braced>[A-Za-z_][A-Za-z0-9_]*(?::-[^}]*)?)\}|(?P<named>(?!))|(?P<escaped>(?!))|(?P<invalid>(?!))"


class Environment(Mapping):
    """What references stand for: variables, or else the default that the reference itself gives. One that is neither set nor has a default is a KeyError."""

    def __getitem__(self, told: str) -> str:
        name, has_default, default = told.partition(":-")
        return os.environ.get(name, default) if has_default else os.environ[name]

    def __iter__(self) -> Iterator[str]:
        return iter(os.environ)

    def __len__(self) -> int:
        return len(os.environ)


def leaves(value, at: tuple = ()) -> Iterator[tuple[tuple, object]]:
    """(path, value) of all that is neither a table with entries nor a list; paths begin with the keys of tables. Lists are leaves."""
    if isinstance(value, dict) and value:
        for k in value:
            yield from leaves(value[k], (*at, k))
    else:
        yield at, value


def planted(found: Iterable[tuple[tuple, object]]) -> dict:
    """The table that has these leaves; of leaves in one place the last stands, and a table there gives way to it."""
    root: dict = {}
    for path, value in found:
        here = root
        for k in path[:-1]:
            if not isinstance(here.get(k), dict):
                here[k] = {}
            here = here[k]
        if path and not (value == {} and isinstance(here.get(path[-1]), dict)):
            here[path[-1]] = value
    return root


def expanded(value):
    """References in a string, or in the strings of a list or table at any depth, replaced; other values as they are."""
    if isinstance(value, str):
        return Reference(value).substitute(Environment())
    if isinstance(value, list):
        return list(map(expanded, value))
    return planted((path, expanded(x)) for path, x in leaves(value)) if isinstance(value, dict) and value else value


#: Readers of settings by the ending of the file; other endings are YAML.
READERS: dict[str, Callable[[str], dict]] = {".json": json.loads}


def read(path: Path) -> dict:
    if path.suffix in READERS:
        return READERS[path.suffix](path.read_text(encoding="utf-8"))
    import yaml  # only where it is installed

    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


def load(path: str | Path) -> dict:
    """The settings of a file over those of the file that its `extends` names in the same folder, and so on down; references are replaced at the end."""
    layers, at = [], Path(path)
    while at is not None:
        if any(at == p for p, _ in layers):
            raise ValueError(f"{at} extends itself")
        layers.append((at, read(at)))
        below = layers[-1][1].pop("extends", None)
        at = at.parent / below if below else None
    return expanded(planted(x for _, layer in reversed(layers) for x in leaves(layer)))


def resolve_path(path: str | Path, root: str | Path) -> Path:
    """A path as it stands where it is absolute, and else below the root; ~ is the home folder."""
    return Path(root, Path(path).expanduser())


def stable_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def stable_hash(value, prefix: int | None = None) -> str:
    """SHA-256 of the value as stable JSON, or the first `prefix` digits of it."""
    return hashlib.sha256(stable_json(value).encode()).hexdigest()[:prefix]


def config_hash(config: dict) -> str:
    """Of all keys that don't begin with an underscore."""
    return stable_hash({k: v for k, v in config.items() if not k.startswith("_")})


def stages(steps: list[tuple[str, object]], spark, exists) -> list[str]:
    """Runs (output path, function of spark and path) steps in order, those whose output exists aside; gives the paths that were made."""
    made = []
    for path, step in steps:
        if not exists(path):
            step(spark, path)
            made.append(path)
    return made
