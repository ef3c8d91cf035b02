"""Driver-side configuration: environment files, topology, preflight checks."""

from __future__ import annotations

import os
import re
from pathlib import Path


def parse_env(text: str) -> dict[str, str]:
    """NAME=value lines; quotes around values go, comments after unquoted ones too."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
        if m and not line.lstrip().startswith("#"):
            value = m[2]
            if value[:1] in "\"'" and value[:1] and value[-1:] == value[:1] and len(value) > 1:
                value = value[1:-1]
            else:
                value = re.split(r"\s+#", value)[0]
            out[m[1]] = value
    return out


def load_env(start: str | Path = ".") -> dict[str, str]:
    """The nearest .env upwards from start; variables that are set already win."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / ".env").is_file():
            return parse_env((folder / ".env").read_text()) | dict(os.environ)
    return dict(os.environ)


def flag(env: dict[str, str], name: str, default: bool = False) -> bool:
    return env[name].strip().lower() in ("1", "true", "yes", "on") if env.get(name) else default


def interpolate(value, env: dict[str, str]):
    """${NAME} in every string of a nested value."""
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, env) for v in value]
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), value) if isinstance(value, str) else value


def mask(secret: str) -> str:
    return secret[:4] + "..." + secret[-2:] if len(secret) > 8 else "***" if secret else ""


def preflight(inputs: list[str], output: str) -> list[str]:
    """What is wrong with local input files and the output folder; empty if nothing."""
    wrong = [f"not a readable file: {p}" for p in inputs if not (os.path.isfile(p) and os.access(p, os.R_OK))]
    parent = Path(output).resolve().parent
    return wrong + ([] if parent.is_dir() and os.access(parent, os.W_OK) else [f"can't write in {parent}"])


def load_topology(text: str, env: dict[str, str]) -> dict:
    """Backends and passes of a YAML text; a pass names one backend or several with weights."""
    import yaml  # an optional library

    raw = interpolate(yaml.safe_load(text), env)
    backends = raw.get("backends", {})
    passes = {name: [x] if isinstance(x, str) else list(x) for name, x in raw.get("passes", {}).items()}
    unknown = {b for names in passes.values() for b in names} - set(backends)
    if unknown:
        raise ValueError(f"unknown backends: {sorted(unknown)}")
    return {"backends": backends, "passes": passes}
