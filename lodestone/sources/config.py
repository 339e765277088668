"""What an index takes in: defaults, and a JSON file of overrides that warns and never fails."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from lodestone.functions.paths import EXTENSIONS, SUFFIXES

# Directories that hold no source of their own, wherever they lie, and the keys of the configuration.
IGNORED = (
    ".git", "node_modules", "dist", "build", "out", ".next", ".nuxt", "target", "__pycache__", ".venv", "venv", "env", ".idea", ".vscode", "coverage",
    ".cache", "vendor", "bin", "obj", ".gradle", ".mvn", ".sfdx", ".sf", ".output", ".svelte-kit", ".astro", ".docusaurus", ".parcel-cache", ".turbo",
    ".angular", ".expo", ".serverless", ".terraform", ".yarn", ".pnpm-store", "bower_components", "jspm_packages", "site-packages",
    ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".nyc_output", ".dart_tool", "DerivedData", "Pods", "cmake-build-debug", "cmake-build-release",
    ".docset", "htmlcov", "_site", ".jekyll-cache", "storybook-static", ".lodestone",
)
MOST_BYTES = 1_500_000
KEYS = ("ignoreDirs", "extensions", "exclude", "maxFileBytes", "suffixes")


@dataclass
class Config:
    """Ignored directory names, anchored ignored paths, extensions, suffixes, excluded substrings, largest file."""

    ignored: set[str] = field(default_factory=lambda: set(IGNORED))
    ignored_paths: list[str] = field(default_factory=list)
    extensions: set[str] = field(default_factory=lambda: set(EXTENSIONS))
    suffixes: list[str] = field(default_factory=lambda: list(SUFFIXES))
    exclude: list[str] = field(default_factory=list)
    most_bytes: int = MOST_BYTES


def load_config(text: str | None) -> tuple[Config, list[str]]:
    """(configuration, warnings) from the JSON text of a file; None stands for no file."""
    config, warnings = Config(), []
    if text is None:
        return config, warnings
    try:
        found = json.loads(text)
    except ValueError as e:
        return config, [f"not JSON: {e}"]
    if not isinstance(found, dict):
        return config, ["not an object"]
    warnings += [f"unknown key {k!r}" for k in found if k not in KEYS]

    def entries(key: str) -> list[str]:
        value = found.get(key, [])
        if not isinstance(value, list):
            warnings.append(f"{key} is no array")
            return []
        texts = [str(x) for x in value]
        if "" in texts:
            warnings.append(f"{key} holds an empty entry")
        return [x for x in texts if x]

    for entry in entries("ignoreDirs"):
        clean = entry.replace("\\", "/").removeprefix("./").rstrip("/")
        if "/" in clean:
            config.ignored_paths.append(clean)
        elif clean:
            config.ignored.add(clean)
    for entry in entries("extensions"):
        if not entry.startswith("."):
            warnings.append(f"extension {entry!r} has no dot")
        config.extensions.add(entry.lower())
    config.exclude += entries("exclude")
    for entry in entries("suffixes"):
        if re.fullmatch(r"\.[a-z0-9]+", entry.lower()):
            warnings.append(f"suffix {entry!r} looks like an extension")
        config.suffixes.append(entry.lower())
    size = found.get("maxFileBytes", MOST_BYTES)
    if isinstance(size, bool) or not isinstance(size, (int, float)) or size <= 0:
        warnings.append("maxFileBytes is no positive number")
    else:
        config.most_bytes = int(size)
    return config, warnings
