"""Job options of an audit."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any, Iterable

from keysift.rules.catalog import Rule

# --- Fixed values: what is scanned by default --------------------------------------------------------------
EXCLUDED_DIRS = frozenset({
    ".build", ".git", ".swiftpm", ".venv", ".xcodeproj", ".xcworkspace", "Carthage", "DerivedData", "Pods",
    "__pycache__", "build", "dist", "node_modules", "vendor", "venv",
})
EXCLUDED_FILES = frozenset({
    ".DS_Store", "Cartfile.resolved", "Package.resolved", "Podfile.lock", "package-lock.json", "yarn.lock",
})
INCLUDED_EXTENSIONS = frozenset({
    ".bash", ".c", ".cfg", ".cjs", ".conf", ".cpp", ".cs", ".dart", ".entitlements", ".env", ".go", ".gradle",
    ".h", ".hpp", ".ini", ".java", ".js", ".json", ".jsonc", ".jsx", ".kt", ".kts", ".m", ".md", ".mjs",
    ".mm", ".php", ".plist", ".pro", ".properties", ".py", ".rb", ".rs", ".sh", ".sql", ".svelte", ".swift",
    ".tf", ".tfvars", ".toml", ".ts", ".tsx", ".txt", ".vue", ".xcconfig", ".xml", ".yaml", ".yml", ".zsh",
})
EXACT_FILENAMES = frozenset({
    ".netrc", ".npmrc", ".pypirc", "Appfile", "Cartfile", "Dockerfile", "ExportOptions.plist", "Fastfile",
    "Gemfile", "GoogleService-Info.plist", "Matchfile", "Package.swift", "Podfile", "agconnect-services.json",
    "build.gradle", "build.gradle.kts", "credentials.json", "docker-compose.yaml", "docker-compose.yml",
    "firebase.json", "google-services.json", "gradle.properties", "keystore.properties", "local.properties",
    "service-account.json", "settings.gradle", "settings.gradle.kts", "signing.properties",
})


@dataclass(frozen=True)
class AuditConfig:
    excluded_dirs: frozenset[str] = EXCLUDED_DIRS
    excluded_files: frozenset[str] = EXCLUDED_FILES
    included_extensions: frozenset[str] = INCLUDED_EXTENSIONS
    exact_filenames: frozenset[str] = EXACT_FILENAMES
    enable_entropy: bool = True
    entropy_threshold: float = 4.5
    min_entropy_length: int = 20
    enable_history: bool = True
    context_lines: int = 20
    json: bool = True
    html: bool = True
    markdown: bool = True
    text: bool = True
    disabled_rules: frozenset[str] = frozenset()
    keywords: frozenset[str] = frozenset()
    custom_rules: tuple[Rule, ...] = field(default=())


# JSON key -> (option, accepted type).  A set option is extended by the file, any other is replaced.
_JSON_OPTIONS = {
    "excluded_dirs": ("excluded_dirs", list),
    "excluded_files": ("excluded_files", list),
    "included_extensions": ("included_extensions", list),
    "enable_entropy": ("enable_entropy", bool),
    "entropy_threshold": ("entropy_threshold", (int, float)),
    "min_entropy_length": ("min_entropy_length", int),
    "enable_git": ("enable_history", bool),
    "context_lines": ("context_lines", int),
}


def config_from_json(text: str, base: AuditConfig = AuditConfig()) -> AuditConfig:
    """Options with those of a JSON object laid over them.

    Values of a wrong type are ignored, broken JSON leaves the base as it is.
    """
    try:
        given: dict[str, Any] = json.loads(text)
        changes: dict[str, Any] = {}
        for key, (option, kind) in _JSON_OPTIONS.items():
            value = given.get(key)
            if isinstance(value, kind):
                if kind is list:
                    value = getattr(base, option) | frozenset(value)
                elif option == "entropy_threshold":
                    value = float(value)
                changes[option] = value
    except (ValueError, AttributeError, TypeError) as error:
        print(f"Warning: unusable audit options ({error}); using defaults.")
        return base
    return replace(base, **changes)


def load_config(path: str | Path, base: AuditConfig = AuditConfig()) -> AuditConfig:
    file = Path(path)
    return config_from_json(file.read_text("utf-8"), base) if file.exists() else base


def _names(values: str | Iterable[str]) -> frozenset[str]:
    parts = values.split(",") if isinstance(values, str) else values
    return frozenset(part.strip() for part in parts if part.strip())


def override(
    config: AuditConfig,
    *,
    no_history: bool = False,
    no_entropy: bool = False,
    threshold: float | None = None,
    exclude_dirs: str | Iterable[str] = (),
    exclude_files: str | Iterable[str] = (),
    brief: bool = False,
) -> AuditConfig:
    """Options with the flags of one job laid over them; a flag that is not given changes nothing."""
    return replace(
        config,
        enable_history=config.enable_history and not no_history,
        enable_entropy=config.enable_entropy and not no_entropy,
        entropy_threshold=threshold or config.entropy_threshold,
        excluded_dirs=config.excluded_dirs | _names(exclude_dirs),
        excluded_files=config.excluded_files | _names(exclude_files),
        context_lines=0 if brief else config.context_lines,
    )
