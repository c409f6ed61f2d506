"""Line-by-line Python statements of what the Spark jobs compute, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter

from keysift.rules.catalog import BUILTIN_RULES, ENTROPY_ID

PATTERNS = {rule.id: re.compile(rule.pattern) for rule in BUILTIN_RULES}


def redact(secret: str) -> str:
    bare = secret.strip("'\" \t\r\n")
    if len(bare) <= 8:
        return "*" * len(bare)
    return bare[:4] + "*" * min(12, max(4, len(bare) - 8)) + ".." + bare[-4:]


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def harmless(candidate: str) -> bool:
    bare = candidate.strip("\"'` \t\r\n")
    shapes = (
        r"(?i)https?://[^\s/$.?#].[^\s]*$", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        r"[0-9a-fA-F]{32,64}$", r"[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9._-]+$", r"\.{0,2}/",
    )
    words = ("placeholder", "example", "sample", "your_secret", "dummy", "test")
    return (
        len(bare) < 20 or len(set(bare)) <= 4 or any(re.match(s, bare) for s in shapes) or any(w in bare.lower() for w in words)
    )


def secrets(line: str, size: int = 20, threshold: float = 4.5) -> set[str]:
    every = re.findall(rf"[\"'`]([^\r\n\"'`]{{{size},}})[\"'`]", line) + re.findall(rf"[A-Za-z0-9+/=_\-]{{{size},}}", line)
    return {c for c in every if not harmless(c) and entropy(c) >= threshold}


def findings(name: str, line: str, entropy_too: bool = True) -> list[tuple[str, str]]:
    found = [
        (rule.id, redact(match.group(0)))
        for rule in BUILTIN_RULES
        if not rule.files or any(name == g or name.endswith(g.lstrip("*")) for g in rule.files)
        for match in PATTERNS[rule.id].finditer(line)
    ]
    return sorted(found + [(ENTROPY_ID, redact(c)) for c in secrets(line) if entropy_too])
