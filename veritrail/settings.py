"""Settings of the engine, with checks, from arguments or environment variables."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from .operators.chunking import MAX_CHARS, OVERLAP_CHARS
from .operators.classify import TOPICS
from .operators.dense import THRESHOLD, TOP_K
from .sources.markdown import EXCLUDED

PREFIX = "VERITRAIL_"
MESSAGE_CHARS = 2000


def words_of(value: str | list | tuple | set) -> tuple[str, ...]:
    """Lower-cased items of a comma-separated list, a JSON array or a collection; blank ones are left out."""
    if isinstance(value, str):
        if value.strip().startswith("["):
            try:
                value = json.loads(value)
            except ValueError as error:
                raise ValueError(f"expected a JSON array or a comma-separated list: {error}") from error
        else:
            value = value.split(",")
    return tuple(w for w in (str(v).strip().lower() for v in value) if w)


@dataclass(frozen=True)
class Settings:
    app_name: str = "veritrail"
    kb_dir: Path = Path("knowledge_base")
    index_dir: Path = Path("storage/index")
    kb_exclude_globs: tuple[str, ...] = EXCLUDED
    embedding_model: str = ""
    chunk_max_chars: int = MAX_CHARS
    chunk_overlap_chars: int = OVERLAP_CHARS
    retrieval_top_k: int = TOP_K
    similarity_threshold: float = THRESHOLD
    max_message_chars: int = MESSAGE_CHARS
    topic_keywords: tuple[str, ...] = TOPICS

    def __post_init__(self):
        for field in fields(self):
            value = getattr(self, field.name)
            if field.type == "Path":
                value = Path(value).expanduser()
            elif field.type.startswith("tuple"):
                value = words_of(value)
            elif field.type in ("int", "float"):
                value = {"int": int, "float": float}[field.type](value)
            object.__setattr__(self, field.name, value)
        for name in ("chunk_max_chars", "retrieval_top_k", "max_message_chars"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.chunk_overlap_chars < self.chunk_max_chars:
            raise ValueError("chunk_overlap_chars must be at least 0 and smaller than chunk_max_chars")
        if not -1.0 <= self.similarity_threshold <= 1.0:
            raise ValueError("similarity_threshold must lie between -1 and 1")

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = PREFIX) -> Settings:
        """Settings named in ``env`` by prefix and upper-case name; others keep their defaults, and unknown names are ignored."""
        known = {f.name for f in fields(cls)}
        given = {k[len(prefix) :].lower(): v for k, v in env.items() if k.upper().startswith(prefix)}
        return cls(**{k: v for k, v in given.items() if k in known})
