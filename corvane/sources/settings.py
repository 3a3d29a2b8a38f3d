"""Settings from a file and the environment, checked as a whole; trusted instruction files."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

PREFIX = "CORVANE_"


@dataclass(frozen=True)
class Settings:
    """Defaults are the values that results must equal."""

    source_root: str = "."
    state_root: str = "state"
    chunk_chars: int = 450
    overlap_chars: int = 80
    min_chunk_chars: int = 80
    pdf_max_pages: int = 250
    max_file_mb: int = 200
    max_extracted_chars: int = 5_000_000
    embedding_dimension: int = 64
    top_k: int = 12
    score_threshold: float | None = None
    max_iterations: int = 3
    max_queries: int = 3
    max_contexts: int = 24
    max_source_documents: int = 2
    adjacent_radius: int = 1
    rewrite_min_similarity: float = 0.35
    whole_document_max_chars: int = 160_000
    logical_parent_max_chars: int = 40_000
    total_context_max_chars: int = 240_000
    max_whole_documents: int = 1
    access_group: str = "employees"
    extensions: tuple[str, ...] = field(default=(".txt", ".md", ".csv", ".xml", ".htm", ".html", ".json", ".docx", ".xlsx", ".pptx", ".pdf"))

    def __post_init__(self) -> None:
        problems = [
            (not 0 <= self.overlap_chars < self.chunk_chars, "overlap_chars"), (not 0 < self.min_chunk_chars <= self.chunk_chars, "min_chunk_chars"), (not 1 <= self.top_k <= 100, "top_k"),
            (not self.access_group.strip(), "access_group"), (self.max_iterations < 1, "max_iterations"), (self.max_queries < 1, "max_queries"), (self.embedding_dimension < 1, "embedding_dimension"),
            (self.total_context_max_chars < self.logical_parent_max_chars, "logical_parent_max_chars"), (self.score_threshold is not None and not -1 <= self.score_threshold <= 1, "score_threshold"),
        ]
        bad = [name for wrong, name in problems if wrong]
        if bad:
            raise ValueError("invalid_setting: " + ", ".join(bad))


def _typed(name: str, value: object, default: object) -> object:
    if isinstance(default, tuple):
        return tuple(value if isinstance(value, (list, tuple)) else str(value).split(","))
    if isinstance(default, bool) or default is None:
        return float(value) if default is None and value is not None else value
    return type(default)(value)


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Settings of a YAML file, then of CORVANE_ variables. Names that don't exist are an error."""
    values: dict[str, object] = {}
    if path:
        import yaml

        values = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    known = {f.name: getattr(Settings(), f.name) for f in fields(Settings)}
    if unknown := set(values) - set(known):
        raise ValueError("unknown_setting: " + ", ".join(sorted(unknown)))
    for name in known:
        if (value := (os.environ if environment is None else environment).get(PREFIX + name.upper())) is not None:
            values[name] = value
    return replace(Settings(), **{k: _typed(k, v, known[k]) for k, v in values.items()})


def load_environment(path: str) -> dict[str, str]:
    """KEY=value lines into the environment; what is set there already wins."""
    added = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = re.fullmatch(r"(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*)", line)
        if m is None:
            raise ValueError("invalid_dotenv_line")
        value = m[2].strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if m[1] not in os.environ:
            os.environ[m[1]] = added[m[1]] = value
    return added


def instructions(root: str, names: list[str], private: list[str], most: int) -> str:
    """The texts of listed .md and .mdc files under a root that shares nothing with private folders, within `most` characters."""
    base = Path(root).resolve()
    for p in map(lambda x: Path(x).resolve(), private):
        if base == p or base.is_relative_to(p) or p.is_relative_to(base):
            raise ValueError("instructions_overlap_private_root")
    parts = []
    for name in names:
        path = (base / name).resolve()
        if path.suffix.lower() not in (".md", ".mdc") or not path.is_relative_to(base) or not path.is_file():
            raise ValueError("instructions_not_allowed")
        parts.append(path.read_text(encoding="utf-8").strip())
    text = "\n\n".join(parts)
    if len(text) > most:
        raise ValueError("instructions_too_large")
    return text
