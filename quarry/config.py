"""Settings of the pipeline, on the driver: defaults, a YAML file over them, and keys from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class ChunkParams:
    max_tokens: int = 512
    overlap_tokens: int = 64


def _formats() -> dict[str, ChunkParams]:
    # Tokens and overlap of each format.
    return {"pdf": ChunkParams(512, 64), "hwp": ChunkParams(640, 80), "docx": ChunkParams(512, 64), "pptx": ChunkParams(320, 32), "xlsx": ChunkParams(768, 0), "txt": ChunkParams(512, 64)}


@dataclass(frozen=True)
class Config:
    """One pipeline's settings. Values that plans need are read as plain scalars, never shipped as an object."""

    roots: tuple[str, ...] = ()
    exclude_dirs: tuple[str, ...] = (".git", "__pycache__", ".venv")
    max_file_mb: int = 120
    model_id: str = "hashing-64"
    query_prefix: str = "query: "
    passage_prefix: str = "passage: "
    dimensions: int = 64
    default_params: ChunkParams = field(default_factory=ChunkParams)
    by_format: dict[str, ChunkParams] = field(default_factory=_formats)
    min_chars: int = 30
    merge_peers: bool = True
    dense_top_k: int = 30
    sparse_top_k: int = 30
    rrf_k: int = 60
    final_top_k: int = 5
    base: str = "."

    def resolved_roots(self) -> list[Path]:
        """Roots relative to the project's own folder; absolute ones stay."""
        return [(Path(self.base) / r).resolve() for r in self.roots]

    def params(self, fmt: str | None) -> ChunkParams:
        return self.by_format.get(fmt or "", self.default_params)


def load_env(path: str) -> None:
    """``KEY=value`` lines of a file into the environment; what is set already stays. Comments and quotes are dropped."""
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else []:
        key, eq, value = line.strip().partition("=")
        if eq and not key.startswith("#"):
            os.environ.setdefault(key.strip(), value.strip().strip("'\""))


def load(path: str) -> Config:
    """A configuration file over the defaults: ``corpus``, ``embedding``, ``chunking`` and ``retrieval`` sections."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    flat = {**raw.get("corpus", {}), **raw.get("embedding", {}), **raw.get("chunking", {}), **raw.get("retrieval", {})}
    if "id" in flat:
        flat["model_id"] = flat["id"]
    if "default" in flat:
        flat["default_params"] = ChunkParams(**flat["default"])
    base = flat.get("default_params", ChunkParams())
    if "by_format" in flat:
        flat["by_format"] = {k: ChunkParams(**{"max_tokens": base.max_tokens, "overlap_tokens": base.overlap_tokens, **v}) for k, v in flat["by_format"].items()}
    for name in ("roots", "exclude_dirs"):
        if name in flat:
            flat[name] = tuple(flat[name])
    known = {f.name for f in fields(Config)}
    return Config(**{k: v for k, v in flat.items() if k in known}, base=str(Path(path).resolve().parent.parent))


def api_key(variable: str) -> str:
    """The key in an environment variable. It is never put into a plan or a table."""
    if not (key := os.environ.get(variable, "").strip()):
        raise RuntimeError(f"the environment variable {variable} has no key")
    return key
