"""Settings of a corpus: defaults, and a TOML file over them."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from textweave.operators.rules import RecordType

NAME = "textweave.toml"
SKIP_DIRS = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".pytest_cache", ".ruff_cache", ".mypy_cache", ".textweave", ".idea", ".vscode")
CODE_EXTS = (".py", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".sql", ".sh", ".bash", ".zsh", ".toml", ".rb", ".go", ".rs")


@dataclass
class Config:
    root: str = "."
    doc_exts: tuple[str, ...] = (".md",)
    code_exts: tuple[str, ...] = CODE_EXTS
    skip_dirs: tuple[str, ...] = SKIP_DIRS
    skip_files: tuple[str, ...] = (NAME,)
    include_gitignored: bool = False
    max_bytes: int = 5 << 20
    databases: tuple[str, ...] = ()
    types: tuple[RecordType, ...] = ()
    semantic: bool = True
    provider: str = "hashing"
    model: str = "hashing"
    url: str = ""
    key_env: str = ""
    dims: int = 256
    chunk_tokens: int = 512
    overlap: float = 0.15
    doc_prefix: str = ""
    query_prefix: str = ""
    stale_days: float = 180
    log: bool = False
    index: str = ".textweave"
    extra: dict = field(default_factory=dict)

    @property
    def index_dir(self) -> Path:
        return Path(self.root, self.index)

    def fingerprint(self) -> str:
        """Changes with any setting that changes what an index holds."""
        names = ("doc_exts", "code_exts", "skip_dirs", "skip_files", "include_gitignored", "max_bytes", "databases")
        return repr([getattr(self, n) for n in names])

    def embedding(self) -> str:
        names = ("provider", "model", "dims", "chunk_tokens", "overlap", "doc_prefix")
        return repr([getattr(self, n) for n in names]) if self.semantic else ""


def find_root(start: str | Path = ".", markers: tuple[str, ...] = (NAME, ".git")) -> Path:
    """The nearest folder upwards with the first marker that any has; else the working folder."""
    here = Path(start).resolve()
    for marker in markers:
        for base in (here, Path.cwd()):
            for folder in (base, *base.parents):
                if (folder / marker).exists():
                    return folder
    return Path.cwd()


def ext_list(raw: dict, key: str, default: tuple[str, ...]) -> tuple[str, ...]:
    value = raw.get(key)
    if value is None:
        return default
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ValueError(f"{key}: a list of strings is wanted")
    return tuple(x.lower() if x.startswith(".") else f".{x.lower()}" for x in value)


def load_config(root: str | Path) -> Config:
    """Defaults with the file's values; a file that is no TOML counts as none."""
    path = Path(root, NAME)
    try:
        raw = tomllib.loads(path.read_text(encoding="utf-8")) if path.is_file() else {}
    except tomllib.TOMLDecodeError:
        raw = {}
    c = Config(root=str(root))
    c.doc_exts = ext_list(raw, "doc_exts", c.doc_exts) or c.doc_exts
    c.code_exts = ext_list(raw, "code_exts", c.code_exts)
    c.skip_dirs = tuple(dict.fromkeys([*SKIP_DIRS, *raw.get("skip_dirs", ())]))
    c.skip_files = tuple(dict.fromkeys([NAME, *raw.get("skip_files", ())]))
    c.databases = tuple(dict.fromkeys(raw.get("databases", ())))
    c.types = tuple(RecordType(name, t.get("folder", ""), bool(t.get("recursive", False)), tuple(t.get("exclude", ())), tuple(t.get("require", ()))) for name, t in raw.get("types", {}).items())
    simple = {f.name: type(getattr(c, f.name)) for f in fields(c) if isinstance(getattr(c, f.name), (bool, int, float, str)) and f.name != "root"}
    for table in (raw, raw.get("semantic") if isinstance(raw.get("semantic"), dict) else {}):
        for name, kind in simple.items():
            if name in table and isinstance(table[name], (bool, int, float, str)):
                setattr(c, name, kind(table[name]))
    if isinstance(raw.get("semantic"), dict):
        c.semantic = bool(raw["semantic"].get("enabled", True))
    return c
