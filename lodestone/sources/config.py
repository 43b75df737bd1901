"""Settings in a TOML file: typed sections, dotted keys for the command line, paths that resolve."""

from __future__ import annotations

import os
import sys
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from ..functions import paths


@dataclass
class EmbedderConfig:
    model_path: str = ""
    tokenizer_path: str = ""
    ort_library_path: str = ""  # kept for old files; onnxruntime finds its library itself
    batch_size: int = 0


@dataclass
class MediaConfig:
    model_dir: str = ""
    allowed_extensions: list[str] = field(default_factory=list)


@dataclass
class IndexConfig:
    max_file_size_mb: int = 0
    allowed_extensions: list[str] = field(default_factory=list)
    ignore_dirs: list[str] = field(default_factory=list)
    index_hidden_dirs: bool = False
    ignore_dir_markers: list[str] = field(default_factory=list)
    ignore_patterns: list[str] = field(default_factory=list)
    max_file_size_mb_by_type: dict[str, int] = field(default_factory=dict)


@dataclass
class SearchConfig:
    max_results: int = 0
    max_media_results: int = 0
    max_results_per_file: int = 0


@dataclass
class StoreConfig:
    path: str = ""


@dataclass
class Config:
    embedder: EmbedderConfig = field(default_factory=EmbedderConfig)
    media: MediaConfig = field(default_factory=MediaConfig)
    index: IndexConfig = field(default_factory=IndexConfig)
    db: StoreConfig = field(default_factory=StoreConfig)
    search: SearchConfig = field(default_factory=SearchConfig)


def default() -> Config:
    dirs = paths.IGNORE_DIRS + paths.SYSTEM_DIRS.get(sys.platform, [])
    patterns = paths.IGNORE_PATTERNS + paths.SYSTEM_PATTERNS.get(sys.platform, [])
    return Config(
        embedder=EmbedderConfig(batch_size=32),
        media=MediaConfig(allowed_extensions=list(paths.MEDIA_EXTENSIONS)),
        index=IndexConfig(paths.DEFAULT_MB, list(paths.TEXT_EXTENSIONS), dirs, False, list(paths.MARKERS), patterns, dict(paths.MB_BY_TYPE)),
        db=StoreConfig("index"),
        search=SearchConfig(5, 5, 2),
    )


def _quote(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if isinstance(v, list):
        return "[" + ", ".join(map(_quote, v)) + "]"
    return str(v)


def dumps(config: Config) -> str:
    """Plain keys of a section before its tables, so that no table swallows them."""
    out = []
    for name, section in asdict(config).items():
        out.append(f"[{name}]")
        out += [f"{k} = {_quote(v)}" for k, v in section.items() if not isinstance(v, dict)]
        for k, v in section.items():
            if isinstance(v, dict):
                out.append(f"[{name}.{k}]")
                out += [f"{_quote(a)} = {_quote(b)}" for a, b in v.items()]
        out.append("")
    return "\n".join(out)


def save(config: Config, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(dumps(config))


def load(path: str, resolve: bool = True) -> Config:
    """Reads the file, writing the defaults first where there is none. Missing keys decode to zero values:
    a file from before a section existed isn't filled up."""
    if not os.path.exists(path):
        save(default(), path)
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    config = Config()
    for section in fields(config):
        target = getattr(config, section.name)
        for f_ in fields(target):
            if f_.name in raw.get(section.name, {}):
                setattr(target, f_.name, raw[section.name][f_.name])
    if not resolve:  # for editing: values stay as they are written
        return config
    base = os.path.dirname(os.path.abspath(path))
    config.db.path = os.path.join(base, expand_home(config.db.path or "index"))
    for owner, name in ((config.embedder, "model_path"), (config.embedder, "tokenizer_path"), (config.media, "model_dir")):
        value = expand_home(getattr(owner, name))
        setattr(owner, name, os.path.join(base, value) if value else value)
    return config


def expand_home(path: str) -> str:
    """'~' and '~/x' only; '~user' stays as it is."""
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def keys(config: Config) -> list[str]:
    return [f"{s.name}.{f_.name}" for s in fields(config) for f_ in fields(getattr(config, s.name))]


def _find(config: Config, key: str):
    section, _, name = key.partition(".")
    owner = getattr(config, section, None)
    if not is_dataclass(owner) or name not in {f_.name for f_ in fields(owner)}:
        raise KeyError(f"unknown key {key!r}; known: {', '.join(keys(config))}")
    return owner, name


def get(config: Config, key: str) -> str:
    owner, name = _find(config, key)
    v = getattr(owner, name)
    if isinstance(v, dict):
        return "\n".join(f"{k} = {v[k]}" for k in sorted(v))
    return ("true" if v else "false") if isinstance(v, bool) else ", ".join(v) if isinstance(v, list) else str(v)


def set_value(config: Config, key: str, value: str) -> None:
    owner, name = _find(config, key)
    old = getattr(owner, name)
    if isinstance(old, (list, dict)):
        raise ValueError(f"{key} can only be changed in the file")
    if isinstance(old, bool):
        if value.lower() not in ("true", "false", "1", "0", "t", "f"):
            raise ValueError(f"{key} must be true or false, not {value!r}")
        setattr(owner, name, value.lower() in ("true", "1", "t"))
    elif isinstance(old, int):
        try:
            setattr(owner, name, int(value))
        except ValueError:
            raise ValueError(f"{key} must be a whole number, not {value!r}") from None
    else:
        setattr(owner, name, value)
