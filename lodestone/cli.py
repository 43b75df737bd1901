"""Command line: index, find, config, clean, sync, version, help."""

from __future__ import annotations

import os
import sys
import time

from . import __version__
from .sources import config as cfg

HOME = os.environ.get("LODESTONE_HOME", os.path.join("~", ".lodestone"))
USAGE = "usage: lodestone index [path] [--recursive=bool] | find <query> [--max=N] [--media-max=N] [--restrict[=path]] | config [path | get key | set key value] | clean | sync [path] | version | help"


class UsageError(ValueError):
    pass


def parse(args: list[str]) -> tuple[list[str], dict[str, str]]:
    """Positional arguments and flags: --name is 'true', --name=value splits at the first '='."""
    positional, flags = [], {}
    for a in args:
        if a.startswith("--"):
            name, eq, value = a[2:].partition("=")
            if not name:
                raise UsageError(f"a flag without a name: {a}")
            flags[name] = value if eq else "true"
        else:
            positional.append(a)
    return positional, flags


def _flag_bool(flags: dict[str, str], name: str, default: bool) -> bool:
    if name not in flags:
        return default
    if flags[name] not in ("true", "false"):
        raise UsageError(f"--{name} must be true or false, not {flags[name]!r}")
    return flags[name] == "true"


def _flag_int(flags: dict[str, str], name: str) -> int:
    try:
        return int(flags.get(name, "0"))
    except ValueError:
        raise UsageError(f"--{name} must be a whole number, not {flags[name]!r}") from None


def _known(flags: dict[str, str], *names: str) -> None:
    for f in flags:
        if f not in names:
            raise UsageError(f"unknown flag --{f}")


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    try:
        return run(args)
    except (UsageError, KeyError, ValueError, OSError) as e:
        print(f"error: {e.args[0] if isinstance(e, KeyError) else e}", file=sys.stderr)
        return 1


def run(args: list[str]) -> int:
    command = args[0] if args else "help"
    if command in ("help", "--help", "-h"):
        print(USAGE)
        return 0
    if command == "version":
        print(__version__)
        return 0
    if command not in ("index", "find", "config", "clean", "sync"):
        raise UsageError(f"unknown command {command!r}\n{USAGE}")
    positional, flags = parse(args[1:])
    path = os.path.join(cfg.expand_home(HOME), "config.toml")
    config = cfg.load(path, resolve=command != "config")
    if command == "config":
        return _config(config, path, positional)
    from .operators.store import IndexStore
    from .session import build_session, scratch

    if command == "clean":
        if positional:
            raise UsageError("clean takes no arguments")
        print("removed the index" if IndexStore(build_session(), "file://" + config.db.path).clean() else "nothing to clean")
        return 0
    if command in ("index", "sync"):
        _known(flags, "recursive")
        if len(positional) > 1:
            raise UsageError(f"{command} takes one path at most")
        recursive = _flag_bool(flags, "recursive", True)
        from .media import image_function
        from .plans.index import index_directory, saw_anything, summary
        from .progress import Progress

        spark = build_session()
        began = time.time()
        images = _media(config)
        with Progress(spark), scratch(spark):
            stats = index_directory(spark, cfg.expand_home(positional[0]) if positional else ".", IndexStore(spark, "file://" + config.db.path), _embedder(config), _rules(config), recursive, image_function(images) if images else None, command == "sync")
        print(summary(stats, time.time() - began) if saw_anything(stats) else "no files found")
        return 0
    _known(flags, "max", "media-max", "restrict")
    if len(positional) != 1:
        raise UsageError("find takes exactly one query")
    from .plans.search import Options, printed, search

    restrict = flags.get("restrict")
    options = Options(_flag_int(flags, "max"), _flag_int(flags, "media-max"), 0, None if restrict is None else "." if restrict == "true" else cfg.expand_home(restrict))
    store = IndexStore(build_session(), "file://" + config.db.path)
    print(printed(search(store, positional[0], _embedder(config), options, _media(config), (config.search.max_results, config.search.max_media_results, config.search.max_results_per_file)), links=sys.stdout.isatty()))
    return 0


def _config(config: cfg.Config, path: str, positional: list[str]) -> int:
    what = positional[0] if positional else ""
    if not positional:
        for key in cfg.keys(config):
            print(f"{key} = {cfg.get(config, key)}")
    elif what == "path" and len(positional) == 1:
        print(path)
    elif what == "get" and len(positional) == 2:
        print(cfg.get(config, positional[1]))
    elif what == "set" and len(positional) == 3:
        cfg.set_value(config, positional[1], positional[2])
        cfg.save(config, path)
    else:
        raise UsageError("config takes path, get <key> or set <key> <value>")
    return 0


def _embedder(config: cfg.Config):
    from .embed import HashEmbedder, OnnxEmbedder

    if config.embedder.model_path:
        return OnnxEmbedder(config.embedder.model_path, config.embedder.tokenizer_path, config.embedder.batch_size)
    return HashEmbedder()


def _rules(config: cfg.Config):
    from .sources.listing import Rules

    i = config.index
    return Rules(i.ignore_dirs, i.ignore_patterns, i.ignore_dir_markers, i.index_hidden_dirs, i.allowed_extensions, config.media.allowed_extensions, i.max_file_size_mb, i.max_file_size_mb_by_type)


def _media(config: cfg.Config):
    """The image encoder where its folder is there; otherwise images are left out."""
    from .media import ClipEmbedder

    return ClipEmbedder(config.media.model_dir) if config.media.model_dir and os.path.isdir(config.media.model_dir) else None


if __name__ == "__main__":
    sys.exit(main())
