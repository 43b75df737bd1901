"""Path expressions and the rules that decide which files are indexed."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Default lists of the configuration.
TEXT_EXTENSIONS = [
    ".txt", ".md", ".markdown", ".rst", ".go", ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".h", ".cpp", ".hpp", ".rs",
    ".rb", ".php", ".sh", ".sql", ".html", ".css", ".scss", ".json", ".yaml", ".yml", ".toml", ".xml", ".swift", ".kt", ".pdf", ".docx",
]
MEDIA_EXTENSIONS = [".jpg", ".jpeg", ".png", ".heic", ".heif"]
IGNORE_PATTERNS = [".DS_Store", ".env", ".env.*"]
IGNORE_DIRS = [
    ".git", ".svn", ".hg", "node_modules", "vendor", "third_party", "_vendored", "Pods", "Carthage", "site-packages", ".venv", "venv",
    "dist", "build", "out", "target", ".next", "cmake-build-*", "__pycache__", ".cache", "cache", ".gradle", ".m2", ".terraform",
    ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "*.egg-info", "*@v*",
]
# What some systems add to the two lists.
SYSTEM_DIRS = {"darwin": ["Library", "Applications"], "win32": ["AppData", "$Recycle.Bin"]}
SYSTEM_PATTERNS = {"win32": ["Thumbs.db", "desktop.ini"]}
MARKERS = ["pyvenv.cfg"]
DEFAULT_MB = 2
MB_BY_TYPE = {"pdf": 50, "docx": 25, "jpg": 50, "jpeg": 50, "png": 50, "heic": 50, "heif": 50}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the base name, lower case; '' without one; '.env' is its own extension."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def directories(path: Column) -> Column:
    """Names of all directories above the file."""
    return F.filter(F.slice(F.split(path, "/", -1), F.lit(1), F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0))), lambda x: x != "")


def under_dir(path: Column, directory: str) -> Column:
    """The path itself or below it; the directory '/' has only itself."""
    return (path == directory) | F.startswith(path, F.lit(directory + "/"))


def glob_regex(pattern: str) -> str | None:
    """An anchored regular expression for * ? [...] and \\ escapes, where * and ? never cross '/'.
    None for a malformed pattern."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
        elif c == "[":
            j, negate, body = i + 1, "", []
            if j < len(pattern) and pattern[j] == "^":
                negate, j = "^", j + 1
            while j < len(pattern) and (pattern[j] != "]" or not body):
                k = j + 1 if pattern[j] == "\\" else j
                if k >= len(pattern) or (pattern[j] in "-]" and k == j):
                    return None
                low, j = pattern[k], k + 1
                high = low
                if j < len(pattern) and pattern[j] == "-":
                    k = j + 2 if j + 1 < len(pattern) and pattern[j + 1] == "\\" else j + 1
                    if k >= len(pattern) or pattern[k] == "]":
                        return None
                    high, j = pattern[k], k + 1
                body.append((low, high))
            if j >= len(pattern):
                return None
            ranges = "".join(re.escape(a) if a == b else f"{re.escape(a)}-{re.escape(b)}" for a, b in body)
            out.append(f"(?:(?!/)[{negate}{ranges}])")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?:" + "".join(out) + ")$"


def matches_any(name: Column, patterns: list[str], literal_if_malformed: bool) -> Column:
    """Glob match of a name; a malformed pattern matches its own text, or nothing."""
    found = F.lit(False)
    for p in patterns:
        rx = glob_regex(p)
        if rx is not None:
            found = found | name.rlike("(?s)" + rx)
        elif literal_if_malformed:
            found = found | (name == p)
    return found


def hidden_or_ignored(path: Column, ignore_dirs: list[str] = IGNORE_DIRS, index_hidden: bool = False) -> Column:
    """Whether a directory above the file is pruned. Hidden files themselves are not."""
    return F.exists(directories(path), lambda d: (F.lit(not index_hidden) & F.startswith(d, F.lit("."))) | matches_any(d, ignore_dirs, True))


def classify(path: Column, text: list[str] = TEXT_EXTENSIONS, media: list[str] = MEDIA_EXTENSIONS, ignore: list[str] = IGNORE_PATTERNS) -> Column:
    """'text', 'media' or 'none'; the list of text extensions is asked first."""
    ext = extension(path)
    return F.when(matches_any(base_name(path), ignore, False), "none").when(ext.isin([e.lower() for e in text]), "text").when(ext.isin([e.lower() for e in media]), "media").otherwise("none")


def size_limit(path: Column, default_mb: int = DEFAULT_MB, by_type: dict[str, int] = MB_BY_TYPE) -> Column:
    """Bytes; 0 or less means no limit. Keys of by_type are compared as they are written."""
    ext = F.regexp_replace(extension(path), r"^\.", "")
    table = F.create_map(*[F.lit(x) for kv in by_type.items() for x in kv]) if by_type else F.lit(None).cast("map<string,int>")
    return F.coalesce(F.element_at(table, ext), F.lit(default_mb)).cast("long") * F.lit(1024 * 1024)


def too_large(path: Column, size: Column, **limits) -> Column:
    limit = size_limit(path, **limits)
    return (limit > 0) & (size > limit)


class GitignoreRule:
    """One line of the .gitignore of the root: anchored rules match the relative path, others the base name."""

    def __init__(self, line: str):
        self.dir_only = line.endswith("/")
        body = line.rstrip("/") if self.dir_only else line
        self.anchored = "/" in body
        self.pattern = body.lstrip("/")

    def matches(self, relative: Column, name: Column) -> Column:
        return matches_any(relative if self.anchored else name, [self.pattern], False)

    @staticmethod
    def parse(text: str) -> list["GitignoreRule"]:
        """Blank lines and comments are skipped; '!' has no meaning of its own."""
        return [GitignoreRule(s) for raw in text.splitlines() if (s := raw.strip()) and not s.startswith("#")]


def _on_directory(rule: GitignoreRule):
    return lambda d: rule.matches(d, base_name(d))


def gitignored(relative: Column, rules: list[GitignoreRule]) -> Column:
    """Whether a rule matches the file or, also those for directories only, one of the directories above it."""
    parts = F.split(relative, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    found = F.lit(False)
    for rule in rules:
        found = found | F.exists(above, _on_directory(rule))
        if not rule.dir_only:
            found = found | rule.matches(relative, base_name(relative))
    return found
