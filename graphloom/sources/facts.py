"""Git history, coverage reports, lock files, workspace layouts and configuration."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Callable
from fnmatch import fnmatch
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- git


def _git(root: str, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=300).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


#: (root, arguments) -> output of the git command, "" if it fails; a caller may bring another.
GitProvider = Callable[..., str]


def changed_files(spark: SparkSession, root: str, base: str | None = None, git: GitProvider = _git) -> DataFrame:
    """(path): unstaged, staged, untracked and, with a base, committed changes; a failing command adds nothing."""
    out = [*(git(root, *command.split()) for command in ("diff --name-only", "diff --name-only --cached", "ls-files --exclude-standard --others"))]
    if base:
        out.append(git(root, "diff", "--name-only", f"{base}...HEAD"))
    names = sorted({line for text in out for line in text.splitlines() if line})
    return spark.createDataFrame([(n,) for n in names], "path STRING")


def git_log(root: str, git: GitProvider = _git) -> str:
    return git(root, *"log -M --name-status --format=%x00%H%x09%ae%x09%ct".split())


def commits_of(log: DataFrame) -> DataFrame:
    """(path, author, ts, log_seq) from rows (log_seq, entry), one log entry each; renames and copies go to the new path."""
    head = F.split(F.element_at(F.split("entry", "\n"), 1), "\t")
    lines = F.filter(F.slice(F.split("entry", "\n"), 2, 1_000_000), lambda x: x.contains("\t"))
    rows = log.select("log_seq", head[1].alias("author"), F.timestamp_seconds(head[2].cast("long")).alias("ts"), F.explode(lines).alias("line"))
    parts = F.split("line", "\t")
    path = F.when(parts[0].rlike("^[RC]"), F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1)))
    return rows.select(path.alias("path"), "author", "ts", "log_seq").where("path is not null")


def log_entries(spark: SparkSession, text: str) -> DataFrame:
    """(log_seq, entry); the newest entry has the highest number."""
    entries = [e.strip("\n") for e in text.split("\0") if e.strip()]
    return spark.createDataFrame([(len(entries) - i, e) for i, e in enumerate(entries)], "log_seq LONG, entry STRING")


# ---- coverage


def coverage(spark: SparkSession, report: str, root: str) -> DataFrame:
    """(path, pct) from a coverage summary; what can't be read is an empty table."""
    try:
        found = json.loads(Path(report).read_text())
        base = root.rstrip("/") + "/"
        rows = [(k.removeprefix(base), float(v["lines"]["pct"])) for k, v in found.items() if k != "total" and isinstance(v.get("lines", {}).get("pct"), (int, float))]
    except (OSError, ValueError, AttributeError):
        rows = []
    return spark.createDataFrame(rows, "path STRING, pct DOUBLE")


# ---- lock files


def parse_package_lock(text: str) -> dict[str, str]:
    data = json.loads(text)
    if "packages" in data:
        inner = "node_modules/"
        return {k[len(inner) :]: v["version"] for k, v in data["packages"].items() if k.startswith(inner) and inner not in k[len(inner) :] and "version" in v}
    return {k: v["version"] for k, v in data.get("dependencies", {}).items() if "version" in v}


def _bare_name(spec: str) -> str:
    spec = spec.strip().strip('"')
    return spec[: spec.index("@", 1)] if "@" in spec[1:] else spec


def parse_yarn_lock(text: str) -> dict[str, str]:
    """Classic and berry: a block names its specifiers on an unindented line and its version below."""
    out: dict[str, str] = {}
    for block in re.split(r"\n\s*\n", text):
        lines = [x for x in block.splitlines() if x.strip() and not x.startswith("#")]
        if not lines or lines[0][0].isspace() or lines[0].startswith("__metadata"):
            continue
        version = next((m.group(1) for x in lines[1:] if (m := re.match(r"\s+version:?\s+\"?([^\"\s]+)\"?", x))), None)
        if version:
            for spec in lines[0].rstrip(":").strip('"').split(","):
                out.setdefault(_bare_name(spec), version)
    return out


def parse_pnpm_lock(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    section = ""
    for line in text.splitlines():
        if line and not line[0].isspace():
            section = line.split(":")[0]
        if section == "packages" and (m := re.match(r"  ['\"]?/?((?:@[^/@'\"]+/)?[^/@'\"(]+)[@/](\d[^'\":(]*)", line)):
            out.setdefault(m.group(1), m.group(2))
        elif section == "dependencies" and (m := re.match(r"  ['\"]?([^'\":]+)['\"]?:\s*(\d\S*)", line)):
            out.setdefault(m.group(1), m.group(2))
    return out


LOCK_FILES = (("package-lock.json", parse_package_lock), ("yarn.lock", parse_yarn_lock), ("pnpm-lock.yaml", parse_pnpm_lock))


def lock_versions(spark: SparkSession, root: str) -> DataFrame:
    """(name, version) from the first lock file that is there."""
    for name, parser in LOCK_FILES:
        path = Path(root, name)
        if path.is_file():
            try:
                return spark.createDataFrame(sorted(parser(path.read_text()).items()), "name STRING, version STRING")
            except ValueError:
                break
    return spark.createDataFrame([], "name STRING, version STRING")


# ---- workspaces


def _manifest(path: Path) -> dict:
    try:
        return json.loads((path / "package.json").read_text())
    except (OSError, ValueError):
        return {}


def expand_globs(root: str, patterns: list[str]) -> list[str]:
    """Folders with a package.json that the patterns name; `!` excludes, node_modules never counts."""
    base, out = Path(root), []
    for p in patterns:
        if not p.startswith("!"):
            for found in sorted(base.glob(p.strip("/"))):
                relative = found.relative_to(base).as_posix()
                if found.is_dir() and (found / "package.json").is_file() and "node_modules" not in found.parts and relative not in out:
                    out.append(relative)
    return [x for x in out if not any(fnmatch(x, p[1:].strip("/")) for p in patterns if p.startswith("!"))]


def entry_points(folder: str) -> list[str]:
    """First existing of exports["."] (import, require, default), main and the usual names; dist is looked for in src too."""
    base, manifest = Path(folder), _manifest(Path(folder))
    root = manifest.get("exports")
    root = root.get(".", root) if isinstance(root, dict) else root
    names = [root[k] for k in ("import", "require", "default") if isinstance(root.get(k), str)] if isinstance(root, dict) else [root] if isinstance(root, str) else []
    names += [manifest[k] for k in ("main", "module") if isinstance(manifest.get(k), str)] + "src/index.ts src/index.tsx src/index.js index.ts index.js src/main.ts".split()
    for n in names:
        n = n.removeprefix("./")
        for candidate in (n, *(re.sub(r"^dist/", "src/", re.sub(r"\.(?:c|m)?js$", e, n)) for e in (".ts", ".tsx", ".js"))):
            if (base / candidate).is_file():
                return [candidate]
    return []


def public_entries(root: str) -> list[list[list[str]]]:
    """Groups of published files, each with the paths it may have (dist is looked for in src): the exports map, then main and module.

    An export with conditions counts once, by import, require or default, whichever leads somewhere first.
    """
    manifest = _manifest(Path(root))

    def paths(value) -> list[str]:
        if isinstance(value, str):
            name = value.removeprefix("./")
            return [name, re.sub(r"\.(?:js|mjs|cjs)$", ".ts", re.sub(r"^dist/", "src/", name))]
        return [p for k in ("import", "require", "default") for p in paths(value.get(k))] if isinstance(value, dict) else []

    exports = manifest.get("exports")
    published = list(exports.values()) if isinstance(exports, dict) else [exports]
    return [[p for x in published if (p := paths(x))], [p for k in ("main", "module") if (p := paths(manifest.get(k)))]]


def read_tsconfig(root: str, folders: tuple[str, ...] = ("",)) -> tuple[str | None, dict[str, list[str]]]:
    """(base_url, ts_paths) for `BuildOptions` from the first tsconfig.json in the folders; comments and trailing commas are allowed."""
    for folder in folders:
        path = Path(root, folder, "tsconfig.json")
        if not path.is_file():
            continue
        text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", path.read_text(), flags=re.S)
        try:
            options = json.loads(re.sub(r",(\s*[}\]])", r"\1", text)).get("compilerOptions", {})
        except ValueError:
            return None, {}
        join = lambda x: "/".join(p for p in f"{folder}/{x}".split("/") if p not in ("", "."))
        base = options.get("baseUrl")
        paths = {a: [join(f"{base or '.'}/{t}") for t in ts] for a, ts in (options.get("paths") or {}).items()}
        return None if base is None else join(base) or ".", paths
    return None, {}


def parse_go_mod(text: str) -> tuple[str | None, dict[str, str]]:
    """(module, replaces) for `BuildOptions`: only replacements by a local folder count."""
    module, replaces, block = None, {}, False
    for raw in text.splitlines():
        line = raw.split("//")[0].strip()
        if line.startswith("module "):
            module = line[7:].strip()
        elif re.match(r"replace\s*\(", line):
            block = True
        elif block and line == ")":
            block = False
        elif "=>" in line and (block or re.match(r"replace\s", line)):
            a, b = (x.strip() for x in re.sub(r"^replace\s+", "", line).split("=>", 1))
            if a and b.startswith((".", "/")):
                replaces[a.split()[0]] = b
    return module, replaces


def go_module(root: str) -> tuple[str | None, dict[str, str]]:
    """`parse_go_mod` of the root's go.mod, nothing without one."""
    path = Path(root, "go.mod")
    return parse_go_mod(path.read_text()) if path.is_file() else (None, {})


def _npm(root: Path) -> list[str] | None:
    w = _manifest(root).get("workspaces")
    return w.get("packages") if isinstance(w, dict) else w


def _pnpm(root: Path) -> list[str] | None:
    path = root / "pnpm-workspace.yaml"
    return re.findall(r"^\s*-\s*['\"]?([^'\"\n]+?)['\"]?\s*$", path.read_text(), re.M) if path.is_file() else None


def _nx(root: Path) -> list[str] | None:
    return ["apps/*", "libs/*", "packages/*"] if (root / "nx.json").is_file() else None


DETECTORS = (
    ("turborepo", lambda r: (_pnpm(r) or _npm(r)) if (r / "turbo.json").is_file() else None),
    ("nx", lambda r: (_npm(r) or _nx(r)) if (r / "nx.json").is_file() else None),
    ("pnpm", _pnpm),
    ("yarn", lambda r: _npm(r) if (r / "yarn.lock").is_file() else None),
    ("npm", _npm),
)


def detect_workspace(spark: SparkSession, root: str, detectors=DETECTORS) -> tuple[str | None, DataFrame]:
    """Kind of the first detector that answers, and packages (pkg_seq, name, relative_root, entry_points), first name wins."""
    kind, rows, seen = None, [], set()
    for name, detect in detectors:
        patterns = detect(Path(root))
        if patterns:
            kind = kind or name
            for folder in expand_globs(root, patterns):
                label = _manifest(Path(root, folder)).get("name") or folder.rsplit("/", 1)[-1]
                if label not in seen:
                    seen.add(label)
                    rows.append((len(rows), label, folder, [f"{folder}/{e}" for e in entry_points(f"{root}/{folder}")]))
    return kind, spark.createDataFrame(rows, "pkg_seq INT, name STRING, relative_root STRING, entry_points ARRAY<STRING>")


def load_config(root: str, name: str = "graphloom.config.json") -> dict:
    """The project's JSON configuration; none is an empty one."""
    path = Path(root, name)
    return json.loads(path.read_text()) if path.is_file() else {}
