"""Writing tags into test files, by framework; every writer gives the same text when it runs again."""

from __future__ import annotations

import re

GENERIC = frozenset("fixture fixtures mock mocks spec test tests setup helper helpers util utils types shared common index main".split())
_BEGIN, _END = "# graphloom:tags", "# graphloom:end"


def writable(tags: list[str]) -> list[str]:
    """Valid names that say something, sorted, each once."""
    return sorted({t for t in tags if re.fullmatch(r"[a-zA-Z][\w-]+", t, re.A) and t.lower() not in GENERIC})


def gherkin(source: str, tags: list[str]) -> str:
    block = re.compile(rf"[ \t]*{_BEGIN}\n(?:.*\n)*?[ \t]*{_END}\n")
    manual = set(re.findall(r"@([\w-]+)", block.sub("", source)))
    new = [t for t in tags if t not in manual]
    text = f"{_BEGIN}\n{' '.join('@' + t for t in new)}\n{_END}\n" if new else ""
    if block.search(source):
        return block.sub(lambda _: text, source, count=1)
    return re.sub(r"^(Feature:)", lambda m: text + m.group(1), source, count=1, flags=re.M) if text else source


def pytest(source: str, tags: list[str]) -> str:
    mark = re.compile(r"^pytestmark\s*=\s*\[.*?\]\n?|^pytestmark\s*=\s*[^\n]*\n?", re.M | re.S)
    line = f"pytestmark = [{', '.join('pytest.mark.' + t.replace('-', '_') for t in tags)}]\n"
    found = mark.search(source)
    if not tags:
        return re.sub(r"\n{3,}", "\n\n", mark.sub("", source)) if found else source
    if found:
        return source[: found.start()] + line + source[found.end() :]
    at = 0
    for m in re.finditer(r"^(?:import\s[^\n]*|from\s+\S+\s+import\s+(?:\([^)]*\)|[^\n(]*))\n?", source, re.M):
        at = m.end()
    need = "" if re.search(r"^import pytest\b", source, re.M) else "import pytest\n"
    before = source[:at]
    return before + ("\n" if before and not before.endswith("\n") else "") + need + ("\n" if before or need else "") + line + source[at:]


def go(source: str, tags: list[str]) -> str:
    own = re.compile(r"^//go:build [^\n]*// graphloom\n\n?", re.M)
    line = f"//go:build {' || '.join(t.replace('-', '_') for t in tags)} // graphloom\n\n" if tags else ""
    if own.search(source):
        return own.sub(lambda _: line, source, count=1)
    return re.sub(r"^(package\s)", lambda m: line + m.group(1), source, count=1, flags=re.M) if line else source


def _call_option(names: str, key: str, quote):
    call = re.compile(rf"(?m)^(?P<head>\s*(?:{names})\(\s*(?:'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`[^`]*`)\s*,\s*)(?P<own>\{{\s*{key}:\s*\[[^\]]*\]\s*\}}\s*,\s*)?")

    def write(source: str, tags: list[str]) -> str:
        option = f"{{ {key}: [{', '.join(quote(t) for t in tags)}] }}, " if tags else ""
        return call.sub(lambda m: m.group("head") + option, source, count=1)

    return write


vitest = _call_option("describe|suite|test|it", "tags", lambda t: f"'{t}'")
playwright = _call_option(r"test\.describe|test", "tag", lambda t: f"'@{t}'")
cypress = _call_option("describe|context|it", "tags", lambda t: f"'@{t}'")


def jest(source: str, tags: list[str]) -> str:
    """A docblock at the top of the file."""
    own = re.compile(r"\A/\*\*\n \* @group [^\n]*\n(?: \* @group [^\n]*\n)* \*/\n")
    text = "/**\n" + "".join(f" * @group {t}\n" for t in tags) + " */\n" if tags else ""
    return own.sub(lambda _: text, source, count=1) if own.search(source) else text + source


STRATEGIES = {"gherkin": gherkin, "pytest": pytest, "go": go, "vitest": vitest, "jest": jest, "playwright": playwright, "cypress": cypress}


def strategy_of(path: str, source: str, overrides: dict[str, str] | None = None, default: str = "vitest") -> str | None:
    """By file name, then by what the file imports, then by an override pattern, then the default; None for what can't be tagged."""
    from graphloom.operators.reports import glob_pattern

    if path.endswith(".feature"):
        return "gherkin"
    if path.endswith(".py"):
        return "pytest"
    if path.endswith("_test.go"):
        return "go"
    if not re.search(r"\.[cm]?[jt]sx?$", path):
        return None
    for name, sign in (("playwright", "@playwright/test"), ("vitest", "vitest"), ("jest", "@jest/globals")):
        if re.search(rf"['\"]{re.escape(sign)}['\"]", source):
            return name
    if ".cy." in path or re.search(r"\bcy\.\w+\(", source):
        return "cypress"
    return next((name for glob, name in (overrides or {}).items() if re.search(glob_pattern(glob), path)), default)


def tagged(path: str, source: str, tags: list[str], overrides: dict[str, str] | None = None, more: dict | None = None) -> tuple[str | None, str]:
    """(strategy, new source); `more` adds writers (source, tags) -> source, which an override may name for any file, or replaces some."""
    from graphloom.operators.reports import glob_pattern

    own = next((name for glob, name in (overrides or {}).items() if name in (more or {}) and re.search(glob_pattern(glob), path)), None)
    name = own or strategy_of(path, source, overrides)
    return name, {**STRATEGIES, **(more or {})}[name](source, writable(tags)) if name else source
