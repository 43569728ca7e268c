"""File types, categories and tags of source files, by an immutable configuration."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

EXTENSIONS = {
    "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .tsx", "css": ".css", "scss": ".scss .sass", "less": ".less", "stylus": ".styl", "coffeescript": ".coffee",
    "livescript": ".ls", "lua": ".lua", "python": ".py", "go": ".go", "gherkin": ".feature", "markdown": ".md .mdx",
}
TYPE_OF = {e: kind for kind, names in EXTENSIONS.items() for e in names.split()}
STYLE_EXTENSIONS = tuple(".css .less .sass .scss .styl".split())


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return name[dot:].lower() if dot > 0 else ""


def file_type(path: str) -> str:
    return TYPE_OF.get(extension(path), "unknown")


def is_style(specifier: str) -> bool:
    return extension(specifier) in STYLE_EXTENSIONS


@dataclass(frozen=True)
class ClassifyConfig:
    """What counts as config or test; a value passed along, never global state."""

    config_matchers: tuple[str | re.Pattern | Callable[[str], bool], ...] = ("tsconfig", ".config.", ".eslintrc", ".prettierrc", "package.json")
    test_patterns: tuple[str, ...] = tuple("-spec. .spec. -test. .test.".split())
    test_libraries: tuple[str, ...] = tuple("@testing-library/ cypress jest playwright vitest".split())
    barrel_threshold: float = 0.8

    def adding(self, **more) -> ClassifyConfig:
        return replace(self, **{k: (*getattr(self, k), *v) if isinstance(v, (tuple, list)) else v for k, v in more.items()})

    def is_config(self, name: str) -> bool:
        return any(m in name if isinstance(m, str) else bool(m.search(name)) if isinstance(m, re.Pattern) else m(name) for m in self.config_matchers)

    def is_test(self, name: str) -> bool:
        return any(p in name for p in self.test_patterns)

    def imports_test_library(self, specifiers) -> bool:
        return any(lib in s for s in specifiers for lib in self.test_libraries)


DEFAULT = ClassifyConfig()


def at_tags(text: str) -> list[str]:
    """Names after `@tag`, in order, each once."""
    return list(dict.fromkeys(re.findall(r"@tag\s+([\w-]+)", text, re.A)))
