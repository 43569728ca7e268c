"""Styles, Markdown, Gherkin, Lua, CoffeeScript and LiveScript by their line-level constructs."""

from __future__ import annotations

import re

from graphloom.functions.classify import ClassifyConfig, at_tags

REMOTE = tuple("# // data: http:// https:// mailto:".split())


def _result(imports=(), exports=(), tags=(), category="other", **more) -> dict:
    return {"imports": list(imports), "exports": list(exports), "tags": list(tags), "category": category, "functions": [], "calls": [], "description": None, "complexity": None, "cognitive": None} | more


def _edge(specifier: str, kind: str = "static", symbols=None, **more) -> dict:
    return {"specifier": specifier, "type": kind, "symbols": symbols} | more


def _remote(specifier: str) -> bool:
    return specifier.startswith(tuple("// http:// https://".split()))


def _style_category(text: str, imports: list, rule: str = r"[^{}@;]+\{") -> str:
    return "ui" if not imports or re.search(rule, re.sub(r"@[\w-]+[^;{]*;", "", text)) else "barrel"


def _strip(text: str, line: bool) -> str:
    text = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    return re.sub(r"(?<![:\w\"'(])//[^\n]*", "", text) if line else text


def _css_imports(text: str) -> list[dict]:
    found = []
    for m in re.finditer(r"@import\s+(?:\(([^)]*)\)\s*)?(?:url\(\s*['\"]?([^'\")]+)['\"]?\s*\)|['\"]([^'\"]+)['\"])|:[^;{}]*?url\(", text):
        spec = m.group(2) or m.group(3)
        if spec:
            found.append(_edge(spec.strip(), "side-effect" if {"reference", "inline"} & set(re.split(r"[,\s]+", m.group(1) or "")) else "static", is_external=_remote(spec)))
    for value in re.findall(r":[^;{}]*url\([^;{}]*", re.sub(r"@import[^;]*;?", "", text)):
        found += [_edge(s.strip()) for s in re.findall(r"url\(\s*['\"]?([^'\")]+)['\"]?\s*\)", value) if not s.strip().startswith(REMOTE)]
    return found


def parse_css(path: str, text: str, config: ClassifyConfig) -> dict:
    text = _strip(text, True)
    imports = _css_imports(text)
    return _result(imports, category=_style_category(text, imports))


def parse_less(path: str, text: str, config: ClassifyConfig) -> dict:
    text = _strip(text, True)
    imports = _css_imports(text)
    names = list(dict.fromkeys(re.findall(r"^\s*(@[\w-]+)\s*:", text, re.M)))
    return _result(imports, [{"name": n} for n in names], [(n.lstrip("@"), "variable") for n in names], _style_category(text, imports))


def parse_scss(path: str, text: str, config: ClassifyConfig) -> dict:
    text = _strip(text, True)
    imports = []
    for m in re.finditer(r"@(import|use|forward)\s+([^;\n]+)", text):
        specs = re.findall(r"['\"]([^'\"]+)['\"]", m.group(2))
        alias = re.search(r"\bas\s+([\w*-]+)", m.group(2))
        for s in specs[: None if m.group(1) == "import" else 1]:
            imports.append(_edge(s, "re-export" if m.group(1) == "forward" else "static", [alias.group(1)] if alias else None, is_external=_remote(s) or s.startswith("sass:")))
    imports += [_edge(s.strip()) for s in re.findall(r"url\(\s*['\"]?([^'\")]+)['\"]?\s*\)", re.sub(r"@(import|use|forward)[^;\n]+", "", text)) if not s.strip().startswith(REMOTE)]
    names = re.findall(r"^\s*\$([\w-]+)\s*:|@(?:mixin|function)\s+([\w-]+)", text, re.M)
    flat = list(dict.fromkeys(a or b for a, b in names))
    return _result(imports, [{"name": n} for n in flat if n[0] not in "_-"], [], _style_category(text, imports))


def parse_stylus(path: str, text: str, config: ClassifyConfig) -> dict:
    imports = [_edge(s, is_external=_remote(s)) for s in re.findall(r"^\s*@?(?:require|import)[\s(]*['\"]([^'\"]+)['\"]", text, re.M)]
    rest = re.sub(r"^\s*@?(?:import|require)[^\n]*", "", text, flags=re.M)
    return _result(imports, category="ui" if not imports or re.search(r"^[^\s@/$][^\n]*$", rest, re.M) else "barrel")


_PATH = re.compile(r"(?:\.{1,2}/)?[\w.-]+(?:/[\w.-]+)*\.(?:coffee|cjs|css|feature|go|json|jsx|js|less|ls|lua|mdx|md|mjs|py|scss|styl|tsx|ts)\b")


def parse_markdown(path: str, text: str, config: ClassifyConfig) -> dict:
    found = []
    for m in re.finditer(r"^(```|~~~)[^\n]*\n(.*?)^\1|`([^`\n]+)`|(?<!!)\[[^\]]*\]\(\s*<?([^)>\s]+)[^)]*\)|^\[[^\]]+\]:\s*(\S+)", text, re.S | re.M):
        link = m.group(4) or m.group(5)
        if link:
            target = link.split("#")[0].split("?")[0]
            if target and not link.strip().startswith(REMOTE):
                found.append(target)
        else:
            found += _PATH.findall(m.group(2) or m.group(3) or "")
    head = re.search(r"^#\s+(.+)$", text, re.M)
    return _result([_edge(s, bare=not s.startswith(".")) for s in dict.fromkeys(found)], description=head.group(1).strip() if head else None)


def parse_gherkin(path: str, text: str, config: ClassifyConfig) -> dict:
    names = [t[1:] for line in text.splitlines() if line.strip().startswith("@") for t in line.split() if t.startswith("@") and len(t) > 1]
    title = re.search(r"^\s*Feature:\s*(.+)$", text, re.M)
    return _result(tags=[(n, "comment-marker") for n in dict.fromkeys(names)], category="test", description=title.group(1).strip() if title else None)


def _test_or_logic(path: str, imports: list[dict], config: ClassifyConfig) -> str:
    return "test" if config.is_test(path.rsplit("/", 1)[-1].lower()) or config.imports_test_library(i["specifier"] for i in imports) else "logic"


def parse_lua(path: str, text: str, config: ClassifyConfig) -> dict:
    code = re.sub(r"--\[\[.*?\]\]|--[^\n]*", "", text, flags=re.S)
    imports = [_edge(s, "require", bare=not s.startswith(".")) for s in re.findall(r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]", code)]
    names: list[str] = []
    for module in re.findall(r"^\s*return\s+([A-Za-z_]\w*)\s*$", code, re.M)[-1:]:
        names += [a or b for a, b in re.findall(rf"\bfunction\s+{module}[.:](\w+)|\b{module}\.(\w+)\s*=(?!=)", code)]
    if table := re.search(r"\breturn\s*\{(.*)\}\s*$", code.strip(), re.S):
        names += re.findall(r"(?:^|[,;{])\s*(\w+)\s*=(?!=)", table.group(1))
    return _result(imports, [{"name": n} for n in dict.fromkeys(names)], [(t, "comment-marker") for t in at_tags(text)], _test_or_logic(path, imports, config))


def _indented(path: str, text: str, config: ClassifyConfig) -> dict:
    """CoffeeScript and LiveScript share these constructs; an approximation of both."""
    code = re.sub(r"###.*?###|/\*.*?\*/", "", text, flags=re.S)
    code = re.sub(r"(?m)(^|\s)#(?!\{)[^\n]*", r"\1", code)
    imports = []
    for m in re.finditer(r"^\s*import\s+(?:(.+?)\s+from\s+)?['\"]([^'\"]+)['\"]", code, re.M):
        names = []
        for part in re.split(r"[{},\s]+(?!as\b)", m.group(1) or ""):
            if part and part not in ("as",):
                names.append("*" if part == "*" else part)
        braced = re.search(r"\{(.*)\}", m.group(1) or "", re.S)
        symbols = [x.strip().split(" as ")[-1] for x in braced.group(1).split(",") if x.strip()] if braced else ["*"] if "*" in (m.group(1) or "") else ["default"] if m.group(1) else None
        imports.append(_edge(m.group(2), "static" if symbols else "side-effect", symbols))
    imports += [_edge(s, "require") for s in re.findall(r"\brequire!?\s*\(?\s*['\"]([^'\"]+)['\"]", code)]
    names = [a or b or c for a, b, c in re.findall(r"(?m)\b(?:module\.)?exports\.(\w+)\s*=|^\s*export\s+(?:default\s+)?(?:class|const|let|var|function)?\s*(\w+)|^\s*exports\.(\w+)\s*=", code)]
    if table := re.search(r"module\.exports\s*=\s*\{([^}]*)\}", code):
        names += [x.split(":")[0].strip() for x in re.split(r"[,\n]", table.group(1)) if x.strip()]
    return _result(imports, [{"name": n} for n in dict.fromkeys(names) if n], [(t, "comment-marker") for t in at_tags(text)], _test_or_logic(path, imports, config))


parse_coffee = parse_livescript = _indented
