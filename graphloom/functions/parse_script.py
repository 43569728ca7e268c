"""TypeScript, JavaScript and Go by a tokenizer and brace matching: a documented approximation of their grammars.

Exact for import and export statements, top-level declarations, methods and branch keywords; generics,
decorators and template-string contents are passed over as tokens.
"""

from __future__ import annotations

import re

from graphloom.functions.classify import ClassifyConfig, at_tags, extension

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|&&=?|\|\|=?|\?\?=?|\?\.|===|!==|==|!=|<=|>=|:=|\.\.\.|\S)",
    re.S,
)


class Token(tuple):
    """(kind, text, line, place)"""

    kind = property(lambda s: s[0])
    text = property(lambda s: s[1])
    line = property(lambda s: s[2])


def tokens(text: str) -> tuple[list[Token], list[str]]:
    """Tokens without comments, and the comments."""
    out, comments, line, at = [], [], 1, 0
    for m in _TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup == "comment":
            comments.append(m.group())
        else:
            out.append(Token((m.lastgroup, m.group(), line, m.start())))
    return out, comments


def closing(ts: list[Token], at: int) -> int:
    """Place of the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(ts)):
        if ts[i].kind == "op":
            depth += ts[i].text in "([{"
            depth -= ts[i].text in ")]}"
            if not depth:
                return i
    return len(ts) - 1


def _names(ts: list[Token], a: int, b: int) -> list[tuple[str, str]]:
    """(name, alias) pairs of a braced list."""
    out, i = [], a + 1
    while i < b:
        if ts[i].kind == "name":
            name = ts[i].text
            if name == "type" and ts[i + 1].kind == "name" and ts[i + 1].text != "as":
                i, name = i + 1, ts[i + 1].text
            alias = name
            if ts[i + 1].text == "as":
                alias, i = ts[i + 2].text, i + 2
            out.append((name, alias))
        i += 1
    return out


def _unquote(t: Token) -> str:
    return t.text[1:-1]


BRANCH = {"if", "for", "while", "do", "catch", "case"}


def cyclomatic(ts: list[Token]) -> int:
    total = 1
    for i, t in enumerate(ts):
        if t.kind == "name" and t.text in BRANCH and not (i and ts[i - 1].text in (".", "?.")):
            # the while of a do-while belongs to the do
            total += not (t.text == "while" and i and ts[i - 1].text == "}" and _closes_do(ts, i - 1))
        elif t.kind == "op" and t.text in ("&&", "||", "??"):
            total += 1
        elif t.text == "?" and i + 1 < len(ts) and ts[i + 1].text not in (":", ")", ",", ".", ";", "="):
            total += 1
    return total


def _closes_do(ts: list[Token], at: int) -> bool:
    depth = 0
    for i in range(at, -1, -1):
        depth += ts[i].text == "}"
        depth -= ts[i].text == "{"
        if not depth:
            return bool(i) and ts[i - 1].text == "do"
    return False


def cognitive(ts: list[Token]) -> int:
    """Branches weighed by the blocks they lie in; else and else-if add one, runs of one boolean operator add one."""
    total, depth, stack, pending, last = 0, 0, [], False, ""
    for i, t in enumerate(ts):
        before = ts[i - 1].text if i else ""
        if t.kind == "name" and before not in (".", "?."):
            if t.text == "else":
                total += 1
                pending = True
            elif t.text == "if" and before == "else":
                pending = True
            elif t.text in ("if", "for", "while", "switch", "do", "select"):
                if not (t.text == "while" and before == "}" and _closes_do(ts, i - 1)):
                    total += 1 + depth
                    pending = True
            elif t.text == "catch":
                total += 1 + depth
        elif t.text == "?" and i + 1 < len(ts) and ts[i + 1].text not in (":", ")", ",", ".", ";", "="):
            total += 1 + depth
        elif t.text in ("&&", "||", "??"):
            total += t.text != last
            last = t.text
        if t.text in (";", "{", "}", ","):
            last = ""
        if t.text == "{":
            nested = before == "=>" and i > 1 and bool(stack)
            total += (1 + depth) * nested
            stack.append(pending or nested)
            depth += pending or nested
            pending = False
        elif t.text == "}" and stack:
            depth -= stack.pop()
    return total


def _doc(comments_before: str | None) -> tuple[str | None, list[str]]:
    if not comments_before or not comments_before.startswith("/**"):
        return None, []
    body = re.sub(r"^\s*\*\s?", "", comments_before[3:-2], flags=re.M).strip()
    flags = [f for f in "alpha beta deprecated internal public".split() if f"@{f}" in body]
    return re.split(r"\n\s*@", body)[0].strip() or None, flags


def _initializer(ts: list[Token], j: int) -> int:
    """Place of the first token of the value that a variable declared before place j begins with, -1 if it has none."""
    n, angles = len(ts), 0
    if j < n and ts[j].text == "!":
        j += 1
    if j < n and ts[j].text == ":":
        while j < n and ts[j].text not in ("=", ";") and not (ts[j].text == "," and not angles):
            angles += (ts[j].text == "<") - (ts[j].text == ">")
            j = closing(ts, j) + 1 if ts[j].text in ("(", "[", "{") else j + 1
    return j + 1 if j < n and ts[j].text == "=" else -1


def _is_function(ts: list[Token], k: int) -> bool:
    """Whether the value at place k is an arrow function or a function expression, and not what comes of calling one."""
    n = len(ts)
    text_at = lambda m: ts[m].text if m < n else ""
    if text_at(k) == "async" and text_at(k + 1) != "=>":
        k += 1
    if text_at(k) == "function":
        opening = next((m for m in range(k, n) if ts[m].text == "("), n)
        body = closing(ts, opening) + 1 if opening < n else n
        while body < n and ts[body].text != "{":
            body += 1
        return body < n and text_at(closing(ts, body) + 1) not in ("(", ".", "?.", "[")
    if text_at(k) == "<":
        angles, m = 0, k
        while m < n and (m == k or angles):
            angles += (ts[m].text == "<") - (ts[m].text == ">")
            m += 1
        k = m
    if text_at(k) == "(":
        return text_at(closing(ts, k) + 1) in ("=>", ":")
    return k < n and ts[k].kind == "name" and text_at(k + 1) == "=>"


def parse(path: str, text: str, config: ClassifyConfig) -> dict:
    ts, comments = tokens(text)
    imports, exports, functions, calls, tags = [], [], [], [], []
    known: dict[str, tuple[str, str]] = {}
    statements = export_statements = 0
    type_only = True
    name = path.rsplit("/", 1)[-1].lower()
    depth, i, n = 0, 0, len(ts)
    text_at = lambda k: ts[k].text if k < n else ""

    def body_of(k: int) -> tuple[int, int]:
        """Range of the first braced block after place k at bracket level 0, or of the expression up to ';'."""
        j = k
        while j < n and ts[j].text not in ("{", ";"):
            j = closing(ts, j) + 1 if ts[j].text in ("(", "[") else j + 1
        return (j, closing(ts, j) + 1) if j < n and ts[j].text == "{" else (k, j)

    def function(label: str, k: int, caller: bool) -> int:
        a, b = body_of(k)
        functions.append({"name": label, "line": ts[k].line, "complexity": cyclomatic(ts[a:b]), "cognitive": cognitive(ts[a:b])})
        if caller:
            for j in range(a, b - 1):
                if ts[j].kind == "name" and ts[j + 1].text == "(" and text_at(j - 1) not in (".", "?.") and ts[j].text in known:
                    calls.append({"from_fn": label, "to_fn": known[ts[j].text][0], "specifier": known[ts[j].text][1]})
        return b

    while i < n:
        t = ts[i]
        if t.text == "import" and text_at(i + 1) != "(" and text_at(i - 1) != "." and depth == 0:
            statements += 1
            j, symbols, typed = i + 1, [], text_at(i + 1) == "type" and text_at(i + 2) != "from"
            j += typed
            type_only &= typed
            start = j
            while j < n and ts[j].kind != "string" and text_at(j) != ";":
                if ts[j].text == "{":
                    end = closing(ts, j)
                    for real, alias in _names(ts, j, end):
                        symbols.append(alias)
                        known[alias] = (real, "")
                    j = end
                elif ts[j].text == "*":
                    symbols.append("*")
                    j += 2
                elif ts[j].kind == "name" and ts[j].text not in ("from", "as") and j == start:
                    symbols.append("default")
                    known[ts[j].text] = ("default", "")
                j += 1
            if j < n and ts[j].kind == "string":
                spec = _unquote(ts[j])
                known.update({k: (r, spec) for k, (r, s) in known.items() if not s})
                imports.append({"specifier": spec, "type": "static" if symbols else "side-effect", "symbols": symbols or None, "at": i})
            i = j + 1
            continue
        if t.text == "export" and depth == 0:
            statements += 1
            export_statements += 1
            place = ts[i][3]
            found = re.search(r"(/\*\*(?:(?!\*/).)*\*/)\s*$", text[:place], re.S)
            doc, flags = _doc(found.group(1) if found else None)
            j = i + 1
            typed = text_at(j) == "type" and text_at(j + 1) in ("{", "*")
            j += typed
            if text_at(j) in ("{", "*"):
                names, end = ([], j) if text_at(j) == "*" else (_names(ts, j, closing(ts, j)), closing(ts, j))
                space = text_at(j) == "*" and text_at(j + 1) == "as"
                end += 2 * space
                if text_at(end + 1) == "from" and end + 2 < n and ts[end + 2].kind == "string":
                    imports.append({"specifier": _unquote(ts[end + 2]), "type": "re-export", "symbols": None if space else [a for _, a in names] or ["*"], "at": i})
                    end += 2
                exports += [{"name": alias} for _, alias in names] + ([{"name": text_at(j + 2)}] if space else [])
                type_only &= typed
                i = end + 1
                continue
            default = text_at(j) == "default"
            j += default
            while text_at(j) in ("async", "abstract", "declare"):
                j += 1
            kind = text_at(j)
            if kind in ("interface", "type") or (kind == "enum"):
                label, signature = text_at(j + 1), f"{kind} {text_at(j + 1)}"
                type_only &= kind != "enum"
            elif kind in ("class", "namespace"):
                label, signature, type_only = text_at(j + 1), f"{kind} {text_at(j + 1)}", False
            elif kind == "function":
                k = j + 1 + (text_at(j + 1) == "*")
                label, type_only = text_at(k), False
                opening = next((m for m in range(k, n) if ts[m].text == "("), k)
                end = closing(ts, opening)
                signature = text[ts[opening][3] : ts[end][3] + 1]
            else:
                j += text_at(j + 1) == "enum"
                label, signature, type_only = text_at(j + 1) if kind in ("const", "let", "var") else "default", kind + " " + text_at(j + 1), False
            exports.append({"name": "default" if default else label, "doc": doc, "flags": flags or None, "signature": signature if label else None})
            i = j
            continue
        exported = i and ts[i - 1].text in ("export", "default", "async")
        if depth == 0 and t.text == "function":
            k = i + 1 + (text_at(i + 1) == "*")
            statements += not exported
            type_only = False
            if k < n and ts[k].kind == "name":
                opening = next((m for m in range(k, n) if ts[m].text == "("), k)
                tags.append((ts[k].text, "function"))
                i = function(ts[k].text, closing(ts, opening) + 1, any(e["name"] == ts[k].text for e in exports))
                continue
        if depth == 0 and t.text in ("const", "let", "var") and i + 1 < n and ts[i + 1].kind == "name" and ts[i + 1].text != "enum":
            statements += not exported
            type_only = False
            label = ts[i + 1].text
            value = _initializer(ts, i + 2)
            tags.append((label, "function" if value >= 0 and _is_function(ts, value) else "variable"))
            j = i + 2
            while j < n and ts[j].text not in ("=", ";", "{"):
                j = closing(ts, j) + 1 if ts[j].text in "([" else j + 1
            if text_at(j) == "=":
                k = j + 1 + (text_at(j + 1) == "async")
                if text_at(k) == "function" or text_at(k) == "(" and "=>" in [text_at(m) for m in range(closing(ts, k) + 1, min(n, closing(ts, k) + 12))] or text_at(k + 1) == "=>":
                    start = closing(ts, next(m for m in range(k, n) if ts[m].text == "(")) + 1 if text_at(k + 1) != "=>" else k + 1
                    while text_at(start) not in ("=>", "{", ""):
                        start += 1
                    i = function(label, start + (text_at(start) == "=>"), any(e["name"] == label for e in exports))
                    continue
        if depth == 0 and t.text == "class" and i + 1 < n and ts[i + 1].kind == "name":
            statements += not exported
            type_only = False
            owner, a = ts[i + 1].text, next((m for m in range(i, n) if ts[m].text == "{"), n - 1)
            tags.append((owner, "class"))
            b, j = closing(ts, a), a + 1
            while j < b:
                if ts[j].kind == "name" and text_at(j + 1) == "(" and text_at(j - 1) not in (".", "new"):
                    end = closing(ts, j + 1)
                    k = end + 1
                    while k < b and ts[k].text not in ("{", ";", "}"):
                        k += 1
                    if text_at(k) == "{":
                        accessor = text_at(j - 1) + " " if text_at(j - 1) in ("get", "set") else ""
                        j = function(f"{owner}.{accessor}{ts[j].text}", end + 1, True)
                        continue
                j = closing(ts, j) + 1 if ts[j].text in "{([" else j + 1
            i = b + 1
            continue
        if depth == 0 and t.text in ("interface", "type", "enum") and i + 1 < n and ts[i + 1].kind == "name" and not exported:
            statements += 1
            type_only &= t.text != "enum"
        if depth == 0 and t.kind == "name" and t.text in ("if", "for", "while", "return", "await", "new"):
            type_only = False
        depth += t.text in "([{" and t.kind == "op"
        depth -= t.text in ")]}" and t.kind == "op"
        i += 1
    for k in range(n - 2):
        if ts[k].text in ("import", "require") and ts[k + 1].text == "(" and ts[k + 2].kind == "string" and (not k or ts[k - 1].text not in (".", "?.")):
            imports.append({"specifier": _unquote(ts[k + 2]), "type": "dynamic" if ts[k].text == "import" else "require", "symbols": None, "at": k})
    imports.sort(key=lambda x: x["at"])
    has_ui = bool(re.search(r"return\s*\(?\s*<[A-Za-z>]", text)) and "=>" in text or bool(re.search(r"return\s*\(\s*<[A-Z]", text))
    ext = extension(path)
    if config.is_test(name):
        category = "test"
    elif config.is_config(name):
        category = "config"
    elif config.imports_test_library(x["specifier"] for x in imports):
        category = "test"
    elif ext in (".tsx", ".jsx") or has_ui:
        category = "ui"
    elif type_only and statements:
        category = "type-only"
    elif statements and export_statements / statements > config.barrel_threshold:
        category = "barrel"
    else:
        category = "logic"
    marks = at_tags(text) + [m for t in ts if t.kind == "string" for m in re.findall(r"(?<![\w.])@([a-zA-Z][\w-]*)", t.text)]
    marks += [m for group in re.findall(r"\btags?\s*:\s*(\[[^\]]*\]|['\"][^'\"]*['\"])", text) for m in re.findall(r"['\"]@?([^'\"]+)['\"]", group)]
    tags = list(dict.fromkeys([*tags, *((m, "comment-marker") for m in marks)]))
    calls = [] if category == "test" else [dict(x) for x in dict.fromkeys(tuple(c.items()) for c in calls if c["specifier"])]
    head = re.match(r"\s*/\*\*(.*?)\*/", text, re.S)
    description = re.sub(r"^\s*\*\s?", "", head.group(1), flags=re.M).strip() if head else None
    return {"imports": imports, "exports": exports, "tags": tags, "category": category, "functions": functions, "calls": calls, "description": description, "complexity": cyclomatic(ts), "cognitive": cognitive(ts)}


def parse_go(path: str, text: str, config: ClassifyConfig) -> dict:
    ts, comments = tokens(text)
    imports, exports, functions, calls, known = [], [], [], [], {}
    depth, i, n = 0, 0, len(ts)
    while i < n:
        t = ts[i]
        if depth == 0 and t.text == "import":
            end = closing(ts, i + 1) if i + 1 < n and ts[i + 1].text == "(" else i + 1 + (i + 1 < n and ts[i + 1].kind != "string")
            for j in range(i + 1, min(end + 1, n)):
                if ts[j].kind == "string":
                    spec = _unquote(ts[j])
                    alias = ts[j - 1].text if j > i + 1 and (ts[j - 1].kind == "name" or ts[j - 1].text in "._") and ts[j - 1].line == ts[j].line and ts[j - 1].text != "import" else None
                    imports.append({"specifier": spec, "type": "side-effect" if alias == "_" else "static", "symbols": [alias] if alias and alias != "_" else ["*"], "bare": True})
                    known[alias or spec.rsplit("/", 1)[-1]] = spec
            i = end + 1
            continue
        if depth == 0 and t.text == "func":
            j, owner = i + 1, ""
            if j < n and ts[j].text == "(":
                end = closing(ts, j)
                owner = next((x.text for x in reversed(ts[j:end]) if x.kind == "name"), "") + "."
                j = end + 1
            if j < n and ts[j].kind == "name":
                name = ts[j].text
                a = next((m for m in range(j, n) if ts[m].text == "{" and ts[m - 1].text not in ("interface", "struct")), n - 1)
                b = closing(ts, a)
                functions.append({"name": owner + name, "line": t.line, "complexity": cyclomatic(ts[a : b + 1]), "cognitive": cognitive(ts[a : b + 1])})
                if name[:1].isupper() and not owner:
                    exports.append({"name": name, "signature": text[ts[j + 1][3] : ts[closing(ts, j + 1)][3] + 1] if j + 1 < n else None})
                if owner or name[:1].isupper():
                    for m in range(a, b - 2):
                        if ts[m].text in known and ts[m + 1].text == "." and ts[m + 2].kind == "name" and m + 3 < n and ts[m + 3].text == "(" and ts[m - 1].text != ".":
                            calls.append({"from_fn": owner + name, "to_fn": ts[m + 2].text, "specifier": known[ts[m].text]})
                i = b + 1
                continue
        if depth == 0 and t.text in ("type", "var", "const") and i + 1 < n:
            end = closing(ts, i + 1) if ts[i + 1].text == "(" else i + 1
            level = 0
            for j in range(i + 1, end + 1):
                level += ts[j].text in "([{"
                level -= ts[j].text in ")]}"
                first = ts[j].kind == "name" and (j == i + 1 or level == 1 and ts[j].line != ts[j - 1].line)
                if first and ts[j].text[:1].isupper():
                    exports.append({"name": ts[j].text, "signature": f"{t.text} {ts[j].text}"})
            if end > i + 1:
                i = end + 1
                continue
        depth += t.text in "([{" and t.kind == "op"
        depth -= t.text in ")]}" and t.kind == "op"
        i += 1
    tags = at_tags("\n".join(comments))
    for c in comments:
        if m := re.match(r"//\s*(?:go:build|\+build)\s+(.*)", c):
            tags += re.findall(r"[A-Za-z_]\w*", m.group(1))
    name = path.rsplit("/", 1)[-1].lower()
    test = name.endswith("_test.go") or config.is_test(name) or "test" in tags or any(x["specifier"] == "testing" for x in imports)
    calls = [dict(x) for x in dict.fromkeys(tuple(c.items()) for c in calls)]
    return {"imports": imports, "exports": exports, "tags": [(x, "comment-marker") for x in dict.fromkeys(tags)], "category": "test" if test else "logic", "functions": functions, "calls": calls, "description": None, "complexity": cyclomatic(ts), "cognitive": cognitive(ts)}
