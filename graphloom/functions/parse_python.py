"""Python files by the standard library's own syntax tree."""

from __future__ import annotations

import ast
import io
import tokenize

from graphloom.functions.classify import ClassifyConfig, at_tags

TEST_LIBRARIES = {"pytest", "unittest"}


def _comments(text: str) -> str:
    found = []
    try:
        for token in tokenize.generate_tokens(io.StringIO(text).readline):
            if token.type == tokenize.COMMENT:
                found.append(token.string)
    except (tokenize.TokenError, SyntaxError, IndentationError):
        found = [line[line.index("#") :] for line in text.splitlines() if "#" in line]
    return "\n".join(found)


def _imports(tree: ast.Module) -> list[dict]:
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(node.lineno, node.col_offset, i, {"specifier": a.name, "type": "static", "symbols": ["*"], "bare": True}) for i, a in enumerate(node.names)]
        elif isinstance(node, ast.ImportFrom):
            names, module = [a.name for a in node.names], node.module or ""
            prefix = "./" if node.level == 1 else "../" * (node.level - 1)
            if not node.level:
                edges = [(module, names, True)]
            elif module:
                edges = [(prefix + module.replace(".", "/"), names, False)]
            elif names[0] == "*":
                edges = [(prefix[:-1], ["*"], False)]
            else:
                edges = [(prefix + n, [n], False) for n in names]
            out += [(node.lineno, node.col_offset, i, {"specifier": s, "type": "static", "symbols": n, "bare": b}) for i, (s, n, b) in enumerate(edges)]
    return [x for *_, x in sorted(out, key=lambda e: e[:3])]


def cyclomatic(node: ast.AST) -> int:
    """1, and one more for each branch, loop, handler, ternary and boolean operator; comprehension conditions don't count."""
    total = 1
    for n in ast.walk(node):
        if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler)):
            total += 1
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
    return total


def cognitive(node: ast.AST) -> int:
    """Branches weighed by nesting; else and elif add one, runs of one boolean operator add one."""

    def many(nodes, depth: int) -> int:
        return sum(one(n, depth) for n in nodes)

    def one(n: ast.AST, depth: int) -> int:
        if isinstance(n, ast.If):
            total, test, chain = 1 + depth, n, 0
            while True:
                total += one(test.test, depth + (chain == 0)) + many(test.body, depth + (chain == 0))
                rest = test.orelse
                if len(rest) == 1 and isinstance(rest[0], ast.If) and rest[0].col_offset == n.col_offset:
                    total, test, chain = total + 1, rest[0], chain + 1
                    continue
                return total + (1 + many(rest, depth + 1) if rest else 0)
        if isinstance(n, (ast.For, ast.AsyncFor, ast.While, ast.IfExp)):
            return 1 + depth + many(ast.iter_child_nodes(n), depth + 1)
        if isinstance(n, ast.ExceptHandler):
            return 1 + depth + many(n.body, depth)
        if isinstance(n, ast.BoolOp):
            return 1 + many(n.values, depth)
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)) and n is not node:
            return 1 + depth + many(ast.iter_child_nodes(n), depth + 1)
        return many(ast.iter_child_nodes(n), depth)

    return many(ast.iter_child_nodes(node), 0)


def parse(path: str, text: str, config: ClassifyConfig) -> dict:
    tree = ast.parse(text)
    name = path.rsplit("/", 1)[-1].lower()
    exports, functions, calls = [], [], []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            names = [node.name]
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            names = [t.id for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name)]
        else:
            continue
        doc = ast.get_docstring(node) if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
        signature = f"class {node.name}" if isinstance(node, ast.ClassDef) else f"({ast.unparse(node.args)})" if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else None
        exports += [{"name": n, "doc": doc, "signature": signature} for n in names if not n.startswith("_")]
    for owner, node in [("", n) for n in tree.body] + [(c.name + ".", n) for c in tree.body if isinstance(c, ast.ClassDef) for n in c.body]:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            functions.append({"name": owner + node.name, "line": node.lineno, "complexity": cyclomatic(node), "cognitive": cognitive(node)})
    imports = _imports(tree)
    known = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            prefix = "" if not node.level else "./" if node.level == 1 else "../" * (node.level - 1)
            module = (node.module or "") if not node.level else prefix + (node.module or "").replace(".", "/")
            for a in node.names:
                known[a.asname or a.name] = (a.name, module if node.module else prefix + a.name)
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for c in ast.walk(node):
                if isinstance(c, ast.Call) and isinstance(c.func, ast.Name) and c.func.id in known:
                    calls.append({"from_fn": node.name, "to_fn": known[c.func.id][0], "specifier": known[c.func.id][1]})
    tags = at_tags(_comments(text))
    if name.startswith("test_") or name.endswith("_test.py") or config.is_test(name):
        category = "test"
    elif name in ("conftest.py", "setup.py"):
        category = "config"
    else:
        category = "test" if "test" in tags or any(i["specifier"] in TEST_LIBRARIES for i in imports) else "logic"
    return {"imports": imports, "exports": exports, "tags": [(t, "comment-marker") for t in tags], "category": category, "functions": functions, "calls": calls, "description": ast.get_docstring(tree), "complexity": cyclomatic(tree), "cognitive": cognitive(tree)}
