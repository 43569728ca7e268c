from graphloom.functions.classify import DEFAULT, file_type
from graphloom.functions.parse import parse_file
from graphloom.functions.tagging import STRATEGIES, strategy_of, tagged, writable
from graphloom.functions.tokens import rule_blocks, tokenize

PY = '''"""Module doc."""
import os.path as p, sys
from . import utils
from .models.user import User as U
from ..core import *
# @tag auth
LIMIT = 3
_hidden = 1

def run(x):
    """Runs."""
    if x and x > 1:
        for i in x:
            U(i)
    elif x:
        pass
    else:
        return 1 if x else 2

class A:
    def m(self):
        try:
            pass
        except ValueError:
            pass
'''


def edges(found):
    return [(i["specifier"], i["type"], i["symbols"]) for i in found["imports"]]


def test_python():
    f = parse_file("src/a.py", PY)
    assert edges(f) == [("os.path", "static", ["*"]), ("sys", "static", ["*"]), ("./utils", "static", ["utils"]), ("./models/user", "static", ["User"]), ("../core", "static", ["*"])]
    assert [e["name"] for e in f["exports"]] == ["LIMIT", "run", "A"] and f["description"] == "Module doc."
    assert f["category"] == "logic" and f["tags"] == [{"name": "auth", "kind": "comment-marker"}]
    assert f["calls"] == [{"from_fn": "run", "to_fn": "User", "specifier": "./models/user"}]
    run, method = f["functions"]
    # 1 + if + elif + and + for + ternary; cognitive: if 1, and 1, for 2, elif 1, else 1, ternary 2
    assert (run["name"], run["complexity"], run["cognitive"]) == ("run", 6, 8)
    assert (method["name"], method["complexity"], method["cognitive"]) == ("A.m", 2, 1)
    assert parse_file("test_x.py", "")["category"] == "test" and parse_file("conftest.py", "")["category"] == "config"
    broken = parse_file("b.py", "def (")
    assert broken["category"] == "other" and broken["parse_error"].startswith("SyntaxError")


TS = '''import React, { useState as us, type T } from "react";
import * as ns from './ns';
import "./side.css";
export { a, b as c } from "./ab";
export * from "./all";
const lazy = () => import("./lazy");
const old = require("./old");
/**
 * Adds.
 * @deprecated
 */
export function add(x: number, y: number): number {
  if (x && y) { return us(x); } else if (y) { return 2; }
  return x ? 1 : 2;
}
export class Cart {
  constructor(private n: number) { this.n = n; }
  get total() { for (const i of []) { add(i, 1); } return 1; }
}
export interface Shape { a?: string }
export const arrow = async (z) => { while (z) { z--; } };
// @tag billing
'''


def test_variables_that_hold_functions_are_tagged_as_functions():
    functions = ["(a) => 1", "a => 1", "async () => 1", "async a => 1", "async => 1", "(a): { b: C } => 1", "<T, U extends V<T>>(a: T) => a", "function (a) { return 1 }", "async function* g(a) { return 1 }", "function (a) {}"]
    variables = ["1", "g(a => 1)", "(a || b).map(c => 1)", "(a) ? (b) : c => 1", "(function () {})()", "function () {}()", "function () {}.bind(a)", "<T>(a)", "{ f: () => 1 }", "[() => 1]", "new F(() => 1)", "await g(() => 1)"]
    for found, kind in ((functions, "function"), (variables, "variable")):
        for value in found:
            for head, end in (("const x =", ";"), ("export const x =", ";"), ("let x =", "\nx;")):
                tags = parse_file("src/a.ts", f"{head} {value}{end}")["tags"]
                assert tags[0] == {"name": "x", "kind": kind}, (head, value)
    for text, kind in (("let x;\ny = () => 1", "variable"), ("let x\ny = () => 1", "variable"), ("const x: (a: A) => B = (a) => 1;", "function"), ("const x: { a: A } = (a) => 1;", "function"), ("const x: M<A, () => B> = new M();", "variable"), ("let x!: A, y = () => 1;", "variable"), ("const x", "variable"), ("const x =", "variable"), ("const x = <", "variable")):
        assert parse_file("src/a.ts", text)["tags"][0] == {"name": "x", "kind": kind}, text


def test_script():
    f = parse_file("src/cart.ts", TS)
    assert edges(f) == [("react", "static", ["default", "us", "T"]), ("./ns", "static", ["*"]), ("./side.css", "side-effect", None), ("./ab", "re-export", ["a", "c"]), ("./all", "re-export", ["*"]), ("./lazy", "dynamic", None), ("./old", "require", None)]
    assert [e["name"] for e in f["exports"]] == ["a", "c", "add", "Cart", "Shape", "arrow"]
    add = next(e for e in f["exports"] if e["name"] == "add")
    assert add["doc"] == "Adds." and add["flags"] == ["deprecated"] and add["signature"] == "(x: number, y: number)"
    assert {x["name"]: x["complexity"] for x in f["functions"]} | {} == {"lazy": 1, "add": 5, "Cart.constructor": 1, "Cart.get total": 2, "arrow": 2}
    assert f["calls"] == [{"from_fn": "add", "to_fn": "useState", "specifier": "react"}]
    assert f["category"] == "logic" and {"name": "billing", "kind": "comment-marker"} in f["tags"]


def test_script_categories():
    c = lambda path, text: parse_file(path, text)["category"]
    assert c("a.test.ts", "") == "test" and c("vite.config.ts", "") == "config" and c("x.tsx", "export const a = 1;") == "ui"
    assert c("t.ts", "export interface A {}\nexport type B = string;") == "type-only"
    assert c("index.ts", 'export * from "./a";\nexport { b } from "./b";') == "barrel"
    assert c("e.ts", 'import { it } from "vitest";') == "test" and c("u.ts", "function f() {}") == "logic"
    more = DEFAULT.adding(test_patterns=[".steps."])
    assert parse_file("a.steps.ts", "", more)["category"] == "test" and c("a.steps.ts", "") == "logic"


def test_go():
    f = parse_file("cmd/main.go", 'package main\n\n// @tag cli\n//go:build linux\nimport (\n\t"fmt"\n\tstr "strings"\n)\n\ntype Server struct{}\n\nfunc Run(a int) {\n\tif a > 1 && a < 3 {\n\t\tfmt.Println(str.ToUpper("x"))\n\t}\n}\n\nfunc (s *Server) Stop() { for {} }\nfunc hidden() {}\n')
    assert edges(f) == [("fmt", "static", ["*"]), ("strings", "static", ["str"])]
    assert [e["name"] for e in f["exports"]] == ["Server", "Run"]
    assert {x["name"]: (x["complexity"], x["cognitive"]) for x in f["functions"]} == {"Run": (3, 2), "Server.Stop": (2, 1), "hidden": (1, 0)}
    assert {(c["from_fn"], c["to_fn"], c["specifier"]) for c in f["calls"]} == {("Run", "Println", "fmt"), ("Run", "ToUpper", "strings")}
    assert [t["name"] for t in f["tags"]] == ["cli", "linux"] and parse_file("a_test.go", "package a")["category"] == "test"


def test_styles_and_text():
    f = parse_file("a.css", '@import "base.css";\n/* @import "no.css"; */\n.a { background: url(img/x.png); color: red }\n.b { background: url("data:abc") }')
    assert edges(f) == [("base.css", "static", None), ("img/x.png", "static", None)] and f["category"] == "ui"
    assert parse_file("b.css", '@import url("x.css");')["category"] == "barrel"
    assert edges(parse_file("a.less", '@import (reference) "r";\n@w: 1px;')) == [("r", "side-effect", None)]
    f = parse_file("a.scss", '@use "colors" as c;\n@forward "mix";\n$size: 1px;\n@mixin _private {}\n@function double($x) {}')
    assert edges(f) == [("colors", "static", ["c"]), ("mix", "re-export", None)] and [e["name"] for e in f["exports"]] == ["size", "double"]
    assert edges(parse_file("a.styl", "@import 'a'\n@require \"b\"")) == [("a", "static", None), ("b", "static", None)]
    f = parse_file("README.md", "# Title\nSee [x](./src/a.ts#L1), [y](https://z), `lib/b.py` and\n```\nsrc/c.go\n```\n[x](./src/a.ts)")
    assert [e[0] for e in edges(f)] == ["./src/a.ts", "lib/b.py", "src/c.go"] and f["description"] == "Title"
    f = parse_file("x.feature", "@smoke @auth\nFeature: Log in\n  @slow\n  Scenario: a\n")
    assert [t["name"] for t in f["tags"]] == ["smoke", "auth", "slow"] and f["category"] == "test"
    f = parse_file("m.lua", 'local x = require("a.b")\n-- require("no")\nlocal M = {}\nfunction M.go() end\nM.k = 1\nreturn M')
    assert edges(f) == [("a.b", "require", None)] and [e["name"] for e in f["exports"]] == ["go", "k"]
    f = parse_file("m.coffee", "import { a, b as c } from './x'\nfs = require 'fs'\n# require 'no'\nexports.run = -> 1")
    assert edges(f) == [("./x", "static", ["a", "c"]), ("fs", "require", None)] and [e["name"] for e in f["exports"]] == ["run"]
    assert [file_type(p) for p in ("a.JSX", "b.sass", "c.java", ".hidden", "d")] == ["javascript", "scss", "unknown", "unknown", "unknown"]


def test_tokens_and_blocks():
    assert tokenize("const a = 'x'; // b\nif (a >= 10) {}", "typescript") == [("const", 1), ("ID", 1), ("=", 1), ("STR", 1), (";", 1), ("if", 2), ("(", 2), ("ID", 2), (">=", 2), ("NUM", 2), (")", 2), ("{", 2), ("}", 2)]
    assert tokenize("x = 1 # y\n", "python", False) == [("ID", 1), ("=", 1), ("1", 1)]
    found = rule_blocks(".a {\n  Color:  red;\n  margin: 0  1px;\n}\n@media x {\n.b { color: red; margin: 0 1px }\n}")
    assert [(b["start_line"], b["end_line"], b["signature"]) for b in found] == [(1, 3, "color:red;margin:0 1px"), (6, 6, "color:red;margin:0 1px")]


def test_tag_writers_are_idempotent():
    sources = {
        "gherkin": "Feature: x\n", "pytest": "import os\n\ndef test_a():\n    pass\n", "go": "package a\n", "vitest": "import { it } from 'vitest'\ndescribe('a', () => {})\n",
        "jest": "test('a', () => {})\n", "playwright": "import { test } from '@playwright/test'\ntest('a', async () => {})\n", "cypress": "describe('a', () => {})\n",
    }
    for name, source in sources.items():
        once = STRATEGIES[name](source, ["auth", "cart"])
        assert once != source and "auth" in once and STRATEGIES[name](once, ["auth", "cart"]) == once, name
        other = STRATEGIES[name](once, ["billing"])
        assert "billing" in other and "auth" not in other, name
        assert "billing" not in STRATEGIES[name](other, []), name
    assert writable(["x", "utils", "ok-tag", "9a", "ok-tag"]) == ["ok-tag"]
    assert [strategy_of(p, s) for p, s in (("a.feature", ""), ("t.py", ""), ("a_test.go", ""), ("a.cy.ts", ""), ("a.ts", "from '@playwright/test'"), ("a.ts", ""), ("a.rb", ""))] == ["gherkin", "pytest", "go", "cypress", "playwright", "vitest", None]
    assert tagged("e2e/a.ts", "test('a', () => {})", ["auth"], {"e2e/**": "playwright"}) == ("playwright", "test('a', { tag: ['@auth'] }, () => {})")
