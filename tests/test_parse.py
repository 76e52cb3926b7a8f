from codelake.parse import extract_item, scan_text
from codelake.parse import clean as C

PY = "import os\nfrom typing import Any\n\n\n@cache\ndef top(a, b=1):\n    return Any\n\n\nclass Box(Base):\n    def __init__(self):\n        def inner():\n            pass\n\n    async def get(self):\n        return Path(self)\n"
JS = "import React from 'react';\n\nexport async function load(a) {\n  return `{${a}`;\n}\n\nexport class Api {\n  get() { return '}'; }\n}\n\nconst Card = ({ x }) => {\n  return <div>{x}</div>;\n};\n"
HTML = "<html><head>\n<style>a { b: c }</style>\n<script src='x.js'></script>\n<script>\nclass App {\n  run() {}\n}\n\nfunction go() { return 1; }\n</script>\n<script type='application/json'>{}</script>\n</head></html>\n"
SQL = "\nCREATE TABLE IF NOT EXISTS app.users (\n  id INT\n);\n\nCREATE OR REPLACE FUNCTION f() RETURNS trigger AS $$\nBEGIN\n  RETURN new;\nEND;\n$$ LANGUAGE plpgsql;\n\nCREATE UNIQUE INDEX ix ON users(id);\n"


def names(path, text):
    return [(i.name, i.block_type, i.line, i.end, i.parent) for i in scan_text(path, text)]


def test_python():
    assert names("a.py", PY) == [("top", "function", 6, 7, None), ("Box", "class", 10, 16, None), ("Box", "table", 10, None, None), ("__init__", "method", 11, 13, "Box"), ("get", "method", 15, 16, "Box")]
    got = extract_item(PY, scan_text("a.py", PY)[0])
    assert got["source_code"].startswith("@cache\ndef top") and got["imports"] == ["import os", "from typing import Any"] and got["type_references"] == ["Any"]
    assert extract_item(PY, scan_text("a.py", PY)[4])["type_references"] == []
    assert names("a.py", "def f(:") == []


def test_script():
    assert names("a.js", JS) == [("load", "function", 3, None, None), ("Api", "class", 7, None, None), ("Card", "component", 11, None, None)]
    assert extract_item(JS, scan_text("a.js", JS)[1])["source_code"].endswith("get() { return '}'; }\n}")
    assert names("a.tsx", "const f = (a) => a;\n") == [("f", "function", 1, None, None)]


def test_html():
    got = names("a.html", HTML)
    assert ("style_block_2", "style_block", 2, 2, None) in got and ("script_block_4", "script_block", 4, 10, None) in got
    assert ("App", "class", 5, None, "script_block_4") in got and ("go", "function", 9, None, "script_block_4") in got
    assert ("script_block_11", "script_block", 11, 11, None) in got


def test_sql():
    assert names("a.sql", SQL) == [("users", "table", 1, None, None), ("f", "sql_function", 5, None, None), ("ix", "index", 11, None, None)]
    items = scan_text("a.sql", SQL)
    assert extract_item(SQL, items[1])["source_code"].endswith("plpgsql;")
    assert {i.block_type for i in scan_text("supabase/migrations/001_x.sql", SQL)} == {"migration"}
    assert names("m.prisma", "model User {\n}\n") == [("User", "table", 1, None, None)]


def test_declared():
    rust = "use a::B;\n\npub struct S {\n    x: i64,\n}\n\nimpl S {\n    pub fn new() -> Self {\n        S { x: 1 }\n    }\n}\n\npub trait T {\n    fn m(&self);\n}\n"
    assert names("a.rs", rust) == [("S", "struct", 3, 5, None), ("new", "function", 8, 10, None), ("T", "trait", 13, 15, None)]
    java = "package a;\n\npublic class K {\n    K() { }\n    public int f(int a) {\n        return g(a);\n    }\n}\n\ninterface I {\n    void h();\n}\n"
    assert names("A.java", java) == [("K", "class", 3, 8, None), ("f", "method", 5, 7, "K"), ("I", "interface", 10, 12, None), ("h", "method", 11, 11, None)]
    ruby = "module M\n  class C\n    def go(a)\n      a\n    end\n  end\nend\n"
    assert names("a.rb", ruby) == [("M", "module", 1, 7, None), ("C", "class", 2, 6, None), ("go", "function", 3, 5, None)]
    go = 'package a\n\ntype S struct {\n\tx int\n}\n\nfunc (s *S) M() int {\n\treturn 1\n}\n\nfunc F() {\n}\n'
    assert names("a.go", go) == [("S", "struct", 3, 5, None), ("M", "method", 7, 9, None), ("F", "function", 11, 12, None)]


def test_empty_and_unknown():
    assert scan_text("a.py", None) == [] and scan_text("a.txt", "x") == [] and scan_text("noending", "x") == []


def test_clean():
    code, kept, warnings = C.clean("#!/bin/x\n# Copyright 2020 me\n\nimport a\nb()\n", ["from x import b", "from y import c", "from .z import b"])
    assert code.startswith("import a") and kept == ["from x import b", "# TODO: Resolve relative import — from .z import b"]
    assert warnings == [C.STRIPPED, "Removed 1 unused import(s)", "Relative import converted to TODO: from .z import b"]
    assert C.strip_metadata("x\n  // eslint-disable-next-line y\nz\n")[0] == "x\n-next-line y\nz\n" and C.strip_metadata("x = 1\n\n# type: ignore\ny\n")[0] == "x = 1\ny\n"
    assert C.strip_metadata("/* All Rights Reserved */\n\ngo()\n") == ("go()\n", [C.STRIPPED]) and C.strip_metadata("# plain\ngo()\n") == ("# plain\ngo()\n", [])
    assert C.strip_metadata("a\n# -*- coding: utf-8 -*-\nb") == ("a\nb", [C.STRIPPED]) and C.strip_metadata("") == ("", [])
    assert C.imported_names("from ..z import (a,") == ["a"] and C.imported_names("const { p, q } = require('z');") == ["p", "q"] and C.imported_names("import a.b.C;") == ["C"] and C.imported_names("import * as z from 'q'") == []
    assert C.is_relative("const x = require('./y')") and C.is_relative("import '../y.dart';") and not C.is_relative("import 'dart:io';") and not C.is_relative("import x from 'y/./z'")
    assert C.imported_names("import { a, b as c } from 'x';") == ["a", "c"] and C.imported_names("import 'package:x/y.dart';") == []
    assert C.formatted("select 1  \n\n\n\nfrom t\n", "sql") == "SELECT 1\n\nFROM t"
    assert C.validated("def f():\n  return 1", "python")[0] and not C.validated("def f(", "python")[0]
    assert C.validated("a { '}' }", "javascript") == (True, None) and C.validated("a {", "go") == (False, "Unbalanced braces (depth=1)")
    assert C.validated("select (1", "sql") == (False, "Unbalanced parentheses (depth=1)")
    assert C.file_content("x", "h", "python") == "# h\n\nx\n"
