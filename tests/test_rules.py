import re

import pytest

from lodestone.operators import rules
from lodestone.operators.lexer import scan
from lodestone.operators.spans import selectors

CASES = {
    "a.ts": ("export class Boat {\n  sail(speed: number): void {\n    if (speed) {\n    }\n  }\n}\nexport const row = (n) => n;\ninterface Oar {}\ntype Wind = string;\nenum Sea { A }\n", ["Boat", "sail", "row", "Oar", "Wind", "Sea"]),
    "b.js": ("const text = `\nclass Hidden {\n`;\n// class Gone\nexports.go = function () {};\nasync function* walk() {}\n", ["go", "walk"]),
    "c.py": ("class Pond:\n    def fill(self):\n        pass\nasync def drain(): pass\n# def no()\n", ["Pond", "fill", "drain"]),
    "d.go": ("func (p *Pond) Fill(n int) {\n}\ntype Pond struct {\n}\n", ["Fill", "Pond"]),
    "e.rs": ("pub struct Reed;\npub trait Grow {}\npub async fn bloom() {}\n", ["Reed", "Grow", "bloom"]),
    "f.java": ("public class Mill {\n    private List<String> grind(int n) throws X {\n        return null;\n    }\n    public static Map<String, List<A>> sift(String s) {\n    }\n}\nrecord Grain(int n) {}\n", ["Mill", "sift", "Grain"]),
    "g.kt": ("fun <T> spin(x: T) {}\ncompanion object Wheel\n", ["spin", "Wheel"]),
    "h.swift": ("protocol Turning {\n}\nprivate func rotate() {}\n", ["Turning", "rotate"]),
    "i.rb": ("module Quay\n  def self.load!\n  end\n  attr_reader :depth\nend\n", ["Quay", "load", "depth"]),
    "j.c": ("#define MAX(a, b) ((a) > (b))\nstatic int *find(char *s) {\n}\ntypedef struct {\n} Box;\n", ["MAX", "find", "Box"]),
    "k.cpp": ("namespace deck {\nvoid Ship::launch(int n) const {\n}\n}\n", ["deck", "launch"]),
    "l.m": ("@interface Lamp : NSObject\n- (void)light:(int)n;\n", ["Lamp", "light"]),
    "m.test.ts": ("describe('the boat', () => {\n  it(\"floats\", () => {});\n});\n", ["the boat", "floats"]),
    "n.cls": ("trigger Ring on Bell__c (before insert) {\n}\n", ["Ring"]),
    "o.css": (".mast, #hull > .mast {\n  color: red;\n}\n@media (max-width: 3px) {\n}\n", [".mast", "#hull", "@media (max-width: 3px)"]),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(p, t) for p, (t, _) in CASES.items()], "path string, text string")
    out = {}
    for r in rules.symbols(rules.parsed(df)).orderBy("path", "ord").collect():
        out.setdefault(r["path"], []).append(r)
    return out


@pytest.mark.parametrize("path", sorted(CASES))
def test_symbols(found, path):
    assert [r["name"] for r in found.get(path, [])] == CASES[path][1]


def test_columns_point_at_the_name(found):
    for path, rows in found.items():
        lines = CASES[path][0].split("\n")
        for r in rows:
            if r["kind"] != "at-rule":
                assert lines[r["line"] - 1][r["col"] - 1 :].startswith(r["name"])


def test_imports(spark):
    text = "import a from './a.js';\nconst b = require('b');\nexport { c } from \"./c\";\n// import z from 'z'\n"
    py = "from os.path import join\nimport sys\n"
    df = spark.createDataFrame([("x.ts", text), ("y.py", py), ("z.rs", "use std::io;\n")], "path string, text string")
    rows = rules.imports(rules.parsed(df)).orderBy("path", "line").collect()
    assert [(r["line"], r["module"]) for r in rows] == [(1, "./a.js"), (2, "b"), (3, "./c"), (1, "os.path"), (2, "sys"), (1, "std::io")]


def test_outline(spark):
    df = spark.createDataFrame([("x.rs", "impl Reed {\n}\nstruct Reed\n")], "path string, text string")
    assert [r["kind"] for r in rules.outline(rules.parsed(df)).orderBy("line").collect()] == ["impl", "struct"]


def test_needed_words_hold_for_every_rule(found):
    """Every rule's match holds one of its words, so the automaton leaves no rule out that would have matched."""
    words = [w for text, _ in CASES.values() for line in text.split("\n") for w in (line, line.strip())]
    for rule in (*rules.SYMBOL_RULES, *rules.OUTLINE_RULES, *rules.IMPORT_RULES):
        assert rule.needs
        for line in words:
            if re.search(rule.pattern, line, re.ASCII):
                assert any(n in line for n in rule.needs), (rule, line)


def test_first_of_all_rules_equals_the_chosen_ones():
    every = [(re.compile(r.pattern.replace(".*", r"[^\r\x85\u2028\u2029]*"), re.ASCII), r) for r in rules.SYMBOL_RULES]
    words = rules._matcher("symbol", "import")
    for text, _ in CASES.values():
        for _, line, code, depth in scan(text):
            tries = words.words(line)
            assert rules.first_match(every, line, code, depth) == (rules.first_match(tries[0], line, code, depth) if tries else None)


def test_truncated(spark):
    df = spark.createDataFrame([("a.ts", "class A {}\n" * 2001), ("b.ts", "class A {}\n" * 2000), ("c.ts", None)], "path string, text string")
    assert {r["path"]: (len(r["symbols"]), r["truncated"]) for r in rules.parsed(df).collect()} == {"a.ts": (2000, True), "b.ts": (2000, False), "c.ts": (0, False)}


def test_style_names_equal_the_columns(spark):
    lines = [".a, #b > .c .d .e {", "  @media  (x: 1px)   and y {", "@font-face{", "p {", "{", "x", ".a.b{.c"]
    df = spark.createDataFrame([("o.css", k, line) for k, line in enumerate(lines)], "path string, line_no int, line string")
    found = [(r["line_no"], r["name"], r["kind"]) for r in selectors(df).orderBy("line_no", "ord").collect()]
    assert found == [(k, *x) for k, line in enumerate(lines) for x in rules.style_names(line)]
