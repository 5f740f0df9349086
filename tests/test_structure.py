"""Structure of sources in five languages: nesting, ranges, bindings, declarations over several lines, strings with braces, refusals."""

import hashlib

import pytest

from weft.operators import structure as S


def outline(language, path, source):
    return S.PARSERS[language](path, source, "c" * 40)


def parts(out, *kinds):
    return [(a["kind"], a["qualified_name"], a["source_ref"]["start_line"], a["source_ref"]["end_line"]) for a in out.artifacts if a["kind"] in kinds]


def told(out, *kinds):
    names = {a["artifact_id"]: a["qualified_name"] for a in out.artifacts}
    return [(r["kind"], names[r["from_id"]], names.get(r["to_ref"], r["to_ref"]), r["evidence"]["start_line"]) for r in out.relations if r["kind"] in kinds]


CODE = ("CLASS", "INTERFACE", "METHOD", "FUNCTION", "MODULE")


def test_python():
    source = "from auth.tokens import Token\n\nclass Service(Base):\n    async def login(self, user: str) -> Token:\n        token = issue(user)\n        return token\n"
    out = outline("python", "src/service.py", source)
    assert parts(out, *CODE) == [("CLASS", "src/service.Service", 3, 6), ("METHOD", "src/service.Service.login", 4, 6)]
    assert told(out, "EXTENDS", "CALLS", "IMPORTS") == [("EXTENDS", "src/service.Service", "symbol:Base", 3), ("IMPORTS", "src/service.py", "module:auth.tokens", 1), ("CALLS", "src/service.Service.login", "symbol:issue", 5)]
    assert told(out, "CONTAINS") == [("CONTAINS", "src/service.py", "src/service.Service", 3), ("CONTAINS", "src/service.Service", "src/service.Service.login", 4)]
    assert out.artifacts[2]["attributes"] == {"async": "true"} and out.artifacts[2]["signature"] == "login(self, user: str) -> Token"
    text = "\n".join(source.split("\n")[2:6])
    assert out.artifacts[1]["content_hash"] == "sha256:" + hashlib.sha256(text.encode() + b"\0").hexdigest()


def test_python_over_several_lines():
    source = 'import os, sys as s\nclass A(\n    Base,\n    Other,\n):\n    def one(\n        self, x=f(1),\n    ) -> int:\n        """def broken(\n        go()"""\n        return self.two(x) + self.none() + g("h(1)")  # k(2)\n\n    def two(self): return 1\n\ndef three(a):\n    def four():\n        five(a)\n        five(a); six(five(a))\n    return four()\n'
    out = outline("python", "m.py", source)
    assert parts(out, *CODE) == [("CLASS", "m.A", 2, 13), ("METHOD", "m.A.one", 6, 11), ("METHOD", "m.A.two", 13, 13), ("FUNCTION", "m.three", 15, 19), ("FUNCTION", "m.three.four", 16, 18)]
    assert told(out, "EXTENDS") == [("EXTENDS", "m.A", "symbol:Base", 2), ("EXTENDS", "m.A", "symbol:Other", 2)]
    assert told(out, "IMPORTS") == [("IMPORTS", "m.py", "module:os", 1), ("IMPORTS", "m.py", "module:sys", 1)]
    assert told(out, "CALLS") == [("CALLS", "m.A.one", "m.A.two", 11), ("CALLS", "m.A.one", "symbol:self.none", 11), ("CALLS", "m.A.one", "symbol:g", 11), ("CALLS", "m.three.four", "symbol:five", 17), ("CALLS", "m.three.four", "symbol:five", 18), ("CALLS", "m.three.four", "symbol:six", 18), ("CALLS", "m.three", "symbol:four", 19)]


@pytest.mark.parametrize("source", ["def broken(\n    a,\n", "class A(B)\n    pass\n", "def f\n", "async def g(x)\n"])
def test_python_refusals(source):
    with pytest.raises(S.Malformed):
        outline("python", "m.py", source)


@pytest.mark.parametrize(
    "language, path, source",
    [
        ("typescript", "src/service.ts", "import { Token } from './token';\nexport class Service extends Base implements Login {\n  async login(user: string): Promise<Token> {\n    return issue(user);\n  }\n}\n"),
        ("java", "src/Service.java", "import app.Token;\npublic class Service extends Base implements Login {\n  public Token login(String user) {\n    return issue(user);\n  }\n}\n"),
    ],
)
def test_classes_with_braces(language, path, source):
    out = outline(language, path, source)
    assert parts(out, *CODE) == [("CLASS", f"{path}.Service", 2, 6), ("METHOD", f"{path}.Service.login", 3, 5)]
    assert told(out, "CALLS", "EXTENDS", "IMPLEMENTS") == [("EXTENDS", f"{path}.Service", "symbol:Base", 2), ("IMPLEMENTS", f"{path}.Service", "symbol:Login", 2), ("CALLS", f"{path}.Service.login", "symbol:issue", 4)]
    assert told(out, "IMPORTS") == [("IMPORTS", path, "module:" + ("./token" if language == "typescript" else "app.Token"), 1)]


def test_typescript():
    source = """const fs = require('fs');
/* class No { */
export interface Shape<T extends Base> extends A<T>, B {
  area(x: number): number;
}
export const f = async (x: number) => {
  const s = `}{ ${g(1)}`; // } h(2)
  return load(x, "}");
};
export const short = (a, b) => add(a, b);
export class Box<T> extends Frame<T, U> implements Shape<T>, Other {
  private items: T[] = [];
  constructor(private a: string) { super(); init(a); }
  put(
    item: T,
    at = here(),
  ): void {
    if (item) { this.store.add(item); }
    for (const x of xs) { use(x); }
  }
  get size(): number { return 1; }
}
async function plain(
  a: string,
): Promise<void> {
  await plain(a);
}
"""
    out = outline("typescript", "b.ts", source)
    want = [("INTERFACE", "b.ts.Shape", 3, 5), ("METHOD", "b.ts.Shape.area", 4, 4), ("FUNCTION", "b.ts.f", 6, 9), ("FUNCTION", "b.ts.short", 10, 10), ("CLASS", "b.ts.Box", 11, 22), ("METHOD", "b.ts.Box.constructor", 13, 13), ("METHOD", "b.ts.Box.put", 14, 20), ("METHOD", "b.ts.Box.size", 21, 21), ("FUNCTION", "b.ts.plain", 23, 27)]
    assert parts(out, *CODE) == want
    assert told(out, "EXTENDS", "IMPLEMENTS") == [("EXTENDS", "b.ts.Shape", "symbol:A", 3), ("EXTENDS", "b.ts.Shape", "symbol:B", 3), ("EXTENDS", "b.ts.Box", "symbol:Frame", 11), ("IMPLEMENTS", "b.ts.Box", "symbol:Shape", 11), ("IMPLEMENTS", "b.ts.Box", "symbol:Other", 11)]
    assert told(out, "CALLS") == [("CALLS", "b.ts.f", "symbol:load", 8), ("CALLS", "b.ts.short", "symbol:add", 10), ("CALLS", "b.ts.Box.constructor", "symbol:init", 13), ("CALLS", "b.ts.Box.put", "symbol:store.add", 18), ("CALLS", "b.ts.Box.put", "symbol:use", 19), ("CALLS", "b.ts.plain", "symbol:plain", 26)]
    assert told(out, "IMPORTS") == [("IMPORTS", "b.ts", "module:fs", 1)]


def test_java():
    source = """package app;
import static app.Util.*;
import java.util.List;
public abstract class Outer<T extends Comparable<T>> extends Base<T> implements Runnable {
  private final String s = "class Fake { void no() {";
  Outer(int a) { this.a = a; start(); }
  public <R> List<R> map(
      Function<T, R> f,
      int n) throws IOException, Other {
    return run(f).collect(to());
  }
  abstract void none();
  static class Inner { int one() { return two(); } }
}
interface Small { void go(String x); }
"""
    out = outline("java", "O.java", source)
    assert parts(out, *CODE) == [("CLASS", "O.java.Outer", 4, 14), ("METHOD", "O.java.Outer.Outer", 6, 6), ("METHOD", "O.java.Outer.map", 7, 11), ("METHOD", "O.java.Outer.none", 12, 12), ("CLASS", "O.java.Outer.Inner", 13, 13), ("METHOD", "O.java.Outer.Inner.one", 13, 13), ("INTERFACE", "O.java.Small", 15, 15), ("METHOD", "O.java.Small.go", 15, 15)]
    assert told(out, "EXTENDS", "IMPLEMENTS") == [("EXTENDS", "O.java.Outer", "symbol:Base", 4), ("IMPLEMENTS", "O.java.Outer", "symbol:Runnable", 4)]
    assert told(out, "IMPORTS") == [("IMPORTS", "O.java", "module:app.Util.*", 2), ("IMPORTS", "O.java", "module:java.util.List", 3)]
    assert ("METHOD", "O.java.Outer.map", 7, 11) in parts(out, *CODE) and ("METHOD", "O.java.Outer.none", 12, 12) in parts(out, *CODE)
    assert ("CALLS", "O.java.Outer.Outer", "symbol:start", 6) in told(out, "CALLS") and ("CALLS", "O.java.Outer.map", "symbol:run", 10) in told(out, "CALLS")


def test_rust():
    source = """use std::{fmt, io};
pub mod inner;
/// fn no() {
pub struct Point<'a> {
    name: &'a str,
}
pub enum Kind { A, B('}') }
pub trait Shape { fn area(&self) -> f64; }
impl<'a, T: Into<f64>> Shape for Point<'a> where T: Copy {
    fn area(&self) -> f64 {
        let s = "}{"; let c = '{';
        helper(self.name, other::deep(1)) + self.area()
    }
}
pub(crate) async fn helper(
    a: &str,
) -> f64 { area_of(a); helper(a) }
"""
    out = outline("rust", "src/p.rs", source)
    assert parts(out, *CODE) == [("MODULE", "src/p::inner", 2, 2), ("CLASS", "src/p::Point", 4, 6), ("CLASS", "src/p::Kind", 7, 7), ("INTERFACE", "src/p::Shape", 8, 8), ("METHOD", "src/p::Point::area", 10, 13), ("FUNCTION", "src/p::helper", 15, 17)]
    assert told(out, "CALLS") == [("CALLS", "src/p::Point::area", "src/p::helper", 12), ("CALLS", "src/p::Point::area", "symbol:deep", 12), ("CALLS", "src/p::Point::area", "symbol:self.area", 12), ("CALLS", "src/p::helper", "symbol:area_of", 17)]
    assert told(out, "IMPORTS") == [("IMPORTS", "src/p.rs", "module:std::{fmt, io}", 1)]
    for bad in ("fn a() { ", "fn a() } {", "fn b() { ( }"):
        with pytest.raises(S.Malformed):
            outline("rust", "x.rs", bad)


def test_go():
    source = """// package no
package store

import "fmt"
import (
\tlog "app/log" // "no/such"
\t`raw/path`
)

type T struct {
\tname string // }
}

type (
\tI interface {
\t\tDo(x int) error
\t}
\tAlias = map[string]int
\tG[K comparable] struct{ k K }
)

func (t *T) Do(
\tx int,
) error {
\ttype local struct{ a int }
\tif x > 0 {
\t\tfmt.Println("}{", `{`, '{')
\t}
\treturn helper(t.name, func() int { return other() }(), []byte("a"))
}

func helper(a string, b int, c []byte) error { return New().Do(len(a)) }

func (g *G[K]) Get() K { return g.k }

func twice() {}
func New() *T { return &T{} }
"""
    out = outline("go", "store/t.go", source)
    want = [("MODULE", "store", 1, 1), ("CLASS", "store.T", 10, 12), ("INTERFACE", "store.I", 15, 17), ("CLASS", "store.Alias", 18, 18), ("CLASS", "store.G", 19, 19), ("METHOD", "store.T.Do", 22, 30), ("FUNCTION", "store.helper", 32, 32), ("METHOD", "store.G.Get", 34, 34), ("FUNCTION", "store.twice", 36, 36), ("FUNCTION", "store.New", 37, 37)]
    assert parts(out, *CODE) == want
    assert told(out, "IMPORTS") == [("IMPORTS", "store", f"module:{x}", n) for x, n in (("fmt", 4), ("app/log", 6), ("raw/path", 7))]
    assert told(out, "CALLS") == [("CALLS", "store.T.Do", "symbol:fmt.Println", 27), ("CALLS", "store.T.Do", "store.helper", 29), ("CALLS", "store.T.Do", "symbol:other", 29), ("CALLS", "store.helper", "store.New", 32), ("CALLS", "store.helper", "store.T.Do", 32), ("CALLS", "store.helper", "symbol:len", 32)]
    assert {r["confidence"] for r in out.relations if r["kind"] == "CALLS"} == {0.8}
    for bad in ("func a() {}", "package a\nfunc f() {", "package a\nfunc () {}"):
        with pytest.raises(S.Malformed):
            outline("go", "x.go", bad)


def test_tables_refusals_and_a_callers_parser(spark):
    files = spark.createDataFrame([("a.py", "def f(): g()\n", "python", "c1"), ("b.py", "def f(\n", "python", "c1"), ("c.zz", "x", "none", "c1"), ("d.go", None, "go", "c1"), ("e.rs", "fn a() { b(); b(); }\nfn b() {}", "rust", "c1")], "path string, content string, parser string, commit_sha string")
    found = S.parsed(files)
    assert {r.path: r.error for r in found.select("path", "error").collect()} == {"a.py": None, "b.py": "line 1: the declaration has no end", "d.go": "no package clause", "e.rs": None}
    ids = {r.artifact_id: r.qualified_name for r in S.artifacts(found).collect()}
    assert sorted((r.kind, ids[r.from_id], ids.get(r.to_ref, r.to_ref), r.confidence) for r in S.relations(found).collect() if r.kind == "CALLS") == [("CALLS", "a.f", "symbol:g", 0.65), ("CALLS", "e::a", "e::b", 0.7)]

    def own(path, source, commit):
        out = S.Outline(path, source, "none", commit)
        out.add("DOCUMENT", "whole", path + "#whole", "", 1, 1, out.root)
        return out

    again = S.artifacts(S.parsed(files, {"none": own, "python": own})).where("kind = 'DOCUMENT'")
    assert sorted(r.qualified_name for r in again.collect()) == ["a.py#whole", "b.py#whole", "c.zz#whole"]
    assert S.artifacts(S.parsed(files.where("false"))).count() == 0
