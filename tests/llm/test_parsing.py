import ast

import pytest

from lithoscope.llm.parsing import LANGUAGES, failure_rates, language, parse_files

GOOD = {
    "python": ["", "# only\n", "x = [i for i in y if i]\n", "async def f(a, /, b: int = 1, *c, d=2, **e) -> int:\n    return await g(*a, **b)\n", "match x:\n    case {'a': [1, *_]} if y:\n        pass\n    case A(b=1) | None:\n        pass\n",
               "class A(B, metaclass=C):\n    x: int\n    @p.q\n    def f(self): return lambda x, *y: x\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "x = f'{a!r:>{w}}' 'b' \\\n  'c'\n", "with (a as b, c):\n\tdel x, y\n", "if (n := 3) > 2: print(x[1:2, ::3], sep='')\nelif y: pass\n"],
    "javascript": ["let a = 1\nlet b = a\n", "export default class A extends B { #x = 1; static async *f({a, b: [c]} = {}, ...d) { yield* 1 } get x() { return this.#x } }", "const f = async (a, {b}) => { for await (const x of y) z?.[1]?.(...w) }", "x = a / b / c; y = /[/]re/g.test(s); z = `a${`b${c}`}d`",
                   "import a, { b as c } from './x'; export * as d from 'y'\nif (a) b\nelse c\nfor (;;) break\ndo x++; while (y) z: while (1) continue z", "switch (x) { case 1: default: y() }\ntry { } catch { } finally { }", "label: { }", "a = b ? c : d => ({ e })", "// c\n/* d */"],
    "typescript": ["interface A<T extends B = C> extends D<T> { readonly a?: string; [k: string]: number; f<U>(x: U): void; new (y: T): A }", "type X = { [K in keyof T]?: T[K] } & (A | B)[]; type F = (a: string, ...b: number[]) => asserts a is string",
                   "abstract class A<T> implements B { private constructor(public readonly x: number, y?: string) { super() } abstract f(): void; declare z: T }", "const x = <T,>(a: T): T => a as unknown as T; let y = z!.w satisfies Q", "enum E { A = 1, B } declare module 'm' { export function f(): void } namespace N.M { }", "function f(this: Window, a?: number): a is string\nfunction f(a) { return g<string>(a) }", "import type { A } from './a'; export type { B } from './b'"],
    "rust": ["fn main() { let x: Vec<Vec<u8>> = vec![1; 2]; if let Some(y) = x.get(0) { println!(\"{}\", y) } }", "impl<'a, T: Clone + 'a> A<T> for B<'a, T> where T: Fn(u8) -> u8 { type X = u8; const Y: usize = 1 << 3; fn f(&mut self, _: &'a str) -> Result<(), Box<dyn E>> { self.x?.await; Ok(()) } }",
             "#[derive(Debug)] pub struct A { pub(crate) a: [u8; 4], b: fn(u8) -> u8 } enum E { A(u8), B { c: u8 } = 3 }", "fn f() { match x { 1 | 2..=5 if y => { } A { b, .. } => 3, _ => return } ; let c = |a: u8, &b| a + b; for i in 0..n { break 'l } }", "/* a /* b */ c */ fn g() -> impl Iterator<Item = u8> { loop {} }", "use a::{self, b::*, c as d};\nmacro_rules! m { ($x:expr) => { $x } }", "fn f() { let s = r#\"a\"b\"#; let c = '\\''; if x == y { z } else { w }; S { a: 1, ..d } }"],
    "go": ["package a\nimport (\n\tb \"c\"\n)\nfunc (r *R[T]) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok {\n\t\treturn 1, nil\n\t} else if x {\n\t}\n\tfor i := range 10 {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tswitch y := z.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\treturn\n}\n",
           "package a\ntype S[T any] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\ntype I interface {\n\tF(int) error\n\t~int | string\n}\nvar x = map[string][]int{\"a\": {1, 2}}\nvar f = func() { go g(); defer h(); ch <- 1 }\n", "package a\nconst (\n\tA = iota\n\tB\n)\nfunc f() { select { case x := <-c: y(x...); default: }; L: for { continue L } }\n"],
    "java": ["package a.b; import static c.D.*; public sealed interface A<T extends B & C> permits D { int x = 1; default <U> U f(List<? super T> a, int... b) throws E { return null; } }", "record P(int x, String y) { P { if (x < 0) throw new X(); } }", "@A(b = {1, 2}, c = @D) enum E implements F { X(1) { void g() {} }, Y; E(int... i) {} }",
             "class A { int[][] x = new int[3][]; static { for (var y : z) { } } Runnable r = () -> { try (var q = w()) { } catch (E | F e) { } finally { } }; int s = switch (t) { case 1, 2 -> 3; default -> { yield 4; } }; Object o = (A & B) x::y; boolean b = p instanceof Q(int u, var v) && (int) w > 3; }"],
    "csharp": ["using System; namespace A.B; public partial class C<T> : D, E where T : class, new() { public int X { get; private set; } = 3; public event F G; [H(1, J = 2)] async Task<int?> K(ref int a, params string[] b) => await L(out var m, n: 3); }",
               "class A { void F() { var q = from x in y where x.z > 1 orderby x descending select new { x.w, v = 2 }; foreach (var (a, b) in c) { } string s = $\"a{b:N2}{(c ? \"d\" : \"e\")}\" + @\"x\"\"y\"; lock (o) { yield return 1; } switch (z) { case int i when i > 0: break; default: return; } } }", "record P(int X, int Y); delegate void D<in T>(T t); enum E : byte { A = 1, B }", "var x = y switch { > 3 and < 5 => 1, { Z: null } => 2, _ => throw new E() };"],
    "bash": ["#!/bin/sh\nif [ \"$a\" -gt 1 ]; then echo b; elif c; then d; else e; fi\n", "f() { local x=\"$1\"; y=$(g \"$x\" | h 2>&1); }\nfor i in a b; do echo $i; done\nwhile read -r l; do :; done < f\n", "case \"$x\" in a|b) c ;; *) d ;; esac\n", "[[ $a =~ ^x(y|z)$ && ! -f b ]] || (( c++ ))\narr=(1 2 3)\ncat <<EOF\nif (\nEOF\n", "echo for if done\n"],
}
BAD = {
    "python": ["print 'x'\n", "def f(:\n  pass\n", "if x\n    y\n", "x = (1,\n", "<<<<<<< HEAD\nx = 1\n", "class A:\n", "s = 'a\n", "  x = 1\ny\n z\n"],
    "javascript": ["let a: string = 'x'", "function f( {", "{ \"a\": 1, \"b\": 2 }", "if (a { b }", "x = 'abc", "<<<<<<< HEAD", "const f = ) => 1", "import { a } frm 'b'", "}"],
    "typescript": ["interface A { a: ; }", "let x: = 3", "type X = ;", "class { x( }", "package main"],
    "rust": ["fn f( {", "let x = 3;", "fn f() { let = 3; }", "fn f() { a b }", "struct A { x u8 }", "/* open", "package a"],
    "go": ["func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nvar = 3\n", "package a\nfunc f() {\n\tif x\n\t{\n\t}\n}\n", "package a\nx := \"abc\n"],
    "java": ["class A { int x }", "class A { void f() { if x { } } }", "class A { ", "def f(): pass", "class A { int f() { return 1 } }"],
    "csharp": ["class A { int X { get; set } }", "class A { void F() { int x = ; } }", "class A {", "using ;", "class A { void F() { foo(1; } }"],
    "bash": ["if true; then echo a\n", "for i in a; do echo\n", "echo \"abc\n", "fi\n", "f() { echo (a) }\n", "case x in a) b ;;\n", "a && && b\n"],
}


@pytest.mark.parametrize("name,source", [(n, s) for n, ss in GOOD.items() for s in ss])
def test_whole(name, source):
    assert language(name).error_at(source) is None
    assert language(name).error_at(source.replace("\n", "\r\n")) is None
    if name == "python":
        ast.parse(source)


@pytest.mark.parametrize("name,source", [(n, s) for n, ss in BAD.items() for s in ss])
def test_broken(name, source):
    at = language(name).error_at(source)
    assert at is not None
    assert 1 <= language(name).error_line(source, at) <= source.count("\n") + 1


INSIDE_BAD = {
    "python": ['f"{a +}"', "f'{for}'", 'x = f"{}"', 'x = f"a } b"', 'f"{a!}"', 'f"{x:{y +}}"', 'f"""{\na b}"""', "1 = x", "if a:\n" + " " * 4001 + "x = 1\n" + " " * 4002 + "y = 1\n"],
    "javascript": ["let x = `${a +}`;", "`${a b}`;", "`${}`;", "`${`${a +}`}`"],
    "typescript": ["const y: string = `${a +}`;"],
    "bash": ["x=$(if true; then echo a)", "((x = 1 +))", 'echo "$(for i in; do)"', "x=`if`", 'echo "a $(echo "$(if)")"'],
    "csharp": ['class A { string s = $"{a +}"; }', 'class A { string s = $@"{a b}"; }'],
}
INSIDE_GOOD = {
    "python": ['f"{a}"', "f'{a!r:>{w}} {{x}} {b=}'", 'f"{x != y}"', 'f"{(lambda x: 1)(2)}"', 'f"{a if b else c:>10}"', 'rf"\\d{n}"', 'f"\\N{BULLET} {a}"', 'f"{x:=^20}"', 'f"""{\n a\n}"""', "a[0] = 1",
               'f"{ {1:2}[1] }"', "f'{x,}'", 'f"{a[b:c]}"', 'f"{x:{a}.{b}}"', "if a:\n" + " " * 4001 + "x = 1\n" + " " * 4001 + "y = 1\n"],
    "javascript": ['let x = `a ${b} ${c ? `x${d}` : "}"}`;', "`\\${a`;", "`${f({a:1})}`;", "`${a, b}`;", "`${x => ({y: x})}`;"],
    "typescript": ["const y = `${a as string}`;"],
    "bash": ["x=$(if true; then echo a; fi)", "((x = 1 + y[2], z++))", "for ((i=0; i<10; i++)); do echo $i; done", "echo $((1 + ${x:-3} * $y ** 2 - 16#ff))", "x=`echo \\`date\\``", "echo '$(if'",
             "echo \"it's $(date)\"", "x=$(( (a+b) ? c : d ))", "y=$( (cd a; ls) )", "((!in && new))", 'echo "${a:-$(b "c")}"', "x=$(# note\n ls)", "[[ $(( $# % 2 )) -eq 0 ]] && ls", "echo $(<file)"],
    "csharp": ['class A { string s = $"{a} {b,10:F2} {{x}} {c:yyyy-MM}"; }', 'class A { string s = $"{(a ? b : c)} {d["k"]}"; }', 'class A { string s = $@"{a}""x"; }'],
}


@pytest.mark.parametrize("name,source", [(n, s) for n, ss in INSIDE_BAD.items() for s in ss])
def test_broken_inside_tokens(name, source):
    assert language(name).error_at(source) is not None


@pytest.mark.parametrize("name,source", [(n, s) for n, ss in INSIDE_GOOD.items() for s in ss])
def test_whole_inside_tokens(name, source):
    assert language(name).error_at(source) is None
    if name == "python":
        ast.parse(source)


def test_memo_has_no_say():
    """The same text gives the same outcome before and after others."""
    p = language("javascript")
    broken = "function f() { if (a) { b(; } }"
    first = p.error_at(broken)
    for s in GOOD["javascript"]:
        assert p.error_at(s) is None
    assert p.error_at(broken) == first == 12


def test_operator(spark):
    rows = [(1, 7, "a/b.py", "x = (", "q"), (2, 7, "b.PY", "x = 1\n", "q"), (3, 7, "c.py", None, "q"), (4, 7, "d.py", "  \n", "q"), (5, 7, "e.txt", "(", "q"), (6, 7, None, "(", "q"), (7, None, "f.go", "func\n", "q"), (1, 7, "a/b.py", "x = (", "q")]
    df = spark.createDataFrame(rows, "file_id bigint, repo_id bigint, path string, source string, language string")
    got = sorted((r.file_id, r.language, r.failed, r.error_line) for r in parse_files(df).where("failed").collect())
    assert got == [(1, "python", True, 1), (1, "python", True, 1), (7, "go", True, 1)]
    rates = {(r.repo_id, r.language): (r.files, r.failures) for r in failure_rates(df, "repo_id").collect()}
    assert rates == {(7, "python"): (5, 2), (None, "go"): (1, 1)}
    assert parse_files(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a.py", "x = 1\n" * 50_000 + "y = (\n")], "file_id bigint, path string, source string")
    assert parse_files(long).first().error_line >= 50_000
    assert set(LANGUAGES.values()) == set(GOOD)
