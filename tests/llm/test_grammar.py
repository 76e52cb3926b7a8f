"""The grammars on short texts that compilers of the languages refuse or take."""

import pytest

pytest.importorskip("codelake.llm.queries")
from codelake.llm import grammar  # noqa: E402

INVALID = {
    'javascript': [
        'const x = ;',
        'let = 3 +;',
        'foo(1 2);',
        'if (a { }',
        'function f( { }',
        'x = [1 2;]',
        'class A { foo( }',
        'return }',
        'var 3a = 1;',
        'a b',
        'for (;;;) {}',
        'else { }',
        'if (x) y else z',
        'try { }',
        'const {a b} = c;',
        "import from 'x';",
        'x => => y',
        '{ a: 1, b: 2',
        'switch (x) { foo(); }',
        'a ? b;',
        'new;',
        'export x y;',
        '{"a": 1, "b": 2}',
    ],
    'typescript': [
        'const x: = 3;',
        'let y: number = ;',
        'interface A { x: ; }',
        'type X = ;',
        'function f(a: number b: string) {}',
        'class A extends { }',
        'enum A { x y }',
        'const x = ;',
        'foo(1 2);',
    ],
    'java': [
        'class A { void f() { int x = ; } }',
        'class A { void f() { foo(1 2); } }',
        'class A { void f() { return 0 } }',
        'class A { void f() { if (a { } } }',
        'class A { void f() { for (int i = 0; i < n) { } } }',
        'class A { void f() { x = a ? b; } }',
        'class A { void f() { int[] a = {1 2}; } }',
        'class A { void f() { else { } } }',
        'class A { void f() { try { } } }',
        'class A { void f() { switch (x) { foo(); } } }',
        'class A { void f() { String s = "a" "b"; } }',
        'class A { void f() { new; } }',
        'class A { void f() { catch (E e) {} } }',
        'class { }',
        'class A extends { }',
        'import ;',
        'class A { int; }',
        'class A { void f( { } }',
        'package a',
        'enum E { A B }',
        'class A { void f() { } } }',
        'def f(): pass',
        'class A { int x = 1 }',
        'public void f() {}x y',
    ],
    'csharp': [
        'class A { void F() { int x = ; } }',
        'class A { void F() { Foo(1 2); } }',
        'class A { void F() { return 0 } }',
        'class A { void F() { if (a { } } }',
        'class A { void F() { foreach (var x y) { } } }',
        'class A { void F() { x = a ? b; } }',
        'class A { void F() { else { } } }',
        'class A { void F() { try { } } }',
        'class A { void F() { var q = ; } }',
        'class A { void F() { new; } }',
        'class A { void F() { for (int i = 0; i < n) { } } }',
        'class { }',
        'class A : { }',
        'using ;',
        'class A { int; }',
        'namespace { }',
        'class A { void F( { } }',
        'enum E { A B }',
        'class A { int X { get set } }',
    ],
    'dart': [
        'void f() { int x = ; }',
        'void f() { foo(1 2); }',
        'void f() { return 0 }',
        'void f() { if (a { } }',
        'void f() { for (var x y) { } }',
        'void f() { x = a ? b; }',
        'void f() { else { } }',
        'void f() { try { } }',
        'void f() { var q = ; }',
        'void f() { var a = [1 2]; }',
        'class { }',
        'class A extends { }',
        'import ;',
        'class A { int; }',
        'void f( { }',
        'enum E { A B }',
        'class A { void f() }}',
        'int x = ',
    ],
    'cpp': [
        'void f() { int x = ; }',
        'void f() { foo(1 2); }',
        'void f() { return 0 }',
        'void f() { if (a { } }',
        'void f() { for (int i = 0; i < n) { } }',
        'void f() { x = a ? b; }',
        'void f() { else { } }',
        'void f() { try { } }',
        'void f() { auto q = ; }',
        'void f() { int a[] = {1 2}; }',
        'class { ',
        'class A : { };',
        'using ;',
        'class A { int; int x }',
        'void f( { }',
        'enum E { A B };',
        'class A { }',
        'int main() { return 0 }',
        'struct S { int x }',
        'def f(): pass',
        'namespace { ',
    ],
    'rust': [
        'fn f() { let = 3; }',
        'fn f() { let x = ; }',
        'fn f() { foo(1 2); }',
        'fn f() { if { } }',
        'fn f() { for x y { } }',
        'fn f() { else { } }',
        'fn f() { match x { 1 => } }',
        'fn f() { let q = 1 }',
        'fn f() { x y; }',
        'fn f() { let v = [1 2]; }',
        'fn f( { }',
        'struct A { x }',
        'impl { }',
        'enum E { A B }',
        'use a::;',
        'fn f() -> { }',
        'struct S { x: i32 y: i32 }',
        'def f(): pass',
    ],
    'go': [
        'package a\nfunc f() {\nx := \n}\n',
        'package a\nfunc f() {\nfoo(1 2)\n}\n',
        'package a\nfunc f() {\nif { }\n}\n',
        'package a\nfunc f() {\nfor i := 0; i < n {\n}\n',
        'package a\nfunc f() {\nelse { }\n}\n',
        'package a\nfunc f() {\nvar x int = \n}\n',
        'package a\nfunc f() {\nx y\n}\n',
        'package a\nfunc f() {\nreturn 1 2\n}\n',
        'package a\nfunc f() {\na := []int{1 2}\n}\n',
        'package a\nfunc f() {\nswitch x { foo() }\n}\n',
        'package',
        'func f() {}',
        'package a\nfunc f( {}',
        'package a\nimport',
        'package a\ntype T struct { x }}',
        'package a\nx := 1',
        'package a\nfunc f() int { return 1 ',
    ],
    'kotlin': [
        'fun f() {\nval x = \n}\n',
        'fun f() {\nfoo(1 2)\n}\n',
        'fun f() {\nif { }\n}\n',
        'fun f() {\nfor (x y) { }\n}\n',
        'fun f() {\nval = 3\n}\n',
        'fun f() {\nwhen (x) { 1 -> }\n}\n',
        'fun f() {\nvar a = [1 2]\n}\n',
        'fun f() {\nval x 3\n}\n',
        'fun f( {}',
        'class { }',
        'class A : { }',
        'fun f() = ',
        'import',
        'enum class E { A B }',
        'fun f() { return 1 } }',
        'def f(): pass',
    ],
    'swift': [
        'func f() {\nlet x = \n}\n',
        'func f() {\nfoo(1 2)\n}\n',
        'func f() {\nif { }\n}\n',
        'func f() {\nfor x y { }\n}\n',
        'func f() {\nlet = 3\n}\n',
        'func f() {\nswitch x { case 1 }\n}\n',
        'func f() {\nlet a = [1 2]\n}\n',
        'func f() {\nguard x { }\n}\n',
        'func f( {}',
        'class { }',
        'struct A : { }',
        'import',
        'func f() -> { }',
        'func f() { return 1 } }',
        'def f(): pass',
    ],
    'ruby': [
        'foo(1 2)',
        'x = ',
        'def f\n  1',
        'if x\n  y',
        'end',
        'class\nend',
        'def f(\nend',
        '[1 2]',
        '{a: 1 b: 2}',
        'puts )',
        'x = [1, 2',
        'foo(1,, 2)',
        'case x\nend',
        '1 +',
        'def 3x\nend',
        'begin\n x\n}',
    ],
    'sql': [
        'SELECT a,, b FROM t',
        'SELECT FROM WHERE',
        'SELECT a FROM',
        'INSERT INTO t VALUES (1, 2',
        'INSERT INTO t (a b) VALUES (1)',
        'CREATE TABLE t (a int b int)',
        'CREATE TABLE (a int)',
        'UPDATE t SET',
        'UPDATE t a = 1',
        'DELETE t',
        'SELECT a FROM t WHERE',
        'SELECT a FROM t GROUP',
        'SELECT (a FROM t',
        'CREATE TABLE t (a int,)',
        'SELEC a FROM t',
        'SELECT a b c FROM t',
        'CREATE VIEW v AS',
        'SELECT * FROM a JOIN ON x',
        'def f(): pass',
        'SELECT CASE WHEN a THEN b FROM t',
        'INSERT t VALUES (1)',
        'SELECT a FROM t ORDER a',
    ],
}

VALID = {
    'javascript': [
        'a\nb',
        'let x = 1\nlet y = 2',
        'const f = async ({a, b = 2, ...c}) => { await g(a) }',
        'for (const [k, v] of Object.entries(o)) console.log(k)',
        'x = a ? b : c ? d : e',
        'x = a ? b ? 1 : 2 : 3',
        'class A extends B { static #x = 1; get y() { return this.#x } async *gen() { yield* z() } static { q() } }',
        'label: for (;;) { continue label }',
        'do x++; while (x < 5)\nfoo()',
        'do { x++ } while (x < 5)',
        "import a, {b as c} from 'x'\nexport default function () {}\nexport * as d from 'y'",
        'const s = `a ${b}` + tag`x`',
        'if (a) b(); else if (c) d(); else e()',
        'try { a() } catch { b() } finally { c() }',
        'switch (x) { case 1: case 2: y(); break; default: z() }',
        "(function () { 'use strict' })()",
        '!function(){}()',
        'const {a, ...r} = o, [p,,q=2] = l',
        'x?.y?.[0]?.(z) ?? w',
        'async function* f() { for await (const x of y) {} }',
        'new Foo',
        'var re = /a[/]b/g.test(x)',
        'if (a)\n  b()\nelse\n  c()',
        'a = b\n  .c()\n  .d()',
        'export { a as default, b }',
        'delete a[b], void 0',
        "const o = { get a() { return 1 }, 'b-c': 2, [d]: 3, e, f() {}, async *g() {} }",
    ],
    'typescript': [
        'const x: number = 1',
        'let f = <T,>(a: T): T => a',
        'function f<T extends object = {}>(this: Foo, a?: string, ...b: number[]): asserts a is string {}',
        'interface A<T> extends B<T>, C { readonly x?: string; [k: string]: any; m(a: number): void; new (x: string): A; (y: number): string }',
        'type X<T> = T extends (infer U)[] ? U : never',
        'type M = { readonly [K in keyof T]?: T[K] }',
        'class A<T> implements B, C { private readonly x: Map<string, number[]> = new Map<string, number[]>(); constructor(private a: string, public b?: number) { super() } abstract foo(): void; static bar = 1 }',
        "enum Color { Red = 'r', Green = 1 << 2 }",
        "declare module 'x' { export function f(a: string): void }",
        'const y = z as unknown as string[]',
        "export type { A } from './b'",
        'let a = b!.c!',
        'abstract class X { abstract y(): void }',
        "const t: [string, number?] = ['a']",
        "let u: 'a' | 'b' | undefined",
        'let g: (a: string, b: number) => Promise<void> = async (a, b) => {}',
        '@Component({a: 1})\nexport class Z { @Input() x: string; }',
        'for (let i = 0; i < n; i++) { if (i > 3 && a < b) {} }',
        'function over(a: string): void\nfunction over(a: any) {}',
        'const q = a < b ? c : d',
        'let v = x satisfies Y',
        "type F = typeof import('x')",
        'let w = obj?.a?.[0]!',
        'namespace N.M { export const x = 1 }',
        'type T1 = `a${string}`',
        'const e = (a as any).b(c)',
    ],
    'java': [
        'class A { void f() { int x = 1, y[] = {1,2}; } }',
        'class A { void f() { List<Map<String, int[]>> m = new ArrayList<>(); } }',
        'class A { void f() { for (var e : m.entrySet()) { } } }',
        'class A { void f() { Runnable r = () -> { foo(); }; } }',
        'class A { void f() { Function<A,B> g = A::new; } }',
        'class A { void f() { x = a > b ? c : d; } }',
        'class A { void f() { if (o instanceof Foo f && f.x > 3) { } else if (b) return; else { } } }',
        'class A { void f() { int y = switch (z) { case 1, 2 -> 3; default -> { yield 4; } }; } }',
        'class A { void f() { try (var a = b(); c) { } catch (E | F e) { } finally { } } }',
        'class A { void f() { label: while (true) { break label; } } }',
        'class A { void f() { do { x++; } while (x < 3); } }',
        'class A { void f() { new Thread() { public void run() { } }.start(); } }',
        'class A { void f() { int a = (int) b; } }',
        'class A { void f() { String s = (String) o.get(1); } }',
        "class A { void f() { char c = 'x'; } }",
        'class A { void f() { x >>= 2; y = x >>> 3 >> 1; } }',
        'class A { void f() { assert x > 0 : "m"; } }',
        'class A { void f() { synchronized (this) { } } }',
        'class A { void f() { int[][] q = new int[3][]; } }',
        'class A { void f() { Class<?> k = String[].class; } }',
        'class A { void f() { foo.<String>bar(); } }',
        'class A { void f() { a = b = c; } }',
        'class A { void f() { switch (x) { case A: case B: y(); break; default: } } }',
        'class A { void f() { var t = """\n a\n"""; } }',
        'class A { void f() { if (a < b) c(); if (d > e) f(); } }',
        'class A { void f() { final var z = x -> y -> z; } }',
        'package a.b;\nimport static c.D.*;\n@Ann(x = 1, y = {"a"})\npublic final class A<T extends B & C> extends D<T> implements E, F<G> { private static final int X = 1; A() { super(); } abstract <U> U f(U u) throws X; static { } int g(int... a); enum I { P, Q(1) { void z() {} }; int q; } record R(int a, String b) implements S { R { } } @interface N { int v() default 1; } }',
        'interface I { default void f() { } void g(); }',
        'sealed interface S permits A, B {}',
    ],
    'csharp': [
        'class A { void F() { int x = 1, y = 2; } }',
        'class A { void F() { var d = new Dictionary<string, List<int>>(); } }',
        'class A { void F() { foreach (var (k, v) in d) { } } }',
        'class A { void F() { int? z = a ? b : c; } }',
        'class A { void F() { x ??= y ?? z; } }',
        'class A { void F() { var s = o switch { 1 => "a", > 2 and < 5 => "b", Foo { X: 1 } f => "c", _ => "d" }; } }',
        'class A { void F() { if (o is Foo f && f.X > 3) { } else if (o is not null) return; else { } } }',
        'class A { void F() { using var t = Open(); } }',
        'class A { void F() { using (var u = Open()) { } } }',
        'class A { void F() { await foreach (var q in w) { } } }',
        'class A { void F() { Func<int, int> g = x => x + 1; } }',
        'class A { void F() { Action h = async () => { await Foo(); }; } }',
        'class A { void F() { var e = from a in b where a.X > 1 orderby a.Y descending select new { a.X, Y = 1 }; } }',
        'class A { void F() { F(out var r, ref s, name: 3); } }',
        'class A { void F() { lock (this) { } } }',
        'class A { void F() { try { } catch (E ex) when (ex.X) { } finally { } } }',
        'class A { void F() { switch (x) { case 1: break; case Foo f when f.X: goto case 1; default: return; } } }',
        'class A { void F() { var (i, j) = (1, 2); } }',
        'class A { void F() { do { x++; } while (x < 3); } }',
        'class A { void F() { int[] arr = { 1, 2 }; var v = arr[^1]; var w2 = arr[1..^2]; } }',
        'class A { void F() { string str = $"{x} y"; } }',
        'class A { void F() { int Local(int a) => a * 2; } }',
        'class A { void F() { var p = (string)o; var k = typeof(List<>); } }',
        'class A { void F() { throw new Exception(); } }',
        'class A { void F() { yield return 1; } }',
        'class A { void F() { a?.b?[0]!.c(); } }',
        'class A { void F() { var l = new List<int> { 1, 2, }; } }',
        'class A { void F() { Point pt = new(1, 2); } }',
        'class A { void F() { checked { x++; } } }',
        'class A { void F() { const int K = 3; } }',
        'class A { void F() { x = y as Foo; } }',
        'class A { void F() { var rec = r with { X = 1 }; } }',
        'class A { void F() { List<int> li = [1, 2, ..o]; } }',
        'using System;\nConsole.WriteLine("x");\nint F(int a) { return a; }',
        'namespace A.B;\npublic record P(int X, string Y = "a") : Q(X) { }',
        '[Attr(1, X = 2)]\npublic abstract class A<T> : B<T>, I where T : class, new() { private readonly int x = 1; public int X { get; private set; } = 3; public int Y => x; public A(int a) : base(a) { } ~A() { } public static A operator +(A a, A b) => a; public int this[int i] { get => i; set { } } public event EventHandler E; public async Task<int> F<U>(U u, params int[] z) where U : struct { return await G(); } delegate void D(int a); enum N : byte { A = 1, B, } static extern void Q(); void I.F() { } public static implicit operator int(A a) => 1; }',
        'namespace X { class Y { } }',
        'interface I { int F(); int P { get; } }',
    ],
    'dart': [
        'void f() { int x = 1, y = 2; }',
        "void f() { final m = <String, List<int>>{'a': [1]}; }",
        'void f() { for (final e in m.entries) { } }',
        'void f() { for (var i = 0; i < n; i++) { } }',
        'void f() { x ??= y ?? z; }',
        'void f() { var s = a ? b : c; }',
        "void f() { var w = Container(child: Text('a' 'b'), onTap: () => foo(), items: [if (a) b else c, ...d, for (var i in l) i]); }",
        'void f() { a..b()..c = 1; }',
        'void f() { await Future.wait([a, b]); }',
        'void f() { try { } on Foo catch (e, s) { } catch (e) { rethrow; } finally { } }',
        'void f() { switch (x) { case 1: break; default: y(); } }',
        'void f() { var f2 = (int a, {required String b}) async { return a; }; }',
        'void f() { late final String t; }',
        'void f() { if (o is! Foo) return; else if (o is Bar) { } }',
        'void f() { int g(int a) => a; }',
        'void f() { a!.b?.c[0]; }',
        'void f() { do { x++; } while (x < 3); }',
        "void f() { throw Exception('x'); }",
        "void f() { assert(x > 0, 'm'); }",
        'void f() { List<int>? l; }',
        'void f() { yield* z; }',
        'void f() { const p = Point(1, 2); }',
        'void f() { var (q, r) = (1, 2); }',
        'void f() { label: for (;;) { break label; } }',
        'void f() { x = y as Foo; }',
        "void f() { var st = switch (z) { 1 => 'a', _ => 'b' }; }",
        "import 'package:a/b.dart' as c show d;\nabstract class A<T extends B> extends C<T> with D implements E { final int x; static const y = 1; A(this.x, {super.key, this.z = 3}) : y = 1, super(x); A.named(); factory A.of(int a) => A(a); int get g => x; set s(int v) { } @override Widget build(BuildContext c) { return x; } bool operator ==(Object o) => true; external int q(); void Function(int)? cb; Future<void> h() async { } }",
        'mixin M on A { }',
        'extension X on String { int get l => 1; }',
        'enum E { a, b; int f() => 1; }',
        'typedef F = void Function(int a);',
        'const int k = 1; var z = 2; String? n;',
        'sealed class S {} class T2 = A with B;',
    ],
    'cpp': [
        'void f() { int x = 1, *y = &x, z[3] = {1,2}; }',
        'void f() { std::vector<std::pair<int, std::string>> v{}; }',
        'void f() { for (const auto& [k, w] : m) { } }',
        'void f() { for (int i = 0; i < n; ++i) { } }',
        'void f() { auto l = [&, x](int a) mutable -> int { return a; }; }',
        'void f() { if (auto it = m.find(k); it != m.end()) { } else if (b) return; else { } }',
        'void f() { std::cout << "a" << x << std::endl; }',
        'void f() { delete[] p; auto q = new int[3]; }',
        'void f() { try { } catch (const std::exception& e) { } catch (...) { } }',
        'void f() { switch (x) { case 1: y(); break; case 2: { } default: ; } }',
        'void f() { do { x++; } while (x < 3); }',
        'void f() { auto u = std::make_unique<Foo>(1); }',
        'void f() { int y = static_cast<int>(z); }',
        'void f() { x = a > b ? c : d; }',
        'void f() { std::lock_guard<std::mutex> g(m); }',
        'void f() { constexpr int k = 3; }',
        'void f() { return {1, 2}; }',
        'void f() { unsigned long long n = 3ULL; }',
        'void f() { int (*fp)(int) = nullptr; }',
        'void f() { a->b.c()[0]++; }',
        'void f() { using T = int; typedef int U; }',
        'void f() { if constexpr (X<int>) { } }',
        'void f() { throw std::runtime_error("x"); }',
        'void f() { goto end; end: ; }',
        "void f() { int z = (int)y; char c = 'x'; }",
        'void f() { co_return; }',
        'void f() { Foo f{1}, g(2); }',
        'void f() { static const std::string s = "a" "b"; }',
        'void f() { x = y >> 2; }',
        'void f() { while (i < n && j > m) { } }',
        '#include <a>\n#define X 1\nnamespace a::b { class A final : public B<int>, private C { public: A() : x(1), y{2} { } explicit A(int a) = delete; virtual ~A() = default; virtual int f() const override; template <typename T, int N = 3> T g(T&& t) noexcept { return t; } static int s; bool operator==(const A& o) const = default; A& operator=(A&&); int operator()(int a) { return a; } operator bool() const { return true; } private: int x = 1; std::map<int, int> m_; friend class Q; enum class E : int { P = 1, Q }; union { int i; float f; }; }; }',
        'template <class T> struct X<T*> { using type = T; };',
        'extern "C" { int f(void); }',
        'int A::f() const { return 1; }',
        'A::A(int x) : B(x), y_{x} {}',
        'static int g(int a = 1, ...);',
        'enum E { A, B = 2, };',
        'template <typename... Ts> auto sum(Ts... ts) -> decltype(auto) { return (ts + ...); }',
        'std::ostream& operator<<(std::ostream& o, const A& a) { return o; }',
        'int x; const char* names[] = {"a", "b"};',
        'template <typename T> concept C = requires(T t) { t.x(); };',
        'using namespace std;',
        'class F;',
    ],
    'rust': [
        'fn f() { let mut x = 1; }',
        'fn f() { if a > 3 { let mut y = b; } }',
        'fn f() { tracing::info!("a {}", x); }',
        'fn f() { let v = vec![a, 1]; let w = vec![0; n]; }',
        'fn f() { for (i, x) in v.iter().enumerate() { } }',
        'fn f() { while let Some(x) = it.next() { } }',
        'fn f() { let y = match z { Some(1..=5) | None => 1, Foo { a, .. } if a > 1 => { 2 } _ => return, }; }',
        'fn f() { if let Ok(x) = f() && x > 1 { } else if b { } else { } }',
        'fn f() { let c = |a: i32, b| -> i32 { a + b }; let d = move || x; }',
        'fn f() { x?.y().await?; }',
        'fn f() { let p = &mut q; *p += 1; }',
        "fn f() { loop { break 'a; } }",
        "fn f() { 'outer: for i in 0..10 { continue 'outer; } }",
        'fn f() { let s = S { a, b: 1, ..Default::default() }; }',
        'fn f() { let t: Vec<_> = v.into_iter().map(|x| x.0 as u64).collect::<Vec<_>>(); }',
        'fn f() { return Err(e.into()); }',
        'fn f() { let r = 1..; let q = ..=5; }',
        'fn f() { unsafe { f() } }',
        'fn f() { x as usize }',
        'fn f() { if a < b { } else { } }',
        'fn f() { let Some(x) = y else { return }; }',
        'fn f() { assert_eq!(a, b); }',
        'fn f() { matches!(x, A | B(_)); }',
        'fn f() { println!("{}", if a { 1 } else { 2 }); }',
        'fn f() { let a = [1, 2, 3]; a[0] = 2; }',
        'fn f() { (a, b) = (b, a); }',
        'fn f() { let f = async move { 1 }; }',
        'fn f() { async { g().await } }',
        'fn f() { let x = -1i64; let y = 0xFFu8; }',
        'fn f() { x >>= 2; }',
        '#![allow(x)]\nuse std::{io::{self, Read}, fmt::*};\npub(crate) mod m;\n#[derive(Debug, Clone)]\npub struct A<\'a, T: B + \'a> where T: C { pub x: &\'a str, y: Option<Box<dyn Fn(i32) -> T + Send>> }\nstruct U; struct T3(pub i32, String);\nenum E { A, B(i32), C { x: i32 }, D = 4 }\nimpl<\'a, T> Tr for A<\'a, T> where T: X { type O = i32; const K: u8 = 1; fn new(mut self: Box<Self>, (a, b): (i32, i32)) -> Result<Self, E> { Ok(self) } async fn q<F>(&mut self, f: F) -> impl Iterator<Item = u8> where F: FnOnce() -> u32, { } }\npub trait Q: R + S { fn f(&self); fn g() {} type Z: W; }\nstatic X: &[u8] = b"a"; const fn k() {} macro_rules! m { ($x:expr) => { $x }; }\nextern "C" { fn c(x: *const u8); }\ntype F2 = fn(i32) -> i32;',
        'fn g<T: ?Sized>(x: &T) -> <T as I>::Item { }',
    ],
    'go': [
        'package a\nfunc f() {\nx := 1\n}\n',
        'package a\nfunc f() {\na, err := f()\nif err != nil { return nil, err }\n}\n',
        'package a\nfunc f() {\nfor i := 0; i < n; i++ { }\n}\n',
        'package a\nfunc f() {\nfor k, v := range m { _ = k }\n}\n',
        'package a\nfunc f() {\nfor { break }\n}\n',
        'package a\nfunc f() {\nif x := f(); x > 0 { } else if y { } else { }\n}\n',
        'package a\nfunc f() {\nswitch v := x.(type) { case int, string: f()\ndefault: g() }\n}\n',
        'package a\nfunc f() {\nswitch { case a > b: return\n}\n}\n',
        'package a\nfunc f() {\nselect { case m := <-ch: f(m)\ncase ch <- 1:\ndefault: }\n}\n',
        'package a\nfunc f() {\ngo func() { f() }()\n}\n',
        'package a\nfunc f() {\ndefer mu.Unlock()\n}\n',
        'package a\nfunc f() {\nm := map[string][]int{"a": {1, 2}, "b": nil}\n}\n',
        'package a\nfunc f() {\np := &T{A: 1,\n B: 2,\n}\n}\n',
        'package a\nfunc f() {\nvar x, y int = 1, 2\n}\n',
        'package a\nfunc f() {\nvar z []byte\n}\n',
        'package a\nfunc f() {\nf := func(a int, b ...string) (int, error) { return 1, nil }\n}\n',
        'package a\nfunc f() {\nx++\ny--\nx += 1\n}\n',
        'package a\nfunc f() {\ns := a[1:2]\nt := a[:]\n}\n',
        'package a\nfunc f() {\nb := []byte("x")\n}\n',
        'package a\nfunc f() {\nch := make(chan int, 1)\n}\n',
        'package a\nfunc f() {\nL: for { continue L }\n}\n',
        'package a\nfunc f() {\nc := x.(T)\n}\n',
        'package a\nfunc f() {\nvar i interface{} = nil\n}\n',
        'package a\nfunc f() {\nconst k = 1\n}\n',
        'package a\nfunc f() {\nreturn\n}\n',
        'package a\nfunc f() {\ngoto L\n}\n',
        'package a\nfunc f() {\nv := *p\n}\n',
        'package a\nfunc f() {\nfmt.Println("a", x...)\n}\n',
        'package a\nfunc f() {\nx = y << 2 &^ 3\n}\n',
        'package a\nfunc f() {\ng := F[int](1)\n}\n',
        'package a\nfunc f() {\nvar fn func(int) error\n}\n',
        'package a\nfunc f() {\nif v, ok := m[k]; ok { }\n}\n',
        'package a\nfunc f() {\nfor range 3 { }\n}\n',
        'package a\n\nimport (\n\t"fmt"\n\tx "y/z"\n\t_ "q"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\ntype T struct {\n\tX, Y int `json:"x"`\n\t*E\n\tpkg.F\n}\n\ntype I interface {\n\tM(a int) error\n\tfmt.Stringer\n}\n\nfunc (t *T) M(a int) error { return nil }\n\nfunc G[K comparable, V int | string](m map[K]V) V { var v V; return v }\n\nvar (\n\ta = 1\n\tb int\n)\n\ntype F func(int) (string, error)\ntype A = B\n',
    ],
    'kotlin': [
        'fun f() {\nval x = 1\n}\n',
        'fun f() {\nval (a, b) = p\n}\n',
        'fun f() {\nfor (i in 0 until n) { }\n}\n',
        'fun f() {\nfor ((k, v) in m) f(k)\n}\n',
        'fun f() {\nif (a) b() else c()\n}\n',
        'fun f() {\nval y = if (a > b) 1 else 2\n}\n',
        'fun f() {\nwhen (x) { 1, 2 -> f()\n in 3..4 -> { }\n is Foo -> g()\n else -> h() }\n}\n',
        'fun f() {\nwhen { a -> b\n else -> c }\n}\n',
        'fun f() {\nx?.y?.let { it + 1 } ?: return\n}\n',
        'fun f() {\nlist.map { a -> a * 2 }.filter { it > 1 }\n}\n',
        'fun f() {\ntry { f() } catch (e: E) { } finally { }\n}\n',
        'fun f() {\nval z by lazy { 1 }\n}\n',
        'fun f() {\nreturn x\n}\n',
        'fun f() {\nthrow E("a")\n}\n',
        'fun f() {\ndo { x++ } while (x < 3)\n}\n',
        'fun f() {\nval m = mapOf("a" to 1)\n}\n',
        'fun f() {\nfun g(a: Int): Int = a\n}\n',
        'fun f() {\nval o = object : Foo(), Bar { override fun q() {} }\n}\n',
        'fun f() {\nx!!.y\n}\n',
        'fun f() {\nval f: (Int) -> Unit = { a: Int -> }\n}\n',
        'fun f() {\nx as? Foo\n}\n',
        'fun f() {\na = b\n  .c()\n  .d()\n}\n',
        'fun f() {\nlistOf<Int>()\n}\n',
        'fun f() {\nreturn@f\n}\n',
        'fun f() {\nx += 1\n}\n',
        'fun f() {\nval s = "a $b ${c}"\n}\n',
        'fun f() {\nif (a) {\n} else if (b) {\n} else {\n}\n}\n',
        'fun f() {\nfoo(a, b = 1) { x, y -> x }\n}\n',
        'fun f() {\nFoo::class.java\n}\n',
        'fun f() {\nvar v: List<Map<String, Int?>>? = null\n}\n',
        'fun f() {\nwhile (true) { break }\n}\n',
        'package a.b\n\nimport c.d.*\nimport e.F as G\n\n@Ann(x = 1)\nopen class A<T : B>(private val x: Int, var y: String = "a") : C<T>(x), D by e where T : F {\n    val z: Int\n        get() = 1\n    var w = 2\n        private set\n    init { f() }\n    constructor(a: Int) : this(a, "b") { }\n    companion object { const val K = 1 }\n    override suspend fun <U> g(u: U, vararg v: Int): U? where U : X { return u }\n    inner class I\n    fun String.ext(): Int = length\n}\n\nenum class E(val v: Int) { A(1), B(2) { override fun f() {} }; abstract fun f() }\n\nsealed interface S\ndata class P(val a: Int)\nobject O { }\ntypealias T2 = (Int) -> Unit\ninterface J { fun f()\n val q: Int }\nfun h() = 1\n',
    ],
    'swift': [
        'func f() {\nlet x = 1\n}\n',
        'func f() {\nvar y: [String: Int] = [:]\n}\n',
        'func f() {\nfor i in 0..<n { }\n}\n',
        'func f() {\nfor (k, v) in m where v > 1 { }\n}\n',
        'func f() {\nif a { } else if let b = c, b > 1 { } else { }\n}\n',
        'func f() {\nguard let x = y else { return }\n}\n',
        'func f() {\nswitch x { case 1, 2: f()\n case .foo(let a) where a > 1: g()\n case let .bar(b): h()\n default: break }\n}\n',
        'func f() {\ndo { try f() } catch let e as E { } catch { }\n}\n',
        'func f() {\nwhile a < b { }\n}\n',
        'func f() {\nrepeat { x += 1 } while x < 3\n}\n',
        'func f() {\nlet c = a > b ? d : e\n}\n',
        'func f() {\nitems.map { $0 + 1 }.filter { x in x > 1 }\n}\n',
        'func f() {\nfoo(a: 1, b: x) { y in y } onDone: { }\n}\n',
        'func f() {\nx?.y?.z()\n}\n',
        'func f() {\nx!.y\n}\n',
        'func f() {\nlet z = try? f()\n}\n',
        'func f() {\nlet w = y as? Foo ?? z\n}\n',
        'func f() {\nreturn x\n}\n',
        'func f() {\nthrow E.a\n}\n',
        'func f() {\nlet q: (Int) -> Void = { _ in }\n}\n',
        'func f() {\ndefer { f() }\n}\n',
        'func f() {\nif case .a(let b) = c { }\n}\n',
        'func f() {\nlet s = "a \\(b)"\n}\n',
        'func f() {\na = b\n  .c()\n  .d()\n}\n',
        'func f() {\nlet t = (1, "a")\n}\n',
        'func f() {\nTask { await f() }\n}\n',
        'func f() {\nlet arr: [Int?] = []\n}\n',
        'func f() {\nlet kp = \\Foo.bar\n}\n',
        'func f() {\nprint("a", x)\n}\n',
        'func f() {\n_ = f()\n}\n',
        'func f() {\nlet closure = { [weak self] (a: Int) -> Int in return a }\n}\n',
        'func f() {\nx = -y\n}\n',
        'import Foundation\n\n@objc public final class A<T: B>: C, D where T: E {\n    private let x: Int\n    static var y = 1\n    var z: Int { return 1 }\n    var w: Int { get { 1 } set { x = newValue } }\n    lazy var l: Foo = { Foo() }()\n    init(a: Int, _ b: String = "c") throws { super.init() }\n    deinit { }\n    override func f<U>(with u: U, in v: inout Int) async throws -> U? { return u }\n    subscript(i: Int) -> Int { return i }\n    enum E: String, CaseIterable { case a, b = "c"; case d(Int, x: String) }\n    @Published var p = 1\n}\n\nprotocol P: AnyObject { associatedtype T; var x: Int { get set }; func f() }\nextension A: P { }\nstruct S { let a: Int; var b: String? }\ntypealias F = (Int) throws -> Void\nstatic func + (a: A, b: A) -> A { a }\nfunc g(_ x: some View) -> any P { }\n',
    ],
    'ruby': [
        'x = 1',
        'puts x, y if z',
        'def f(a, b = 1, *c, d:, e: 2, **g, &h)\n  a\nend',
        'class A < B::C\n  attr_accessor :a, :b\n  include D\n  X = 1\n  def self.f\n    @x ||= {}\n  end\nend',
        'if a && b\n  c\nelsif d\n  e\nelse\n  f\nend',
        'x = a ? b : c',
        '[1, 2].each do |x|\n  puts x\nend',
        'list.map { |a, b| a + b }.select(&:ok?)',
        'begin\n  f\nrescue A, B => e\n  g\nensure\n  h\nend',
        'case x\nwhen 1, 2 then y\nwhen A\n  z\nelse\n  w\nend',
        'while x < 3 do\n  x += 1\nend',
        'h = { a: 1, \'b\' => 2, "c": 3 }',
        'return unless x',
        'raise Foo, "bar" unless x',
        'foo a: 1, b: 2',
        'x&.y&.z',
        '->(a) { a }',
        'a, b = b, a',
        '@x = y rescue nil',
        'module A\n  class << self\n    def x; end\n  end\nend',
        'def f(x) = x + 1',
        'x.each_with_index do |a, i| puts a end',
        'y = if a then b else c end',
        's = <<~EOS\n  hi\nEOS\n',
        'puts "a #{b}"',
        'foo\n  .bar\n  .baz(1)',
        'private def f; end',
        'yield x',
        'until a\n b\nend',
        'for a in b do\n c\nend',
        'x = %w[a b c]',
        'p(*a, **b)',
        'def ==(o)\n true\nend',
        'foo.bar = 1',
        'x[1] = 2',
        'unless x then y end',
        'not x',
        'a and b or c',
        'f(a, b) do |x|\n y\nend',
        'logger.info("x", y)',
        'loop { break }',
        'x =~ /a/',
        'def x?\n !y\nend',
        'puts [1].map do |x|\n x\nend',
        'a <<= 1 if b',
        'x = y.z 1, 2',
    ],
    'sql': [
        'SELECT a, b AS c, count(*) FROM t x JOIN u ON x.a = u.b LEFT JOIN v USING (a) WHERE a > 1 AND b IN (1, 2) AND c IS NOT NULL GROUP BY a, b HAVING count(*) > 1 ORDER BY a DESC NULLS LAST LIMIT 10 OFFSET 5;',
        'WITH x AS (SELECT 1), y AS (SELECT 2) SELECT * FROM x, y;',
        "INSERT INTO s.t (a, b) VALUES (1, 'x'), (2, NULL) ON CONFLICT (a) DO UPDATE SET b = EXCLUDED.b RETURNING id;",
        'UPDATE t SET a = 1, b = c + 1 FROM u WHERE t.id = u.id;',
        'DELETE FROM t USING u WHERE t.a = u.a;',
        "CREATE TABLE IF NOT EXISTS s.t (id BIGSERIAL PRIMARY KEY, a VARCHAR(10) NOT NULL DEFAULT 'x', b NUMERIC(10, 2) CHECK (b > 0), c TIMESTAMP WITH TIME ZONE DEFAULT now(), d INT REFERENCES u(id) ON DELETE CASCADE, e text[], PRIMARY KEY (a, b), CONSTRAINT q UNIQUE (c), FOREIGN KEY (d) REFERENCES v (id));",
        "CREATE OR REPLACE VIEW v AS SELECT a::int, b->>'c' FROM t;",
        'CREATE UNIQUE INDEX CONCURRENTLY i ON t USING btree (lower(a), b DESC) WHERE a IS NOT NULL;',
        "CREATE OR REPLACE FUNCTION f(a int, b text DEFAULT 'x') RETURNS int AS $$ BEGIN RETURN 1; END; $$ LANGUAGE plpgsql;",
        'CREATE TRIGGER x BEFORE INSERT OR UPDATE ON t FOR EACH ROW EXECUTE FUNCTION f();',
        'ALTER TABLE t ADD COLUMN a int, DROP COLUMN b;',
        'DROP TABLE IF EXISTS t CASCADE;',
        'GRANT SELECT ON t TO u;',
        "SELECT CASE WHEN a THEN 1 ELSE 2 END, coalesce(a, b), row_number() OVER (PARTITION BY a ORDER BY b DESC) AS rn FROM (SELECT 1) s WHERE EXISTS (SELECT 1 FROM u) AND a BETWEEN 1 AND 2 OR b LIKE 'x%';",
        'SELECT 1 UNION ALL SELECT 2;',
        'BEGIN; COMMIT;',
        'SELECT sum(a) FILTER (WHERE b) FROM t;',
        "SELECT extract(epoch FROM now()), interval '1 day', date '2020-01-01', a AT TIME ZONE 'UTC';",
        'CREATE POLICY p ON t FOR SELECT USING (a = b);',
        'SELECT DISTINCT ON (a) a, b FROM t TABLESAMPLE_X;',
        "COMMENT ON TABLE t IS 'x';",
        "CREATE TYPE x AS ENUM ('a', 'b');",
        'SELECT a.* FROM generate_series(1, 10) AS g(i) CROSS JOIN LATERAL (SELECT 1) a;',
        'CREATE TABLE x AS SELECT 1;',
        'SELECT array_agg(a ORDER BY b), ARRAY[1, 2], (ARRAY[1])[1] FROM t FOR UPDATE SKIP LOCKED;',
        'SET x = 1;',
        'INSERT INTO t SELECT * FROM u;',
        "CREATE USER x WITH PASSWORD 'y';",
    ],
}


@pytest.mark.parametrize("lang", sorted(INVALID))
def test_refused(lang):
    assert [t for t in INVALID[lang] if grammar.valid(lang, t)] == []


@pytest.mark.parametrize("lang", sorted(VALID))
def test_taken(lang):
    assert [t for t in VALID[lang] if not grammar.valid(lang, t)] == []


@pytest.mark.parametrize("lang", sorted(VALID))
def test_cut(lang):
    """A text that is cut within a bracket is never valid."""
    for t in VALID[lang]:
        at = max(t.rfind(c) for c in ")}]")
        if at > 0 and lang != "ruby":
            assert not grammar.valid(lang, t[:at]), t


def test_long_and_deep():
    assert grammar.valid("javascript", "const x = [" + "1, " * 50_000 + "2];")
    assert grammar.valid("java", "class A { int f() { return " + "(" * 200 + "1" + ")" * 200 + "; } }")
    assert not grammar.valid("go", "package a\nvar x = []int{" + "1, " * 20_000 + "2 3}\n")
