"""Facts of small Java and TypeScript files."""

from veldspar.operators.extract_braces import brace_facts

JAVA = '''package shop.web;
import java.util.List;
import static java.lang.Math.*;

@RestController
@RequestMapping("/orders")
public class OrderController extends Base<Order> implements Api, Closeable {
    private final OrderService service;
    @Autowired private Mailer mailer;
    private int count = 0, unused;

    public OrderController(OrderService service) {
        this.service = service;
    }

    @GetMapping("/{id}")
    @PreAuthorize("hasRole('ADMIN')")
    public List<Order> read(@PathVariable long id, String... tags) throws IOException {
        if (id > 0 && tags.length > 1) {
            for (String t : tags) { service.find(id, t); }
        }
        try {
            restTemplate.getForObject("http://x/y", Order.class);
        } catch (IllegalStateException | IOException e) {
            throw new OrderException("x {");
        }
        this.count += 1;
        return new ArrayList<>();
    }

    enum Kind { A, B; int rank() { return 1; } }
}
'''

TS = '''import def, { a as b, type C } from './x';
import * as ns from "pkg";
import './effect';
export interface Shape { id: string }
type Id = string | number;
export class Box<T> extends Base implements Shape {
  private items: Map<string, T> = new Map();
  static count = 0;
  constructor(readonly raw: string) { super(); this.raw = raw; }
  async load(key: string, ...more: number[]): Promise<T> {
    const found = this.items.get(key) || `a ${b({ c: 1 })}`;
    return found && /x[/]{/.test(key) ? found : ns.make(found);
  }
}
const add = async (x: number, y = 2): Promise<number> => {
  while (x) { x--; }
  await fetch('/api/add');
  return x;
};
function top({ a }, b) { function inner() {} return inner(); }
app.get('/items', (req, res) => { res.send(add(1)); });
'''


def facts(path, text):
    return [dict(zip("repo relpath fact type src name fqn value line end arity args".split(), r, strict=True)) for r in brace_facts("r", path, text)]


def pick(rows, fact, kind, *columns):
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in rows if r["fact"] == fact and r["type"] == kind}


def test_java():
    f = facts("src/OrderController.java", JAVA)
    c = "shop.web.OrderController"
    assert pick(f, "node", "Class", "fqn", "value") == {(c, "class"), (f"{c}.Kind", "enum")}
    assert pick(f, "node", "Function", "fqn", "value", "arity") == {(f"{c}.OrderController", "constructor", 1), (f"{c}.read", "method", 2), (f"{c}.Kind.rank", "method", 0)}
    assert {"service", "mailer", "count"} <= pick(f, "node", "Field", "name")
    assert pick(f, "node", "Endpoint", "name") == {"GET /orders/{id}"}
    assert pick(f, "ref", "EXTENDS", "name") == {"Base"} and pick(f, "ref", "IMPLEMENTS", "name") == {"Api", "Closeable"}
    assert pick(f, "ref", "AUTOWIRED", "name", "value") == {("Mailer", "field"), ("OrderService", "constructor")}
    assert pick(f, "ref", "IMPORTS", "fqn", "value") == {("java.util.List", None), ("java.lang.Math", "wildcard")}
    assert pick(f, "ref", "THROWS", "name") == {"IOException", "OrderException"} and pick(f, "ref", "CATCHES", "name") == {"IllegalStateException", "IOException"}
    assert ("find", "service", 2) in {(r["name"], r["value"], r["arity"]) for r in f if r["type"] == "CALLS"}
    assert pick(f, "ref", "INSTANTIATES", "name") == {"OrderException", "ArrayList"}
    assert pick(f, "ref", "WRITES", "name") == {f"{c}.service", f"{c}.count"} and f"{c}.count" in pick(f, "ref", "READS", "name")
    assert pick(f, "ref", "CALLS_API", "name", "value") == {("http://x/y", "GET")} and pick(f, "ref", "REQUIRES_AUTH", "name") == {"hasRole('ADMIN')"}
    assert next(r["args"] for r in f if r["type"] == "cyclomatic" and r["name"] == "read")[:2] == ["2", "1"]
    assert ("shop.web.OrderController.read", "List") in pick(f, "ref", "RETURN_TYPE", "src", "name") and "Order" in pick(f, "ref", "HAS_GENERIC", "name")


def test_typescript():
    f = facts("web/box.ts", TS)
    assert pick(f, "node", "Class", "name", "value") == {("Shape", "interface"), ("Id", "type_alias"), ("Box", "class")}
    names = pick(f, "node", "Function", "fqn", "value", "arity")
    assert {("web.box.Box.constructor", "method", 1), ("web.box.Box.load", "method", 2), ("web.box.add", "arrow", 2), ("web.box.top", "function", 2), ("web.box.top.inner", "function", 0)} == names
    assert {("def", "./x#def", "default"), ("a", "./x#a", "b"), ("C", "./x#C", "named"), ("ns", "pkg#ns", "namespace"), ("./effect", "./effect", "effect")} == pick(f, "ref", "IMPORTS", "name", "fqn", "value")
    assert {"items", "count"} <= pick(f, "node", "Field", "name")
    assert pick(f, "ref", "EXTENDS", "name") == {"Base"} and pick(f, "ref", "IMPLEMENTS", "name") == {"Shape"}
    assert pick(f, "ref", "CALLS_API", "name") >= {"/api/add"} and pick(f, "node", "Endpoint", "name") == {"GET /items"}
    assert "web.box.Box.raw" in pick(f, "ref", "WRITES", "name") and "web.box.Box.items" in pick(f, "ref", "READS", "name")
    assert ("web.box.Box.load", "Promise") in pick(f, "ref", "RETURN_TYPE", "src", "name")
    assert next(r["arity"] for r in f if r["type"] == "cyclomatic" and r["name"] == "load") == 4


def test_broken_and_empty():
    f = facts("A.java", "class A {\n  int f(int x) {\n    return x;\n")
    assert [r["type"] for r in f if r["fact"] == "error"] == ["SyntaxError"]
    assert pick(f, "node", "Function", "fqn") == {"A.A.f"}
    assert [r["type"] for r in facts("a.js", None)][:1] == ["File"]
