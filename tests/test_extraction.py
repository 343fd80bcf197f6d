"""Facts of a small corpus: what extraction, data flow and taint must give."""

import datetime as dt

import pytest

from veldspar.plans import extraction

CORPUS = {
    "shop/orders.py": '''"""Orders."""
import json
import os.path as osp
from .db import Store, open_db as connect
from requests import Session

LIMIT = 10
CACHE = {}


class Order(Base, mixins.Audit):
    """An order."""
    table = "orders"

    def __init__(self, store: Store, *items, note: Optional[str] = None, **extra):
        self.lock = threading.Lock()
        self.store = store
        self.total = 0

    def add(self, item, price):
        self.total += price
        if price > LIMIT:
            raise ValueError("too much")
        line = clean(item)
        self.store.save(line, key=item)
        return line


@app.get("/orders/{id}")
@login_required
def read_order(order_id: int) -> dict:
    global CACHE
    for key in CACHE:
        try:
            json.loads(key)
        except (KeyError, ValueError):
            pass
    CACHE[order_id] = 1
    requests.post("https://api.example.test/v1", json=order_id)
    bus.publish("order.placed")
    mailer.send("hello")
    store = Store()
    store.find(*order_id)
    return run_query(order_id)


@events.subscribe("order.placed")
@app.route("/hook", methods=["POST", "PUT"])
async def hook(request):
    def inner(x):
        return x
    return inner(request)
''',
    "shop/db.py": '''def run_query(key, limit=5):
    sql = "select * from t where k = " + key
    return fetch(sql=sql, n=limit)


def fetch(n, sql):
    cursor.execute(sql)
    os.system("true")
    return n
''',
    "shop/broken.py": "def f(:\n",
}

# columns, then the rows that the corpus must give
GOLD = {
    'x_python': ('type, fqn, line', [('File', 'shop.orders', 1), ('Field', 'shop.orders.CACHE', None), ('Field', 'shop.orders.LIMIT', None), ('Class', 'shop.orders.Order', 11), ('Field', 'shop.orders.Order.table', 13), ('Field', 'shop.orders.Order.lock', 16), ('Field', 'shop.orders.Order.store', 17), ('Field', 'shop.orders.Order.total', 18), ('Function', 'shop.orders.Order.__init__', 15), ('Function', 'shop.orders.Order.add', 20), ('Function', 'shop.orders.read_order', 31), ('Function', 'shop.orders.hook', 49), ('Function', 'shop.orders.hook.inner', 50), ('Endpoint', 'GET /orders/{id}', 29), ('Endpoint', 'POST /hook', 48), ('Endpoint', 'PUT /hook', 48), ('File', 'shop.db', 1), ('Function', 'shop.db.run_query', 1), ('Function', 'shop.db.fetch', 6)]),
    'x_metrics': ('fqn, cyclomatic, counts', [('shop.orders.Order.__init__', 1, '0,0,4'), ('shop.orders.Order.add', 2, '1,0,7'), ('shop.orders.read_order', 3, '1,1,14'), ('shop.orders.hook', 1, '0,0,4'), ('shop.orders.hook.inner', 1, '0,0,2'), ('shop.db.run_query', 1, '0,0,3'), ('shop.db.fetch', 1, '0,0,4')]),
    'x_endpoints': ('src, name', [('shop.orders.read_order', 'GET /orders/{id}'), ('shop.orders.hook', 'POST /hook'), ('shop.orders.hook', 'PUT /hook')]),
    'x_outbound_http': ('src, name, value', [('shop.orders.read_order', 'https://api.example.test/v1', 'POST')]),
    'x_events': ('type, src, name, value', [('EMITS_EVENT', 'shop.orders.read_order', 'order.placed', 'sure'), ('EMITS_EVENT', 'shop.orders.read_order', 'hello', 'fuzzy'), ('CONSUMES_EVENT', 'shop.orders.hook', 'order.placed', 'sure')]),
    'x_auth': ('src, name, value', [('shop.orders.read_order', 'AUTH_REQUIRED', 'sure')]),
    'x_locks': ('fqn', [('shop.orders.Order.lock',)]),
    'x_exceptions': ('type, src, name', [('THROWS', 'shop.orders.Order.add', 'ValueError'), ('CATCHES', 'shop.orders.read_order', 'KeyError'), ('CATCHES', 'shop.orders.read_order', 'ValueError')]),
    'x_types': ('type, src, name', [('PARAM_TYPE', 'shop.orders.Order.__init__', 'Store'), ('PARAM_TYPE', 'shop.orders.Order.__init__', 'Optional'), ('HAS_GENERIC', 'shop.orders.Order.__init__', 'str'), ('PARAM_TYPE', 'shop.orders.read_order', 'int'), ('RETURN_TYPE', 'shop.orders.read_order', 'dict')]),
    'x_params': ('fqn, arity, args', [('shop.orders.Order.__init__', 4, 'store,*items,note,**extra'), ('shop.orders.Order.add', 2, 'item,price'), ('shop.orders.read_order', 1, 'order_id'), ('shop.orders.hook', 1, 'request'), ('shop.orders.hook.inner', 1, 'x'), ('shop.db.run_query', 2, 'key,limit'), ('shop.db.fetch', 2, 'n,sql')]),
    'x_receivers': ('name, value, arity', [('find', 'Store', -1)]),
    'x_imports': ('name, fqn, value', [('json', 'json', None), ('path', 'os.path', 'osp'), ('Store', '.db.Store', None), ('open_db', '.db.open_db', 'connect'), ('Session', 'requests.Session', None)]),
    'x_extends': ('src, name', [('shop.orders.Order', 'Base'), ('shop.orders.Order', 'Audit')]),
    'x_syntax_gate': ('relpath, line', [('shop/broken.py', 1)]),
    'g_taint': ('source, param, sink, sink_class, path, hops', [('shop.orders.read_order', 'order_id', 'execute', 'sql_injection', 'shop.orders.read_order > shop.db.run_query > shop.db.fetch', 3), ('shop.orders.read_order', 'order_id', 'post', 'ssrf', 'shop.orders.read_order', 1)]),
    'p_sink_classify': ('src, name, sink_class', [('shop.db.fetch', 'execute', 'sql_injection'), ('shop.db.fetch', 'system', 'command_injection'), ('shop.orders.read_order', 'loads', 'deserialization'), ('shop.orders.read_order', 'post', 'ssrf')]),
    'j_arg_binding': ('src, callee, slot, callee_param', [('shop.orders.read_order', 'shop.db.run_query', '0', 'key'), ('shop.db.run_query', 'shop.db.fetch', 'sql', 'sql'), ('shop.db.run_query', 'shop.db.fetch', 'n', 'n'), ('shop.orders.hook', 'shop.orders.hook.inner', '0', 'x')]),
}
FIELDS = {('READS', 'add', 'Order.total'), ('WRITES', '__init__', 'Order.store'), ('WRITES', '__init__', 'Order.total'), ('WRITES', 'add', 'Order.total'), ('READS', 'add', 'Order.store'), ('WRITES', '__init__', 'Order.lock')}
GLOBALS = {('READS', 'shop.orders.Order.add', 'shop.orders.LIMIT'), ('READS', 'shop.orders.read_order', 'shop.orders.CACHE'), ('WRITES', 'shop.orders.read_order', 'shop.orders.CACHE')}
FLOWS = {('PASSES', 'shop.db.run_query', 'fetch', 'n', '1'), ('PASSES', 'shop.db.fetch', 'execute', '0', '1'), ('PASSES', 'shop.db.run_query', 'fetch', 'sql', '0'), ('PASSES', 'shop.db.fetch', 'system', '0', ''), ('RETURNS', 'shop.db.run_query', None, None, '0,1'), ('RETURNS', 'shop.db.fetch', None, None, '0')}

FILE = "repo string, relpath string, text string, last_indexed timestamp_ntz"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    rows = [(repo, p, t, new) for repo in ("a", "b", None) for p, t in CORPUS.items()]
    rows += [("a", "shop/db.py", "def gone(x):\n    os.system(x)\n", old), ("b", "shop/orders.py", None, None)]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, FILE).write.parquet(str(d / "files.parquet"))
    return str(d)


@pytest.mark.parametrize("name", sorted(GOLD))
def test_facts(spark, corpus, name):
    columns, want = GOLD[name]
    got = extraction.QUERIES[name](spark, corpus)
    for repo in ("a", "b", ""):
        rows = [tuple(r) for r in got.where(f"repo = '{repo}'").select(*columns.split(", ")).collect()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)


def _run(spark, corpus, name):
    return [tuple(r) for r in extraction.QUERIES[name](spark, corpus).where("repo = 'a'").drop("repo", "relpath").collect()]


def test_state_and_flow(spark, corpus):
    fields = {(t, s.rpartition(".")[2], n.removeprefix("shop.orders.")) for t, s, n in _run(spark, corpus, "x_field_state")}
    assert fields == FIELDS
    assert set(_run(spark, corpus, "x_global_state")) == GLOBALS
    assert FLOWS < set(_run(spark, corpus, "x_dataflow"))


WEB = {
    "web/app.py": '''
class Box:
    def __init__(self, raw):
        self.raw = raw
        self.kept = self.raw

    def run(self):
        cursor.execute(self.kept)


@app.get("/a")
def entry(q, n):
    Box(q)
    first(q)
    first(clean(n))
    logger.info("x")


def first(v):
    w = v + "x"
    return second(1, text=w)


def second(k, text):
    first(text)
    os.system(text)


def clean(x):
    return x.strip()


def clean_badly(x):
    eval(x)
    return x
''',
}


@pytest.fixture(scope="module")
def web(spark):
    from veldspar.operators import extract

    rows = [("r", p, t) for p, t in WEB.items()]
    return extract.extract_python(spark.createDataFrame(rows, "repo string, relpath string, text string")).persist()


def test_taint_through_calls_and_cycles(web):
    from veldspar.operators import taint

    hits = {(r.param, r.sink_class, r.path, r.sanitized) for r in taint.taint(web).collect()}
    m = "web.app."
    assert ("q", "command_injection", f"{m}entry > {m}first > {m}second", False) in hits
    paths = {r.path for r in taint.taint_paths(web).where("param = 'q'").collect()}
    assert f"{m}entry > {m}first > {m}second" in paths


def test_fields_and_sanitizers(web):
    from veldspar.operators import taint

    assert {(r.fn, r.p) for r in taint.sanitizers(web).collect()} == {("web.app.clean", 0)}
    assert {(r.fn, r.sink_class, tuple(r.params)) for r in taint.own_sinks(web).collect()} >= {("web.app.second", "command_injection", (1,)), ("web.app.clean_badly", "eval_injection", (0,))}
    edges = {(r.src, r.callee): (r.positions, r.from_params, r.const_args) for r in taint.passes_edges(web).collect()}
    assert edges[("web.app.first", "second")] == ([0, -1], [-1, 0], [0])


def test_sink_classes(spark):
    from veldspar.operators import taint

    rows = [("execute", ""), ("exec", ""), ("eval", ""), ("open", ""), ("open", "gzip"), ("get", "requests"), ("get", "cache"), ("Markup", ""), ("parse", "etree")]
    df = spark.createDataFrame(rows, "n string, r string")
    got = [r.c for r in df.select(taint.sink_class(df.n, df.r).alias("c")).collect()]
    assert got == ["sql_injection", "command_injection", "eval_injection", "path_traversal", None, "ssrf", None, "xss", "xxe"]
