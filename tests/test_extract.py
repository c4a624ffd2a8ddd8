import fixtures as fx
import pytest
from graphloom import goldens
from graphloom.extract import extract


def names(path, language, text, **more):
    records, calls = extract(path, language, text, **more)
    return {r["qualified_name"]: r for r in records}, [(c["line"], c["called_name"], c["arg_count"]) for c in calls]


def brief(items):
    return [(p["name"], p["type"] or p["type_expr"], p["nullable"]) for p in items]


def test_go():
    f, calls = names("shop/basket.go", "go", fx.GO)
    assert list(f) == ["shop.Checkout", "shop.addUp", "shop.Basket.Describe", "shop.Basket.check", "shop.pair"]
    c = f["shop.Checkout"]
    assert (c["start_line"], c["end_line"], c["exported"], c["package"], c["kind"]) == (18, 23, True, "shop", "function")
    assert brief(c["parameters"]) == [("b", "Basket", False), ("limit", "*int", True), ("tags", "...string", False)]
    assert c["parameters"][2]["variadic"] and not c["parameters"][0]["variadic"]
    assert [(x["name"], x["type"], x["nullable"]) for x in c["parameters"][0]["expanded"]] == [("Owner", "string", False), ("Lines", "[]Line", False), ("Parent", "*Basket", True)]
    assert c["returns"]["multiple"] and brief(c["returns"]["values"]) == [("total", "float64", False), ("err", "error", True)]
    d = f["shop.Basket.Describe"]
    assert (d["kind"], d["receiver"]) == ("method", "*Basket") and d["parameters"][0]["type"] == "interface{}" and d["parameters"][1]["type_expr"] == "map[string]int"
    assert f["shop.addUp"]["parameters"][0]["type"] == "[]Line" and not f["shop.addUp"]["exported"]
    assert brief(f["shop.pair"]["parameters"]) == [("", "int", False), ("", "string", False)]
    p = f["shop.pair"]["returns"]["values"]
    assert p[0]["type_expr"] == "Sum" and p[1]["type"] == "*Line" and p[1]["expanded"]
    assert all(r["contract_completeness"] == "full" for r in f.values())
    assert (19, "addUp", 1) in calls and (20, "Println", 2) in calls and (20, "describe", 1) in calls and (30, "check", 0) in calls
    assert not any(n in ("Checkout", "Describe", "func") for _, n, _ in calls)


def test_go_tests_need_the_file_name():
    f, _ = names("shop/basket_test.go", "go", fx.GO_TEST)
    assert f["shop.TestCheckout"]["tag"] == "test" and f["shop.prepare"]["tag"] == "application"
    assert names("shop/basket.go", "go", fx.GO_TEST)[0]["shop.TestCheckout"]["tag"] == "application"


def test_python():
    f, calls = names("app/service.py", "python", fx.PYTHON)
    assert list(f) == ["Request.load", "Request.make", "handle", "open_all", "_private", "__dunder__"]
    load = f["Request.load"]
    assert brief(load["parameters"]) == [("path", "str", False), ("deep", "bool", False)] and load["receiver"] == "Request" and load["contract_completeness"] == "full"
    make = f["Request.make"]
    assert (make["start_line"], make["contract_completeness"]) == (12, "inferred") and [p["name"] for p in make["parameters"]] == ["cls", "raw"]
    assert [(x["name"], x["type"], x["nullable"]) for x in make["parameters"][1]["expanded"]] == [("ident", "int", False), ("note", "Optional[str]", True)]
    h = f["handle"]
    assert (h["start_line"], h["end_line"]) == (25, 32) and brief(h["parameters"]) == [("request", "Request", False), ("hidden", "Hidden | None", True)] and h["returns"]["values"] == []
    assert brief(f["open_all"]["parameters"]) == [("path", "", False), ("mode", "", False), ("", "str", False)] and f["open_all"]["returns"]["values"][0]["nullable"]
    assert not f["_private"]["exported"] and f["__dunder__"]["exported"]
    assert (31, "open_all", 2) in calls and (32, "inner", 0) in calls and (25, "route", 1) in calls and (40, "_private", 0) in calls


def test_python_tests():
    f, _ = names("a/test_x.py", "python", fx.PYTHON_TEST)
    assert f["test_open"]["tag"] == "test" and f["helper"]["tag"] == "application"
    assert names("a/x.py", "python", fx.PYTHON_TEST)[0]["test_open"]["tag"] == "application"
    assert names("a/x_test.py", "python", fx.PYTHON_TEST)[0]["test_open"]["tag"] == "test"


def test_java():
    f, calls = names("java/Store.java", "java", fx.JAVA)
    base = "com.shop.core.Store."
    assert list(f) == [base + n for n in ("Store", "find", "all", "copy", "works")] + ["com.shop.core.Closer.close", "com.shop.core.Closer.stop"]
    c = f[base + "Store"]
    assert c["kind"] == "constructor" and brief(c["parameters"]) == [("name", "String", False), ("parent", "Store", True)] and c["returns"]["values"] == []
    assert [x["name"] for x in c["parameters"][1]["expanded"]] == ["name", "alias", "sizes"]
    find = f[base + "find"]
    assert (find["start_line"], find["end_line"], find["exported"]) == (16, 19, True) and brief(find["parameters"]) == [("key", "String", False), ("sizes", "int", False)]
    assert find["returns"]["values"][0]["type"] == "Optional<List<T>>" and find["returns"]["values"][0]["nullable"]
    assert f[base + "all"]["returns"]["values"] == [] and f[base + "copy"]["returns"]["values"][0]["expanded"] and f[base + "copy"]["parameters"][0]["type"] == "Map<String, List<K>>"
    assert f[base + "works"]["tag"] == "test" and not f["com.shop.core.Closer.stop"]["exported"] and f["com.shop.core.Closer.close"]["start_line"] == 32
    assert {(18, "lookup", 2), (18, "run", 0), (13, "check", 1), (26, "find", 1), (33, "copy", 1)} <= set(calls)
    assert names("java/Store.java", "java", fx.JAVA, strict_parity=True)[1] == []


def test_typescript():
    f, calls = names("web/desk.ts", "typescript", fx.TYPESCRIPT)
    assert list(f) == ["place", "plain", "twice", "once", "short", "Desk.constructor", "Desk.open", "Desk.close"]
    p = f["place"]
    assert brief(p["parameters"]) == [("order", "Order", False), ("box", "Box", True), ("", "string[]", False)] and p["exported"] and (p["start_line"], p["end_line"]) == (7, 10)
    assert [(x["name"], x["type"], x["nullable"]) for x in p["parameters"][0]["expanded"]] == [("id", "string", False), ("note", "string", True), ("tags", "Map<string, number[]>", False)]
    assert [(x["name"], x["type"]) for x in p["parameters"][1]["expanded"]] == [("size", "number"), ("of", "Order | null")]
    assert f["plain"]["contract_completeness"] == "partial" and f["plain"]["returns"]["values"] == [] and not f["plain"]["exported"]
    assert f["twice"]["returns"]["values"][0]["type"] == "number" and f["once"]["parameters"][0]["nullable"] and (f["once"]["start_line"], f["once"]["end_line"]) == (15, 17)
    assert f["Desk.constructor"]["kind"] == "constructor" and not f["Desk.constructor"]["exported"] and f["Desk.open"]["exported"] and not f["Desk.close"]["exported"]
    assert [x["name"] for x in f["Desk.open"]["parameters"]] == ["", "kind"] and f["Desk.close"]["returns"]["values"][0]["nullable"]
    assert {(9, "send", 1), (9, "then", 1), (16, "plain", 1), (18, "twice", 1), (23, "place", 1), (24, "get", 1)} <= set(calls)


def test_typescript_test_files_are_tests():
    assert names("web/desk.test.ts", "typescript", fx.FILES["web/desk.test.ts"])[0]["setup"]["tag"] == "test"


@pytest.mark.parametrize("language", ["go", "python", "java", "typescript"])
@pytest.mark.parametrize("text", ["", "\n", "}}}((", "func (", "def f(", "class X { void f(", "export class {", "'''", '"abc', "`${`", "/* open", "x = {", "func f(a, b", "interface A {", "@", "def f(a: =): pass"])
def test_broken_text_gives_what_can_be_read(language, text):
    records, calls = extract("a", language, text)
    assert isinstance(records, list) and isinstance(calls, list)


@pytest.mark.parametrize("language", ["go", "py", "java", "ts"])
def test_records_written_by_hand(spark, language):
    assert sorted(tuple(r) for r in goldens.rendered(spark, language).collect()) == sorted(goldens.expected(f"{language}_"))
