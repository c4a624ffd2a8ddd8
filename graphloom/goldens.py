"""Own source texts with the records expected of them: small cases of every language, and of call resolution.

``EXPECTED`` is written by hand from the rules of the extraction records; the registered ``golden_*`` queries run the
extractors over ``CASES`` and are compared with it. One row of it holds

    case | qualified name | kind | receiver | first-last line | exported | tag | completeness | parameters | returns

Parameters and values are ``name:type``, ``name:~type expression``; '?' marks nullable, '*' variadic, braces the expanded
fields, 'multiple' a list of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.extract.frames import extract_files

CASES: dict[str, tuple[str, str]] = {
    # ------------------------------------------------------------ Go
    "go_plain": (
        "rivers/gauge.go",
        """package rivers

type Gauge struct {
	Site   string
	Levels []float64
	Last   *Reading
}

type Reading struct {
	At int64
}

func Measure(g Gauge, depth float64) Reading {
	return Reading{}
}

func drain(g *Gauge) {
}
""",
    ),
    "go_nullable": (
        "rivers/lookup.go",
        """package rivers

func Find(site *string, limit int) (*Gauge, error) {
	return nil, nil
}

func check(site string) error {
	return nil
}
""",
    ),
    "go_methods": (
        "boats/ferry.go",
        """package boats

type Ferry struct {
	Name, Port string
	Deck
}

func (f *Ferry) Load(tons int) bool {
	return true
}

func (f Ferry) label() string { return f.Name }
""",
    ),
    "go_tests": (
        "boats/ferry_test.go",
        """package boats

func TestLoad(t *testing.T) {}

func BenchmarkLoad(b *testing.B) {}

func ExampleFerry_Load() {}

func newFerry() *Ferry { return nil }
""",
    ),
    "go_results": (
        "mills/grind.go",
        """package mills

func Split(total int) (flour int, bran int, err error) {
	return 0, 0, nil
}

func Stones() (int, []string) {
	return 0, nil
}

func Stop() {}
""",
    ),
    "go_edges": (
        "mills/odd.go",
        """package mills

func init() {}

func Sum(parts ...int) int { return 0 }

func Wrap(any interface{}, rates map[string]float64, pick func(int) bool) chan int {
	return nil
}

func pair(a, b int, _ string) {
	helper := func() {}
	helper()
}
""",
    ),
    # ------------------------------------------------------------ Python
    "py_plain": (
        "orchard/trees.py",
        '''class Tree:
    kind: str
    height: float = 1.0
    owner = None


def plant(tree: Tree, count: int) -> bool:
    return True


def prune(tree: Tree) -> None:
    pass
''',
    ),
    "py_inferred": (
        "orchard/loose.py",
        """def pick(basket, size=3):
    return basket


def weigh(basket: list, *more, **options) -> float:
    return 0.0


def rest():
    return None
""",
    ),
    "py_dataclass": (
        "orchard/crate.py",
        """@dataclass
class Crate:
    label: str
    fill: Optional[int] = None

    def lost(self) -> int:
        return 1


def ship(crate: Crate) -> Crate:
    return crate
""",
    ),
    "py_nullable": (
        "orchard/maybe.py",
        """def first(a: Optional[str], b: int | None, c: Union[str, None], d: Union[str, int]) -> None | str:
    return a


def last(a: str = None) -> Optional[int]:
    return None
""",
    ),
    "py_tests": (
        "orchard/test_trees.py",
        """def test_plant():
    assert True


def helper():
    return 1


class TestTree:
    def test_height(self):
        assert True
""",
    ),
    "py_decorators": (
        "orchard/api.py",
        """@route("/trees")
@cached
async def listing(limit: int) -> list[str]:
    def inner():
        pass
    return []


class Api:
    @staticmethod
    def ping(host: str) -> bool:
        return True

    @classmethod
    def build(cls, host: str):
        return cls()

    def _close(self) -> None:
        pass


def __hidden(a: int) -> int:
    return a


def _quiet(a: int) -> int:
    return a
""",
    ),
    # ------------------------------------------------------------ Java
    "java_plain": (
        "src/Depot.java",
        """package rail.yard;

public class Depot {
    private String name;
    int tracks, slots;

    public Depot merge(Depot other, int extra) {
        return other;
    }

    void close() {
    }
}
""",
    ),
    "java_interfaces": (
        "src/Signal.java",
        """package rail.yard;

public interface Signal {
    public boolean clear(int track);
    void reset();
}

class Lamp implements Signal {
    public boolean clear(int track) { return true; }
    public void reset() { }
    class Inner { void gone() { } }
}
""",
    ),
    "java_nullable": (
        "src/Find.java",
        """package rail.yard;

public class Find {
    public Optional<String> lookup(@Nullable String key, String other) {
        return null;
    }

    protected Integer plain(final int size) {
        return null;
    }
}
""",
    ),
    "java_generics": (
        "src/Box.java",
        """package rail.yard;

public class Box<T> {
    public Map<String, List<Integer>> sort(List<T> items, Map<String, List<T>> index) {
        return null;
    }

    public <K> K first(K[] all, String... names) {
        return null;
    }
}
""",
    ),
    "java_tests": (
        "src/DepotTest.java",
        """package rail.yard;

class DepotTest {
    @Test
    void merges() { }

    @ParameterizedTest
    public void closes(int n) { }

    void setUp() { }
}
""",
    ),
    "java_constructors": (
        "src/Engine.java",
        """package rail.yard;

public class Engine {
    private int power;

    public Engine(int power) {
        this.power = power;
    }

    Engine(Engine other) { }

    public static Engine of(int power) {
        return new Engine(power);
    }
}
""",
    ),
    # ------------------------------------------------------------ TypeScript
    "ts_plain": (
        "ui/chart.ts",
        """interface Point {
  x: number;
  label?: string;
}

export function draw(point: Point, scale: number): string {
  return "";
}

function erase(point: Point): void {
}
""",
    ),
    "ts_classes": (
        "ui/panel.ts",
        """export class Panel {
  constructor(private title: string) {
  }

  public open(width: number): boolean {
    return true;
  }

  private hide(): void {
  }

  resize(by: number): Panel {
    return this;
  }
}

class Ghost {
  public gone(): void {
  }
}
""",
    ),
    "ts_nullable": (
        "ui/maybe.ts",
        """export function pick(a: string | null, b?: number, c: string | undefined, d: string): number | null {
  return null;
}
""",
    ),
    "ts_arrows": (
        "ui/arrows.ts",
        """export const half = (n: number): number => n / 2;

const log = async (text: string): Promise<void> => {
  return;
};

let plain = function (n: number) { return n; };
""",
    ),
    "ts_tests": (
        "ui/chart.test.ts",
        """function sample(): number {
  return 1;
}

describe("chart", () => {
  it("draws", () => {
    sample();
  });
});
""",
    ),
    "ts_types": (
        "ui/types.ts",
        """type Theme = {
  name: string;
  dark: boolean;
};

export function paint(theme: Theme, extra: any): void {
}

export function load(table: Record<string, any>, ...rest: string[]): Map<string, Theme[]> {
  return new Map();
}
""",
    ),
}

EXPECTED = """
go_plain|rivers.Measure|function||13-15|true|application|full|g:Gauge{Site:string,Levels:[]float64,Last:*Reading?}; depth:float64|:Reading{At:int64}
go_plain|rivers.drain|function||17-18|false|application|full|g:*Gauge?{Site:string,Levels:[]float64,Last:*Reading?}|
go_nullable|rivers.Find|function||3-5|true|application|full|site:*string?; limit:int|multiple :~*Gauge?; :error?
go_nullable|rivers.check|function||7-9|false|application|full|site:string|:error?
go_methods|boats.Ferry.Load|method|*Ferry|8-10|true|application|full|tons:int|:bool
go_methods|boats.Ferry.label|method|Ferry|12-12|false|application|full||:string
go_tests|boats.TestLoad|function||3-3|true|test|full|t:*testing.T?|
go_tests|boats.BenchmarkLoad|function||5-5|true|test|full|b:*testing.B?|
go_tests|boats.ExampleFerry_Load|function||7-7|true|test|full||
go_tests|boats.newFerry|function||9-9|false|application|full||:~*Ferry?
go_results|mills.Split|function||3-5|true|application|full|total:int|multiple flour:int; bran:int; err:error?
go_results|mills.Stones|function||7-9|true|application|full||multiple :int; :[]string
go_results|mills.Stop|function||11-11|true|application|full||
go_edges|mills.init|function||3-3|false|application|full||
go_edges|mills.Sum|function||5-5|true|application|full|parts:...int*|:int
go_edges|mills.Wrap|function||7-9|true|application|full|any:interface{}; rates:~map[string]float64; pick:~func(int) bool|:~chan int
go_edges|mills.pair|function||11-14|false|application|full|a:int; _:string|
py_plain|plant|function||7-8|true|application|full|tree:Tree{kind:str,height:float}; count:int|:bool
py_plain|prune|function||11-12|true|application|full|tree:Tree{kind:str,height:float}|
py_inferred|pick|function||1-2|true|application|inferred|basket:; size:|
py_inferred|weigh|function||5-6|true|application|full|basket:list|:float
py_inferred|rest|function||9-10|true|application|full||
py_dataclass|ship|function||10-11|true|application|full|crate:Crate{label:str,fill:Optional[int]?}|:Crate{label:str,fill:Optional[int]?}
py_nullable|first|function||1-2|true|application|full|a:Optional[str]?; b:int | None?; c:Union[str, None]?; d:Union[str, int]|:None | str?
py_nullable|last|function||5-6|true|application|full|a:str|:Optional[int]?
py_tests|test_plant|function||1-2|true|test|full||
py_tests|helper|function||5-6|true|application|full||
py_tests|TestTree.test_height|method|TestTree|10-11|true|test|full||
py_decorators|listing|function||1-6|true|application|full|limit:int|:list[str]
py_decorators|Api.ping|method|Api|10-12|true|application|full|host:str|:bool
py_decorators|Api.build|method|Api|14-16|true|application|inferred|cls:; host:str|
py_decorators|Api._close|method|Api|18-19|false|application|full||
py_decorators|__hidden|function||22-23|true|application|full|a:int|:int
py_decorators|_quiet|function||26-27|false|application|full|a:int|:int
java_plain|rail.yard.Depot.merge|method|Depot|7-9|true|application|full|other:Depot{name:String,tracks:int,slots:int}; extra:int|:Depot{name:String,tracks:int,slots:int}
java_plain|rail.yard.Depot.close|method|Depot|11-12|false|application|full||
java_interfaces|rail.yard.Signal.clear|method|Signal|4-4|true|application|full|track:int|:boolean
java_interfaces|rail.yard.Signal.reset|method|Signal|5-5|false|application|full||
java_interfaces|rail.yard.Lamp.clear|method|Lamp|9-9|true|application|full|track:int|:boolean
java_interfaces|rail.yard.Lamp.reset|method|Lamp|10-10|true|application|full||
java_nullable|rail.yard.Find.lookup|method|Find|4-6|true|application|full|key:String?; other:String|:Optional<String>?
java_nullable|rail.yard.Find.plain|method|Find|8-10|false|application|full|size:int|:Integer
java_generics|rail.yard.Box.sort|method|Box|4-6|true|application|full|items:List<T>; index:Map<String, List<T>>|:Map<String, List<Integer>>
java_generics|rail.yard.Box.first|method|Box|8-10|true|application|full|all:K[]; names:String|:K
java_tests|rail.yard.DepotTest.merges|method|DepotTest|4-5|false|test|full||
java_tests|rail.yard.DepotTest.closes|method|DepotTest|7-8|true|test|full|n:int|
java_tests|rail.yard.DepotTest.setUp|method|DepotTest|10-10|false|application|full||
java_constructors|rail.yard.Engine.Engine|constructor|Engine|6-8|true|application|full|power:int|
java_constructors|rail.yard.Engine.Engine|constructor|Engine|10-10|false|application|full|other:Engine{power:int}|
java_constructors|rail.yard.Engine.of|method|Engine|12-14|true|application|full|power:int|:Engine{power:int}
ts_plain|draw|function||6-8|true|application|full|point:Point{x:number,label:string?}; scale:number|:string
ts_plain|erase|function||10-11|false|application|full|point:Point{x:number,label:string?}|
ts_classes|Panel.constructor|constructor|Panel|2-3|false|application|full|title:string|
ts_classes|Panel.open|method|Panel|5-7|true|application|full|width:number|:boolean
ts_classes|Panel.hide|method|Panel|9-10|false|application|full||
ts_classes|Panel.resize|method|Panel|12-14|false|application|full|by:number|:Panel
ts_nullable|pick|function||1-3|true|application|full|a:string | null?; b:number?; c:string | undefined?; d:string|:number | null?
ts_arrows|half|function||1-1|true|application|full|n:number|:number
ts_arrows|log|function||3-5|false|application|full|text:string|:Promise<void>
ts_tests|sample|function||1-3|false|test|full||:number
ts_types|paint|function||6-7|true|application|partial|theme:Theme{name:string,dark:boolean}; extra:any|
ts_types|load|function||9-11|true|application|full|table:Record<string, any>; :string[]|:Map<string, Theme[]>
"""

COLUMNS = ("case_name", "qualified_name", "kind", "receiver", "lines", "exported", "tag", "completeness", "parameters", "returns")


def expected(prefix: str) -> list[tuple[str, ...]]:
    rows = [tuple(c.strip() for c in line.split("|", 8)) for line in EXPECTED.strip().splitlines() if line.startswith(prefix)]
    # types of parameters may hold bars: the last one between blanks-free neighbours parts them from the returns
    return [(*r[:8], *map(str.strip, _parted(r[8]))) for r in rows]


def _parted(text: str) -> tuple[str, str]:
    at = max(i for i, c in enumerate(text) if c == "|" and text[max(0, i - 1) : i] != " " and text[i + 1 : i + 2] != " ")
    return text[:at], text[at + 1 :]


def _value(v: Column, variadic: bool) -> Column:
    kind = F.when(F.coalesce(v["type"], F.lit("")) != "", v["type"]).when(F.coalesce(v["type_expr"], F.lit("")) != "", F.concat(F.lit("~"), v["type_expr"])).otherwise("")
    fields = F.array_join(F.transform(v["expanded"], lambda f: F.concat(f["name"], F.lit(":"), f["type"], F.when(f["nullable"], "?").otherwise(""))), ",")
    return F.concat(
        F.coalesce(v["name"], F.lit("")), F.lit(":"), kind, F.when(v["nullable"], "?").otherwise(""), F.when(v["variadic"], "*").otherwise("") if variadic else F.lit(""),
        F.when(F.coalesce(F.size(v["expanded"]), F.lit(0)) > 0, F.concat(F.lit("{"), fields, F.lit("}"))).otherwise(""),
    )


def rendered(spark: SparkSession, prefix: str) -> DataFrame:
    """The records of the cases of a language, in the form of ``EXPECTED``."""
    language = {"go": "go", "py": "python", "java": "java", "ts": "typescript"}[prefix]
    rows = [(f"{case}/{path}", language, text) for case, (path, text) in CASES.items() if case.startswith(f"{prefix}_")]
    files = extract_files(spark.createDataFrame(rows, "path string, language string, content string"))
    r = files.select(F.substring_index("file", "/", 1).alias("case_name"), F.explode("records").alias("r"))
    bar = F.array_join(F.transform("r.returns.values", lambda v: _value(v, False)), "; ")
    return r.select(
        "case_name", "r.qualified_name", "r.kind", F.coalesce("r.receiver", F.lit("")).alias("receiver"), F.concat_ws("-", "r.start_line", "r.end_line").alias("lines"),
        F.col("r.exported").cast("string").alias("exported"), "r.tag", F.col("r.contract_completeness").alias("completeness"),
        F.array_join(F.transform("r.parameters", lambda p: _value(p, True)), "; ").alias("parameters"),
        F.trim(F.concat(F.when(F.col("r.returns.multiple"), "multiple ").otherwise(""), bar)).alias("returns"),
    )


def values_sql(rows: list[tuple], columns: tuple[str, ...]) -> str:
    quoted = lambda v: "null" if v is None else str(v) if isinstance(v, int) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({', '.join(columns)})"


def expected_sql(prefix: str) -> str:
    return values_sql(expected(f"{prefix}_"), COLUMNS)


# ---------------------------------------------------------------- calls, resolution, imports

#: one small project whose calls cross files and languages; every name that is called and defined gives an edge
PROJECT: dict[str, str] = {
    "net/cast.go": "package net\n\nfunc Cast(depth int) {\n\thaul(depth)\n\tfmt.Println(mend(depth, 2))\n}\n",
    "net/haul.go": "package net\n\nfunc haul(depth int) {}\n\nfunc mend(a int, b ...int) int { return trim(a) }\n",
    "net/cast_test.go": "package net\n\nfunc TestCast(t *testing.T) {\n\tCast(3)\n\tCast(4)\n}\n",
    "dock/crew.py": "from .rope import tie\n\n\ndef board(crew):\n    tie(crew)\n    return tie(crew, 2)\n",
    "dock/rope.py": "def tie(crew, knots=1):\n    return trim(crew)\n\n\ndef trim(rope: str):\n    return rope\n",
    "dock/Port.java": "package dock;\n\npublic class Port {\n    public void open(int gate) { warn(gate); }\n    void warn(int gate) { new Port().open(gate, 1); }\n}\n",
    "dock/sail.ts": "import { hoist } from './mast';\n\nexport function sail(wind: number): void {\n  hoist(wind);\n  sail(wind - 1);\n}\n",
    "dock/mast.ts": "export function hoist(wind: number): void {\n}\n",
}

CALLS = [
    ("dock/Port.java", 4, "warn", 1), ("dock/Port.java", 5, "open", 2), ("dock/crew.py", 5, "tie", 1), ("dock/crew.py", 6, "tie", 2), ("dock/rope.py", 2, "trim", 1), ("dock/sail.ts", 4, "hoist", 1), ("dock/sail.ts", 5, "sail", 1),
    ("net/cast.go", 4, "haul", 1), ("net/cast.go", 5, "Println", 1), ("net/cast.go", 5, "mend", 2), ("net/cast_test.go", 4, "Cast", 1), ("net/cast_test.go", 5, "Cast", 1), ("net/haul.go", 5, "trim", 1),
]
#: self calls are no edges; 'trim' of another language is the only function of its name, so Go's call reaches it
RESOLVED = [
    ("net/Cast", "net/haul"), ("net/Cast", "net/mend"), ("net/TestCast", "net/Cast"), ("net/mend", "dock/trim"), ("dock/board", "dock/tie"), ("dock/tie", "dock/trim"), ("dock/Port.open", "dock/Port.warn"), ("dock/Port.warn", "dock/Port.open"),
    ("dock/sail", "dock/hoist"),
]
IMPORTED = [("dock/board", "dock/tie"), ("dock/board", "dock/trim"), ("dock/sail", "dock/hoist")]
BROKEN = [("dock/Port.warn", "open", 2)]


def project(spark: SparkSession) -> DataFrame:
    language = {"go": "go", "py": "python", "java": "java", "ts": "typescript"}
    rows = [(path, language[path.rsplit(".", 1)[1]], text) for path, text in PROJECT.items()]
    return extract_files(spark.createDataFrame(rows, "path string, language string, content string"))


# ---------------------------------------------------------------- a small graph and the answers about it

#: id, name, module, exported, test
NODES = [
    (1, "openShop", "front", False, None), (2, "bakeLoaf", "oven", True, None), (3, "mixDough", "oven", False, None), (4, "weighFlour", "store", True, None), (5, "checkBakeLoaf", "oven", True, True),
    (6, "sellLoaf", "front", True, None),
]
EDGES = [(1, 6), (6, 2), (2, 3), (3, 4), (2, 4), (5, 2), (5, 4)]

#: tool, arguments -> what its answer holds, in the order of pages (file, start line, qualified name)
ANSWERS = [
    ("callers", {"function": "bakeLoaf"}, "2/2: sellLoaf, checkBakeLoaf"), ("callers", {"function": "bakeLoaf", "limit": 1}, "1/2: sellLoaf; more at 1"), ("callers", {"function": "nobody"}, 'function "nobody" not found'),
    ("breaks", {"function": "mixDough"}, "1/1: bakeLoaf"), ("contract", {"function": "oven/mixDough"}, "oven/mixDough oven/a.go:30-35"), ("impact", {"function": "mixDough"}, "4/4: openShop, sellLoaf, bakeLoaf, checkBakeLoaf"),
    ("impact", {"function": "mixDough", "depth": 1}, "1/1: bakeLoaf"), ("impact", {"function": "nobody"}, "0/0:"), ("entry_points", {}, "2/2: openShop, checkBakeLoaf"), ("exports", {"module": "oven"}, "1/1: bakeLoaf"),
    ("domains", {}, "3/3: oven 3, front 2, store 1"), ("domain", {"module": "oven"}, "3/3: bakeLoaf, mixDough, checkBakeLoaf; inside oven/bakeLoaf > oven/mixDough, oven/checkBakeLoaf > oven/bakeLoaf"),
    ("domain", {"module": "oven", "offset": 99}, "0/3:; inside oven/bakeLoaf > oven/mixDough, oven/checkBakeLoaf > oven/bakeLoaf"), ("coupling", {}, "2/2: oven > store 3, front > oven 1"), ("untested", {}, "3/3: openShop, sellLoaf, mixDough"),
    ("untested", {"limit": 0, "offset": -3}, "3/3: openShop, sellLoaf, mixDough"), ("test_coverage", {"function": "weighFlour"}, "1/1: checkBakeLoaf"), ("graph_summary", {}, "6 functions, 7 edges, 3 untested, 40.0 %: oven, front, store"),
    ("subgraph", {"function": "bakeLoaf", "hops": 1}, "bakeLoaf; callers sellLoaf, checkBakeLoaf; impact sellLoaf, checkBakeLoaf; callees mixDough, weighFlour"), ("nothing", {}, "unknown tool: nothing"),
]


def graph(spark: SparkSession):
    from graphloom.graph import CodeGraph

    rows = [(i, name, f"{m}/{name}", f"{m}/a.go", m, e, t, i * 10, i * 10 + 5) for i, name, m, e, t in NODES]
    nodes = spark.createDataFrame(rows, "node_id bigint, name string, qualified_name string, file string, module string, exported boolean, is_test boolean, start_line int, end_line int")
    return CodeGraph.with_defaults(nodes, spark.createDataFrame([(a, b, "CALLS") for a, b in EDGES], "src bigint, dst bigint, label string"))


def told(answer: object) -> str:
    """A tool's answer in the form of ``ANSWERS``."""
    named = lambda items: ", ".join(i["Name"] for i in items)
    if isinstance(answer, str):
        return answer
    if "center" in answer:
        return f"{answer['center']['Name']}; callers {named(answer['callers'])}; impact {named(answer['callees'])}; callees {named(answer['true_callees'])}"
    if "modules" in answer:
        return f"{answer['total_functions']} functions, {answer['total_edges']} edges, {answer['untested_count']} untested, {answer['coverage_pct']} %: " + ", ".join(m["Module"] for m in answer["modules"])
    if "items" not in answer:
        return f"{answer['QualifiedName']} {answer['File']}:{answer['StartLine']}-{answer['EndLine']}"
    show = lambda i: f"{i['FromModule']} > {i['ToModule']} {i['EdgeCount']}" if "FromModule" in i else f"{i['Module']} {i['Functions']}" if "Functions" in i else i["Name"]
    out = f"{answer['returned']}/{answer['total_count']}: " + ", ".join(map(show, answer["items"]))
    if answer["truncated"]:
        out += f"; more at {answer['hint'].split('offset=')[1].split()[0]}"
    if "internal_edges" in answer:
        out = out.strip() + "; inside " + ", ".join(f"{e['From']} > {e['To']}" for e in answer["internal_edges"])
    return out.strip()


def asked(spark: SparkSession) -> DataFrame:
    """Every request of ``ANSWERS`` put to the line service, one JSON object a line."""
    import io
    import json

    from graphloom.service import rpc
    from graphloom.service.tools import Tools

    lines = [json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": args}}) for i, (name, args, _) in enumerate(ANSWERS)]
    sink = io.StringIO()
    rpc.serve(Tools(graph(spark)), io.StringIO("\n".join(lines)), sink)
    rows = []
    for line in sink.getvalue().splitlines():
        response = json.loads(line)
        text = response["result"]["content"][0]["text"]
        rows.append((response["id"], ANSWERS[response["id"]][0], told(text.removeprefix("Error: ") if text.startswith("Error: ") else json.loads(text))))
    return spark.createDataFrame(rows, "request bigint, tool string, answer string")


# ---------------------------------------------------------------- a build of the project, from files to answers

#: files beside ``PROJECT`` that a build has to leave out or count
BESIDE = {"tools/knot.rb": "puts 1\n", "vendor/lib/far.go": "package lib\n\nfunc Far() {}\n", "dock/made.gen.py": "def made(): pass\n", "Makefile": "all:\n", ".gitignore": "# made\n*.gen.py\n\n"}

#: what a build and the command line say about it
BUILT = [
    ("functions", "11"), ("files", "8"), ("edges", "9"), ("errors", "0"), ("languages", "go java typescript python"), ("coverage", "full 9, inferred 2"), ("skipped", ".gitignore 1, .rb 1"), ("stored functions", "11"), ("stored edges", "9"),
    ("nodes with the graph's own", "12"), ("recorded", "11 functions in 8 files: go java python typescript"), ("config", "version 1: go java typescript python; vendor node_modules .git __pycache__ dist build"), ("scope net", "4 functions in 3 files"), ("only python", "3 functions in 2 files"), ("rebuilt", "11 functions, 9 edges"),
    ("query callers tie", "dock/board | dock/crew.py:4-6  [inferred]"), ("query domains", "dock 7 functions | net 4 functions"), ("query coupling", "net -> dock  (1 edges)"), ("query exports nowhere", "No results."), ("query contract trim", "dock/trim | dock/rope.py:5-6 | Completeness: full"),
    ("query mismatches", "dock/Port.warn | dock/Port.java:5  open takes 1 to 1, given 2"), ("pattern", '{"a.name": "TestCast"}'), ("parse", "sail hoist: 3-6"), ("data shape of trim", "rope: str"),
]


def built(spark: SparkSession) -> DataFrame:
    """A build of the project in the shared folder, its stored tables, and the command line over them."""
    import contextlib
    import io
    import json
    import os
    import shutil
    import uuid

    from graphloom import config
    from graphloom.graph import CodeGraph
    from graphloom.plans.build import Options, build
    from graphloom.service import cli
    from graphloom.storage import shared_dir

    root = f"{shared_dir(spark).removeprefix('file://')}/graphloom/project-{uuid.uuid4().hex}"
    for path, text in (PROJECT | BESIDE).items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w", encoding="utf-8") as f:
            f.write(text)

    def said(*args: str) -> str:
        out = io.StringIO()
        cli.main(["--root", root, *args], spark, out)
        lines = [" ".join(x.split()) if args[-1] == "domains" else x.strip() for x in out.getvalue().splitlines()]
        return " | ".join(x for x in lines if not x.startswith("Contract:"))

    try:
        graph, r = build(spark, Options(root))
        meta, made = graph.meta.first(), config.load(root)
        names = graph.functions.where("name = 'trim'").select(F.col("node_id").alias("dst"))
        shape = graph.edges.join(names, "dst").first().data_shape
        rows = [
            ("functions", r.function_count), ("files", r.file_count), ("edges", r.edge_count), ("errors", r.errors), ("languages", " ".join(r.languages)), ("coverage", ", ".join(f"{k} {n}" for k, n in sorted(r.coverage.items()))),
            ("skipped", ", ".join(f"{k} {n}" for k, n in sorted(r.skipped.items()))), ("stored functions", graph.functions.count()), ("stored edges", graph.edge_count()), ("nodes with the graph's own", graph.node_count()),
            ("recorded", f"{meta.function_count} functions in {meta.file_count} files: {' '.join(meta.languages)}"), ("config", f"version {made.version}: {' '.join(made.languages)}; {' '.join(made.exclude)}"),
            ("query callers tie", said("query", "callers", "tie")), ("query domains", said("query", "domains")), ("query coupling", said("query", "coupling")), ("query exports nowhere", said("query", "exports", "nowhere")), ("query contract trim", said("query", "contract", "trim")),
            ("query mismatches", said("query", "mismatches")), ("pattern", said("pattern", "MATCH (a)-[:CALLS]->(b {name: 'Cast'}) RETURN a.name")), ("data shape of trim", ", ".join(f"{k}: {v}" for k, v in shape.items())),
        ]
        parsed = io.StringIO()
        with contextlib.redirect_stderr(io.StringIO()):
            cli.main(["--root", root, "parse", f"{root}/dock/sail.ts"], spark, parsed)
        records = json.loads(parsed.getvalue())
        rows.append(("parse", f"{records[0]['name']} hoist: {records[0]['start_line']}-{records[0]['end_line']}"))
        _, few = build(spark, Options(root, scope="net", out=f"{root}/net_only"))
        rows.append(("scope net", f"{few.function_count} functions in {few.file_count} files"))
        config.write(root, config.Config(languages=["python"]))
        _, few = build(spark, Options(root, out=f"{root}/python_only", configured_languages=True))
        rows.append(("only python", f"{few.function_count} functions in {few.file_count} files"))
        _, again = build(spark, Options(root))
        rows.append(("rebuilt", f"{CodeGraph.load(spark, again.graph_path).functions.count()} functions, {again.edge_count} edges"))
        return spark.createDataFrame([(k, str(v)) for k, v in rows], "what string, value string")
    finally:
        shutil.rmtree(root, ignore_errors=True)
