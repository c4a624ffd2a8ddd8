"""Own source fixtures: a small project in the four languages."""

from __future__ import annotations

GO = '''package shop

import "fmt"

// Basket holds what a buyer picked.
type Basket struct {
	Owner, Note string
	Lines       []Line `json:"lines"`
	Parent      *Basket
	fmt.Stringer
}

type (
	Line struct { Sku string; Count int }
	Sum  int
)

func Checkout(b Basket, limit *int, tags ...string) (total float64, err error) {
	total = addUp(b.Lines)
	fmt.Println(total, describe(
		b))
	return total, nil
}

func addUp(lines []Line) float64 { return 0 }

func (b *Basket) Describe(w interface{}, conv map[string]int) error {
	helper := func() { addUp(nil) }
	helper()
	return b.check()
}

func (b Basket) check() error { return nil }

func pair(int, string) (Sum, *Line) {
	return 0, nil
}
'''

GO_TEST = '''package shop

func TestCheckout(t *testing.T) {
	Checkout(Basket{}, nil)
}

func prepare() {}
'''

PYTHON = '''import os


class Request:
    """A request."""
    ident: int
    note: Optional[str] = None

    def load(self, path: str, *, deep: bool = False) -> "Request":
        return open_all(path)

    @classmethod
    def make(cls, raw: Request):
        return cls(raw)


@dataclass
class Hidden:
    size: int

    def lost(self) -> int:
        return self.size


@route("/x")
@cached
async def handle(request: Request, hidden: Hidden | None, *args, **kw) -> None:
    def inner():
        pass
    if request:
        open_all(request.note,
                 inner())


def open_all(path, mode="r", *rest: str) -> Union[str, None]:
    return path


def _private(): return 1
def __dunder__(): return _private()
'''

PYTHON_TEST = '''def test_open():
    assert open_all("x")


def helper():
    return 1
'''

JAVA = '''package com.shop.core;

import java.util.List;

@Component
public class Store<T> extends Base implements Closer {
    private final String name, alias = "x";
    int[] sizes;

    static { boot(); }

    public Store(String name, @Nullable Store parent) {
        this.name = check(name);
    }

    @Override
    public Optional<List<T>> find(final String key, int... sizes) throws IOException {
        return Optional.of(index.lookup(key, new Probe(1).run()));
    }

    java.util.List<String> all() { return null; }

    protected <K> Store copy(Map<String, List<K>> by) { return this; }

    @Test
    void works() { find("x"); }

    class Inner { void no() {} }
}

interface Closer {
    void close();
    default Result stop(Store s) { return s.copy(null); }
}

enum Kind { A; void nope() {} }
'''

TYPESCRIPT = '''import { x } from "./x";

interface Order { id: string; note?: string; tags: Map<string, number[]>; }
type Box = { size: number; of: Order | null };
export interface Outside { a: string }

export async function place(order: Order, box?: Box, ...rest: string[]): Promise<Order> {
  const local = (q: number) => q;
  return api.client.send(order).then(done);
}

function plain(input: any): void {}

export const twice = (n: number): number => n * 2;
const once = async (box: Box | undefined) => {
  plain(box);
}, other = function () { return 1 };
let short = v => twice(v);

export class Desk {
  private cache = new Map<string, Order>();
  constructor(private readonly order: Order) { super(order); }
  public static async open({ a, b }: Box, kind = "x"): Promise<void> { await place(a); }
  close(): Order | undefined { return this.cache.get("x") }
}

class Inside { never(): void {} }
'''

FILES = {
    "shop/basket.go": GO, "shop/basket_test.go": GO_TEST, "app/service.py": PYTHON, "app/test_service.py": PYTHON_TEST, "java/Store.java": JAVA, "web/desk.ts": TYPESCRIPT, "web/desk.test.ts": "function setup() { plain(1) }\n",
    "vendor/lib/a.go": GO, "builder/b.go": GO, "tools/x.rb": "puts 1\n", "Makefile": "all:\n", "app/skip.gen.py": "def gone(): pass\n", "ignored/c.py": "def gone(): pass\n", "root.py": "def top(): pass\n",
}
GITIGNORE = "# comment\n\nignored/\n*.gen.py\n"


def write_project(root) -> None:
    for path, text in FILES.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    (root / ".gitignore").write_text(GITIGNORE)
