import random

import pytest

from graphloom.llm import leakage
from graphloom.llm.leakage import characters, holds_run, in_order, leak_report, leaked_items, words
from graphloom.llm.queries import p7_found

ITEM = "On the following morning the map engraver loads 921 chalk markers and 304 pear crates while two apprentices fall ill near the old mill"
CJK = "翌朝塩の商人は春の洪水が下の門に届く間に七十八枚の杉板と四百十袋の大麦を並べます"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def brute_run(item, post, run=12):
    grams = {tuple(item[i : i + run]) for i in range(len(item) - run + 1)}
    return any(tuple(post[i : i + run]) in grams for i in range(len(post) - run + 1))


def brute_ordered(item, post):
    n = len(item)
    width = int(n * 1.5) + 1
    return any(lcs(item, post[i : i + width]) * 4 >= 3 * n for i in range(max(1, len(post))))


def cases(seed, scattered):
    """Items and posts that hold parts of them, some scattered over the post."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    for _ in range(150):
        item = [rng.choice(vocabulary) for _ in range(rng.randint(4, 30))]
        post = [rng.choice(vocabulary + ["zz"] * 30) for _ in range(rng.randint(0, 60))]
        part = [w for w in item if rng.random() > rng.choice([0, 0.2, 0.3])][rng.randint(0, 3) :]
        at = rng.randint(0, len(post))
        for w in reversed(part):
            post[at:at] = [w] + ([rng.choice(vocabulary + ["zz"] * 100) for _ in range(rng.choice([0, 0, 1, 6]))] if scattered else [])
        yield item, post


def test_exact_checks_against_brute_force():
    for seed, slack in ((5, 1.5), (6, None)):
        hits = 0
        for item, post in cases(seed, slack is None):
            run = brute_run(item, post)
            ordered = brute_ordered(item, post) if slack else lcs(item, post) * 4 >= 3 * len(item)
            assert holds_run(item, post, 12) == run and in_order(item, post, slack) == ordered
            hits += run or ordered
        assert 20 < hits < 140


@pytest.mark.parametrize("slack", [1.5, None])
def test_join_against_brute_force(spark, slack, monkeypatch):
    """All items with all posts, and a key table so full that it lets nearly everything through gives the same."""
    made = list(cases(8, slack is None))
    items, posts = [m[0] for m in made], [m[1] for m in made]
    want = {(j, i) for i, item in enumerate(items) for j, post in enumerate(posts) if brute_run(item, post) or (brute_ordered(item, post) if slack else lcs(item, post) * 4 >= 3 * len(item))}
    d = spark.createDataFrame([(j, " ".join(p)) for j, p in enumerate(posts)], "doc_id bigint, text string")
    i = spark.createDataFrame([(i, "en", " ".join(t)) for i, t in enumerate(items)], "item_id bigint, lang string, text string")
    assert {tuple(r) for r in leaked_items(d, i, slack=slack).collect()} == want and len(want) > 50
    monkeypatch.setattr(leakage, "MOST_BITS", 1 << 12)
    assert {tuple(r) for r in leaked_items(d, i, slack=slack).collect()} == want


def test_the_work_has_the_same_steps_however_many_items(spark, monkeypatch):
    w, steps, write = ITEM.split(), [], leakage.materialize
    monkeypatch.setattr(leakage, "materialize", lambda df, label, **k: steps.append(label) or write(df, label, **k))
    docs = spark.createDataFrame([(k, " ".join(w[k % 9 : k % 9 + 13]) + f" word{k}") for k in range(40)], "doc_id bigint, text string")
    for n in (1, 30):
        items = spark.createDataFrame([(i, "en", ITEM + f" tail{i}" * 3) for i in range(n)], "item_id bigint, lang string, text string")
        assert leaked_items(docs, items).count() == 40 * n
    assert steps[: len(steps) // 2] == steps[len(steps) // 2 :] and steps.count("held") == 2


def test_query_takes_the_whole_post(spark, tmp_path):
    w = ITEM.split()
    pieces = ["\n> " + " ".join(w[i : i + 6]) + "\n\nAn answer of quite a few more words stands below each quoted piece here.\n" for i in range(0, len(w), 6)]
    docs = [(1, "".join(pieces)), (2, "".join(reversed(pieces))), (3, "".join(pieces[:2]))]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "en", ITEM)], "item_id bigint, lang string, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    assert [tuple(r) for r in p7_found(spark, str(tmp_path)).collect()] == [(1, 1)]


def test_tokens():
    assert words("a <" + "b " * 400 + "> c") == ["a", "c"]  # markup of any length
    assert words("The <b>miller's</b> cart_ &amp; [x](https://a.b/c) Straße") == ["the", "miller", "s", "cart", "x", "strasse"]
    assert characters("翌朝、 塩") == list("翌朝塩")


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id bigint, text string, item_id int, id string")
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id bigint, lang string, text string, doc_id string")
    out = leaked_items(d, i).collect()
    assert len(out) == len(set(out))
    return {(r.doc_id, r.item_id) for r in out}, d, i


def test_posts(spark):
    w = ITEM.split()
    quote = "\n> ".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5))
    docs = [
        (1, "Before. " + ITEM.upper() + " after"), (2, "> " + quote), (3, " ".join(w[3:15])), (4, " ".join(w[3:14]) + " other words follow here"), (5, " ".join(x for i, x in enumerate(w) if i % 5)),
        (6, " ".join(reversed(w))), (7, None), (8, ""), (9, "# " + " ".join(w[:6]) + "\n# " + " ".join(w[6:14])), (10, "前書き。" + CJK[5:26] + "。"), (11, CJK[5:24]), (12, "x " * 50_000 + ITEM),
        (1, "Before. " + ITEM.upper() + " after"), (13, " filler ".join(" ".join(w[i : i + 2]) + " a b c d e f g" for i in range(0, len(w), 2))),
    ]
    items = [(1, "en", ITEM), (2, "ja", CJK), (3, None, None), (4, "en", ""), (5, None, "short item"), (None, "en", ITEM)]
    got, d, i = run(spark, docs, items)
    assert got == {(k, 1) for k in (1, 2, 3, 5, 9, 12)} | {(10, 2)}
    report = {r.item_id: r.n_posts for r in leak_report(leaked_items(d, i), i).where("item_id is not null").collect()}
    assert report == {1: 6, 2: 1, 3: 0, 4: 0, 5: 0}


def test_empty(spark):
    assert run(spark, [], [(1, "en", ITEM)])[0] == set()
    assert run(spark, [(1, ITEM)], [])[0] == set()
