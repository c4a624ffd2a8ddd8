import random

import pytest
from graphloom.llm import sentences
from graphloom.llm.sentences import VOCABULARY, Lattice, lattice_of, segment

CASES = {
    "abbreviations": ("Dr. Oakes of Hill Inc. said so, e.g. on p. 12. It costs 3.50 approx. as in fig. 2. Done.", 3),
    "initials": ("J. R. Stone wrote it. We read vers. 2.10.3. Fine.", 3),
    "number word": ("Should I? No. It is No. 7 on the list.", 3),
    "meridiem": ("It runs at 3 p.m. and stops. The U.S. mirror works, etc. and more.", 2),
    "quotes inside": ('She said "Stop it. Now!" and left. He wrote "It works." Then he left.', 3),
    "single quotes": ("It printed 'Done. Exiting.' and then hung. Odd.", 2),
    "brackets": ("My note (in a hurry. sorry!) says so. (It was late.) We went on.", 3),
    "ellipsis": ("It waits ... and waits. It stops… Then it starts. … and so on it goes", 4),
    "no space": ("It works!!Then it fails. Why?It is odd.", 4),
    "lower case": ("why does it fail? it works here! the end. all good", 4),
    "no capitals": ("it waits... then fails... the end. \"stop it. now!\" and left. \"it helps.\" we go on ... or not", 5),
    "no capitals, initials": ("m. roux et mme petit lisent. j. r. stone of hill inc. left. am 2. märz auch.", 3),
    "smiley": ("It works. :-) Next one 😀\nis here. Last :)", 3),
    "link": ("See https://a.example/x.y?z=1.5 for it. Next.\n\nhttps://b.example/q", 3),
    "file names": ("Open conf.yaml and node.js. Then main.go! Use `a.b(). C` now.", 3),
    "german": ("Am 2. März war es z. B. kalt, d. h. nass usw. und in der 3. Version nicht. Er rief „Halt! Nein!“ und ging. Gut.", 3),
    "french": ("M. Roux répond « C'est réglé dans la 7.1. » Voir p. ex. l'art. 8 ! Et ?", 3),
    "spanish": ("El Sr. Paz y la Dra. Ruiz, p. ej. en la pág. 3, etc. con más. ¿Qué? ¡No!", 3),
    "russian": ("В 2019 г. модуль, т. е. он и т. д. работал. Её спросили: «Ты пробовал?» и закрыли. А. Б. Иванов.", 3),
    "hindi": ("डॉ. शिव कहते हैं। उसने लिखा, \"क्या चलाया?\" और बंद किया। रु. 12 में है. ठीक", 4),
    "arabic": ("د. سالم يقول ذلك. كتبت: «هل جربت؟» ثم أغلقت. لماذا؟", 3),
    "chinese": ("他说“好。别再等。”，然后走了。结论是：“没问题。”第二个（例如a.py！）也好!升级到1.2以后……好了\n下一行", 5),
    "japanese": ("彼は「直る。」と言いました。3.2では……動きます。本当ですか！？「試した？」と聞かれた", 4),
    "thai": ("ผมคิดว่าดี แคชลืมบ่อยๆ ใช้เวลา9.5วินาที", 3),
    "wrapped": ("One line\nthat goes on. Two\r\nlines here.", 2),
    "lists": ("Intro:\n- one. two\n- three\n1. four\n3. five\n> six\n> seven", 7 + 1),
    "wrapped number": ("Es war in der\n3. Version davon. Ja.", 2),
    "code": ("A.\n\n```py\nx = 1. y\n\nz\n```\n    a. b\n    c\n\n    d\n\nEnd", 5),
    "unclosed fence": ("A.\n```\nx. y\n\nz.", 2),
}


@pytest.mark.parametrize("name", CASES)
def test_number_of_sentences(name):
    text, n = CASES[name]
    found = [text[a:b] for a, b in segment(text)]
    assert len(found) == n, found


@pytest.mark.parametrize(
    "text, n",
    [("他想了想……然后走了。好", 2), ("按下按钮……就停了。", 1), ("再试一次……便好了", 1), ("設定を変える……と直ります。", 1), ("動きます……が遅いです。", 1), ("动了……我们走。", 2), ("動きます……はい、直りました。", 2), ("動きます……もう直りました。", 2), ("画面……は動きます。", 1)],
)
def test_words_around_an_ellipsis(text, n):
    found = [text[a:b] for a, b in segment(text)]
    assert len(found) == n, found


def test_ranges():
    text = "  He left. \n\n\"She stayed.\" - item"
    assert [text[a:b] for a, b in segment(text)] == ["He left.", "\"She stayed.\" - item"]


@pytest.mark.parametrize("seed", range(40))
def test_cover_everything_without_overlap(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "B", ".", "!", "?", "…", " ", "\n", "\n\n", "\r\n", "“", "”", "\"", "'", "(", ")", "- ", "> ", "1. ", "```", "    ", "中", "。", "ค", "は", ":)", "`", "https://x.y ", "😀", "\t"]) for _ in range(rng.randint(0, 300)))
    last, covered = 0, set()
    for a, b in segment(text):
        assert last <= a < b and not text[a].isspace() and not text[b - 1].isspace()
        last = b
        covered |= set(range(a, b))
    assert all(i in covered or c.isspace() for i, c in enumerate(text))


def test_long_text_in_linear_time():
    text = "word " * 200_000 + ". " + "“" * 2000 + "x. y! " * 20_000
    assert len(segment(text)) > 1


def test_lattice_prefers_known_words():
    assert Lattice().words("动了以后") == ["动", "了", "以后"]
    assert "".join(Lattice().words("ですから終わり")) == "ですから終わり" and Lattice().words("") == []


def test_table(spark):
    rows = [(1, "A b. C d."), (2, None), (3, ""), (4, " \n "), (None, "X."), (1, "A b. C d.")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id bigint, text string, start_pos int, id int")
    out = sorted((r.doc_id is None, r.doc_id, r.start_pos, r.end_pos) for r in sentences.sentences(df).collect())
    assert out == [(False, 1, 0, 4), (False, 1, 0, 4), (False, 1, 5, 9), (False, 1, 5, 9), (True, None, 0, 2)]
    assert sentences.sentences(df.limit(0)).count() == 0


def cut(text, words=None):
    return [text[a:b] for a, b in (segment(text, words) if words else segment(text))]


@pytest.mark.parametrize("text", ["这样可以吗……然后重启。", "直ります……それで再起動します。", "ได้ครับ… แต่ช้ามาก"])
def test_final_particles_decide(text, monkeypatch):
    words = lattice_of(VOCABULARY)
    assert len(cut(text, words)) == 2
    monkeypatch.setattr(sentences, "FINAL", frozenset())
    monkeypatch.setattr(sentences, "CLOSING", frozenset())
    assert cut(text, words) == [text]


@pytest.mark.parametrize("text", ["先放在这里……重启。", "試した所……もう一度やる。"])
def test_the_dictionary_decides(text):
    assert len(cut(text, lattice_of(VOCABULARY))) == 2 and cut(text) == [text]


def test_words_that_lead_on():
    words = lattice_of(VOCABULARY)
    for text in ("我试了一下……然后重启。", "これは……動かない。", "試して……それで直した。", "ช้า… แต่ดีมาก", "ช้าและ… ดีมาก"):
        assert cut(text, words) == [text]
    assert cut("ช้า… ดีมาก", words) == ["ช้า…", "ดีมาก"]
    assert "我在" not in words.cost and words.words("现在这里") == ["现在", "这里"]


def test_looks_reach_to_the_bounds_of_the_unit():
    assert cut("请看" + "=" * 90 + "\n" + "-" * 90 + "重启") == ["请看" + "=" * 90, "-" * 90 + "重启"]
    wide = "one " + "= " * 60 + "\n" + "= " * 60 + "two"
    assert cut(wide) == [wide]
    assert cut("Es begann am" + " " * 40 + "3. Tag der Woche und endete.") == ["Es begann am" + " " * 40 + "3. Tag der Woche und endete."]


def test_a_missing_vocabulary_leaves_closed_class_words(spark):
    df = spark.createDataFrame([(1, "先放在这里……重启。")], "doc_id bigint, text string")
    with pytest.warns(UserWarning, match="no vocabulary"):
        few = sentences.sentences(df, vocabulary="/nowhere/words.tiktoken")
    assert few.count() == 1 and sentences.sentences(df).count() == 2
