"""Text functions, layouts and metrics on stated values."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veridelta.functions import align, layout, metrics, text


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first().x


L = F.lit


def texts(*xs):
    return F.array(*map(L, xs))


def test_normal_forms(value):
    assert value(text.articles_first(L("the-cat, an  Owl"))) == "cat owl"
    assert value(text.punctuation_first(L("the-cat, an  Owl"))) == "thecat owl"


@pytest.mark.parametrize("n, want", [(0, 0), (1, 1), (256, 1), (257, 2), (480, 2), (481, 3)])
def test_chunks(value, n, want):
    found = value(text.chunks(L(" ".join(f"w{i}" for i in range(n)))))
    assert len(found) == want
    assert not found or found[-1].split()[-1] == f"w{n - 1}"


def test_tokens_and_numbers(value):
    assert value(text.tokens(L("It's state-of-the-art -- É2b"))) == ["it's", "state-of-the-art", "2b"]
    assert value(text.numbers(L("up 50% to 42.5, not -3"))) == [0.5, 42.5, -3.0]
    assert value(text.tokens(L(None).cast("string"))) == []


def test_claims(value):
    assert value(text.claims(L('{"claims": [" a b ", "", "c"]}'))) == ["a b", "c"]
    assert value(text.claims(L("A sentence that is long. Short. Another long sentence!"))) == [
        "A sentence that is long",
        "Another long sentence",
    ]
    assert value(text.claims(L(""))) == []
    assert value(text.claims(L('{"claims": []}'))) == [] and value(text.claims(L('say ["a", " b "] now'))) == ["a", "b"]
    # an item that is no string: not taken as it is
    assert value(text.claims(L('{"claims": ["a", 3]}'))) == ["a", "3"]
    assert value(text.claims(L('{"claims": "a claim that is a long string"}'))) == ['{"claims": "a claim that is a long string"}']
    assert value(text.standalone_claims(L("short"), L("its text"))) == ["its text"]
    assert value(text.standalone_claims(L('{"claims": ["a"]}'), L("  "))) == []


@pytest.mark.parametrize("token, want", [("River", True), (" the", False), ("x", False), ("?!", False), ("42", True), ("", False), ("\n", False)])
def test_key_tokens(value, token, want):
    assert value(text.is_key_token(L(token))) == want


@pytest.mark.parametrize("token, want", [("▁Owl", " Owl"), ("ĠOwl", " Owl"), ("aĊ", "a\n"), ("</s>", ""), ("<|end|>", ""), ("[INST]", ""), ("<b>", "<b>")])
def test_display_form(value, token, want):
    assert value(text.display_decoded(L(token))) == want


@pytest.mark.parametrize(
    "said, pieces, want, kept",
    [
        ("It rains. It pours.", ["It", " rains", ". It", " pours", "."], "It rains.", ["It", " rains", "."]),
        ("It rains.", ["It", " rains."], "It rains.", ["It", " rains."]),
        ('He said "no." Then', ['He said "', 'no."', " Then"], 'He said "no."', ['He said "', 'no."']),
        ("3.5 is a number", ["3.5", " is a number"], "3.5 is a number", ["3.5", " is a number"]),
        ("no end", ["no", " end"], "no end", ["no", " end"]),
        ("", [], "", []),
    ],
)
def test_first_sentence(value, said, pieces, want, kept):
    own = F.array(*map(L, pieces)).cast("array<string>")
    assert value(text.first_sentence(L(said))) == want and value(text.first_sentence_pieces(L(said), own)) == kept


def test_alignment_by_text(spark):
    cases = [
        ("a bc", [" a", " b", "c "], (["a", " b", "c"], True)),
        ("", [], ([], True)),
        ("x", [], ([], False)),
        ("x", ["", ""], (["", "x"], False)),
        ("owls hunt", ["ow", "lz", "hunt!"], (["ow", "ls", " hunt"], False)),
        ("é🙂", ["\u3000é", "🙂\x1c\n"], (["é", "🙂"], True)),
        ("", ["\n", " \xa0"], (["", ""], True)),
        ("abcde", ["xx", "yy"], (["ab", "cde"], False)),
        (None, None, ([], True)),
    ]
    rows = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(cases)], "k int, x string, p array<string>")
    got = rows.select("k", align.aligned_to_text(F.col("x"), F.col("p")).alias("a")).orderBy("k").collect()
    assert [(list(r.a.pieces), r.a.exact) for r in got] == [c[2] for c in cases]


def test_alignment_by_bytes(spark):
    raw = "né 🙂".encode()
    whole = ["<s>", *["t"] * len(raw), "</s>"]
    cases = [
        ("né 🙂", whole, [None, *[[b] for b in raw], None], (["", "n", "", "é", " ", "", "", "", "🙂", ""], True)),
        ("x", ["t"], [None], ([""], False)),
        ("x", ["t"], [[121]], ([""], False)),
        ("x", ["t", "t"], [[120]], (["", ""], False)),
        ("né", ["t", "t", "t"], [[32, 10, 110], [195], [169, 9]], (["n", "", "é"], True)),
        ("éa", ["t", "t", "t"], [[195], [], [169, 97]], (["", "", "éa"], True)),
        (None, None, None, ([], True)),
        ("", ["<|x|>", "t"], [None, [32]], (["", ""], True)),
    ]
    schema = "k int, x string, t array<string>, v array<array<int>>"
    rows = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], schema)
    found = rows.select("k", align.aligned_to_bytes(F.col("x"), F.col("t"), F.col("v")).alias("a")).orderBy("k")
    assert [(list(r.a.pieces), r.a.exact) for r in found.collect()] == [c[3] for c in cases]
    assert "Python" not in found._jdf.queryExecution().toString()


def test_no_byte_passes_for_another(spark):
    # numbers that aren't bytes, a byte that no UTF-8 has, a null among bytes, and the white space of a character's second byte
    cases = [("\x10", [[256]]), ("\xff", [[-1]]), ("\xff", [[255]]), ("a", [[97, None]]), ("\xe0", [[0xC3, 0xA0]]), (" a", [[32, 97]])]
    rows = spark.createDataFrame([(k, x, ["t"], v) for k, (x, v) in enumerate(cases)], "k int, x string, t array<string>, v array<array<int>>")
    got = rows.select("k", align.aligned_to_bytes(F.col("x"), F.col("t"), F.col("v")).alias("a")).orderBy("k").collect()
    assert [(list(r.a.pieces), r.a.exact) for r in got] == [([""], False)] * 4 + [(["\xe0"], True), ([""], False)]


def test_alignment_of_random_tokens(spark):
    draw, rows, want = random.Random(5), [], []
    for k in range(300):
        text = "".join(draw.choices("ab é🙂\n\u20ac", k=draw.randrange(12)))
        raw, bare = text.encode(), text.strip(" \n")
        cuts = sorted(draw.choices(range(len(raw) + 1), k=draw.randrange(6)))
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
        head, ends = len(text) - len(text.lstrip(" \n")), [0, *cuts, len(raw)]
        ended = [min(max(len(raw[:e].decode(errors="ignore")) - head, 0), len(bare)) for e in ends]
        rows.append((k, bare, ["t"] * len(parts), [list(p) for p in parts]))
        want.append([bare[a:b] for a, b in zip(ended, ended[1:])])
    rows = spark.createDataFrame(rows, "k int, x string, t array<string>, v array<array<int>>")
    got = rows.select("k", align.aligned_to_bytes(F.col("x"), F.col("t"), F.col("v")).alias("a")).orderBy("k").collect()
    assert all(r.a.exact for r in got) and [list(r.a.pieces) for r in got] == want


@pytest.mark.parametrize("spoilt", [False, True])
def test_alignment_takes_time_in_proportion_to_a_text(spark, spoilt):
    took = {}
    for n in (1, 10_000, 100_000):
        row = spark.range(1).select(F.repeat(L("é "), n).alias("x"))
        p = F.split("x", "")
        p = F.slice(p, 1, F.size(p) - 1) if spoilt else p
        v = F.transform(p, lambda c: F.when(c == " ", F.array(L(32))).otherwise(F.array(L(0xC3), L(0xA9))))
        row = row.select("x", p.alias("p"), v.alias("v")).localCheckpoint()
        began = time.time()
        row.select(align.aligned_to_text(F.col("x"), F.col("p")), align.aligned_to_bytes(F.col("x"), F.col("p"), F.col("v"))).collect()
        took[n] = time.time() - began
    assert took[100_000] < 30 * max(took[10_000], 0.2)


def test_unicode_white_space_parts_and_strips(value):
    assert value(metrics.exact_match(L("New\xa0York"), texts("New York")))
    assert value(metrics.token_f1_single(L("New\u3000York"), L("york new"))) == 1
    assert value(text.words(L("a\xa0b\u3000c d\x1ce\u2028"))) == ["a", "b", "c", "d", "e"]
    assert value(text.stripped(L("\x85\n a b\u2003\x1f"))) == "a b"
    assert value(text.articles_first(L("éa the_a a"))) == "éa thea"


def test_claims_lose_their_outer_white_space(value):
    lines = "First sentence is long.\nSecond sentence is long."
    assert value(text.claims(L(lines))) == ["First sentence is long", "Second sentence is long"]
    assert value(text.claims(L('{"claims": ["\\n one claim\\t", " \\n"]}'))) == ["one claim"]
    assert value(text.claims(L("[] This is a long sentence here..."))) == ["[] This is a long sentence here"]
    assert value(text.claims(L('say ["\u3000a", null, true, 3] now'))) == ["a", "None", "True", "3"]
    assert value(text.claims(L('{"facts": ["one", "two"]}'))) == []
    assert value(text.standalone_claims(L("[ ]"), L("its text"))) == []
    assert value(text.standalone_claims(L("x"), L("\n\xa0"))) == []


@pytest.mark.parametrize(
    "said, want",
    [
        ('We add both. The final answer is: "Lake Vesna"', "Lake Vesna"),
        ("The answer is - Paris.", "Paris"),
        ("So the answer is 'B'...", "B"),
        ("The answer is A.\nMore text", None),
        ("no end", None),
        ("First.\nThe answer is A.\n", "A"),
    ],
)
def test_final_answer(value, said, want):
    assert value(text.final_answer(L(said))) == want
    assert value(text.answer_of(L(said))) == (want or said.strip())


def test_exact_match_and_containment(value):
    assert value(metrics.exact_match(L("the old Mill"), texts("Old mill")))
    assert value(metrics.exact_match(L("B. Oak"), texts("Birch", "b oak", "Beech")))
    assert not value(metrics.exact_match(L("x"), F.array().cast("array<string>")))
    assert value(metrics.containment(L("Near Vesna, in the hills"), texts("vesna")))


def test_token_f1(value):
    assert value(metrics.token_f1(L("grey owls hunt mice"), texts("none", "owls hunt at night"))) == 0.5
    assert value(metrics.token_f1(L(""), texts("x"))) == 0
    assert value(metrics.token_f1_single(L("the"), L("a"))) == 1
    assert value(metrics.token_f1(L("the-cat"), texts("dog", "cat"))) == 1 and value(metrics.token_f1_single(L("the-cat"), L("cat"))) == 0


def test_numeric_match(value):
    assert value(metrics.numeric_match(L("50%"), texts("0.5")))
    assert value(metrics.numeric_match(L("some 1700 boats"), texts("1700")))
    assert not value(metrics.numeric_match(L("16"), texts("17")))


def test_rouge(value):
    assert value(metrics.rouge_l(L("grey owls hunt"), texts("x", "big grey owls never hunt"))) == pytest.approx(2 * 3 / (3 + 5))
    assert value(metrics.rouge_l(L(""), texts("x"))) == 0 and value(metrics.rouge_l(L("the-cat"), texts("cat"))) == 1
    assert value(metrics.rouge_l(L("x"), F.array().cast("array<string>"))) == 0


def test_suite(value):
    chosen = metrics.suite(("token_f1", "numeric"), L("17"), texts("17"))
    assert list(chosen) == ["token_f1", "numeric"] and value(chosen["numeric"]) == 1
    with pytest.raises(ValueError):
        metrics.suite(("other",), L("x"), texts("x"))


def test_common_length_is_the_dynamic_programme():
    draw = random.Random(0)
    for _ in range(200):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(15))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert metrics._common_length(a, b) == best[-1][-1]


def test_layouts(value):
    headers, rows = texts("Name", "Age"), F.array(texts("Alice", "30"), texts("Bob"), texts("Eve", "1", "x"))
    found = value(layout.table_markdown(headers, rows)).split("\n")
    assert found == ["| Name | Age |", "| --- | --- |", "| Alice | 30 |", "| Bob |  |", "| Eve | 1 |"]
    assert value(layout.table_linear(headers, rows)) == "Name: Alice; Age: 30 | Name: Bob | Name: Eve; Age: 1; col2: x"
    assert value(layout.text_context(texts("a", "b"))) == "Context:\n[Doc 1] a\n[Doc 2] b"
    assert value(layout.text_context(F.array().cast("array<string>"))) == "[No context provided]"
    assert value(layout.image_label(L("A red car"))) == "[Image: A red car]"
    assert value(layout.image_label(L(None).cast("string"))) == "[Image]"
    assert value(layout.mime_type(L("x/y.PNG"))) == "image/png" and value(layout.mime_type(L("z"))) == "image/jpeg"


CHUNK = "array<struct<modality: string, text: string, caption: string, image: string, mime: string, headers: array<string>, rows: array<array<string>>>>"


def test_table_and_image_contexts(spark):
    chunks = [("table", None, None, None, None, ["h"], [["1"]]), ("text", "plain", None, None, None, None, None), ("table", "as it is", None, None, None, None, None)]
    rows = spark.createDataFrame([(chunks,), ([],)], f"c {CHUNK}")
    got = [r.x for r in rows.select(layout.table_context(F.col("c")).alias("x")).collect()]
    assert got[0] == "Context:\n\n[TABLE 1]\n| h |\n| --- |\n| 1 |\n\n[TEXT 2] plain\n\n[TABLE 3]\nas it is\n" and got[1] == layout.NO_CONTEXT
    assert "[TABLE 1]\nh: 1\n" in rows.select(layout.table_context(F.col("c"), "linear").alias("x")).first().x
    chunks = [("image", None, "a hill", "http://x/y.png", None, None, None), ("image", None, None, "QUJD", "image/png", None, None), ("text", "t", None, None, None, None, None)]
    rows = spark.createDataFrame([(chunks,), ([],)], f"c {CHUNK}")
    got = [r.x for r in rows.select(layout.image_context(F.col("c")).alias("x")).collect()]
    assert [b.text or b.url for b in got[0]] == ["Context:\n", "[Image 1] Caption: a hill", "http://x/y.png", "[Image 2]", "data:image/png;base64,QUJD", "[Text 3] t\n"]
    assert [b.text for b in got[1]] == [layout.NO_CONTEXT]
    said = rows.select(layout.prompt_messages(L("why"), layout.image_context(F.col("c")), L("be brief")).alias("m")).collect()
    assert [m.role for m in said[0].m] == ["system", "user"] and said[0].m[1].content[-1].text == "\nQuestion: why\nAnswer:"
    said = rows.select(layout.prompt_messages(L("why"), layout.image_context(F.col("c"))).alias("m")).first().m
    assert [m.role for m in said] == ["user"]
    labels = rows.select(F.explode("c").alias("c")).select(layout.chunk_label(*[F.col(f"c.{n}") for n in ("modality", "text", "caption", "headers", "rows")]).alias("x"))
    assert [r.x for r in labels.collect()] == ["[Image: a hill]", "[Image]", "t"]


def test_listed_tables_and_base64(value):
    cells = F.array(texts("h", "k"), texts("1"))
    assert value(layout.listed_table(cells)) == "| h | k |\n| --- | --- |\n| 1 |  |"
    assert value(layout.image_base64(L("abc" * 40).cast("binary"))) == "YWJj" * 40


def test_prompts(spark, value):
    rows = spark.createDataFrame([("Some-Alpha-7", "why", "p")], "model string, q string, p string")
    templates = spark.createDataFrame([("alpha", "{q}? {p}"), ("beta", "-")], "kind string, chat string")
    assert layout.prompts(rows, templates, "model", "chat", q=F.col("q"), p=F.col("p")).first().prompt == "why? p"
    with pytest.raises(Exception, match="no template"):
        layout.prompts(rows.withColumn("model", L("gamma")), templates, "model", "chat", q=F.col("q"), p=F.col("p")).collect()
    docs = F.array(F.struct(L("T").alias("title"), L(None).cast("string").alias("source"), L("d").alias("published_at"), L("x").alias("text"), L(1).alias("id"), L("u").alias("url"), L(0.5).alias("score")))
    assert value(layout.document_block(docs)) == "[1] T\nSource: ; Date: d\nx"
    assert value(layout.compact_documents(docs))[0].asDict() == {"id": 1, "title": "T", "url": "u", "score": 0.5}


def test_truth_prompts(value):
    shot = value(layout.truth_shot(L("q"), L("a "), texts("b"), L(True)))
    assert shot == "Question: q\nBrainstormed Answers: a \nb \nPossible answer: a \n" + layout.CHOICES + " A"
    own = value(layout.truth_prompt(L("q"), L("a"), texts("b"), layout.shot_block(texts("one", "two"))))
    assert own == "one\ntwo\nQuestion: q\nBrainstormed Answers: b\na\nPossible answer: a\n" + layout.CHOICES
