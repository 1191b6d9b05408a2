import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking as C
from docloom.operators import markdown as M
from docloom.operators import structure as S
from docloom.plans import catalogue

PAGE = """# Top

Intro with <!-- a note --> a comment.\r
| a | b |
|---|:-:|
| 1 | 2 |

Table 1: numbers
```py
# no heading
```
<!-- Start of picture text -->x<br>y<!-- End of picture text -->
![alt](pic.png)
#tag
"""


def kinds(text):
    return [(b["type"], b["text"] or b["rows"] or b["content"]) for b in M.parse_blocks(M.normalize(text))]


def test_blocks_in_order():
    assert kinds(PAGE) == [
        ("heading", "Top"),
        ("text", "Intro with  a comment."),
        ("table", [["a", "b"], ["1", "2"]]),
        ("text", "Table 1: numbers"),
        ("text", "# no heading"),
        ("picture", "x\ny"),
        ("heading", "tag"),
    ]


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []),
        (None, []),
        ("```\nopen to the end\n# x", [("text", "open to the end\n# x")]),
        ("```\n```\nnext", [("text", "next")]),
        ("# \n####### Deep ##", [("heading", "Deep")]),
        ("| - | : |\n| | |", []),
        ("  keeps\n   indent", [("text", "keeps\n   indent")]),
        ("a\n<!-- one\ntwo -->b", [("text", "a\nb")]),
    ],
)
def test_block_edges(text, want):
    assert kinds(text) == want


def test_tables_both_ways(spark):
    rows = M.parse_table(["| a | b |", "|---|---|", "| 1 |", "| x | y | z |"])
    assert rows == [["a", "b"], ["1"], ["x", "y", "z"]]
    text = M.render_table(rows)
    assert text.split("\n")[1] == "| --- | --- | --- |" and M.parse_table(text.split("\n"))[1][0] == "1"
    df = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 |\n| x | y | z |"), (2, "no table")], "id int, t string")
    got = {r.id: (r.c, r.m) for r in df.select("id", M.table_cells(df.t).alias("c")).select("id", "c", M.table_markdown(F.col("c")).alias("m")).collect()}
    assert got[1] == (rows, text) and got[2] == ([], "")
    assert M.default_caption([]) == "Table." and M.default_caption(rows) == "Table with columns: a, b. Rows: 2."


def test_truncated_table(spark):
    rows = [["h"]] + [[str(i)] for i in range(50)]
    df = spark.createDataFrame([(rows,)], "r array<array<string>>")
    text = df.select(M.truncated_table(F.col("r"), 5)).first()[0]
    assert text.endswith("| 4 |\n(5 of 50 rows shown)") and "| 5 |" not in text
    assert df.select(M.truncated_table(F.col("r"), 100)).first()[0] == M.render_table(rows)
    assert df.select(M.truncated_table(F.col("r"), 100, 40)).first()[0].split("\n")[-1].endswith("of 50 rows shown)")


def table(*rows):
    return M.block("table", rows=[list(r) for r in rows])


def text(t):
    return M.block("text", text=t)


def test_page_breaks():
    a, b = table(("x", "y"), ("1", "2")), table(("x", "y"), ("3", "4"))
    assert [len(t["rows"]) for t in S.merge_page_breaks([a, text("2"), b])] == [3]
    assert len(S.merge_page_breaks([a, table(("x", "y", "z"), ("1", "2", "3"))])) == 2
    assert len(S.merge_page_breaks([a, b, text("Table 2: own")])) == 3
    assert len(S.merge_page_breaks([text("Table 1: first"), a, b])) == 2
    assert [t["type"] for t in S.merge_page_breaks([a, text("2"), text("end")])] == ["table", "text", "text"]
    assert not S.is_page_marker("see page 2") and all(map(S.is_page_marker, ("", "Page 3", "7", "(1 of 9)", "continued")))


def test_captions():
    a, b = table(("x",), ("1",)), table(("y",), ("2",))
    got = S.attach_captions([a, text("Table 3: c"), b])
    assert [(t["type"], t["table_number"]) for t in got] == [("table", "3"), ("table", None)]
    got = S.attach_captions([M.block("picture", content="p"), text("Bảng 2.1: ảnh"), M.block("picture", content="q"), text("Figure 1: q")])
    assert [(t["type"], t["table_number"]) for t in got] == [("table", "2.1"), ("text", None)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("# Head\fbody\x85more", [("heading", "Head"), ("text", "body\nmore")]),
        ("<!-- Start of picture text --><!-- End of picture text -->\nafter", [("text", "after")]),
        ("a\n```x\n# no\n```\nb", [("text", "a"), ("text", "# no"), ("text", "b")]),
        ("~~~\n```\n~~~\n| a |\n  | 1 |\ntext", [("text", "```"), ("table", [["a"], ["1"]]), ("text", "text")]),
        ("one\n \t\ntwo\n\n\nthree", [("text", "one"), ("text", "two"), ("text", "three")]),
    ],
)
def test_more_block_edges(text, want):
    assert kinds(text) == want


def test_comments_do_not_end_a_paragraph():
    assert [b["text"] for b in M.parse_blocks("a\n<!-- one\ntwo --> gone\nb <!-- c --> d\n<!-- open\ne")] == ["a\nb  d"]


def test_pictures_take_time_in_proportion():
    M.parse_blocks("<!-- Start of picture text -->x<!-- End of picture text -->\n" * 20_000)
    M.parse_blocks("<!-- " * 100_000), M.parse_blocks("```\n" * 100_001), M.parse_blocks("|\n" * 100_000), M.parse_blocks(" " * 100_000)


def test_captions_by_the_first_neighbour():
    a = table(("x",), ("1",))
    kinds_of = lambda *b: [(t["type"], t["table_number"]) for t in S.attach_captions(list(b))]
    assert kinds_of(text("Table 1: t"), a, text("Figure 2: f")) == [("text", None), ("table", None), ("text", None)]
    assert kinds_of(a, text("Table 3a: t")) == [("table", "3a")] and kinds_of(a, text("**Table A1.** t")) == [("table", "A1")] and kinds_of(a, text("Table2- t")) == [("table", "2")]
    assert kinds_of(a, text("see Table 2: t")) == [("table", None), ("text", None)]
    assert M.default_caption([["a", "", "b"], ["1"]]) == "Table with columns: a, b. Rows: 1."
    assert S.clean_heading("**A**b *c*") == "A b c"


def test_section_ids():
    s = S.SectionStack()
    ids = [s.enter(level, t)["id"] for level, t in [(1, "1 One"), (2, "1.1 Sub"), (2, "Plain"), (3, "**Deep**"), (1, "1 Again"), (1, "Other"), (1, "A Survey of X"), (2, "2 Off")]]
    assert ids == ["s1", "s1.1", "s1.x1", "s1.x1.x1", "s1-2", "x1", "sA", "sA.x1"]
    assert s.path()[-1]["depth"] == 2


@pytest.mark.parametrize("n,sizes", [(0, []), (1, [1]), (1800, [1800]), (1801, [1800, 1]), (3600, [1800, 1800])])
def test_split_one_paragraph(n, sizes):
    assert [len(p) for p in C.split_text("a" * n)] == sizes


def test_split_strips_a_text_once(spark):
    spaces = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"
    odd = [None, "", spaces, *(f"{c}a b{c}" for c in spaces), *(f"a{c}" for c in spaces), "\u200bx\u200b", f"{spaces}{'x' * 1801}{spaces}\n\n{spaces}y", "\U0001f600 " * 950 + "\n\n z\n\n"]
    rows = spark.createDataFrame(list(enumerate(odd)), "id int, text string").select("id", C.split_column(F.col("text")).alias("x")).collect()
    assert [r.x for r in sorted(rows)] == [C.split_text(t) for t in odd]
    plan = catalogue.split_text_chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2  # of the text and of its paragraphs


def test_split_packs_paragraphs(spark):
    texts = ["\n\n".join(p) for p in (["b" * 700, "c" * 400, "d" * 1300, "e" * 2000], ["x" * 600] * 5, ["", "y" * 1799, " ", "z"], ["q" * 1799])]
    assert [len(p) for p in C.split_text(texts[0])] == [1102, 1300, 1800, 200]
    texts += ["\n\n\n".join("ab \n\t"[k % 3] * 700 for k in range(9)), "\t" + "\n\n\u00a0".join(["k\t" * 450] * 4) + "\x1c\n", " \n\t\u2003", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.split_column(df.t)).collect()]
    assert got == [C.split_text(t) for t in texts]


def test_chunks_of_a_document():
    chunks = C.chunk_document("/r", "a/b.md", PAGE + "\nlast", [{"image_path": "i.png", "caption": "pic"}])
    assert [(c["seq"], c["chunk_type"], c["section_id"]) for c in chunks] == [
        (1, "text", "x1"), (2, "table_stub", "x1"), (3, "text", "x1"), (4, "text", "x2"), (5, "image_stub", "s0"), (6, "text", "x2"),
    ]
    stub = chunks[1]
    assert stub["asset_id"].endswith("_x1_t0") and stub["table_number"] == "1" and "Row entities: 1" in stub["text"]
    assert "[Ref Table: " in chunks[2]["text"] and chunks[2]["text"].startswith("[Document: b.md | Section: Top]\n\n")
    assert chunks[5]["text"].endswith(f"[Ref Image: {chunks[4]['asset_id']}]")
    assert len({c["chunk_id"] for c in chunks}) == 6 and all(c["char_count"] == len(c["text"]) for c in chunks)


def test_images_through_spark(spark):
    df = spark.createDataFrame([("/r", "a.md", "# A\n\nx", [("i.png", "c"), ("j.png", None)]), ("/r", "b.md", "y", None)], "root string, path string, text string, images array<struct<image_path:string,caption:string>>")
    got = [(r.path, r.chunk_type, r.asset_path, r.section_id) for r in C.chunk_frame(df).orderBy("path", "seq").collect()]
    assert got == [("a.md", "text", None, "x1"), ("a.md", "image_stub", "i.png", "s0"), ("a.md", "image_stub", "j.png", "s0"), ("a.md", "text", None, "x1"), ("b.md", "text", None, "s0")]


def test_chunk_frame_and_outline(spark):
    df = spark.createDataFrame([("/r", "a.md", "# 1 A\n\nx\n\n## 1.2 B\n\ny\n\n# C\n\nz"), ("/r", "b.md", None), ("/r", "c.md", "plain")], "root string, path string, text string")
    chunks = C.chunk_frame(df)
    assert {(r.path, r.section_id) for r in chunks.collect()} == {("a.md", "s1"), ("a.md", "s1.2"), ("a.md", "x1"), ("c.md", "s0")}
    tree = S.outline(chunks)
    assert [(r.section_id, r.parent_id) for r in tree.where("path = 'a.md'").orderBy("ord").collect()] == [("s1", None), ("s1.2", "s1"), ("x1", None)]
    assert S.render_outline(tree).where("path = 'a.md'").first()["outline"] == "- 1 A\n  - 1.2 B\n- C"
