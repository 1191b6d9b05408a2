import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.functions.batches import BATCH_BYTES
from docloom.operators import markdown
from docloom.plans import catalogue
from docloom.plans.engine import Engine
from docloom.sources import decoders, files, stores


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Title", "Heading1") + p("Words.") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a.md").write_text("# One\n\nalpha beta\n\n| k | v |\n|---|---|\n| x | 1 |\n\nTable 1: keys")
    (tmp_path / "sub" / "b.txt").write_text("gamma delta")
    (tmp_path / "c.docx").write_bytes(docx())
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    for name in (".hidden.md", ".hidden/x.md", "sub/skip.bin"):
        (tmp_path / name).write_text("no")
    return tmp_path


def test_scan_and_tree(spark, folder):
    rows = files.scan(spark, str(folder))
    assert sorted(r.path for r in rows.collect()) == ["a.md", "c.docx", "p.pdf", "sub/b.txt"]
    assert "content" not in rows.columns
    tree = files.tree(rows)
    assert tree["files"] == ["a.md", "c.docx", "p.pdf"] and tree["folders"]["sub"]["files"] == ["b.txt"]
    assert files.file_meta(spark, str(folder), "a.md").count() == 1 and files.file_meta(spark, str(folder), "zz.md").count() == 0
    assert [r.path for r in files.listing(spark, str(folder), 2).collect()] == ["a.md", "c.docx"]


def test_read_content(spark, folder):
    assert files.read_content(spark, str(folder), "sub/b.txt")["content"] == "gamma delta"
    assert files.read_content(spark, str(folder), "sub/b.txt", 5) == {"path": "sub/b.txt", "size": 11, "truncated": True, "encoding": "utf-8", "content": "gamma"}
    assert files.read_content(spark, str(folder), "c.docx")["encoding"] == "base64"
    for bad in ("../x", "/etc/passwd", "sub/../../x"):
        with pytest.raises(ValueError):
            files.read_content(spark, str(folder), bad)


def test_decoders():
    assert decoders.decode(".docx", docx()) == "# Title\n\nWords.\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    html = b"<html><head><title>t</title></head><body><nav>no</nav><h2>H &amp; i</h2><p>one<br>two</p><ul><li>x<li>y</ul><table><tr><th>a<th>b</tr><tr><td>1</td><td>2</td></tr></table></body></html>"
    assert decoders.decode(".html", html).split("\n\n")[:4] == ["## H & i", "one two", "- x", "- y"]
    for suffix in (".py", ".pdf", "", None):
        with pytest.raises(decoders.Unsupported):
            decoders.decode(suffix, b"x")


def test_errors_stay_in_their_row(spark, folder):
    rows = {r.path: r for r in files.read_documents(spark, str(folder)).collect()}
    assert rows["p.pdf"].text is None and "PDF" in rows["p.pdf"].error
    assert rows["a.md"].error is None and rows["c.docx"].text.startswith("# Title")


def test_blocks_of_files_in_one_bounded_pass(spark, tmp_path):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")  # other tests may have left a bound
    page = "<h2>H &amp; i</h2><p>one<br>two</p><table><tr><td>1</td></tr></table><!-- c --><p># x</p>" * 200
    spark.range(0, 400, 1, 1).select(F.col("id").alias("page_id"), F.when(F.col("id") > 2, F.lit(page)).when(F.col("id") == 1, F.lit("")).alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    df = catalogue.html_to_blocks(spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = markdown.parse_blocks(markdown.normalize(decoders.decode(".html", page.encode())))
    got = df.where("page_id IN (0, 1, 2, 399)").orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.type, r.level, r.text, r.rows) for r in got] == [(399, *(b[k] for k in ("pos", "type", "level", "text", "rows"))) for b in want]
    assert df.where("page_id = 5").count() == len(want)

    @F.pandas_udf("long")
    def together(html: pd.Series) -> pd.Series:
        return pd.Series([int(html.str.len().sum())] * len(html))

    most = spark.read.parquet(f"{tmp_path}/pages.parquet").select(together(F.coalesce("html", F.lit(""))).alias("n")).agg(F.max("n")).first()[0]
    assert len(page) <= most <= BATCH_BYTES + len(page) < 397 * len(page)
    bad = spark.createDataFrame([(".pdf", b"%PDF"), (".py", b"x"), (".md", b"# a")], "s string, c binary")
    assert [len(r.b) for r in bad.select(decoders.blocks_of(F.col("s"), F.col("c")).alias("b")).collect()] == [0, 0, 1]


def test_roots():
    assert files.normal_root('"C:\\a\\b"') == "/mnt/c/a/b" and files.normal_root("/x/../y/") == "/y"


def test_stores(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"model":"m","text":"a","embedding":[1]}\n{"model":"n","text":"a","embedding":[2]}\n{"model":"m","text":"a","embedding":[3]}\n')
    assert [list(r.embedding) for r in stores.load_cache(spark, str(tmp_path / "e.jsonl"), "m").collect()] == [[3.0]]
    (tmp_path / "q.json").write_text('{"questions":[{"id":"q1","question":"?","gold":{"url":"u","section_heading":"s","chunk_ids":["c"]}}]}')
    row = stores.load_questions(spark, str(tmp_path / "q.json")).first()
    assert (row.id, row.url, row.chunk_ids) == ("q1", "u", ["c"])


def test_engine_round(spark, folder, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("home")), answer=lambda prompt: f"{len(prompt)} characters")
    counts = lambda df: {r.change: r.files for r in df.collect()}
    assert counts(engine.sync(str(folder))) == {"added": 4}
    root = str(folder)
    assert {r.status: r.files for r in engine.status(root).collect()} == {"indexed": 3, "error": 1, "total": 4}
    assert [r.path for r in engine.search("gamma", root).collect()] == ["sub/b.txt"]
    assert engine.search("  ", root).count() == 0 and engine.search("gamma", root, ["a.md"]).count() == 0
    (folder / "sub" / "b.txt").unlink()
    (folder / "a.md").write_text("# Two\n\nepsilon")
    assert counts(engine.sync(root)) == {"modified": 2, "deleted": 1, "unchanged": 1}
    assert engine.search("gamma", root).count() == 0 and engine.search("epsilon", root).first()["section_heading"] == "Two"
    turn = engine.ask("What is epsilon?", root)
    assert "epsilon" in turn["context"] and turn["answer"].endswith("characters") and len(turn["session"].messages) == 2
    assert [r.section_id for r in engine.outline(root, "a.md").collect()] == ["x1"]
    assert {r.path for r in engine.sources(root).collect()} == {"a.md", "c.docx"}
    assert engine.tree(root)["files"] == ["a.md", "c.docx", "p.pdf"] and "epsilon" in engine.read(root, "a.md")["content"]
    cache = {}
    assert engine.insight(root, "a.md", lambda kind, text: kind, cache)["summary"] == "single"
    assert {r.path: (r.stale, r.summary) for r in engine.insights(root, cache).collect()} == {"a.md": (False, "single"), "c.docx": (True, None)}


def test_the_last_file_of_a_folder(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# One\n\nalpha")
    engine = Engine(spark, str(tmp_path / "home"), embed=lambda texts: [[1.0, 0.0] for _ in texts])
    counts = lambda df: {r.change: r.files for r in df.collect()}
    assert counts(engine.sync(str(folder))) == {"added": 1} and counts(engine.sync(str(folder))) == {"unchanged": 1}
    assert engine.totals(str(folder)) == {"files": 1, "chunks": 1, "tables": 0, "images": 0, "embedded": 1}
    (folder / "a.md").unlink()
    (folder / "keep.zip").write_text("not read")
    assert counts(engine.sync(str(folder))) == {"deleted": 1} and counts(engine.sync(str(folder))) == {}
    assert engine.chunks.count() == engine.state.count() == 0 and engine.totals(str(folder))["embedded"] == 0
    assert engine.search("alpha", str(folder)).count() == 0


def test_batches_cards_and_embeddings(spark, folder, tmp_path_factory):
    embedded = []
    engine = Engine(spark, str(tmp_path_factory.mktemp("home")), embed=lambda texts: [[float(len(t)), 1.0] for t in texts])
    root = str(folder)
    engine.sync(root)
    stamp = {r.path: r.indexed_at for r in engine.state.collect()}
    (folder / "a.md").write_text("# New\n\nzeta")
    batch = spark.createDataFrame([("a.md", "upsert"), ("sub/b.txt", "delete"), ("never.md", "upsert"), ("p.pdf", "upsert")], "path string, action string")
    assert engine.apply(root, batch) == {"deleted": 1, "indexed": 1, "errors": 1}
    assert engine.search("zeta", root).first()["path"] == "a.md" and engine.search("gamma", root).where("path = 'sub/b.txt'").count() == 0
    after = {r.path: (r.status, r.indexed_at) for r in engine.state.collect()}
    assert after["a.md"][1] > stamp["a.md"] and after["c.docx"][1] == stamp["c.docx"] and after["p.pdf"][0] == "error" and "sub/b.txt" not in after
    card = engine.cards(root).where("path = 'a.md'").first()
    assert card.stale and card.summary is None
    engine.save_cards(root, spark.createDataFrame([("a.md", "sum", card.file_hash), ("gone.md", "x", "y")], "path string, summary string, file_hash string"))
    again = {r.path: (r.summary, r.stale) for r in engine.cards(root).collect()}
    assert again == {"a.md": ("sum", False), "c.docx": (None, True)}
    assert len(engine.results(engine.dense_search("q", root, k=2)).columns) == 34
    engine.drop_root(root)
    assert engine.chunks.count() == engine.state.count() == 0


def test_engine_with_vectors(spark, folder, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("home")), embed=lambda texts: [[float("gamma" in t), float("alpha" in t), 0.1] for t in texts])
    engine.sync(str(folder))
    best = engine.search("gamma things", str(folder), k=2).collect()
    assert best[0].path == "sub/b.txt" and best[0].semantic_score > 0.9
    rows = engine.retrieve("What does table 1 say?", str(folder))
    assert rows.first()["chunk_type"] == "table_stub" and "| x | 1 |" in engine.context(rows, str(folder))
