import io
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.embed import HashEmbedder, mean_pool
from lodestone.functions import paths
from lodestone.operators.store import IndexStore, missing_files, replace_children, unchanged, upsert_files
from lodestone.plans.index import index_directory, summary
from lodestone.plans.search import Options, printed, search
from lodestone.sources import config as cfg
from lodestone.sources.extract import docx_text, extract_text
from lodestone.sources.pdf import pages
from lodestone.sources.listing import Rules, classify, listing, match, scan, size_limit


def test_globs():
    assert match("cmake-build-*", "cmake-build-debug", True) and not match("*", "a/b", True)
    assert match("*@v*", "pkg@v1", True) and match("ms-python.*", "ms-python.x", True)
    assert match("[a-c]x", "bx", True) and not match("[^a-c]x", "bx", True) and match("a\\*", "a*", True)
    assert match("weird[name", "weird[name", True) and not match("weird[name", "weird[name", False)


def test_classify_and_limits():
    r = Rules(text=[".txt", ".go"], media=[".jpg", ".png"], ignore_patterns=[".DS_Store", "*.tmp"], default_mb=2, mb_by_type={"pdf": 20, "heic": 25, "PNG": 9})
    kinds = {n: classify(n, r, []) for n in ("notes.txt", "NOTES.TXT", "main.go", "photo.PNG", "song.mp3", ".DS_Store", "cache.tmp")}
    assert kinds == {"notes.txt": "text", "NOTES.TXT": "text", "main.go": "text", "photo.PNG": "media", "song.mp3": "none", ".DS_Store": "none", "cache.tmp": "none"}
    assert [size_limit(n, r) >> 20 for n in ("todo.txt", "paper.pdf", "IMG.HEIC", "Makefile", "a.tar.gz", "x.png")] == [2, 20, 25, 2, 2, 2]


def test_path_columns(spark):
    names = ["/a/.git/x.txt", "/a/b/.env", "/a/node_modules/c/d.md", "/a/e.tar.gz", "/a/noext", "/a/weird[name/x.md"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    rows = df.select("path", paths.extension(F.col("path")).alias("e"), paths.classify(F.col("path")).alias("k"), paths.hidden_or_ignored(F.col("path"), ["node_modules", "weird[name"]).alias("h")).collect()
    assert [(r.e, r.k, r.h) for r in rows] == [(".txt", "text", True), (".env", "none", False), (".md", "text", True), (".gz", "none", False), ("", "none", False), (".md", "text", True)]
    under = df.select(paths.under_dir(F.col("path"), "/a/b").alias("u")).collect()
    assert [r.u for r in under] == [False, True, False, False, False, False]
    size = spark.createDataFrame([("/x.pdf", 3 << 20), ("/x.txt", 2 << 20), ("/x.txt", (2 << 20) + 1)], "p string, s long")
    assert [r[0] for r in size.select(paths.too_large(F.col("p"), F.col("s"), by_type={"pdf": 0})).collect()] == [False, False, True]


def test_scan(tmp_path):
    for name in ("aaa/notes.txt", ".hidden/x.txt", "dist/bundle.js", ".dotfile.txt", "venv/pyvenv.cfg", "venv/lib.py", "node_modules/x.js", "build/y.txt", "src/build.txt", "src/z.log", "big.txt", "pic.png"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    (tmp_path / "big.txt").write_bytes(b"x" * (2 * 1024 * 1024 + 1))
    (tmp_path / ".gitignore").write_text("# no\nbuild/\n/src/*.log\n")
    os.symlink(tmp_path / "aaa", tmp_path / "link")
    root = os.path.realpath(tmp_path)
    found = {os.path.relpath(p, root): (k, o) for p, k, _, _, o in scan(str(tmp_path), Rules())}
    assert found == {
        ".dotfile.txt": ("text", "candidate"), ".gitignore": ("none", "filtered"), "aaa/notes.txt": ("text", "candidate"), "big.txt": ("text", "too_large"), "pic.png": ("media", "candidate"),
        "src/build.txt": ("text", "candidate"), "src/z.log": ("none", "filtered"), "link": ("none", "filtered"),
    }
    assert not any(os.sep in os.path.relpath(p, root) for p, *_ in scan(str(tmp_path), Rules(), recursive=False))
    with pytest.raises(FileNotFoundError):
        scan(str(tmp_path / "nowhere"), Rules())


def test_listing_in_tasks(spark, tmp_path):
    for k in range(6):
        for j in range(3):
            p = tmp_path / f"d{k}" / f"e{j}" / "x.md"
            p.parent.mkdir(parents=True)
            p.write_text("x" * k)
    want = sorted(scan(str(tmp_path), Rules()))
    for share in (1, 5, 100):
        assert sorted(tuple(r) for r in listing(spark, str(tmp_path), Rules(), share=share).collect()) == want
    assert listing(spark, str(tmp_path), Rules(), recursive=False).count() == 0


def docx(body: str, part="word/document.xml") -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr(part, f'<?xml version="1.0"?><w:document xmlns:w="u"><w:body>{body}</w:body></w:document>')
    return raw.getvalue()


def test_rules_of_the_scan_and_of_columns_agree(spark):
    names = ["/r/a.txt", "/r/A.MD", "/r/.env", "/r/.DS_Store", "/r/b.JPG", "/r/noext", "/r/x.tar.gz", "/r/.gitignore", "/r/.env.local", "/r/c.Go", "/r/ü.txt", "/r/d.", "/r/e.heic"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    rows = df.select("path", paths.extension(F.col("path")).alias("e"), paths.classify(F.col("path")).alias("k"), paths.size_limit(F.col("path")).alias("s")).collect()
    r = Rules()
    from lodestone.sources.listing import extension

    assert [(x.e, x.k, x.s) for x in rows] == [(extension(n[3:]), classify(n[3:], r, []), size_limit(n[3:], r)) for n in names]


def test_progress(spark):
    import io as text_io
    import time

    from lodestone.progress import Progress

    class Terminal(text_io.StringIO):
        def isatty(self):
            return True

    told, out = [], Terminal()
    with Progress(spark, out, lambda *x: told.append(x), 0.01):
        spark.range(1000).repartition(8).count()
        time.sleep(0.1)
    assert told and out.getvalue().endswith("\r\x1b[K")
    plain = text_io.StringIO()
    with Progress(spark, plain):
        pass
    assert plain.getvalue() == ""


def test_docx():
    assert docx_text(docx("<w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p/><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p>")) == "One two\n\na\tb\nc\n"
    assert extract_text("/x/Y.DOCX", docx("<w:p><w:r><w:t>x</w:t></w:r></w:p>")) == "x\n"
    for bad in (b"no zip", docx("", "other.xml"), docx("<w:p>")):
        with pytest.raises(Exception):
            docx_text(bad)


def pdf(contents: list[bytes], compressed: bool, font: bytes = b"") -> bytes:
    """A file of one page for each content."""
    n = len(contents)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 %d 0 R >> >> >>" % (n, b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(n)), 3 + 2 * n)]
    for k, c in enumerate(contents):
        data = zlib.compress(c) if compressed else c
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * k), b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if compressed else b"", data)]
    objects.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica %s>>" % (b"/ToUnicode %d 0 R " % (4 + 2 * n) if font else b""))
    if font:
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(font), font))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf():
    one = b"BT /F1 12 Tf 72 700 Td (First \\(line\\) \\351) Tj 0 -14 Td [(Sec) 20 (ond) -300 (line  )] TJ ET"
    two = b"BT /F1 12 Tf (Page) Tj T* (two) ' ET"
    for compressed in (False, True):
        assert list(pages(pdf([one, two], compressed))) == ["First (line) \xe9\nSecond line  \n", "Page\n\ntwo\n"]
        assert extract_text("/x/Y.PDF", pdf([one, two], compressed)) == "--- page 1 ---\nFirst (line) \xe9\nSecond line\n\n--- page 2 ---\nPage\n\ntwo\n\n"
    cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 2 beginbfchar <01> <0048> <02> <20AC> endbfchar 1 beginbfrange <10> <12> <0061> endbfrange"
    assert list(pages(pdf([b"BT /F1 9 Tf <0102101112> Tj ET"], True, cmap))) == ["H\u20acabc\n"]
    broken = pdf([one, two], True).replace(zlib.compress(two), b"x" * len(zlib.compress(two)))
    with pytest.raises(ValueError, match="page 2"):
        list(pages(broken))
    for bad in (b"no pdf", b"%PDF-1.4\n", pdf([one], False) + b"/Encrypt 9 0 R"):
        with pytest.raises(ValueError):
            list(pages(bad))


def test_store_pieces(spark):
    files = spark.createDataFrame([(1, "/a", 5, b"x", "failed", "no"), (2, "/b", 6, b"y", "ok", None)], "id long, path string, modified_at long, file_hash binary, status string, last_error string")
    new = spark.createDataFrame([("/a", 7, b"z"), ("/c", 8, b"w"), ("/c", 8, b"w")], "path string, modified_at long, file_hash binary")
    rows = {r.path: r for r in upsert_files(files, new).collect()}
    assert rows["/a"].id == 1 and rows["/a"].status == "ok" and rows["/a"].last_error is None and rows["/a"].modified_at == 7
    assert rows["/b"].modified_at == 6 and rows["/c"].id > 2 and len(rows) == 3
    old = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id long, file_id long")
    touched = spark.createDataFrame([(1,)], "file_id long")
    assert sorted(r.id for r in replace_children(old, touched, old.limit(0)).collect()) == [12]
    seen = spark.createDataFrame([("/a", 5), ("/b", 7), ("/z", 1)], "path string, modified_at long")
    assert {r.path: r.unchanged for r in unchanged(seen, files).collect()} == {"/a": True, "/b": False, "/z": False}
    assert [r.path for r in missing_files(files, seen.where("path = '/a'")).collect()] == ["/b"]


def test_index_and_search(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("alpha words about harbours\nmore lines\n")
    (src / "b.txt").write_text("beta words about gardens")
    (src / "empty.txt").write_text("")
    (src / "bad.docx").write_bytes(b"no zip")
    store, e = IndexStore(spark, f"file://{tmp_path}/index"), HashEmbedder(32)
    stats = index_directory(spark, str(src), store, e)
    assert (stats["indexed"], stats["errors"], stats["chunks_embedded"]) == (3, 1, 2)
    assert "indexed 3 files" in summary(stats, 0.1)
    assert store.read("files").count() == 3 and store.read("vec_chunks").count() == 2
    again = index_directory(spark, str(src), store, e)
    assert (again["unchanged"], again["indexed"], again["errors"]) == (3, 0, 1)
    (src / "a.md").write_text("alpha gone")
    os.utime(src / "a.md", (1, 1))
    (src / "b.txt").unlink()
    assert index_directory(spark, str(src), store, e)["indexed"] == 1
    assert store.read("chunks").count() == 2  # the deleted file is still there
    results = search(store, "alpha gone", e, Options(max=1))
    assert "a.md:1-1  (score: 1.00)" in printed(results) and "\x1b]8;;file:///" in printed(results, links=True)
    index_directory(spark, str(src), store, e, remove_missing=True)
    assert store.read("chunks").count() == 1 and store.read("vec_chunks").count() == 1
    assert printed(search(store, "x", e, Options(restrict="/nowhere"))) == "no results found"
    assert store.clean() and not store.clean()


def test_media_branch(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(b"png")
    store = IndexStore(spark, f"file://{tmp_path}/index")

    def embed(listing):
        return listing.select("path", F.array([F.lit(0.5)] * 4).cast("array<float>").alias("embedding"), F.lit(b"h").cast("binary").alias("file_hash"), F.lit("clip").alias("model"), F.lit(None).cast("string").alias("error"))

    assert index_directory(spark, str(tmp_path), store, HashEmbedder(8), Rules(text=[]), media=embed)["media_indexed"] == 1
    assert store.read("media_embeddings").first().frame_index == 0 and store.read("vec_media").count() == 1


def test_an_image_that_is_gone_goes_everywhere(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "p.png").write_bytes(b"png")
    store = IndexStore(spark, f"file://{tmp_path}/index")

    def embed(listing):
        return listing.select("path", F.array([F.lit(0.5)] * 4).cast("array<float>").alias("embedding"), F.lit(b"h").cast("binary").alias("file_hash"), F.lit("clip").alias("model"), F.lit(None).cast("string").alias("error"))

    index_directory(spark, str(tmp_path / "src"), store, HashEmbedder(8), media=embed)
    assert [store.read(t).count() for t in ("files", "media_embeddings", "vec_media")] == [1, 1, 1]
    (tmp_path / "src" / "p.png").unlink()
    index_directory(spark, str(tmp_path / "src"), store, HashEmbedder(8), media=embed, remove_missing=True)
    assert [store.read(t).count() for t in ("files", "media_embeddings", "vec_media")] == [0, 0, 0]


def test_a_run_writes_what_it_changes(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for k in range(12):
        (src / f"{k}.md").write_text(f"words of file {k}\n" * 30)
    store, e = IndexStore(spark, f"file://{tmp_path}/index"), HashEmbedder(8)
    index_directory(spark, str(src), store, e)
    chunks = store.read("chunks").count()
    (src / "3.md").write_text("changed")
    os.utime(src / "3.md", (1, 1))
    index_directory(spark, str(src), store, e)
    added = store.manifest()["tables"]
    rows = {t: spark.read.parquet(f"{store.root}/{f[-1]}").count() for t, f in added.items()}
    assert rows == {"files": 1, "chunks": 1, "vec_chunks": 1} and len(added["files"]) == 2
    assert store.read("files").count() == 12 and store.read("chunks").where("content = 'changed'").count() == 1
    before = {t: sorted(map(str, store.read(t).collect())) for t in ("files", "chunks", "vec_chunks")}
    assert len(before["chunks"]) == chunks - chunks // 12 + 1
    store.compact()
    assert {t: sorted(map(str, store.read(t).collect())) for t in before} == before and store.manifest()["touched"] == []
    assert index_directory(spark, str(src), store, e)["unchanged"] == 12 and store.manifest()["version"] == 3  # nothing to publish


def test_below_an_unreadable_folder_nothing_is_missing(spark):
    files = spark.createDataFrame([(1, "/r/a/x"), (2, "/r/b/y"), (3, "/r/bb/z")], "id long, path string")
    seen = spark.createDataFrame([("/r/b", "unreadable"), ("/r/a", "filtered")], "path string, outcome string")
    assert sorted(r.path for r in missing_files(files, seen).collect()) == ["/r/a/x", "/r/bb/z"]


def test_embedder():
    e = HashEmbedder(16)
    v = e.embed(["a b", "", "a b"])
    assert (v[0] == v[2]).all() and abs((v[0] ** 2).sum() - 1) < 1e-6 and not v[1].any()
    import numpy as np

    assert np.allclose(mean_pool(np.array([[[3.0, 4.0], [9.0, 9.0]]]), np.array([[1, 0]])), [[0.6, 0.8]])


def test_config(tmp_path):
    path = str(tmp_path / "c" / "config.toml")
    c = cfg.load(path)
    assert os.path.exists(path) and c.search.max_results == 5 and c.index.max_file_size_mb_by_type["pdf"] == 50
    assert c.db.path == str(tmp_path / "c" / "index")
    assert len(cfg.keys(c)) == 17
    for key in cfg.keys(c):
        cfg.get(c, key)
    cfg.set_value(c, "search.max_results", "9")
    with pytest.raises(ValueError):
        cfg.set_value(c, "search.max_results", "lots")
    with pytest.raises(ValueError):
        cfg.set_value(c, "index.ignore_dirs", "x")
    with pytest.raises(KeyError):
        cfg.get(c, "no.such")
    cfg.save(c, path)
    assert cfg.load(path).search.max_results == 9 and cfg.load(path).index.ignore_dir_markers == ["pyvenv.cfg"]
    (tmp_path / "old.toml").write_text("[embedder]\nbatch_size = 4\n")
    assert cfg.load(str(tmp_path / "old.toml")).search.max_results == 0
    assert cfg.expand_home("~") == os.path.expanduser("~") and cfg.expand_home("~user/x") == "~user/x"


def test_command_line(tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "HOME", str(tmp_path))
    assert cli.parse(["a", "--f", "--g=1=2"]) == (["a"], {"f": "true", "g": "1=2"})
    for bad in (["nope"], ["find"], ["find", "q", "--max=x"], ["index", "a", "b"], ["index", "--recursive=yes"], ["config", "get"], ["find", "q", "--wat"], ["find", "--"]):
        assert cli.main(bad) == 1
    capsys.readouterr()
    assert cli.main(["version"]) == 0 and cli.main(["config", "path"]) == 0 and cli.main(["config", "set", "search.max_results", "7"]) == 0 and cli.main(["config", "get", "search.max_results"]) == 0
    assert capsys.readouterr().out.splitlines()[-1] == "7"
