"""Files, feeds, persisted tables, the engine and streams."""

import json
import zipfile

from pyspark.sql import functions as F

from orrery.plans.engine import Engine
from orrery.sources import feeds, files, tables
from orrery.streaming import ingest


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\r\n\r\n\r\n\r\nbody\n## U\n")
    (tmp_path / "b.txt").write_bytes("汉字文本".encode("gbk"))
    (tmp_path / "c.bin").write_bytes(b"x")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", doc)
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r.source_file: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert got["a.md"].text == "# T\n\nbody\n## U" and got["a.md"].metadata["headings"] == "2"
    assert got["b.txt"].text == "汉字文本"
    assert "unsupported" in got["c.bin"].error and "BadZipFile" in got["e.docx"].error
    assert got["d.docx"].text == "one\n\nx | y" and got["d.docx"].metadata["tables"] == "1"


def test_markdown_scan(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for p, n in (("a.md", 600), ("b.md", 10), ("node_modules/c.md", 600)):
        (tmp_path / p).write_text("x" * n)
    assert [r.path.split("/")[-1] for r in files.scan_markdown(spark, str(tmp_path)).collect()] == ["a.md"]


def test_feed(spark, tmp_path):
    e = "<entry><id>http://x/abs/1234</id><title>A  b</title><summary> text (X 2019) more [1] </summary><published>2024-01-02T00:00:00Z</published><author><name>N</name></author><category term='cs.LG'/></entry>"
    (tmp_path / "f.xml").write_text(f"<feed>{e}</feed>")
    p = feeds.read_atom(spark, str(tmp_path))
    r = p.first()
    assert (r.paper_id, r.title, r.published, r.authors, r.categories) == ("1234", "A b", "2024-01-02", ["N"], ["cs.LG"])
    assert feeds.as_markdown(p).first().body.endswith("## Abstract\n\ntext more\n")


def test_json_tables(spark, tmp_path):
    s = {"version": 4, "spheres": {"a": {"id": "a", "text": "t", "source_file": "f", "connections": {"b": 0.5}}, "b": {"id": "b", "text": "u", "active": False}}}
    (tmp_path / "s.json").write_text(json.dumps(s))
    rows = {r.id: r for r in tables.read_spheres(spark, str(tmp_path / "s.json")).collect()}
    assert rows["a"].level == 2 and rows["a"].active and not rows["b"].active
    assert tables.read_sphere_edges(spark, str(tmp_path / "s.json")).first().dst == "b"
    for ax in ({"('a', 'b')": "forward"}, [["a", "b"]]):
        (tmp_path / "c.json").write_text(json.dumps({"version": 1, "connections": {"a": {"b": 0.5}, "b": {"a": 0.5, "c": 0.2}}, "axon_types": ax}))
        got = {(r.src, r.dst): r.direction for r in tables.read_connections(spark, str(tmp_path / "c.json")).collect()}
        assert got[("b", "a")] == ("forward" if isinstance(ax, dict) else "bidirectional") and got[("b", "c")] is None
    (tmp_path / "r.json").write_text(json.dumps({"version": 1, "mapping": [{"faiss_id": 5, "sphere_id": "a"}]}))
    assert tuple(tables.read_registry(spark, str(tmp_path / "r.json")).first()) == (5, "a")
    (tmp_path / "g.json").write_text(json.dumps({"version": 1, "adjacency": {"a": ["b", "c"]}}))
    assert tables.read_adjacency(spark, str(tmp_path / "g.json")).count() == 2


def test_newer_version_raises(spark, tmp_path):
    import pytest

    (tmp_path / "g.json").write_text(json.dumps({"version": 9, "adjacency": {"a": ["b"]}}))
    with pytest.raises(Exception, match="newer version"):
        tables.read_adjacency(spark, str(tmp_path / "g.json")).collect()


def test_engine(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/kb")
    e = Engine(spark, store=store)
    docs = spark.createDataFrame([(f"Topic {i % 3} about {'gravity waves' if i % 3 else 'neural models'} number {i}.", f"f{i % 4}.md", "note") for i in range(24)], "text string, source_file string, source_type string")
    assert e.upload(docs).count() == 24
    e.save()
    assert e.upload(docs).count() == 0
    e.rebuild(k=3, threshold=0.3)
    assert e.status().first().total == 24
    assert e["edges"].count() > 0 and e["spheres"].where("poincare_norm_source = 'derived'").count() == 24
    hits = e.query("neural models number 3", k=5).collect()
    assert 0 < len(hits) <= 5 and "neural" in hits[0].text
    r = e.ask("neural models number 3").first()
    assert r.error is None and r.reply
    assert e.ask("x y", backend="nope").first().error == "unknown backend: nope"
    assert e.multi("gravity waves", mode="deep").count() > 0
    one = hits[0].id
    e.delete(spark.createDataFrame([(one,)], "id string"))
    assert not e["spheres"].where(F.col("id") == one).first().active and e["vectors"].where(F.col("id") == one).count() == 0
    assert spark.sql("select count(*) c from spheres").first().c == 24


def test_stream_ingest_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docs = spark.createDataFrame([("some text here", "a.md", "x"), ("other text", "b.md", "x")], "text string, source_file string, source_type string")
    docs.write.mode("append").parquet(str(tmp_path / "in"))
    store = tables.Store(spark, f"file://{tmp_path}/kb")
    go = lambda: ingest.run(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    go()
    docs.write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert store.load("spheres").count() == 2


def test_a_writer_that_dies_leaves_the_last_change(spark, tmp_path, monkeypatch):
    """Killed after its tables and before its pointer, or after the pointer's file and before the rename."""
    import pytest

    store = tables.Store(spark, f"file://{tmp_path}/kb")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    store.save_all({"t": rows("a"), "u": rows("x")})

    class Died(Exception):
        pass

    def die(*_):
        raise Died

    real = tables.Store._point
    monkeypatch.setattr(tables.Store, "_point", die)
    with pytest.raises(Died):
        store.save_all({"t": rows("b"), "u": rows("y")})
    assert [r.id for r in store.load("t").collect()] == ["a"]
    monkeypatch.setattr(tables.Store, "_point", real)
    (tmp_path / "kb" / "_1-half.json").write_text('{"t": ["nowhere')
    again = tables.Store(spark, f"file://{tmp_path}/kb")
    again.append({"t": rows("b")})
    assert sorted(r.id for r in again.load("t").collect()) == ["a", "b"] and [r.id for r in again.load("u").collect()] == ["x"]
    again.compact("t")
    assert len(again.current()["t"]) == 1 and again.load("t").count() == 2
    (tmp_path / "kb" / "current-000000000003.json").write_text("{}")
    monkeypatch.setattr(tables.Store, "_pointers", lambda self: [2])
    with pytest.raises(RuntimeError, match="another writer"):
        again.save_all({"t": rows("c")})


def test_ingest_writes_its_own_rows_only(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}/kb")
    docs = lambda *t: spark.createDataFrame([(x, "a.md", "x") for x in t], "text string, source_file string, source_type string")
    batch = ingest.upsert_into(store, parts=3)
    batch(docs("first text"), 0)
    first = store.current()["spheres"]
    batch(docs("first text", "second text"), 1)
    assert store.current()["spheres"][:1] == first and len(store.current()["spheres"]) == 2
    for k in range(2, 5):
        batch(docs(f"text {k}"), k)
    assert len(store.current()["spheres"]) < 4 and store.load("spheres").count() == 5


def test_ingest_is_logged_and_recovered(spark, tmp_path, monkeypatch):
    """An entry that dies before its tables are published leaves nothing; a later start rolls it back."""
    import pytest

    docs = lambda *t: spark.createDataFrame([(x, "a.md", "note") for x in t], "text string, source_file string, source_type string")
    e = Engine(spark, store=tables.Store(spark, f"file://{tmp_path}/kb"))
    assert e.ingest(docs("first of all texts", "second of all texts"), "one").count() == 2
    real = tables.Store.append

    class Died(Exception):
        pass

    def die(self, t, *_):
        if "spheres" in t:
            raise Died
        real(self, t)

    monkeypatch.setattr(tables.Store, "append", die)
    with pytest.raises(Died):
        e.ingest(docs("third of all texts"), "two")
    monkeypatch.setattr(tables.Store, "append", real)
    again = Engine(spark, store=tables.Store(spark, f"file://{tmp_path}/kb"))
    assert [r.entry_id for r in again.recover().collect()] == ["two"]
    assert again.status().first().total == 2 and again["vectors"].count() == 2
    assert {r.entry_id: r.status for r in again.store.load("wal").collect()} == {"one": "done", "two": "rolled_back"}
    assert again.recover().count() == 0
    assert again.ingest(docs("third of all texts"), "three").count() == 1
    later = Engine(spark, store=tables.Store(spark, f"file://{tmp_path}/kb"))
    assert later.status().first().total == 3 and later.recover(hours=-1).count() == 0 and later.store.load("wal").count() == 0


def test_facade(spark, tmp_path):
    import pytest

    e = Engine(spark, store=tables.Store(spark, f"file://{tmp_path}/kb"))
    texts = ["We therefore show that memory falls with sparse attention in this work.", "Sparse attention in this work improves memory by 3.5% and more.", "Nothing of the kind is said in these words."]
    e.upload(spark.createDataFrame([(t, "a.md", "note") for t in texts], "text string, source_file string, source_type string"))
    e.rebuild(k=2, threshold=0.2)
    one = {r.text: r.id for r in e["spheres"].collect()}
    assert [r.id for r in e.list_documents(2, 1).collect()] == sorted(one.values())[1:3]
    assert e.stats().first().total == 3 and e.backends()["offline"] is True
    e.add_connection(one[texts[0]], one[texts[2]], 0.9)
    assert {(r.dst, r.weight) for r in e.connections(one[texts[0]]).collect()} >= {(one[texts[2]], 0.9)}
    assert e.rebuild_connections(threshold=0.2).first().edges > 0
    all_ = e.rebuild_axon().first().axons
    e.rebuild_connections(threshold=0.2)
    assert 0 < e.rebuild_axon(one[texts[0]]).first().axons <= all_
    assert e.calibrate().first().n == 3
    for mode in ("simple", "poincare", "gravity", "deep"):
        assert e.multi("sparse attention memory", k=2, mode=mode).count() > 0
    with pytest.raises(ValueError, match="no such mode"):
        e.multi("x", mode="nope")
    a = e.embed_query("sparse attention")
    assert e.embed_query("sparse attention") is a and e.embed_query.stats()["hits"] >= 1
    assert e.hyde("sparse attention", 2).count() > 0
    e.migrate_texts()
    assert e.status().first().total == 3


def test_rewriting_by_a_model(spark, monkeypatch):
    """Bare and fenced JSON, a second try, and rules where no try can be read."""
    import json

    from orrery.plans import models

    asked = {}

    def model(prompts):
        out = []
        for p in prompts:
            n = asked[p] = asked.get(p, 0) + 1
            good = json.dumps({"title": "T", "summary": "S", "content": "C " + p[-3:], "entities": ["rag", "zeta"], "sections": [{"heading": "h", "content": "c"}]})
            out.append("" if not p else good if "bare" in p else f"Sure:\n```json\n{good}\n```" if "fence" in p else good if "later" in p and n > 1 else "no idea")
        return out

    monkeypatch.setitem(models.BACKENDS, "fake", model)
    docs = spark.createDataFrame([("1", "a bare one", "f.md", "x"), ("2", "a fence two", "f.md", "x"), ("3", "none at all here", "my_note.md", "x")], "id string, text string, source_file string, source_type string")
    got = {r.id: r for r in models.rewrite_full(docs.coalesce(1), "fake").collect()}
    assert [got[i].rewrite_model for i in "123"] == ["fake", "fake", "rule"]
    assert got["1"].title == "T" and got["1"].content == "C one" and got["2"].sections[0].heading == "h" and "zeta" in got["2"].entities
    assert got["3"].title == "my note" and got["3"].content == "none at all here"
    assert {r.rewrite_model for r in models.rewrite_full(docs, "absent").collect()} == {"rule"}
    assert models.available("fake") and not models.available("absent")


def test_session_history_as_state(spark, tmp_path):
    from orrery.streaming import sessions

    rows = [("s", k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(9)] + [("z", 0, "user", "hello")]
    d = spark.createDataFrame(rows, "session_id string, seq int, role string, content string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = ingest.collect_stream(sessions.stream_history(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), 2, None), "history_state", "update")
    assert {r.session_id: r.history for r in out.collect()} == {"s": "Human: t6\n\nAssistant: t7\n\nHuman: t8", "z": "Human: hello"}


def test_query_cache_is_bounded():
    from orrery.plans.models import QueryEmbedder

    e = QueryEmbedder(4, most=8)
    for k in range(20):
        e(f"word{k}")
    assert len(e.cache) <= 8 and e.stats()["misses"] == 20


def test_export_and_restore(spark, tmp_path):
    """All tables as JSON and back, in an engine with a store of its own; concepts have vectors."""
    e = Engine(spark, store=tables.Store(spark, f"file://{tmp_path}/kb"))
    e.upload(spark.createDataFrame([(f"基于注意力机制的神经网络模型。 number {i}", "a.md", "note") for i in range(12)], "text string, source_file string, source_type string"))
    e.rebuild(k=2, threshold=0.3)
    e.rebuild_hierarchy(least=3)
    level = {r.id: r.level for r in e["spheres"].collect()}
    concepts = {i for i, l in level.items() if l == 1}
    assert concepts and concepts <= {r.id for r in e["vectors"].collect()}
    e.export(str(tmp_path / "out"))
    b = Engine(spark, store=tables.Store(spark, f"file://{tmp_path}/other"))
    b.restore(str(tmp_path / "out"))
    assert set(b.tables) == set(e.tables)
    for name in e.tables:
        assert b[name].schema == e[name].schema and sorted(map(str, b[name].collect())) == sorted(map(str, e[name].collect()))
