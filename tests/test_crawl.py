"""A repository is crawled, crawled again, changed, searched and purged, all on temporary folders."""

import json
import subprocess
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from chunkloom import cli
from chunkloom.operators.embedding import hashing_embedder
from chunkloom.plans.crawl import crawl
from chunkloom.sources import config, git
from chunkloom.sources.warehouse import DatabaseError, Warehouse
from chunkloom.streaming.ingest import ARRIVALS, ingest_files, stream_files

EMBED = hashing_embedder(16)


def sh(repo, *args):
    subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", str(repo), *args], check=True, capture_output=True)


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "packages/a/src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "packages/a/package.json").write_text('{"name": "@x/a"}')
    (root / "packages/a/src/one.ts").write_text("export function one() {\n  return 1;\n}\n")
    (root / "README.md").write_text("# Title\n\nSome words.\n\n## Second\n\nMore words.\n")
    (root / "notes.txt").write_text("line one\nline two\n")
    (root / "bad.txt").write_bytes(b"\xff\xfeA")
    (root / "node_modules/skip.ts").write_text("export const no = 1;\n")
    sh(tmp_path, "init", "-q", str(root))
    sh(root, "add", "-A")
    sh(root, "commit", "-qm", "first")
    return root


def table(store):
    return {(r.relative_path, r.chunk_ordinal): r for r in store.chunks().collect()}


def test_life_of_a_label(spark, tmp_path, repo):
    store = Warehouse.create(spark, tmp_path / "db", vector_dim=16)
    go = lambda label, **how: crawl(store, str(repo), "cat", label, EMBED, "e:v1", **how)
    first = go("main", revision="HEAD")
    assert (first.new_files, first.existing_files, first.complete) == (4, 0, True)
    rows = table(store)
    assert set(rows) == {("packages/a/src/one.ts", 1), ("README.md", 1), ("README.md", 2), ("notes.txt", 1)}
    one = rows[("packages/a/src/one.ts", 1)]
    assert (one.package_name, one.breadcrumb, one.active_label_ids, one.file_complete) == ("@x/a", "%40x/a:one.ts:one", ["cat:main"], True)
    assert rows[("README.md", 2)].breadcrumb == "cat:README.md:second" and rows[("notes.txt", 1)].breadcrumb == "notes.txt"

    again = go("next", revision="HEAD")
    assert again.existing_files == 3 and again.chunks == 0
    assert table(store)[("README.md", 1)].active_label_ids == ["cat:main", "cat:next"]

    (repo / "notes.txt").write_text("line three\n")
    (repo / "README.md").unlink()
    (repo / "new.md").write_text("# New\n")
    dirty = go("main")
    assert dirty.new_files == 3 and dirty.removed_chunks == 0
    rows = store.chunks().where(F.array_contains("active_label_ids", "cat:main")).collect()
    assert {r.relative_path for r in rows} == {"packages/a/src/one.ts", "notes.txt", "new.md"}
    labels = {r.label_id: r for r in store.labels().collect()}
    assert labels["cat:main"].source_kind == "working-directory" and labels["cat:main"].commit_oid == "" and labels["cat:next"].crawl_complete

    sh(repo, "checkout", "-q", "--", ".")
    assert go("next", revision="HEAD").removed_chunks == 0
    (repo / "new.md").unlink()
    assert go("main", revision="HEAD").removed_chunks == 2
    assert store.purge("cat") == (4, 2) and store.chunks().count() == 0 and store.labels().count() == 0


def test_failures_leave_a_file_open(spark, tmp_path, repo):
    store = Warehouse.create(spark, tmp_path / "db", vector_dim=16)
    (repo / "empty.md").write_text("# ...\n\n# Words\n")
    sh(repo, "add", "-A")
    sh(repo, "commit", "-qm", "second")
    failed = crawl(store, str(repo), "cat", "main", EMBED, "e:v1", revision="HEAD")
    assert failed.failed_chunks == 1 and not failed.complete
    assert {r.file_complete for r in store.stored_chunks().where("relative_path = 'empty.md'").collect()} == {False}
    assert not store.labels().head().crawl_complete
    assert crawl(store, str(repo), "cat", "main", EMBED, "e:v1", revision="HEAD").existing_files == 3


def test_both_ways_give_the_same_blob_ids(spark, repo):
    commit = git.resolve_commit(str(repo), "HEAD")
    assert len(commit) == 40
    listed = {tuple(r) for r in git.commit_files(spark, str(repo), commit).collect()}
    working = {tuple(r) for r in git.working_files(spark, str(repo)).collect()}
    assert working == listed and len(listed) == 6
    assert git.hash_files(str(repo), []) == []
    assert git.version_at_least("2.35.0") and git.version_at_least("3") and not git.version_at_least("2.34.9")
    with pytest.raises(git.GitError):
        git.resolve_commit(str(repo), "no-such-thing")


def test_database_states(spark, tmp_path):
    with pytest.raises(DatabaseError):
        Warehouse(spark, tmp_path / "absent")
    with pytest.raises(DatabaseError):
        Warehouse.create(spark, tmp_path / "no" / "parent")
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "file").write_text("x")
    with pytest.raises(DatabaseError):
        Warehouse.create(spark, tmp_path / "foreign")
    store = Warehouse.create(spark, tmp_path / "db")
    Warehouse.create(spark, tmp_path / "db")
    meta = json.loads((store.path / "meta.json").read_text())
    (store.path / "meta.json").write_text(json.dumps(meta | {"schema_version": 99}))
    with pytest.raises(DatabaseError, match="99"):
        Warehouse(spark, store.path)
    (store.path / "meta.json").write_text("{")
    with pytest.raises(DatabaseError):
        Warehouse.create(spark, store.path)
    (store.path / "meta.json").unlink()
    with pytest.raises(DatabaseError):
        Warehouse.create(spark, store.path)


def test_warnings_sidecar(spark, tmp_path):
    store = Warehouse.create(spark, tmp_path / "db")
    assert store.load_warnings("cat") == []
    store.save_warnings("cat", ["b", "a", "b"])
    assert store.load_warnings("cat") == ["a", "b"]
    (store.path / "warnings-cat.json").write_text("{")
    assert store.load_warnings("cat") == []


def test_stream(spark, tmp_path):
    store = Warehouse.create(spark, tmp_path / "db", vector_dim=16)
    inbox = str(tmp_path / "inbox")
    how = {"catalog": "cat", "embedder": EMBED, "embedder_id": "e:v1", "checkpoint": str(tmp_path / "progress")}
    for n, text in ((1, "# A\nwords\n"), (2, "# B\nwords\n")):
        spark.createDataFrame([(f"f{n}.md", f"b{n}", None, text), (f"f{n}.md", f"b{n}", None, text)], ARRIVALS).write.mode("append").parquet(inbox)
        stream_files(spark, inbox, store, **how).awaitTermination()
        assert store.stored_chunks().count() == n
    stream_files(spark, inbox, store, **how).awaitTermination()
    assert store.stored_chunks().count() == 2


def test_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv(config.HOME_VARIABLE, str(tmp_path / "home"))
    file = tmp_path / "config.json"
    file.write_text('{ // c\n "catalogs": {"cat": {"type": "monorepo", "path": "/a//b"}}, /* x */ "embeddingModel": {"modelInstances": 2} }')
    found = config.Config.load(file)
    assert found.catalogs == {"cat": "/a/b"} and found.model_instances == 2 and found.database == tmp_path / "home" / "default-db"
    for bad in ('{"catalogs": {"Bad": {"path": "/a"}}}', '{"catalogs": {"a": {"path": "~/a"}}}', '{"catalogs": {}, "more": 1}', "[]", "{", '{"catalogs": {}, "embeddingModel": {"modelInstances": 0}}'):
        file.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.Config.load(file)
    assert config.Context.load() is None
    with pytest.raises(config.ConfigError):
        config.resolve_context("cat", None)
    config.Context("cat", "main").save()
    assert config.resolve_context(None, "x/y") == config.Context("cat", "x/y")
    with pytest.raises(config.ConfigError):
        config.resolve_context(None, "a:b")
    sized = config.Config(model_instances="auto", threads_per_instance=2)
    assert config.resolve_sizing(sized, 8, 64 << 30) == (4, 2) and config.resolve_sizing(config.Config(), 16, 64 << 30) == (4, 4)


def test_command_line(spark, tmp_path, repo, monkeypatch, capsys):
    monkeypatch.setenv(config.HOME_VARIABLE, str(tmp_path / "home"))
    file = tmp_path / "config.json"
    file.write_text(json.dumps({"catalogs": {"cat": {"path": str(repo)}}, "database": {"path": str(tmp_path / "db")}, "embeddingModel": {"vectorDim": 32}}))

    def run(*args, code=0):
        assert cli.main(["--config", str(file), *args]) == code
        return capsys.readouterr().out

    assert "no default" in run("use")
    run("use", "--catalog", "cat", code=1)
    run("search", "--text", "x", code=1)
    run("use", "--catalog", "cat", "--label", "main")
    run("init-db")
    assert "4 new files" in run("crawl", "--label", "main", "--commit", "HEAD")
    assert "README.md" in run("search", "--text", "some words title", "--limit", "1")
    store = Warehouse(spark, tmp_path / "db")
    readme = store.stored_chunks().where("relative_path = 'README.md'").head().file_id
    shown = run("view", "--id", f"{readme}:2", "--id", "0" * 16)
    assert "## Second" in shown and "# Title" not in shown and "CHUNK NOT FOUND" in shown
    dumped = run("dump-chunks", "--file", str(repo / "packages/a/src/one.ts"))
    assert "quality" in dumped and "%40x/a:one.ts:one" in dumped
    assert "one.ts" in run("audit-chunks", "--dir", str(repo / "packages"))
    run("purge", code=1)
    assert "4 chunks" in run("purge", "--catalog", "cat")
    assert "everything" in run("purge", "--all")


def half_blind(text):
    """An embedder that fails on chunks that say so."""
    done = EMBED(text)
    return F.when(text.contains("unreadable"), F.struct(F.lit(None).cast("array<float>").alias("vector"), F.lit("failed").alias("error"))).otherwise(F.struct(done["vector"].alias("vector"), done["error"].alias("error")))


def test_a_stream_that_fails_in_part_loses_nothing(spark, tmp_path, repo):
    store = Warehouse.create(spark, tmp_path / "db", vector_dim=16)
    inbox, failures = str(tmp_path / "inbox"), []
    how = {"catalog": "cat", "embedder_id": "e:v1", "checkpoint": str(tmp_path / "progress")}
    text = "# A\nwords\n# B\nunreadable\n# C\nwords\n# D\nunreadable\n"
    spark.createDataFrame([("f.md", "b1", None, text), ("g.md", "b2", None, "# G\nwords\n")], ARRIVALS).write.parquet(inbox)
    stream_files(spark, inbox, store, embedder=half_blind, failures=failures, **how).awaitTermination()
    rows = table(store)
    assert failures == [(0, 2)] and {k: (r.file_complete, r.active_label_ids) for k, r in rows.items()} == {
        ("f.md", 1): (False, ["cat:arrivals"]), ("f.md", 3): (False, ["cat:arrivals"]), ("g.md", 1): (True, ["cat:arrivals"]),
    }
    assert not store.labels().where("label_id = 'cat:arrivals'").head().crawl_complete
    # a clean crawl of another label leaves them alone
    assert crawl(store, str(repo), "cat", "main", EMBED, "e:v1", revision="HEAD").removed_chunks == 0
    assert {k[0] for k in table(store)} >= {"f.md", "g.md"}
    # the same file, delivered again to an embedder that can, is complete
    spark.createDataFrame([("f.md", "b1", None, text)], ARRIVALS).write.mode("append").parquet(inbox)
    stream_files(spark, inbox, store, embedder=EMBED, **how).awaitTermination()
    assert table(store)[("f.md", 1)].file_complete and len([k for k in table(store) if k[0] == "f.md"]) == 4
    assert store.labels().where("label_id = 'cat:arrivals'").head().crawl_complete


def test_an_interrupted_crawl_goes_on(spark, tmp_path, repo, monkeypatch):
    for i in range(6):
        (repo / f"more{i}.md").write_text(f"# Part {i}\nwords\n")
    sh(repo, "add", "-A")
    sh(repo, "commit", "-qm", "more")
    store = Warehouse.create(spark, tmp_path / "db", vector_dim=16)
    told, real = [], Warehouse.upsert_files

    def breaks(self, chunks):
        if told:
            raise RuntimeError("executor lost")
        real(self, chunks)

    monkeypatch.setattr(Warehouse, "upsert_files", breaks)
    with pytest.raises(RuntimeError):
        crawl(store, str(repo), "cat", "main", EMBED, "e:v1", revision="HEAD", part_files=4, progress=told.append)
    assert len(told) == 1 and "of 10 new files" in told[0]
    monkeypatch.undo()
    written = store.stored_chunks().select("file_id").distinct().count()
    assert 0 < written < 9 and store.membership().count() == 0 and not store.labels().head().crawl_complete
    again = crawl(store, str(repo), "cat", "main", EMBED, "e:v1", revision="HEAD")
    assert again.existing_files == written and again.complete and again.removed_chunks == 0
    assert store.membership().count() == 9


def test_two_writers_take_turns(spark, tmp_path):
    store = Warehouse.create(spark, tmp_path / "db", vector_dim=16)
    how = {"embedder": EMBED, "embedder_id": "e:v1"}
    batches = [spark.createDataFrame([(f"f{n}-{i}.md", f"b{n}-{i}", None, "# A\nwords\n") for i in range(5)], ARRIVALS) for n in range(4)]
    with ThreadPoolExecutor(4) as pool:
        assert [f.result() for f in [pool.submit(ingest_files, Warehouse(spark, store.path), b, "cat", **how) for b in batches]] == [0] * 4
    assert store.stored_chunks().count() == 20 and store.membership().count() == 20
    before = {p.name for p in (store.path / "chunks").iterdir()}
    ingest_files(store, batches[0], "cat", **how)
    assert store.stored_chunks().count() == 20 and {p.name for p in (store.path / "chunks").iterdir()} - before


def test_a_change_that_fails_is_not_seen(spark, tmp_path, monkeypatch):
    from chunkloom.sources import warehouse

    store = Warehouse.create(spark, tmp_path / "db", vector_dim=16)
    one, two = (spark.createDataFrame([("f.md", "b", None, text)], ARRIVALS) for text in ("# A\nwords\n", "# A\nwords\n# B\nmore\n"))
    ingest_files(store, one, "cat", EMBED, "e:v1")
    monkeypatch.setattr(warehouse, "_write_durably", lambda path, text: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest_files(store, two, "cat", EMBED, "e:v1")
    monkeypatch.undo()
    assert store.stored_chunks().count() == 1
    ingest_files(store, two, "cat", EMBED, "e:v1")
    assert store.stored_chunks().count() == 2


def test_rows_are_validated_on_write(spark, tmp_path):
    store = Warehouse.create(spark, tmp_path / "db", vector_dim=16)
    ingest_files(store, spark.createDataFrame([("f.md", "b", None, "# A\nwords\n")], ARRIVALS), "cat", EMBED, "e:v1")
    good = store.stored_chunks()
    for wrong, said in ((good.withColumn("vector", F.array(F.lit(1.0).cast("float"))), "16"), (good.withColumn("chunk_ordinal", F.lit(7)), "ordinal"), (good.withColumn("point_id", F.lit("x")), "point_id"), (good.withColumn("catalog", F.lit("Cat")), "catalog")):
        with pytest.raises(ValueError, match=said):
            store.upsert_files(wrong)
    assert store.stored_chunks().count() == 1


def test_links_are_not_followed(spark, repo):
    (repo / "link.md").symlink_to(repo / "README.md")
    (repo / "fresh.md").symlink_to("/etc/hostname")
    sh(repo, "add", "link.md")
    listed = {r.relative_path for r in git.working_files(spark, str(repo)).collect()}
    assert "README.md" in listed and not listed & {"link.md", "fresh.md"}
    read = git.with_contents(spark.createDataFrame([("link.md", "x"), ("README.md", "y")], git.FILES), str(repo), working_tree=True)
    assert {r.relative_path: r.content is None for r in read.collect()} == {"link.md": True, "README.md": False}
