import json
import os
import sqlite3
import subprocess

import pytest

from textweave.plans import cli, find, index
from textweave.plans.config import NAME, find_root, load_config
from textweave.sources import schemas, tree


def repo(path, settings, files):
    (path / NAME).write_text(settings)
    for name, body in files.items():
        p = path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body, encoding="utf-8")
    return load_config(path)


@pytest.fixture
def corpus(tmp_path):
    con = sqlite3.connect(tmp_path / "shop.db")
    con.execute("CREATE TABLE orders_archive (order_ref, secret_note)")
    con.execute("INSERT INTO orders_archive VALUES (1, 'hunter2')")
    con.commit()
    con.close()
    return repo(tmp_path, 'databases = ["shop.db"]\ninclude_gitignored = true\n', {
        "docs/deploy.md": "---\nowner: ops\n---\n# Deploy\nHow to deploy the garmin ingest to production\n",
        "docs/other.md": "# Other\nNothing but résumé text\n",
        "src/tool.py": '"""Rotates the logs every night."""\nprint("garmin")\n',
        "node_modules/x.md": "# skipped\n",
    })


def names(df):
    return {r.relpath for r in df.select("relpath").collect()}


def test_build_find_refresh(spark, corpus, tmp_path):
    assert index.build(spark, corpus)[:3] == (2, 1, 1)
    stored = index.current(spark, corpus)
    assert names(stored.table("docs")) == {"docs/deploy.md", "docs/other.md", "src/tool.py", "shop.db :: orders_archive"}
    assert "hunter2" not in str(stored.table("docs").collect())
    assert names(index.with_frontmatter(stored, "owner", "ops")) == {"docs/deploy.md"}
    hit = find.search(stored, corpus, "deploying garmin", lexical_only=True).first()
    assert hit.relpath == "docs/deploy.md" and hit.title == "Deploy" and "garmin" in hit.snippet
    assert find.search(stored, corpus, "resume", lexical_only=True).first().relpath == "docs/other.md"
    assert find.search(stored, corpus, "rotate logs").first().relpath == "src/tool.py"
    assert find.search(stored, corpus, "order_ref", lexical_only=True).first().kind == "db-table"
    assert index.refresh(spark, corpus)[:2] == (0, 0)
    assert index.current(spark, corpus).path == stored.path
    (tmp_path / "docs/other.md").write_text("# Other\nNow about tulips and more\n")
    (tmp_path / "docs/new.md").write_text("# New\nfresh\n")
    os.remove(tmp_path / "src/tool.py")
    assert index.refresh(spark, corpus)[:2] == (2, 1)
    stored = index.current(spark, corpus)
    assert names(stored.table("docs")) == {"docs/deploy.md", "docs/other.md", "docs/new.md", "shop.db :: orders_archive"}
    assert find.search(stored, corpus, "tulips", lexical_only=True).count() == 1
    assert find.search(stored, corpus, "rotates logs night").where("relpath = 'src/tool.py'").isEmpty()
    os.utime(tmp_path / "docs/new.md", (1, 1))
    assert index.refresh(spark, corpus)[:2] == (0, 0)
    assert index.current(spark, corpus).table("files").where("relpath = 'docs/new.md'").first().mtime == 1
    index.compact(spark, corpus)
    assert index.current(spark, corpus).table("docs").count() == 4
    index.current(spark, corpus).register()
    assert spark.sql("SELECT count(*) FROM corpus_docs").first()[0] == 4


def test_size_limit(spark, corpus, tmp_path):
    corpus.max_bytes = 90
    index.build(spark, corpus)
    (tmp_path / "docs/other.md").write_text("# Other\n" + "long " * 50)
    index.refresh(spark, corpus)
    assert "docs/other.md" not in names(index.current(spark, corpus).table("docs"))
    assert index.refresh(spark, corpus)[:2] == (0, 0)


def test_commands(spark, corpus, tmp_path, capsys):
    root = ["--root", str(tmp_path)]
    assert cli.main([*root, "index", "--full", "--compact"], spark) == 0
    assert cli.main([*root, "find", "garmin", "--json", "--lexical"], spark) == 0
    assert "docs/deploy.md" in capsys.readouterr().out
    assert cli.main([*root, "find", "zzzqqq", "--lexical"], spark) == 1
    assert cli.main([*root, "lint"], spark) == 0
    (tmp_path / "docs/void.md").write_text("")
    assert cli.main([*root, "lint", "--strict"], spark) == 1 and cli.main([*root, "lint", "--json"], spark) == 0
    gold = tmp_path / "gold.jsonl"
    gold.write_text(json.dumps({"query": "deploy garmin", "gold": "docs/deploy.md", "class": "exact"}) + "\n")
    capsys.readouterr()
    assert cli.main([*root, "bench", str(gold), "--json"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert all(report["arms"][a]["overall"]["recall"] == 1 for a in ("grep", "lexical", "hybrid"))
    assert "recall@8" in find.format_report(report)


def test_init(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["--root", str(tmp_path), "init"]) == 0
    assert (tmp_path / NAME).exists() and ".textweave/" in (tmp_path / ".gitignore").read_text()
    assert find_root(tmp_path) == tmp_path


def test_walk(tmp_path):
    c = repo(tmp_path, 'doc_exts = [".md", ".py"]\nskip_files = ["b.md"]\n', {"a.md": "x", "b.md": "x", "_T.md": "x", ".h.md": "x", "c.PY": "x", "i.md": "x", ".gitignore": "i.md\n"})
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    got = {r[0]: r[1] for r in tree.walk(c)}
    assert got == {"a.md": "md", "_T.md": "md", ".h.md": "md", "c.PY": "code", "i.md": "md"}
    notes = []
    assert tree.allowed(c, notes) is None and notes
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    assert "i.md" not in {r[0] for r in tree.walk(c)}
    with pytest.raises(ValueError, match="doc_exts"):
        repo(tmp_path, 'doc_exts = "md"\n', {})
    assert repo(tmp_path, "not toml [", {}).doc_exts == (".md",)


def test_discover(tmp_path):
    for name in ("real.db", "copy.bak.db", "own.sqlite"):
        con = sqlite3.connect(tmp_path / name)
        con.execute("CREATE TABLE t (a)")
        con.close()
    (tmp_path / "fake.db").write_text("no")
    assert schemas.discover(str(tmp_path), own=str(tmp_path / "own.sqlite")) == [("real.db", 1)]
