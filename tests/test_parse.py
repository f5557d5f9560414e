import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textweave.functions import parse as p


@pytest.mark.parametrize(
    ("text", "keys"),
    [
        ("---\ntitle: Guide\nlabels: [x, 'y']\nteam: ops\n---\nbody", {"title": "Guide", "labels": "x, y", "team": "ops"}),
        ("---\nnames:\n  - first\n  - \"second\"\n...\n", {"names": "first, second"}),
        ("---\nouter:\n  a: 1\n  b: 2\nlast: yes\n---\n", {"last": "yes"}),
        ("---\n# note\nkey: 1\nkey: 2\nempty:\n  x: 1\n---\n", {"key": "2"}),
        ("---\nopen: 1\n", {}),
        ("---\n: : :\n---\n", {}),
        ("", {}),
        ("no fence\nkey: 1", {}),
    ],
)
def test_frontmatter(text, keys):
    assert p.frontmatter(text) == keys


@pytest.mark.parametrize(
    ("text", "title"),
    [
        ("# Setup\ntext", "Setup"),
        ("== Setup\n", "Setup"),
        ("Setup\n=====\n", "Setup"),
        ("Setup guide\n---\n", ""),
        ("```\n# code\n```\n## Real\n", "Real"),
        ("---\n# key: 1\n---\nplain", ""),
        ("#hashtag\n", ""),
        ("#### \nplain", ""),
        ("*****\nTitle\n*****\n", "Title"),
    ],
)
def test_first_heading(text, title):
    assert p.first_heading(text) == title


def test_sections():
    assert [c.splitlines()[0] for c in p.chunks("intro\n# One\na\n## Two\nb\n")] == ["intro", "# One", "## Two"]
    assert len(p.sections("API\n===\nx\nFAQ\n===\ny\n")) == 2
    assert len(p.sections("# T\n===  ===\na    b\n===  ===\n")) == 1
    over = p.sections("lead\n=======\nDinner!\n=======\nx\n")
    assert over == ["lead\n", "=======\nDinner!\n=======\nx\n"]
    assert p.sections("plain\ntext\n") == []
    fence = "# T\n```\n# inside\n```\nend\n"
    assert p.sections(fence) == [fence]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc .\n#", max_size=60), max_size=40))
def test_chunks_keep_words_and_cap(parts):
    text = "\n\n".join(parts)
    out = p.chunks(text, tokens=10)
    assert all(0 < len(c) <= 40 for c in out)


def test_overlap():
    text = " ".join(f"w{k:03d}" for k in range(100))
    out = p.chunks(text, tokens=10, overlap=0.25)
    assert all(len(c) <= 40 for c in out) and set(" ".join(out).split()) >= set(text.split())
    assert out[1].startswith(out[0][-10:].strip())


@pytest.mark.parametrize(
    ("path", "text", "line"),
    [
        ("a.py", '#!/bin/x\n"""Reads files. Then more."""\n', "Reads files."),
        ("a.py", "# a.py\n# Counts words\nx = 1", "Counts words"),
        ("a.sql", "-- ----\n-- Totals by day\nselect 1", "Totals by day"),
        ("a.js", "/**\n * ignored\n */\nlet x", ""),
        ("a.json", '{"_description": "Settings for runs. Old"}', "Settings for runs."),
        ("a.md", "# Title\n- item\nLead:\nFirst prose here. Second.", "First prose here."),
        ("a.md", "# Title\n**What this is:** A map. Of things.", "A map."),
        ("a.md", "# Only title", "Only title"),
        ("a.bin", "# x", ""),
    ],
)
def test_purpose(path, text, line):
    assert p.purpose(path, text) == line


def test_doc_block():
    assert p.doc_block("a.sh", "#!/bin/sh\n# ====\n# One\n# two\n\n# later") == "One\ntwo"
    assert p.doc_block("a.ts", "/* First\n * second\n */ code") == "First\nsecond"
    assert p.doc_block("a.py", '"""Whole\n\nblock."""') == "Whole\n\nblock."
    assert len(p.doc_block("a.py", '"""' + "x" * 4000 + '"""')) == 1500
    assert p.doc_block("a.md", "# x") == ""
