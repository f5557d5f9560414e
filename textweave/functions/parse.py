"""Parsers for single documents: plain Python, to be called from Arrow functions.

They follow Python's notion of lines and white space, which Java's regular expressions do not share.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KEY_LINE = re.compile(r"([A-Za-z0-9_.\-]+):\s?(.*)")
HASH_HEADING = re.compile(r" {0,3}(?:#{1,6}|={1,6})[ \t]")
NO_TITLE = re.compile(r"[ \t#=]*")
ADORNMENT = re.compile(r" {0,3}([=\-~^\"'#*+.:`<>_])\1+\s*")
FENCE = re.compile(r" {0,3}(?:`{3,}|~{3,})")
SPLITS = ("\n\n", "\n", ". ", " ")
PURPOSE_CHARS, DOC_CHARS = 200, 1500
SLASHES = {".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".go", ".rs"}
HASHES = {".py", ".sh", ".bash", ".zsh", ".toml", ".yml", ".yaml", ".rb"}


# -- frontmatter --------------------------------------------------------------------------------
def frontmatter_block(text: str) -> str | None:
    """Text between the opening fence and its end; None without a closed fence."""
    if not text.startswith("---"):
        return None
    lines = text.splitlines(keepends=True)
    if lines[0].strip() != "---":
        return None
    closing = next((k for k, line in enumerate(lines) if k and line.strip() in ("---", "...")), None)
    return None if closing is None else "".join(lines[1:closing])


def _bare(value: str) -> str:
    value = value.strip()
    quoted = len(value) > 1 and value[0] in "'\"" and value[-1] == value[0]
    return value[1:-1] if quoted else value


def frontmatter(text: str) -> dict[str, str]:
    """Flat keys and values: scalars, inline lists and block lists; all else gives no entry."""
    out: dict[str, str] = {}
    pending: tuple[str, list[str]] | None = None

    def close() -> None:
        nonlocal pending
        if pending and any(pending[1]):
            out[pending[0]] = ", ".join(x for x in pending[1] if x)
        pending = None

    for raw in (frontmatter_block(text) or "").splitlines():
        if raw[:1] in (" ", "\t"):
            item = raw.strip()
            if pending and item.startswith("-"):
                pending[1].append(_bare(item[1:]))
            continue
        close()
        line = raw.rstrip()
        m = None if not line or line.startswith("#") else KEY_LINE.fullmatch(line)
        if m is None:
            continue
        key, value = m[1], m[2].strip()
        if not value:
            pending = (key, [])
            continue
        if value[0] == "[" and value[-1] == "]":
            value = ", ".join(filter(None, map(_bare, value[1:-1].split(","))))
        else:
            value = _bare(value)
        if value:
            out[key] = value
    close()
    return out


# -- headings and sections ----------------------------------------------------------------------
def is_prefix_heading(line: str) -> bool:
    return bool(HASH_HEADING.match(line)) and not NO_TITLE.fullmatch(line.rstrip("\r\n"))


def is_adornment(line: str) -> bool:
    return bool(ADORNMENT.fullmatch(line))


def _can_be_title(line: str) -> bool:
    return bool(line.strip()) and not is_adornment(line) and not is_prefix_heading(line)


def _open_lines(lines: list[str]):
    """(number, line) outside of fences and of leading frontmatter; None for the lines inside."""
    front = fence = False
    for k, line in enumerate(lines):
        mark = line.strip() == "---"
        if front or (k == 0 and mark):
            front = not (front and mark)
            yield k, None
        elif FENCE.match(line):
            fence = not fence
            yield k, None
        else:
            yield k, None if fence else line


def first_heading(text: str) -> str:
    lines = text.splitlines()
    for k, line in _open_lines(lines):
        if line is None:
            continue
        if is_prefix_heading(line):
            return line.strip().lstrip("#=").strip()
        if k and is_adornment(line) and _can_be_title(lines[k - 1].strip()) and len(line.strip()) >= len(lines[k - 1].strip()):
            return lines[k - 1].strip()
    return ""


@dataclass
class _Sections:
    done: list[str] = field(default_factory=list)
    body: list[str] = field(default_factory=list)
    headed: bool = False

    def begin(self, head: list[str]) -> None:
        self.finish()
        self.body, self.headed = head, True

    def finish(self) -> None:
        whole = "".join(self.body)
        if whole.strip():
            self.done.append(whole)


def sections(text: str) -> list[str]:
    """Sections with their headings, preamble first; none when there is no heading."""
    s = _Sections()
    lines = text.splitlines(keepends=True)
    for k, line in _open_lines(lines):
        if line is None:
            s.body.append(lines[k])
        elif is_prefix_heading(line):
            s.begin([line])
        elif s.body and is_adornment(line) and _can_be_title(s.body[-1]) and len(line.strip()) >= len(s.body[-1].strip()):
            head = [s.body.pop(), line]
            if s.body and is_adornment(s.body[-1]) and s.body[-1].strip()[0] == line.strip()[0]:
                head.insert(0, s.body.pop())
            s.begin(head)
        else:
            s.body.append(line)
    s.finish()
    return s.done if s.headed else []


# -- chunks ---------------------------------------------------------------------------------------
def atoms(text: str, limit: int, level: int = 0) -> list[str]:
    """Pieces of at most limit characters, cut at the coarsest separator that does."""
    if not text.strip():
        return []
    if len(text) <= limit:
        return [text]
    while level < len(SPLITS) and SPLITS[level] not in text:
        level += 1
    if level == len(SPLITS):
        return [p for p in (text[k : k + limit] for k in range(0, len(text), limit)) if p.strip()]
    return [a for part in text.split(SPLITS[level]) for a in atoms(part, limit, level + 1)]


def windows(pieces: list[str], limit: int, overlap: int) -> list[str]:
    """Pieces joined by spaces up to limit; each window begins with the end of the one before."""
    out: list[str] = []
    for piece in pieces:
        if out and out[-1] and len(out[-1]) + 1 + len(piece) <= limit:
            out[-1] += f" {piece}"
            continue
        room = limit - 1 - len(piece)
        lead = out[-1][-min(overlap, room) :] if out and overlap and room > 0 else ""
        out.append(f"{lead} {piece}".strip() if lead else piece)
    return [w for w in out if w.strip()]


def chunks(text: str, tokens: int = 512, overlap: float = 0.15) -> list[str]:
    """Section-bounded chunks of at most 4 * tokens characters."""
    cap = 4 * max(1, tokens)
    lap = int(cap * min(max(overlap, 0.0), 0.49))
    parts = sections(text or "")
    if not parts:
        return windows(atoms(text or "", cap), cap, lap)
    out: list[str] = []
    for part in parts:
        out += [part.strip()] if len(part) <= cap else windows(atoms(part, cap), cap, lap)
    return [c for c in out if c.strip()]


# -- purpose and doc blocks -----------------------------------------------------------------------
def _extension(path: str) -> str:
    return "." + path.rsplit(".", 1)[1].lower() if "." in path else ""


def _marker(path: str) -> str | None:
    ext = _extension(path)
    return "//" if ext in SLASHES else "--" if ext == ".sql" else "#" if ext in HASHES else None


def _lettered(s: str) -> bool:
    return any("a" <= ch <= "z" for ch in s.lower())


def first_sentence(text: str) -> str:
    flat = " ".join(text.split()).strip("*_`#>").strip()
    m = re.match(r".+?[.!?](?=\s|$)", flat)
    return (m[0] if m else flat)[:PURPOSE_CHARS].rstrip()


def _docstring(path: str, text: str) -> str:
    if _extension(path) != ".py":
        return ""
    if text.startswith("#!"):
        text = text.partition("\n")[2]
    m = re.match(r"(?s)[\n \t]*(?:\"{3}|'{3})(.*?)(?:\"{3}|'{3})", text)
    return m[1].strip() if m else ""


def _description(text: str) -> str:
    m = re.search(r'"_description"\s*:\s*"([^"]+)"', text)
    return m[1] if m else ""


def _prose_purpose(text: str) -> str:
    if text.startswith("---") and (end := text.find("\n---", 3)) >= 0:
        text = text[text.find("\n", end + 1) + 1 :]
    if m := re.search(r"(?m)^\*\*What this is:?\*\*\s*(.+)$", text):
        return first_sentence(m[1])
    title = ""
    for line in filter(None, map(str.strip, text.splitlines())):
        if line[0] == "#":
            title = title or line.lstrip("#").strip()
        elif not (line.startswith(("- ", "* ", "> ", "|", "---", "**", "```")) or line[-1] == ":" or re.match(r"\d+[.)]\s", line)):
            return first_sentence(line)
    return first_sentence(title) if title else ""


def purpose(path: str, text: str) -> str:
    """One line that says what a file is for; empty if it has none."""
    ext = _extension(path)
    if ext in (".md", ".markdown"):
        return _prose_purpose(text)
    if ext == ".json":
        return first_sentence(_description(text)) if _description(text) else ""
    mark = _marker(path)
    if mark is None:
        return ""
    if doc := _docstring(path, text):
        return first_sentence(doc.splitlines()[0])
    name = path.rsplit("/", 1)[-1].lower()
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#!"):
            continue
        if line.startswith("/*"):
            said = line.lstrip("/*").strip()
            if _lettered(said):
                return first_sentence(said)
        elif line.startswith(mark):
            said = line[len(mark) :].strip()
            if _lettered(said) and said.lower() != name:
                return first_sentence(said)
        elif line[0] != "*":
            break
    return ""


def _comment_lines(text: str, mark: str):
    """The letters-bearing lines of the leading comment, cleaned."""
    boxed = begun = False
    for line in map(str.strip, text.splitlines()):
        if boxed or line.startswith("/*"):
            said, closed, _ = line.partition("*/")
            yield said.strip(" *") if boxed else said.lstrip("/*").strip()
            boxed = begun = True
            if closed:
                return
        elif line.startswith("#!") and not begun or not line and not begun:
            continue
        elif line.startswith(mark):
            begun = True
            yield line[len(mark) :].strip()
        else:
            return


def doc_block(path: str, text: str, most: int = DOC_CHARS) -> str:
    """The whole leading documentation of a code file."""
    if _extension(path) == ".json":
        block = _description(text)
    elif (mark := _marker(path)) is None:
        block = ""
    else:
        block = _docstring(path, text) or "\n".join(filter(_lettered, _comment_lines(text, mark))).strip()
    return block[:most].rstrip()
