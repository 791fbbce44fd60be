"""What all parsers write to: a book under construction."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

BLANKS = re.compile(r"[ \t\r\f\v\u00a0]+")
MARKS = re.compile(r"([*`\[\]])")
UNMARKED = re.compile(r"\\([*`\[\]])")
PRIVATE = re.compile(r"\S*[\ue000-\uf8ff]\S*")
EMPTY_BLOCK = dict.fromkeys("type level text ordered depth rows header file alt labels".split())


def tidy(text: str) -> str:
    return BLANKS.sub(" ", text).strip()


def marked(text: str) -> str:
    """Text whose marks of inline markup are escaped."""
    return MARKS.sub(r"\\\1", text)


def joined(text: str, line: str) -> str:
    """A text and the line that goes on with it: a word broken by a soft hyphen is put together, others get a space between."""
    if not text:
        return line
    if re.search(r"[a-zà-ɏ]{2}-\Z", text) and re.match(r"[a-zà-ɏ]", line):
        return text[:-1] + line
    return text + ("" if text.endswith((" ", "\u200b")) else " ") + line


def title_text(text: str) -> str:
    """A title without inline markup."""
    return re.sub(r"\*\*|`", "", UNMARKED.sub(r"\1", text)).strip("* ")


@dataclass
class Book:
    title: str = ""
    author: str = ""
    language: str = ""
    chapters: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    assets: list[dict] = field(default_factory=list)

    def open_chapter(self, title: str = "") -> dict:
        self.chapters.append({"title": tidy(title), "blocks": []})
        return self.chapters[-1]

    def add(self, kind: str, **fields) -> None:
        """Appends a block to the last chapter; texts without content are left out."""
        if "text" in fields and kind != "code":
            fields["text"] = fields["text"].strip()
        if "text" in fields and not fields["text"].strip():
            return
        (self.chapters[-1] if self.chapters else self.open_chapter())["blocks"].append(EMPTY_BLOCK | {"type": kind} | fields)

    def image(self, content: bytes, suffix: str) -> str:
        suffix = (suffix or "png").lower().lstrip(".").replace("jpeg", "jpg")
        name = f"assets/fig_{len(self.assets) + 1:04d}.{suffix}"
        self.assets.append({"file": name, "content": content})
        return name

    def done(self, stem: str = "") -> dict:
        """The parsed record: no empty untitled chapters, the stem as title if there is none, a note on glyphs without meaning."""
        chapters = [c for c in self.chapters if c["blocks"] or c["title"]]
        odd = [w for c in chapters for b in c["blocks"] if b["type"] != "code" for w in PRIVATE.findall(b["text"] or "")]
        if odd:
            self.notes.append(f"{len(odd)} words hold private-use characters, such as {', '.join(odd[:6])}")
        return {"title": self.title or stem.replace("_", " "), "author": self.author, "language": self.language, "notes": self.notes, "chapters": chapters, "assets": self.assets}
