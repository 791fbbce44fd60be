"""Books as EPUB and DOCX: one row of bytes for each book, built where the book's group lies."""

from __future__ import annotations

import hashlib
import html
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import inline, languages
from .html import FIELDS, STYLE, chapter_body

MEDIA = {"png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}
XHTML, OPS, OPF = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops", "http://www.idpf.org/2007/opf"
NCX, DC = "http://www.daisy.org/z3986/2005/ncx/", "http://purl.org/dc/elements/1.1/"
#: A package without a clock in it, so that one book always gives the same bytes.
STAMP = (1980, 1, 1, 0, 0, 0)


def _zipped(files: dict[str, str | bytes], stored: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, STAMP), data, zipfile.ZIP_STORED if name == stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def closed(fragment: str) -> str:
    return re.sub(r"<(img|hr|br)([^>]*?)(?<!/)>", r"<\1\2/>", fragment)


def epub(book: dict, lang: dict, modified: str = "1980-01-01T00:00:00Z") -> bytes:
    """An EPUB 3 package of a gathered book, with an NCX for older readers."""
    e, plain = html.escape, inline.plain
    code, way, title = lang["code"], lang["dir"], e(plain(book["title"]))
    uid = "urn:sha256:" + hashlib.sha256(repr((book["book_id"], book["title"])).encode()).hexdigest()[:32]
    page = lambda head, body: f'<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="{XHTML}" xmlns:epub="{OPS}" lang="{code}" xml:lang="{code}" dir="{way}"><head><title>{head}</title><link rel="stylesheet" href="style.css"/></head><body>{body}</body></html>'
    author = f'<div class="author">{e(book["author"])}</div>' if book["author"] else ""
    texts = {"cover": page(title, f'<section class="cover"><h1>{closed(inline.to_html(book["title"]))}</h1>{author}</section>')}
    entries = []
    for i, chapter in enumerate(book["chapters"], 1):
        name = f"ch{i:03d}"
        head = f'<h1 class="chapter">{inline.to_html(chapter["title"])}</h1>' if chapter["title"] else ""
        texts[name] = page(e(plain(chapter["title"])) or title, closed(head + chapter_body(chapter["blocks"], way == "rtl")))
        if chapter["title"]:
            entries.append((f"{name}.xhtml", e(plain(chapter["title"]))))
    label = e(plain(book["toc"]))
    nav = page(label, f'<nav epub:type="toc" id="toc"><h1>{label}</h1><ol>' + "".join(f'<li><a href="{f}">{t}</a></li>' for f, t in entries) + "</ol></nav>")
    points = "".join(f'<navPoint id="n{i}" playOrder="{i}"><navLabel><text>{t}</text></navLabel><content src="{f}"/></navPoint>' for i, (f, t) in enumerate(entries, 1))
    ncx = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="{NCX}" version="2005-1"><head><meta name="dtb:uid" content="{uid}"/></head><docTitle><text>{title}</text></docTitle><navMap>{points}</navMap></ncx>'
    images = {k: v for k, v in book["assets"].items() if any(b["type"] == "figure" and b["file"] == k for c in book["chapters"] for b in c["blocks"])}
    item = lambda i, href, kind, more="": f'<item id="{i}" href="{href}" media-type="{kind}"{more}/>'
    manifest = [item("nav", "nav.xhtml", "application/xhtml+xml", ' properties="nav"'), item("ncx", "toc.ncx", "application/x-dtbncx+xml"), item("css", "style.css", "text/css")]
    manifest += [item(n, f"{n}.xhtml", "application/xhtml+xml") for n in texts]
    manifest += [item(f"img{i}", f, MEDIA.get(f.rsplit(".", 1)[-1], "image/png")) for i, f in enumerate(images)]
    creator = f"<dc:creator>{e(book['author'])}</dc:creator>" if book["author"] else ""
    turn = ' page-progression-direction="rtl"' if way == "rtl" else ""
    opf = (
        f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="{OPF}" version="3.0" unique-identifier="bookid" xml:lang="{code}" dir="{way}"><metadata xmlns:dc="{DC}">'
        f'<dc:identifier id="bookid">{uid}</dc:identifier><dc:title>{title}</dc:title><dc:language>{code}</dc:language>{creator}<meta property="dcterms:modified">{modified}</meta></metadata>'
        f"<manifest>{''.join(manifest)}</manifest><spine toc=\"ncx\"{turn}>{''.join(f'<itemref idref=\"{n}\"/>' for n in texts)}</spine></package>"
    )
    container = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    files: dict[str, str | bytes] = {"mimetype": "application/epub+zip", "META-INF/container.xml": container, "OEBPS/content.opf": opf, "OEBPS/nav.xhtml": nav, "OEBPS/toc.ncx": ncx, "OEBPS/style.css": STYLE}
    files |= {f"OEBPS/{n}.xhtml": t for n, t in texts.items()} | {f"OEBPS/{f}": bytes(data) for f, data in images.items()}
    return _zipped(files, "mimetype")


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
# Styles by id: name, properties of paragraphs and of runs.
STYLES = {
    "Normal": ("Normal", "", ""),
    "Title": ("Title", '<w:jc w:val="center"/>', '<w:b/><w:bCs/><w:sz w:val="56"/><w:szCs w:val="56"/>'),
    **{f"Heading{k}": (f"heading {k}", f'<w:keepNext/><w:outlineLvl w:val="{k - 1}"/>', f'<w:b/><w:bCs/><w:sz w:val="{38 - 4 * k}"/><w:szCs w:val="{38 - 4 * k}"/>') for k in range(1, 5)},
    "Quote": ("Quote", '<w:ind w:left="567"/>', "<w:i/><w:iCs/>"),
    "Caption": ("caption", '<w:jc w:val="center"/>', '<w:sz w:val="18"/>'),
    "CodeBlock": ("Code Block", '<w:shd w:val="clear" w:fill="F5F5F5"/>', '<w:rFonts w:ascii="Consolas" w:hAnsi="Consolas" w:cs="Consolas"/><w:sz w:val="18"/>'),
    "Note": ("Note", '<w:shd w:val="clear" w:fill="FFF8DC"/>', ""),
    "ListBullet": ("List Bullet", '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>', ""),
    "ListNumber": ("List Number", '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="2"/></w:numPr>', ""),
}


#: Pictures are shown at this many pixels an inch, enlarged so, and at most so many centimetres wide; a centimetre has so many units.
PICTURE_DPI, PICTURE_SCALE, PICTURE_WIDTH, UNITS = 200, 1.4, 15.5, 360_000


def picture_size(content: bytes) -> tuple[int, int] | None:
    """Width and height in pixels of a PNG, GIF or JPEG file; None for others."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:4] == b"GIF8" and len(content) >= 10:
        return struct.unpack("<HH", content[6:10])
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 9 <= len(content) and content[at] == 0xFF:
        kind, size = struct.unpack(">BH", content[at + 1 : at + 4])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
            return struct.unpack(">HH", content[at + 5 : at + 9])[::-1]
        at += 2 + size
    return None


class Docx:
    """A word processor's document; properties are written in the order that the format's schema asks for."""

    def __init__(self, lang: dict, assets: dict[str, bytes] | None = None) -> None:
        self.rtl, self.code, self.body, self.links, self.images = lang["dir"] == "rtl", lang["code"], [], [], []
        self.assets = assets or {}

    def run(self, text: str, bold: bool = False, italic: bool = False, code: bool = False, rtl: bool = False) -> str:
        properties = ('<w:rFonts w:ascii="Consolas" w:hAnsi="Consolas" w:cs="Consolas"/>' if code else "") + ("<w:b/><w:bCs/>" if bold else "") + ("<w:i/><w:iCs/>" if italic else "") + ("<w:rtl/>" if rtl else "")
        return f'<w:r><w:rPr>{properties}</w:rPr><w:t xml:space="preserve">{html.escape(text, quote=False)}</w:t></w:r>'

    def runs(self, text: str) -> str:
        out = []
        for r in inline.parse(text):
            parts = inline.split_rtl(r.text) if self.rtl and not r.code else [(r.text, False)]
            x = "".join(self.run(t, r.b, r.i, r.code, d) for t, d in parts)
            if r.url:
                self.links.append(r.url)
                x = f'<w:hyperlink r:id="link{len(self.links)}">{x}</w:hyperlink>'
            out.append(x)
        return "".join(out)

    def paragraph(self, inner: str, style: str = "Normal", level: int | None = None, ltr: bool = False, extra: str = "", before: str = "") -> str:
        numbered = f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{2 if style == "ListNumber" else 1}"/></w:numPr>' if level is not None else ""
        bidi = "<w:bidi/>" if self.rtl and not ltr else ""
        return f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{before}{numbered}{bidi}{extra}</w:pPr>{inner}</w:p>'

    def table(self, rows: list[list[str]]) -> str:
        width = max(map(len, rows), default=0)
        visual = "<w:bidiVisual/>" if self.rtl else ""
        sides = "".join(f'<w:{s} w:val="single" w:sz="4" w:color="999999"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
        cell = lambda c: f"<w:tc><w:tcPr><w:tcW w:w=\"0\" w:type=\"auto\"/></w:tcPr>{self.paragraph(self.runs(c))}</w:tc>"
        body = "".join("<w:tr>" + "".join(map(cell, [*r, *[""] * (width - len(r))])) + "</w:tr>" for r in rows)
        return f'<w:tbl><w:tblPr>{visual}<w:tblW w:w="0" w:type="auto"/><w:tblBorders>{sides}</w:tblBorders></w:tblPr><w:tblGrid>{"<w:gridCol/>" * width}</w:tblGrid>{body}</w:tbl>'

    def picture(self, file: str, alt: str) -> str | None:
        """The run of a picture; None where there is none, or none whose size can be told."""
        content = bytes(self.assets.get(file) or b"")
        size = picture_size(content)
        if not size or not all(size):
            return None
        self.images.append((f"media/image{len(self.images) + 1}.{file.rsplit('.', 1)[-1].lower()}", content))
        n, width = len(self.images), min(PICTURE_WIDTH, size[0] / PICTURE_DPI * 2.54 * PICTURE_SCALE)
        extent = f'cx="{round(width * UNITS)}" cy="{max(1, round(width * UNITS * size[1] / size[0]))}"'
        named = f'id="{n}" name="{html.escape(file)}" descr="{html.escape(alt)}"'
        drawing = "http://schemas.openxmlformats.org/drawingml/2006"
        shape = (
            f'<pic:pic xmlns:pic="{drawing}/picture"><pic:nvPicPr><pic:cNvPr {named}/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="image{n}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
            f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {extent}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic>'
        )
        return (
            f'<w:r><w:drawing><wp:inline xmlns:wp="{drawing}/wordprocessingDrawing"><wp:extent {extent}/><wp:docPr {named}/>'
            f'<a:graphic xmlns:a="{drawing}/main"><a:graphicData uri="{drawing}/picture">{shape}</a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
        )

    def add(self, b: dict) -> None:
        kind, text = b["type"], b.get("text") or ""
        if kind == "heading":
            self.body.append(self.paragraph(self.runs(text), f"Heading{min(max(int(b.get('level') or 2), 1) + 1, 4)}"))
        elif kind == "item":
            self.body.append(self.paragraph(self.runs(text), "ListNumber" if b.get("ordered") else "ListBullet", min(int(b.get("depth") or 0), 2)))
        elif kind == "code":
            self.body += [self.paragraph(self.run(line), "CodeBlock", ltr=True) for line in text.split("\n")]
        elif kind == "table":
            self.body += [self.table([list(r) for r in (b["rows"] if b.get("rows") is not None else [])]), self.paragraph("")]
        elif kind == "figure":
            shown = self.picture(b.get("file") or "", inline.plain(b.get("alt"))) or self.run(f"[{b.get('alt') or b.get('file') or ''}]")
            self.body.append(self.paragraph(shown, extra='<w:jc w:val="center"/>'))
        elif kind == "rule":
            self.body.append(self.paragraph(self.run("* * *"), extra='<w:jc w:val="center"/>'))
        else:
            self.body.append(self.paragraph(self.runs(text), {"quote": "Quote", "caption": "Caption", "note": "Note"}.get(kind, "Normal")))

    def packed(self, title: str, author: str) -> bytes:
        styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"{" w:default=\"1\"" if i == "Normal" else ""}><w:name w:val="{n}"/><w:pPr>{p}</w:pPr><w:rPr>{r}</w:rPr></w:style>' for i, (n, p, r) in STYLES.items())
        levels = lambda kind, text: "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{text.format(k + 1)}"/><w:pPr><w:ind w:left="{567 * (k + 1)}" w:hanging="283"/></w:pPr></w:lvl>' for k in range(3))
        numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="0">{levels("bullet", "•")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{levels("decimal", "%{}.")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        relations = "".join(f'<Relationship Id="link{i}" Type="{kind}/hyperlink" Target="{html.escape(u)}" TargetMode="External"/>' for i, u in enumerate(self.links, 1))
        relations += "".join(f'<Relationship Id="{n}" Type="{kind}/{n}" Target="{n}.xml"/>' for n in ("styles", "numbering"))
        relations += "".join(f'<Relationship Id="image{n}" Type="{kind}/image" Target="{name}"/>' for n, (name, _) in enumerate(self.images, 1))
        pictures = "".join(f'<Default Extension="{x}" ContentType="{MEDIA.get(x, "image/png")}"/>' for x in sorted({name.rsplit(".", 1)[-1] for name, _ in self.images}))
        top, pkg = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n', "http://schemas.openxmlformats.org/package/2006"
        word = "application/vnd.openxmlformats-officedocument.wordprocessingml"
        types = f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{pictures}<Override PartName="/word/document.xml" ContentType="{word}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{word}.styles+xml"/><Override PartName="/word/numbering.xml" ContentType="{word}.numbering+xml"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>'
        core = f'<cp:coreProperties xmlns:cp="{pkg}/metadata/core-properties" xmlns:dc="{DC}"><dc:title>{html.escape(title)}</dc:title><dc:creator>{html.escape(author)}</dc:creator><dc:language>{self.code}</dc:language></cp:coreProperties>'
        section = f'<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1418" w:right="1418" w:bottom="1418" w:left="1418" w:header="709" w:footer="709" w:gutter="0"/>{"<w:bidi/>" if self.rtl else ""}</w:sectPr>'
        return _zipped(
            {
                "[Content_Types].xml": top + types,
                "_rels/.rels": top + f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="doc" Type="{kind}/officeDocument" Target="word/document.xml"/><Relationship Id="core" Type="{pkg}/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>',
                "docProps/core.xml": top + core,
                "word/document.xml": top + f"<w:document {W}><w:body>{''.join(self.body)}{section}</w:body></w:document>",
                "word/styles.xml": top + f"<w:styles {W}>{styles}</w:styles>",
                "word/numbering.xml": top + numbering,
                "word/_rels/document.xml.rels": top + f'<Relationships xmlns="{pkg}/relationships">{relations}</Relationships>',
                **{f"word/{name}": content for name, content in self.images},
            }
        )


def docx(book: dict, lang: dict) -> bytes:
    out, plain = Docx(lang, book["assets"]), inline.plain
    out.body.append(out.paragraph(out.runs(book["title"]), "Title"))
    if plain(book["title_src"]) != plain(book["title"]):
        out.body.append(out.paragraph(out.run(plain(book["title_src"])), ltr=True, extra='<w:jc w:val="center"/>'))
    if book["author"]:
        out.body.append(out.paragraph(out.run(book["author"]), extra='<w:jc w:val="center"/>'))
    out.body.append(out.paragraph(out.runs(book["toc"]), "Normal"))
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText xml:space="preserve"> TOC \\o "1-1" \\h </w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    out.body.append(out.paragraph(field))
    for chapter in book["chapters"]:
        if chapter["title"]:
            out.body.append(out.paragraph(out.runs(chapter["title"]), "Heading1", before="<w:pageBreakBefore/>"))
        for b in chapter["blocks"]:
            out.add(b)
    return out.packed(plain(book["title"]), book["author"])


def gathered(books: DataFrame, chapters: DataFrame, blocks: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Each book with its chapters, their blocks, and its assets in one row: a book must fit in a task to be packed."""
    by_chapter = blocks.groupBy("book_id", "ch_no").agg(F.collect_list(F.struct(*FIELDS)).alias("blocks"))
    rows = chapters.join(by_chapter, ["book_id", "ch_no"], "left")
    by_book = rows.groupBy("book_id").agg(F.collect_list(F.struct("ch_no", "title", "blocks")).alias("chapters"))
    out = books.join(by_book, "book_id", "left")
    if assets is None:
        return out.withColumn("assets", F.array().cast("array<struct<file: string, content: binary>>"))
    return out.join(assets.groupBy("book_id").agg(F.collect_list(F.struct("file", "content")).alias("assets")), "book_id", "left")


def render(books: DataFrame, pack: Callable[[dict, dict], bytes], target_lang: str = "fr") -> DataFrame:
    """book_id, content of gathered() books as pack (epub or docx) writes them."""
    lang = languages.describe(target_lang)
    schema = StructType([books.select("book_id").schema[0], *StructType.fromDDL("content binary").fields])
    arrow = to_arrow_schema(schema)

    def content(book: dict) -> bytes:
        listed = lambda x: [] if x is None else list(x)
        chapters = [c | {"blocks": sorted(listed(c["blocks"]), key=lambda b: (b["pos"], b["sub"]))} for c in sorted(listed(book["chapters"]), key=lambda c: c["ch_no"])]
        return pack(book | {"chapters": chapters, "assets": {a["file"]: a["content"] for a in listed(book["assets"])}}, lang)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # books may be large: only one is held as objects at a time
                book = batch.slice(at, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist([{"book_id": book["book_id"], "content": content(book)}], schema=arrow)

    return books.mapInArrow(each, schema)
