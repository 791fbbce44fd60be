"""Tables of the document model. book_id may be of any type that can be grouped by."""

BLOCK_FIELDS = (
    "type string, level int, text string, ordered boolean, depth int, rows array<array<string>>, header boolean, file string, alt string, labels array<string>"
)
#: What a format's parser gives for a whole document.
PARSED = (
    "title string, author string, language string, notes array<string>, "
    f"chapters array<struct<title: string, blocks: array<struct<{', '.join(f'{n}: {t}' for n, t in (f.split(' ', 1) for f in BLOCK_FIELDS.split(', ')))}>>>>, "
    "assets array<struct<file: string, content: binary>>"
)
TEXT_TYPES = ("heading", "para", "item", "quote", "caption")
