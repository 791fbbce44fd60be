"""Character classes, spelled so that Java's and RE2's regular expressions read them alike."""

#: White space as Unicode text processing commonly has it.
WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LETTER = r"\p{L}\p{Nl}\p{No}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

CODE_SPAN = r"`([^`\n]+)`"
LINK_TARGET = rf"\]\(([^){WS}]+)\)"
WEB = rf"(?:https?|ftp)://[^{WS}<>\"')\]]+[^{WS}<>\"')\].,;:!?]"
MAIL = rf"mailto:[^{WS})\]]+|[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.-]+[{WORD}]"
URL = f"{WEB}|{MAIL}"
NUMBER = rf"{{0}}+(?:[.,:]{{0}}+)*".format(f"[{DIGIT}]")
