"""Scalar text rules as SQL expressions in either spelling (survey ids F1 to F22, PF3, PF8, PF21)."""

from __future__ import annotations

# Patterns of document structure.
BLANKS = r"[\s　]"
CN = "一二三四五六七八九十百千零0-9"
DOTTED = r"^([0-9]+([.．][0-9]+)+)(\s+|[^0-9.．\s])"
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.．]0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
NETWORK = "(?i)^(IP|IPv4|地址|网段|网关|掩码|端口|主机|服务器|节点|DNS|URL)"
VERSION = r"(?i)^(v(ersion)?\s*)?(版本(号|信息|说明)|release\b|build\b)"
HEADINGS = [
    (rf"^第[{CN}]+章\s*", 1),
    (rf"^第[{CN}]+节\s*", 2),
    (rf"^第[{CN}]+条\s*", 3),
    (rf"^[{CN}]+[、，,.\s]\s*", 1),
    (rf"^\([{CN}]+\)\s*", 2),
    (rf"^（[{CN}]+）\s*", 2),
]
DECIMAL_DOT = r"^[0-9]+[.．]{1,2}([^.．0-9]|$)"
LISTS = [
    (r"^[a-zA-Z]\)\s*", "letter"),
    (DECIMAL_DOT, "decimal"),
    (r"^[0-9]+\)\s*", "decimal"),
    (r"^（[0-9]+）\s*", "decimal"),
    (r"^\([0-9]+\)\s*", "decimal"),
    (r"^[•·]\s*", "bullet2"),
    (r"^——\s*", "dash"),
    (r"^—\s*", "dash"),
    (r"^[●○]\s*", "bullet2"),
]
CAPTION = r"^([图表])[：:\s]*(([A-Z][.])?[0-9]+([-.]([A-Z][.])?[0-9]+)*\s*)?(.*)"
FORMULA = r"^(S|S[.])?\(?[0-9]+([.][0-9]+)*\)?[：:]\s*"
NOTE_FORMULA = r"^（[0-9]+([.][0-9]+)*）\s*"
APPENDIX = r"^附\s*录\s|^附录([A-Z]|[一二三四五六七八九十百千零])"
NOTE = "^(备注：|编写提示：|【备注提示】|【编写样例】)"
NUMBERED_NOTE = "^注[1-5]：|^注："
DATE = r"^[0-9]{4}\s*年\s*[0-9]{1,2}\s*月"
TOC_ENTRY = r"[\t.·…]+[0-9]{1,4}$"
OWN_NUMBER = "CASE WHEN hier IS NOT NULL THEN num ELSE '' END"  # what strip_heading takes off a block
PAGE_TAIL = r"[\t ]+[0-9]+$"
APPENDIX_MARK = r"(?i)^附\s*录\s*[A-Z](\s*|[：:].*)$"
APPENDIX_ID = r"(?i)^附\s*录\s*([A-Z])([^A-Za-z]|$)"
APPENDIX_CANDIDATE = r"(?i)^附\s*录(?:\s*([A-Z]))?(?:\s*[：:]\s*.+|\s+.+)?$"
APPENDIX_HEADING = r"(?i)^\s*([A-Z])(([.．][0-9]+){1,3})[\s、：:.)）-]*(.*)$"
CAPTION_START = "^[图表]"
IMAGE = r"^!\[[^\]]*\]\([^)]*\)$"
ORDERED = r"^([A-Za-z]\)|[0-9]+[.)、]|[（(][0-9]+[）)])"
UNORDERED = "^[-–—－•·●○■□▪▫◆◇▶▷►▻※★☆✓✔]"


def strip(d, x: str) -> str:
    return d.replace(x, f"^{BLANKS}+|{BLANKS}+$")


def dotted_number(d, x: str) -> str:
    return d.extract(x, DOTTED, 1)


def hierarchical_level(d, x: str, number: str = "num") -> str:
    """Level of a leading dotted number (F1), given the number; null if it isn't a heading's."""
    rest = strip(d, f"substring({x}, length({number}) + 1)")
    parts = f"(length({number}) - length(replace(replace({number}, '．', '.'), '.', '')) + 1)"
    first = f"TRY_CAST({d.extract(number, '^([0-9]+)', 1)} AS BIGINT)"
    return (
        f"CASE WHEN {number} = '' OR length({x}) > 80 OR {d.matches(x, '[。；;，,]$')} THEN NULL "
        f"WHEN NOT {d.matches(rest, r'\p{L}')} THEN NULL WHEN coalesce({first}, 100) > 99 THEN NULL "
        f"WHEN {d.matches(number, OCTETS)} AND ({first} >= 10 OR {d.matches(rest, NETWORK)}) THEN NULL "
        f"WHEN {parts} >= 3 AND {d.matches(rest, VERSION)} THEN NULL "
        f"ELSE CAST(least({parts}, 6) AS INT) END"
    )


def heading_level(d, x: str, hier: str = "hier") -> str:
    """Level of any heading marker in the text (F2)."""
    rules = " ".join(f"WHEN {d.matches(x, p)} THEN {level}" for p, level in HEADINGS)
    return (
        f"CASE WHEN length({x}) > 80 THEN NULL WHEN {hier} IS NOT NULL THEN {hier} "
        f"WHEN {d.matches(x, '^[0-9]+[.．][0-9]+')} THEN NULL WHEN {d.matches(x, r'^[0-9]+\s+')} THEN 1 {rules} ELSE NULL END"
    )


def strip_heading(d, x: str, number: str = "num") -> str:
    """The text without heading markers and trailing page number (F3); markers go one after the other."""
    out = strip(d, f"substring({x}, length({number}) + 1)")
    for pattern in (PAGE_TAIL, r"^[0-9]+\s+", *(p for p, _ in HEADINGS)):
        out = d.replace(out, pattern)
    return strip(d, out)


def list_kind(d, x: str) -> str:
    """Kind of the list marker, null without one."""
    rules = " ".join(f"WHEN {d.matches(x, p)} THEN '{kind}'" for p, kind in LISTS)
    return f"CASE {rules} ELSE NULL END"


def strip_list(d, x: str) -> str:
    """The text without list markers, each pattern tried in turn, and trailing page number (F8)."""
    out = x
    for pattern, _ in LISTS:
        if pattern == DECIMAL_DOT:
            rest = d.replace(d.replace(out, "^[0-9]+[.．]{1,2}"), r"^\s+")
            out = f"CASE WHEN {d.matches(out, pattern)} THEN {rest} ELSE {out} END"
        else:
            out = d.replace(out, pattern)
    return strip(d, d.replace(out, PAGE_TAIL))


def residual_number(d, x: str, hier: str = "hier") -> str:
    rules = " OR ".join(d.matches(x, p) for p, _ in HEADINGS)
    return f"({hier} IS NOT NULL OR {d.matches(x, r'^[0-9]+\s+')} OR {rules})"


def note_role(d, x: str) -> str:
    return f"CASE WHEN {d.matches(x, NUMBERED_NOTE)} THEN 'numbered_note' WHEN {d.matches(x, NOTE)} THEN 'note' ELSE NULL END"


def is_formula(d, x: str) -> str:
    return f"({d.matches(x, FORMULA)} OR {d.matches(x, NOTE_FORMULA)})"
