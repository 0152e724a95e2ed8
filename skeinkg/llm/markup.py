"""Markup (HTML, Markdown, wiki, LaTeX) to clean text that still tells headings, list items, code blocks and formulas.

The format is recognised from the text itself; the stored format only breaks ties. Two passes:

1. *Votes.* Every HTML page scores its containers by the text they hold against the links in it. The best
   container gets the page's vote as a generalised tag-class path (digits dropped), and of every path the page says
   whether its own text is content or links and margins. Votes are added up per host inside the tasks and then in
   Spark, so a host with a third of all pages sends one row a path and task.
2. *Extraction.* Inside the container that won at a host everything is read but what most pages call links or
   margins; outside it only what most pages call content. Pages without the winning container lose nothing but such margins, and
   other formats are read from the root. The verdicts are broadcast only if they are few (``WINNERS``), else joined
   by host and salt.

The parsers work on regular expressions over whole texts, in Arrow batches. A document becomes a list of
blocks (kind, text); kinds are ``text``, ``heading``, ``list_item``, ``code``, ``formula`` and ``row`` (of a table, cells
joined by tabs). Formulas inside a sentence are their own blocks besides staying in the text.

Defined results: null and empty texts have no blocks and no format; unclosed or unknown markup is read as far
as it goes, never an error; repeated rows are read alike.
"""

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed

#: As many winning paths are broadcast at most.
WINNERS = 100_000
SALTS = 16
BLOCKS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))

_BLOCK = r"p|h[1-6]|ul|ol|li|dl|dt|dd|table|tr|td|th|thead|tbody|div|pre|br|hr|html|body|head|title|script|style|section|article|main|nav|header|footer|aside|blockquote|figure"
_INLINE = r"b|i|u|em|strong|a|span|code|sup|sub|small|img|tt|kbd"
_SNIFF = {
    "html": re.compile(rf"(?i)</?(?:{_BLOCK})\b[^<>]*>|<!--|<!doctype|</?(?:{_INLINE})(?: [^<>]*)?>|&(?:nbsp|amp|lt|gt|quot|middot|[lr][sd]quo|mdash|ndash|hellip|[A-Za-z]{{1,5}}(?:acute|grave|uml|circ|cedil|tilde|slash|lig)|#\d+|#x[0-9a-fA-F]+);"),
    "wiki": re.compile(r"(?m)^(={2,6})[^=\n].*\1[ \t]*$|\[\[[^\[\]\n]+\]\]|'''[^'\n]+'''|''[^'\n]*[^\W\d_]{2}[^'\n]*''|<ref\b|</?math>|<syntaxhighlight|<nowiki>|\{\{[^{}]*\}\}|^\{\|"),
    "tex": re.compile(r"\\(?:(?:sub)*section|chapter|paragraph|begin|end|emph|textbf|textit|textsc|texttt|underline|footnote|cite|label|ref|item|documentclass|usepackage|title|author|caption|href|url)\b|\{\\(?:it|bf|sc|tt|em|rm|sf|sl)\b"),
    "md": re.compile(r"(?m)(?:\A|\n\n)(?:> ?)? {0,3}#{1,6}[ \t]+\S.*(?=\n(?:[^#]|#{2,6})|\n?\Z)|^[^\s<>|].*\n(?:={3,}|-{3,})[ \t]*$|\*\*[^\s*][^*\n]*\*\*|__[^\s_][^_\n]*__|(?<![\w*\\])\*[^\s*][^*\n]*\*(?![\w*])|(?<=[\u3400-\u9fff\u3040-\u30ff])\*[^\s*][^*\n]*\*|`[^`\n]+`|^ {0,3}(?:```|~~~)|\]\([^()\s]+\)|\]\[\w+\]|\[\^\w+\]|^> |^\$\$|\A---\n(?:.*\n)*?---\n|^\|?[ ]?:?-{3,}:?[ ]?\|"),
}
_STORED = {"html": "html", "htm": "html", "text/html": "html", "xhtml": "html", "md": "md", "markdown": "md", "text/markdown": "md", "wiki": "wiki", "mediawiki": "wiki", "tex": "tex", "latex": "tex"}
_ANY = re.compile(r"[<&={\\*_`$#\[]|''|^(?:> |---)|\n(?:> |-{3,})")
_PROSE = re.compile(r"[\w\s]")
_WIKI_SURE = re.compile(r"(?m)\[\[|^==|\{\{|'''|<math>|<ref\b|<syntaxhighlight")
_TEX_SURE = re.compile(r"\\(?:begin|(?:sub)*section|emph|text..|footnote|item|cite)\b")
_HTML_SURE = re.compile(r"(?i)<(?:p|h[1-6]|ul|ol|li|div|html|table|pre|br)\b")
_HTML_ONLY = re.compile(r"(?i)<(?:p|h[1-6]|ul|ol|div|html)\b")


def recognised(text: str, stored: str | None) -> str | None:
    """html, wiki, tex, md, or None for text without markup."""
    if not text or not _ANY.search(text):
        return None
    named = _STORED.get((stored or "").strip().lstrip(".").lower())
    found = {}
    for k, pattern in _SNIFF.items():
        if k == "html" and "<" not in text and "&" not in text or k == "tex" and "\\" not in text:
            continue
        if n := sum(1 for _ in pattern.finditer(text)):
            found[k] = n + 0.5 * (k == named)
    if "wiki" in found and not _WIKI_SURE.search(text) and len(_PROSE.findall(text)) < 0.93 * len(text):
        found.pop("wiki")  # stray apostrophes in unreadable text
    if "md" in found and "tex" in found and not _TEX_SURE.search(text):
        found.pop("tex")
    if not found:
        return None
    if "html" in found:
        if _HTML_SURE.search(text) and not ("wiki" in found and _WIKI_SURE.search(text) and not _HTML_ONLY.search(text)):
            found["html"] += 2
        elif "wiki" in found or "md" in found:
            found["wiki" if "wiki" in found else "md"] += found.pop("html")
    return max(found, key=lambda k: (found[k], k == named))


_SPACE = re.compile(r"\s+")


def _clean(s: str) -> str:
    return _SPACE.sub(" ", s).strip()


# ---------------------------------------------------------------- HTML
_DROP = re.compile(r"(?is)<!--.*?-->|<(script|style|head|template|noscript)\b[^<>]*>.*?</\1\s*>|<!doctype[^<>]*>|<\?xml.*?\?>")
_TAG = re.compile(r"(?s)<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)/?>")
_CLASS = re.compile(r"""\b(class|id)\s*=\s*["']?([^"'\s>]+)""", re.I)
_PLACES = {"html", "body", "div", "main", "article", "section", "nav", "header", "footer", "aside", "td", "center"}
_HTML_BLOCKS = frozenset(_BLOCK.replace("h[1-6]", "h1|h2|h3|h4|h5|h6").split("|"))
_TEX_IN_HTML = re.compile(r"(?s)\\\((.+?)\\\)|\\\[(.+?)\\\]")


_MARGINS = frozenset({"nav", "footer", "aside"})
Votes = dict[str, tuple[int, int]]


def _places(text: str) -> Iterator[tuple[int, int, tuple[str, ...], re.Match | None]]:
    """(start, end, path, tag behind it) of each piece of text between tags, with the generalised path of the container it stands in."""
    path: list[str] = []
    here: tuple[str, ...] = ()
    at = 0
    for m in _TAG.finditer(text):
        yield at, m.start(), here, m
        at, tag = m.end(), m[2].lower()
        if tag in _PLACES:
            if not m[1]:
                named = _CLASS.search(m[3])
                path.append(tag + (("." if named[1].lower() == "class" else "#") + re.sub(r"\d+", "", named[2]) if named else ""))
            else:
                while path and re.match(r"\w+", path.pop())[0] != tag:
                    pass
            here = tuple(path)
    yield at, len(text), here, None


def container_votes(text: str) -> Votes:
    """For each container path of a page (1 if it is the page's best, else 0; 1 if its own text is content, -1 if it is links or a margin). The root, '', is nobody's best."""
    plain: Counter[tuple[str, ...]] = Counter()
    links: Counter[tuple[str, ...]] = Counter()
    text, in_link = _DROP.sub(" ", text), False
    for a, b, path, m in _places(text):
        if n := len(text[a:b].strip()):
            (links if in_link else plain)[path] += n
        if m and m[2].lower() == "a":
            in_link = not m[1]
    total: Counter[tuple[str, ...]] = Counter()
    for p in plain.keys() | links.keys():  # a container also holds what its inner ones hold, at a discount for each level
        for k in range(len(p) + 1):
            total[p[:k]] += (plain[p] - links[p]) * 0.9 ** (len(p) - k)
    if not total:
        return {}
    best, size = max(sorted(total), key=lambda p: total[p]), sum(plain.values())
    margin = lambda p: any(re.match(r"\w+", x)[0] in _MARGINS for x in p) and 2 * plain[p] < size
    out = {"/".join(p): (0, -1 if links[p] > plain[p] or margin(p) else 1) for p in plain.keys() | links.keys()}
    name = "/".join(best)
    return out | {name: (1 if name else 0, out.get(name, (0, 0))[1])}


def _within(text: str, path: str, bad: frozenset[str] | None) -> str:
    """``text`` without the containers of ``bad``; where the page lacks the container ``path``, only those that are no frame of the whole page."""
    if not bad:
        return text
    pieces = list(_places(text))
    if not any("/".join(p) == path for _, _, p, _ in pieces):
        bad = frozenset(b for b in bad if re.search(r"(?:^|/)(?!html$|body$)[^/]+$", b))
    out = []
    for a, b, p, m in pieces:
        keep = "/".join(p) not in bad
        out.append(text[a : m.end() if m else b] if keep else m[0] if m and m[2].lower() in _PLACES else " ")
    return "".join(out)


def _html(text: str, path: str = "", bad: frozenset[str] | None = None) -> list[tuple[str, str]]:
    text = _within(_DROP.sub(" ", text), path, bad)
    out: list[tuple[str, str]] = []
    buffer: list[str] = []
    kind, cells, formula, pre, at = "text", [], None, None, 0

    def flush() -> None:
        nonlocal kind
        raw = "".join(buffer)
        buffer.clear()
        s = html.unescape(raw)
        for m in _TEX_IN_HTML.finditer(s):
            out.append(("formula", _clean(m[1] or m[2])))
        s = _TEX_IN_HTML.sub(lambda m: m[1] or "", s)
        if s := _clean(s):
            if cells is not None and kind == "cell":
                cells.append(s)
            else:
                out.append((kind if kind != "cell" else "text", s))
        elif kind == "cell":
            cells.append("")
        kind = "text"

    for m in _TAG.finditer(text):
        if pre is not None:
            if m[1] and m[2].lower() == pre:
                out.append(("code", html.unescape(_TAG.sub("", text[at : m.start()])).strip("\n")))
                pre, at = None, m.end()
            continue
        if formula is not None:
            if m[1] and m[2].lower() == formula:
                f = html.unescape(_TAG.sub("", text[at : m.start()]))
                f = _clean(re.sub(r"^\s*(?:\\\(|\\\[|\$\$?)|(?:\\\)|\\\]|\$\$?)\s*$", "", f))
                out.append(("formula", f))
                if formula == "span":
                    buffer.append(html.escape(f, False))
                formula, at = None, m.end()
            continue
        buffer.append(text[at : m.start()])
        at, tag = m.end(), m[2].lower()
        if tag not in _HTML_BLOCKS and tag not in ("span", "math"):
            continue
        if tag in ("span", "div", "math") and not m[1] and (tag == "math" or (c := _CLASS.search(m[3])) and c[2].lower() in ("math", "formula", "tex", "katex", "mathjax", "equation")):
            if tag != "span":
                flush()
            formula = tag
        elif tag == "span":
            continue
        elif tag == "pre":
            if not m[1]:
                flush()
                pre = "pre"
        elif tag == "br":
            if kind not in ("list_item", "heading", "cell"):
                flush()
            else:
                buffer.append(" ")
        elif tag in ("p", "div") and kind in ("list_item", "cell", "heading") and not "".join(buffer).strip():
            continue
        elif tag == "p" and kind == "list_item":
            buffer.append(" ")
        elif tag in ("td", "th"):
            if not m[1]:
                if kind == "cell":
                    flush()
                elif "".join(buffer).strip():
                    flush()
                buffer.clear()
                kind = "cell"
            elif kind == "cell":
                flush()
        else:
            flush()
            if tag == "tr" and cells:
                out.append(("row", "\t".join(cells)))
                cells = []
            if not m[1]:
                kind = "list_item" if tag in ("li", "dt", "dd") else "heading" if len(tag) == 2 and tag[0] == "h" and tag != "hr" else "text"
    if pre is not None:
        out.append(("code", html.unescape(text[at:]).strip("\n")))
    else:
        buffer.append(text[at:])
        flush()
    if cells:
        out.append(("row", "\t".join(cells)))
    return out


# ---------------------------------------------------------------- Markdown
_MD_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_MD_FORMULA = re.compile(r"(?s)\$\$(.+?)\$\$|(?<![\\$\w])\$(?![\s$])([^$\n]*?[^\s$\\])\$(?![\w$])|\\\((.+?)\\\)|\\\[(.+?)\\\]")
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\](?:\([^()\n]*\)|\[[^\[\]\n]*\])")
_MD_NOTE = re.compile(r"\[\^[^\[\]\n]+\]")
_MD_EMPHASIS = re.compile(r"(\*\*\*|\*\*|\*|___|__|~~)(?=[^\s*_~])([^\n]*?[^\s])\1")
_MD_UNDER = re.compile(r"(?<!\w)_(?=\S)([^_\n]*\S)_(?!\w)")
_MD_ITEM = re.compile(r"( *)(?:[*+-]|\d{1,9}[.)])[ \t]+(\S.*)")
_MONEY = re.compile(r"^\d[\d.,]*(?:\s|,|$)")


def _md_inline(s: str, out: list[tuple[str, str]] | None = None) -> str:
    kept: list[str] = []

    def keep(x: str) -> str:
        kept.append(x)
        return f"\x00{len(kept) - 1}\x00"

    if "`" in s:
        s = re.sub(r"(`+)(.+?)\1", lambda m: keep(m[2].strip()), s)
    if "$" in s or "\\" in s:

        def formula(m: re.Match) -> str:
            if m[2] is not None and _MONEY.match(m[2]):
                return m[0]
            f = _clean(next(g for g in m.groups() if g is not None))
            if out is not None:
                out.append(("formula", f))
            return keep(f)

        s = _MD_FORMULA.sub(formula, s)
        s = _MD_ESCAPE.sub(lambda m: keep(m[1]), s)
    if "[" in s:
        s = _MD_NOTE.sub("", s)
        s = _MD_LINK.sub(r"\1", s)
    if "<" in s:
        s = re.sub(r"<((?:https?|mailto):[^<>\s]+)>", r"\1", s)
        s = re.sub(r"(?i)<br\s*/?>", " ", s)
        s = re.sub(rf"(?i)<!--.*?-->|</?(?:{_INLINE}|{_BLOCK})\b[^<>]*>", "", s)
    if "*" in s or "__" in s or "~~" in s:
        for _ in range(3):
            t = _MD_EMPHASIS.sub(r"\2", s)
            if t == s:
                break
            s = t
    if "_" in s:
        s = _MD_UNDER.sub(r"\1", s)
    if "&" in s:
        s = html.unescape(s)
    while "\x00" in s:
        s = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], s)
    return _clean(s)


def _md(text: str) -> list[tuple[str, str]]:
    text = re.sub(r"\A---\n(?:.*\n)*?---(?:\n|\Z)", "", text)
    if "<!--" in text:
        text = re.sub(r"(?s)<!--.*?-->", "", text)
    out: list[tuple[str, str]] = []
    lines = text.split("\n")
    paragraph: list[str] = []
    blank, k = True, 0

    def flush() -> None:
        if paragraph:
            found: list[tuple[str, str]] = []
            s = _md_inline("\n".join(paragraph), found)
            out.extend(found)
            if s:
                out.append(("text", s))
            paragraph.clear()

    while k < len(lines):
        line = lines[k]
        while line.startswith(">"):
            line = line[2:] if line[1:2] == " " else line[1:]
        s = line.strip()
        k += 1
        if not s:
            flush()
            blank = True
            continue
        if m := re.match(r" {0,3}(`{3,}|~{3,})", line):
            flush()
            code = []
            while k < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[k]):
                code.append(lines[k])
                k += 1
            k += 1
            out.append(("code", "\n".join(code)))
        elif s == "$$" or s == "\\[":
            flush()
            inner, end = [], "$$" if s == "$$" else "\\]"
            while k < len(lines) and lines[k].strip() != end:
                inner.append(lines[k])
                k += 1
            k += 1
            out.append(("formula", _clean("\n".join(inner))))
        elif (line.startswith("    ") or line.startswith("\t")) and blank and not paragraph:
            code = [line]
            while k < len(lines) and (lines[k].startswith(("    ", "\t")) or not lines[k].strip() and k + 1 < len(lines) and lines[k + 1].startswith(("    ", "\t"))):
                code.append(lines[k])
                k += 1
            out.append(("code", "\n".join(code)))
        elif m := re.match(r" {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", line):
            flush()
            out.append(("heading", _md_inline(m[2], out)))
        elif paragraph and len(paragraph) == 1 and re.fullmatch(r" {0,3}(?:=+|-{2,})[ \t]*", line):
            out.append(("heading", _md_inline(paragraph.pop(), out)))
        elif re.fullmatch(r" {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})", line):
            flush()
        elif m := _MD_ITEM.match(line):
            flush()
            item = [m[2]]
            while k < len(lines) and lines[k].startswith("  ") and lines[k].strip() and not _MD_ITEM.match(lines[k]):
                item.append(lines[k].strip())
                k += 1
            out.append(("list_item", _md_inline("\n".join(item), out)))
        elif re.match(r"\[\^?[^\[\]]+\]:\s", s):
            flush()
        elif "|" in s and (re.fullmatch(r"\|?(?:\s*:?-{3,}:?\s*\|)+(?:\s*:?-{3,}:?\s*)?", s) or s.startswith("|") and s.endswith("|")):
            if not re.fullmatch(r"[|\s:-]+", s):
                out.append(("row", "\t".join(_md_inline(c) for c in s.strip("|").split("|"))))
        else:
            paragraph.append(line)
        blank = False
    flush()
    return out


# ---------------------------------------------------------------- wiki
_WIKI_MATH = re.compile(r"(?s)<math[^<>]*>(.*?)</math>")
_WIKI_CODE = re.compile(r"(?s)<(syntaxhighlight|source|pre)\b[^<>]*>(.*?)</\1>")
_WIKI_CUT = re.compile(r"(?s)<!--.*?-->|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|__[A-Z]+__")
_WIKI_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_WIKI_FILE = re.compile(r"(?i)\[\[(?:category|file|image|datei|kategorie|catégorie|fichier|категория|файл|分类|カテゴリ|ファイル)\s*:[^\[\]]*\]\]")


def _wiki(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    kept: list[tuple[str, str]] = []

    def keep(kind: str, s: str) -> str:
        kept.append((kind, s))
        return f"\x00{len(kept) - 1}\x00"

    text = _WIKI_CODE.sub(lambda m: "\n" + keep("code", html.unescape(m[2]).strip("\n")) + "\n", text)
    text = _WIKI_MATH.sub(lambda m: keep("formula", _clean(html.unescape(m[1]))), text)
    text = _WIKI_CUT.sub("", text)
    while (t := _WIKI_TEMPLATE.sub("", text)) != text:
        text = t
    text = _WIKI_FILE.sub("", text)

    def inline(s: str) -> str:
        s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
        s = re.sub(r"\[(?:https?:)?//\S+ ([^\[\]]*)\]", r"\1", s)
        s = re.sub(r"'''''|'''|''", "", s)
        s = re.sub(r"(?i)<br\s*/?>", " ", s)
        s = _TAG.sub("", s)
        s = html.unescape(s)

        def back(m: re.Match) -> str:
            kind, x = kept[int(m[1])]
            out.append((kind, x))
            return x if kind == "formula" else " "

        return _clean(re.sub("\x00(\\d+)\x00", back, s))

    for line in text.split("\n"):
        s = line.strip()
        if not s or s == "----":
            continue
        if m := re.fullmatch(r"(={1,6})\s*(.+?)\s*\1", s):
            out.append(("heading", inline(m[2])))
        elif s.startswith(("{|", "|}", "|-")):
            continue
        elif s[0] in "|!" and len(s) > 1:
            cells = [re.sub(r"^[^|\[\]]*=[^|\[\]]*\|(?!\|)", "", c) for c in re.split(r"\|\||!!", s[1:])]
            out.append(("row", "\t".join(inline(c) for c in cells)))
        elif (m := re.match(r"[*#]+[:;]?\s*(.+)", s)) and not line.startswith(" "):
            if x := inline(m[1]):
                out.append(("list_item", x))
        elif re.fullmatch(r":*\s*\x00\d+\x00", s):
            inline(s)
        elif x := inline(s.lstrip(":;")):
            out.append(("text", x))
    return out


# ---------------------------------------------------------------- LaTeX
_MARKS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a", "d": "\u0323"}
_LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "ı", "ldots": "…", "dots": "…", "textendash": "–", "textemdash": "—", "LaTeX": "LaTeX", "TeX": "TeX", "textbackslash": "\\", "S": "§"}
_TEX_ACCENT = re.compile(r"\\([`'^\"~=.])\s*(?:\{\\?([A-Za-zı])\}|\\?([A-Za-z]))|\\([uvHckrd])(?:\{([A-Za-z])\}|\s+([A-Za-z]))")
_TEX_CODE = re.compile(r"(?s)\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]]*\])?(?:(?<=minted\})\{\w+\})?[ \t]*\n?(.*?)\\end\{\1\}")
_TEX_MATH = re.compile(r"(?s)\\begin\{(equation|align|gather|multline|displaymath|math|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}|\\\[(.*?)\\\]|\\\((.*?)\\\)|\$\$(.+?)\$\$|(?<!\\)\$([^$]+?)(?<!\\)\$")
_TEX_GROUP = r"\{((?:[^{}\\]|\\.|\{(?:[^{}\\]|\\.|\{(?:[^{}\\]|\\.)*\})*\})*)\}"
_TEX_CUT = re.compile(rf"\\(?:footnote|footnotetext|cite[tp]?|label|ref|pageref|index|vspace|hspace|documentclass|usepackage|bibliography\w*|pagestyle|newcommand\*?|input|include)\*?(?:\[[^\]]*\])?(?:{_TEX_GROUP})+")
_TEX_HEAD = re.compile(rf"\\(?:part|chapter|(?:sub){{0,2}}section|paragraph|subparagraph|title)\*?\s*(?:\[[^\]]*\])?\s*{_TEX_GROUP}")
_TEX_STYLE = re.compile(rf"\\(?:emph|text\w\w|texttt|underline|mbox|uppercase|textsuperscript|href{_TEX_GROUP}|url|caption)\s*{_TEX_GROUP}")
_TEX_OLD = re.compile(r"\{\\(?:it|bf|sc|tt|em|rm|sf|sl|small|large|itshape|bfseries)\b\s*((?:[^{}\\]|\\.)*)\}")


def _tex(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    kept: list[tuple[str, str]] = []

    def keep(kind: str, s: str) -> str:
        kept.append((kind, s))
        return f"\x00{len(kept) - 1}\x00"

    text = _TEX_CODE.sub(lambda m: "\n\n" + keep("code", m[2].strip("\n")) + "\n\n", text)
    text = re.sub(r"(?m)^[ \t]*%.*\n?|(?<!\\)[ \t]*%.*$", "", text)

    def formula(m: re.Match) -> str:
        if m[7] is not None and _MONEY.match(m[7]):
            return m[0]
        f = next(g for n, g in enumerate(m.groups(), 1) if n >= 3 and g is not None)
        return keep("formula", _clean(re.sub(r"\\label\{[^{}]*\}", "", f)))

    text = _TEX_MATH.sub(formula, text)
    if "\\begin{document}" in text:
        text = text.partition("\\begin{document}")[2]
    text = text.partition("\\end{document}")[0]

    def plain(s: str) -> str:
        s = _TEX_CUT.sub("", s)
        for _ in range(4):
            t = _TEX_OLD.sub(r"\1", _TEX_STYLE.sub(lambda m: m[m.lastindex or 1] or "", s))
            if t == s:
                break
            s = t

        def accent(m: re.Match) -> str:
            base = (m[2] or m[3] or m[5] or m[6]).replace("ı", "i")
            return unicodedata.normalize("NFC", base + _MARKS[m[1] or m[4]])

        s = _TEX_ACCENT.sub(accent, s)
        s = re.sub(r"\\([A-Za-z]+)(?:\{\}|[ \t]+|(?![A-Za-z]))", lambda m: _LETTERS.get(m[1], ""), s)
        s = re.sub(r"\\\\(?:\[[^\]]*\])?", " ", s)
        s = re.sub(r"\\([%&#_${}])", lambda m: keep("char", m[1]), s)
        s = s.replace("\\,", " ").replace("\\ ", " ").replace("~", " ").replace("``", "“").replace("''", "”").replace("---", "—").replace("--", "–")
        s = re.sub(r"[{}]", "", s)

        def back(m: re.Match) -> str:
            kind, x = kept[int(m[1])]
            if kind != "char":
                out.append((kind, x))
            return " " if kind == "code" else x

        return _clean(re.sub("\x00(\\d+)\x00", back, s))

    text = re.sub(r"\\begin\{tabular\*?\}(?:\{[^{}]*\})+|\\end\{tabular\*?\}|\\hline|\\(?:top|mid|bottom)rule|\\maketitle|\\centering", "\n", text)
    text = re.sub(r"\\(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]]*\])?", "\n\n\x01\n\n", text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n\n", text)
    text = _TEX_HEAD.sub(lambda m: f"\n\n\x02{_SPACE.sub(' ', m[1])}\n\n", text)
    text = re.sub(r"\\item\b\s*(?:\[([^\]]*)\])?", lambda m: "\n\n\x03" + (m[1] + " " if m[1] else ""), text)
    for part in re.split(r"\n\s*\n", text):
        s = part.strip()
        if not s or s.startswith("\x01"):
            continue
        kind = {"\x02": "heading", "\x03": "list_item"}.get(s[0], "text")
        s = s.lstrip("\x02\x03")
        if kind == "text" and " & " in s and "\\\\" in s:
            for row in s.split("\\\\"):
                if row.strip():
                    out.append(("row", "\t".join(plain(c) for c in re.split(r"(?<!\\)&", row))))
            continue
        before = len(out)
        x = plain(s)
        alone = len(out) == before + 1 and out[-1][0] == "formula" and out[-1][1] == x
        if x and not alone:
            out.append((kind, x))
    return out


_ENDED = re.compile(r"[.!?。！？।؟…:：,，、—][\"'”’»›」』）)\]]*\s*$")
_SENTENCES = re.compile(r"[^\W\d_]{3}[.!?。！？।؟][\"'”’»›」』）)\]]*(?:\s*\S|\s*$)")
_APART = re.compile(r"\s*(?:[•‣·▪*+➤►–—-]|\(?(?:\d{1,3}|[a-z])[.)]\s|No\.?\s?\d+:)|.*(?:\t|  |[|¦]|;.*;)")


def _plain(text: str) -> list[tuple[str, str]]:
    """The lines of a text without markup; up to three lines of a paragraph that break off are read as one with the line that ends their sentence."""
    out: list[tuple[str, str]] = []
    for paragraph in re.split(r"\n\s*\n", text):
        held: list[str] = []
        lines = [x for x in paragraph.split("\n") if x.strip()]
        if len(lines) > 1 and _ENDED.search(lines[-1]) and 3 * sum(1 for x in lines if _SENTENCES.search(x)) >= len(lines) and not any(_APART.match(x) for x in lines[1:]):
            out.append(("text", " ".join(lines)))
            continue
        for line in lines:
            held.append(line)
            if _ENDED.search(line) or _APART.match(line):
                wrapped = len(held) <= 4 and _ENDED.search(line) and not any(_APART.match(x) for x in held[1:])
                out += [("text", " ".join(held))] if wrapped else [("text", x) for x in held]
                held = []
        out += [("text", x) for x in held]
    return out


def blocks(text: str | None, fmt: str | None, path: str = "", bad: frozenset[str] | None = None) -> list[tuple[str, str]]:
    """The blocks of a text in format ``fmt``; plain text has its lines as they are."""
    if not text:
        return []
    if fmt is None:
        return _plain(text)
    found = _html(text, path, bad) if fmt == "html" else {"md": _md, "wiki": _wiki, "tex": _tex}[fmt](text)
    return [(k, t) for k, t in found if t.strip()]


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes: dict[tuple[str, str], list[int]] = {}
    for batch in batches:
        hosts, formats, texts = (batch.column(i).to_pylist() for i in range(3))
        for host, stored, text in zip(hosts, formats, texts, strict=True):
            if text and recognised(text, stored) == "html":
                for path, (best, content) in container_votes(text).items():
                    v = votes.setdefault((host or "", path), [0, 0])
                    v[0] += best
                    v[1] += content
        if len(votes) > 50_000:
            yield _counted(votes)
            votes = {}
    yield _counted(votes)


def _counted(votes: dict[tuple[str, str], list[int]]) -> pa.RecordBatch:
    cols = ([h for h, _ in votes], [p for _, p in votes], [v[0] for v in votes.values()], [v[1] for v in votes.values()])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["host", "path", "best", "content"])


def winning_paths(docs: DataFrame, host: str = "source", stored: str = "format", text: str = "text") -> DataFrame:
    """(host, path, bad): the container path with most votes at each host, the greater path on a tie and the root without votes, and the paths whose own text isn't read there: those that more pages call links or margins than content, and outside the winner those that as many do."""
    pages = docs.select(F.col(host).cast("string"), F.col(stored).cast("string"), text).where(F.col(text).rlike(r"(?i)<(?:div|article|main|section|td|nav|header|footer|aside)\b"))
    votes = pages.mapInArrow(_votes, "host string, path string, best bigint, content bigint").groupBy("host", "path").agg(F.sum("best").alias("best"), F.sum("content").alias("content"))
    won = F.coalesce(F.max_by("path", F.when(F.col("best") > 0, F.struct("best", F.col("path").alias("p")))), F.lit(""))
    doubtful = votes.groupBy("host").agg(won.alias("path"), F.collect_list(F.when(F.col("content") <= 0, F.struct("path", "content"))).alias("low"))
    inside = lambda x: (x["path"] == F.col("path")) | F.startswith(x["path"], F.concat("path", F.lit("/"))) | (F.col("path") == "")
    low = F.filter("low", lambda x: (x["path"] != F.col("path")) & ((x["content"] < 0) | ~inside(x)))
    return doubtful.select("host", "path", F.transform(low, lambda x: x["path"]).alias("bad"))


Verdict = tuple[str, frozenset[str] | None]


def _reader(known: dict[str, Verdict], consume):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, formats, texts, paths, bad = (batch.column(i).to_pylist() for i in range(6))
            formats = [recognised(t, s) if t else None for t, s in zip(texts, formats, strict=True)]
            found = []
            for t, f, h, p, b in zip(texts, formats, hosts, paths, bad, strict=True):
                path, low = (p, frozenset(b or ())) if p is not None else known.get(h or "", ("", None))
                found.append(blocks(t, f, path, low))
            yield consume(ids, formats, found)

    return read


def _as_blocks(ids: list, formats: list, found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(formats, pa.string()), pa.array([[{"kind": k, "text": t} for k, t in b] for b in found], BLOCKS)], ["id", "format", "blocks"])


def read_documents(docs: DataFrame, consume, schema: str, key: str = "doc_id", host: str = "source", stored: str = "format", text: str = "text") -> DataFrame:
    """What ``consume`` makes of (ids, recognised formats, blocks) of each batch of rows; ids are ``key`` as string."""
    winners = checkpointed(winning_paths(docs, host, stored, text))
    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(host).cast("string").alias("host"), F.col(stored).cast("string").alias("stored"), F.col(text).alias("text"))
    if winners.agg(F.coalesce(F.sum(1 + F.size("bad")), F.lit(0))).first()[0] <= WINNERS:
        known = {r["host"]: (r["path"], frozenset(r["bad"])) for r in winners.collect()}
        return rows.select("*", F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<string>").alias("bad")).mapInArrow(_reader(known, consume), schema)
    salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).withColumn("host", F.coalesce("host", F.lit(""))).join(salted, ["host", "salt"], "left")
    return joined.select("id", "host", "stored", "text", "path", "bad").mapInArrow(_reader({}, consume), schema)


def document_blocks(docs: DataFrame, key: str = "doc_id", host: str = "source", stored: str = "format", text: str = "text") -> DataFrame:
    """(id, format, blocks) of each row; id is ``key`` as string, format the recognised one or null."""
    return read_documents(docs, _as_blocks, "id string, format string, blocks array<struct<kind: string, text: string>>", key, host, stored, text)


def clean_text(blocks_column: str = "blocks"):
    """Clean text with light structure: ``# `` headings, ``- `` items, fenced code, formulas on lines of their own only where they stand alone."""
    line = lambda b: F.when(b.kind == "heading", F.concat(F.lit("# "), b.text)).when(b.kind == "list_item", F.concat(F.lit("- "), b.text)).when(b.kind == "code", F.concat(F.lit("```\n"), b.text, F.lit("\n```"))).when(b.kind == "formula", F.concat(F.lit("$"), b.text, F.lit("$"))).otherwise(b.text)
    return F.array_join(F.transform(blocks_column, line), "\n")


def marked_elements(found: DataFrame) -> DataFrame:
    """(id, element, element_text): one ``document`` row for each text with markup, and its distinct headings, list items, code blocks and formulas."""
    marked = found.where("format IS NOT NULL")
    inner = marked.select("id", F.explode("blocks").alias("b")).where("b.kind IN ('heading', 'list_item', 'code', 'formula')")
    text = F.trim(F.regexp_replace("b.text", r"(?U)\s+", " "))
    return marked.select("id", F.lit("document").alias("element"), F.lit("").alias("element_text")).unionByName(inner.select("id", F.col("b.kind").alias("element"), text.alias("element_text")))
