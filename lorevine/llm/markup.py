"""Markup residue in text documents: which kinds occur, and clean text that keeps headings, lists, code and formulas.

One left-to-right pass takes code and formulas out first, so that nothing inside them is read as markup, then rewrites block structure line by line, then strips
inline markup. The clean text marks structure in one plain way: ``# `` (one to six) before headings, ``- `` or ``1. `` before list items, code between lines
of three back-quotes or in single back-quotes, formulas between dollar signs, table cells separated by `` | ``. What is left is weighed by line-block distribution:
text lengths are summed over windows of lines, and lines are kept from each surge to the following dive, so lines that were only residue,
and the menus and bars of a page go: where a page has long prose, short lines count only by how much text stands around them, and runs of lines that are nothing but hyperlinks count nothing. A page of
short notes has no long prose and keeps all its lines with letters. Headings, code, formulas, tables and lists of text always carry full weight.

Defined results: null text gives null and no kinds; blank text gives ``""``; texts are processed whole, whatever their length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and of the tags that wiki text borrows from it.
TAGS = (
    "a abbr acronym address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn "
    "div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark "
    "math meta meter nav noscript nowiki object ol optgroup option output p param picture pre progress q ref references rp rt ruby s samp script section select small "
    "source span strike strong style sub summary sup svg syntaxhighlight table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
# LaTeX commands that are known without an argument in braces.
COMMANDS = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi "
    "Sigma Phi Psi Omega cdot cdots ldots dots times div pm mp le leq ge geq ne neq approx equiv sim in notin subset cup cap infty partial nabla sum prod int sqrt frac "
    "to rightarrow leftarrow Rightarrow forall exists item hline quad qquad noindent par newline maketitle tableofcontents centering bfseries itshape textit textbf "
    "left right log ln exp sin cos tan max min lim begin end section subsection emph"
).split()

_ATTR = r"(?:\s+[a-zA-Z_:][\w:.-]*\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+)|\s+(?:checked|disabled|selected|hidden|open|controls|nowrap|noshade|async|defer))*"
TAG = re.compile(rf"</?(?:{'|'.join(sorted(TAGS, key=len, reverse=True))}){_ATTR}\s*/?>", re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
FENCE = re.compile(r"(?m)^[ \t]*(```+|~~~+)[ \t]*([\w+#.-]*)[^\n`]*\n(.*?)(?:^[ \t]*\1[ \t]*$|\Z)", re.S)
PRE = re.compile(r"<(pre|syntaxhighlight|nowiki|source)\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted|Verbatim)\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?(.*?)\\end\{\1\*?\}", re.S)
CODE_TAG = re.compile(r"<(code|tt|kbd|samp)\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
TICKS = re.compile(r"(?<!`)(`+)(?!`)([^`](?:[^\n]|\n(?!\n))*?)(?<!`)\1(?!`)")
TEXTTT = re.compile(r"\\(?:texttt|verb\*?|lstinline)(?:\{([^{}]*)\}|([|!+])(.*?)\2)")
MATH_TAG = re.compile(r"<math\b[^<>]*>(.*?)</math\s*>", re.S | re.I)
MATH_ENV = re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)\*?\}(.*?)\\end\{\1\*?\}", re.S)
DISPLAY = re.compile(r"\$\$(?=[^\s$]|\s+\S)(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
DOLLAR = re.compile(r"(?<![\w$\\])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\w$])")
#: A formula between single dollars holds at least one of these, or is a single letter: prices are not formulas.
MATHS = re.compile(r"[\\^_={}<>]|^[A-Za-z]$|[A-Za-z\d)]\s*[+*/-]\s*[A-Za-z\d(]")
COMMAND = re.compile(r"(?<![\w\\:])\\(?:(?:" + "|".join(sorted(COMMANDS, key=len, reverse=True)) + r")(?![a-zA-Z])|[a-zA-Z]+\*?(?=[\[{]))")
ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-{2,})[ \t]*$")
WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*$")
BULLET = re.compile(r"^([ \t]*)([-+*])[ \t]+(?=\S)(.*)$")
ORDERED = re.compile(r"^([ \t]*)(\d{1,9})[.)][ \t]+(?=\S)(.*)$")
WIKI_LIST = re.compile(r"^([*#:;]{2,}|[:;])[ \t]+(?=[^\s*#:;])(.*)$")
QUOTE = re.compile(r"^ {0,3}(?:>[ \t]?)+(.*)$")
ROW = re.compile(r"^[ \t]*\|(.*)\|[ \t]*$")
RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$")
BOLD = re.compile(r"(?<![\w*\\])\*\*(?=\S)(.+?)(?<=\S)\*\*(?![\w*])|(?<![\w\\])__(?=[^\s_])(.+?)(?<=[^\s_])__(?!\w)")
ITALIC = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w\\/])_(?=[^\s_])([^_\n]*?[^\s_])_(?![\w/])")
STRIKE = re.compile(r"~~(?=[^\s~])(.+?)(?<=[^\s~])~~")
LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(\s*(?:<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\s*\)")
REFERENCE = re.compile(r"!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]")
DEFINITION = re.compile(r"^ {0,3}\[[^\[\]\n]+\]:[ \t]+\S+.*$")
AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
EXTERNAL = re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+([^\]\n]+))?\]")
WIKILINK = re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
QUOTES = re.compile(r"(?<!')('{5}|'{3}|'{2})(?!')(?=\S)(.+?)(?<=\S)\1(?!')")
_HOLD = "\ue000{}\ue001"
#: Around the text of a hyperlink until lines are weighed.
_LINKED = "\ue002{}\ue003"
ANCHOR = re.compile(r"(<a\b[^<>]*\bhref\b[^<>]*>)(.*?)(</a\s*>)", re.S | re.I)
_HELD = re.compile("\ue000(\\d+)\ue001")


def _entity(text: str) -> bool:
    name = text[1:-1]
    return name.startswith("#") or f"{name};" in html.entities.html5


def clean(text: str) -> tuple[str, set[str]]:
    """The clean text before line blocks are weighed, hyperlinks still marked, and the kinds of markup found in ``text``."""
    kinds: set[str] = set()
    held: list[str] = []

    def hold(value: str, kind: str) -> str:
        kinds.add(kind)
        held.append(value)
        return _HOLD.format(len(held) - 1)

    def block(value: str, kind: str, entities: bool = False) -> str:
        return "\n" + hold("```\n" + (html.unescape(value) if entities else value).strip("\n") + "\n```", kind) + "\n"

    def inline(pattern, kind, s, pick=lambda m: next((g for g in m.groups() if g is not None), "")):
        def put(m):
            kinds.add(kind)
            return pick(m)
        return pattern.sub(put, s)

    t = re.sub("[\ue000-\ue003]", "", text).replace("\r\n", "\n").replace("\r", "\n")
    t = FENCE.sub(lambda m: block(m[3], "markdown code"), t)
    t = VERBATIM.sub(lambda m: block(m[2], "latex environment"), t)
    t = MATH_TAG.sub(lambda m: hold(f"${html.unescape(m[1]).strip()}$", "wiki mathematics"), t)
    t = PRE.sub(lambda m: block(re.sub(r"</?code\b[^<>]*>", "", m[2], flags=re.I), "html tag", m[1].lower() == "pre"), t)
    t = CODE_TAG.sub(lambda m: hold(f"`{html.unescape(TAG.sub('', m[2]))}`", "html tag"), t)
    t = inline(COMMENT, "html comment", t, lambda m: "")
    t = TICKS.sub(lambda m: hold(f"`{m[2].strip()}`", "markdown code"), t)
    t = MATH_ENV.sub(lambda m: "\n" + hold(f"${m[2].strip()}$", "latex mathematics") + "\n", t)
    t = DISPLAY.sub(lambda m: hold(f"${next(g for g in m.groups() if g is not None).strip()}$", "latex mathematics"), t)
    t = DOLLAR.sub(lambda m: hold(m[0], "latex mathematics") if MATHS.search(m[1]) else m[0], t)
    t = TEXTTT.sub(lambda m: hold(f"`{m[1] if m[1] is not None else m[3]}`", "latex command"), t)
    t = ANCHOR.sub(lambda m: m[1] + _LINKED.format(m[2]) + m[3], t)
    t = _html(t, kinds)
    t = _latex(t, kinds)
    while TEMPLATE.search(t):  # innermost first
        t = inline(TEMPLATE, "wiki template", t, lambda m: "")
    t = inline(WIKILINK, "wiki link", t, lambda m: m[2] or m[1])
    t = inline(EXTERNAL, "wiki link", t, lambda m: _LINKED.format(m[1]) if m[1] else "")
    t = inline(LINK, "markdown link", t, lambda m: _LINKED.format(m[1]))
    t = inline(REFERENCE, "markdown link", t, lambda m: _LINKED.format(m[1]))
    t = inline(AUTOLINK, "markdown link", t)
    t = _blocks(t, kinds)
    for pattern, kind in ((QUOTES, "wiki emphasis"), (BOLD, "markdown emphasis"), (ITALIC, "markdown emphasis"), (STRIKE, "markdown strike")):
        t = inline(pattern, kind, t, (lambda m: m[2]) if pattern is QUOTES else (lambda m: next(g for g in m.groups() if g is not None)))
    if any(_entity(m[0]) for m in ENTITY.finditer(t)):
        kinds.add("html entity")
        t = html.unescape(t)
    while _HELD.search(t):
        t = _HELD.sub(lambda m: held[int(m[1])], t)
    return t, kinds


def _html(t: str, kinds: set[str]) -> str:
    def put(m: re.Match) -> str:
        kinds.add("html tag")
        name = re.match(r"</?([a-zA-Z0-9]+)", m[0])[1].lower()
        closing = m[0].startswith("</")
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return "\n" if closing else "\n" + "#" * int(name[1]) + " "
        if name == "li":
            return "\n" if closing else "\n- "
        if name in ("td", "th"):
            return " | " if closing else ""
        if name in ("script", "style"):
            return "\n"
        if name in ("p", "div", "br", "hr", "tr", "table", "ul", "ol", "dl", "dt", "dd", "blockquote", "section", "article", "header", "footer", "figure", "pre", "body", "html", "head", "title"):
            return "\n"
        return ""

    t = re.sub(r"<(script|style)\b[^<>]*>.*?</\1\s*>", lambda m: kinds.add("html tag") or "\n", t, flags=re.S | re.I)
    return TAG.sub(put, t)


def _latex(t: str, kinds: set[str]) -> str:
    if "\\" not in t or not COMMAND.search(t):
        return t
    kinds.add("latex command")
    if "\\begin{" in t:
        kinds.add("latex environment")
    heads = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
    t = re.sub(r"(?m)(?<!\\)%[^\n]*$", "", t) if "\\documentclass" in t else t
    t = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: "\n" + "#" * heads[m[1]] + " " + m[2] + "\n", t)
    t = re.sub(r"\\begin\{tabular\}(?:\[[^\]]*\])?(?:\{[^}]*\})?(.*?)\\end\{tabular\}", lambda m: "\n" + re.sub(r"\s*(?<!\\)&\s*", " | ", re.sub(r"\\\\(?:\[[^\]]*\])?|\\hline", "\n", m[1])) + "\n", t, flags=re.S)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", t)
    t = re.sub(r"\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: "\n- " + (m[1] + " " if m[1] else ""), t)
    t = re.sub(r"\\(?:href|textcolor|hyperlink)\{[^{}]*\}\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\(?:label|cite[pt]?|ref|eqref|bibliography|bibliographystyle|usepackage|documentclass|includegraphics|input|include|vspace|hspace)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
    argument = re.compile(r"(?<![\w\\])\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}")
    while (new := argument.sub(r"\1", t)) != t:  # innermost first; each round shortens the text
        t = new
    t = COMMAND.sub("", t)
    return re.sub(r"\\([%&_#${}])", r"\1", t)


def _blocks(t: str, kinds: set[str]) -> str:
    out: list[str] = []
    in_table = False
    for line in t.split("\n"):
        if m := ATX.match(line):
            kinds.add("markdown heading")
            line = f"{m[1]} {m[2]}"
        elif SETEXT.match(line) and out and out[-1].strip() and not out[-1].startswith(("#", "- ")):
            kinds.add("markdown heading")
            out[-1] = ("# " if "=" in line else "## ") + out[-1].strip()
            continue
        elif m := WIKI_HEAD.match(line):
            kinds.add("wiki heading")
            line = "#" * len(m[1]) + " " + m[2]
        elif line.startswith("{|"):
            kinds.add("wiki table")
            in_table = True
            continue
        elif in_table and line.startswith("|}"):
            in_table = False
            continue
        elif in_table and line.startswith("|-"):
            continue
        elif in_table and line[:1] in "|!" and line:
            line = re.sub(r"\s*(\|\||!!)\s*", " | ", line.lstrip("|!+").strip())
        elif RULE.match(line):
            kinds.add("markdown table")
            continue
        elif m := ROW.match(line):
            kinds.add("markdown table")
            line = " | ".join(x.strip() for x in m[1].split("|"))
        elif m := QUOTE.match(line):
            kinds.add("markdown quote")
            line = m[1]
        elif m := ORDERED.match(line):
            kinds.add("markdown list")
            line = f"{m[1]}{m[2]}. {m[3]}"
        elif m := BULLET.match(line):
            kinds.add("markdown list")
            line = f"{m[1]}- {m[3]}"
        elif (m := WIKI_LIST.match(line)) and not (m[1] in (":", ";") and m[2][:1] in ")(-DPp"):
            kinds.add("wiki list")
            line = f"{'  ' * (len(m[1]) - 1)}- {m[2]}"
        elif DEFINITION.match(line):
            kinds.add("markdown link")
            continue
        out.append(line)
    return "\n".join(out)


#: Lines in a block window, and the summed text length at which a surge begins and below which a dive ends it, in a page without long prose.
BLOCK, SURGE, DIVE = 3, 3, 1
#: Text length of a block that is long prose; in a page that has it, lengths at which a surge begins and below which a dive ends it.
PROSE, PROSE_SURGE, PROSE_DIVE = 240, 60, 25
#: Lines of hyperlinks alone, or of less than ``SHORT`` letters and no sentence, that in a row make a menu or bar.
MENU, SHORT = 3, 25
_MARKS = re.compile("[\ue002\ue003]")
_LINK_TEXT = re.compile("\ue002[^\ue002\ue003]*\ue003")
_STRUCTURE = re.compile(r"#{1,6} |\s*- |\s*\d+\. |\$")
_ENDED = re.compile(r"[.!?:;…][\"'”’»)\]]*$")


def _runs(hit: list[bool], blank: list[bool]) -> list[bool]:
    """Which of the lines hit lie in a run of at least ``MENU`` of them, blank lines between not counted."""
    out, run = [False] * len(hit), []
    for i in range(len(hit) + 1):
        if i < len(hit) and hit[i]:
            run.append(i)
        elif i == len(hit) or not blank[i]:
            if len(run) >= MENU:
                for j in run:
                    out[j] = True
            run = []
    return out


def line_blocks(marked: str) -> str:
    """The lines between surges and dives of the summed text lengths; runs of blank lines become one. Hyperlinks are marked by private characters, which go."""
    raw = marked.split("\n")
    lines = [_MARKS.sub("", line) for line in raw]
    # a run of lines that are nothing but hyperlinks is a menu
    menu = _runs(["\ue002" in line and not any(c.isalnum() for c in re.sub(r"^\s*(?:- |\d+\. )", "", _LINK_TEXT.sub("", line))) for line in raw], [not line.strip() for line in lines])
    lengths, structural, code = [], [], False
    for line in lines:
        fence = line.startswith("```")
        code ^= fence
        body = line.strip()
        structural.append(bool(body) and (fence or code or bool(_STRUCTURE.match(line)) or " | " in line))
        lengths.append(sum(c.isalnum() for c in body))
    prose = [0 if s or m else n for n, s, m in zip(lengths, structural, menu, strict=True) if n]
    long = max((sum(prose[i:i + BLOCK]) for i in range(len(prose))), default=0) >= PROSE
    surge, dive = (PROSE_SURGE, PROSE_DIVE) if long else (SURGE, DIVE)
    short = [0 < n < SHORT and not st and not _ENDED.search(line.strip()) for n, st, line in zip(lengths, structural, lines, strict=True)]
    bar = _runs(short, [not line.strip() for line in lines])
    weights = []
    for i, line in enumerate(lines):
        if long and menu[i]:
            weights.append(0)
        elif lengths[i] and (structural[i] or long and not bar[i]) or line.startswith("```"):
            weights.append(max(surge, lengths[i]))  # structure, sentences, and short lines that stand alone
        else:
            weights.append(lengths[i])
    ahead = [sum(weights[i:i + BLOCK]) for i in range(len(weights))]
    keep, inside = [], False
    for i, w in enumerate(weights):
        inside = (ahead[i] >= surge and w > 0) or (inside and (w >= dive or ahead[i] >= dive) and not (long and menu[i]))
        keep.append(inside)
    # one blank line stands for what was cut between two kept blocks
    kept = "\n".join(line.rstrip() if k else "" for line, k in zip(lines, keep, strict=True))
    return re.sub(r"\n{3,}", "\n\n", kept).strip("\n")


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, found = [], []
        for text in batch["_text"]:
            if text is None:
                texts.append(None)
                found.append([])
                continue
            t, kinds = clean(text)
            texts.append(line_blocks(t))
            found.append(sorted(kinds))
        yield pd.DataFrame({"key": batch["key"], "clean_text": texts, "kinds": found})


def cleaned(records: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, clean_text, kinds)`` for every row, repeated ones included; narrow, without a shuffle."""
    kind = records.schema[key].dataType.simpleString()
    rows = records.select(F.col(key).alias("key"), F.col(text).alias("_text"))
    out = rows.where(F.col("_text").isNotNull() & (F.col("_text") != "")).mapInPandas(_run, f"key {kind}, clean_text string, kinds array<string>")
    # texts of nothing stay on the JVM's side
    return out.unionByName(rows.where("_text IS NULL OR _text = ''").select("key", F.col("_text").alias("clean_text"), F.array().cast("array<string>").alias("kinds")))
