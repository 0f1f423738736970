"""The readable passages of LaTeX source.

Left out: comments (what follows an unescaped ``%`` on a line, ``comment`` environments,
``\\iffalse`` to ``\\fi``), code (``verbatim`` and the like, ``\\verb``), macro definitions, package
loading, references and the preamble but for title, author and date. Formulas become one word.
A passage is a paragraph, a heading, a list item, a caption, a footnote or one of the front fields.
"""

from __future__ import annotations

import re
import unicodedata

#: Stand-ins for escaped characters, so that what is left of their kind is syntax.
_ESCAPED = [("\\\\", "\ue004"), ("\\%", "\ue000"), ("\\{", "\ue001"), ("\\}", "\ue002"), ("\\$", "\ue003"), ("\\_", "_"), ("\\&", "&"), ("\\#", "#"), ("\\-", ""), ("~", " ")]
PLAIN = str.maketrans({"\ue000": "%", "\ue001": "{", "\ue002": "}", "\ue003": "$", "\ue004": " "})

#: Words that stand for what isn't read.
FORMULA, QUOTED, FILLER = "⟨formula⟩", "⟨quoted⟩", "⟨filler⟩"

#: Levels of braces within an argument.
DEPTH = 32
_ARG = r"\{[^{}]*+\}"
for _ in range(DEPTH):
    _ARG = rf"\{{(?:[^{{}}]++|{_ARG})*+\}}"
_OPT = r"(?:\s*\[[^\]]*\])*"
_VERB = re.compile(r"\\(?:verb\*?|lstinline)([^\sA-Za-z*\\{}\[\]])[^\n]*?\1")
_COMMENT = re.compile(r"%[^\n]*")
_COMMENT_BLOCKS = re.compile(r"\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)|\\iffalse(?![A-Za-z]).*?(?:\\fi(?![A-Za-z])|\Z)", re.S)
_CODE = re.compile(r"\\begin\{((?:verbatim|lstlisting|minted|Verbatim|BVerbatim|alltt|filecontents|tikzpicture)\*?)\}.*?(?:\\end\{\1\}|\Z)", re.S)
_MATH = re.compile(r"\\begin\{((?:equation|align|alignat|gather|multline|eqnarray|displaymath|math|flalign)\*?)\}.*?(?:\\end\{\1\}|\Z)|\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$|\$[^$\n]*(?:\n[^$\n]+)*\n?[^$\n]*\$", re.S)
_DEFINITION = re.compile(
    rf"\\(?:re|provide)?newcommand\*?\s*(?:\{{[^{{}}]*\}}|\\[A-Za-z@]+){_OPT}\s*{_ARG}|\\(?:re|provide)command\*?\s*(?:\{{[^{{}}]*\}}|\\[A-Za-z@]+){_OPT}\s*{_ARG}"
    rf"|\\[egx]?def\s*\\[A-Za-z@]+[^{{}}\n]*{_ARG}|\\let\s*\\[A-Za-z@]+\s*=?\s*\\?[A-Za-z@]+|\\DeclareMathOperator\*?\s*(?:{_ARG}|\\[A-Za-z@]+)\s*{_ARG}"
    rf"|\\(?:re)?newenvironment\*?\s*{_ARG}{_OPT}\s*{_ARG}\s*{_ARG}|\\newtheorem\*?\s*{_ARG}{_OPT}\s*{_ARG}{_OPT}|\\(?:usepackage|RequirePackage|documentclass){_OPT}\s*{_ARG}"
)
_REFERENCE = re.compile(rf"\\(?:[A-Za-z]*cite[A-Za-z]*|[A-Za-z]*ref|label|input|include|includegraphics|bibliography|bibliographystyle|pagestyle|thispagestyle|vspace|hspace|setlength|setcounter)\*?{_OPT}\s*{_ARG}")
_FIELD = re.compile(rf"\\(?:title|subtitle|author|date|institute|affil|affiliation|address|email|keywords|abstract|thanks|titlerunning|authorrunning)\*?{_OPT}\s*({_ARG})")
_OWN = re.compile(rf"\\(?:title|subtitle|author|date|institute|affil|affiliation|address|email|keywords|abstract|thanks|titlerunning|authorrunning|part|chapter|section|subsection|subsubsection|paragraph|caption|footnote|footnotetext)\*?{_OPT}\s*({_ARG})")
_BREAK = re.compile(rf"\\(?:begin|end)\s*\{{[^{{}}]*\}}(?:\[[^\]]*\])?|\\bibitem{_OPT}\s*{_ARG}|\\(?:item|maketitle|centering|par|noindent|hline|toprule|midrule|bottomrule|newpage|clearpage|tableofcontents|appendix|quad)(?![A-Za-z])")
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_STYLED = re.compile(rf"\\(?:texttt|textit|textsl|emph|enquote|url|textquote|textsf)\s*{_ARG}")
_MARKED = re.compile(r"``(?:(?!''|``).)*''|“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|‘‘(?:(?!’’).)*’’", re.S)
_STRAIGHT = re.compile(r'(?<![\w="])"[^"\n]{2,80}"(?![\w"])')
_JSON = re.compile(r'[\s{\[\ue001]*"[\w ]+"\s*:')
_LESS = re.compile(r"\\text(less|greater)(?:\{\}|\s)?")
_COMMAND = re.compile(r"\\(?:[A-Za-z@]+\*?|.)")
_ACCENT = re.compile(r"\\([\"'`^~])\s*(?:\{\\?([A-Za-z])\}|\\?([A-Za-z])(?![A-Za-z]{2})|([A-Za-z]))")
#: The combining marks that accent commands stand for.
_MARKS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303"}


def unescaped(text: str) -> str:
    """The text with stand-ins for escaped characters: the form that the other functions read."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    for i, (escape, plain) in enumerate(_ESCAPED):
        text = text.replace(escape, plain)
        if i == 0:  # line breaks are out of the way, and tildes are still there
            text = _ACCENT.sub(_accented, text)
    return text


def _accented(m: re.Match) -> str:
    return unicodedata.normalize("NFC", (m[2] or m[3] or m[4]) + _MARKS[m[1]])


def passages(text: str, filler: re.Pattern) -> list[str]:
    """The passages of an unescaped text; ``filler`` matches the commands that print filler."""
    text = _VERB.sub(QUOTED, text)
    text = _COMMENT.sub("", text)
    text = _COMMENT_BLOCKS.sub("", text)
    text = _CODE.sub("\n\n", text)
    text = _DEFINITION.sub("", text)
    begin = text.find("\\begin{document}")
    if begin >= 0:
        end = text.find("\\end{document}", begin)
        front = "\n\n".join(m[1] for m in _FIELD.finditer(text, 0, begin))
        text = front + "\n\n" + (text[begin + 16 :] if end < 0 else text[begin + 16 : end] + "\n\n" + text[end + 14 :])
    text = _MATH.sub(FORMULA, text)
    text = _REFERENCE.sub("", text)
    text = filler.sub(f" {FILLER} ", text)
    text = _OWN.sub(r"\n\n\1\n\n", text)
    text = _BREAK.sub("\n\n", text)
    return [p for p in _PARAGRAPH.split(text) if p and not p.isspace()]


def readable(passage: str) -> str:
    """The words of a passage. What it quotes or sets apart becomes one word, unless that is all of it."""
    return unquoted(passage).translate(PLAIN)


def unquoted(passage: str) -> str:
    """What is readable of a passage, still with stand-ins for escaped characters."""
    body = passage.strip()
    while True:
        inner = _whole(body)
        if inner is None:
            break
        body = inner
    body = _STYLED.sub(QUOTED, body)
    body = _MARKED.sub(QUOTED, body)
    if not _JSON.match(body):
        body = _STRAIGHT.sub(QUOTED, body)
    body = _LESS.sub(lambda m: "<" if m[1] == "less" else ">", body)
    body = _COMMAND.sub(" ", body)
    return _outer_braces(body)


_STYLE_ALL = re.compile(rf"\\(?:text(?:bf|it|tt|sc|sf|sl|rm|up|md|normal)|emph|underline|textcolor\s*\{{[^{{}}]*\}}|enquote|mbox|fbox|large|centerline)\s*({_ARG})[\s.!]*\Z", re.S)


def _whole(body: str) -> str | None:
    """The inside of a command, braces or quotation marks that hold the whole passage."""
    if m := _STYLE_ALL.match(body):
        return m[1][1:-1].strip()
    if body.startswith("{") and body.endswith("}") and not body.startswith("{{") and _closes_last(body):
        return body[1:-1].strip()
    return None


def _closes_last(body: str) -> bool:
    depth = 0
    for i, c in enumerate(body):
        depth += (c == "{") - (c == "}")
        if depth == 0:
            return i == len(body) - 1
    return False


def _outer_braces(body: str) -> str:
    """Without the braces that group; doubled ones are a template's and stay."""
    return re.sub(r"(?<!\{)\{(?!\{)|(?<!\})\}(?!\})", " ", body) if "{{" in body else body.replace("{", " ").replace("}", " ")
