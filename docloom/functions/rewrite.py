"""Text rewriting that needs state from line to line: pure functions on one text, and pandas functions over columns of them.

Each rewrite is a plain function from text to text, tested on its own; ``over`` lifts one to a pandas function, so a batch of rows
crosses to Python once through Arrow.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

_TAG = re.compile(r"\**[\[(]\s*(\d{1,2})\s*marks?\s*[\])]\**", re.I)
_PART = re.compile(r"^\s*\**\(([a-z]|[ivx]{1,4})\)\**", re.M)
_BOXED = ("equation", "align", "gather", "matrix", "pmatrix", "bmatrix", "cases", "array", "tabular")


def over(f: Callable[[str], str]):
    """A pandas function over string columns; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run


def decimal_parts(text: str, question: int) -> str:
    """'7 . 2' at a line start of question 7 becomes '(b)', where the spaced form occurs or two compact ones do."""
    mark = re.compile(rf"^(\**)\s*0?{question}(\s*\.\s*)(\d{{1,2}})(\**)(?=\s)", re.M)
    found = list(mark.finditer(text))
    spaced = any(m[2] != "." for m in found)
    if not spaced and len({m[3] for m in found}) < 2:
        return text

    def letter(m):
        n = int(m[3])
        return f"{m[1]}({chr(96 + n)}){m[4]}" if 1 <= n <= 20 else m[0]

    return mark.sub(letter, text)


def _kept_lines(lines: list[str]) -> list[bool]:
    """Which lines lie in fenced code, display maths, an environment or a table."""
    fence = maths = False
    depth, out = 0, []
    for line in lines:
        s = line.strip()
        inside = fence or maths or depth > 0 or s.startswith("|")
        if s.startswith("```"):
            fence, inside = not fence, True
        if not fence:
            if s.count("$$") % 2:
                maths, inside = not maths, True
            if s.startswith("\\["):
                depth, inside = depth + 1, True
            depth += s.count("\\begin{")
            inside = inside or "\\begin{" in s
            depth = max(0, depth - s.count("\\end{") - ("\\]" in s))
        out.append(inside)
    return out


def harden_lines(text: str) -> str:
    """A single line break between plain lines becomes a blank line; code, maths, environments and tables keep theirs."""
    lines = text.split("\n")
    kept = _kept_lines(lines)
    out = [lines[0]]
    for i in range(1, len(lines)):
        if lines[i - 1].strip() and lines[i].strip() and not (kept[i] and kept[i - 1]) and not lines[i].lstrip().startswith("|"):
            out.append("")
        out.append(lines[i])
    return "\n".join(out)


#: Whole lines that carry no content, by how they begin (any case).
BOILERPLATE = ("do not write", "turn over", "end of questions", "answer all questions", "there are no questions", "leave blank", "copyright", "please turn", "blank page", "extra space", "go on to the next")
_BOILER = re.compile(r"^[ \t>*_]*(?:" + "|".join(map(re.escape, BOILERPLATE)) + r")\b.*$\n?", re.I | re.M)
_SERIAL = re.compile(r"^[ \t]*(?:\*?[A-Z]{1,3}\d{5,}[A-Z]?\*?|\d{5,6}|(?:page\s+)?\d{1,3}\s*(?:/|of)\s*\d{1,3}|page\s+\d{1,3})[ \t]*$\n?", re.I | re.M)
_LINES = re.compile(r"^[ \t]*(?:[_.\-]{6,}|answer\s*[:=]?\s*[_.]{3,}.*)[ \t]*$\n?", re.I | re.M)


def collapse(text: str) -> str:
    return (re.sub(r"\n{3,}", "\n\n", text) if "\n\n\n" in text else text).strip()


def strip_boilerplate(text: str) -> str:
    """Without notices, serial codes, page numbers and answer lines."""
    return collapse(_LINES.sub("", _SERIAL.sub("", _BOILER.sub("", text))))


def clean_content(text: str) -> str:
    from docloom.functions.scalars import LIGATURES

    text = heal_polar(strip_boilerplate(text))
    for a, b in LIGATURES.items():
        text = text.replace(a, b)
    return harden_lines(collapse(text))


def heal_polar(text: str) -> str:
    """Lines that follow 'polar equation' or 'curve with equation' and lack delimiters or 'r =' get them."""
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        before = " ".join(lines[max(0, i - 2) : i]).lower()
        s = line.strip()
        bare = s and "$" not in s and not s.endswith((".", ":")) and len(s) < 80
        if bare and "polar equation" in before and re.search(r"theta|θ", s):
            s = s if re.match(r"r\s*=", s) else f"r = {s.lstrip('= ')}"
            line = f"$${s}$$"
        elif bare and "equation" in before and re.search(r"[a-z]\s*[\^²³]|\\frac", s) and not re.search(r"[a-z]{4,}\s+[a-z]{4,}", s):
            s = s if "=" in s else f"y = {s}"
            line = f"$${s}$$"
        out.append(line)
    return "\n".join(out)


#: Ordered rewrites of recognised text to LaTeX.
_LATEX = [
    (re.compile(r"°\s*C\b"), r"\\,^{\\circ}\\mathrm{C}"), (re.compile(r"°"), r"^{\\circ}"), (re.compile(r"½"), r"\\frac{1}{2}"), (re.compile(r"¼"), r"\\frac{1}{4}"), (re.compile(r"¾"), r"\\frac{3}{4}"),
    (re.compile(r"²"), r"^{2}"), (re.compile(r"³"), r"^{3}"), (re.compile(r"⁻¹"), r"^{-1}"), (re.compile(r"×"), r"\\times "), (re.compile(r"÷"), r"\\div "), (re.compile(r"±"), r"\\pm "), (re.compile(r"≤"), r"\\leq "),
    (re.compile(r"≥"), r"\\geq "), (re.compile(r"≠"), r"\\neq "), (re.compile(r"≈"), r"\\approx "), (re.compile(r"√"), r"\\surd "), (re.compile(r"π"), r"\\pi "), (re.compile(r"θ"), r"\\theta "), (re.compile(r"λ"), r"\\lambda "),
    (re.compile(r"μ|µ"), r"\\mu "), (re.compile(r"Ω"), r"\\Omega "), (re.compile(r"Δ"), r"\\Delta "), (re.compile(r"→"), r"\\rightarrow "), (re.compile(r"∞"), r"\\infty "), (re.compile(r"(?<=\d)(?=(?:kg|cm|mm|km|ms|kJ|kW)\b)"), r"\\,"),
]


def latex_sanitize(text: str) -> str:
    """Degrees, fractions, powers, units and signs as LaTeX, in this order."""
    for pattern, to in _LATEX:
        text = pattern.sub(to, text)
    return re.sub(r"[ \t]{2,}", " ", text)


def relocate_marks(text: str) -> str:
    """Mark tags at the ends of what they mark: without parts the last tag ends the text; with parts each part's last tag ends it,
    and a tag before the parts goes to the first one without its own."""
    starts = [m.start() for m in _PART.finditer(text)]
    if not starts:
        tags = list(_TAG.finditer(text))
        if not tags:
            return text
        last = tags[-1]
        body = (text[: last.start()] + text[last.end() :]).rstrip()
        return f"{re.sub(r'[ ]{2,}', ' ', body)} {last[0]}"
    pieces = [text[a:b] for a, b in zip([0, *starts], [*starts, len(text)])]
    lead = _TAG.search(pieces[0])
    out = []
    for i, piece in enumerate(pieces):
        tags = list(_TAG.finditer(piece))
        if i == 0:
            out.append(_TAG.sub("", piece).rstrip() + "\n" if tags else piece)
            continue
        if tags:
            t = tags[-1]
            tail = piece[len(piece.rstrip()) :]
            body = (piece[: t.start()] + piece[t.end() :]).rstrip()
            out.append(f"{body} {t[0]}{tail or ''}")
        elif i == 1 and lead:
            out.append(f"{piece.rstrip()} {lead[0]}{piece[len(piece.rstrip()) :]}")
        else:
            out.append(piece)
    return "".join(out).strip()


_MATHS = re.compile(r"(\$\$.*?\$\$|\$[^$\n]+\$|\\\[.*?\\\])", re.S)


def latex_format(text: str) -> str:
    """Markdown to LaTeX outside maths: bold, italics, list items, sub-parts, images, special characters."""

    def plain(s: str) -> str:
        s = re.sub(r"([%&#_])", r"\\\1", s)
        s = re.sub(r"!\[[^\]]*\]\(([^)]*)\)", r"\\includegraphics[width=\\linewidth]{\1}", s)
        s = re.sub(r"\*\*(.+?)\*\*", r"\\textbf{\1}", s)
        s = re.sub(r"(?<!\*)\*([^*\n]+)\*(?!\*)", r"\\textit{\1}", s)
        s = re.sub(r"(?m)^\s*[-*]\s+", r"\\item ", s)
        return re.sub(r"(?m)^\s*\(([a-z])\)\s*", r"\\part[(\1)] ", s)

    return "".join(p if i % 2 else plain(p) for i, p in enumerate(_MATHS.split(text)))


_OPTION = re.compile(r"(?:^|\s)\(?([A-D])[).]\s+")
#: What a line of three options, or a third row of columns, must hold.
_THIRD, _THIRD_ROW = re.compile(r"C[).]\s"), re.compile(r"^\s*C\s+\S", re.M)


def mcq_options(text: str) -> str:
    """Options A to D in one line, one paragraph each; a line with another order or an option that begins with a command verb stays."""
    if not _THIRD.search(text):
        return text
    out = []
    for line in text.split("\n"):
        marks = list(_OPTION.finditer(line))
        letters = "".join(m[1] for m in marks)
        if len(marks) < 3 or not "ABCD".startswith(letters):
            out.append(line)
            continue
        parts = [line[m.end() : n.start() if n else len(line)].strip() for m, n in zip(marks, [*marks[1:], None])]
        if any(re.match(r"(?i)(state|explain|describe|calculate|show|prove|find)\b", p) for p in parts):
            out.append(line)
            continue
        if lead := line[: marks[0].start()].strip():
            out += [lead, ""]
        for k, (letter, p) in enumerate(zip(letters, parts)):
            out += [f"- **{letter}** {p}"] if k == len(parts) - 1 else [f"- **{letter}** {p}", ""]
    return "\n".join(out)


def table_from_columns(text: str) -> str:
    """Rows 'A  1.2  3.4' under a header of columns two spaces apart become a table."""
    if not _THIRD_ROW.search(text):
        return text
    lines, out, i = text.split("\n"), [], 0
    row = re.compile(r"^\s*([A-D])\s+(\S.*)$")
    while i < len(lines):
        rows = []
        while i + 1 + len(rows) < len(lines) and (m := row.match(lines[i + 1 + len(rows)])) and m[1] == "ABCD"[len(rows) % 4]:
            rows.append(m)
        head = re.split(r"\s{2,}", lines[i].strip())
        cells = [re.split(r"\s{2,}", m[2].strip()) for m in rows]
        if len(rows) >= 3 and len(head) >= 2 and all(len(c) == len(head) for c in cells):
            out.append("| | " + " | ".join(head) + " |")
            out.append("|" + "---|" * (len(head) + 1))
            out += [f"| **{m[1]}** | " + " | ".join(c) + " |" for m, c in zip(rows, cells)]
            i += 1 + len(rows)
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out)


def table_repair(text: str) -> str:
    """Tables get a delimiter row where it is missing, and blank lines around."""
    out: list[str] = []
    lines = text.split("\n")
    is_row = lambda s: s.strip().startswith("|") and s.strip().endswith("|") and len(s.strip()) > 1
    for i, line in enumerate(lines):
        starts = is_row(line) and (i == 0 or not is_row(lines[i - 1]))
        if starts and out and out[-1].strip():
            out.append("")
        if not is_row(line) and i and is_row(lines[i - 1]) and line.strip():
            out.append("")
        out.append(line)
        if starts and not (i + 1 < len(lines) and re.match(r"^\s*\|[\s:|-]+\|\s*$", lines[i + 1])):
            out.append("|" + "---|" * (line.strip().count("|") - 1))
    return "\n".join(out)


#: Macro names that recognised text tears from their backslash.
MACROS = ("frac", "sqrt", "times", "alpha", "beta", "theta", "pi", "sum", "int", "begin", "end", "text", "mathrm", "left", "right", "cdot", "infty", "leq", "geq")
_SPACED = re.compile(r"\\\s+(" + "|".join(MACROS) + r")\b")


def join_commands(text: str) -> str:
    return _SPACED.sub(r"\\\1", text)


def drop_repeats(text: str) -> str:
    """A text of two equal halves of over 40 characters is one; equal neighbouring paragraphs of over 30 are one."""
    s = text.strip()
    half = len(s) // 2
    if half > 40 and s[:half].strip() == s[half:].strip():
        s = s[:half].strip()
    out: list[str] = []
    for p in re.split(r"\n{2,}", s):
        if not (out and p.strip() == out[-1].strip() and len(p.strip()) > 30):
            out.append(p)
    return "\n\n".join(out)


def balance_environments(text: str) -> str:
    """Missing end marks appended."""
    for e in _BOXED:
        text += f"\\end{{{e}}}" * max(0, text.count(f"\\begin{{{e}}}") - text.count(f"\\end{{{e}}}"))
    return text


def pair_dollars(text: str) -> str:
    """'$…$$' and '$$…$' become '$$…$$'; an odd '$$' gets a partner, then an odd '$' outside display maths; nested '$' go."""
    text = re.sub(r"\${3,}", "$$", text)
    text = re.sub(r"(?m)^\s*\$\s*$\n?", "", text)
    text = re.sub(r"(?<!\$)\$([^$\n]+)\$\$(?!\$)", r"$$\1$$", text)
    text = re.sub(r"(?<!\$)\$\$([^$\n]+)\$(?!\$)", r"$$\1$$", text)
    if text.count("$$") % 2:
        text += "$$"
    parts = text.split("$$")
    for i in range(len(parts)):
        if i % 2:
            parts[i] = parts[i].replace("$", "")
        elif parts[i].count("$") % 2:
            parts[i] += "$"
    return "$$".join(parts)


def wrap_matrices(text: str) -> str:
    """Matrices outside maths stand in display maths; blanks just inside its marks go."""
    text = re.sub(r"(?<!\$)(\\begin\{([bpv]?matrix|cases)\}.*?\\end\{\2\})(?!\s*\$)", r"$$\1$$", text, flags=re.S) if "$" not in text else text
    return re.sub(r"\$\$\s*(\\begin\{[bpv]?matrix\}.*?\\end\{[bpv]?matrix\})\s*\$\$", r"$$\1$$", text, flags=re.S)


def heal_delimiters(text: str) -> str:
    for f in (drop_repeats, table_repair, join_commands, wrap_matrices, heal_polar, balance_environments, pair_dollars):
        text = f(text)
    return text


def likely_equation(line: str) -> bool:
    """Whether a line reads as maths: as many maths signs as words, two at least or a macro, and no sentence."""
    s = line.strip()
    words = re.findall(r"(?<!\\)\b[A-Za-z]{3,}\b", s)
    signs = re.findall(r"\\[a-zA-Z]+|[=+^_<>]|(?<=\d)\s*[-*/]\s*(?=\w)", s)
    macro = bool(re.search(r"\\(?:frac|sqrt|int|sum|begin)\b", s))
    return bool(s) and not (s.endswith(".") and len(words) > 4) and len(signs) >= len(words) and (len(signs) >= 2 or macro)


def wrap_equations(text: str) -> str:
    """Lines that read as maths and have no delimiters, as display maths."""
    lines = text.split("\n")
    return "\n".join(f"$$\n{x.strip()}\n$$" if likely_equation(x) and "$" not in x and not kept else x for x, kept in zip(lines, _kept_lines(lines)))


def letters_for_decimals(text: str) -> str:
    def letter(m):
        n = int(m[2])
        return f"\n({chr(96 + n)}) " if 1 <= n <= 20 else m[0]

    return re.sub(r"(?m)^(\d{1,2})(?:\s*\.\s*|\s)(\d{1,2})(?=\s)\s*", letter, text)


def place_marks(text: str) -> str:
    """Tags in order at the ends of the parts; without parts before the first option, else at the end."""
    tags = [m[0] for m in _TAG.finditer(text)]
    if not tags:
        return text
    body = re.sub(r"[ \t]{2,}", " ", _TAG.sub("", text)).rstrip()
    starts = [m.start() for m in _PART.finditer(body)]
    if starts:
        pieces = [body[a:b].rstrip() for a, b in zip([0, *starts], [*starts, len(body)])]
        for i, t in enumerate(tags):
            k = min(i + 1, len(pieces) - 1)
            pieces[k] = f"{pieces[k]} {t}"
        return "\n\n".join(p for p in pieces if p.strip())
    option = re.search(r"(?m)^\s*(?:- \*\*)?\(?A[).*]", body)
    if option:
        return f"{body[: option.start()].rstrip()} {' '.join(tags)}\n\n{body[option.start() :].lstrip()}"
    return f"{body} {' '.join(tags)}"


def marker_cleanup(text: str) -> str:
    """The steps over recognised pages; their order matters."""
    from docloom.functions.scalars import LIGATURES

    for a, b in LIGATURES.items():
        text = text.replace(a, b)
    text = join_commands(text)
    text = _SERIAL.sub("", _BOILER.sub("", text))
    text = letters_for_decimals(text)
    text = re.sub(r"(?mi)^(?:Q\d{1,3}\.?|\d \d )\s*", "", text)
    if "\n(" in text:
        text = re.sub(r"(?m)(?<=[^\n])\n(?=\((?:[a-z]|[ivx]{1,4})\))", "\n\n", text)
    text = table_from_columns(mcq_options(text))
    text = re.sub(r"(?m)^(?:\s*[A-D]\s*$\n?){4,}", "", text)
    return collapse(place_marks(text))


def multiset_share(a: str, b: str) -> float:
    """Share of the shorter text's words (lower-case runs of letters and digits) that the other has too, each as often."""
    from collections import Counter

    x, y = (Counter(re.findall(r"[^\W_]+", t.lower())) for t in (a, b))
    shorter = min(sum(x.values()), sum(y.values()))
    return sum((x & y).values()) / shorter if shorter else 0.0


def attach_figures(text: str, names: list[str]) -> str:
    """Figures in place of their placeholders in order; those left after the paragraphs that mention them, else at the end."""
    left = list(names)
    text = re.sub(r"\[DIAGRAM_PLACEHOLDER\]", lambda m: f"![]({left.pop(0)})" if left else m[0], text)
    for i, name in enumerate(list(left)):
        m = re.search(rf"(?i)\bfig(?:ure|\.)?\s*{i + 1}\b.*", text)
        if m:
            text = f"{text[: m.end()]}\n\n![]({name})\n{text[m.end() :]}"
            left.remove(name)
    return "\n\n".join([text.rstrip(), *(f"![]({n})" for n in left)]) if left else text
