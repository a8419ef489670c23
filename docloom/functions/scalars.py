"""Scalar functions of texts as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and the letters they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Words that tell subjects apart; each counts once where the text contains it. Subjects and subtopics of maths, by
#: whether school or further maths is named; the words that name school maths.
KEYWORDS = {
    "computing": ["array", "pointer", "recursion", "binary tree", "linked list", "stack", "queue", "hash table", "algorithm", "big-o", "o(n)", "complexity", "sql", "database", "sorting", "searching", "compiler", "interpreter", "cpu", "register", "cache", "encryption", "network", "protocol", "tcp", "ip address", "subroutine", "function call", "object-oriented", "class", "inheritance", "polymorphism", "binary", "hexadecimal", "boolean", "pseudocode", "flowchart", "assembly"],
    "math": ["matrix", "determinant", "eigenvalue", "eigenvector", "differential equation", "integration", "differentiation", "calculus", "gradient", "vector", "scalar", "proof", "induction", "complex number", "argand", "polynomial", "binomial", "series", "sequence", "limit", "convergence", "trigonometry", "sine", "cosine", "tangent", "logarithm", "exponent", "modulus", "inequality", "quadratic"],
    "physics": ["kinetic energy", "potential energy", "momentum", "velocity", "acceleration", "force", "newton", "wavelength", "frequency", "magnetic field", "electric field", "voltage", "current", "resistance", "ohm", "capacitor", "inductor", "photon", "quantum", "nuclear", "radioactive", "half-life", "thermal", "entropy", "pressure", "density", "refraction", "diffraction"],
    "chemistry": ["mole", "molarity", "titration", "oxidation", "reduction", "electrode", "catalyst", "reaction rate", "equilibrium", "enthalpy", "entropy", "gibbs", "bond energy", "lattice", "atomic number", "electron configuration", "periodic table", "organic", "hydrocarbon", "ester", "polymer"],
    "biology": ["cell membrane", "mitosis", "meiosis", "dna", "rna", "protein synthesis", "enzyme", "atp", "photosynthesis", "respiration", "ecosystem", "natural selection", "evolution", "chromosome", "allele", "genotype", "phenotype", "nervous system", "homeostasis", "osmosis"],
}
SCHOOL = ["gcse", "level 2 certificate", "secondary education"]
MATHS = {
    "school further": ("GCSE Further Mathematics (AQA)", "Algebra"),
    "school": ("GCSE Mathematics (Edexcel)", "Algebra"),
    "further": ("A Level Further Mathematics (Edexcel)", "Pure Mathematics"),
    "plain": ("A Level Mathematics (Edexcel)", "Pure"),
}
OTHER = ("General", "Imported")
_MARK = r"(?i)[\[(]\s*\**\s*([0-9]{1,2})\s*marks?\s*\**\s*[\])]"


def inline_marks_sum(text: Column) -> Column:
    """The sum of all '[n marks]' and '(n marks)' with n of 25 at most."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_MARK), 1), lambda x: x.cast("int"))
    return F.aggregate(F.filter(found, lambda x: x <= 25), F.lit(0), lambda a, x: a + x)


def last_mark(text: Column) -> Column:
    """The last '[n marks]' or '(n)' within 1 to 25; 1 where there is none."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?:\[\s*|\()([0-9]{1,3})(?:\s*marks?)?\s*[\])]"), 1)
    n = F.try_element_at(found, F.lit(-1)).cast("int")
    return F.when(n.isNull(), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(25), n)))


def first_math(text: Column) -> Column:
    """The first maths span between dollars, or ''."""
    return F.regexp_extract(text, r"(?s)(\$\$.+?\$\$|\$[^$\n]+\$)", 1)


def split_questions(text: Column) -> Column:
    """Pieces that begin at a numbered line, of more than 20 bytes; by '---' where there is one piece at most; else the whole."""
    keep = lambda a: F.filter(F.transform(a, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.octet_length(x) > 20)
    numbered = keep(F.split(text, r"(?m)(?=^(?:Q(?:uestion)?\s*)?[0-9]{1,2}[.)]\s)"))
    ruled = keep(F.split(text, "---"))
    return F.when(F.size(numbered) > 1, numbered).when(F.size(ruled) > 0, ruled).otherwise(keep(F.array(text)))


def keyword_class(text: Column) -> Column:
    """subject, subtopic and is_code by the subject with most keywords in the text. Maths wins ties and splits by further words; where
    another subject leads, or none is named, the text is general. No subject counts as code."""
    low = F.lower(text)
    n = {s: reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in ws)) for s, ws in KEYWORDS.items()}
    top = F.greatest(*n.values())
    school, further = reduce(lambda a, b: a | b, map(low.contains, SCHOOL)), low.contains("further")
    both = lambda names: F.struct(F.lit(names[0]).alias("subject"), F.lit(names[1]).alias("subtopic"), F.lit(False).alias("is_code"))
    math = F.when(school & further, both(MATHS["school further"])).when(school, both(MATHS["school"])).when(further, both(MATHS["further"])).otherwise(both(MATHS["plain"]))
    return F.when((top > 0) & (n["math"] == top), math).otherwise(both(OTHER))


def terminal_ending(text: Column) -> Column:
    """Whether a text ends as a finished one does: a mark tag, maths, code, a table row or closing punctuation."""
    t = F.regexp_replace(text, r"\s+$", "")
    return F.coalesce(t.rlike(r"(?i)(\[\s*[0-9]+\s*marks?\s*\]|[.?!)\]:;$`|])$") & (t != ""), F.lit(False))


def clean_ligatures(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), text)


def drop_examiner_codes(text: Column) -> Column:
    """Lines without trailing codes as 'M1', 'A1ft' or 'B2', trimmed; empty lines go."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?:\s+(?:M|A|B|E|dM)[0-9](?:ft|cao|oe)?)+\s*$", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def figure_refs(text: Column) -> Column:
    """Numbers of the figures that a text mentions, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:figure|fig\.?)\s*([0-9]{1,3})"), 1), lambda x: x.cast("int"))


def placeholders(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\[DIAGRAM_PLACEHOLDER\]"))


def consistency_errors(text: Column, boxes: Column) -> Column:
    """What disagrees between placeholders, figure mentions and boxes."""
    return F.filter(F.array(F.when(placeholders(text) != boxes, "placeholders differ from boxes"), F.when((F.size(figure_refs(text)) > 0) & (boxes == 0), "figures are mentioned without boxes")), lambda x: x.isNotNull())


def content_flags(text: Column) -> Column:
    """Whether the text asks for a grid, has code, a table, or is a footer."""
    grid = text.rlike(r"(?i)\b(draw|plot|sketch)\b") & text.rlike(r"(?i)\b(grid|axes)\b")
    code = text.contains("```") | text.rlike(r"(?m)^\s*(def|class|for|while|if)\b.*:\s*$")
    table = F.regexp_count(text, F.lit(r"(?m)^\s*\|.*\|\s*$")) >= 2
    footer = (F.length(text) < 80) & text.rlike(r"(?i)\b(page|turn over|copyright)\b")
    return F.struct(grid.alias("grid"), code.alias("code"), table.alias("table"), footer.alias("footer"))


def text_density(text: Column) -> Column:
    """0.7 of the share of non-space characters in all bytes and 0.3 of the mean line length over 80 bytes, 1 at most."""
    solid = F.length(F.regexp_replace(text, r"\s", "")) / F.octet_length(text)
    lines = F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) / F.size(F.split(text, "\n"))
    return F.when(F.octet_length(text) == 0, 0.0).otherwise(0.7 * solid + 0.3 * F.least(lines / 80, F.lit(1.0)))


def extraction_route(text: Column, has_figure: Column, reliable: Column) -> Column:
    """text first where the text suffices, crops where figures are mentioned or seen, else the whole page."""
    needs = has_figure | (F.size(figure_refs(text)) > 0)
    return F.when(reliable & ~needs, "text_first").when(reliable & needs, "crop_first").otherwise("full_vision")


def new_question(prev: Column, new: Column) -> Column:
    """Whether a text starts a new question after ``prev``: part (a) again, an early mark tag after some letters, a number."""
    part = F.regexp_extract(new, r"^\s*\(([a-z])\)", 1)
    reset = (part == "a") & prev.rlike(r"\([b-z]\)")
    early = F.substring(new, 1, 200).rlike(r"(?i)\[\s*[0-9]+\s*marks?\s*\]") & (F.length(F.regexp_replace(F.substring(new, 1, 200), r"[^\p{L}]", "")) > 20)
    return reset | early | new.rlike(r"^\s*\**[0-9]{1,3}[.)]?\**\s")


def slice_by_y(text: Column, start: Column, end: Column) -> Column:
    """The lines of a page between two fractions of its height with a margin of 0.06; short pages whole."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    a = F.greatest(F.lit(0), F.floor(n * (start - 0.06))).cast("int")
    z = F.least(n, F.ceil(n * (end + 0.06)).cast("int"))
    return F.when(n <= 2, text).otherwise(F.array_join(F.slice(lines, a + 1, F.greatest(F.lit(0), z - a)), "\n"))


def crop_signals(text: Column) -> Column:
    """Why a crop may be no figure."""
    return F.filter(F.array(F.when(F.length(text) > 300, "much text"), F.when(F.regexp_count(text, F.lit(r"\.")) >= 4, "sentences"), F.when(text.rlike(r"(?i)\[\s*[0-9]+\s*marks?\s*\]"), "mark tag"), F.when(text.rlike(r"(?m)^\s*\([a-z]\)"), "sub-part")), lambda x: x.isNotNull())


def likely_equation(text: Column) -> Column:
    """Whether a text reads as maths: as many maths signs as words, two at least or a macro, and no sentence."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    runs = F.regexp_extract_all(s, F.lit(r"[\\\p{L}\p{N}_]+"), 0)
    words = F.size(F.filter(runs, lambda x: x.rlike("^[A-Za-z]{3,}$")))
    signs = F.regexp_count(s, F.lit(r"\\[a-zA-Z]+|[=+^_<>]|(?<=[0-9])\s*[-*/]\s*(?=[\p{L}\p{N}_])"))
    macro = s.rlike(r"\\(?:frac|sqrt|int|sum|begin)\b")
    return (s != "") & ~(s.endswith(".") & (words > 4)) & (signs >= words) & ((signs >= 2) | macro)


def drop_repeated_lines(text: Column, over: int = 30) -> Column:
    """A text without lines of over ``over`` characters that equal the line before, ends aside."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: (i == 0) | (F.length(F.trim(x)) <= over) | (F.trim(x) != F.trim(F.get(lines, i - 1))))
    return F.array_join(kept, "\n")


def visual_option(line: Column) -> Column:
    """Whether a line is the mark of a visual option: a letter A to D alone, or with a placeholder or a bracket, dot or colon after it."""
    return line.rlike(r"^\s*[ABCD]\s*(?:$|\[DIAGRAM_PLACEHOLDER\]|[).:])")


def composite_options(content: Column) -> Column:
    """The content of a question whose options are pictures, with one placeholder for the one picture of them all: from the first of
    two option marks or more, where there are placeholders, all becomes one; without such marks the first of several stays."""
    lines = F.split(content, "\n")
    marks = F.size(F.filter(lines, visual_option))
    first = F.array_position(F.transform(lines, visual_option), True)
    lead = F.regexp_replace(F.array_join(F.slice(lines, 1, F.greatest(first - 1, F.lit(0)).cast("int")), "\n"), r"\s+$", "")
    one = F.lit("[DIAGRAM_PLACEHOLDER]")
    parts = F.split(content, r"\[DIAGRAM_PLACEHOLDER\]")
    rest = F.regexp_replace(F.concat(parts[0], one, F.array_join(F.slice(parts, 2, F.size(parts)), "")), r"^\s+|\s+$", "")
    return F.when((marks >= 2) & (F.size(parts) > 1), F.when(lead == "", one).otherwise(F.concat(lead, F.lit("\n"), one))).when(F.size(parts) > 2, rest).otherwise(content)
