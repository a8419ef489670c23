"""JSON that arrives dirty: usage blocks, salvage of cut-off replies, arrays inside prose, values of any type."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usage(col: Column, prompt: str = "$.usage.prompt_tokens", completion: str = "$.usage.completion_tokens", total: str = "$.usage.total_tokens") -> Column:
    """prompt, completion and total tokens; absent ones are 0, an absent total is their sum."""
    p, c, t = (F.get_json_object(col, x).try_cast("bigint") for x in (prompt, completion, total))
    p, c = F.coalesce(p, F.lit(0).cast("long")), F.coalesce(c, F.lit(0).cast("long"))
    return F.struct(p.alias("prompt"), c.alias("completion"), F.coalesce(t, p + c).alias("total"))


def array_in_prose(col: Column) -> Column:
    """The text from the first '[' to the last ']', or null."""
    found = F.regexp_extract(col, r"(?s)(\[.*\])", 1)
    return F.when(found != "", found)


OUTCOME = T.StructType([T.StructField("status", T.StringType()), T.StructField("value", T.StringType()), T.StructField("dropped_tail", T.BooleanType()), T.StructField("error", T.StringType())])

_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*\n?|\n?\s*```\s*$")


def salvage_text(text: str | None) -> tuple[str, str | None, bool, str | None]:
    """(status, value, dropped_tail, error): 'clean' as it stands, 'salvaged' where a fence, words around it or a cut tail had to go,
    'malformed' where nothing can be read. A cut array keeps its complete items."""
    if text is None:
        return "malformed", None, False, "no text"
    body = _FENCE.sub("", text)
    begin = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return "malformed", None, False, "no JSON value"
    body = body[begin:]
    try:
        return "clean", json.dumps(json.loads(body)), False, None
    except ValueError as e:
        error = str(e)
    try:
        value, _ = json.JSONDecoder().raw_decode(body)
        return "salvaged", json.dumps(value), False, None
    except ValueError:
        pass
    # scan: after each complete array item, what would close the value there
    stack, cut, quoted, skip = [], None, False, False
    for i, c in enumerate(body):
        if quoted:
            quoted, skip = not (c == '"' and not skip), c == "\\" and not skip
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                break
            if stack and stack[-1] == "]":
                cut = (i + 1, "".join(reversed(stack)))
        elif c == "," and stack and stack[-1] == "]":
            cut = (i, "".join(reversed(stack)))
    if cut:
        try:
            return "salvaged", json.dumps(json.loads(body[: cut[0]] + cut[1])), True, None
        except ValueError:
            pass
    return "malformed", None, False, error


@F.pandas_udf(OUTCOME)
def salvage(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([salvage_text(t) for t in texts], columns=[f.name for f in OUTCOME])


def salvaged(col: Column) -> Column:
    """The outcome struct: values that parse as they stand never leave the JVM.

    The parser takes a value with words after it, so a bracket that something other than ',', ']' or '}' follows sends the text
    to Python too (inside a string this costs time only).
    """
    clean = F.try_parse_json(col)
    whole = col.rlike(r"^\s*[\[{]") & ~col.rlike(r"[}\]]\s*[^,\]}\s]")
    return F.when(clean.isNotNull() & whole, F.struct(F.lit("clean").alias("status"), F.to_json(clean).alias("value"), F.lit(False).alias("dropped_tail"), F.lit(None).cast("string").alias("error"))).otherwise(salvage(col))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def to_marks(col: Column) -> Column:
    """Marks from a JSON value of any type: numbers rounded, the digits of strings joined; within 0 to 100, else null."""
    v = F.try_parse_json(col)
    number = F.try_variant_get(v, "$", "double")
    digits = F.regexp_replace(F.try_variant_get(v, "$", "string"), "[^0-9]", "")
    text = _kind(v) == "STRING"
    from_text = F.when(F.length(digits) > 9, F.lit(100.0)).otherwise(digits.try_cast("double"))
    n = F.when(text, from_text).when(_kind(v).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.round(number))
    return F.when(n.isNotNull(), F.greatest(F.lit(0).cast("long"), F.least(F.lit(100).cast("long"), n.cast("long"))))


def number_from_text(text: Column) -> Column:
    """A question number in a string: 'Q.9', '6)', '5b', '0 7', '01 5', '0 1.1', '4.2'; the integer part counts, other forms give null.

    Of two numbers apart the first counts, and after a single 0 the second. Otherwise white space means nothing.
    """
    spaced = F.regexp_extract(text, r"^\s*([0-9]+)\s+([0-9]+)\s*$", 1), F.regexp_extract(text, r"^\s*([0-9]+)\s+([0-9]+)\s*$", 2)
    core = F.regexp_replace(F.lower(F.regexp_replace(text, r"\s", "")), r"^(?:question\.*)?q*\.*|[.)\]\-–—:}]+$", "")
    plain = F.regexp_extract(core, r"^([0-9]+)(?:\.[0-9]|[a-z])?$", 1)
    return F.when(spaced[0] != "", F.when(spaced[0] == "0", spaced[1]).otherwise(spaced[0])).when(plain != "", plain).try_cast("bigint")


def to_number(col: Column) -> Column:
    """A question number from a JSON value of any type, within 1 to 1000; a float counts with one decimal at most."""
    v = F.try_parse_json(col)
    f = F.try_variant_get(v, "$", "double")
    tenths = F.abs(f * 10 - F.round(f * 10)) < 1e-6
    n = F.when(_kind(v) == "STRING", number_from_text(F.try_variant_get(v, "$", "string"))).when(_kind(v).rlike("^(BIGINT|DOUBLE|DECIMAL)") & tenths, F.floor(f + 1e-9))
    return F.when(n.between(1, 1000), n)


def to_topics(col: Column) -> Column:
    """The trimmed, non-empty strings of a JSON array, or of a single string; else an empty array."""
    v = F.try_parse_json(col)
    listed = F.try_variant_get(v, "$", "array<string>")
    one = F.when(_kind(v) == "STRING", F.array(F.try_variant_get(v, "$", "string")))
    return F.filter(F.transform(F.coalesce(one, listed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
