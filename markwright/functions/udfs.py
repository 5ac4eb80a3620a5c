"""Functions that Spark has no expression for, as Arrow-batched pandas UDFs over small Python helpers."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def tidy_prose(x: pd.Series) -> pd.Series:
    """Compatibility forms composed, curly quotes straight, no space before stops, one space between words."""
    quotes = str.maketrans("‘’“”", "''\"\"")

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        plain = unicodedata.normalize("NFKC", s).translate(quotes)
        return re.sub(r"\s+([,.;:!?])", r"\1", " ".join(plain.split()))

    return x.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def repair_mojibake(x: pd.Series) -> pd.Series:
    """UTF-8 that was read as cp1252 is read again, if that lowers the count of the tell-tale letters."""

    def bad(s: str) -> int:
        return sum(s.count(c) for c in "âÂÃ")

    def one(s: str) -> str:
        if not bad(s):
            return s
        try:
            again = s.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return s
        return again if bad(again) < bad(s) else s

    return x.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def repair_json(x: pd.Series) -> pd.Series:
    """A JSON text from within fences and prose, without trailing commas, with missing closers added; else null."""

    def closers(s: str) -> str:
        stack, quoted, escaped = [], False, False
        for c in s:
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), (c != '"' or escaped)
            elif c == '"':
                quoted = True
            elif c in "[{":
                stack.append("]" if c == "[" else "}")
            elif c in "]}" and stack:
                stack.pop()
        return ('"' if quoted else "") + "".join(reversed(stack))

    def one(s: str) -> str | None:
        body = re.sub(r"```(?:json)?", "", s).strip()
        begin = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
        if begin < 0:
            return None
        body = body[begin:]
        end = max(body.rfind("}"), body.rfind("]"))
        for text in (body[: end + 1], body + closers(body)):
            try:
                return json.dumps(json.loads(re.sub(r",\s*([}\]])", r"\1", text)), ensure_ascii=False)
            except ValueError:
                continue
        return None

    return x.map(one, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType())])))
def inline_options(x: pd.Series) -> pd.Series:
    """The options A to D at the end of a question, from the last place where all four follow in order."""
    run = re.compile(r"(?s)\bA[).]?\s+(.*?)\s+B[).]?\s+(.*?)\s+C[).]?\s+(.*?)\s+D[).]?\s+(.*)")

    def one(s: str | None) -> list[dict]:
        starts = [m.start() for m in re.finditer(r"\bA[).]?\s", s or "")]
        for at in reversed(starts):
            if found := run.match(s, at):
                return [{"label": label, "text": " ".join(t.split())} for label, t in zip("ABCD", found.groups(), strict=True)]
        return []

    return x.map(one)
