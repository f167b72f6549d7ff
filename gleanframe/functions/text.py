"""Column functions on texts; everything runs in the JVM except the JSON repair."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inclusive code point ranges of weight 2 in a weighted text length.
HEAVY = (
    (0x1100, 0x115F),
    (0x2E80, 0x303E),
    (0x3041, 0x33FF),
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0xA000, 0xA4CF),
    (0xA960, 0xA97F),
    (0xAC00, 0xD7A3),
    (0xF900, 0xFAFF),
    (0xFE30, 0xFE4F),
    (0xFF00, 0xFF60),
    (0xFFE0, 0xFFE6),
    (0x2190, 0x21FF),
    (0x2300, 0x23FF),
    (0x2460, 0x24FF),
    (0x25A0, 0x27BF),
    (0x2B00, 0x2BFF),
    (0x1F000, 0x1FAFF),
    (0x1FB00, 0x1FBFF),
)
#: Joiner, variation selectors and skin tones, of weight 0.
WEIGHTLESS = ((0x200D, 0x200D), (0xFE0E, 0xFE0F), (0x1F3FB, 0x1F3FF))


def code_class(ranges: tuple) -> str:
    """A regular expression class of code point ranges, as Java and RE2 read it."""
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def weighted_length(text: Column) -> Column:
    """Length in which heavy code points count 2 and weightless ones 0; null stays null."""
    shown = F.regexp_replace(text, code_class(WEIGHTLESS), "")
    return F.length(shown) * 2 - F.length(F.regexp_replace(shown, code_class(HEAVY), ""))


def weighted_prefix(text: Column, limit: Column | int) -> Column:
    """Longest prefix of weight at most ``limit``; weightless code points at its end stay.

    Positions are cut by a fold over the code points that carries the weight so far, so a text is
    read once, whatever the limit.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    start = F.struct(F.lit(0).alias("weight"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def step(acc: Column, ch: Column) -> Column:
        w = F.when(ch.rlike(code_class(WEIGHTLESS)), 0).when(ch.rlike(code_class(HEAVY)), 2).otherwise(1)
        over = acc["full"] | (acc["weight"] + w > limit)
        return F.struct(
            F.when(over, acc["weight"]).otherwise(acc["weight"] + w).alias("weight"),
            F.when(over, acc["kept"]).otherwise(acc["kept"] + 1).alias("kept"),
            over.alias("full"),
        )

    kept = F.aggregate(F.split(text, ""), start, step, lambda acc: acc["kept"])
    # short texts need no fold: two units a code point is the most there is
    return F.when(limit <= 0, "").when(F.length(text) * 2 <= limit, text).otherwise(F.substring(text, F.lit(1), kept))


def tag_in_place(line: Column, word: str) -> Column:
    """``line`` with its first whole occurrence of ``word`` turned into a tag; null if there is none.

    A line that already holds the tag stays as it is. Case does not matter.
    """
    quoted = r"\Q" + word + r"\E"
    tagged = rf"(?iU)#{quoted}(?!\w)"
    whole = rf"(?iU)(?<![#\w]){quoted}(?!\w)"
    first = rf"(?isU)^(.*?)(?<![#\w])({quoted})(?!\w)"
    return F.when(line.rlike(tagged), line).when(line.rlike(whole), F.regexp_replace(line, first, "$1#$2"))


def post_text(caption: Column, line: Column, word: str, limit: int = 280) -> Column:
    """Caption, line and one tag under a weighted limit; only the caption is ever cut."""
    tag = f"#{word}" if word else ""
    inside = tag_in_place(line, word) if word else F.lit(None).cast("string")
    shown = F.nullif(F.coalesce(inside, line), F.lit(""))
    own = F.when(inside.isNull() & F.lit(bool(word)), F.lit(tag))
    cost = F.coalesce(weighted_length(shown) + 1, F.lit(0)) + F.coalesce(weighted_length(own) + 1, F.lit(0))
    body = F.rtrim(weighted_prefix(F.trim(F.coalesce(caption, F.lit(""))), F.lit(limit) - cost))
    return F.concat_ws("\n", F.nullif(body, F.lit("")), shown, own)


def single_spaced(text: Column) -> Column:
    """Inner runs of white space as one space, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def safe_label(text: Column, longest: int) -> Column:
    """Words of letters and digits joined by ``-``, other characters ``_``, cut to ``longest``."""
    return F.substring(F.regexp_replace(F.regexp_replace(single_spaced(text), "[^A-Za-z0-9 ]", "_"), " ", "-"), 1, longest)


def first_line(text: Column) -> Column:
    """The first line without outer blanks; null where that is empty."""
    return F.nullif(F.trim(F.get(F.split(text, "\n"), F.lit(0))), F.lit(""))


def bar(value: Column, longest: int = 28) -> Column:
    """A bar of as many blocks as ``value`` has whole units, at most ``longest``."""
    return F.repeat(F.lit("█"), F.greatest(F.lit(0), F.least(F.lit(longest), value.cast("int"))))


# ---- JSON that a model wrote
def _objects(text: str):
    """Readings of a text as a JSON object, from strict to repaired."""
    yield text
    for m in re.finditer(r"\{", text):
        try:
            yield json.dumps(json.JSONDecoder(strict=False).raw_decode(text, m.start())[0])
        except ValueError:
            continue
        break
    closed = text[text.index("{") :] if "{" in text else text
    quotes = len(re.findall(r'(?<!\\)"', closed))
    yield closed.rstrip() + ('"' if quotes % 2 else "") + "}" * max(0, closed.count("{") - closed.count("}"))


def repaired_object(text: str | None) -> str | None:
    """A JSON object read from fenced, wrapped, unfinished or control-character-ridden text; else null."""
    if text is None:
        return None
    bare = re.sub(r"^\s*```\w*[ \t]*\n?|\n?\s*```\s*$", "", text).strip()
    for t in _objects(bare):
        try:
            got = json.loads(t, strict=False)
        except ValueError:
            continue
        if isinstance(got, dict):
            return json.dumps(got, ensure_ascii=False, sort_keys=True)
    return None


def json_object(text: Column) -> Column:
    """:func:`repaired_object` as a column; valid objects could be read natively, this is for the rest."""

    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(repaired_object)

    return repair(text)
