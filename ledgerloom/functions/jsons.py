"""Repairing JSON that a model has written, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# a string, open or closed; a comment; a mark; anything else between them
_TOKEN = r"\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\\?\"?|//[^\n]*+|/\*[\s\S]*?\*/|[{}\[\],:]|[^\s\"{}\[\],:/]++|/"
_FENCE = r"(?is)```(?:json)?\s*(.*?)(?:```|$)"
# Words of other languages for JSON's own, and marks that stand for quotation marks.
WORDS = {"True": "true", "False": "false", "None": "null", "NaN": "null", "undefined": "null"}
QUOTES, QUOTE = "“”„‟＂", '"'


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it stands in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _closed(token: Column) -> Column:
    """A string token with its end; line breaks and tabs in it as JSON writes them."""
    ended = (F.length(token) > 1) & F.endswith(token, F.lit(QUOTE)) & (F.length(F.regexp_extract(token, r'(\\*+)"$', 1)) % 2 == 0)
    # an escape that the end cuts off goes
    cut = F.regexp_replace(F.when(F.length(F.regexp_extract(token, r"(\\*+)$", 1)) % 2 == 1, F.left(token, F.length(token) - 1)).otherwise(token), r"\\u[0-9A-Fa-f]{0,3}$", "")
    made = F.when(ended, token).otherwise(F.concat(cut, F.lit(QUOTE)))
    return F.replace(F.replace(F.replace(made, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))


def _fold(tokens: Column) -> Column:
    """struct<stack, done, n>: what closes the brackets still open, and how many tokens the first value has."""

    def step(a: Column, t: Column) -> Column:
        stack = F.when(t == "{", F.concat(F.lit("}"), a["stack"])).when(t == "[", F.concat(F.lit("]"), a["stack"])).when(t.isin("}", "]"), F.substr(a["stack"], F.lit(2))).otherwise(a["stack"])
        new = F.struct(stack.alias("stack"), (t.isin("}", "]") & (F.length(a["stack"]) <= 1)).alias("done"), (a["n"] + 1).alias("n"))
        return F.when(a["done"], a).otherwise(new)

    return F.aggregate(tokens, F.struct(F.lit("").alias("stack"), F.lit(False).alias("done"), F.lit(0).alias("n")), step)


def _rebuilt(tokens: Column, stack: Column) -> Column:
    """The tokens as JSON, without commas that lead nowhere, and what is missing at the end."""
    words = F.create_map(*(F.lit(x) for kv in WORDS.items() for x in kv))
    plain = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit(QUOTE)), _closed(t)).otherwise(F.coalesce(F.try_element_at(words, t), t)))
    led = lambda p: F.filter(p, lambda t, i: (t != ",") | ~F.coalesce(F.get(p, i + 1), F.lit("}")).isin("}", "]", ","))

    def whole(k: Column) -> Column:
        last, before = F.get(k, F.size(k) - 1), F.get(k, F.size(k) - 2)
        # a name without a value, at the end
        name = F.startswith(last, F.lit(QUOTE)) & F.startswith(stack, F.lit("}")) & before.isin("{", ",")
        return F.concat(F.array_join(k, ""), F.when(last == ":", F.lit("null")).when(name, F.lit(":null")).otherwise(""), stack)

    return _let(plain, lambda p: _let(led(p), whole))


def repaired_json(text: Column) -> Column:
    """The first object or array of a text as JSON, or null where none can be made out.

    Fences and prose around it go; typographic quotation marks (in a text without plain ones), Python's words and comments
    become JSON; commas before a closing mark or the end go; strings and brackets that are open at the end are closed, a
    name without a value gets null. JSON that is sound stays as it is. One fold over the tokens keeps the open brackets
    only, so the work is linear in the text, and nothing leaves the JVM. Null stays null.
    """
    inner = F.when(F.contains(text, F.lit("```")), F.regexp_extract(text, _FENCE, 1)).otherwise(text)

    def mended(begin: Column) -> Column:
        marks = F.when(F.contains(begin, F.lit(QUOTE)), begin).otherwise(F.translate(begin, QUOTES, QUOTE * len(QUOTES)))
        tokens = F.filter(F.regexp_extract_all(marks, F.lit(_TOKEN), F.lit(0)), lambda t: ~(F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*"))))

        def value(ts: Column, f: Column) -> Column:
            # the parser passes over what follows the first value; here that is no part of it
            made = _let(_rebuilt(F.slice(ts, F.lit(1), f["n"]), f["stack"]), lambda m: F.when(F.try_parse_json(m).isNotNull(), m))
            return F.when((f["n"] == F.size(ts)) & F.try_parse_json(begin).isNotNull(), F.rtrim(begin)).otherwise(made)

        return _let(tokens, lambda ts: F.when(F.size(ts) > 0, _let(_fold(ts), lambda f: value(ts, f))))

    return _let(F.regexp_extract(inner, r"(?s)[{\[].*$", 0), mended)
