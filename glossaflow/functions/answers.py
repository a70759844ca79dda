"""Model answers: cleaning and checking of rewritten texts, judge scores out of free text, prompts and batch requests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaflow.functions.text import SPACE, let, strip_edges

# Labels before an answer, wrapping quotes, words of a refusal, length ratios.
LABELS = ("Παράδειγμα\\s+εξόδου", "Έξοδος", "Κανονικοποιημένο\\s+κείμενο", "Output", "Normalized\\s+text", "Απάντηση")
QUOTES = (('"', '"'), ("«", "»"), ("“", "”"), ("'", "'"))
REFUSALS = ("δεν μπορώ", "δε μπορώ", "λυπάμαι", "ως μοντέλο", "ως γλωσσικό μοντέλο", "i cannot", "i can't", "i'm sorry", "as an ai", "as a language model")
SHORTEST, LONGEST = 0.5, 5.0


def _occurrences(text: Column, mark: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))


def cleaned_answer(text: Column) -> Column:
    """Without fence, label and quotes that wrap the whole answer; the pairs of quotes are tried in their order."""
    fence = r"(?s)^```[\p{L}\p{N}_-]*\n(.*?)\n?```[" + SPACE + "]*$"
    out = let(strip_edges(text), lambda x: F.when(F.regexp_like(x, F.lit(fence)), strip_edges(F.regexp_extract(x, fence, 1))).otherwise(x))
    out = F.regexp_replace(out, rf"(?iu)^[{SPACE}]*(?:{'|'.join(LABELS)})[{SPACE}]*[:\uff1a][{SPACE}]*", "")
    for opening, closing in QUOTES:
        out = _unquoted(out, opening, closing)
    return out


def _unquoted(text: Column, opening: str, closing: str) -> Column:
    def strip(x: Column) -> Column:
        once = _occurrences(x, opening) == (2 if opening == closing else 1)
        wrapped = (F.char_length(x) >= 2) & x.startswith(opening) & x.endswith(closing) & once
        return F.when(wrapped, strip_edges(F.substring(x, F.lit(2), F.char_length(x) - 2))).otherwise(x)

    return let(text, strip)


def without_restated_acronyms(text: Column) -> Column:
    """Parentheses that only restate a Greek acronym go; blanks collapse, none before closing marks."""
    out = F.regexp_replace(text, rf"[{SPACE}]*\([{SPACE}]*[Α-ΩΪΫ](?:[.{SPACE}]*[Α-ΩΪΫ])+[{SPACE}]*\.?[{SPACE}]*\)", "")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return strip_edges(F.regexp_replace(out, rf"[{SPACE}]+([,.;:!»)])", "$1"))


def answer_warnings(original: Column, cleaned: Column) -> Column:
    """Why an answer looks unusable, in fixed order; an empty array if it does not."""
    lowered, own = F.lower(cleaned), F.lower(original)
    marker = F.coalesce(*[F.when(lowered.contains(m) & ~own.contains(m), F.lit(m)) for m in REFUSALS])
    shown = F.when(marker.contains("'"), F.concat(F.lit('"'), marker, F.lit('"'))).otherwise(F.concat(F.lit("'"), marker, F.lit("'")))
    ratio = F.char_length(cleaned) / F.greatest(F.char_length(original), F.lit(1))
    as_text = F.format_string("%.2f", ratio)
    length = F.when(ratio < SHORTEST, F.concat(F.lit("output too short (ratio "), as_text, F.lit(")"))).when(ratio > LONGEST, F.concat(F.lit("output too long (ratio "), as_text, F.lit(")")))
    lines = F.when(_occurrences(cleaned, "\n") > _occurrences(original, "\n") + 2, F.lit("output has unexpected extra lines"))
    rest = F.array_compact(F.array(F.when(marker.isNotNull(), F.concat(F.lit("possible refusal/meta text: "), shown)), length, lines))
    return F.when(F.coalesce(cleaned, F.lit("")) == "", F.array(F.lit("empty output"))).otherwise(rest)


def checked_answer(original: Column, answer: Column) -> Column:
    """``struct(text, warnings)`` of an answer; any warning brings the original back."""
    def check(cleaned: Column) -> Column:
        shaped = lambda w: F.struct(F.when(F.size(w) > 0, original).otherwise(cleaned).alias("text"), w.alias("warnings"))
        return let(answer_warnings(original, cleaned), shaped)

    return let(without_restated_acronyms(cleaned_answer(answer)), check)


def _score(value: Column, low: float, high: float) -> Column:
    """A variant as a score: numbers and the first number in a string, clamped; booleans and all else null."""
    def score(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        number = F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, "$", "double"))
        in_text = F.nullif(F.regexp_extract(F.try_variant_get(v, "$", "string"), r"(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
        found = F.when(kind == "STRING", in_text).otherwise(number)
        return F.when(found.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), found)))

    return let(value, score)


def judged(text: Column, dimensions: Iterable[str], low: float = 1.0, high: float = 5.0) -> Column:
    """``struct(mos, mos_overall, comment, flaws, parse_ok)`` out of a judge's answer.

    The outermost braces hold the scores, at the top or under 'scores'. The overall score falls back from 'overall' to
    'overall_mos' to the mean of the dimensions present (unrounded; the report rounds). Anything unreadable is null.
    """
    dims = list(dimensions)
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    field = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")

    def scores(source: Column) -> Column:
        scored = F.array(*[_score(field(source, d), low, high) for d in dims]) if dims else F.array().cast("array<double>")
        overall = F.coalesce(_score(field(source, "overall"), low, high), _score(field(source, "overall_mos"), low, high))
        return let(F.struct(scored.alias("s"), overall.alias("o")), lambda p: F.struct(p["s"].alias("s"), F.coalesce(p["o"], _mean(p["s"])).alias("o")))

    def read(payload: Column) -> Column:
        nested, comment, flaws = field(payload, "scores"), field(payload, "comment"), field(payload, "flaws_and_deductions_log")
        source = let(nested, lambda v: F.when(is_object(v), v).otherwise(payload))
        said = let(comment, lambda v: F.when(F.schema_of_variant(v) == "STRING", strip_edges(F.try_variant_get(v, "$", "string"))))
        logged = let(flaws, lambda v: F.when(is_object(v), F.to_json(v)))
        return F.struct(let(source, scores).alias("r"), said.alias("c"), logged.alias("f"))

    def shape(got: Column) -> Column:
        mos = F.map_from_arrays(F.array(*map(F.lit, dims)), got["r"]["s"]) if dims else F.create_map().cast("map<string,double>")
        return F.struct(mos.alias("mos"), got["r"]["o"].alias("mos_overall"), got["c"].alias("comment"), got["f"].alias("flaws"), got["r"]["o"].isNotNull().alias("parse_ok"))

    parsed = F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))
    return let(let(let(parsed, lambda v: F.when(is_object(v), v)), read), shape)


def _mean(values: Column) -> Column:
    return let(F.array_compact(values), lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)))


STYLES = ("standard", "strict")


def system_prompt(dimensions: dict[str, str | tuple[str, str]], style: str = "standard", with_reference: bool = True) -> str:
    """Instructions of a judge in one of two styles, for clips whose text is given or not; answers as JSON.

    dimensions: what each one means; a pair says it with and without the text. The strict style has every flaw listed before
    its deduction. An unknown style is refused.
    """
    if style not in STYLES:
        raise ValueError(f"unknown style: {style}")
    strict = style == "strict"
    meaning = lambda m: m if isinstance(m, str) else m[0 if with_reference else 1]
    lines = "\n".join(f"- {name}: {meaning(m)}" for name, m in dimensions.items())
    keys = ", ".join(f'"{name}": 1-5' for name in dimensions)
    log = ", ".join(f'"{name}_anomalies": "..."' for name in dimensions)
    shape = f'{{"flaws_and_deductions_log": {{{log}}}, "scores": {{{keys}, "overall_mos": 1-5}}, "comment": "..."}}' if strict else f'{{{keys}, "overall": 1-5, "comment": "..."}}'
    start = "List every flaw you hear first. Start each score at 5 and take off what the flaws cost." if strict else "Score each dimension by itself; half points are allowed."
    text = "The text that should be heard is given; words left out, added or misread count." if with_reference else "The text is not given; judge by what can be heard."
    return f"You rate synthesised speech. {start} Each score lies between 1 and 5.\n{lines}\n{text}\nAnswer with JSON only: {shape}"


def user_prompt(reference: Column, with_reference: bool = True) -> Column:
    """The request for one clip; without a reference text, or with an empty one, it names none."""
    bare = F.lit("Rate the attached clip.")
    if not with_reference:
        return bare
    return F.when(F.coalesce(reference, F.lit("")) != "", F.concat(bare, F.lit(" It should say: "), reference)).otherwise(bare)


def generation_config(**options) -> Column:
    """A JSON object of the options that are set."""
    return F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(options.items()) if v is not None]))


def batch_request(key: Column, prompt: Column, mime: Column, *, audio: Column | None = None, uri: Column | None = None, instructions: str, config: dict | None = None) -> Column:
    """One line of a batch: the prompt with the clip inline (base64) or by URI."""
    clip = F.struct(F.struct(F.base64(audio).alias("data"), mime.alias("mime_type")).alias("inline_data")) if audio is not None else F.struct(F.struct(uri.alias("file_uri"), mime.alias("mime_type")).alias("file_data"))
    text = F.struct(prompt.alias("text"))
    parts = F.concat(F.lit("["), F.to_json(text), F.lit(","), F.to_json(clip), F.lit("]"))
    rest = f',"generation_config":{_json(config)}' if config else ""
    head = f'"system_instruction":{{"parts":[{{"text":{_json(instructions)}}}]}}'
    return F.concat(F.lit('{"key":'), F.to_json(F.struct(key.alias("k"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(key.alias("k")))) - 6), F.lit(f',"request":{{{head},"contents":[{{"role":"user","parts":'), parts, F.lit("}]" + rest + "}}"))


def _json(value) -> str:
    import json

    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def response_text(response: Column) -> Column:
    """Texts of the first candidate's parts, one per line; null if there is none."""
    parsed = F.from_json(response, "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>")
    texts = F.transform(F.get(parsed["candidates"], F.lit(0))["content"]["parts"], lambda p: p["text"])
    return F.nullif(F.array_join(F.array_compact(texts), "\n"), F.lit(""))


def usage_metadata(response: Column) -> Column:
    """Token usage as JSON under either spelling of its name."""
    payload = F.try_parse_json(response)
    return F.to_json(F.coalesce(F.try_variant_get(payload, "$.usageMetadata", "variant"), F.try_variant_get(payload, "$.usage_metadata", "variant")))


def transcript_text(text: Column, segments: Column) -> Column:
    """Text of a transcript: ``text`` as it is, else its segments' texts joined by spaces and stripped, else ''."""
    joined = F.array_join(F.transform(segments, lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    return F.coalesce(text, strip_edges(joined), F.lit(""))
