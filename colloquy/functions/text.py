"""Text functions as columns: cleaning, comparison, flags, routing, formatting, scores."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

CJK = "\\x{4E00}-\\x{9FFF}"
CJK_WIDE = fixed.CJK_WIDE
NORMAL = r"[\s\.,!?;:，。！？；：、\-—\"'\(\)\[\]【】「」]+"


def fillers(lists: dict, level: str, extra=(), excluded=()) -> list[str]:
    """Words up to a level plus extra ones less excluded ones: of most spaces first, then longest, then by name."""
    words = [w for k in fixed.LEVELS[: fixed.LEVELS.index(level) + 1] for w in lists[k]]
    return sorted((set(words) | set(extra)) - set(excluded), key=lambda w: (-w.count(" "), -len(w), w))


def remove_fillers_zh(text: Column, level: str = "medium", middle: bool = False, extra=(), excluded=()) -> Column:
    words = fillers(fixed.FILLERS_ZH, level, extra, excluded)
    start = rf"^(?:\s*(?:{'|'.join(words)})[，、。 ]*)*[，、。 ]*"
    text = F.regexp_replace(text, start, "")
    return reduce(lambda t, w: F.replace(t, F.lit(w), F.lit("")), words, text) if middle else text


def remove_fillers_en(text: Column, level: str = "medium", middle: bool = True, extra=(), excluded=()) -> Column:
    """Fillers in any case go from the start, as long as no letter follows, with the commas, semicolons and spaces after them;
    then, single words as words and phrases wherever they are."""
    words = fillers(fixed.FILLERS_EN, level, extra, excluded)
    text = F.regexp_replace(text, rf"^(?iU:\s*(?:{'|'.join(words)})(?!\p{{L}})[ ,;]*)*[ ,;]*", "")
    return reduce(lambda t, w: F.regexp_replace(t, rf"(?iU)\b{w}\b" if " " not in w else rf"(?iU){w}", ""), words, text) if middle else text


def filtered(text: Column, chinese: bool, level: str = "medium", least: int = 2, middle: bool | None = None) -> Column:
    """Repetitions merged, fillers removed, spaces and marks tidied."""
    if chinese:
        return clean_spaces(remove_fillers_zh(merge_repeats_zh(text, least), level, bool(middle)))
    return clean_spaces(remove_fillers_en(merge_repeats_en(text, least), level, middle is not False))


def merge_repeats_zh(text: Column, least: int = 2) -> Column:
    """A character repeated at least max(least, 3) times, then phrases of 6 to 2 characters repeated at least so often, become one."""
    text = F.regexp_replace(text, rf"([{CJK}])\1{{{max(least, 3) - 1},}}", "$1")
    for n in range(6, 1, -1):
        text = F.regexp_replace(text, rf"([{CJK}]{{{n}}})\1{{{least - 1},}}", "$1")
    return text


def merge_repeats_en(text: Column, least: int = 2) -> Column:
    return F.regexp_replace(text, rf"(?iU)\b(\w+)(?:\s+\1){{{least - 1},}}\b", "$1")


def clean_spaces(text: Column) -> Column:
    for pattern, to in fixed.TIDY:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def comparable(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), NORMAL, "")


def chinese_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", fixed.CHINESE_DIGITS)


def char_similarity(a: Column, b: Column) -> Column:
    """Shared characters (with multiplicity) over the longer length; two empty texts are equal."""
    chars = F.array_distinct(F.split(a, ""))
    count = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    shared = F.aggregate(chars, F.lit(0), lambda s, c: s + F.when(c == "", 0).otherwise(F.least(count(a, c), count(b, c))))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(F.try_divide(shared.cast("double"), longer))


def any_of(text: Column, phrases) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(p)) for p in phrases])


def template_phrase(text: Column) -> Column:
    return any_of(F.lower(text), [p.lower() for p in fixed.BLOCKED_ZH + fixed.BLOCKED_EN])


def language_switch(text: Column, expects_cjk: bool) -> Column:
    """Letters of words of two or more count, and ideographs of any block."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    cjk, latin = F.regexp_count(t, F.lit(f"[{CJK_WIDE}]")), F.length(F.array_join(F.regexp_extract_all(t, F.lit("[A-Za-z]{2,}"), F.lit(0)), ""))
    ratio = F.coalesce(F.try_divide(cjk.cast("double"), cjk + latin), F.lit(0.0))
    wrong = (ratio < 0.2) & (latin > 10) if expects_cjk else (ratio > 0.8) & (cjk > 5)
    return (F.length(t) >= 4) & (cjk + latin > 0) & wrong


def low_confidence(text: Column, confidence: Column, least: float) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.coalesce(confidence < least, F.lit(False)) & ((F.length(t) <= 2) | F.regexp(t, F.lit(r"(?U)^[\s\W]+$")))


def odd_times(start: Column, end: Column, most: float) -> Column:
    return (end - start < 0) | (end - start > most)


def route_question(q: Column) -> Column:
    low = F.lower(q)
    return F.when(any_of(low, fixed.STATS_KEYWORDS), "stats").when(any_of(low, fixed.ACTION_KEYWORDS), "action_items").when(any_of(low, fixed.SPEAKER_KEYWORDS), "speaker").otherwise("search")


def clock(seconds: Column) -> Column:
    """mm:ss, minutes not rolling over to hours."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.floor(seconds % 60))


def mime_type(filename: Column) -> Column:
    ext = F.lower(F.substring_index(filename, ".", -1))
    table = F.create_map(*[F.lit(x) for kv in fixed.MIME.items() for x in kv])
    return F.coalesce(table[ext], F.lit("application/octet-stream"))


def colour_index(name: Column) -> Column:
    """Sum of the UTF-16 units modulo 8 (basic plane)."""
    return F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0), lambda s, c: s + F.ascii(c)) % 8


def keywords(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([{CJK}]{{2,}}|[a-zA-Z]{{3,}}|[0-9]+)"), F.lit(1))


def filler_density_en(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), "[ \\t\\n\\r]+"), lambda w: w.isin(fixed.FILLER_LANGUAGES_EN))
    return F.least(F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)).cast("double") / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))


def filler_density_zh(text: Column) -> Column:
    chars = sum((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit(""))) for w in fixed.DENSITY_FILLERS_ZH), F.lit(0))
    return F.least(chars.cast("double") / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))


def hallucination_count(text: Column) -> Column:
    return sum((F.regexp_count(text, F.lit(f"(?i){p}")) for p in fixed.HALLUCINATIONS), F.lit(0)).cast("long")


def number_issues_zh(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(f"(?<=[{CJK}])\\d(?=[{CJK}])")) + F.regexp_count(text, F.lit(f"(?<!\\d)\\d(?!\\d)(?=[{CJK}]{{2}})"))).cast("long")


def readability(fillers: Column, repeats: Column, numbers: Column, hallucinations: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.4 * fillers - 0.3 * repeats - F.least(0.02 * numbers, F.lit(0.2)) - F.least(0.1 * hallucinations, F.lit(0.3)))


def repetition_density_zh(text: Column) -> Column:
    """For each stretch of three or more repeats of one to six ideographs, the length of three repeats times how often these
    occur in the text, over the text's length; 1 at most."""
    found = F.regexp_extract_all(text, F.lit(f"([{CJK}]{{1,6}})\\1{{2,}}"), F.lit(1))
    thrice = lambda m: F.concat(m, m, m)
    chars = F.aggregate(found, F.lit(0), lambda s, m: s + F.length(text) - F.length(F.replace(text, thrice(m), F.lit(""))))
    return F.least(chars.cast("double") / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))


def transcript_scores(text: Column, chinese: bool) -> Column:
    """A struct of a transcript's densities, counts and readability; blank texts score nothing."""
    zero = F.lit(0.0)
    parts = {
        "filler_density": filler_density_zh(text) if chinese else filler_density_en(text),
        "repetition_density": repetition_density_zh(text),
        "number_issues": number_issues_zh(text) if chinese else F.lit(0).cast("long"),
        "hallucination_count": hallucination_count(text),
    }
    scored = lambda p: F.struct(*[p[k].alias(k) for k in parts], readability(*[p[k] for k in parts]).alias("readability"))
    full = F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in parts.items()])), scored), F.lit(0))  # each part is worked out once
    none = F.struct(zero.alias("filler_density"), zero.alias("repetition_density"), F.lit(0).cast("long").alias("number_issues"), F.lit(0).cast("long").alias("hallucination_count"), zero.alias("readability"))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", none).otherwise(full)


def sentences(text: Column) -> Column:
    """Clauses with the marks that end them; pieces of fewer than two characters go to the one before."""
    parts = F.filter(F.split(text, "(?<=[。！？.!?，,；;])"), lambda p: p != "")
    last = lambda a: F.element_at(a, -1)
    short = lambda p: F.length(F.regexp_replace(p, r"^\s+|\s+$", "")) < 2
    joined = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((F.size(a) > 0) & short(p), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.try_element_at(a, F.lit(-1)), p)))).otherwise(F.concat(a, F.array(p))))
    return F.when(F.size(joined) > 0, joined).otherwise(F.array(text))


def fenced_json(answer: Column) -> Column:
    """What stands in the first fence of a model's answer, else the answer; trimmed."""
    fence = F.regexp_extract_all(answer, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    return F.regexp_replace(F.coalesce(F.get(fence, F.lit(0)), answer), r"^\s+|\s+$", "")


def clean_title(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(answer, fixed.TITLE_MARKS, ""), r"^\s+|\s+$", "")


def completion(body: Column) -> Column:
    """The text of a completion: of one JSON object, or of the `data:` lines of a stream up to [DONE]; malformed lines are skipped."""
    whole = F.get_json_object(body, "$.choices[0].message.content")
    lines = F.transform(F.filter(F.transform(F.split(body, "\n"), F.trim), lambda x: F.startswith(x, F.lit("data:"))), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    done = F.array_position(lines, F.lit("[DONE]")).cast("int")
    parts = F.transform(F.when(done > 0, F.slice(lines, 1, F.greatest(done - 1, F.lit(0)))).otherwise(lines), lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.lit("")))
    return F.when(F.startswith(F.ltrim(body), F.lit("{")), F.coalesce(whole, F.lit(""))).otherwise(F.array_join(parts, ""))


def meeting_name(at: Column) -> Column:
    return F.concat(F.lit("会议 "), F.date_format(at, "MM-dd"), F.lit(" 周"), F.substring(F.lit(fixed.WEEKDAYS), F.dayofweek(at), F.lit(1)), F.date_format(at, " HH:mm"))


def node_height(label: Column, font: float, width: float, padding: float, line: float, least: float) -> Column:
    """Height of a box of a width for a label: ideographs are as wide as the font, other characters 0.55 of it."""
    wide = F.regexp_count(label, F.lit(f"[{fixed.WIDE}]"))
    lines = F.greatest(F.lit(1), F.ceil((wide * font + (F.length(label) - wide) * font * 0.55) / F.lit(width)))
    return F.greatest(F.lit(least), lines * font * line + padding)


def token_budget(text: Column) -> Column:
    return F.greatest(F.lit(8000).cast("long"), F.ceil(F.length(text) * 1.8).cast("long"))


def numbered_lines(answer: Column) -> Column:
    """The `[n] text` lines of a model's answer without its thoughts: an array of (idx, text), texts trimmed and not empty."""
    plain = F.regexp_replace(answer, "(?s)<think>.*?</think>", "")
    pattern = F.lit(r"(?m)^\[(\d+)\][ \t]*(.+)$")
    pairs = F.arrays_zip(F.regexp_extract_all(plain, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(plain, pattern, F.lit(2)).alias("t"))
    return F.filter(F.transform(pairs, lambda p: F.struct(p["n"].cast("long").alias("idx"), F.trim(p["t"]).alias("text"))), lambda p: p["text"] != "")


def line(speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(speaker, F.lit("Unknown")), F.lit("] "), text)


def chunk_text(text: str, size: int = 500, overlap: int = 50) -> list[str]:
    """Chunks of at most size characters that end at a sentence within the last overlap ones where there is one."""
    if 2 * overlap > size:
        raise ValueError("overlap may be half the size at most")
    if not text.strip():
        return []
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            cut = max(text.rfind(m, end - overlap, end) for m in "。！？.!?\n")
            end = cut + 1 if cut >= 0 else end
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        start = end - overlap
    return out


def split_transcript(text: str, size: int) -> list[str]:
    """Pieces of at most size + 1 characters that end at the last sentence mark beyond half of it, else at size."""
    out = []
    while len(text) > size:
        cut = max(text.rfind(m, 0, size + 1) for m in "。！？.!?\n")
        cut = cut + 1 if cut > size * 0.5 else size
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text] if text or not out else out


def transcript_pieces(text: Column, size: int) -> Column:
    """split_transcript() of a column: an array of pieces, null for null."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_transcript(t, size), na_action="ignore")

    return pieces(text)


def rewrite_numbers(text: str) -> str:
    """Short runs of digits beside ideographs become Chinese digits, from right to left, unless a kept pattern covers them."""
    out = text
    for m in reversed(list(re.finditer(r"\d{1,3}", text))):
        a, b = m.span()
        low = max(0, a - 5)
        window = out[low : b + 5]
        first = [p.search(window) for p in fixed.KEPT_NUMBERS]
        if any(f and low + f.start() <= a and low + f.end() >= b for f in first):
            continue
        if any(re.fullmatch(fixed.IDEOGRAPH, c) for c in (out[a - 1 : a] if a else "", out[b : b + 1])):
            out = out[:a] + "".join(fixed.CHINESE_DIGITS[int(d)] if d.isascii() else d for d in m[0]) + out[b:]
    return out


def numbers_rewritten(text: Column) -> Column:
    @F.pandas_udf("string")
    def rewritten(texts: pd.Series) -> pd.Series:
        return texts.map(rewrite_numbers, na_action="ignore")

    return rewritten(text)
