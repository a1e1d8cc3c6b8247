"""Text normalisation, scripts, character ratios, words and repetition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code-point ranges of the scripts, in the order of the rules.
SCRIPTS = {
    "Latin": [(0x0041, 0x024F)],
    "Cyrillic": [(0x0400, 0x052F)],
    "Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F)],
    "Devanagari": [(0x0900, 0x097F)],
    "Bengali": [(0x0980, 0x09FF)],
    "Tamil": [(0x0B80, 0x0BFF)],
    "Telugu": [(0x0C00, 0x0C7F)],
    "Japanese": [(0x3040, 0x30FF)],
    "Han": [(0x4E00, 0x9FFF)],
    "Hangul": [(0xAC00, 0xD7AF)],
}
#: The script expected of each language name or code.
LANGUAGE_SCRIPT = {
    "arabic": "Arabic", "bengali": "Bengali", "bangla": "Bengali", "bn": "Bengali", "chinese": "Han", "zh": "Han", "english": "Latin", "en": "Latin",
    "hindi": "Devanagari", "hi": "Devanagari", "japanese": "Japanese", "ja": "Japanese", "korean": "Hangul", "ko": "Hangul", "russian": "Cyrillic", "ru": "Cyrillic",
    "sanskrit": "Devanagari", "sa": "Devanagari", "tamil": "Tamil", "ta": "Tamil", "telugu": "Telugu", "te": "Telugu", "urdu": "Arabic", "ur": "Arabic",
}
#: Openings that instruction data is freed of, in this order.
BOILERPLATE = ["As an AI language model, ", "As an AI, ", "I am an AI, ", "Sure, I can help with that! ", "Certainly! ", "Of course! "]

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The characters of SPACE.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c\x1d\x1e\x85  ]"
#: Holds before each white space and before few other characters: tells most positions apart in two comparisons.
_NEAR_SPACE = r"(?=[^!-\x84\x{A1}-\x{167F}])"
#: Line breaks besides the line feed.
_LINE_ENDS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
WORD = r"[\p{L}\p{N}_]+"
#: Control, format, private and surrogate characters, with format characters of later Unicode than the JVM's. Not \p{C}, which has each character that the JVM does not know, newer letters and emoji too.
OTHER = r"\p{Cc}\p{Cf}\p{Co}\p{Cs}\x{0890}\x{0891}\x{13439}-\x{1343F}"
#: Fixed value: what counts as a tag.
HTML = r"</?[a-zA-Z][^>]{0,200}>"


#: Texts of characters that are in normal form wherever they stand: all below U+0300, and general punctuation. One loop over the text; a search for any other character begins anew at each.
_PLAIN = r"\A[\x00-\x{02FF}\x{2010}-\x{2027}\x{2030}-\x{205E}]*\z"
#: Texts of those of them whose full case folding is their lower case: no sharp s, micro sign or letters beyond Latin-1.
_PLAIN_CASE = r"\A[\x00-\x{00B4}\x{00B6}-\x{00DE}\x{00E0}-\x{00FF}\x{2010}-\x{2027}\x{2030}-\x{205E}]*\z"
#: Texts of characters of the first script or of none.
_NO_OTHER_SCRIPT = r"\A[\x00-\x{03FF}\x{2010}-\x{205E}]*\z"


def _is_ascii(c: Column) -> Column:
    return c.isNull() | (F.octet_length(c) == F.length(c))


def _any_of(c: Column, pieces: list[str]) -> Column:
    return reduce(Column.__or__, (F.contains(c, F.lit(p)) for p in pieces))


def nfc(c: Column) -> Column:
    """Unicode NFC on the JVM; most texts hold no character that could change, null stays null."""
    return F.when(_is_ascii(c) | c.rlike(_PLAIN), c).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False)))


def casefold(c: Column) -> Column:
    """Full case folding on the JVM, which is the lower case for most texts."""
    return F.when(_is_ascii(c) | c.rlike(_PLAIN_CASE), F.lower(c)).otherwise(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True)))


def lowercase(c: Column) -> Column:
    """Lower case of each letter by itself, sharp s as two letters: what the queries' SQL folds by, where ``casefold`` folds more."""
    c = F.when(_any_of(c, ["Σ", "İ"]), F.translate(c, "Σİ", "σi")).otherwise(c)
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip(c: Column) -> Column:
    """Unicode white space off both ends; nothing but the ends is looked at."""
    return F.btrim(c, F.lit(WHITE))


def normalize(c: Column) -> Column:
    """NFC, inner blanks of a line collapsed, lines stripped, empty lines dropped.

    Other line breaks and runs of blanks are searched for as bytes and replaced only in texts that hold some; no pattern runs over the others.
    """

    def lines(t: Column) -> Column:
        t = F.when(_any_of(t, _LINE_ENDS), F.regexp_replace(t, rf"{_NEAR_SPACE}(?:{LINE_BREAK})", "\n")).otherwise(t)
        return F.array_join(F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != ""), "\n")

    def blanks(t: Column) -> Column:
        return F.when(_any_of(t, ["\t", "  "]), F.regexp_replace(t, r"(?=[\t ])(?:\t[ \t]*+| [ \t]++)", " ")).otherwise(t)

    # a lambda's variable is computed once, however often it stands there
    return F.element_at(F.transform(F.transform(F.array(nfc(c)), lines), blanks), 1)


def normalize_keep_paragraphs(c: Column) -> Column:
    """NFC, control and format characters dropped, lines stripped, runs of empty lines become one."""
    lines = F.transform(F.split(F.regexp_replace(nfc(c), r"[\p{C}&&[^\n\t]]", ""), "\n"), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def strip_boilerplate(c: Column) -> Column:
    """Each opening goes at most once, in list order."""
    phrases = F.array(*(F.lit(p) for p in BOILERPLATE))
    # a fold, as nested conditions would hold the text three times as often with each phrase
    c = F.aggregate(phrases, nfc(c), lambda t, p: F.when(F.startswith(t, p), F.substr(t, F.length(p) + 1)).otherwise(t))
    return strip(c)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def _char_class(ranges) -> str:
    return "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges) + "]"


def count_chars(c: Column, char_class: str) -> Column:
    """Characters that match a one-character pattern; they go in runs."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{char_class}++", ""))


def script_counts(c: Column) -> Column:
    """Map of script to count, scripts without characters left out."""
    return F.map_filter(F.create_map(*(x for name, r in SCRIPTS.items() for x in (F.lit(name), count_chars(c, _char_class(r))))), lambda _, n: n > 0)


def dominant_script(c: Column) -> Column:
    """Kana decides for Japanese; else the most frequent, the first met of equals; Unknown without any.

    Most texts hold characters of the first script at most, which the byte length or a loop over the text tells.
    """
    rows = [F.struct(count_chars(c, _char_class(r)).alias("n"), (-F.length(F.substring_index(F.regexp_replace(c, _char_class(r), "\u0001"), "\u0001", 1))).alias("p"), F.lit(name).alias("s")) for name, r in SCRIPTS.items()]
    best = F.array_max(F.filter(F.array(*rows), lambda x: x["n"] > 0))
    (first, ranges), *others = SCRIPTS.items()
    plain = _is_ascii(c) | c.rlike(_NO_OTHER_SCRIPT) | ~c.rlike(_char_class([r for _, own in others for r in own]))
    short = F.when(c.rlike(_char_class(ranges)), first).otherwise("Unknown")
    return F.when(plain, short).when(c.rlike(_char_class(SCRIPTS["Japanese"])), "Japanese").otherwise(F.coalesce(best["s"], F.lit("Unknown")))


def script_mismatch(language: Column, detected: Column) -> Column:
    """``language_script_mismatch:expected!=detected``, or null where nothing is expected or all is well."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_SCRIPT.items() for x in pair))
    expected = F.element_at(table, F.lower(F.trim(F.coalesce(language, F.lit("")))))
    fine = expected.isNull() | (detected == "Unknown") | (expected == detected) | ((expected == "Japanese") & (detected == "Han"))
    return F.when(~fine, F.concat(F.lit("language_script_mismatch:"), expected, F.lit("!="), detected))


def alnum_count(c: Column) -> Column:
    return count_chars(c, r"[\p{L}\p{N}]")


def visible_count(c: Column) -> Column:
    return F.when(_is_ascii(c), count_chars(c, "[!-~]")).otherwise(count_chars(c, rf"[^\s\x1c-\x1f\x85\p{{Z}}{OTHER}]"))


def control_count(c: Column) -> Column:
    pattern = rf"[{OTHER}&&[^\n\t]]"
    return F.when(c.rlike(pattern), count_chars(c, pattern)).otherwise(F.when(c.isNotNull(), 0))


def html_count(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("<")), F.length(c) - F.length(F.regexp_replace(c, HTML, ""))).otherwise(F.when(c.isNotNull(), 0))


def ratio(part: Column, text: Column) -> Column:
    return part / F.greatest(F.lit(1), F.length(text))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)


def split_words(c: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def ngrams(w: Column, n: int) -> Column:
    """Neighbours joined by a space, by zipping shifted copies: linear in the number of words."""
    out = w
    for k in range(1, n):
        out = F.zip_with(out, F.slice(w, k + 1, F.greatest(F.lit(0), F.size(w) - k)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(out, 1, F.greatest(F.lit(0), F.size(w) - n + 1))


def repetition(w: Column, n: int, least: int) -> Column:
    """1 - different / all n-grams; 0 with fewer than ``least`` words."""
    g = ngrams(w, n)
    return F.when(F.size(w) < least, F.lit(0.0)).otherwise(1.0 - F.size(F.array_distinct(g)) / F.size(g))


def repetition_metrics(w: Column) -> Column:
    """struct(token_count, unique_token_ratio, rep_3gram, rep_4gram, longest_repeated); ratios at four places, no tokens give zeros."""
    n, share = F.size(w), lambda k: F.when(F.size(w) < k, 0.0).otherwise(1 - F.size(F.array_distinct(ngrams(w, k))) / (F.size(w) - k + 1))
    unique = F.when(n > 0, F.size(F.array_distinct(w)) / n).otherwise(0.0)
    return F.struct(n.cast("long").alias("token_count"), F.round(unique, 4).alias("unique_token_ratio"), F.round(share(3), 4).alias("rep_3gram"), F.round(share(4), 4).alias("rep_4gram"), longest_run(w).cast("long").alias("longest_repeated"))


def longest_run(items: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(acc["last"].eqNullSafe(x), acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(items, start, step, lambda acc: acc["best"])


def retrieval_tokens(c: Column) -> Column:
    """NFC, punctuation deleted (not spaced), lower case, split at white space."""
    return split_words(F.lower(F.regexp_replace(nfc(c), r"[!-/:-@\[-`{-~।॥—‘’“”«»]", "")))
